"""A stored vector index: coarse centroids and lists of the vectors nearest to each, read only
where a query or a key points; upsert, purge and look-up by key.

Layout below a folder: `lists/segment=<n>/list=<c>` holds (key, extra columns, vector, away), where
`away` is the distance to the list's centroid; `stats/segment=<n>` each list's rows and radius;
`docs/v=<n>` one narrow row per indexed key with its list and segment. An update appends a segment
and writes docs anew; rows whose segment is not their key's present one are dead.

Centroids are fitted on SAMPLE vectors at most, chosen by hash; every vector is indexed. Search
reads the nearest lists; `exact` then also reads each list whose centroid is not further away than
the k-th distance plus the list's radius, so no neighbour is missed (the triangle inequality).
Without it, only the nearest `probes` lists are read.

Defined results: vectors that are null, of another length than most of the sample, or hold null or
non-finite components are not indexed; of repeated keys each row is kept; an empty table gives an
index that finds nothing; ties stand by key.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE, ROUNDS, MOST_LISTS = 20_000, 8, 4096


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _gaps(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centroids."""
    return np.maximum((rows * rows).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * rows @ centroids.T, 0)


def fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced rows; those without rows keep their place."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _gaps(sample, centroids).argmin(1)
        count = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return centroids


@dataclass(frozen=True)
class Index:
    path: str
    key: str
    vector: str
    version: int
    centroids: np.ndarray
    schema: str

    def docs(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/docs/v={self.version}")

    def rows(self, spark: SparkSession, lists: list[int]) -> DataFrame:
        """Live rows of some lists; only those are listed and read."""
        stats = spark.read.parquet(f"{self.path}/stats")
        held = stats.where(F.col("list").isin(lists)).select("segment", "list").collect() if lists else []
        if not held:
            return spark.createDataFrame([], self.schema)
        at = f"{self.path}/lists"
        out = spark.read.schema(self.schema).option("basePath", at).parquet(*[f"{at}/segment={r.segment}/list={r.list}" for r in held])
        return out.join(self.docs(spark).where(F.col("list").isin(lists)).select(self.key, "segment"), [self.key, "segment"], "left_semi") if self.version else out

    def radii(self, spark: SparkSession) -> dict[int, float]:
        """The radius of each list: a row per list."""
        return dict(spark.read.parquet(f"{self.path}/stats").groupBy("list").agg(F.max("radius")).collect())


def _usable(vector: str, width: int | None = None) -> Column:
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(whole & (F.size(vector) == width) if width else whole, F.lit(False))


def _dealt(centroids: np.ndarray, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gaps = _gaps(_matrix(batch.column(at), centroids.shape[1]), centroids)
                near = gaps.argmin(1)
                away = np.sqrt(gaps[np.arange(len(near)), near])
                yield pa.record_batch([*batch.columns, pa.array(away), pa.array(near.astype(np.int32))], [*batch.schema.names, "away", "list"])

    return run


def _segment(vectors: DataFrame, index: Index, extra: list[str], number: int) -> DataFrame:
    """Write a segment; its docs rows."""
    spark, width = vectors.sparkSession, index.centroids.shape[1]
    read = vectors.where(_usable(index.vector, width)).select(index.key, *extra, F.col(index.vector).cast("array<double>").alias(index.vector))
    kinds = ", ".join(f"`{c}` {t}" for c, t in read.dtypes)
    dealt = read.mapInArrow(_dealt(index.centroids, len(extra) + 1), f"{kinds}, away double, list int")
    # lists that very many rows fall in are split
    at = f"{index.path}/lists/segment={number}"
    dealt.hint("rebalance", F.col("list")).write.mode("overwrite").partitionBy("list").parquet(at)
    rows = spark.read.schema(f"{kinds}, away double, list int").parquet(at)
    rows.groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius")).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/stats/segment={number}")
    return rows.select(index.key, "list", F.lit(number).alias("segment"))


def build(vectors: DataFrame, key: str, vector: str, path: str, extra: list[str] | None = None, lists: int | None = None) -> Index:
    """Index all vectors below `path`. `lists`: about the square root of their number by default."""
    spark, extra = vectors.sparkSession, extra or []
    good = vectors.where(_usable(vector))
    sample = good.select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64(vector)).limit(SAMPLE).collect()  # SAMPLE rows
    widths = [len(r.v) for r in sample]
    width = max(set(widths), key=widths.count, default=1)
    rows = np.array([r.v for r in sample if len(r.v) == width], np.float64).reshape(-1, width)
    lists = lists or min(MOST_LISTS, max(1, round(math.sqrt(good.count()))))
    centroids = fitted(rows, lists) if len(rows) else np.zeros((1, width))
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in [key, *extra])
    index = Index(path, key, vector, 0, centroids, f"{kinds}, `{vector}` array<double>, away double, segment int, list int")
    _segment(vectors, index, extra, 0).write.mode("overwrite").parquet(f"{path}/docs/v=0")
    spark.createDataFrame([(json.dumps(centroids.tolist()),)], "centroids string").coalesce(1).write.mode("overwrite").text(f"{path}/centroids")
    return index


def upsert(index: Index, changed: DataFrame) -> Index:
    """The next version with some keys' vectors added or replaced."""
    spark, number = changed.sparkSession, index.version + 1
    extra = [p.strip().split(" ")[0].strip("`") for p in index.schema.split(", `")[1:-1]]
    added = _segment(changed, index, extra, number)
    gone = changed.select(index.key).distinct()
    index.docs(spark).join(gone, index.key, "left_anti").unionByName(added).write.mode("overwrite").parquet(f"{index.path}/docs/v={number}")
    return replace(index, version=number)


def purge(index: Index, keys: DataFrame) -> Index:
    """The next version without some keys."""
    spark, number = keys.sparkSession, index.version + 1
    index.docs(spark).join(keys.select(index.key).distinct(), index.key, "left_anti").write.mode("overwrite").parquet(f"{index.path}/docs/v={number}")
    return replace(index, version=number)


def fetch(spark: SparkSession, index: Index, keys: list) -> DataFrame:
    """(key, vector) of some keys, missing ones left out; only their lists are read."""
    at = index.docs(spark).where(F.col(index.key).isin(keys)).select("list").distinct().collect()  # a row per list at most
    return index.rows(spark, [r.list for r in at]).where(F.col(index.key).isin(keys)).select(index.key, index.vector)


def nearest(spark: SparkSession, index: Index, query: list[float], k: int, probes: int = 4, exact: bool = True, where: Column | None = None) -> DataFrame:
    """(key, distance) of the k nearest rows by squared Euclidean distance, ties by key."""
    q = np.array(query, np.float64)
    away = np.sqrt(_gaps(q[None], index.centroids)[0])
    order = [int(c) for c in np.argsort(away, kind="stable")]
    literal = F.array(*[F.lit(float(x)) for x in query])
    gap = F.aggregate(F.zip_with(index.vector, literal, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)

    def best(lists: list[int]) -> DataFrame:
        rows = index.rows(spark, lists)
        rows = rows.where(where) if where is not None else rows
        return rows.select(index.key, F.round(gap, 6).alias("distance")).orderBy("distance", index.key).limit(k)

    if not exact:
        return best(order[:probes])
    radii = index.radii(spark)
    order = [c for c in order if c in radii]
    found = best(order[:probes]).collect()  # k rows
    bound = math.sqrt(found[-1]["distance"]) + 1e-3 if len(found) == k else math.inf
    return best([c for i, c in enumerate(order) if i < probes or away[c] - radii[c] <= bound])
