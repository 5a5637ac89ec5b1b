"""A stored lexical index over several fields: stems of words, posting lists in ranges of terms,
read only where a query's words are.

Layout below a folder: `postings/segment=<n>/part=<r>` holds (term, key, tf, length) sorted by term
and key, where tf counts each field; parts are ranges of (term, key) of about equal size, so their
number follows the postings and the list of a common word lies in several. `ranges/segment=<n>`
names each part's first and last term; `docs/v=<n>` holds one row per indexed page (key, the
columns that filters need, length, segment). An update appends the changed pages as a new segment
and writes the narrow docs table anew; postings whose segment is not the page's present one are
dead. Queries read the parts that their words' terms fall in, and filters hold before the ranking.

Words are counted within a page before anything is shuffled; postings are shuffled once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.functions.stemming import stem, stems, words
from codexmill.session import bound_batches, spread

from .retrieval import STOPWORDS

#: Postings of a part: at most about so many; smaller indexes have parts down to the second figure,
#: so that all tasks take part.
PART_ROWS, LEAST_ROWS = 4_000_000, 100_000
#: Words are counted in slices of a batch of about so many bytes of text, or of one longer page.
SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Index:
    """A version of a stored index: where it lies, its fields, pages and mean length."""

    path: str
    key: str
    fields: tuple[str, ...]
    version: int
    pages: int
    mean: float
    schema: str = ""

    def docs(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/docs/v={self.version}")

    def postings(self, spark: SparkSession, terms: list[str] | None = None) -> DataFrame:
        """Live postings, of some terms or of all; of terms only their parts are listed and read."""
        at = f"{self.path}/postings"
        if terms is None:
            rows = spark.read.schema(self.schema).parquet(at)
        else:
            ranges = spark.read.schema("low string, high string, part int, segment int").parquet(f"{self.path}/ranges")
            held = ranges.where(reduce(Column.__or__, [(F.col("low") <= t) & (F.col("high") >= t) for t in terms])).collect()  # parts of the query's words
            if not held:
                return spark.createDataFrame([], self.schema)
            rows = spark.read.schema(self.schema).option("basePath", at).parquet(*[f"{at}/segment={r.segment}/part={r.part}" for r in held]).where(F.col("term").isin(*terms))
        if self.version:
            rows = rows.join(self.docs(spark).select(self.key, "segment"), [self.key, "segment"], "left_semi")
        return rows


def _slices(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts from column `first` on come to about SLICE_BYTES."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns[first:]:
            size += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def _counted(fields: int, extra: int):
    """For each page a row without a term, with the extra columns, and a row for each of its stems."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1 + extra):
            at, heads, lengths, terms, tfs = [], [], [], [], []
            for row, texts in enumerate(zip(*(batch.column(1 + extra + i).to_pylist() for i in range(fields)))):
                counts: dict[str, list[int]] = {}
                total = 0
                for i, text in enumerate(texts):
                    for word, n in Counter(words(text)).items():
                        total += n
                        counts.setdefault(stem(word), [0] * fields)[i] += n
                at += [row] * (1 + len(counts))
                heads += [row, *[None] * len(counts)]
                lengths += [total] * (1 + len(counts))
                terms += [None, *counts]
                tfs += [[0] * fields, *counts.values()]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(tfs) + 1) * fields, pa.int32()), pa.array(list(chain.from_iterable(tfs)), pa.int32()))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(batch.column(1 + i).take(pa.array(heads, pa.int64())) for i in range(extra))]
            yield pa.record_batch([*columns, pa.array(lengths, pa.int32()), pa.array(terms, pa.string()), listed], [*batch.schema.names[: 1 + extra], "length", "term", "tf"])

    return run


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _segment(pages: DataFrame, key: str, fields: dict[str, Column], extra: list[str], number: int, path: str) -> DataFrame:
    """Write the postings of some pages as a segment; their docs rows."""
    spark = pages.sparkSession
    bound_batches(spark)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in [key, *extra])
    read = spread(pages.select(key, *extra, *[c.cast("string").alias(f"_f{i}") for i, c in enumerate(fields.values())]))
    counted = f"{path}/counted-{number}"
    read.mapInArrow(_counted(len(fields), len(extra)), f"{kinds}, length int, term string, tf array<int>").write.mode("overwrite").parquet(counted)
    rows = spark.read.parquet(counted)
    postings = rows.where("term is not null").select("term", key, "tf", "length")
    n = postings.count()
    parts = max(math.ceil(n / PART_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / LEAST_ROWS)), 1)
    at = f"{path}/postings/segment={number}"
    placed = postings.repartitionByRange(parts, "term", key).sortWithinPartitions("term", key)
    placed.withColumn("part", F.spark_partition_id()).write.mode("overwrite").partitionBy("part").parquet(at)
    ranges = spark.read.schema(", ".join(f"`{c}` {t}" for c, t in [*postings.dtypes, ("part", "int")])).parquet(at).groupBy("part").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    ranges.select("low", "high", "part").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges/segment={number}")
    return rows.where("term is null").select(key, *extra, "length", F.lit(number).alias("segment"))


def _open(spark: SparkSession, index: Index) -> Index:
    n, total = index.docs(spark).agg(F.count(F.lit(1)), F.sum("length")).first()
    return replace(index, pages=n, mean=float(total or 0) / n if n else 0.0)


def build(pages: DataFrame, key: str, fields: dict[str, Column], path: str, extra: list[str] | None = None) -> Index:
    """Index whole fields of all pages below `path`."""
    spark = pages.sparkSession
    docs = _segment(pages, key, fields, extra or [], 0, path)
    docs.write.mode("overwrite").parquet(f"{path}/docs/v=0")
    _remove(spark, f"{path}/counted-0")
    schema = f"term string, `{key}` {pages.schema[key].dataType.simpleString()}, tf array<int>, length int, segment int, part int"
    return _open(spark, Index(path, key, tuple(fields), 0, 0, 0.0, schema))


def update(index: Index, changed: DataFrame, fields: dict[str, Column], removed: DataFrame) -> Index:
    """The next version: changed and added pages in, removed keys out. Answers as a rebuild does."""
    spark, key, number = changed.sparkSession, index.key, index.version + 1
    old = index.docs(spark)
    extra = [c for c in old.columns if c not in (key, "length", "segment")]
    docs = _segment(changed, key, fields, extra, number, index.path)
    gone = changed.select(key).unionByName(removed.select(key)).distinct()
    old.join(gone, key, "left_anti").unionByName(docs).write.mode("overwrite").parquet(f"{index.path}/docs/v={number}")
    _remove(spark, f"{index.path}/counted-{number}")
    return _open(spark, replace(index, version=number))


def query_terms(query: str) -> list[str]:
    """Distinct stems of up to eight words of three letters or more, common ones left out."""
    return list(dict.fromkeys(s for w in T.query_tokens(query, least=3, most=8, stopwords=STOPWORDS) for s in stems(w)))


def search(spark: SparkSession, index: Index, query: str, k: int, where: Column | None = None, weights: tuple[float, ...] | None = None, k1: float = 1.2, b: float = 0.75, floor: float | None = None) -> DataFrame:
    """(key, score) of the k best pages by BM25 over the fields, words joined by OR; counts are
    of all pages, the filter holds before the ranking; ties by key. A word's weight is
    ln(1 + odds); with `floor`, ln(odds), but `floor` for words that most pages hold."""
    terms = query_terms(query)
    if not terms or not index.pages:
        return index.docs(spark).select(index.key, F.lit(0.0).alias("score")).limit(0)
    rows = index.postings(spark, terms)
    found = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per query word
    idf = F.lit(0.0)
    for term, n in found.items():
        odds = (index.pages - n + 0.5) / (n + 0.5)
        weight = math.log(1 + odds) if floor is None else math.log(odds) if odds > 1 else floor
        idf = F.when(F.col("term") == term, weight).otherwise(idf)
    tf = F.lit(0.0)
    for i, weight in enumerate(weights or (1.0,) * len(index.fields)):
        tf = tf + F.col("tf")[i] * weight
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / index.mean))
    if where is not None:
        rows = rows.join(index.docs(spark).where(where).select(index.key), index.key, "left_semi")
    scored = rows.select(index.key, part.alias("part")).groupBy(index.key).agg(F.round(F.sum("part"), 6).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), index.key).limit(k)


def dictionary(spark: SparkSession, index: Index) -> DataFrame:
    """(term, df, cf): the index's stems with their pages and occurrences."""
    count = F.aggregate("tf", F.lit(0), lambda acc, x: acc + x)
    return index.postings(spark).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(count).alias("cf"))
