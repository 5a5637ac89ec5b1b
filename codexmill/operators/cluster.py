"""Clustering by cosine: edges, components, complete linkage, cohesion, labels, claims.

Equal vectors are one class. Classes are dealt to a fixed number of blocks and meet in pairs of
blocks, each pair once, by matrix products of bounded tiles; only pairs at or above the threshold
leave a task, tile by tile. Each task cuts its edges to a spanning forest before components run on
them by alternating minimum steps with written rounds. Complete linkage joins all pairs of groups
that are each other's nearest, round by round."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks hold at least and at most about so many classes; between the two there are BLOCKS, so
#: each class is sent to a fixed number of tasks.
BLOCK, MOST_BLOCK, BLOCKS = 1024, 1 << 17, 24
#: Rows and columns of one matrix product.
TILE = 1024, 4096
#: A task cuts its edges to a forest after so many; as many links of groups at most are left to
#: one task.
FOREST, FEW = 500_000, 100_000
#: A table is broadcast if its rows, at 32 bytes each, come to no more.
BROADCAST_BYTES = 8 << 20


def shared(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir, gone when the application ends;
    where that is unset, a folder of our own serves a single machine, and a cluster raises."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "CODEXMILL_SHARED" not in os.environ:
            os.environ["CODEXMILL_SHARED"] = tempfile.mkdtemp(prefix="codexmill-")
        root = os.environ["CODEXMILL_SHARED"]
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)  # only what exists can be marked
    fs.deleteOnExit(at)
    return path


def _written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a written table."""
    path = shared(df.sparkSession, "cut")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def classes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(class, size, v): distinct vectors, each named by its least key."""
    return rows.where(F.col(key).isNotNull() & (F.size(vector) > 0)).groupBy(F.col(vector).alias("v")).agg(F.min(key).alias("class"), F.count(F.lit(1)).alias("size"))


def copies(rows: DataFrame, named: DataFrame, key: str, vector: str) -> DataFrame:
    """(a, b): from each class to every other key that bears its vector. Vectors without a norm, or
    whose norm is not finite, are similar to nothing, so their copies have no link."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double") * x, F.lit(0.0)))
    several = named.where("size > 1").where((norm > 0) & (norm < float("inf"))).select("v", "class")
    return rows.select(F.col(vector).alias("v"), F.col(key).alias("b")).join(several, "v").where("class <> b").select(F.col("class").alias("a"), "b")


def _near(threshold: float):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, left, right = (k.as_py() for k in key)
        held = [([], []), ([], [])]
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block").to_numpy()
            names, width = batch.column("class").to_numpy(), len(batch.column("v")[0])
            v = batch.column("v").flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v /= np.where(norm == 0, 1, norm)
            for (ids, rows), of in zip(held, (left, right)):
                ids.append(names[block == of])
                rows.append(v[block == of])
        (xs, x), (ys, y) = ((np.concatenate(ids), np.concatenate(rows)) for ids, rows in held)
        for at in range(0, len(xs), TILE[0]):
            for to in range(0, len(ys), TILE[1]):
                sim = x[at : at + TILE[0]] @ y[to : to + TILE[1]].T
                i, j = np.nonzero(sim >= threshold - 1e-8)
                s = np.round(sim[i, j], 9)
                a, b = xs[at + i], ys[to + j]
                keep = (s >= threshold) & (a < b) if left == right else s >= threshold
                a, b = a[keep], b[keep]
                yield pa.record_batch([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(s[keep], pa.float64())], ["a", "b", "similarity"])

    return run


def cosine_edges(named: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of class pairs at or above the threshold, a < b."""
    named = _written(named)
    n = named.count()
    blocks = max(1, min(BLOCKS, -(-n // BLOCK)), -(-n // MOST_BLOCK))
    dealt = named.select("class", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int").alias("block"))
    # a class meets its own block once and each other block once
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select("class", "v", "block", "dim", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    return met.groupBy("dim", "left", "right").applyInArrow(_near(threshold), "a long, b long, similarity double")


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n * 32 <= BROADCAST_BYTES else rows


def cross_pairs(edges: DataFrame, settled: DataFrame, key: str, known: DataFrame | Column) -> DataFrame:
    """Similar pairs of which at least one side is not settled, without known pairs: a table of
    them, or a condition on a and b, for which no pair is moved."""
    if isinstance(known, Column):
        edges = edges.where(~F.coalesce(known, F.lit(False)))
    ids = settled.select(F.col(key).alias("_s"), F.lit(1).alias("_y"))
    ids = _small(ids, settled.count())
    left = edges.join(ids.withColumnsRenamed({"_s": "a", "_y": "_l"}), "a", "left").join(ids.withColumnsRenamed({"_s": "b", "_y": "_r"}), "b", "left")
    left = left.where("_l is null or _r is null").select("a", "b", "similarity")
    return left if isinstance(known, Column) else left.join(known, ["a", "b"], "left_anti")


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of nodes that are not the least."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(left):
        x, y = root[left], root[right]
        live = x != y
        left, right = np.minimum(x, y)[live], np.maximum(x, y)[live]
        np.minimum.at(root, right, left)
        while (root[root] != root).any():
            root = root[root]
    away = root != np.arange(len(ids))
    return ids[away], ids[root[away]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect what a task's edges connect, less than one for each node."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = base = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= FOREST + 2 * base:
            held = [_star(*map(np.concatenate, zip(*held)))]
            size = base = len(held[0][0])
    if held:
        yield pa.record_batch(list(map(pa.array, _star(*map(np.concatenate, zip(*held))))), ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of nodes with an edge: least node of each connected component."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    if dict(pairs.dtypes) == {"a": "bigint", "b": "bigint"}:
        pairs = pairs.mapInArrow(_forest, "a long, b long")
    now = _written(pairs.distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = _written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        last, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def affected(prior: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(class) of all classes that a change can reach: those linked, through new edges or earlier
    clusters (class, cluster), to a changed class. Only they need clustering again."""
    stars = prior.where("class <> cluster").select(F.col("class").alias("a"), F.col("cluster").alias("b"))
    roots = components(edges.select("a", "b").unionByName(stars))
    whole = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    hit = whole.join(changed.select(F.col("class").alias("node")).distinct(), "node").select("root").distinct()
    return whole.join(hit, "root", "left_semi").select(F.col("node").alias("class")).unionByName(changed.select("class")).distinct()


def spliced(prior: DataFrame, reach: DataFrame, fresh: DataFrame) -> DataFrame:
    """Earlier clusters with the rows of affected classes replaced."""
    return prior.join(reach, "class", "left_anti").unionByName(fresh)


def linked(edges: Iterable[tuple[int, int, float]], threshold: float) -> dict[int, int]:
    """{node: least node of its group}: of all pairs of groups whose members are all linked, the
    pair with the highest least similarity joins, ties by the least members; memory grows with
    the edges, not with the square of the nodes."""
    near: dict[int, dict[int, float]] = {}
    heap = []
    for a, b, s in edges:
        a, b = min(a, b), max(a, b)
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = s
        heap.append((-s, a, b))
    heapify(heap)
    group = {x: [x] for x in near}
    while heap:
        s, a, b = heappop(heap)
        if -s < threshold:
            break
        if near.get(a, {}).get(b) != -s:  # one of them has joined another group since
            continue
        left, right = near.pop(a), near.pop(b)
        both = {x: min(left[x], right[x]) for x in left.keys() & right.keys()}
        for x in left.keys() | right.keys():
            if x in near:
                near[x].pop(a, None)
                near[x].pop(b, None)
        near[a] = both
        for x, v in both.items():
            near[x][a] = v
            heappush(heap, (-v, min(a, x), max(a, x)))
        group[a] += group.pop(b)
    return {x: min(g) for g in group.values() for x in g}


def _linkage(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = linked(zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["similarity"].tolist()), threshold)
        return pd.DataFrame(sorted(found.items()), columns=["class", "cluster"]).astype("int64")

    return run


def complete_linkage(edges: DataFrame, roots: DataFrame | None, threshold: float) -> DataFrame:
    """(class, cluster): complete linkage of classes with an edge, each edge given once; of those
    in the components of `roots` where these are given (no step needs them).

    A joined group is never nearer to a third than its parts were, so two groups that are each
    other's nearest join whatever joins before; all such pairs of a round join at once, with the
    same result as `linked`, ties by the least members. Only links of joined groups are shuffled,
    and most of them end, as a link to a joined group needs one to either part."""
    links = edges.where((F.col("a") != F.col("b")) & (F.col("similarity") >= threshold)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    if roots is not None:
        # the larger end of an edge is never its component's least node, which `roots` leaves out
        links = links.join(roots.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", "similarity")
    links = _written(links)
    ends = lambda df, *columns: df.select(F.col("a").alias("x"), *columns).unionByName(df.select(F.col("b").alias("x"), *columns))
    clusters = _written(ends(links).distinct().select(F.col("x").alias("class"), F.col("x").alias("cluster")))
    nodes = clusters.count()
    while links.count() > FEW:
        most = _written(ends(links, "similarity").groupBy("x").agg(F.max("similarity").alias("most")))
        most = _small(most, nodes)
        near = links.join(most.select(F.col("x").alias("a"), F.col("most").alias("_l")), "a").join(most.select(F.col("x").alias("b"), F.col("most").alias("_r")), "b")
        # a group's nearest: of its links of the highest similarity the first by members
        near = near.where("similarity = _l or similarity = _r").select("a", "b", "similarity", "_l", "_r")
        first = near.where("similarity = _l").select(F.col("a").alias("x"), "a", "b").unionByName(near.where("similarity = _r").select(F.col("b").alias("x"), "a", "b"))
        pairs = first.groupBy("x").agg(F.min(F.struct("a", "b")).alias("p")).groupBy("p.a", "p.b").count().where("count = 2")
        joined = _written(pairs.select(F.explode(F.array("a", "b")).alias("x"), F.col("a").alias("to")))
        to = _small(joined, nodes)
        moved = links.join(to.select(F.col("x").alias("a"), F.col("to").alias("_l")), "a", "left").join(to.select(F.col("x").alias("b"), F.col("to").alias("_r")), "b", "left")
        still = moved.where("_l is null and _r is null").select("a", "b", "similarity")
        x, y = F.coalesce("_l", "a"), F.coalesce("_r", "b")
        touched = moved.where("_l is not null or _r is not null").where(x != y)
        touched = touched.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "similarity", F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 4).otherwise(2).alias("parts"))
        # linked if all parts are
        whole = touched.groupBy("a", "b").agg(F.min("similarity").alias("similarity"), F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts")).where("n = parts").select("a", "b", "similarity")
        links = _written(still.unionByName(whole))
        clusters = _written(clusters.join(to.select(F.col("x").alias("cluster"), "to"), "cluster", "left").select("class", F.coalesce("to", "cluster").alias("cluster")))
    rest = links.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_linkage(threshold), "class long, cluster long").select(F.col("class").alias("cluster"), F.col("cluster").alias("to"))
    return clusters.join(rest, "cluster", "left").select("class", F.coalesce("to", "cluster").alias("cluster"))


def cohesion(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, members, mean_similarity, min_similarity): over pairs of classes inside."""
    a = clusters.select(F.col("class").alias("a"), F.col("cluster").alias("ca"))
    b = clusters.select(F.col("class").alias("b"), F.col("cluster").alias("cb"))
    pairs = edges.join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.round(F.avg("similarity"), 6).alias("mean_similarity"), F.round(F.min("similarity"), 6).alias("min_similarity"))
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    return sizes.join(pairs, "cluster", "left").fillna(1.0, ["mean_similarity", "min_similarity"])


def gate(sources: Column, confidence: Column, mean: Column, least: Column, threshold: float = 0.55) -> Column:
    """The first reason against a merge, in fixed order: too many sources, a chain, a loose mean,
    low confidence; null where there is none."""
    return F.when(sources > 5, "size").when(least < threshold, "chain").when(mean < 0.6, "cohesion").when(confidence < 0.0, "confidence")


def low_cohesion(mean: Column, scopes: Column, floor: float, least: int) -> Column:
    """A loose group over many scopes; a floor of 0 turns the test off."""
    return F.lit(floor > 0) & (mean < floor) & (scopes >= least)


def cluster_id(members: Column, scope: Column) -> Column:
    """Content address: scope, then eight hex digits of the sorted members."""
    return F.concat(F.coalesce(F.nullif(F.regexp_replace(scope, "^[-_]+|[-_]+$", ""), F.lit("")), F.lit("unscoped")), F.lit("-"), F.substring(F.sha1(F.array_join(F.array_sort(members), "\n").cast("binary")), 1, 8))


def topic_words(rows: DataFrame, group: str, key: str, words: Column, most: int = 3) -> DataFrame:
    """(group, topic): the words in most members, then most often, then first in the alphabet.
    Where no member has several rows, words are counted within rows, and only words of groups are
    shuffled."""
    from pyspark.sql import Window

    if rows.groupBy(group, key).count().where("count > 1").isEmpty():
        each = rows.select(group, words.alias("w")).withColumn("d", F.array_distinct("w"))
        terms = each.select(group, F.size("d").alias("k"), F.posexplode(F.concat("d", "w")).alias("at", "word"))
        per = terms.groupBy(group, "word").agg(F.count_if(F.col("at") < F.col("k")).alias("members"), F.count_if(F.col("at") >= F.col("k")).alias("total"))
    else:
        terms = rows.select(group, key, F.explode(words).alias("word"))
        per = terms.groupBy(group, key, "word").agg(F.count(F.lit(1)).alias("n")).groupBy(group, "word").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    order = Window.partitionBy(group).orderBy(F.desc("members"), F.desc("total"), "word")
    top = per.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), "-").alias("topic"))


def shared_words(rows: DataFrame, group: str, key: str, words: Column) -> DataFrame:
    """(group, word) of words that every member of a group has."""
    per = rows.select(group, key, F.explode(F.array_distinct(words)).alias("word")).groupBy(group, "word").agg(F.count(F.lit(1)).alias("members"))
    return per.join(rows.groupBy(group).agg(F.count(F.lit(1)).alias("members")), [group, "members"]).select(group, "word")


def recurring_claims(rows: DataFrame, key: str, claim: Column, least: int = 2) -> DataFrame:
    """(claim_key, entities, occurrences): normalised claims made by several entities."""
    claims = rows.select(key, F.explode(claim).alias("claim")).where(F.length("claim") > 0)
    hashed = claims.select(key, F.substring(F.sha1(F.col("claim").cast("binary")), 1, 16).alias("claim_key"))
    per = hashed.groupBy("claim_key", key).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("claim_key").agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("occurrences")).where(F.col("entities") >= least)
