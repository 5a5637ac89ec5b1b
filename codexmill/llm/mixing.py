"""Mixing sources to target weights by systematic sampling.

Targets: sources share `share` of all words by weight; a target stops at `most` times its
source's words and the excess is shared again by weight until no target is above.

Within a source every document expects target / source words copies. Documents stand in the
order of their size (then doc_id and checksum), so neighbours are alike; expected copies are
prefix-summed from one random offset per source, and a document is emitted once for each whole
number that its stretch crosses: floor or ceiling of its expectation, so at most `most`. As
neighbours are alike in size, the words taken miss the target by about one document's size.

Defined results: a null text has 0 words; the null source is a source of its own, last in
order; a source without words gets target 0 and no copies; repeated rows are drawn one by one;
extra columns are ignored by `plan`. `mix_rows` emits the input's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .ordering import unit, with_prefix

WEIGHTS = (3, 1, 2)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """source, source_size -> number, weight and target, from one row per source.

    Sources fill in the order of most * size / weight. After the first k have stopped, the rest
    share what is left by weight; a source has stopped if it is below that level when its turn
    comes. Sums are integers, so the levels don't depend on the order of addition. Both orders
    are prefix sums over ranges of sources, so sources may be as many as hosts."""
    up, down = share
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    out = sources.withColumns({"_none": F.col("source").isNull(), "_code": F.col("source").cast("string").cast("binary"), "_one": F.lit(1).cast("long")})
    out = with_prefix(out, ["_none", "_code"], "_one", "number", "_before")
    out = out.withColumn("weight", cycle[(F.col("number") % len(weights)).cast("int")].cast("long"))
    out = out.withColumn("_rate", F.col("source_size") / F.col("weight"))
    out = common.written(out.select("source", "source_size", "number", "weight", "_rate"), "mix-sources")
    whole = out.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_w"))  # one row
    out = with_prefix(out, ["_rate", "number"], "source_size", "_place", "_full")
    out = with_prefix(out, ["_rate", "number"], "weight", "_place", "_gone").join(F.broadcast(whole))
    left = F.col("_all") * up - F.col("_full") * most * down  # words left to share, times `down`
    out = out.withColumn("_rest", F.col("_w") - F.col("_gone")).withColumn("_left", left)
    out = common.written(out.withColumn("_stops", F.col("source_size") * most * down * F.col("_rest") <= F.col("weight") * F.col("_left")), "mix-filled")
    # the first that doesn't stop has the largest rest of weights
    level = out.where("not _stops").agg(F.max(F.struct("_rest", "_left")).alias("_level"))  # one row
    out = out.join(F.broadcast(level))
    share_of = F.col("weight") * F.col("_level._left") / (F.col("_level._rest") * down)
    return out.select("source", "source_size", F.col("number").cast("int").alias("number"), "weight", F.when(F.col("_stops"), (F.col("source_size") * most).cast("double")).otherwise(share_of).alias("target"))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (and source, text_crc32, text_key) of every
    row."""
    rows = docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), _text_key().alias("text_key"))
    rows = common.written(rows, "mix-sizes")
    sources = common.written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    rows = rows.join(common.small(sources), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = with_prefix(rows, ["number", "size", "doc_id", "text_crc32"], "size")
    first = common.written(placed.groupBy("number").agg(F.min("row_index").alias("_first")), "mix-first")
    placed = placed.join(common.small(first), "number")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = (F.col("row_index") - F.col("_first")).cast("double")
    offset = unit(F.concat(F.lit(seed + ":"), F.coalesce(F.col("source").cast("string"), F.lit("\x00null"))))
    crossed = F.floor(offset + (place + 1) * rate) - F.floor(offset + place * rate)
    placed = placed.withColumn("copies", F.least(crossed, F.lit(most)).cast("long"))
    return placed.select("doc_id", "source", "text_crc32", "text_key", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is drawn, with the input's columns."""
    drawn = plan(docs, **options)
    keys = ["doc_id", "source", "text_key"]
    doc_id, source, key, copies, rows, own, nth, times, draw = common.fresh(docs.columns, "_id", "_source", "_key", "_copies", "_rows", "_own", "_nth", "_times", "_draw")
    # rows that agree in all keys are interchangeable; the n-th of them takes the n-th count
    counts = drawn.groupBy(*keys).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)).withColumnsRenamed(dict(zip(keys, (doc_id, source, key))))
    counts = common.written(counts, "mix-plan")
    named = docs.withColumn(own, _text_key())
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(own) == F.col(key))
    # whole texts move once, whatever their number: a broadcast would hold a row for each document
    joined = named.join(counts, same).select(*[F.col(f"`{c}`") for c in docs.columns], own, copies, rows)
    out = joined.where(F.col(rows) == 1).withColumn(times, F.col(copies))
    if not counts.where(F.col(rows) > 1).isEmpty():
        # by the same key as the counts, in an order that a stage run again keeps
        number = F.row_number().over(Window.partitionBy("doc_id", "source", own).orderBy(common.row_hash(docs))) - 1
        again = joined.where(F.col(rows) > 1).withColumn(nth, number)
        each = F.floor(F.col(copies) / F.col(rows)) + F.when(F.col(nth) < F.col(copies) % F.col(rows), 1).otherwise(0)
        out = out.unionByName(again.withColumn(times, each).drop(nth))
    draws = F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"))).alias(draw)
    return out.where(F.col(times) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], draws).drop(draw)
