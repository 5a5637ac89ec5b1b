"""Sharding: contiguous shards of near-equal bytes, cut from global byte-size prefix sums.

Order: doc_id (nulls first), then the text's checksum and size. A row goes to the shard in
which the middle of its bytes falls, so a shard misses its target by less than one row at
either end. A row weighs its text's UTF-8 bytes plus 8.

Defined results: a null text weighs 8 and has checksum 0; repeated rows are placed one after
the other; an empty table gives no rows; extra columns are ignored by `assign` and kept by
`shard_rows`, whose own columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .ordering import with_prefix

ROW_OVERHEAD = 8


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (position in the shard) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = with_prefix(rows, ["doc_id", "text_crc32", "size"], "size")
    total = placed.agg(F.max(F.col("size_before") + F.col("size")).alias("total"))
    middle = F.expr(f"cast(least({shards - 1}, ((2 * size_before + size) * {shards}) div (2 * total)) as int)")
    placed = placed.join(F.broadcast(total)).withColumn("shard", middle)
    first = placed.groupBy("shard").agg(F.min("row_index").alias("first_row"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row_index") - F.col("first_row")).alias("slot"))


def shard_rows(docs: DataFrame, shards: int = 24) -> DataFrame:
    """All columns of the rows, with shard and slot. Rows that agree in doc_id, checksum and
    size are told apart by their number among such rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    added = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in docs.columns if c.lower() not in added]
    id_, none, copy, first, n, skip = common.fresh([*kept, *added], "_id", "_none", "_copy", "_first", "_n", "_skip")
    key = lambda df: df.withColumns({id_: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), none: F.col("doc_id").isNull()})
    names = [id_, none, "text_crc32", "size"]
    rows = key(docs.select(*[F.col(f"`{c}`") for c in kept], (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    # one row per (key, shard): where copies of one row straddle shards, the n-th copy takes the n-th place
    spans = key(assign(docs, shards)).groupBy(*names, "shard").agg(F.min("slot").alias(first), F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(*names).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn(skip, F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    numbered = rows.withColumn(copy, F.row_number().over(Window.partitionBy(*names).orderBy(common.row_hash(rows))) - 1)
    placed = numbered.join(spans, names).where((F.col(copy) >= F.col(skip)) & (F.col(copy) < F.col(skip) + F.col(n)))
    return placed.select(*[F.col(f"`{c}`") for c in kept], "size", "text_crc32", "shard", (F.col(first) + F.col(copy) - F.col(skip)).alias("slot"))
