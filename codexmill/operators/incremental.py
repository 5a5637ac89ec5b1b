"""Incremental maintenance by content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest(rows: DataFrame, key: str, body: Column, active: Column | None = None) -> DataFrame:
    """(key, hash) of active rows."""
    rows = rows.where(active) if active is not None else rows
    return rows.select(key, F.sha2(F.coalesce(body, F.lit("")).cast("binary"), 256).alias("hash"))


def delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added, changed or removed between two manifests."""
    both = before.withColumnRenamed("hash", "_b").join(after.withColumnRenamed("hash", "_a"), key, "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def apply_delta(index: DataFrame, changes: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """An index after a delta: rows of changed keys out, their fresh rows in. Equals a rebuild."""
    return index.join(changes.select(key), key, "left_anti").unionByName(fresh.join(changes.where("change <> 'removed'").select(key), key, "left_semi"))


def stale(entries: DataFrame, changes: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """Entries on a pair of keys of which one has changed."""
    ids = changes.select(F.col(key).alias("_k")).distinct()
    hit = lambda side: entries.join(ids, entries[side] == ids["_k"], "left_semi")
    return hit(left).unionByName(hit(right)).distinct()
