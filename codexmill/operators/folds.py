"""Folds of append-only logs: latest wins, retractions, pending lists, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by max_by: partial aggregation, no group is gathered."""
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_l"))
    return top.select(*keys, "_l.*")


def fold_observations(observations: DataFrame, retractions: DataFrame, id_: str, keys: list[str], order: list[str]) -> DataFrame:
    """Retracted observations out, then the latest of each key."""
    return latest(observations.join(retractions.select(id_).distinct(), id_, "left_anti"), keys, order)


def compact(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every entry with `live`: the last of its key, the rest are history."""
    last = entries.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    return entries.join(last, keys).withColumn("live", F.struct(*order) == F.col("_last")).drop("_last")


def resolved(records: DataFrame, key: str, human: Column, order: str) -> DataFrame:
    """One record per key: people before machines, then the last written."""
    rows = records.withColumn("_h", human.cast("int"))
    return latest(rows, [key], ["_h", order]).drop("_h")


def pending(raised: DataFrame, settled: DataFrame, key: str) -> DataFrame:
    return raised.join(settled.select(key).distinct(), key, "left_anti")


def audit(ledger: DataFrame, key: str, action: str, order: str) -> DataFrame:
    """(key, last_action, actions, first, last) in ledger order."""
    return ledger.groupBy(key).agg(F.max_by(action, order).alias("last_action"), F.count(F.lit(1)).alias("actions"), F.min(order).alias("first"), F.max(order).alias("last"))


def streaks(ledger: DataFrame, key: str, failed: Column, order: str) -> DataFrame:
    """(key, failures): failures since the last success of each key."""
    rows = ledger.select(key, order, failed.alias("f"))
    good = rows.where(~F.col("f")).groupBy(key).agg(F.max(order).alias("_ok"))
    since = rows.where("f").join(good, key, "left").where(F.col("_ok").isNull() | (F.col(order) > F.col("_ok")))
    return since.groupBy(key).agg(F.count(F.lit(1)).alias("failures"))


def chunks(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """Rows numbered newest first in chunks of `most`."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / most))
