"""Two partitions of the same rows held against each other, as single and complete linkage of one
set of edges: which groups one of them splits or merges, and how many pairs they agree on.

All of it is counting in the contingency table (one row per pair of groups that share a member), so
pairs of rows are never made. Rows that one side lacks are groups of their own there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(rows: DataFrame, a: DataFrame, b: DataFrame, key: str, group: str) -> DataFrame:
    """(a, b, n): how many keys of `rows` lie in both groups; `a` and `b`: (key, group)."""
    side = lambda df, name: df.select(key, F.col(group).alias(name))
    both = rows.select(key).distinct().join(side(a, "a"), key, "left").join(side(b, "b"), key, "left")
    return both.groupBy(F.coalesce("a", key).alias("a"), F.coalesce("b", key).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def parted(table: DataFrame, of: str, by: str) -> DataFrame:
    """(group, members, parts, largest) of the groups of one side that the other side parts."""
    each = table.groupBy(F.col(of).alias("group")).agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("parts"), F.max("n").alias("largest"))
    return each.where("parts > 1")


def agreement(table: DataFrame) -> DataFrame:
    """One row: groups of either side, how many are split and merged, pairs together in a, in b and
    in both, the Rand index and the adjusted one (1 where either side has no choice)."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2).cast("double")
    side = lambda name: table.groupBy(name).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).agg(F.count(F.lit(1)).alias(f"groups_{name}"), F.count_if(F.col("parts") > 1).alias("splits" if name == "a" else "merges"), F.coalesce(pairs("n"), F.lit(0.0)).alias(f"pairs_{name}"))
    both = table.agg(F.coalesce(pairs("n"), F.lit(0.0)).alias("pairs_both"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    one = both.join(F.broadcast(side("a"))).join(F.broadcast(side("b")))  # one row each
    whole = F.col("rows") * (F.col("rows") - 1) / 2
    chance = F.try_divide(F.col("pairs_a") * F.col("pairs_b"), whole)
    room = (F.col("pairs_a") + F.col("pairs_b")) / 2 - chance
    rand = F.coalesce(F.try_divide(whole + 2 * F.col("pairs_both") - F.col("pairs_a") - F.col("pairs_b"), whole), F.lit(1.0))
    adjusted = F.coalesce(F.try_divide(F.col("pairs_both") - chance, room), F.lit(1.0))
    return one.select("rows", "groups_a", "groups_b", "splits", "merges", "pairs_a", "pairs_b", "pairs_both", F.round(rand, 9).alias("rand"), F.round(adjusted, 9).alias("adjusted"))
