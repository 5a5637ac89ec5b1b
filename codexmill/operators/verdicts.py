"""Which stored verdicts a change makes stale, with the reason; several rules at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_page(page: str, sides: Column, hashes: Column, new_hash: str) -> Column:
    at = F.array_position(sides, F.lit(page)).cast("int")
    return F.when((at > 0) & ~F.try_element_at(hashes, F.nullif(at, F.lit(0))).eqNullSafe(F.lit(new_hash)), "content-hash")


def dimension_change(dimension: str, assumed: Column, missing: Column, sides: Column, changed: list[str]) -> Column:
    named = F.array_contains(assumed, dimension) | F.array_contains(missing, dimension)
    touched = F.arrays_overlap(sides, F.array(*[F.lit(c) for c in changed]).cast("array<string>"))
    return F.when(F.coalesce(named, F.lit(False)), "dimension-named").when(F.coalesce(touched, F.lit(False)), "dimension-changed")


def challenged(answer: str, origins: Column) -> Column:
    return F.when(F.coalesce(F.array_contains(F.map_values(origins), answer), F.lit(False)), "coordinate-challenged")


def tree_epoch(epoch: Column, new: int, coords: Column, prefixes: list[str]) -> Column:
    touches = F.exists(coords, lambda c: F.coalesce(F.exists(F.array(*[F.lit(p) for p in prefixes]).cast("array<string>"), lambda p: F.startswith(c, p)), F.lit(False)))
    return F.when((epoch != new) & F.coalesce(touches, F.lit(False)), "tree-epoch")


def authority(basis: Column, revoked: str) -> Column:
    return F.when(basis == revoked, "authority-revoked")


def comparator(version: Column, branch: str, new: str) -> Column:
    return F.when(version.startswith(branch) & (version != new), "comparator-epoch")


def mark(entries: DataFrame, reasons: list[Column], stale: str = "stale") -> DataFrame:
    """Entries with the first reason; a mark that stands is kept."""
    return entries.withColumn(stale, F.coalesce(F.col(stale), *reasons))
