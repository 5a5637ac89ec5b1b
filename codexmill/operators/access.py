"""Row-level access, activity and validity. Access fails closed, dates fail open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def authorized(access: Column, audience: Column, roles: list[str], owner: bool = False) -> Column:
    """The owner, an open row, or a role in common; unknown is no."""
    if owner:
        return F.lit(True)
    common = F.arrays_overlap(audience, F.array(*[F.lit(r) for r in roles]).cast("array<string>"))
    return F.coalesce((access == "open") | common, F.lit(False))


def all_authorized(sources: Column, test) -> Column:
    """Every source passes; none is no."""
    return F.coalesce((F.size(sources) > 0) & F.forall(sources, test), F.lit(False))


def expired(valid_until: Column, as_of: Column) -> Column:
    """Past its last valid day; without one it never expires."""
    return F.coalesce(as_of > valid_until, F.lit(False))


def inactive(superseded: Column, deprecated: Column, valid_until: Column, as_of: Column, bucket: Column | None = None) -> Column:
    """Superseded, deprecated or expired; an expired row of the daily bucket stays visible."""
    gone = expired(valid_until, as_of)
    if bucket is not None:
        gone = gone & (F.coalesce(bucket, F.lit("")) != "daily")
    return F.coalesce(superseded, F.lit(False)) | F.coalesce(deprecated, F.lit(False)) | gone


def more_restrictive(a: Column, b: Column) -> Column:
    """The stricter of two access levels; an unknown one gives way."""
    rank = lambda c: F.coalesce(F.try_element_at(F.create_map(*[x for i, v in enumerate(("open", "internal", "confidential", "personal")) for x in (F.lit(v), F.lit(i))]), F.lower(F.trim(c))), F.lit(-1))
    return F.when(rank(a) >= rank(b), a).otherwise(b)


def swept(pages: DataFrame, bucket: Column, valid_until: Column, as_of: Column) -> DataFrame:
    """Pages of the daily bucket with their disposition: kill when expired, else kept."""
    rows = pages.where(F.coalesce(bucket, F.lit("")) == "daily")
    return rows.withColumn("disposition", F.when(expired(valid_until, as_of), "kill").otherwise("keep: not yet expired"))
