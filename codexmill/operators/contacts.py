"""Contact facts on the excluded surface: marks, classes, reads that name what they hold back.

A batch of keys meets the records by one join, whatever its size; reads without permission carry
the field and how many values it has, never the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .handles import normal

# Classes of use, and the only one that may be written to.
OBSERVED, PROVIDER, UNCLASSIFIED = "observed", "provider", "unclassified"


def flagged(flag: Column) -> Column:
    """A truthy text flag; missing is no."""
    return F.coalesce(F.lower(F.trim(flag)).isin("true", "1", "yes"), F.lit(False))


def bounced(valid_until: Column, as_of: Column) -> Column:
    """Closed before `as_of`; an open or undated address is not."""
    return F.coalesce(as_of > valid_until, F.lit(False))


def classified(values: DataFrame, entries: DataFrame, record: str) -> DataFrame:
    """Values (record, identifier) with usage_class and whether they may be written to; the first
    entry of an address holds, and a value without one is unclassified."""
    first = entries.select(F.col(record).alias("_r"), normal(F.col("identifier")).alias("_i"), F.col("usage_class").alias("_u"), F.col("seq").alias("_s"))
    first = first.groupBy("_r", "_i").agg(F.min_by(F.coalesce("_u", F.lit("")), "_s").alias("_u"))
    out = values.join(first, (F.col(record) == F.col("_r")) & (normal(F.col("identifier")) == F.col("_i")), "left")
    kind = F.coalesce(F.nullif(F.trim("_u"), F.lit("")), F.lit(UNCLASSIFIED))
    return out.withColumns({"usage_class": kind, "outreach": kind == OBSERVED}).drop("_r", "_i", "_u")


def do_not_email(page_flag: Column, record_flag: Column) -> Column:
    """Which surface bars mail, the page first; null where none does."""
    return F.when(flagged(page_flag), "wiki").when(flagged(record_flag), "excluded")


def excluded_read(records: DataFrame, uid: str, fields: list[str], include: bool, classes: list[str] | None = None, usage: str | None = None) -> DataFrame:
    """(uid, field, values, held): the values of excluded fields, or without permission how many
    are held back. With `classes`, only values whose class (a map column `usage`) is among them."""
    each = records.select(F.col(uid).alias("uid"), *([F.col(usage).alias("_usage")] if usage else []), F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "values"))
    clean = F.filter(F.transform(F.coalesce("values", F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    if include and classes is not None:
        kind = lambda v: F.coalesce(F.try_element_at("_usage", v), F.lit(UNCLASSIFIED))
        clean = F.filter(clean, lambda v: kind(v).isin(*classes))
    each = each.select("uid", "field", clean.alias("values")).where(F.size("values") > 0)
    nothing = F.lit(None).cast("array<string>")
    return each.select("uid", "field", (F.col("values") if include else nothing).alias("values"), (F.lit(0) if include else F.size("values")).alias("held"))


def read_batch(wanted: DataFrame, pages: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Wanted keys with their page and record, nulls where there is none: one join for a batch."""
    left = wanted.select(key).distinct().join(pages, key, "left")
    return left.join(records, key, "left")


def facts_for(identifiers: DataFrame, contacts: DataFrame, closed: DataFrame, as_of: Column) -> DataFrame:
    """(identifier, records, uids, bounced) of many addresses against one scan of the records."""
    ends = closed.select(normal(F.col("identifier")).alias("_c"), "valid_until").groupBy("_c").agg(F.max("valid_until").alias("_until"))
    out = identifiers.join(contacts, normal(F.col("identifier")) == F.col("address"), "left").join(ends, F.col("address") == F.col("_c"), "left")
    return out.select("identifier", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("uids", F.lit(0)).alias("uids"), bounced(F.col("_until"), as_of).alias("bounced"))


def mark(marks: DataFrame, records: DataFrame, record: str, emails: str) -> DataFrame:
    """(record, identifier, valid_until, is_new): where each mark (identifier, observed_at) closes
    an address: the first record that lists it, else a record of its own; the first observation
    of an address holds."""
    first = marks.groupBy(normal(F.col("identifier")).alias("identifier")).agg(F.min("observed_at").alias("valid_until"))
    lists = records.select(F.col(record).cast("string").alias("_r"), F.explode(emails).alias("_e")).groupBy(normal(F.col("_e")).alias("_e")).agg(F.min("_r").alias("_r"))
    return first.join(lists, F.col("identifier") == F.col("_e"), "left").select(F.coalesce("_r", F.concat(F.lit("bounce-"), "identifier")).alias("record"), "identifier", "valid_until", F.col("_r").isNull().alias("is_new"))


def orphaned(own: DataFrame, records: DataFrame, record: str, emails: str) -> DataFrame:
    """(identifier, bounce_record, person_record): marks on a record of their own whose address
    another record lists by now, so they can be folded into it."""
    lists = records.select(F.col(record).alias("_r"), F.explode(emails).alias("_e")).select("_r", normal(F.col("_e")).alias("_e"))
    open_ = own.where(F.col("valid_until").isNotNull() & F.col("folded_into").isNull() & (F.trim("identifier") != ""))
    met = open_.join(lists, (normal(F.col("identifier")) == F.col("_e")) & (F.col("bounce_record") != F.col("_r")))
    return met.groupBy("identifier", "bounce_record").agg(F.min("_r").alias("person_record"))
