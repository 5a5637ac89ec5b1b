"""Findings with their places: every match of a pattern as a row of class, value, offsets, line and
column; a sweep that drops what overlaps a class of higher rank; redaction from what is left.

Places come from the text's pieces between matches by running sums, so a text is cut once for each
pattern, and only texts with a match leave the scan. Offsets count characters from 0, the end
excluded; lines and columns count from 1.

Defined results: a null text has no findings and stays null; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import privacy as P


def matches(rows: DataFrame, key: str, text: str, kind: str, pattern: str) -> DataFrame:
    """(key, kind, value, start, end, line, column, before) of every match; `before` is what stands
    in front of it, up to the match before."""
    cut = rows.select(F.col(key), F.col(text).alias("_t")).where(F.col("_t").rlike(pattern)).select(key, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)).alias("v"), F.split("_t", pattern, -1).alias("p"))
    cut = cut.withColumn("_row", F.monotonically_increasing_id())  # keys may repeat
    each = cut.select(key, "_row", F.posexplode(F.arrays_zip("p", "v")).alias("_i", "_z")).select(key, "_row", "_i", F.col("_z.p").alias("p"), F.coalesce("_z.v", F.lit("")).alias("v"))
    # length, line breaks and characters behind the last line break of the piece and of the match
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    tail = lambda c: F.length(F.substring_index(c, "\n", -1))
    both = F.concat("p", "v")
    each = each.select(key, "_row", "_i", "p", "v", F.length("p").alias("lp"), F.length("v").alias("lv"), breaks(both).alias("nb"), breaks("p").alias("np"), tail(both).alias("tb"), tail("p").alias("tp"))
    by = Window.partitionBy("_row").orderBy("_i")
    earlier, now = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("_far", F.sum(F.col("lp") + F.col("lv")).over(now))
    # where the line begins that is open behind this piece and its match
    each = each.withColumn("_open", F.max(F.when(F.col("nb") > 0, F.col("_far") - F.col("tb"))).over(earlier))
    start = F.col("_far") - F.col("lv")
    line_start = F.when(F.col("np") > 0, start - F.col("tp")).otherwise(F.coalesce("_open", F.lit(0)))
    each = each.withColumns({"start": start, "line": 1 + F.coalesce(F.sum("nb").over(earlier), F.lit(0)) + F.col("np"), "column": start - line_start + 1})
    return each.where(F.col("v") != "").select(key, F.lit(kind).alias("kind"), F.col("v").alias("value"), "start", F.col("_far").alias("end"), "line", "column", F.col("p").alias("before"))


def swept(found: list[DataFrame], key: str) -> DataFrame:
    """Findings of classes in the order of their rank, without those that overlap a kept one of a
    higher rank. Findings of one class never overlap; a class is swept against all above it."""
    ranked = reduce(DataFrame.unionByName, [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(found)])
    by = Window.partitionBy(key).orderBy("start", "_rank")
    before, behind = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    for rank in range(len(found) - 1):
        own = F.col("_rank") == rank
        past = F.max(F.when(own, F.col("end"))).over(before)
        coming = F.min(F.when(own, F.col("start"))).over(behind)
        at = F.max(F.when(own, F.col("end"))).over(Window.partitionBy(key, "start"))
        hit = F.coalesce(past > F.col("start"), F.lit(False)) | F.coalesce(coming < F.col("end"), F.lit(False)) | at.isNotNull()
        ranked = ranked.withColumn("_hit", hit).where((F.col("_rank") <= rank) | ~F.col("_hit")).drop("_hit")
    return ranked.drop("_rank")


def normal(kind: Column, value: Column) -> Column:
    """How values are compared with those a recipient knows: addresses in lower case, numbers by digits."""
    return F.when(kind == "email", F.lower(F.trim(value))).otherwise(F.regexp_replace(value, r"\D", ""))


def outbound(rows: DataFrame, key: str, text: str, known: list[str] | None = None) -> DataFrame:
    """(key, kind, value, start, end, line, column) of addresses and numbers that leave with a text,
    less those of `known`. A number inside an address is the address's; one that a label names as an
    id, or that can't be a phone number, is none. Nothing known: everything is reported."""
    emails = matches(rows, key, text, "email", P.EMAIL)
    label = r"(?i)(?:^|[^A-Za-z0-9])(?:" + "|".join(P.LABELS) + r")[\s`'\"(:=\-]*$"
    token = F.col("value")
    number = (F.length(F.regexp_replace(token, r"\D", "")) >= 7) & ~P.not_a_phone(token) & ~F.col("before").rlike(label)
    phones = matches(rows, key, text, "phone", P.PHONE).where(number)
    out = swept([emails, phones], key).drop("before")
    entries = [e.strip() for e in known or [] if e.strip()]
    for kind, own in (("email", [e.lower() for e in entries if "@" in e]), ("phone", ["".join(c for c in e if c.isdigit()) for e in entries if "@" not in e])):
        if own := [e for e in own if e]:
            out = out.where((F.col("kind") != kind) | ~normal(F.col("kind"), F.col("value")).isin(own))
    return out


def redacted(rows: DataFrame, key: str, text: str, found: DataFrame, mark: str = "[redacted-{kind}]") -> DataFrame:
    """Rows with the found spans of their text replaced, the class standing for {kind}. Keys are
    unique; rows without findings never join a list."""
    before, behind = mark.split("{kind}")
    each = found.select(key, F.struct("start", "end", "kind").alias("s")).groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("_spans"))
    out = rows.join(each, key, "left")
    cut = lambda a, b: F.substring(F.col(text), a + 1, b - a)
    begun = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate("_spans", begun, lambda acc, s: F.struct(F.concat(acc["text"], cut(acc["at"].cast("int"), s["start"].cast("int")), F.lit(before), s["kind"], F.lit(behind)).alias("text"), s["end"].cast("long").alias("at")))
    out = out.withColumn("_done", done)
    whole = F.concat("_done.text", F.substring(F.col(text), F.col("_done.at").cast("int") + 1, F.length(text)))
    return out.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(whole)).drop("_spans", "_done")
