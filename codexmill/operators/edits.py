"""Anchored edits: operations that name the passage they change, checked against the original body
and made in one pass, all or none.

An operation is a struct (op, anchor, text): `replace` puts its text in the place of its anchor,
`insert_after` puts it behind, `append_section` puts it at the end after an empty line. An anchor
has to occur exactly once, overlapping occurrences counted; passages that operations replace may
not overlap, and nothing may be inserted inside one. The order of operations on passages doesn't
matter, but those at one place keep it.

Defined results: a null body is an empty one; no operations (none, or null) change nothing; null
operations, unknown ones, and those that lack an anchor or a text, are errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = "array<struct<op:string,anchor:string,text:string>>"


def _located(op: Column, number: Column, body: Column) -> Column:
    """An operation's place (characters from 0; none for an appended one), number, text and error."""
    anchored = op["op"].isin("replace", "insert_after")
    first = F.call_function("locate", op["anchor"], body, F.lit(1))
    again = F.call_function("locate", op["anchor"], body, first + 1)
    error = (
        F.when(~F.coalesce(anchored | (op["op"] == "append_section"), F.lit(False)), "unknown operation")
        .when(anchored & (F.coalesce(op["anchor"], F.lit("")) == ""), "no anchor")
        .when(op["text"].isNull(), "no text")
        .when(anchored & (first == 0), "anchor not found")
        .when(anchored & (again > 0), "anchor not unique")
    )
    end = first - 1 + F.length(op["anchor"])
    start = F.when(op["op"] == "insert_after", end).otherwise(first - 1)
    return F.struct(F.when(anchored, start).alias("start"), F.when(anchored, end).alias("end"), number.alias("number"), op["text"].alias("text"), error.alias("error"))


def edited(rows: DataFrame, body: str, ops: str, into: str = "edited", error: str = "error") -> DataFrame:
    """Rows with the edited body, and what stands against it (then the body is as it was): the first
    operation's number and reason, or that operations overlap. Columns of those names are replaced."""
    out = rows.withColumn("_body", F.coalesce(body, F.lit(""))).withColumn("_ops", F.transform(F.coalesce(ops, F.array().cast(OPS)), lambda op, i: _located(op, i, F.col("_body"))))
    wrong = F.filter("_ops", lambda s: s["error"].isNotNull())
    out = out.withColumn("_wrong", F.when(F.size(wrong) > 0, F.concat(wrong[0]["number"].cast("string"), F.lit(": "), wrong[0]["error"])))
    # sorted by start, end and number
    out = out.withColumn("_placed", F.array_sort(F.filter("_ops", lambda s: s["start"].isNotNull())))
    far = F.struct(F.lit(-1).alias("end"), F.lit(False).alias("over"))
    over = F.aggregate("_placed", far, lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["over"] | (s["start"] < acc["end"])).alias("over")))["over"]
    out = out.withColumn("_wrong", F.coalesce("_wrong", F.when(over, "overlapping operations")))
    cut = lambda a, b: F.substring(F.col("_body"), a + 1, b - a)
    begun = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    done = F.aggregate("_placed", begun, lambda acc, s: F.struct(F.concat(acc["text"], cut(acc["at"], s["start"]), F.coalesce(s["text"], F.lit(""))).alias("text"), s["end"].alias("at")))
    out = out.withColumn("_done", done)
    passed = F.concat(F.col("_done.text"), F.substring(F.col("_body"), F.col("_done.at") + 1, F.length("_body")))
    sections = F.transform(F.filter("_ops", lambda s: s["start"].isNull()), lambda s: F.coalesce(s["text"], F.lit("")))
    whole = F.aggregate(sections, passed, lambda acc, t: F.when(acc == "", t).otherwise(F.concat(F.regexp_replace(acc, r"\n+\z", ""), F.lit("\n\n"), t)))
    return out.withColumn(into, F.when(F.col("_wrong").isNull(), whole).otherwise(F.col("_body"))).withColumn(error, F.col("_wrong")).drop("_body", "_ops", "_wrong", "_placed", "_done")
