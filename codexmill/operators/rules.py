"""Declarative record rules: matching, value expressions, dispositions and rollups, compiled to
columns on the driver, so no row is interpreted."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob(pattern: str) -> str:
    """A shell pattern as an anchored regular expression."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def value(expression: object, row: dict[str, Column]) -> Column:
    """A literal, a `$field`, or {fn: first | date_of | set_diff, args: [...]}."""
    if isinstance(expression, str) and expression.startswith("$"):
        return row[expression[1:]]
    if isinstance(expression, dict):
        args = [value(a, row) for a in expression["args"]]
        if expression["fn"] == "first":
            return F.try_element_at(args[0], F.lit(1))
        if expression["fn"] == "date_of":
            return F.try_to_date(F.substring(args[0].cast("string"), 1, 10), "yyyy-MM-dd")
        if expression["fn"] == "set_diff":  # repeated entries stay
            return F.filter(args[0], lambda x: ~F.coalesce(F.array_contains(args[1], x), F.lit(False)))
        raise ValueError(f"unknown function {expression['fn']}")
    return F.lit(expression)


@dataclass(frozen=True)
class Rule:
    """All tests hold: `equals`, `globs` and `within` by field."""

    name: str
    disposition: str
    equals: dict[str, object] = field(default_factory=dict)
    globs: dict[str, str] = field(default_factory=dict)
    within: dict[str, tuple] = field(default_factory=dict)
    live: bool = True

    def matches(self, row: dict[str, Column]) -> Column:
        tests = [row[f] == F.lit(v) for f, v in self.equals.items()]
        tests += [row[f].cast("string").rlike(glob(g)) for f, g in self.globs.items()]
        tests += [row[f].isin(*v) for f, v in self.within.items()]
        return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def apply_rules(records: DataFrame, rules: list[Rule], row: dict[str, Column]) -> DataFrame:
    """Each record with the first rule (by name) that matches, and its disposition: the rule's,
    `observed-` before it where the rule only observes, or no-match."""
    rule, disposition = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for r in sorted(rules, key=lambda r: r.name):
        rule, disposition = rule.when(r.matches(row), r.name), disposition.when(r.matches(row), r.disposition if r.live else f"observed-{r.disposition}")
    return records.withColumn("rule", rule).withColumn("disposition", F.coalesce(disposition, F.lit("no-match")))


def rollup(records: DataFrame, keys: list[str], last: Column) -> DataFrame:
    """(keys, count, last): how many, and the greatest value expression."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.max(last).alias("last"))
