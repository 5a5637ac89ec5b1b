"""Comparators of claims by dimension, and the conflict policy, as CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source types from the most to the least trusted; the index + 1 is the rank.
PRECEDENCE = (("user",), ("linkedin", "twitter"), ("api",), ("wikipedia",), ("agent-observed",), ("claude",), ("script",), ("model-prior",), ("unsourced",))
UNKNOWN_RANK = 9


def _nulls(a: Column, b: Column, universal: bool) -> Column:
    one = F.lit("CONTAINS" if universal else "UNKNOWN")
    return F.when(a.isNull() & b.isNull(), "UNKNOWN").when(a.isNull() | b.isNull(), one)


def interval(a_from: Column, a_until: Column, b_from: Column, b_until: Column) -> Column:
    """Half-open [from, until) windows; a null bound is open. Order of tests: disjoint, equal,
    contains, overlaps."""
    before = lambda x, y: F.coalesce(x <= y, F.lit(False))  # noqa: E731  false where a bound is open
    inside = lambda xf, xu, yf, yu: (xf.isNull() | before(xf, yf)) & (xu.isNull() | before(yu, xu))
    return (
        F.when(before(a_until, b_from) | before(b_until, a_from), "DISJOINT")
        .when(a_from.eqNullSafe(b_from) & a_until.eqNullSafe(b_until), "EQUAL")
        .when(inside(a_from, a_until, b_from, b_until) | inside(b_from, b_until, a_from, a_until), "CONTAINS")
        .otherwise("OVERLAPS")
    )


def closed_disjoint(a_from: Column, a_until: Column, b_from: Column, b_until: Column) -> Column:
    """Disjointness of windows whose last day belongs to them."""
    return F.coalesce(a_until < b_from, F.lit(False)) | F.coalesce(b_until < a_from, F.lit(False))


def _starred(a: Column, b: Column) -> Column:
    return F.when((a == "*") & (b == "*"), "EQUAL").when((a == "*") | (b == "*"), "CONTAINS")


def hierarchy(a: Column, b: Column, universal: bool = True, separator: str = "/") -> Column:
    """Paths: equal, one above the other, or disjoint."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    above = lambda p, q: F.startswith(F.concat(q, F.lit(separator)), F.concat(p, F.lit(separator)))
    told = F.when(x == y, "EQUAL").when(above(x, y) | above(y, x), "CONTAINS").otherwise("DISJOINT")
    return F.coalesce(_nulls(a, b, universal), _starred(a, b), told)


def enum(a: Column, b: Column, universal: bool = False) -> Column:
    return F.coalesce(_nulls(a, b, universal), _starred(a, b), F.when(a == b, "EQUAL").otherwise("DISJOINT"))


def identity(a: Column, b: Column, ratified: Column, universal: bool = False) -> Column:
    """Different subjects are disjoint only where that is ratified, never by a score."""
    told = F.when(a == b, "EQUAL").when(ratified, "DISJOINT").otherwise("UNKNOWN")
    return F.coalesce(_nulls(a, b, universal), _starred(a, b), told)


def source_rank(source: Column) -> Column:
    """Rank of a `type:ref` source, 9 for null and unknown types."""
    kind = F.lower(F.trim(F.split(source, ":")[0]))
    ranks = [(tier, rank) for rank, tier in enumerate(PRECEDENCE, 1)]
    return F.coalesce(reduce(lambda acc, x: acc.when(kind.isin(*x[0]), x[1]), ranks, F.when(F.lit(False), 0)), F.lit(UNKNOWN_RANK))


def verdict(existing_rank: Column, incoming_rank: Column, same: Column, observed: Column, updated: Column, monotone: Column = None, clears: Column = None) -> Column:
    """noop, apply, defer or escalate for one value."""
    monotone = F.lit(False) if monotone is None else monotone
    clears = F.lit(False) if clears is None else clears
    return (
        F.when(same, "noop")
        .when(monotone & clears, F.when(incoming_rank == 1, "apply").otherwise("defer"))
        .when(monotone, "apply")
        .when(incoming_rank < existing_rank, "apply")
        .when(incoming_rank > existing_rank, "defer")
        .when(observed.isNull() | updated.isNull(), "escalate")
        .when(observed > updated, "apply")
        .when(observed < updated, "defer")
        .otherwise("escalate")
    )


def scope_verdict(org: Column, locale: Column, window: Column) -> Column:
    """From the relations of two claims in two trees and in time: DISJOINT where any meet is
    empty, OVERRIDE where one is below or equal in both trees and not equal in both, else OVERLAP.
    Tree relations are BELOW, ABOVE, EQUAL or DISJOINT."""
    same = (org == "EQUAL") & (locale == "EQUAL")
    return (
        F.when((org == "DISJOINT") | (locale == "DISJOINT") | (window == "DISJOINT"), "DISJOINT")
        .when(~same & org.isin("BELOW", "EQUAL") & locale.isin("BELOW", "EQUAL"), "OVERRIDE_LEFT")
        .when(~same & org.isin("ABOVE", "EQUAL") & locale.isin("ABOVE", "EQUAL"), "OVERRIDE_RIGHT")
        .otherwise("OVERLAP")
    )


def tree_leq(a: Column, b: Column, separator: str = "/") -> Column:
    """Whether a stands below or at b; an undeclared place is the whole tree."""
    inside = F.startswith(F.concat(a, F.lit(separator)), F.concat(b, F.lit(separator)))
    return b.isNull() | (a.isNotNull() & F.coalesce(inside, F.lit(False)))


def tree_relation(a: Column, b: Column, separator: str = "/") -> Column:
    up, down = tree_leq(a, b, separator), tree_leq(b, a, separator)
    return F.when(up & down, "EQUAL").when(up, "BELOW").when(down, "ABOVE").otherwise("DISJOINT")


def interval_leq(a_from: Column, a_until: Column, b_from: Column, b_until: Column) -> Column:
    """Whether window a lies in window b; null bounds are open."""
    inside = lambda x: F.coalesce(x, F.lit(False))
    return (b_from.isNull() | inside(a_from >= b_from)) & (b_until.isNull() | inside(a_until <= b_until))
