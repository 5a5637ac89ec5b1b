"""The resolution ladder: deterministic verdicts on a flagged pair, in a fixed order, before
anybody is asked; and what a verdict does to the pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.functions import compare as C
from codexmill.functions import text as T

# Least confidence at which an action may be applied without a person.
FLOORS = {"not_a_conflict": 0.75, "keep_a": 0.90, "keep_b": 0.90, "deprecate_both": 0.90}
DELETE_FLOOR = 0.95


def declared(a_name: Column, b_name: Column, a_supersedes: Column, b_supersedes: Column, a_refines: Column, b_refines: Column) -> Column:
    """keep_a or keep_b where one side says that it replaces the other, not_a_conflict where one
    refines the other; null without a declaration, and where each claims to replace the other."""
    a, b = T.slugify(F.trim(a_name)), T.slugify(F.trim(b_name))
    says = lambda names, slug: F.coalesce(F.exists(names, lambda n: T.slugify(n) == slug), F.lit(False))
    left, right = says(a_supersedes, b), says(b_supersedes, a)
    named = (F.trim(F.coalesce(a_name, F.lit(""))) != "") & (F.trim(F.coalesce(b_name, F.lit(""))) != "")
    return F.when(~named | (left & right), F.lit(None)).when(left, "keep_a").when(right, "keep_b").when(says(a_refines, b) | says(b_refines, a), "not_a_conflict")


def stance(a_kind: Column, b_kind: Column, conflict: Column, same_asserter: Column, a_from: Column, b_from: Column, a_seen: Column, b_seen: Column) -> Column:
    """Opinions are attributed, never ranked: attribute_both, or the newer of one person's dated
    opinions; null where a side is explicitly something else. `same_asserter`: same, different
    or unknown."""
    kind = lambda k: F.trim(F.coalesce(k, F.lit("")))
    blocks = ((kind(a_kind) != "") & (kind(a_kind) != "opinion")) | ((kind(b_kind) != "") & (kind(b_kind) != "opinion"))
    applies = ~blocks & (((kind(a_kind) == "opinion") & (kind(b_kind) == "opinion")) | F.coalesce(conflict == "stance", F.lit(False)))
    dated = F.when(a_from.isNotNull() & b_from.isNotNull() & (a_from != b_from), a_from > b_from).when(a_seen.isNotNull() & b_seen.isNotNull() & (a_seen != b_seen), a_seen > b_seen)
    newer = F.when(dated, "keep_a").when(~dated, "keep_b").otherwise("attribute_both")
    return F.when(applies, F.when(same_asserter == "same", newer).otherwise("attribute_both"))


def propose(detected: Column, disjoint: Column, scope: Column, declaration: Column, attribution: Column) -> tuple[Column, Column]:
    """(rung, action): the first rung that decides; `ask` where none does, `none` where nothing
    was detected."""
    apart = F.coalesce(scope.isin("DISJOINT", "OVERRIDE_LEFT", "OVERRIDE_RIGHT"), F.lit(False))
    rung = F.when(~detected, "none").when(disjoint, "validity").when(apart, "scope").when(declaration.isNotNull(), "declared").when(attribution.isNotNull(), "stance").otherwise("ask")
    action = F.when(rung.isin("validity", "scope"), "not_a_conflict").when(rung == "declared", declaration).when(rung == "stance", attribution)
    return rung, action


def applies_itself(action: Column, confidence: Column) -> Column:
    """Whether an action is confident enough to be applied; merges never are."""
    out = F.when(action == "propose_merge", F.lit(False))
    for name, floor in FLOORS.items():
        out = out.when(action == name, confidence >= floor)
    return F.coalesce(out.otherwise(confidence >= DELETE_FLOOR), F.lit(False))


def closed_snapshot(a_from: Column, b_from: Column, a_seen: Column, b_seen: Column) -> tuple[Column, Column]:
    """(older side, boundary): of two sequential snapshots the older ends where the newer begins."""
    by_window = a_from.isNotNull() & b_from.isNotNull() & (a_from != b_from)
    by_intake = a_seen.isNotNull() & b_seen.isNotNull() & (a_seen != b_seen)
    older = F.when(by_window, F.when(a_from < b_from, "a").otherwise("b")).when(by_intake, F.when(a_seen < b_seen, "a").otherwise("b"))
    bound = F.when(by_window, F.greatest(a_from, b_from)).when(by_intake, F.when(a_seen < b_seen, F.coalesce(b_from, b_seen)).otherwise(F.coalesce(a_from, a_seen)))
    return older, bound


def enacted(action: Column, older: Column, bound: Column) -> Column:
    """What an action changes, as (side, mark) pairs: the loser is superseded, both are deprecated
    or attributed, the older snapshot is closed. Other actions change nothing here."""
    pair = lambda side, mark: F.struct(side.alias("side"), mark.alias("mark"))
    both = lambda mark: F.array(pair(F.lit("a"), F.lit(mark)), pair(F.lit("b"), F.lit(mark)))
    return (
        F.when(action == "keep_a", F.array(pair(F.lit("b"), F.lit("superseded"))))
        .when(action == "keep_b", F.array(pair(F.lit("a"), F.lit("superseded"))))
        .when(action == "deprecate_both", both("deprecated"))
        .when(action == "attribute_both", both("attributed"))
        .when((action == "not_a_conflict") & older.isNotNull(), F.array(pair(older, F.concat(F.lit("closed "), bound.cast("string")))))
        .otherwise(F.array().cast("array<struct<side: string, mark: string>>"))
    )


def undeclared(members: DataFrame, group: str, key: str, declared_pairs: DataFrame) -> DataFrame:
    """(group, key): members that have an undeclared partner in their group. A member whose pairs
    are all declared needs no comparison. Counted, not paired: a member of a group of n is left
    out if n - 1 different members are declared against it. A pair counts once, however often and
    in whatever order it is declared; pairs with itself or with one outside the group don't."""
    there = members.select(group, key).distinct()
    size = there.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    pairs = declared_pairs.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(there.withColumnRenamed(key, side), [group, side], "left_semi")
    told = pairs.select(group, F.explode(F.array("a", "b")).alias(key)).groupBy(group, key).agg(F.count(F.lit(1)).alias("_d"))
    rows = members.join(size, group).join(told, [group, key], "left")
    return rows.where((F.col("_n") >= 2) & (F.coalesce("_d", F.lit(0)) < F.col("_n") - 1)).select(group, key)


def all_disjoint(members: DataFrame, group: str, since: str, until: str) -> DataFrame:
    """(group, disjoint): whether no two windows of a group share a day (both ends belong to it);
    false for fewer than two members. Windows sorted by their beginning are disjoint if each ends
    before the next begins, so no pairs are formed."""
    from pyspark.sql import Window

    first, last = F.coalesce(F.col(since), F.lit("0001-01-01").cast("date")), F.coalesce(F.col(until), F.lit("9999-12-31").cast("date"))
    rows = members.select(group, first.alias("_f"), last.alias("_l"))
    order = Window.partitionBy(group).orderBy("_f", "_l")
    rows = rows.withColumn("_next", F.lead("_f").over(order))
    return rows.groupBy(group).agg(((F.count(F.lit(1)) >= 2) & F.bool_and(F.col("_next").isNull() | (F.col("_l") < F.col("_next")))).alias("disjoint"))


def scope_of(a_org: Column, b_org: Column, a_locale: Column, b_locale: Column, a_from: Column, a_until: Column, b_from: Column, b_until: Column) -> Column:
    """The verdict on two scopes: undeclared places are the whole tree."""
    window = F.when(C.closed_disjoint(a_from, a_until, b_from, b_until), "DISJOINT").otherwise("OVERLAPS")
    return C.scope_verdict(C.tree_relation(a_org, b_org), C.tree_relation(a_locale, b_locale), window)
