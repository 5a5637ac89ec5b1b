"""Queries of queues, the resolution ladder and declared dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.functions import compare as C
from codexmill.functions import dimensions as D
from codexmill.functions import records as S
from codexmill.functions import text as T
from codexmill.operators import access as A
from codexmill.operators import cluster as K
from codexmill.operators import compile as M
from codexmill.operators import ladder as L
from codexmill.operators import queues as Q
from codexmill.registered import query
from codexmill.session import table

from .common import frame, sub

# --- merge queue -------------------------------------------------------------------------------

#: Orders as merge proposals: their lines are the sources.
MERGE = "SELECT o_orderkey, list(DISTINCT 'wiki/p' || (l_partkey % 40)::VARCHAR || '.md') sources, 'Target ' || (o_custkey % 50)::VARCHAR target, (o_totalprice % 100) / 100 confidence, o_orderstatus = 'F' resolved FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"
_ID = "left(sha1(array_to_string(list_sort(sources), chr(10)) || chr(10) || target), 12)"


def _merges(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("wiki/p"), (F.col("l_partkey") % 40).cast("string"), F.lit(".md")).alias("source"))
    sources = lines.groupBy("l_orderkey").agg(F.collect_set("source").alias("sources"))  # an order has few lines
    o = table(spark, sf, "orders").join(sources, F.col("l_orderkey") == F.col("o_orderkey"))
    return o.select("o_orderkey", "sources", F.concat(F.lit("Target "), (F.col("o_custkey") % 50).cast("string")).alias("target"), ((F.col("o_totalprice") % 100) / 100).alias("confidence"), (F.col("o_orderstatus") == "F").alias("resolved"))


@query(f"SELECT o_orderkey, {_ID} id FROM ({MERGE})")
def merge_ids(spark, sf):
    return _merges(spark, sf).select("o_orderkey", Q.merge_id(F.col("sources"), F.col("target")).alias("id"))


@query(f"SELECT o_orderkey, list_sort(list_transform(sources, lambda s: regexp_extract(s, '([^/]*)\\.md$', 1))) slugs FROM ({MERGE})")
def merge_source_slugs(spark, sf):
    return _merges(spark, sf).select("o_orderkey", F.array_sort(Q.source_slugs(F.col("sources"))).alias("slugs"))


@query(f"WITH m AS (SELECT *, {_ID} id FROM ({MERGE})), q AS (SELECT id, min(o_orderkey) o_orderkey FROM m WHERE o_orderkey % 2 = 0 GROUP BY id), f AS (SELECT id, min(o_orderkey) o_orderkey FROM m WHERE o_orderkey % 2 = 1 GROUP BY id) SELECT id, o_orderkey FROM q UNION ALL SELECT id, o_orderkey FROM f WHERE id NOT IN (SELECT id FROM q)")
def merges_written(spark, sf):
    """A queue after proposals are written to it: one that stands there is not written again."""
    m = _merges(spark, sf).select(Q.merge_id(F.col("sources"), F.col("target")).alias("id"), "o_orderkey")
    queue = m.where("o_orderkey % 2 = 0").groupBy("id").agg(F.min("o_orderkey").alias("o_orderkey"))
    return Q.append_once(queue, m.where("o_orderkey % 2 = 1"), "id", "o_orderkey")


@query(f"SELECT o_orderkey, target FROM ({MERGE}) WHERE NOT resolved AND len(list_filter(sources, lambda s: s LIKE 'wiki/p1%')) = 0")
def merges_pending(spark, sf):
    """Open proposals all of whose sources the caller may see."""
    allowed = A.all_authorized(F.col("sources"), lambda s: ~s.startswith("wiki/p1"))
    return _merges(spark, sf).where(~F.col("resolved") & allowed).select("o_orderkey", "target")


@query(f"SELECT o_orderkey, CASE WHEN len(sources) > 5 THEN 'size' WHEN confidence < 0.2 THEN 'confidence' END reason FROM ({MERGE}) WHERE NOT resolved")
def merges_revalidated(spark, sf):
    reason = F.when(F.size("sources") > 5, "size").when(F.col("confidence") < 0.2, "confidence")
    return Q.retired(_merges(spark, sf), reason).select("o_orderkey", "reason")


_DECIDED = "SELECT o_orderkey, sources, target, CASE WHEN o_orderkey % 3 = 0 THEN 'approve' WHEN o_orderkey % 3 = 1 THEN 'reject' END decision FROM ({m})".format(m=MERGE)


def _decisions(spark, sf):
    return frame(spark, sf, "orders", {"o_orderkey": "o_orderkey", "decision": "CASE WHEN o_orderkey % 3 = 0 THEN 'approve' ELSE 'reject' END", "at": "1"}, "o_orderkey % 3 < 2").unionByName(frame(spark, sf, "orders", {"o_orderkey": "o_orderkey", "decision": "'reject'", "at": "2"}, "o_orderkey % 3 = 0"))


@query(f"SELECT coalesce(decision, 'open') decision, count(*) n FROM ({_DECIDED}) GROUP BY 1")
def merges_resolved(spark, sf):
    done = Q.decided(_merges(spark, sf), _decisions(spark, sf), "o_orderkey", "at")
    return done.groupBy(F.coalesce("decision", F.lit("open")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT source, arg_min(target, o_orderkey) target FROM (SELECT o_orderkey, target, unnest(sources) source FROM ({_DECIDED}) WHERE decision = 'approve') GROUP BY source")
def merges_folded(spark, sf):
    return Q.folded(Q.decided(_merges(spark, sf), _decisions(spark, sf), "o_orderkey", "at"), "o_orderkey", "target", "sources")


@query(f"SELECT target, count(*) merges, max(o_orderkey) AS last FROM ({_DECIDED}) WHERE decision = 'approve' AND target IN ('Target 7', 'Target 8') GROUP BY target")
def merge_provenance(spark, sf):
    done = Q.decided(_merges(spark, sf), _decisions(spark, sf), "o_orderkey", "at").where("decision = 'approve'")
    return done.where(F.col("target").isin("Target 7", "Target 8")).groupBy("target").agg(F.count(F.lit(1)).alias("merges"), F.max("o_orderkey").alias("last"))


# --- question queue ----------------------------------------------------------------------------

#: Conversations as a file of question blocks, one with a fence that holds a heading.
_BLOCK = "'## [' || cast(turn AS string) || '] ' || role || chr(10) || '- [' || CASE WHEN turn % 2 = 0 THEN ' ' ELSE 'x' END || '] Question?' || chr(10) || '```' || chr(10) || '## not a heading' || chr(10) || '```'"
_FILE = {"conv_id": "conv_id", "turn": "turn", "role": "role", "block": _BLOCK}


def _questions(spark, sf):
    rows = frame(spark, sf, "conversations", _FILE).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]), "\n---\n").alias("t"))
    text = F.concat(F.lit("# Pending\n\nnot a block\n"), F.col("t"), F.lit("\n---\nstray\n"))
    return rows.select("conv_id", F.posexplode(Q.blocks(text)).alias("at", "block"))


@query(f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, block) - 1 AS \"at\", block FROM {sub('conversations', _FILE)}")
def question_blocks(spark, sf):
    return _questions(spark, sf).withColumn("at", F.col("at").cast("long"))


@query(f"SELECT conv_id, left(sha1('## [' || turn || '] ' || role || chr(10) || 'Question?'), 12) id FROM {sub('conversations', _FILE)} WHERE turn % 2 = 0")
def questions_unanswered(spark, sf):
    b = F.split("block", "\n")
    open_ = _questions(spark, sf).where(b[1].startswith("- [ ]"))
    return open_.select("conv_id", Q.question_id(b[0], F.regexp_extract(b[1], r"^- \[.\] (.*)$", 1)).alias("id"))


@query(f"SELECT CASE WHEN turn % 2 = 0 THEN 'open' ELSE 'archive' END part, count(*) n FROM {sub('conversations', _FILE)} GROUP BY 1")
def answers_ingested(spark, sf):
    """Answered blocks leave the queue for the archive and become intake."""
    part = F.when(F.split("block", "\n")[1].startswith("- [ ]"), "open").otherwise("archive")
    return _questions(spark, sf).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


def _pending(kind: str, settled: str, key: str) -> str:
    return f"SELECT event_id FROM events WHERE event_type = '{kind}' AND {key} NOT IN (SELECT {key} FROM events WHERE event_type = '{settled}')"


@query(_pending("view", "error", "user_id * 7 + event_id % 7"))
def pending_audit(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.col("user_id") * 7 + F.col("event_id") % 7)
    return Q.open_rows(e, "k", "event_type", "view", ["error"]).select("event_id")


@query(_pending("error", "purchase", "user_id"))
def pending_quarantine(spark, sf):
    return Q.open_rows(table(spark, sf, "events"), "user_id", "event_type", "error", ["purchase"]).select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'signup' AND user_id * 5 + event_id % 5 NOT IN (SELECT user_id * 5 + event_id % 5 FROM events WHERE event_type IN ('error', 'click'))")
def pending_rule_proposals(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.col("user_id") * 5 + F.col("event_id") % 5)
    return Q.open_rows(e, "k", "event_type", "signup", ["error", "click"]).select("event_id")


@query(
    "WITH f AS (SELECT p_name || '-' || p_partkey::VARCHAR nm, p_brand k, CASE WHEN p_size % 3 = 0 THEN 'unmatched-extension' WHEN p_size % 3 = 1 THEN 'too-deep' END r FROM part), g AS (SELECT r reason, k AS key, count(*) files, list(nm ORDER BY nm) l FROM f WHERE r IS NOT NULL GROUP BY ALL) "
    "SELECT reason, key, files, l[:5] samples FROM g WHERE NOT (reason = 'too-deep' AND key = (SELECT min(p_brand) FROM part))"
)
def unclaimed_raised(spark, sf):
    p = table(spark, sf, "part").withColumn("nm", F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")))
    seen = p.agg(F.min("p_brand").alias("key")).select(F.lit("too-deep").alias("reason"), "key")
    return Q.raised(p, F.when(F.col("p_size") % 3 == 0, "unmatched-extension").when(F.col("p_size") % 3 == 1, "too-deep"), "p_brand", "nm", F.broadcast(seen))


@query("SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC)::INT place FROM events QUALIFY place <= 3")
def rule_exemplars(spark, sf):
    return Q.latest_exemplars(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id", 3)


@query("SELECT event_id, row_number() OVER (ORDER BY (user_id <> 3)::INT, ts, event_id) place FROM events QUALIFY place <= 500")
def callers_first(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id")
    from pyspark.sql import Window

    top = e.orderBy(*Q.sources_first(e, F.col("user_id") == 3, ["ts", "event_id"])).limit(500)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*Q.sources_first(e, F.col("user_id") == 3, ["ts", "event_id"])))).select("event_id", "place")


# --- resolution ladder -------------------------------------------------------------------------

#: Parts as flagged pairs.
PAIR = {
    "id": "p_partkey",
    "a_name": "'Claim ' || cast(p_size AS string)",
    "b_name": "CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE 'claim-' || cast(p_partkey % 50 AS string) END",
    "a_sup": "CASE WHEN p_partkey % 5 = 0 THEN 'Claim ' || cast(p_partkey % 50 AS string) ELSE 'x' END",
    "b_sup": "CASE WHEN p_partkey % 10 = 0 THEN 'claim ' || cast(p_size AS string) WHEN p_partkey % 7 = 0 THEN 'Claim! ' || cast(p_size AS string) ELSE 'y' END",
    "a_ref": "CASE WHEN p_partkey % 3 = 0 THEN 'claim ' || cast(p_partkey % 50 AS string) ELSE 'z' END",
    "a_kind": "CASE p_size % 4 WHEN 0 THEN 'opinion' WHEN 1 THEN 'fact' WHEN 2 THEN '' END",
    "b_kind": "CASE p_partkey % 3 WHEN 0 THEN 'opinion' WHEN 1 THEN NULL ELSE ' opinion ' END",
    "conflict": "CASE WHEN p_size % 2 = 0 THEN 'stance' ELSE 'fact' END",
    "who": "CASE p_partkey % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'different' WHEN 2 THEN 'unknown' ELSE 'same' END",
    "a_from": "CASE WHEN p_size % 3 > 0 THEN cast('2024-01-01' AS date) + cast(p_size AS int) END",
    "b_from": "CASE WHEN p_partkey % 3 > 0 THEN cast('2024-01-01' AS date) + cast(p_partkey % 50 AS int) END",
    "a_until": "CASE WHEN p_size % 5 > 2 THEN cast('2024-01-20' AS date) + cast(p_size AS int) END",
    "b_until": "CASE WHEN p_partkey % 11 = 0 THEN cast('2023-12-31' AS date) END",
    "a_seen": "cast('2024-03-01' AS date) + cast(p_size AS int)",
    "b_seen": "CASE WHEN p_partkey % 4 > 0 THEN cast('2024-03-01' AS date) + cast(p_partkey % 50 AS int) END",
    "a_org": "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'acme' ELSE 'acme/eng' END",
    "b_org": "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'acme/eng' WHEN 2 THEN 'acme/eng/x' ELSE 'acme' END",
    "a_loc": "CASE WHEN p_size % 6 = 0 THEN 'us' END",
    "b_loc": "CASE WHEN p_partkey % 6 = 0 THEN 'us/ca' END",
}
PAIRS = sub("part", PAIR)
_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_DECLARED = (
    "CASE WHEN trim(b_name) = '' OR ({l} AND {r}) THEN NULL WHEN {l} THEN 'keep_a' WHEN {r} THEN 'keep_b' WHEN {f} THEN 'not_a_conflict' END"
).format(l=f"{_SLUG.format('a_sup')} = {_SLUG.format('b_name')}", r=f"{_SLUG.format('b_sup')} = {_SLUG.format('a_name')}", f=f"{_SLUG.format('a_ref')} = {_SLUG.format('b_name')}")
_NEWER = "CASE WHEN a_from <> b_from THEN a_from > b_from WHEN a_seen <> b_seen THEN a_seen > b_seen END"
_STANCE = f"CASE WHEN coalesce(trim(a_kind), '') IN ('', 'opinion') AND coalesce(trim(b_kind), '') IN ('', 'opinion') AND ((trim(a_kind) = 'opinion' AND trim(b_kind) = 'opinion') IS TRUE OR conflict = 'stance') THEN CASE WHEN who <> 'same' THEN 'attribute_both' WHEN {_NEWER} THEN 'keep_a' WHEN NOT {_NEWER} THEN 'keep_b' ELSE 'attribute_both' END END"
_LEQ = "({y} IS NULL OR coalesce(starts_with({x} || '/', {y} || '/'), false))"
_AB = " AND ".join(_LEQ.format(x=f"a_{p}", y=f"b_{p}") for p in ("org", "loc"))
_BA = " AND ".join(_LEQ.format(x=f"b_{p}", y=f"a_{p}") for p in ("org", "loc"))
_MEET = " OR ".join(f"NOT ({_LEQ.format(x=f'a_{p}', y=f'b_{p}')} OR {_LEQ.format(x=f'b_{p}', y=f'a_{p}')})" for p in ("org", "loc"))
_SCOPE = f"CASE WHEN {_MEET} OR coalesce(a_until < b_from, false) OR coalesce(b_until < a_from, false) THEN 'DISJOINT' WHEN ({_AB}) AND NOT ({_BA}) THEN 'OVERRIDE_LEFT' WHEN ({_BA}) AND NOT ({_AB}) THEN 'OVERRIDE_RIGHT' ELSE 'OVERLAP' END"
_LADDER = f"SELECT id, a_from, b_from, a_seen, b_seen, CASE WHEN id % 23 = 0 THEN 'none' WHEN coalesce(a_until < b_from, false) OR coalesce(b_until < a_from, false) THEN 'validity' WHEN {_SCOPE} <> 'OVERLAP' THEN 'scope' WHEN {_DECLARED} IS NOT NULL THEN 'declared' WHEN {_STANCE} IS NOT NULL THEN 'stance' ELSE 'ask' END rung, {_DECLARED} d, {_STANCE} s FROM {PAIRS}"
_ACTION = "CASE WHEN rung IN ('validity', 'scope') THEN 'not_a_conflict' WHEN rung = 'declared' THEN d WHEN rung = 'stance' THEN s END"


def _c(*names):
    return [F.col(n) for n in names]


def _declared(p):
    return L.declared(*_c("a_name", "b_name"), F.array("a_sup"), F.array("b_sup"), F.array("a_ref"), F.array().cast("array<string>"))


def _stance(p):
    return L.stance(*_c("a_kind", "b_kind", "conflict", "who", "a_from", "b_from", "a_seen", "b_seen"))


def _scope(p):
    return L.scope_of(*_c("a_org", "b_org", "a_loc", "b_loc", "a_from", "a_until", "b_from", "b_until"))


def _ladder(spark, sf):
    p = frame(spark, sf, "part", PAIR)
    disjoint = C.closed_disjoint(*_c("a_from", "a_until", "b_from", "b_until"))
    rung, action = L.propose(F.col("id") % 23 != 0, disjoint, _scope(p), _declared(p), _stance(p))
    return p.select("id", "a_from", "b_from", "a_seen", "b_seen", rung.alias("rung"), action.alias("action"))


@query(f"SELECT id, {_DECLARED} winner FROM {PAIRS}")
def declared_winners(spark, sf):
    p = frame(spark, sf, "part", PAIR)
    return p.select("id", _declared(p).alias("winner"))


@query(f"SELECT id, {_STANCE} verdict FROM {PAIRS}")
def stance_verdicts(spark, sf):
    p = frame(spark, sf, "part", PAIR)
    return p.select("id", _stance(p).alias("verdict"))


@query(f"SELECT id, {_SCOPE} verdict FROM {PAIRS}")
def scope_verdicts(spark, sf):
    p = frame(spark, sf, "part", PAIR)
    return p.select("id", _scope(p).alias("verdict"))


@query(f"SELECT id, rung, {_ACTION} AS action FROM ({_LADDER})")
def resolution_ladder(spark, sf):
    return _ladder(spark, sf).select("id", "rung", "action")


@query(f"SELECT id, coalesce(CASE {_ACTION} WHEN 'not_a_conflict' THEN (id % 100) / 100 >= 0.75 WHEN 'keep_a' THEN (id % 100) / 100 >= 0.9 WHEN 'keep_b' THEN (id % 100) / 100 >= 0.9 ELSE (id % 100) / 100 >= 0.95 END, false) auto FROM ({_LADDER}) WHERE {_ACTION} IS NOT NULL")
def auto_applied(spark, sf):
    return _ladder(spark, sf).where("action is not null").select("id", L.applies_itself(F.col("action"), (F.col("id") % 100) / 100).alias("auto"))


_OLDER = "CASE WHEN a_from <> b_from THEN CASE WHEN a_from < b_from THEN 'a' ELSE 'b' END WHEN a_seen <> b_seen THEN CASE WHEN a_seen < b_seen THEN 'a' ELSE 'b' END END"
_BOUND = "CASE WHEN a_from <> b_from THEN greatest(a_from, b_from) WHEN a_seen < b_seen THEN coalesce(b_from, b_seen) WHEN a_seen > b_seen THEN coalesce(a_from, a_seen) END"


@query(f"SELECT id, {_OLDER} older, {_BOUND} bound FROM {PAIRS}")
def snapshot_closes(spark, sf):
    older, bound = L.closed_snapshot(*_c("a_from", "b_from", "a_seen", "b_seen"))
    return frame(spark, sf, "part", PAIR).select("id", older.alias("older"), bound.alias("bound"))


@query(
    f"WITH x AS (SELECT id, {_ACTION} act, {_OLDER} older, {_BOUND} bound FROM ({_LADDER})) SELECT id, 'b' side, 'superseded' mark FROM x WHERE act = 'keep_a' UNION ALL SELECT id, 'a', 'superseded' FROM x WHERE act = 'keep_b' "
    "UNION ALL SELECT id, unnest(['a', 'b']), 'attributed' FROM x WHERE act = 'attribute_both' UNION ALL SELECT id, older, 'closed ' || bound::VARCHAR FROM x WHERE act = 'not_a_conflict' AND older IS NOT NULL"
)
def enacted_resolutions(spark, sf):
    older, bound = L.closed_snapshot(*_c("a_from", "b_from", "a_seen", "b_seen"))
    return _ladder(spark, sf).select("id", F.explode(L.enacted(F.col("action"), older, bound)).alias("m")).select("id", "m.side", "m.mark")


@query("SELECT p_size, p_partkey FROM part WHERE p_size % 2 = 1 OR p_partkey <> (SELECT min(p_partkey) FROM part q WHERE q.p_size = part.p_size) AND (SELECT count(*) FROM part q WHERE q.p_size = part.p_size) > 2 EXCEPT SELECT p_size, p_partkey FROM part WHERE (SELECT count(*) FROM part q WHERE q.p_size = part.p_size) < 2")
def undeclared_members(spark, sf):
    """In groups of even size number the least member is declared against all others."""
    p = table(spark, sf, "part").select("p_size", "p_partkey")
    least = p.groupBy("p_size").agg(F.min("p_partkey").alias("a"))
    pairs = p.join(least, "p_size").where("p_size % 2 = 0 and p_partkey <> a").select("p_size", "a", F.col("p_partkey").alias("b"))
    return L.undeclared(p, "p_size", "p_partkey", pairs)


_WINDOW = "SELECT o_custkey, o_orderdate::DATE f, (o_orderdate::DATE + (o_orderkey % 40)::INT) l FROM orders"


@query(f"WITH w AS ({_WINDOW}), n AS (SELECT o_custkey, row_number() OVER () i, f, l FROM w) SELECT a.o_custkey, count(DISTINCT a.i) >= 2 AND count(b.i) = 0 disjoint FROM n a LEFT JOIN n b ON a.o_custkey = b.o_custkey AND a.i <> b.i AND NOT (a.l < b.f OR b.l < a.f) GROUP BY 1")
def windows_disjoint(spark, sf):
    o = frame(spark, sf, "orders", {"o_custkey": "o_custkey", "f": "cast(o_orderdate AS date)", "l": "cast(o_orderdate AS date) + cast(o_orderkey % 40 AS int)"})
    return L.all_disjoint(o, "o_custkey", "f", "l")


# --- dimensions --------------------------------------------------------------------------------

_CLAIM = {
    "valid_from": "{s}_from", "valid_until": "{s}_until", "scope": "{s}_org", "subject": "{s}_name", "memory_class": "{s}_kind",
    "recorded_from": "{s}_seen", "recorded_until": "{s}_until", "observed_from": "{s}_seen", "observed_until": "{s}_from",
}
_OWN = (D.Dimension("kind", "enum", ("memory_class",), values=("opinion", "fact"), applies_to={"scope": ("acme", "acme/eng")}),)


def _side(s: str) -> dict:
    return {k: F.col(v.format(s=s)) for k, v in _CLAIM.items()}


def _interval(a: str, b: str, x: str, y: str, one: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL AND {b} IS NULL AND {x} IS NULL AND {y} IS NULL THEN 'UNKNOWN' WHEN ({a} IS NULL AND {b} IS NULL) OR ({x} IS NULL AND {y} IS NULL) THEN '{one}' WHEN coalesce({b} <= {x}, false) OR coalesce({y} <= {a}, false) THEN 'DISJOINT' WHEN {a} IS NOT DISTINCT FROM {x} AND {b} IS NOT DISTINCT FROM {y} THEN 'EQUAL' "
        f"WHEN (({a} IS NULL OR coalesce({x} >= {a}, false)) AND ({b} IS NULL OR coalesce({y} <= {b}, false))) OR (({x} IS NULL OR coalesce({a} >= {x}, false)) AND ({y} IS NULL OR coalesce({b} <= {y}, false))) THEN 'CONTAINS' ELSE 'OVERLAPS' END"
    )


_KIND = "CASE WHEN coalesce(a_org IN ('acme', 'acme/eng') AND b_org IN ('acme', 'acme/eng'), false) THEN CASE WHEN a_kind IN ('opinion', 'fact') AND b_kind IN ('opinion', 'fact') THEN CASE WHEN a_kind = b_kind THEN 'EQUAL' ELSE 'DISJOINT' END ELSE 'UNKNOWN' END ELSE 'UNKNOWN' END"


@query(
    f"SELECT id, {_interval('a_from', 'a_until', 'b_from', 'b_until', 'CONTAINS')} valid_time, {_interval('a_seen', 'a_until', 'b_seen', 'b_until', 'UNKNOWN')} recorded_time, CASE WHEN a_name = b_name THEN 'EQUAL' ELSE 'UNKNOWN' END subject, 'UNKNOWN' memory_class, {_KIND} kind, {_KIND} = 'DISJOINT' apart FROM {PAIRS}"
)
def compared_dimensions(spark, sf):
    reg, a, b = D.registry(_OWN), _side("a"), _side("b")
    rel = {n.replace("-", "_"): D.compare(reg[n], a, b) for n in ("valid-time", "recorded-time", "subject", "memory-class", "kind")}
    return frame(spark, sf, "part", PAIR).select("id", *[c.alias(n) for n, c in rel.items()], D.separates(reg["kind"], rel["kind"]).alias("apart"))


@query(f"SELECT id, CASE WHEN a_kind IN ('opinion', 'fact') AND b_kind IN ('opinion', 'fact') THEN CASE WHEN a_kind = b_kind THEN 'EQUAL' ELSE 'DISJOINT' END ELSE 'UNKNOWN' END mapped, 'UNKNOWN' unmapped FROM {PAIRS}")
def compared_corpora(spark, sf):
    local, remote = (D.Dimension(n, "enum", ("memory_class",), values=("opinion", "fact")) for n in ("kind", "sort"))
    a, b = _side("a"), _side("b")
    return frame(spark, sf, "part", PAIR).select("id", D.across(local, remote, a, b, {"kind": "sort"}).alias("mapped"), D.across(local, remote, a, b).alias("unmapped"))


@query(f"SELECT id, {_LEQ.format(x='a_org', y='b_org')} below, coalesce((b_from IS NULL OR a_from >= b_from) AND (b_until IS NULL OR a_until <= b_until), false) inside FROM {PAIRS}")
def ordered_scopes(spark, sf):
    p = frame(spark, sf, "part", PAIR)
    return p.select("id", C.tree_leq(F.col("a_org"), F.col("b_org")).alias("below"), C.interval_leq(*_c("a_from", "a_until", "b_from", "b_until")).alias("inside"))


# --- gates of groups ---------------------------------------------------------------------------


@query("SELECT p_size, count(DISTINCT p_brand) >= 3 AND avg(p_retailprice) / 2000 < 0.75 held FROM part GROUP BY p_size")
def low_cohesion(spark, sf):
    g = table(spark, sf, "part").groupBy("p_size").agg(F.count_distinct("p_brand").alias("scopes"), (F.avg("p_retailprice") / 2000).alias("mean"))
    return g.select("p_size", K.low_cohesion(F.col("mean"), F.col("scopes"), 0.75, 3).alias("held"))


@query("SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%a%' AND p_size % 10 = 0 THEN 'mirror' WHEN p_partkey % 19 = 0 OR p_partkey % 17 = 0 THEN 'flag' WHEN p_partkey % 7 = 0 THEN 'phrase: still needs' END reason FROM part")
def never_ingested(spark, sf):
    """Why a page is refused: a live source owns its topic, or it only tells of work to do."""
    p = table(spark, sf, "part")
    owned = F.contains(F.lower("p_name"), F.lit("a")) & (F.col("p_size") % 10 == 0)
    text = F.when(F.col("p_partkey") % 7 == 0, "It STILL needs work").otherwise("done")
    state = S.pending_state(F.when(F.col("p_partkey") % 19 == 0, " Yes ").when(F.col("p_partkey") % 17 == 0, "ON").otherwise("no"), F.lit("name"), text)
    return p.select("p_partkey", F.when(owned, "mirror").otherwise(state).alias("reason"))


@query("WITH c AS (SELECT p_partkey, 1 o, lower(p_brand) t FROM part UNION ALL SELECT p_partkey, 2, lower(p_type) FROM part), a AS (SELECT lower(p_brand) t, 'brand' s FROM part GROUP BY 1 HAVING min(p_size) < 5 UNION ALL SELECT lower(p_type), 'type' FROM part GROUP BY 1 HAVING max(p_size) > 49) SELECT p_partkey, arg_min(s, o) source, arg_min(c.t, o) topic FROM c JOIN a ON a.t = c.t GROUP BY p_partkey")
def owned_topics(spark, sf):
    """The first of a page's topics that a live source owns."""
    p = table(spark, sf, "part")
    owners = p.groupBy(F.lower("p_brand").alias("topic")).agg(F.min("p_size").alias("z")).where("z < 5").select("topic", F.lit("brand").alias("source"))
    owners = owners.unionByName(p.groupBy(F.lower("p_type").alias("topic")).agg(F.max("p_size").alias("z")).where("z > 49").select("topic", F.lit("type").alias("source")))
    return M.owned(p.select("p_partkey", F.array("p_brand", "p_type").alias("topics")), "p_partkey", "topics", owners)


@query("SELECT CASE WHEN p_size % 4 = 0 AND DATE '2024-02-01' > d THEN 'kill' WHEN p_size % 4 = 0 THEN 'keep: not yet expired' END disposition, count(*) n FROM (SELECT p_size, CASE WHEN p_partkey % 3 > 0 THEN DATE '2024-01-01' + (p_partkey % 60)::INT END d FROM part) WHERE p_size % 4 = 0 GROUP BY 1")
def decay_sweep(spark, sf):
    rows = frame(spark, sf, "part", {"bucket": "CASE WHEN p_size % 4 = 0 THEN 'daily' END", "d": "CASE WHEN p_partkey % 3 > 0 THEN cast('2024-01-01' AS date) + cast(p_partkey % 60 AS int) END"})
    return A.swept(rows, F.col("bucket"), F.col("d"), F.lit("2024-02-01").cast("date")).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_size, CASE WHEN p_size % 5 = 0 THEN 'disabled' WHEN p_size % 3 = 0 THEN 'no instrumentation' WHEN n = 0 THEN 'no records' ELSE 'healthy' END reason, p_size % 5 = 0 OR (p_size % 3 > 0 AND n > 0) healthy FROM (SELECT p_size, count(*) FILTER (p_partkey % 40 = 1) n FROM part GROUP BY 1)")
def ingestion_gate(spark, sf):
    from codexmill.functions import gates as G

    g = table(spark, sf, "part").groupBy("p_size").agg(F.count_if(F.col("p_partkey") % 40 == 1).alias("n"))
    reason = G.ingestion(F.col("p_size") % 5 != 0, F.col("p_size") % 3 != 0, F.col("n"))
    return g.select("p_size", reason.alias("reason"), reason.isin("disabled", "healthy").alias("healthy"))


@query("SELECT doc_id, left(sha256('[\"1\",\"' || coalesce(source, '') || '\",\"set\"]'), 16) correction_id, trim(regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]+', '-', 'g'), '-') slug FROM documents")
def correction_ids(spark, sf):
    d = table(spark, sf, "documents")
    parts = F.array(F.lit("1"), F.coalesce("source", F.lit("")), F.lit("set"))
    return d.select("doc_id", S.short_hash(S.canonical(parts)).alias("correction_id"), T.slugify(F.coalesce("source", F.lit(""))).alias("slug"))
