"""Queries of anchored edits, findings with places, references in transcripts, and counts that
streaming state keeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.functions import privacy as P
from codexmill.functions import spans as N
from codexmill.operators import cluster as K
from codexmill.operators import edits, mentions
from codexmill.operators import vectors as W
from codexmill.registered import query
from codexmill.session import table
from codexmill.streaming import bounds

# operations cut out of each turn's own text: (turn modulo 8, op, anchor, text)
_OPS = [
    (0, "replace", "left(t, 9)", "'Begin: '"), (0, "insert_after", "right(t, 9)", "'!'"), (0, "append_section", "null", "'See also.'"),
    (1, "insert_after", "substr(t, 20, 12)", "' (noted)'"), (1, "replace", "substr(t, 1, 12)", "'Opening'"),
    (2, "replace", "substr(t, 2, 2)", "'First'"),
    (3, "replace", "left(t, 12)", "'x'"), (3, "replace", "substr(t, 7, 10)", "'y'"),
    (4, "replace", "concat(left(t, 4), '#')", "'z'"), (4, "append_section", "null", "'End.'"),
    (5, "append_section", "null", "'One.'"), (5, "append_section", "null", "'Two.'"),
    (6, "insert_after", "left(t, 14)", "'<'"), (6, "insert_after", "left(t, 14)", "'>'"), (6, "replace", "left(t, 14)", "role"),
    (7, "delete", "left(t, 9)", "'x'"),
]
_NUMBER = "(conv_id + turn) % 8"


def _ops_sql() -> str:
    each = " UNION ALL ".join(f"SELECT conv_id, turn, t, {i} i, '{op}' op, {anchor} anchor, {text} text FROM c WHERE {_NUMBER} = {n}" for i, (n, op, anchor, text) in enumerate(_OPS))
    return f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') t FROM conversations),
o AS ({each}),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 k, strpos(t, anchor) a FROM o),
q AS (SELECT *, CASE WHEN op NOT IN ('replace', 'insert_after', 'append_section') THEN 'unknown operation' WHEN op <> 'append_section' AND anchor = '' THEN 'no anchor'
  WHEN op <> 'append_section' AND a = 0 THEN 'anchor not found' WHEN op <> 'append_section' AND strpos(substr(t, a + 1), anchor) > 0 THEN 'anchor not unique' END e,
  CASE op WHEN 'replace' THEN a - 1 WHEN 'insert_after' THEN a - 1 + length(anchor) END s, CASE WHEN op <> 'append_section' THEN a - 1 + length(anchor) END f FROM p),
r AS (SELECT *, max(f) OVER (PARTITION BY conv_id, turn ORDER BY s, f, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before FROM q WHERE s IS NOT NULL),
w AS (SELECT conv_id, turn, coalesce(arg_min(k || ': ' || e, k) FILTER (e IS NOT NULL), CASE WHEN max((conv_id, turn) IN (SELECT (conv_id, turn) FROM r WHERE s < before)) THEN 'overlapping operations' END) error FROM q GROUP BY ALL),
b AS (SELECT conv_id, turn, string_agg(substr(t, coalesce(before, 0)::INT + 1, (s - coalesce(before, 0))::INT) || text, '' ORDER BY s, f, k) done, max(f) far FROM r GROUP BY ALL),
x AS (SELECT conv_id, turn, string_agg(chr(10) || chr(10) || text, '' ORDER BY k) sections FROM q WHERE op = 'append_section' GROUP BY ALL),
z AS (SELECT c.*, error, coalesce(done, '') || substr(t, coalesce(far, 0)::INT + 1) body, sections FROM c LEFT JOIN w USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn) LEFT JOIN x USING (conv_id, turn))
SELECT conv_id, turn, error, md5(CASE WHEN error IS NOT NULL THEN t WHEN sections IS NULL THEN body WHEN body = '' THEN substr(sections, 3) ELSE rtrim(body, chr(10)) || sections END) digest FROM z
"""


@query(_ops_sql())
def anchored_edits(spark, sf):
    """Turns edited by operations that name a passage: all of a turn's, or none and the reason."""
    c = table(spark, sf, "conversations").withColumn("t", F.expr("coalesce(text, '')"))
    each = [F.expr(f"CASE WHEN {_NUMBER} = {n} THEN named_struct('op', '{op}', 'anchor', CAST({anchor} AS STRING), 'text', {text}) END") for n, op, anchor, text in _OPS]
    c = c.withColumn("ops", F.filter(F.array(*each), lambda x: x.isNotNull()))
    out = edits.edited(c.select("conv_id", "turn", "t", "ops"), "t", "ops")
    return out.select("conv_id", "turn", "error", F.md5(F.col("edited").cast("binary")).alias("digest"))


_EMAIL = P.EMAIL.replace("'", "''")
_FOUND = f"""
WITH e AS (SELECT doc_id, text, unnest(v) AS value, generate_subscripts(v, 1) i, v, p FROM (SELECT doc_id, text, regexp_extract_all(text, '{_EMAIL}') v, string_split_regex(text, '{_EMAIL}') p FROM documents)),
f AS (SELECT doc_id, text, value, (list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM e),
g AS (SELECT *, left(text, start::INT) AS head FROM f WHERE lower(value) <> 'info@example.com')
"""


def _with_numbers(sf_table):
    """Texts in which every fifth carries numbers and addresses of its own, by its id."""
    line = "concat('\nCall +49 30 ', lpad(cast(doc_id * 7919 % 100000000 as string), 8, '0'), ' or (555) 0', lpad(cast(doc_id % 100 as string), 2, '0'), '-0', lpad(cast(doc_id % 1000 as string), 3, '0'), '; realm: 4155550', lpad(cast(doc_id % 1000 as string), 3, '0'), ' since 2020-01-15,\nx.4155550', lpad(cast(doc_id % 1000 as string), 3, '0'), '@mail.example.org')"
    return sf_table.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.coalesce("text", F.lit("")), F.expr(line))).otherwise(F.col("text")))


@query(_FOUND + "SELECT doc_id, 'email' kind, value, start, start + length(value) AS \"end\", (length(head) - length(replace(head, chr(10), '')) + 1)::BIGINT line, (length(head) - CASE WHEN contains(head, chr(10)) THEN length(head) - strpos(reverse(head), chr(10)) + 1 ELSE 0 END + 1)::BIGINT AS \"column\" FROM g")
def outbound_emails(spark, sf):
    """Addresses that leave with a text, with their offsets, line and column."""
    found = N.outbound(table(spark, sf, "documents"), "doc_id", "text", ["Info@Example.com"]).where("kind = 'email'")
    return found.select("doc_id", "kind", "value", F.col("start").cast("long"), F.col("end").cast("long"), F.col("line").cast("long"), F.col("column").cast("long"))


_LINE = "chr(10) || 'Call +49 30 ' || lpad((doc_id * 7919 % 100000000)::VARCHAR, 8, '0') || ' or (555) 0' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '-0' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || '; realm: 4155550' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || ' since 2020-01-15,' || chr(10) || 'x.4155550' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || '@mail.example.org'"
_PLANTED = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') || {_LINE} AS t FROM documents WHERE doc_id % 5 = 0),
w AS (SELECT doc_id, t, regexp_extract(t, 'Call (\\+49 30 [0-9]+) or (\\([0-9]+\\) [0-9-]+); realm: [0-9]+ since 2020-01-15,\\n(x[^@]+@mail.example.org)$', ['a', 'b', 'c']) m FROM d),
p AS (SELECT doc_id, t, 'phone' kind, m.a AS value FROM w UNION ALL SELECT doc_id, t, 'phone', m.b FROM w UNION ALL SELECT doc_id, t, 'email', m.c FROM w),
l AS (SELECT doc_id, kind, value, length(t) - strpos(reverse(t), reverse(value)) + 1 - length(value) + 0 AS start, t FROM p)
SELECT doc_id, kind, value, start::BIGINT AS start, (length(left(t, start::INT)) - length(replace(left(t, start::INT), chr(10), '')) + 1)::BIGINT line, (start - (length(left(t, start::INT)) - strpos(reverse(left(t, start::INT)), chr(10)) + 1) + 1)::BIGINT AS "column" FROM l
"""


@query(_PLANTED)
def outbound_findings(spark, sf):
    """Addresses and numbers in a last line that every fifth text gets: labelled ids, dates and
    numbers inside addresses are none."""
    docs = _with_numbers(table(spark, sf, "documents").where("doc_id % 5 = 0"))
    found = N.outbound(docs, "doc_id", "text")
    last = docs.select("doc_id", (F.length("text") - F.length(F.substring_index("text", "\n", -2))).alias("from"))
    found = found.join(last, "doc_id").where(F.col("start") >= F.col("from"))
    return found.select("doc_id", "kind", "value", F.col("start").cast("long"), F.col("line").cast("long"), F.col("column").cast("long"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '{_EMAIL}', '[redacted-email]', 'g')) digest FROM documents")
def outbound_redacted(spark, sf):
    """Texts with the found addresses replaced by their class."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    found = N.swept([N.matches(d, "doc_id", "text", "email", P.EMAIL)], "doc_id")
    return N.redacted(d, "doc_id", "text", found).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


_PUSHED = "SELECT conv_id, unnest([split_part(text, ' ', 2), split_part(text, ' ', 3) || '-' || conv_id, lower(split_part(text, ' ', 1)), role]) item FROM conversations"


@query(f"WITH p AS (SELECT DISTINCT conv_id, item FROM ({_PUSHED}) WHERE item <> ''), h AS (SELECT conv_id, item FROM p WHERE EXISTS (SELECT 1 FROM conversations t WHERE t.conv_id = p.conv_id AND contains(t.text, p.item))) SELECT conv_id, count(*) pushed, (SELECT count(*) FROM h WHERE h.conv_id = p.conv_id) referenced FROM p GROUP BY conv_id")
def session_references(spark, sf):
    """How many of the items that a session was pushed its transcript names. Items are words of the
    session's own turns, some with a suffix that no text holds."""
    c = table(spark, sf, "conversations")
    part = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    items = F.array(part(2), F.concat(part(3), F.lit("-"), F.col("conv_id").cast("string")), F.lower(part(1)), F.col("role"))
    return mentions.references(c.select("conv_id", F.explode(items).alias("item")), c, "conv_id", "item", "text")


@query(
    "WITH e AS (SELECT user_id, event_id, ts::DATE::VARCHAR AS content, event_type <> 'purchase' AS violated FROM events WHERE event_type IN ('error', 'click', 'purchase')), "
    "s AS (SELECT *, sum(CASE WHEN NOT violated OR pv IS NOT TRUE OR pc IS DISTINCT FROM content THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) stretch FROM (SELECT *, lag(violated) OVER w pv, lag(content) OVER w pc FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))), "
    "g AS (SELECT user_id, stretch, min(content) AS content, min(event_id) first_seq, count(*) FILTER (violated) violations FROM s GROUP BY ALL) "
    "SELECT user_id::VARCHAR AS key, arg_max(content, stretch) AS content, arg_max(violations, stretch) violations, arg_max(first_seq, stretch) first_seq, max(violations >= 3) crossed FROM g GROUP BY user_id HAVING arg_max(violations, stretch) > 0"
)
def bound_violations(spark, sf):
    """Violations in a row of each user, counted by a stream that is stopped half way and started
    again from its checkpoint."""
    e = table(spark, sf, "events").where("event_type in ('error', 'click', 'purchase')")
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.to_date("ts").cast("string").alias("content"), (F.col("event_type") != "purchase").alias("violated"))
    at = K.shared(spark, "bounds")
    # one number, taken once: an approximate one may differ where it is worked out again
    half = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    for late in (False, True):
        rows.where((F.col("seq") > F.lit(half)) == late).write.mode("append").parquet(f"{at}/in")
        bounds.run(spark, f"{at}/in", "key string, seq long, content string, violated boolean", f"{at}/checkpoint", f"{at}/out", 3)
    return bounds.latest(spark, f"{at}/out")


_VECTORS = "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 7 = 0 THEN -x ELSE x END) v FROM embeddings WHERE vec_id % 11 <> 0"


def _vectors(spark, sf):
    """A stored index of which a seventh was replaced and an eleventh purged."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    index = W.build(rows, "vec_id", "embedding", K.shared(spark, "vectors"), ["label"])
    index = W.upsert(index, rows.where("vec_id % 7 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    return W.purge(index, rows.where("vec_id % 11 = 0"))


@query(f"SELECT vec_id, len(v)::INT dims, round(list_sum(list_transform(v, lambda x: x::DOUBLE)), 6) total, round(v[1]::DOUBLE, 6) AS first FROM ({_VECTORS}) WHERE vec_id % 10 = 3 AND vec_id < 500 OR vec_id = 7")
def stored_vectors(spark, sf):
    """Vectors looked up by key after an upsert and a purge."""
    keys = [7, *range(3, 500, 10)]
    found = W.fetch(spark, _vectors(spark, sf), keys)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return found.select("vec_id", F.size("embedding").alias("dims"), F.round(total, 6).alias("total"), F.round(F.col("embedding")[0], 6).alias("first"))


_Q = [((i * 37) % 11 - 5) / 20 for i in range(64)]


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip(v, [{', '.join(f'{x}::DOUBLE' for x in _Q)}]), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))), 6) distance FROM ({_VECTORS}) ORDER BY distance, vec_id LIMIT 20")
def stored_vectors_nearest(spark, sf):
    """The nearest vectors by lists, none missed."""
    return W.nearest(spark, _vectors(spark, sf), _Q, 20)
