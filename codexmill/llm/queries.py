"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontaminate, licenses, lm, mixing, neardup, periodic, runindex, sharding, tokenstore, toxicity, urls, vafile
from .common import table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_score(table(spark, sf_dir, "documents"), order=3, held_modulus=10)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(table(spark, sf_dir, "documents"), percent=85)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, keys = tokenstore.write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenstore.read_store(folder, keys)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.repeats(periodic.looped(table(spark, sf_dir, "documents")))
    best = periodic.longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    milli = F.floor(length * 1000 / period)
    digest = lambda c, name: F.sha2(F.col(c).cast("binary"), 256).alias(name)
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), digest("lines", "runs_sha256"), digest("collapsed", "collapsed_sha256"))


def op12_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runindex.drop_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    found = align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), groups=digest)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_toxicity, op3_url_filter, op4_decontamination, op5_license_scan, op6_sharding, op7_mixing, op8_vector_search, op9_near_dedup, op10_token_store, op11_periodic_runs, op12_repeated_substrings, op13_token_alignment, pipeline)}


_OP3 = """
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) rv FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.rv, 'allow') verdict FROM p LEFT JOIN m ON m.page_id = p.page_id
"""

_OP7 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 number FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][number % 3 + 1] weight FROM s),
f AS (SELECT *, (sum(source_size) OVER ()) * 3 - 2 * coalesce(2 * sum(source_size) OVER before, 0) AS rem, (sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) rest FROM w WINDOW before AS (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, source_size * 4 * rest <= weight * rem stops FROM f),
t AS (SELECT *, CASE WHEN stops THEN 2.0::DOUBLE * source_size ELSE (weight * (SELECT arg_max(rem, rest) FROM g WHERE NOT stops))::DOUBLE / ((SELECT max(rest) FROM g WHERE NOT stops) * 2)::DOUBLE END target FROM g),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END rate, (('0x' || left(md5('mix:' || coalesce(d.source, chr(0) || 'null')), 8))::UBIGINT)::DOUBLE / 4294967296.0::DOUBLE unit, (row_number() OVER (PARTITION BY number ORDER BY d.size, d.doc_id) - 1)::DOUBLE place FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (least(floor(unit + (place + 1) * rate) - floor(unit + place * rate), 2) * size)::BIGINT taken FROM o
"""

_OP8 = """
WITH v AS (SELECT row_number() OVER () n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) q FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.n, a.vec_id query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT score FROM v a JOIN v b ON a.n <> b.n AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""


def _op5() -> str:
    texts = ", ".join(f"({i}, '{name}', '{text.lower().replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
    grams = "list_distinct(list_transform(list_zip({w}[:-2], {w}[2:]), lambda z: z[1] || ' ' || z[2]))"
    return f"""
WITH k AS (SELECT template, license, {grams.format(w="w")} b FROM (SELECT template, license, regexp_extract_all(t, '[a-z0-9]+') w FROM (VALUES {texts}) x(template, license, t))),
x AS (SELECT doc_id, lower(text) t FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, unnest(list_distinct(list_append(string_split(t, chr(10)), replace(t, chr(10), ' ')))) line FROM x),
u AS (SELECT doc_id, row_number() OVER () unit, {grams.format(w="w")} b FROM (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, regexp_extract_all(line, '[a-z0-9]+') w FROM y) WHERE len(w) > 1)),
s AS (SELECT doc_id, unit, license, round(2.0 * len(list_intersect(u.b, k.b)) / (len(u.b) + len(k.b)), 6)::DOUBLE dice FROM u JOIN k ON list_has_any(u.b, k.b)),
z AS (SELECT *, max(dice) OVER (PARTITION BY doc_id, unit) best FROM s WHERE dice >= 0.8)
SELECT doc_id, license, max(dice) dice, count(DISTINCT unit) AS lines FROM z WHERE dice = best GROUP BY ALL
"""


def oracle_sql() -> dict[str, str]:
    """No SQL for trained models (1, 2), alignment (4), checksums of texts (6), components (9),
    tokenizers (10) and the pipeline: tests compare those with brute force."""
    return {"op3_url_filter": _OP3, "op5_license_scan": _op5(), "op7_mixing": _OP7, "op8_vector_search": _OP8}
