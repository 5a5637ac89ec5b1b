"""Queries over the supplied tables, each beside its DuckDB SQL (None where SQL can't say it)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import compare as C
from .functions import gates as G
from .functions import privacy as P
from .functions import stemming as Z
from .functions import text as T
from .operators import access as A
from .operators import cluster as K
from .operators import compile as M
from .operators import folds as D
from .operators import incremental as I
from .operators import lexical as X
from .operators import ledger as L
from .operators import partitions as H
from .operators import resolve as E
from .operators import retrieval as R
from .operators import rules as U
from .operators import verdicts as V
from .plans import recall as plans
from .registered import ALL, Query, query
from .session import bound_batches, spread, table
from .streaming import ingest as S



def _every() -> dict[str, tuple[Query, str | None]]:
    from . import catalog  # noqa: F401  registers the rest

    return ALL


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _every().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _every().items() if sql}


AUDIENCE = "CASE doc_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' END"
_audience = lambda: F.expr(AUDIENCE.replace("doc_id % 4", "pmod(doc_id, 4)"))


def _words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


# --- retrieval -------------------------------------------------------------------------------


def _count(column: str, token: str) -> str:
    return f"((length({column}) - length(replace({column}, '{token}', ''))) // {len(token)})"


@query(
    "SELECT doc_id, (3.0 * ({h}) + ({b}))::DOUBLE AS score FROM (SELECT doc_id, lower(coalesce(lang, '') || ' ' || coalesce(source, '')) h, lower(coalesce(text, '')) b FROM documents) "
    "WHERE 3.0 * ({h}) + ({b}) > 0 ORDER BY score DESC, doc_id LIMIT 20".format(h=" + ".join(_count("h", t) for t in ("the", "station", "en")), b=" + ".join(_count("b", t) for t in ("the", "station", "en")))
)
def recall_keyword(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))
    return R.keyword_search(d, "doc_id", F.concat_ws(" ", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))), F.col("text"), "the station: en", 20)


@query(
    "SELECT doc_id, ({b})::DOUBLE AS score FROM (SELECT doc_id, lower(coalesce(text, '')) b FROM documents WHERE lang IN ('de', 'fr') AND coalesce({a} = 'open' OR source = 'src1', false)) WHERE ({b}) > 0 ORDER BY score DESC, doc_id LIMIT 15".format(
        a=AUDIENCE, b=" + ".join(_count("b", t) for t in ("les", "der"))
    )
)
def recall_keyword_authorized(spark, sf):
    allowed = A.authorized(_audience(), F.array("source"), ["src1"]) & F.col("lang").isin("de", "fr")
    return R.keyword_search(table(spark, sf, "documents"), "doc_id", F.lit(""), F.col("text"), "les der", 15, allowed)


def _porter_sql(words: str) -> str:
    """CTEs that end in st(word, stem) from a query of distinct words: the stemmer as a chain of
    patterns, of which each step sees what the one before left. A first y is a consonant."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    m0, m1, once = f"^({c})?{v}{c}", f"^({c})?{v}{c}{v}{c}", f"^({c})?{v}{c}({v})?$"
    vowel, short = f"^({c})?[aeiouy]", f"^{c}[aeiouy][^aeiouwxy]$"
    is_ = lambda x, p: f"regexp_matches({x}, '{p}')"
    head = lambda n: f"left(s, greatest(length(s) - {n}, 0))"

    def swap(endings: dict[str, str], measure: str, more: str = "true") -> str:
        each = " ".join(f"WHEN ends_with(s, '{e}') THEN CASE WHEN {is_(head(len(e)), measure)} AND {more if e == 'ion' else 'true'} THEN {head(len(e))} || '{to}' ELSE s END" for e, to in sorted(endings.items(), key=lambda x: -len(x[0])))
        return f"CASE {each} ELSE s END"

    cut = "CASE WHEN ends_with(s, 'ed') THEN left(s, length(s) - 2) ELSE left(s, length(s) - 3) END"
    mended = f"CASE WHEN {is_('x', '(at|bl|iz)$')} THEN x || 'e' WHEN length(x) > 1 AND right(x, 1) = left(right(x, 2), 1) AND right(x, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') THEN left(x, length(x) - 1) WHEN {is_('x', once)} AND {is_('x', short)} THEN x || 'e' ELSE x END"
    steps = [
        f"CASE WHEN {is_('s', '(ss|i)es$')} THEN {head(2)} WHEN {is_('s', '[^s]s$')} THEN {head(1)} ELSE s END",
        f"CASE WHEN ends_with(s, 'eed') THEN CASE WHEN {is_(head(3), m0)} THEN {head(1)} ELSE s END WHEN {is_('s', '(ed|ing)$')} AND {is_(cut, vowel)} THEN (SELECT {mended} FROM (SELECT {cut} x)) ELSE s END",
        f"CASE WHEN ends_with(s, 'y') AND {is_(head(1), vowel)} THEN {head(1)} || 'i' ELSE s END",
        swap(Z.STEP2, m0),
        swap(Z.STEP3, m0),
        swap(dict.fromkeys(Z.STEP4, ""), m1, f"{is_(head(3), '[st]$')}"),
        f"CASE WHEN ends_with(s, 'e') AND ({is_(head(1), m1)} OR {is_(head(1), once)} AND NOT {is_(head(1), short)}) THEN {head(1)} ELSE s END",
        f"CASE WHEN ends_with(s, 'll') AND {is_(head(1), m1)} THEN {head(1)} ELSE s END",
    ]
    chain = [f"p0 AS (SELECT word, CASE WHEN starts_with(word, 'y') THEN 'Y' || substr(word, 2) ELSE word END s FROM ({words}) WHERE length(word) >= 3 AND strlen(word) <= 64)"]
    chain += [f"p{i} AS (SELECT word, {step} s FROM p{i - 1})" for i, step in enumerate(steps, 1)]
    return ", ".join([*chain, f"st AS (SELECT word, lower(s) stem FROM p{len(steps)} UNION ALL SELECT word, word FROM ({words}) WHERE length(word) < 3 OR strlen(word) > 64)"])


_FIELDS = {"title": "regexp_extract(text, '^[^\\n]*', 0)", "tags": "concat_ws(' ', lang, source)", "body": "text"}
_WEIGHTS, _FLOOR = (3.0, 2.0, 1.0), 1e-6
#: Words of all fields, without case and accents, and their stems.
_INDEXED = (
    "f AS (SELECT doc_id, lang, source, unnest([0, 1, 2]) field, unnest([regexp_extract(text, '^[^\\n]*'), concat_ws(' ', lang, source), text]) t FROM documents), "
    r"w AS (SELECT doc_id, field, unnest(regexp_extract_all(strip_accents(lower(coalesce(t, ''))), '[\p{L}\p{N}]+')) word FROM f), " + _porter_sql("SELECT DISTINCT word FROM w") + ", "
    "t AS (SELECT doc_id, field, stem, count(*) n FROM w JOIN st USING (word) GROUP BY ALL)"
)


def _bm25_sql(terms: list[str], where: str, k: int) -> str:
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(_WEIGHTS))
    return (
        f"WITH {_INDEXED}, len AS (SELECT doc_id, sum(n)::DOUBLE len FROM t GROUP BY 1), a AS (SELECT (SELECT count(*) FROM documents)::DOUBLE n, sum(len) / (SELECT count(*) FROM documents) mean FROM len), "
        f"h AS (SELECT doc_id, stem, sum(n * CASE field {weights} END)::DOUBLE tf FROM t WHERE stem IN ({', '.join(repr(x) for x in terms)}) GROUP BY ALL), o AS (SELECT stem, ((SELECT n FROM a) - count(*) + 0.5) / (count(*) + 0.5) odds FROM h GROUP BY 1), "
        f"z AS (SELECT doc_id, round(sum(CASE WHEN odds > 1 THEN ln(odds) ELSE {_FLOOR} END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) score FROM h JOIN o USING (stem) JOIN len USING (doc_id) JOIN documents USING (doc_id), a WHERE {where} GROUP BY 1) "
        f"SELECT doc_id, score FROM z WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {k}"
    )


_INDEXES: dict[tuple[str, str], X.Index] = {}


def _index(spark, sf) -> X.Index:
    """The stored index of the documents, built once per application and table."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _INDEXES:
        path = K.shared(spark, "lexical")
        _INDEXES[at] = X.build(table(spark, sf, "documents"), "doc_id", {c: F.expr(e) for c, e in _FIELDS.items()}, path, ["lang", "source"])
    return _INDEXES[at]


_BM25_QUERY, _BM25_TERMS = "Where is the station of worthless thing, erthing and heration?", ["station", "worthless", "erth", "herat"]


def _search(spark, sf, k: int, where: Column | None = None):
    return X.search(spark, _index(spark, sf), _BM25_QUERY, k, where, _WEIGHTS, floor=_FLOOR)


@query(_bm25_sql(_BM25_TERMS, "true", 20))
def recall_bm25(spark, sf):
    return _search(spark, sf, 20)


@query(_bm25_sql(_BM25_TERMS, "lang = 'en' AND doc_id % 4 = 0", 10))
def recall_bm25_filtered(spark, sf):
    where = (F.col("lang") == "en") & A.authorized(_audience(), F.array().cast("array<string>"), ["none"])
    return _search(spark, sf, 10, where)


@query(f"WITH {_INDEXED} SELECT stem AS term, count(DISTINCT doc_id) df, sum(n)::BIGINT cf FROM t GROUP BY 1")
def index_dictionary(spark, sf):
    return X.dictionary(spark, _index(spark, sf))


def _probe() -> list[float]:
    return [((i * 37) % 11 - 5) / 20 for i in range(64)]


_KNN = "SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, {q}), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))), 6) distance FROM embeddings".format(q="[" + ",".join(f"{x}::DOUBLE" for x in _probe()) + "]")


@query(f"SELECT vec_id, distance FROM ({_KNN}) ORDER BY distance, vec_id LIMIT 20")
def recall_vector(spark, sf):
    return R.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", _probe(), 20)


@query(f"SELECT vec_id, distance FROM ({_KNN} WHERE label IN (1, 4, 7)) ORDER BY distance, vec_id LIMIT 10")
def recall_vector_filtered(spark, sf):
    return R.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", _probe(), 10, F.col("label").isin(1, 4, 7))


@query(f"SELECT count(*) hits, count(*) >= 2 AND count(DISTINCT distance) = 1 degenerate FROM (SELECT * FROM ({_KNN}) ORDER BY distance, vec_id LIMIT 20)")
def recall_degenerate(spark, sf):
    return R.degenerate(recall_vector(spark, sf))


@query(
    f"WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) rank FROM ({_bm25_sql(_BM25_TERMS, 'true', 3)})), v AS (SELECT vec_id doc_id, row_number() OVER (ORDER BY distance, vec_id) rank FROM (SELECT * FROM ({_KNN}) ORDER BY distance, vec_id LIMIT 3)), "
    "b AS (SELECT doc_id, arm, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY arm, rank) n FROM (SELECT doc_id, 0 arm, rank FROM l UNION ALL SELECT doc_id, 1 arm, rank FROM v)) WHERE n = 1) "
    "SELECT doc_id, arm, position FROM (SELECT doc_id, arm, row_number() OVER (ORDER BY arm, rank) position FROM b) WHERE position <= 3"
)
def recall_hybrid(spark, sf):
    lexical = R.ranked(_search(spark, sf, 3), [F.desc("score"), F.col("doc_id")])
    vector = R.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", _probe(), 3).withColumnRenamed("vec_id", "doc_id")
    return R.hybrid(lexical, R.ranked(vector, [F.col("distance"), F.col("doc_id")]), "doc_id")


@query(f"SELECT doc_id, score, row_number() OVER (ORDER BY (doc_id % 3 = 0)::INT, score DESC, doc_id) position FROM ({_bm25_sql(_BM25_TERMS, 'true', 20)})")
def recall_by_currency(spark, sf):
    hits = R.ranked(_search(spark, sf, 20), [F.desc("score"), F.col("doc_id")])
    return R.by_currency(hits, F.pmod("doc_id", F.lit(3)) == 0).select("doc_id", "score", "position")


_ALLOWED = f"coalesce({AUDIENCE} = 'open' OR source IN ('src0', 'src2'), false)"
_FIRST = "least({})".format(", ".join(f"nullif(instr(lower(text), '{t}'), 0)" for t in T.query_tokens(_BM25_QUERY, 3)))


@query(f"SELECT doc_id, score, row_number() OVER (ORDER BY (doc_id % 5 = 0)::INT, score DESC, doc_id) AS position, substr(text, greatest(1, coalesce({_FIRST}, 1) - 30), 120) snippet FROM ({_bm25_sql(_BM25_TERMS, _ALLOWED, 10)}) JOIN documents USING (doc_id)")
def recall_plan(spark, sf):
    docs = table(spark, sf, "documents")
    allowed = A.authorized(_audience(), F.array("source"), ["src0", "src2"])
    return plans.recall(_index(spark, sf), docs, "text", _BM25_QUERY, 10, allowed, F.pmod("doc_id", F.lit(5)) == 0, weights=_WEIGHTS, floor=_FLOOR)


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def candidates_by_type(spark, sf):
    parts = table(spark, sf, "part")
    least = parts.agg(F.min("p_brand").alias("b"))
    return parts.join(F.broadcast(least), parts["p_brand"] == least["b"]).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_retailprice, p_size FROM part WHERE (regexp_matches(lower(p_type), '[ae]l$') OR contains(lower(p_name), 'a')) AND NOT coalesce(lower(p_brand) = 'brand#11', false) ORDER BY p_retailprice DESC, p_partkey::VARCHAR LIMIT 50")
def enumerate_parts(spark, sf):
    where = (R.predicate([F.col("p_type")], "regex", "[ae]l$") | R.predicate([F.col("p_name")], "substring", "A")) & R.predicate([F.col("p_brand")], "eq", "BRAND#11", negate=True)
    return R.enumerate_rows(table(spark, sf, "part"), "p_partkey", F.col("p_retailprice"), where, 50).select("p_partkey", "p_retailprice", "p_size")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 5000 OR (c_acctbal = 5000 AND c_custkey::VARCHAR > '10') ORDER BY c_acctbal DESC, c_custkey::VARCHAR LIMIT 25")
def enumerate_next_page(spark, sf):
    after = R.cursor(1, 5000.0, "", 10)
    return R.enumerate_rows(table(spark, sf, "customer"), "c_custkey", F.col("c_acctbal"), F.lit(True), 25, after=after).select("c_custkey", "c_acctbal")


@query("SELECT coalesce(lang, name) AS type, coalesce(n, 0) n, name IS NOT NULL declared, n IS NOT NULL observed FROM (SELECT lang, count(*) n FROM documents GROUP BY lang) FULL JOIN (VALUES ('en'), ('de'), ('it')) t(name) ON lang = name")
def class_registry(spark, sf):
    return R.class_registry(table(spark, sf, "documents"), "lang", ["en", "de", "it"])


# --- access and validity ----------------------------------------------------------------------


@query(f"SELECT doc_id FROM documents WHERE coalesce({AUDIENCE} = 'open' OR source IN ('src3', 'src4'), false)")
def access_authorized(spark, sf):
    return table(spark, sf, "documents").where(A.authorized(_audience(), F.array("source"), ["src3", "src4"])).select("doc_id")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, bool_and(l_returnflag <> 'R') ok FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) WHERE ok")
def access_all_sources(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))  # three flags at most
    rows = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.where(A.all_authorized(F.col("flags"), lambda f: f != "R")).select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority LIKE '1%') AND NOT coalesce(DATE '1997-06-01' > CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE END, false)")
def access_active(spark, sf):
    until = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.to_date("o_orderdate"))
    gone = A.inactive((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1"), F.lit(False), until, F.lit("1997-06-01").cast("date"))
    return table(spark, sf, "orders").where(~gone).select("o_orderkey", "o_orderstatus")


@query("SELECT access, count(*) n FROM (SELECT CASE WHEN coalesce(rank_a, -1) >= rank_b THEN a ELSE b END AS access FROM (SELECT a, b, CASE a WHEN 'open' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 WHEN 'personal' THEN 3 END rank_a, CASE b WHEN 'internal' THEN 1 ELSE 3 END rank_b FROM (SELECT {a} a, CASE WHEN doc_id % 3 = 0 THEN 'personal' ELSE 'internal' END b FROM documents))) GROUP BY access".format(a=AUDIENCE))
def access_more_restrictive(spark, sf):
    stamp = F.when(F.pmod("doc_id", F.lit(3)) == 0, "personal").otherwise("internal")
    return table(spark, sf, "documents").select(A.more_restrictive(_audience(), stamp).alias("access")).groupBy("access").agg(F.count(F.lit(1)).alias("n"))


# --- resolution --------------------------------------------------------------------------------

_PERSONS = "SELECT c_custkey uid, CASE WHEN c_custkey % 9 = 0 THEN (c_custkey // 18)::VARCHAR END apollo, CASE WHEN c_custkey % 5 = 0 THEN (c_custkey % 400)::VARCHAR END linkedin, lower(c_mktsegment) || ' ' || (c_nationkey * 40 + c_custkey % 40)::VARCHAR AS name, c_acctbal warm FROM customer"


def _persons(spark, sf):
    c = table(spark, sf, "customer")
    return c.selectExpr("c_custkey uid", "CASE WHEN c_custkey % 9 = 0 THEN cast(c_custkey div 18 AS string) END apollo", "CASE WHEN c_custkey % 5 = 0 THEN cast(c_custkey % 400 AS string) END linkedin", "lower(c_mktsegment) || ' ' || cast(c_nationkey * 40 + c_custkey % 40 AS string) AS name", "c_acctbal warm").withColumn("has", F.col("apollo").isNotNull().cast("int"))


def _duplicates_sql() -> str:
    arm = "SELECT uid absorbed, {i} priority, '{s}' signal, first_value(uid) OVER (PARTITION BY {s} ORDER BY (apollo IS NOT NULL)::INT DESC, warm DESC, uid) canonical, count(*) OVER (PARTITION BY {s}) n FROM p WHERE {s} IS NOT NULL"
    arms = " UNION ALL ".join(f"SELECT * FROM ({arm.format(i=i, s=s)}) WHERE absorbed <> canonical AND n {'BETWEEN 2 AND 3' if s == 'name' else '>= 2'}" for i, s in enumerate(("apollo", "linkedin", "name")))
    return f"WITH p AS ({_PERSONS}) SELECT absorbed, canonical, signal FROM (SELECT *, row_number() OVER (PARTITION BY absorbed ORDER BY priority) k FROM ({arms})) WHERE k = 1"


@query(_duplicates_sql())
def duplicate_persons(spark, sf):
    return E.duplicates(_persons(spark, sf), ["apollo", "linkedin"], "name", ["has", "warm"])


@query(f"SELECT canonical, count(*) n, max(warm) warm, list_sort(list_distinct(list(name))) AS names FROM (SELECT coalesce(canonical, uid) canonical, warm, name FROM ({_PERSONS}) LEFT JOIN ({_duplicates_sql()}) ON uid = absorbed) GROUP BY canonical")
def merged_persons(spark, sf):
    persons = _persons(spark, sf)
    links = E.duplicates(persons, ["apollo", "linkedin"], "name", ["has", "warm"])
    rows = persons.join(links, F.col("uid") == F.col("absorbed"), "left").withColumn("canonical", F.coalesce("canonical", "uid")).withColumn("names", F.array("name"))
    return E.merged(rows, "canonical", {"warm": "max", "names": "union"}, [F.col("uid")])


@query("SELECT c_custkey, r_name, candidates FROM customer LEFT JOIN (SELECT lower(c_mktsegment) a, max_by(r, c_custkey) r_name, count(DISTINCT r) candidates FROM (SELECT c_mktsegment, c_custkey, 'r' || (c_custkey % 3)::VARCHAR r FROM customer) GROUP BY 1) ON lower(c_mktsegment) = a")
def lookup_alias(spark, sf):
    c = table(spark, sf, "customer")
    index = c.select(F.col("c_mktsegment").alias("alias"), F.col("c_custkey").alias("seq"), F.concat(F.lit("r"), F.col("c_custkey") % 3).alias("r_name"))
    return E.lookup(c, index, "c_mktsegment", "alias", "r_name", F.col("seq")).select("c_custkey", "r_name", "candidates")


@query(
    "WITH n AS (SELECT DISTINCT w[1] || ' ' || w[2] AS name FROM (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') w FROM benchmark) WHERE len(w) >= 2), "
    "d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') w FROM documents), g AS (SELECT DISTINCT doc_id, a || ' ' || b gram FROM (SELECT doc_id, unnest(w[:-2]) a, unnest(w[2:]) b FROM d WHERE len(w) >= 2)) SELECT doc_id, name FROM g JOIN n ON gram = name"
)
def names_in_texts(spark, sf):
    words = _words()
    names = table(spark, sf, "benchmark").select(words.alias("w")).where(F.size("w") >= 2).select(F.array_join(F.slice("w", 1, 2), " ").alias("name")).distinct()
    return E.names_in_texts(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", F.col("text"), names, "name", 2)


@query("SELECT key, side FROM (SELECT DISTINCT c_custkey key, 'left' side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))")
def surface_divergence(spark, sf):
    return E.divergence(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), "key")


@query(
    "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') slug, regexp_replace(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), ' +', ' ', 'g') AS name, regexp_replace(regexp_replace(lower('https://www.linkedin.com/in/' || p_name || '/?x=1'), '^https?://(www\\.)?', ''), '\\?.*$', '') profile FROM part"
)
def normal_names(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.slugify(F.col("p_name")).alias("slug"), T.normal_name(F.regexp_replace("p_type", "[^A-Za-z0-9]+", " ")).alias("name"), T.canonical_profile(F.concat(F.lit("https://www.linkedin.com/in/"), "p_name", F.lit("/?x=1"))).alias("profile"))


# --- clusters and claims -----------------------------------------------------------------------


def _edges(spark, sf):
    return K.cosine_edges(K.classes(table(spark, sf, "embeddings"), "vec_id", "embedding"), 0.33)


_EDGES = "WITH e AS (SELECT vec_id, embedding v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) n FROM (SELECT min(vec_id) vec_id, embedding FROM embeddings GROUP BY embedding)), p AS (SELECT a.vec_id a, b.vec_id b, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1]::DOUBLE * z[2])) / (a.n * b.n), 9) similarity FROM e a JOIN e b ON a.vec_id < b.vec_id) "


@query(_EDGES + "SELECT vec_id, count(*) links FROM (SELECT unnest([a, b]) vec_id FROM p WHERE similarity >= 0.33) GROUP BY vec_id")
def cosine_links(spark, sf):
    return _edges(spark, sf).select(F.explode(F.array("a", "b")).alias("vec_id")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("links"))


@query(_EDGES.replace("WITH e", "WITH RECURSIVE e") + ", g AS (SELECT a x, b y FROM p WHERE similarity >= 0.33 UNION ALL SELECT b, a FROM p WHERE similarity >= 0.33), r AS (SELECT DISTINCT x node, x reach FROM g UNION SELECT r.node, g.y FROM r JOIN g ON g.x = r.reach) SELECT node, min(reach) root FROM r GROUP BY node HAVING min(reach) <> node")
def cosine_components(spark, sf):
    return K.components(_edges(spark, sf))


_LINKED = _EDGES.replace("WITH e", "WITH RECURSIVE e") + ", g AS (SELECT a x, b y FROM p WHERE similarity >= 0.33 UNION ALL SELECT b, a FROM p WHERE similarity >= 0.33), r AS (SELECT DISTINCT x node, x reach FROM g UNION SELECT r.node, g.y FROM r JOIN g ON g.x = r.reach), "
_LINKED += "k AS (SELECT vec_id, coalesce((SELECT min(reach) FROM r WHERE node = vec_id), vec_id) a, label b FROM embeddings), c AS (SELECT a, b, count(*) n FROM k GROUP BY ALL), x AS (SELECT a, sum(n) n, count(*) parts FROM c GROUP BY 1), y AS (SELECT b, sum(n) n, count(*) parts FROM c GROUP BY 1)"


@query(_LINKED.replace("(SELECT min(vec_id) vec_id, embedding FROM embeddings GROUP BY embedding)", "embeddings") + " SELECT a AS \"group\", n::BIGINT members, parts, (SELECT max(n) FROM c WHERE c.a = x.a) largest FROM x WHERE parts > 1")
def linkage_splits(spark, sf):
    """Components of similar vectors, equal ones among them, whose members bear several labels."""
    e = table(spark, sf, "embeddings")
    named = K._written(K.classes(e, "vec_id", "embedding"))
    links = K.cosine_edges(named, 0.33).select("a", "b").unionByName(K.copies(e, named, "vec_id", "embedding"))
    linked = K.components(links).select(F.col("node").alias("vec_id"), "root")
    held = e.select("vec_id", "label").join(linked, "vec_id", "left")
    counts = held.groupBy(F.coalesce("root", "vec_id").alias("a"), F.col("label").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    # rows without a key have no largest part in the SQL, where null equals nothing
    return H.parted(counts, "a", "b").withColumn("largest", F.when(F.col("group").isNotNull(), F.col("largest")))


def _linkage_table(spark, sf):
    e = table(spark, sf, "embeddings")
    linked = K.components(_edges(spark, sf)).select(F.col("node").alias("vec_id"), F.col("root").alias("g"))
    return H.contingency(e, linked, e.select("vec_id", F.col("label").alias("g")), "vec_id", "g")


@query(
    _LINKED + ", t AS (SELECT (SELECT sum(n) FROM c)::BIGINT rows, (SELECT count(*) FROM x) groups_a, (SELECT count(*) FROM y) groups_b, (SELECT count(*) FILTER (parts > 1) FROM x) splits, (SELECT count(*) FILTER (parts > 1) FROM y) merges, "
    "(SELECT sum(n * (n - 1) / 2) FROM x)::DOUBLE pairs_a, (SELECT sum(n * (n - 1) / 2) FROM y)::DOUBLE pairs_b, (SELECT sum(n * (n - 1) / 2) FROM c)::DOUBLE pairs_both), w AS (SELECT *, rows * (rows - 1) / 2 whole FROM t) "
    "SELECT rows, groups_a, groups_b, splits, merges, pairs_a, pairs_b, pairs_both, round((whole + 2 * pairs_both - pairs_a - pairs_b) / whole, 9)::DOUBLE AS rand, round((pairs_both - pairs_a * pairs_b / whole) / ((pairs_a + pairs_b) / 2 - pairs_a * pairs_b / whole), 9)::DOUBLE adjusted FROM w"
)
def linkage_agreement(spark, sf):
    """How far components of similar vectors and labels agree, over all pairs."""
    return H.agreement(_linkage_table(spark, sf))


@query()
def cosine_clusters(spark, sf):
    edges = K._written(_edges(spark, sf))
    clusters = K.complete_linkage(edges, None, 0.33)
    shape = K.cohesion(edges, clusters)
    return shape.withColumn("reason", K.gate(F.col("members"), F.lit(1.0), F.col("mean_similarity"), F.col("min_similarity")))


_CLAIMS = "SELECT doc_id, trim(regexp_replace(lower(unnest(string_split_regex(coalesce(text, ''), '[.!?\\n]+'))), '[ \\t]+', ' ', 'g')) c FROM documents"


@query(f"SELECT left(sha1(c), 16) claim_key, count(DISTINCT doc_id) entities, count(*) occurrences FROM ({_CLAIMS}) WHERE length(c) > 0 GROUP BY c HAVING count(DISTINCT doc_id) >= 2")
def recurring_claims(spark, sf):
    parts = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[.!?\n]+"), lambda s: F.trim(F.regexp_replace(s, "[ \t]+", " ")))
    return K.recurring_claims(table(spark, sf, "documents"), "doc_id", parts)


@query(
    "WITH t AS (SELECT source, doc_id, word, count(*) n FROM (SELECT source, doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) word FROM documents) GROUP BY ALL), s AS (SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, sum(n) DESC, word) place FROM t GROUP BY source, word) "
    "SELECT source, string_agg(word, '-' ORDER BY place) topic FROM s WHERE place <= 3 GROUP BY source"
)
def topic_slugs(spark, sf):
    return K.topic_words(table(spark, sf, "documents"), "source", "doc_id", _words())


@query(
    "WITH t AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) word FROM conversations), m AS (SELECT conv_id, count(DISTINCT turn) members FROM conversations GROUP BY 1) SELECT conv_id, word FROM (SELECT conv_id, word, count(*) k FROM t GROUP BY ALL) JOIN m USING (conv_id) WHERE k = members"
)
def shared_words(spark, sf):
    return K.shared_words(table(spark, sf, "conversations"), "conv_id", "turn", _words())


_CLAIM = "SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) c FROM documents"


@query(f"SELECT a.doc_id, left(sha1(least(a.c, b.c) || chr(10) || greatest(a.c, b.c) || chr(10) || 'kind'), 16) print, least(a.doc_id::VARCHAR, b.doc_id::VARCHAR) || '+' || greatest(a.doc_id::VARCHAR, b.doc_id::VARCHAR) pair FROM ({_CLAIM}) a JOIN ({_CLAIM}) b ON b.doc_id = a.doc_id + 1")
def claim_fingerprints(spark, sf):
    a = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("ta"))
    both = a.join(a.select(F.col("doc_id").alias("other"), F.col("ta").alias("tb")), F.col("other") == F.col("doc_id") + 1)
    return both.select("doc_id", T.pair_fingerprint(F.col("ta"), F.col("tb"), F.lit("kind")).alias("print"), T.pair_key(F.col("doc_id").cast("string"), F.col("other").cast("string")).alias("pair"))


# --- comparators -------------------------------------------------------------------------------

_WINDOWS = "SELECT o_orderkey, o_orderdate::DATE af, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderdate + INTERVAL 30 DAY)::DATE END au, CASE WHEN o_orderkey % 5 > 0 THEN f END bf, u bu FROM orders JOIN (SELECT l_orderkey, min(l_shipdate)::DATE f, max(l_shipdate)::DATE u FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"


@query(
    f"SELECT o_orderkey, CASE WHEN coalesce(au <= bf, false) OR coalesce(bu <= af, false) THEN 'DISJOINT' WHEN af IS NOT DISTINCT FROM bf AND au IS NOT DISTINCT FROM bu THEN 'EQUAL' "
    "WHEN ((af IS NULL OR coalesce(bf >= af, false)) AND (au IS NULL OR coalesce(bu <= au, false))) OR ((bf IS NULL OR coalesce(af >= bf, false)) AND (bu IS NULL OR coalesce(au <= bu, false))) THEN 'CONTAINS' ELSE 'OVERLAPS' END relation, "
    f"coalesce(au < bf, false) OR coalesce(bu < af, false) closed_disjoint FROM ({_WINDOWS})"
)
def compare_intervals(spark, sf):
    ship = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("f"), F.to_date(F.max("l_shipdate")).alias("bu"))
    o = table(spark, sf, "orders").join(ship, F.col("l_orderkey") == F.col("o_orderkey"))
    af, au = F.to_date("o_orderdate"), F.when(F.col("o_orderkey") % 7 > 0, F.date_add(F.to_date("o_orderdate"), 30))
    bf, bu = F.when(F.col("o_orderkey") % 5 > 0, F.col("f")), F.col("bu")
    return o.select("o_orderkey", C.interval(af, au, bf, bu).alias("relation"), C.closed_disjoint(af, au, bf, bu).alias("closed_disjoint"))


_PATHS = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '*' WHEN 2 THEN 'x' ELSE 'x/' || (p_size % 3)::VARCHAR END a, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '*' WHEN 2 THEN ' X/1 ' ELSE 'x/1/' || (p_size % 2)::VARCHAR END b, p_size FROM part"


@query(
    f"SELECT p_partkey, CASE WHEN a IS NULL AND b IS NULL THEN 'UNKNOWN' WHEN a IS NULL OR b IS NULL THEN 'CONTAINS' WHEN a = '*' AND b = '*' THEN 'EQUAL' WHEN a = '*' OR b = '*' THEN 'CONTAINS' WHEN lower(trim(a)) = lower(trim(b)) THEN 'EQUAL' WHEN starts_with(lower(trim(a)) || '/', lower(trim(b)) || '/') OR starts_with(lower(trim(b)) || '/', lower(trim(a)) || '/') THEN 'CONTAINS' ELSE 'DISJOINT' END hierarchy, "
    f"CASE WHEN a IS NULL OR b IS NULL THEN 'UNKNOWN' WHEN a = '*' AND b = '*' THEN 'EQUAL' WHEN a = '*' OR b = '*' THEN 'CONTAINS' WHEN a = b THEN 'EQUAL' ELSE 'DISJOINT' END enum, "
    f"CASE WHEN a IS NULL OR b IS NULL THEN 'UNKNOWN' WHEN a = '*' AND b = '*' THEN 'EQUAL' WHEN a = '*' OR b = '*' THEN 'CONTAINS' WHEN a = b THEN 'EQUAL' WHEN p_size > 25 THEN 'DISJOINT' ELSE 'UNKNOWN' END AS identity FROM ({_PATHS})"
)
def compare_scopes(spark, sf):
    size = lambda n: f"cast(p_size % {n} AS string)"
    p = table(spark, sf, "part").selectExpr("p_partkey", "p_size", f"CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '*' WHEN 2 THEN 'x' ELSE 'x/' || {size(3)} END a", f"CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '*' WHEN 2 THEN ' X/1 ' ELSE 'x/1/' || {size(2)} END b")
    a, b = F.col("a"), F.col("b")
    return p.select("p_partkey", C.hierarchy(a, b).alias("hierarchy"), C.enum(a, b).alias("enum"), C.identity(a, b, F.col("p_size") > 25).alias("identity"))


@query(
    "SELECT org, locale, win, CASE WHEN org = 'DISJOINT' OR locale = 'DISJOINT' OR win = 'DISJOINT' THEN 'DISJOINT' WHEN org = 'EQUAL' AND locale = 'EQUAL' THEN 'OVERLAP' WHEN org IN ('BELOW', 'EQUAL') AND locale IN ('BELOW', 'EQUAL') THEN 'OVERRIDE_LEFT' WHEN org IN ('ABOVE', 'EQUAL') AND locale IN ('ABOVE', 'EQUAL') THEN 'OVERRIDE_RIGHT' ELSE 'OVERLAP' END verdict, count(*) n "
    "FROM (SELECT ['BELOW', 'ABOVE', 'EQUAL', 'DISJOINT'][p_size % 4 + 1] org, ['BELOW', 'ABOVE', 'EQUAL', 'DISJOINT'][p_partkey % 4 + 1] locale, CASE WHEN p_partkey % 9 = 0 THEN 'DISJOINT' ELSE 'OVERLAPS' END win FROM part) GROUP BY ALL"
)
def compare_scope_verdicts(spark, sf):
    names = F.array(*[F.lit(x) for x in ("BELOW", "ABOVE", "EQUAL", "DISJOINT")])
    p = table(spark, sf, "part").select(names[F.col("p_size") % 4].alias("org"), names[(F.col("p_partkey") % 4).cast("int")].alias("locale"), F.when(F.col("p_partkey") % 9 == 0, "DISJOINT").otherwise("OVERLAPS").alias("win"))
    return p.withColumn("verdict", C.scope_verdict(F.col("org"), F.col("locale"), F.col("win"))).groupBy("org", "locale", "win", "verdict").agg(F.count(F.lit(1)).alias("n"))


_RANK = "CASE {c} WHEN 'user' THEN 1 WHEN 'linkedin' THEN 2 WHEN 'twitter' THEN 2 WHEN 'api' THEN 3 WHEN 'claude' THEN 6 ELSE 9 END"
_SOURCES = ["user", "linkedin", "twitter", "api", "claude", "other"]


@query(
    "SELECT event_id, CASE WHEN same THEN 'noop' WHEN mono AND clears THEN CASE WHEN b = 1 THEN 'apply' ELSE 'defer' END WHEN mono THEN 'apply' WHEN b < a THEN 'apply' WHEN b > a THEN 'defer' WHEN seen IS NULL THEN 'escalate' WHEN seen > upd THEN 'apply' WHEN seen < upd THEN 'defer' ELSE 'escalate' END verdict FROM "
    f"(SELECT event_id, {_RANK.format(c='x')} a, {_RANK.format(c='y')} b, event_id % 11 = 0 same, event_type = 'click' mono, user_id % 2 = 0 clears, CASE WHEN event_id % 4 > 0 THEN ts::DATE END seen, DATE '2024-01-15' upd FROM (SELECT *, {_SOURCES}[event_id % 6 + 1] x, {_SOURCES}[user_id % 6 + 1] y FROM events))"
)
def conflict_verdicts(spark, sf):
    names = F.array(*[F.lit(f"{x}:ref") for x in _SOURCES])
    e = table(spark, sf, "events")
    a, b = C.source_rank(names[(F.col("event_id") % 6).cast("int")]), C.source_rank(names[(F.col("user_id") % 6).cast("int")])
    seen = F.when(F.col("event_id") % 4 > 0, F.to_date("ts"))
    return e.select("event_id", C.verdict(a, b, F.col("event_id") % 11 == 0, seen, F.lit("2024-01-15").cast("date"), F.col("event_type") == "click", F.col("user_id") % 2 == 0).alias("verdict"))


# --- ledgers -----------------------------------------------------------------------------------

_SPEND = "SELECT event_id, ts, user_id, event_type run_type, CASE event_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'subscription' WHEN 2 THEN 'unknown' ELSE CASE WHEN user_id % 2 = 0 THEN 'api' ELSE 'subscription' END END bucket, 'model-' || (event_id % 5)::VARCHAR || '-' || (user_id % 3)::VARCHAR model, (event_id % 1000)::BIGINT tokens, round(coalesce(value, 0), 2) cost FROM events"


def _spend(spark, sf):
    e = table(spark, sf, "events")
    mode = F.expr("CASE event_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'subscription' END")
    provider = F.expr("CASE WHEN event_id % 4 = 2 THEN NULL WHEN user_id % 2 = 0 THEN 'cloud' ELSE 'cli' END")
    model = F.expr("'model-' || cast(event_id % 5 AS string) || '-' || cast(user_id % 3 AS string)")
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("run_type"), L.billing_bucket(mode, provider, "cloud", "cli").alias("bucket"), model.alias("model"), (F.col("event_id") % 1000).alias("tokens"), F.round(F.coalesce("value", F.lit(0.0)), 2).alias("cost"))


_SUMS = "count(*) records, sum(tokens)::BIGINT tokens, round(sum(CASE WHEN bucket = 'subscription' THEN 0 ELSE cost END), 4)::DOUBLE cost"


@query(f"SELECT b.bucket, coalesce(records, 0) records, coalesce(tokens, 0) tokens, coalesce(cost, 0) AS cost FROM (VALUES ('api'), ('subscription'), ('unknown')) b(bucket) LEFT JOIN (SELECT bucket, {_SUMS} FROM ({_SPEND}) GROUP BY bucket) USING (bucket)")
def spend_summary(spark, sf):
    return L.summarize(_spend(spark, sf), "bucket", "tokens", "cost")


@query(f"SELECT 'run_type' part, run_type AS value, bucket, {_SUMS} FROM ({_SPEND}) GROUP BY ALL UNION ALL SELECT 'model', model, bucket, {_SUMS} FROM ({_SPEND}) GROUP BY ALL")
def spend_breakdown(spark, sf):
    return L.breakdown(_spend(spark, sf), "bucket", ["run_type", "model"], "tokens", "cost")


_RATES = [("model", 1.0), ("model-1", 2.0), ("model-1-2", 5.0), ("model-3", 3.5)]


@query(f"WITH r(prefix, rate) AS (VALUES ('model', 1.0::DOUBLE), ('model-1', 2.0), ('model-1-2', 5.0), ('model-3', 3.5)) SELECT bucket, round(sum(cost), 4)::DOUBLE stored, round(sum(tokens * rate / 1e6), 4)::DOUBLE repriced, count(*) FILTER (rate IS NULL) unpriceable FROM (SELECT *, (SELECT arg_max(rate, length(prefix)) FROM r WHERE starts_with(model, prefix)) rate FROM ({_SPEND})) GROUP BY bucket")
def spend_reprice(spark, sf):
    rates = F.broadcast(spark.createDataFrame(_RATES, "prefix string, rate double"))
    return L.reprice(_spend(spark, sf), "model", "tokens", "cost", "bucket", rates, sorted({len(p) for p, _ in _RATES}))


@query(f"SELECT ts::DATE AS day, bucket, {_SUMS} FROM ({_SPEND}) GROUP BY ALL")
def spend_by_day(spark, sf):
    return _spend(spark, sf).groupBy(F.to_date("ts").alias("day"), "bucket").agg(*L._sums("tokens", "cost", "bucket"))


@query(f"SELECT bucket, round(coalesce(consumed, 0), 4)::DOUBLE consumed, cap, round(cap - coalesce(consumed, 0), 4)::DOUBLE AS left, coalesce(consumed, 0) >= cap tripped FROM (VALUES ('api', 1000.0::DOUBLE), ('unknown', 1e9)) c(bucket, cap) LEFT JOIN (SELECT bucket, sum(cost) consumed FROM ({_SPEND}) GROUP BY bucket) USING (bucket)")
def spend_headroom(spark, sf):
    return L.headroom(_spend(spark, sf), "bucket", "cost", {"api": 1000.0, "unknown": 1e9})


@query("SELECT coalesce(p.user_id, r.user_id) user_id, coalesce(pushed, 0) pushed, coalesce(referenced, 0) referenced, last_pushed, last_referenced FROM (SELECT user_id, count(*) pushed, max(ts::VARCHAR) last_pushed FROM events WHERE event_type = 'view' GROUP BY 1) p FULL JOIN (SELECT user_id, count(*) referenced, max(ts::VARCHAR) last_referenced FROM events WHERE event_type = 'click' GROUP BY 1) r ON p.user_id = r.user_id".replace("ts::VARCHAR", "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"))
def usage_report(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return L.usage(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "t")


@query("SELECT count(DISTINCT session) sessions, count(*) records, round(sum(referenced) / nullif(sum(pushed), 0), 6)::DOUBLE AS precision FROM (SELECT user_id::VARCHAR || ':' || ts::DATE::VARCHAR session, count(*) FILTER (event_type = 'view') pushed, count(*) FILTER (event_type = 'click') referenced FROM events WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY 1)")
def push_precision(spark, sf):
    e = table(spark, sf, "events").where("ts >= timestamp'2024-01-08'")
    s = e.groupBy(F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session")).agg(F.count_if(F.col("event_type") == "view").alias("pushed"), F.count_if(F.col("event_type") == "click").alias("referenced"))
    return L.precision(s, "pushed", "referenced", "session")


@query("WITH c AS (SELECT event_type tier, (user_id % 3)::VARCHAR AS scope, count(*) n FROM events GROUP BY ALL) SELECT sum(n)::BIGINT total, count(*) pairings, (SELECT tier FROM c ORDER BY n DESC, tier, scope LIMIT 1) top_tier, (SELECT scope FROM c ORDER BY n DESC, tier, scope LIMIT 1) top_scope, round(max(n) / sum(n), 6)::DOUBLE AS share, count(*) <= 1 degenerate FROM c")
def push_concentration(spark, sf):
    return L.concentration(table(spark, sf, "events").withColumn("scope", (F.col("user_id") % 3).cast("string")), "event_type", "scope")


@query("SELECT tier, coalesce(reviewed, 0) reviewed, coalesce(overturned, 0) overturned FROM (VALUES ('click'), ('view'), ('never')) t(tier) LEFT JOIN (SELECT event_type tier, count(*) FILTER (event_id % 2 = 0) reviewed, count(*) FILTER (event_id % 2 = 0 AND value > 50) overturned FROM events GROUP BY 1) USING (tier)")
def calibration_summary(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "tier")
    even = F.col("event_id") % 2 == 0
    return L.calibration(e, "tier", ["click", "view", "never"], {"reviewed": even, "overturned": even & (F.col("value") > 50)})


@query("SELECT count(*) runs, round(avg(q), 6)::DOUBLE mean, round(sum(p) / nullif(sum(q), 0), 6)::DOUBLE ratio FROM (SELECT o_totalprice p, o_orderkey % 97 q FROM orders WHERE o_orderkey % 97 > 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 14)")
def drain_rate(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate", "o_orderkey", F.col("o_totalprice").alias("p"), (F.col("o_orderkey") % 97).alias("q")).where("q > 0")
    return L.trailing_rate(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], "p", "q")


@query("SELECT class, count(*) n, sum(s)::BIGINT bytes FROM (SELECT s, CASE WHEN s >= 16000 THEN 'flag' WHEN s >= 4000 THEN 'warn' ELSE 'ok' END AS class FROM (SELECT strlen(coalesce(text, '')) s FROM documents)) GROUP BY class")
def page_sizes(spark, sf):
    return L.size_classes(table(spark, sf, "documents"), "text", 4000, 16000)


# --- folds -------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) k FROM events WHERE event_type <> 'error' AND event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_type = 'error')) WHERE k = 1")
def fold_observations(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    bad = e.where("event_type = 'error'").select((F.col("event_id") - 1).alias("event_id"))
    return D.fold_observations(e.where("event_type <> 'error'"), bad, "event_id", ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 live FROM orders")
def compact_verdicts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return D.compact(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "live")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase')::INT DESC, event_id DESC) k FROM events) WHERE k = 1")
def resolved_records(spark, sf):
    return D.resolved(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", F.col("event_type") == "purchase", "event_id")


@query("SELECT user_id, arg_max(event_type, event_id) last_action, count(*) actions, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY user_id")
def ledger_audit(spark, sf):
    return D.audit(table(spark, sf, "events"), "user_id", "event_type", "event_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_items(spark, sf):
    return D.pending(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("WITH e AS (SELECT user_id, event_id, event_type = 'error' f FROM events), g AS (SELECT user_id, max(event_id) ok FROM e WHERE NOT f GROUP BY 1) SELECT user_id, count(*) failures FROM e LEFT JOIN g USING (user_id) WHERE f AND (ok IS NULL OR event_id > ok) GROUP BY user_id")
def failure_streaks(spark, sf):
    return D.streaks(table(spark, sf, "events"), "user_id", F.col("event_type") == "error", "event_id")


@query("SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) - 1) // 25 chunk FROM lineitem")
def member_chunks(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    return D.chunks(rows, "l_suppkey", [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], 25).select("l_orderkey", "l_linenumber", "chunk")


@query("SELECT user_id, day, event_id FROM (SELECT user_id, ts::DATE AS day, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) k FROM events) WHERE k = 1")
def first_sources(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id")
    return E.first_per(e, ["user_id", "day"], [F.col("ts"), F.col("event_id")]).select("user_id", "day", "event_id")


# --- rules -------------------------------------------------------------------------------------

_RULES = [U.Rule("a-errors", "skip", equals={"event_type": "error"}), U.Rule("b-values", "emit", within={"event_type": ("click", "view")}, globs={"props": '*"k": 1*'}), U.Rule("c-watch", "rollup", globs={"event_type": "p*"}, live=False)]


@query(
    "SELECT rule, disposition, count(*) n FROM (SELECT CASE WHEN event_type = 'error' THEN 'a-errors' WHEN event_type IN ('click', 'view') AND contains(props, '\"k\": 1') THEN 'b-values' WHEN starts_with(event_type, 'p') THEN 'c-watch' END rule, CASE WHEN event_type = 'error' THEN 'skip' WHEN event_type IN ('click', 'view') AND contains(props, '\"k\": 1') THEN 'emit' WHEN starts_with(event_type, 'p') THEN 'observed-rollup' ELSE 'no-match' END disposition FROM events) GROUP BY ALL"
)
def rule_tallies(spark, sf):
    e = table(spark, sf, "events")
    done = U.apply_rules(e, _RULES, {c: F.col(c) for c in e.columns})
    return done.groupBy("rule", "disposition").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, count(*) AS count, max(ts::DATE) AS last FROM events GROUP BY ALL")
def rule_rollups(spark, sf):
    e = table(spark, sf, "events")
    row = {c: F.col(c) for c in e.columns}
    return U.rollup(e, ["user_id", "event_type"], U.value({"fn": "date_of", "args": ["$ts"]}, row))


@query("SELECT event_type, left(sha256('[\"k\"]'), 16) AS print, count(*) n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY ALL")
def shape_frequency(spark, sf):
    e = table(spark, sf, "events").where("ts >= timestamp'2024-01-20'")
    return e.groupBy("event_type", T.key_fingerprint(F.col("props")).alias("print")).agg(F.count(F.lit(1)).alias("n"))


# --- privacy -----------------------------------------------------------------------------------

_EMAILS = "SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) e FROM documents"


@query(f"SELECT doc_id, list_sort(e) emails, len(e) n FROM ({_EMAILS}) WHERE len(e) > 0")
def inline_emails(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", P.emails(F.col("text")).alias("e")).where(F.size("e") > 0)
    return d.select("doc_id", F.array_sort("e").alias("emails"), F.size("e").cast("long").alias("n"))


def _phones_sql() -> str:
    """The rules for numbers in SQL, one condition each over the token t."""
    labels = "|".join(P.LABELS)
    body = r"\d[\d\-.\s()]{6,}\d"
    source = f"regexp_replace(coalesce(text, ''), '(^|[^A-Za-z0-9])(?:{labels})[\\s`''\"(:=\\-]*[+(]?{body}\\b', '\\1 ', 'gi')"
    bare = "regexp_replace(regexp_replace(t, '^[+(]', ''), '\\)$', '')"
    flat = f"regexp_replace({bare}, '[()]', '', 'g')"
    part = lambda i: f"regexp_extract({bare}, '^(\\d{{1,4}})[-./](\\d{{1,4}})[-./](\\d{{1,4}})$', {i})"
    year = lambda x: f"regexp_matches({x}, '^(?:19|20)\\d\\d$')"
    other = f"try_cast(CASE WHEN {year(part(1))} THEN {part(3)} ELSE {part(1)} END AS INT)"
    middle = f"try_cast({part(2)} AS INT)"
    bad = [
        "regexp_matches(t, '[\\r\\n\\t]')",
        "length(replace(t, '(', '')) <> length(replace(t, ')', ''))",
        f"({year(part(1))} <> {year(part(3))} AND coalesce({other} BETWEEN 1 AND 31 AND {middle} BETWEEN 1 AND 31 AND ({other} <= 12 OR {middle} <= 12), false))",
        f"regexp_matches({bare}, '^(?:19|20)\\d\\d[-.\\s]+(?:19|20)\\d\\d$')",
        f"(regexp_matches({bare}, '^\\d+$') AND (length({bare}) < 10 OR length({bare}) > 15))",
        f"regexp_matches({bare}, '^97[89]\\d{{10}}$')",
        f"regexp_matches({flat}, '\\d[^\\d][^\\d]+\\d')",
        f"(len(regexp_extract_all({flat}, '\\d+')) >= 4 AND NOT starts_with(t, '+'))",
        f"len(regexp_extract_all({flat}, '\\d+')) > 4",
        f"(len(regexp_extract_all({flat}, '\\d+')) >= 2 AND NOT starts_with(t, '+') AND length(regexp_replace(t, '\\D', '', 'g')) < 10)",
    ]
    found = f"SELECT doc_id, unnest(f) t, generate_subscripts(f, 1) i FROM (SELECT doc_id, regexp_extract_all({source}, '(?:\\B[+(]|\\b){body}\\b') f FROM documents)"
    return f"SELECT doc_id, list(t ORDER BY i) phones FROM (SELECT doc_id, t, min(i) i FROM ({found}) WHERE length(regexp_replace(t, '\\D', '', 'g')) >= 7 AND NOT ({' OR '.join(bad)}) GROUP BY doc_id, t) GROUP BY doc_id"


@query(_phones_sql())
def inline_phones(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", P.phones(F.col("text")).alias("phones")).where(F.size("phones") > 0)


def _medical_sql() -> str:
    """The same signs for an engine whose word boundaries know ASCII letters only."""
    edge = lambda p: re.sub(r"\\b$", r"(?:$|[^\\p{L}\\p{N}_])", re.sub(r"^(\(\?i\))?\\b", r"\1(?:^|[^\\p{L}\\p{N}_])", p))
    any_ = lambda c, patterns: "(" + " OR ".join(f"regexp_matches({c}, '{edge(p)}')" for p in patterns) + ")"
    drugs = f"regexp_extract_all(low, '{edge(P.DOSAGE_OF)}', 1)".replace(r"(\w+)", r"([\p{L}\p{N}_]+)")
    otc = ", ".join(f"'{x}'" for x in P.OTC)
    return f"SELECT doc_id, CASE WHEN {any_('low', P.HIGH)} OR len(list_filter({drugs}, lambda d: d NOT IN ({otc}))) > 0 OR ({any_('low', P.MEDIUM)} AND ({any_('low', P.CONTEXT)} OR {any_('t', [P.ICD])})) THEN 'personal' END AS access FROM (SELECT doc_id, coalesce(text, '') t, lower(coalesce(text, '')) low FROM documents)"


@query(_medical_sql())
def medical_screen(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.when(P.is_medical(F.col("text")), "personal").alias("access"))


@query("SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[redacted]', 'g')) digest FROM documents")
def redacted_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(P.redact(F.col("text")).cast("binary")).alias("digest"))


@query(f"WITH f AS (SELECT doc_id, unnest(e) email FROM ({_EMAILS})), a(allowed) AS (VALUES ('info@example.com'), ('unused@example.org')) SELECT 'finding' kind, email, count(*) n FROM f WHERE email NOT IN (SELECT allowed FROM a) GROUP BY email UNION ALL SELECT 'unused', allowed, 0 FROM a WHERE allowed NOT IN (SELECT email FROM f)")
def adjudicated_emails(spark, sf):
    found = table(spark, sf, "documents").select(F.explode(P.emails(F.col("text"))).alias("email"))
    allowed = spark.createDataFrame([("info@example.com",), ("unused@example.org",)], "email string")
    open_ = found.join(F.broadcast(allowed), "email", "left_anti").groupBy("email").agg(F.count(F.lit(1)).alias("n")).select(F.lit("finding").alias("kind"), "email", "n")
    return open_.unionByName(allowed.join(found.distinct(), "email", "left_anti").select(F.lit("unused").alias("kind"), "email", F.lit(0).cast("long").alias("n")))


@query("SELECT p_partkey FROM part WHERE ('0x' || left(sha256('tier:' || p_partkey::VARCHAR), 16))::UBIGINT / 18446744073709551616.0 < 0.2")
def audit_sample(spark, sf):
    return table(spark, sf, "part").where(T.sampled(F.lit("tier"), F.col("p_partkey").cast("string"), 0.2)).select("p_partkey")


@query(
    f"SELECT doc_id, len(e)::BIGINT n, md5(list_reduce(list_prepend(text, list_transform(list_sort(list_transform(e, lambda v: {{'k': -length(v), 'v': v}})), lambda z: z.v)), lambda acc, v: replace(acc, v, '[[email:' || left(sha256('email|' || doc_id::VARCHAR || '|' || v), 16) || ']]'))) digest FROM (SELECT doc_id, coalesce(text, '') AS text, e FROM documents JOIN ({_EMAILS}) USING (doc_id))"
)
def routed_values(spark, sf):
    text, vault = P.routed(F.col("doc_id"), F.coalesce("text", F.lit("")), "email", P.EMAIL)
    return table(spark, sf, "documents").select("doc_id", F.size(vault).cast("long").alias("n"), F.md5(text.cast("binary")).alias("digest"))


@query()
def affected_clusters(spark, sf):
    """Classes that a change of every seventh vector can reach."""
    edges = K._written(_edges(spark, sf))
    prior = K.complete_linkage(edges, None, 0.33)
    changed = table(spark, sf, "embeddings").where("vec_id % 7 = 0").select(F.col("vec_id").alias("class"))
    return K.affected(prior, edges, changed)


# --- incremental and transcripts ---------------------------------------------------------------

_DELTA = "WITH b AS (SELECT doc_id, sha256(coalesce(text, '')) h FROM documents WHERE doc_id % 10 <> 3), a AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) h FROM documents WHERE doc_id % 11 <> 5), x AS (SELECT coalesce(a.doc_id, b.doc_id) doc_id, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' END change FROM b FULL JOIN a ON a.doc_id = b.doc_id) "


def _versions(spark, sf):
    """Two versions of the corpus: one without a tenth, one with edits and without an eleventh."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    return I.manifest(d, "doc_id", F.col("text"), F.col("doc_id") % 10 != 3), I.manifest(d, "doc_id", edited, F.col("doc_id") % 11 != 5)


@query(_DELTA + "SELECT doc_id, change FROM x WHERE change IS NOT NULL")
def manifest_delta(spark, sf):
    return I.delta(*_versions(spark, sf), "doc_id")


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) hash FROM documents WHERE doc_id % 11 <> 5")
def delta_equals_full(spark, sf):
    before, after = _versions(spark, sf)
    return I.apply_delta(before, I.delta(before, after, "doc_id"), after, "doc_id")


@query(_DELTA + "SELECT e.item_id, d.doc_id FROM benchmark e JOIN documents d ON d.doc_id = e.item_id * 3 WHERE e.item_id IN (SELECT doc_id FROM x WHERE change IS NOT NULL) OR d.doc_id IN (SELECT doc_id FROM x WHERE change IS NOT NULL)")
def stale_entries(spark, sf):
    entries = table(spark, sf, "benchmark").select("item_id").join(table(spark, sf, "documents").select("doc_id"), F.col("doc_id") == F.col("item_id") * 3)
    changes = I.delta(*_versions(spark, sf), "doc_id").withColumnRenamed("doc_id", "key")
    return I.stale(entries, changes, "item_id", "doc_id", "key")


@query("SELECT user_id, count(*) n FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) p FROM events) WHERE p IS NULL OR ts >= p + INTERVAL 6 HOUR GROUP BY user_id")
def session_counts(spark, sf):
    return S.sessions(table(spark, sf, "events"), "ts", "6 hours", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN g < 0 THEN 'future' WHEN g > 730 THEN 'backdated' ELSE 'ok' END AS class FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1997-01-01') g FROM orders)")
def temporal_classes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.temporal_class(F.to_date("o_orderdate"), F.lit("1997-01-01").cast("date")).alias("class"))


_NEAT = "lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


@query(
    f"WITH u AS (SELECT conv_id, list({_NEAT.format(c='text')}) said FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id), l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) \"at\" FROM conversations WHERE role <> 'user') "
    f'SELECT conv_id, turn, "at", ' f"{_NEAT.format(c='line')} <> '' AND len(list_filter(coalesce(said, []), lambda x: contains(x, {_NEAT.format(c='line')}))) > 0 stated FROM l LEFT JOIN u USING (conv_id)"
)
def user_stated(spark, sf):
    """Whether each whole line of the other side was said, white space and case aside, by the user."""
    c = table(spark, sf, "conversations")
    said = c.where("role = 'user' and text is not null").groupBy("conv_id").agg(F.collect_list(T.neat(F.col("text"))).alias("said"))  # a conversation's own turns
    lines = c.where("role <> 'user'").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("claim", T.neat(F.col("line")))
    stated = F.exists(F.coalesce("said", F.array().cast("array<string>")), lambda x: F.contains(x, F.col("claim")))
    return lines.join(said, "conv_id", "left").select("conv_id", "turn", (F.col("at") + 1).cast("long").alias("at"), ((F.col("claim") != "") & stated).alias("stated"))


@query("SELECT doc_id, (length(coalesce(text, '')) // 4)::INT tokens FROM documents")
def prompt_estimates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.prompt_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


# --- gates and schedules -----------------------------------------------------------------------


@query(
    "SELECT reason, count(*) n FROM (SELECT CASE WHEN doc_id % 50 = 0 THEN 'flag' WHEN source LIKE 'src1_' THEN 'scope' WHEN contains(t, 'station')::INT + contains(t, 'worthless')::INT + contains(t, 'loser')::INT >= 2 THEN 'markers' END reason FROM (SELECT *, lower(coalesce(text, '')) t FROM documents)) GROUP BY reason"
)
def ephemeral_pages(spark, sf):
    reason = G.ephemeral(F.col("doc_id") % 50 == 0, F.col("source"), F.col("text"), ["src1?"], ["station", "worthless", "loser"])
    return table(spark, sf, "documents").select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN NOT regexp_matches(nm, '\\s') AND regexp_extract(lower(nm), '\\.([a-z0-9]+)$', 1) IN ('py', 'md', 'sql') AND lower(nm) <> 'readme.md' THEN 'extension' END rule FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'mod' || p_size || '.py' WHEN 1 THEN 'A file.md' WHEN 2 THEN 'README.md' WHEN 3 THEN 'src/x' ELSE 'notes.' || p_size || '.SQL' END nm FROM part)")
def code_artifacts(spark, sf):
    name = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'mod' || p_size || '.py' WHEN 1 THEN 'A file.md' WHEN 2 THEN 'README.md' WHEN 3 THEN 'src/x' ELSE 'notes.' || p_size || '.SQL' END")
    return table(spark, sf, "part").select("p_partkey", G.code_artifact(name, ("readme.md",)).alias("rule"))


_GROUPS = "SELECT p_size, count(*) pages, count(DISTINCT CASE WHEN p_partkey % 4 > 0 THEN p_brand END) kinds, bool_or(p_partkey % 97 = 0) pii, bool_or(p_partkey % 89 = 0) axiom, bool_or(p_partkey % 83 = 0) dup FROM part GROUP BY p_size"


@query(f"SELECT p_size, pages >= 2 AND kinds > 1 cross_class, CASE WHEN pages > 60 THEN 'too-many-pages' WHEN pii THEN 'pii' WHEN axiom THEN 'axiom' WHEN kinds > 1 THEN 'cross-class' WHEN dup THEN 'live-source' END reason FROM ({_GROUPS})")
def merge_gates(spark, sf):
    p = table(spark, sf, "part")
    any_ = lambda n: F.bool_or(F.col("p_partkey") % n == 0)
    g = p.groupBy("p_size").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct(F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand"))).alias("kinds"), any_(97).alias("pii"), any_(89).alias("axiom"), any_(83).alias("dup"))
    return g.select("p_size", G.cross_class(F.col("pages"), F.col("kinds")).alias("cross_class"), G.safe_class(F.col("pages"), F.col("pii"), F.col("axiom"), F.col("kinds"), F.col("dup"), 60).alias("reason"))


@query("SELECT event_id FROM events WHERE coalesce(event_type = 'view' AND user_id % 2 = 0 AND ts < TIMESTAMP '2024-01-30' - INTERVAL 14 DAY, false)")
def decayed_suppressions(spark, sf):
    e = table(spark, sf, "events")
    by, action = F.when(F.col("event_type") == "view", "auto").otherwise("human"), F.when(F.col("user_id") % 2 == 0, "not_a_conflict").otherwise("keep")
    return e.where(G.decayed(by, action, F.col("ts"), F.lit("2024-01-30").cast("timestamp"), 14)).select("event_id")


@query("SELECT user_id, CASE WHEN user_id = 1 THEN 'on-demand' WHEN files >= 70 THEN 'backlog-files' WHEN bytes >= 3000 THEN 'backlog-bytes' WHEN h IS NULL OR h >= 20 THEN 'interval' WHEN h >= 24 THEN 'nightly-backstop' ELSE 'none' END reason FROM (SELECT user_id, count(*) files, sum(event_id % 100) bytes, CASE WHEN user_id % 5 > 0 THEN user_id * 3 END h FROM events GROUP BY user_id)")
def run_triggers(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("event_id") % 100).alias("bytes"))
    hours = F.when(F.col("user_id") % 5 > 0, F.col("user_id") * 3)
    return e.select("user_id", G.trigger(F.col("user_id") == 1, F.col("files"), F.col("bytes"), hours, 70, 3000, 20).alias("reason"))


@query("SELECT rate, round_even(b * rate / 100.0, 0)::BIGINT decisions, round_even(round_even(b * rate / 100.0, 0) / 20.0, 0)::BIGINT AS days, round_even(round_even(b * rate / 100.0, 0) / 20.0, 0) > 182 breaches FROM (SELECT count(*) b FROM documents), (VALUES (10), (25), (50), (100)) r(rate)")
def sensitivity(spark, sf):
    backlog = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("b"))
    rows = backlog.select("b", F.explode(F.array(*[F.lit(x) for x in (10, 25, 50, 100)])).alias("rate"))
    decisions = F.bround(F.col("b") * F.col("rate") / 100.0, 0)
    days = F.bround(decisions / 20.0, 0)
    return rows.select("rate", decisions.cast("long").alias("decisions"), days.cast("long").alias("days"), (days > 182).alias("breaches"))


@query("SELECT n_nationkey, CASE WHEN c = 0 THEN 0.0 WHEN n_nationkey % 6 = 0 THEN 'inf'::DOUBLE ELSE ceil(c / (n_nationkey % 6))::DOUBLE END nights, CASE WHEN n_nationkey % 4 = 0 THEN 'indeterminate' WHEN c <= 60 AND c * 10 <= 550 THEN 'closes' ELSE 'does-not-close' END verdict FROM (SELECT n_nationkey, count(c_custkey) c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)")
def night_closure(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("c"))
    seconds = F.when(F.col("n_nationkey") % 4 != 0, F.col("c") * 10)
    return n.select("n_nationkey", G.eta(F.col("c"), F.col("n_nationkey") % 6).alias("nights"), G.closure(F.col("c"), 60, seconds, 550).alias("verdict"))


@query("SELECT p_partkey, CASE WHEN p_retailprice <= 0 THEN 0 WHEN p_retailprice <= b THEN b WHEN p_retailprice <= 2 * b THEN 2 * b WHEN p_retailprice <= 5 * b THEN 5 * b ELSE 10 * b END::DOUBLE AS budget FROM (SELECT p_partkey, p_retailprice, pow(10.0, floor(log10(p_retailprice))) b FROM part)")
def budget_steps(spark, sf):
    return table(spark, sf, "part").select("p_partkey", G.budget_step(F.col("p_retailprice")).alias("budget"))


@query("SELECT o_orderkey, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a = b THEN 'same' ELSE 'different' END WHEN x = y THEN 'same' ELSE 'unknown' END relation FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 5 END a, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 5 END b, lower(o_orderstatus) x, lower(left(o_orderpriority, 1)) y FROM orders)")
def compare_asserters(spark, sf):
    o = table(spark, sf, "orders")
    a, b = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey") % 5), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 5)
    return o.select("o_orderkey", G.asserters(a, F.col("o_orderstatus"), b, F.substring("o_orderpriority", 1, 1)).alias("relation"))


@query(
    f"SELECT doc_id, email, CASE WHEN lower(l) NOT IN ({', '.join(repr(x) for x in G.ROLES)}) AND len(w) >= 2 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^\\p{{L}}{{3,}}$'))) = 0 THEN array_to_string(list_transform(w, lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') END AS name, email bounced "
    f"FROM (SELECT doc_id, email, l, list_filter(string_split_regex(l, '[._-]'), lambda x: x <> '') w FROM (SELECT doc_id, email, split_part(email, '@', 1) l FROM (SELECT doc_id, unnest(e) email FROM ({_EMAILS}))))"
)
def display_names(spark, sf):
    mails = table(spark, sf, "documents").select("doc_id", F.explode(P.emails(F.col("text"))).alias("email"))
    return mails.select("doc_id", "email", G.display_name(F.col("email")).alias("name"), G.hard_bounce(F.concat("email", F.lit(" 5.1.1")), F.array("email")).alias("bounced"))


@query("SELECT doc_id, list_filter([CASE WHEN NOT coalesce(lang = 'en', false) THEN 'english' END, CASE WHEN NOT coalesce(n_chars > 1000, false) THEN 'long' END, CASE WHEN NOT coalesce(source = 'src0', false) THEN 'trusted' END], lambda x: x IS NOT NULL) unmet FROM documents")
def unmet_conditions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", G.unmet({"english": F.col("lang") == "en", "long": F.col("n_chars") > 1000, "trusted": F.col("source") == "src0"}).alias("unmet"))


@query("SELECT kind, count(*) n FROM (SELECT CASE WHEN lower(trim(source)) IN ('src0', 'src1') THEN lower(trim(source)) ELSE 'unsourced' END kind FROM documents) GROUP BY kind")
def source_kinds(spark, sf):
    return table(spark, sf, "documents").select(G.source_kind(F.col("source"), ("src0", "src1")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- compilation -------------------------------------------------------------------------------


@query(
    "WITH p AS (SELECT conv_id, turn, unnest(string_split_regex(coalesce(text, ''), '\\n+')) p, generate_subscripts(string_split_regex(coalesce(text, ''), '\\n+'), 1) i FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(trim(regexp_replace(p, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) ORDER BY turn, i) n FROM p WHERE trim(p) <> '') "
    "SELECT conv_id, md5(string_agg(p, chr(10) || chr(10) ORDER BY turn, i)) digest, count(*) paragraphs FROM k WHERE n = 1 GROUP BY conv_id"
)
def compiled_bodies(spark, sf):
    done = M.bodies(table(spark, sf, "conversations"), "conv_id", "turn", F.col("text"))
    return done.select("conv_id", F.md5(F.col("body").cast("binary")).alias("digest"), "paragraphs")


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_type, round_even(value, 0) v, (event_id % 9 + 1)::INT r, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) n, count(*) OVER (PARTITION BY user_id, event_type) m FROM events), "
    "f AS (SELECT user_id, event_type, m, 0::BIGINT n, NULL::DOUBLE v, 9 r, 0 applied FROM e WHERE n = 1 UNION ALL SELECT f.user_id, f.event_type, f.m, e.n, CASE WHEN t THEN e.v ELSE f.v END, CASE WHEN t THEN e.r ELSE f.r END, f.applied + (t AND f.v IS NOT NULL)::INT "
    "FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1, LATERAL (SELECT e.v IS DISTINCT FROM f.v AND e.r <= f.r t)) "
    "SELECT user_id::VARCHAR AS key, event_type field, round(v, 0)::BIGINT AS value, r AS rank, applied FROM f WHERE n = m"
)
def applied_corrections(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("field"), F.bround("value", 0).alias("value"), (F.col("event_id") % 9 + 1).alias("rank"), F.col("event_id").alias("line"))
    pages = e.groupBy("page", "field").agg(F.lit(None).cast("double").alias("value"), F.lit(9).alias("rank"))
    return M.corrections(e, pages, "page", "field", "value", "rank", "line").withColumn("value", F.col("value").cast("double").cast("long"))


@query("SELECT o_orderkey, l_partkey FROM (SELECT DISTINCT o_orderkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1) AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def retraction_cascade(spark, sf):
    o, parts = table(spark, sf, "orders"), table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    merged = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("sources"))  # an order has few lines
    merged = merged.join(o.select("o_orderkey"), "o_orderkey", "left_semi")
    return M.cascade(parts, merged, o.where("o_orderstatus = 'F'"), "l_partkey", "sources", "o_orderkey")


@query("SELECT o_orderkey, list(link ORDER BY i) links FROM (SELECT o_orderkey, link, min(i) i FROM (SELECT l_orderkey o_orderkey, CASE WHEN l_partkey % 3 = 0 THEN 'p' || (l_partkey // 2)::VARCHAR ELSE 'p' || l_partkey::VARCHAR END link, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) i FROM lineitem) GROUP BY ALL) GROUP BY o_orderkey")
def rewritten_links(spark, sf):
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("p"), x["l_partkey"].cast("string"))).alias("l"))
    old = table(spark, sf, "lineitem").where("l_partkey % 3 = 0").select(name(F.col("l_partkey")).alias("old"), name(F.floor(F.col("l_partkey") / 2)).alias("new")).distinct()
    return M.relinked(lines, "o_orderkey", F.col("l"), old, "old", "new")


@query("SELECT a.p_partkey, b.p_partkey pooled FROM part a JOIN part b ON a.p_partkey // 6 = b.p_partkey // 6 AND a.p_partkey % 3 = 0 AND b.p_partkey % 3 <> 0")
def pooled_ancestors(spark, sf):
    """Every third part stands below the scope that it shares with the others of its six."""
    six = F.concat(F.lit("s"), F.floor(F.col("p_partkey") / 6).cast("string"))
    scope = F.when(F.col("p_partkey") % 3 == 0, F.concat(six, F.lit("/x"))).otherwise(six)
    return M.pooled(table(spark, sf, "part").select("p_partkey", scope.alias("scope")), "p_partkey", "scope")


@query("SELECT 'questions' queue, event_id::VARCHAR AS key, strftime(ts, '%Y-%m-%d') created FROM events WHERE event_type = 'error' UNION ALL SELECT 'orders', o_orderkey::VARCHAR, '' FROM orders WHERE o_orderstatus = 'P'")
def pending_decisions(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("at"))
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("at"))
    return M.decisions({"questions": e, "orders": o}, "id", "at")


@query("SELECT 'text' field, count(text) populated, round(count(text) / count(*), 6)::DOUBLE ratio FROM documents UNION ALL SELECT 'source', count(CASE WHEN doc_id % 9 > 0 THEN source END), round(count(CASE WHEN doc_id % 9 > 0 THEN source END) / count(*), 6) FROM documents")
def field_coverage(spark, sf):
    d = table(spark, sf, "documents").withColumn("source", F.when(F.col("doc_id") % 9 > 0, F.col("source")))
    return M.coverage(d, ["text", "source"])


@query(
    "WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(replace(text, '_', ' ')), '[\\s\\p{Z}\\x1c-\\x1f\\x85]+')) w FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, sha256(w) x FROM t WHERE length(w) >= 2), "
    "s AS (SELECT doc_id, ('0x' || left(x, 8))::BIGINT % 384 p, sum(CASE WHEN ('0x' || substr(x, 9, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE v FROM h GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(v * v)) n FROM s GROUP BY 1) "
    "SELECT doc_id, p AS \"at\", round((v / n)::FLOAT::DOUBLE, 6) AS value FROM s JOIN n USING (doc_id) WHERE v <> 0 UNION ALL SELECT doc_id, 0, 1.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n WHERE n > 0)"
)
def hashed_embeddings(spark, sf):
    """Each text's vector: its places that are not 0."""
    bound_batches(spark)
    v = table(spark, sf, "documents").select("doc_id", M.hash_embedding()(F.col("text")).alias("v")).select("doc_id", F.posexplode("v").alias("at", "x"))
    return v.where("x <> 0").select("doc_id", F.col("at").cast("long").alias("at"), F.round(F.col("x").cast("double"), 6).alias("value"))


_ABBR = "|".join(a.replace(".", r"\.") for a in M.ABBREVIATIONS)
_SENTENCES = (
    "SELECT conv_id, turn, unnest(s) line, generate_subscripts(s, 1) i, len(s) n FROM (SELECT conv_id, turn, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), "
    f"'(^|\\s)((?i:{_ABBR}))(\\s*)([.!?]+)', '\\1\\2\\3\\4' || chr(57345), 'g'), '[.!?]+\\s+([\\p{{Lu}}\\p{{Nd}}])', chr(57344) || '\\1', 'g'), chr(57344)) s FROM conversations)"
)


@query(f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS \"at\", sentence FROM (SELECT conv_id, turn, i, trim(CASE WHEN i = n THEN regexp_replace(replace(line, chr(57345), ''), '[.!?]+\\s*$', '') ELSE replace(line, chr(57345), '') END, ' ' || chr(9) || chr(10) || chr(13)) sentence FROM ({_SENTENCES})) WHERE sentence <> ''")
def sentence_claims(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.posexplode(M.sentences(F.col("text"))).alias("at", "sentence")).withColumn("at", F.col("at").cast("long"))


# --- staleness ---------------------------------------------------------------------------------


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN 'earlier' WHEN p_brand = (SELECT min(p_brand) FROM part) AND p_size % 2 = 0 THEN 'content-hash' WHEN p_size % 5 = 0 THEN 'dimension-named' WHEN p_size % 11 = 0 THEN 'coordinate-challenged' WHEN p_size < 10 AND p_partkey % 2 = 0 THEN 'tree-epoch' WHEN p_partkey % 13 = 0 THEN 'authority-revoked' WHEN p_partkey % 17 > 8 AND p_size % 3 > 0 THEN 'comparator-epoch' END stale FROM part"
)
def stale_verdicts(spark, sf):
    p = table(spark, sf, "part")
    least = p.agg(F.min("p_brand").alias("least"))  # one row
    p = p.join(F.broadcast(least))
    e = p.select("p_partkey", F.when(F.col("p_partkey") % 10 == 3, "earlier").alias("stale"), "p_size", "p_brand", "least",
        F.array(F.when(F.col("p_brand") == F.col("least"), "page").otherwise("other"), F.lit("b")).alias("sides"),
        F.array(F.when(F.col("p_size") % 2 == 0, "old").otherwise("new"), F.lit("h")).alias("hashes"),
        F.array(F.when(F.col("p_size") % 5 == 0, "scope").otherwise("none")).alias("assumed"),
        F.create_map(F.lit("subject"), F.when(F.col("p_size") % 11 == 0, "ans-1").otherwise("ans-2")).alias("origins"),
        F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(2).alias("epoch"), F.array(F.when(F.col("p_size") < 10, "org/a/x").otherwise("org/b"), F.lit(None).cast("string")).alias("coords"),
        F.when(F.col("p_partkey") % 13 == 0, "grant-1").otherwise("grant-2").alias("basis"),
        F.when(F.col("p_partkey") % 17 > 8, F.when(F.col("p_size") % 3 > 0, "v1.gate2.a").otherwise("v1.gate2.b")).otherwise("v1.gate1").alias("version"))
    reasons = [V.changed_page("page", F.col("sides"), F.col("hashes"), "new"), V.dimension_change("scope", F.col("assumed"), F.array().cast("array<string>"), F.col("sides"), ["nobody"]), V.challenged("ans-1", F.col("origins")), V.tree_epoch(F.col("epoch"), 2, F.col("coords"), ["org/a"]), V.authority(F.col("basis"), "grant-1"), V.comparator(F.col("version"), "v1.gate2", "v1.gate2.b")]
    return V.mark(e, reasons).select("p_partkey", "stale")
