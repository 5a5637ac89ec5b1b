"""Ranked and typed retrieval. Filters stand below the ranking, so a row that the caller may not
see never takes a place among the k."""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions import text as T

# Words that a lexical query leaves out.
STOPWORDS = frozenset(
    "the and for are but not you all can had her was one our out has his how its let may new now old see way who did get got him she too use with from "
    "have this that they will been call come each find give help here just know like long look make many more most much must next only over said same some "
    "such take tell than them then very want well went were what when which while work also back been being both came does done down even goes going "
    "good keep last left life line made need never part place point right show small still think those turn used using where would about after again "
    "could every great might often other shall should since start state there these thing three through under until world years your into time year "
    "really looking trying running check please sure okay yeah thanks".split()
)


def keyword_search(pages: DataFrame, key: str, head: Column, body: Column, query: str, k: int, where: Column | None = None) -> DataFrame:
    """Three points for each occurrence of a query word in the head, one for each in the body;
    rows above 0, best first, ties by key."""
    tokens = T.query_tokens(query)
    pages = pages.where(where) if where is not None else pages
    if not tokens:
        return pages.select(key, F.lit(0.0).alias("score")).limit(0)
    h, b = F.lower(F.coalesce(head, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    score = reduce(lambda x, y: x + y, [T.occurrences(h, t) * 3.0 + T.occurrences(b, t) * 1.0 for t in tokens])
    return pages.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest rows to one vector by squared Euclidean distance, ties by key. The query is
    a literal, so this is one scan and a top-k."""
    rows = vectors.where(where) if where is not None else vectors
    q = F.array(*[F.lit(float(x)) for x in query])
    gap = F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select(key, F.round(gap, 6).alias("distance")).orderBy("distance", key).limit(k)


def degenerate(hits: DataFrame, distance: str = "distance") -> DataFrame:
    """Whether two or more hits all have one distance: an index that can't tell rows apart."""
    return hits.agg(F.count(F.lit(1)).alias("hits"), F.count_distinct(F.round(distance, 6)).alias("kinds")).select("hits", ((F.col("hits") >= 2) & (F.col("kinds") == 1)).alias("degenerate"))


def hybrid(lexical: DataFrame, vector: DataFrame, key: str, each: int = 3, most: int = 3) -> DataFrame:
    """The first lexical hits, then the first vector hits, each key once, `most` in all. Both
    inputs are top-k results (key, rank)."""
    both = lexical.where(F.col("rank") <= each).select(key, F.lit(0).alias("arm"), "rank").unionByName(vector.where(F.col("rank") <= each).select(key, F.lit(1).alias("arm"), "rank"))
    once = both.groupBy(key).agg(F.min(F.struct("arm", "rank")).alias("place")).select(key, "place.*")
    order = Window.orderBy("arm", "rank")  # at most 2 * each rows
    return once.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select(key, "arm", "position")


def ranked(hits: DataFrame, order: list[Column]) -> DataFrame:
    """Number a top-k result."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def by_currency(hits: DataFrame, expired: Column, rank: str = "rank") -> DataFrame:
    """Hits with expired ones last, else in their order."""
    return hits.withColumn("position", F.row_number().over(Window.orderBy(expired.cast("int"), rank)))


def predicate(fields: list[Column], kind: str, needle: str, negate: bool = False) -> Column:
    """Any field equal to, holding or matching the needle, without regard to case; negation
    is of the whole."""
    tests = {"eq": lambda f: F.lower(f) == needle.lower(), "substring": lambda f: F.contains(F.lower(f), F.lit(needle.lower())), "regex": lambda f: f.rlike(f"(?i){needle}")}
    hit = reduce(lambda a, b: a | b, [F.coalesce(tests[kind](f.cast("string")), F.lit(False)) for f in fields])
    return ~hit if negate else hit


def sort_key(value: Column) -> Column:
    """Numbers sort above text: (is number, number, lower-case text)."""
    number = value.cast("string").try_cast("double")
    return F.struct(number.isNotNull().cast("int").alias("is_number"), F.coalesce(number, F.lit(0.0)).alias("number"), F.when(number.isNull(), F.lower(value.cast("string"))).otherwise("").alias("text"))


def enumerate_rows(rows: DataFrame, key: str, value: Column, where: Column, limit: int = 0, descending: bool = True, after: str | None = None) -> DataFrame:
    """Rows that satisfy a predicate in the order of a typed sort key, ties by key ascending;
    `after` is the cursor of the last row of the page before; a limit of 0 is none."""
    out = rows.where(F.col(key).isNotNull() & where).withColumn("_k", sort_key(value))
    if after:
        at = json.loads(base64.urlsafe_b64decode(after))
        mark = F.struct(F.lit(at[0]).alias("is_number"), F.lit(float(at[1])).alias("number"), F.lit(at[2]).alias("text"))
        beyond = F.col("_k") < mark if descending else F.col("_k") > mark
        out = out.where(beyond | ((F.col("_k") == mark) & (F.col(key).cast("string") > F.lit(at[3]))))
    out = out.orderBy(F.desc("_k") if descending else F.asc("_k"), F.col(key).cast("string"))
    return (out.limit(limit) if limit else out).drop("_k")


def cursor(is_number: int, number: float, text: str, key: object) -> str:
    return base64.urlsafe_b64encode(json.dumps([is_number, number, text, str(key)]).encode()).decode()


def class_registry(rows: DataFrame, kind: str, declared: list[str]) -> DataFrame:
    """(type, n, declared, observed): declared and observed types, counted."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(d,) for d in declared], f"{kind} string").withColumn("_declared", F.lit(True))
    seen = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    both = seen.join(F.broadcast(names), kind, "full_outer")
    return both.select(F.col(kind).alias("type"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_declared", F.lit(False)).alias("declared"), F.col("n").isNotNull().alias("observed"))
