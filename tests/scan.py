"""BM25 by a scan of all pages, which the stored index is held against."""

from functools import reduce

from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators.retrieval import STOPWORDS


def _matches(words: str, term: str):
    return F.size(F.filter(words, lambda w: w == term))


def bm25(pages, key: str, body, query: str, k: int, where=None, k1: float = 1.2, b: float = 0.75):
    """BM25 over up to eight query words of three letters or more, joined by OR. Words and text
    lengths are counted over all pages, the filter holds before the ranking.

    Only query words leave the scan: a row's counts are an array as long as the query."""
    terms = T.query_tokens(query, least=3, most=8, stopwords=STOPWORDS)
    terms = list(dict.fromkeys(terms))
    if not terms:
        return pages.select(key, F.lit(0.0).alias("score")).limit(0)
    words = F.regexp_extract_all(F.lower(F.coalesce(body, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    seen = pages.withColumn("_w", words).withColumn("_len", F.size("_w"))
    seen = seen.select("*", *[_matches("_w", t).alias(f"_t{i}") for i, t in enumerate(terms)]).drop("_w")
    stats = seen.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(terms))])
    rows = seen.where(where) if where is not None else seen
    part = lambda i: F.when(F.col(f"_t{i}") > 0, F.log(1 + (F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)) * F.col(f"_t{i}") * (k1 + 1) / (F.col(f"_t{i}") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))).otherwise(0.0)
    score = F.round(reduce(lambda x, y: x + y, [part(i) for i in range(len(terms))]), 6)
    found = rows.crossJoin(F.broadcast(stats)).select(key, score.alias("score"))  # one row of statistics
    return found.where("score > 0").orderBy(F.desc("score"), key).limit(k)
