"""Composed plans: the recall query and the compile run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators import lexical as X
from codexmill.operators import retrieval as R


def recall(index: X.Index, pages: DataFrame, body: str, query: str, k: int, allowed: Column, expired: Column, **ranking) -> DataFrame:
    """Ranked recall from a stored index: access before the ranking, expired pages last, a snippet
    of each hit. Only the hits' rows of `pages` are read for more than their key."""
    key = index.key
    hits = X.search(pages.sparkSession, index, query, k, allowed, **ranking)
    rows = pages.select(key, body, expired.alias("_expired")).join(F.broadcast(R.ranked(hits, [F.desc("score"), F.col(key)])), key)  # k rows
    placed = R.by_currency(rows, F.col("_expired"))
    return placed.select(key, "score", "position", T.snippet(F.col(body), T.query_tokens(query, 3), 120).alias("snippet"))
