"""References: which of the items that a session was pushed its transcript names.

All items of a session are looked for in one pass over each of its turns (Aho-Corasick). Turns
meet the items of their own session only; sessions are dealt by session and spread over the turns'
own split, so a long transcript is many rows, never one. Items are distinct per session first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=512)
def _automaton(items: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for item in items:
        out.add_word(item, item)
    out.make_automaton()
    return out


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, found = [], []
        for row, (text, items) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            seen = {item for _, item in _automaton(tuple(items)).iter(text)} if text and items else ()
            at += [row] * len(seen)
            found += sorted(seen)
        yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["session", "item"])


def named(pushes: DataFrame, turns: DataFrame, session: str, item: str, body: str) -> DataFrame:
    """(session, item): pushed items that occur anywhere in any turn of their session, each once.
    Null or empty items and null turns name nothing; other columns are ignored."""
    kind = turns.schema[session].dataType.simpleString()
    lists = pushes.where(F.col(item).isNotNull() & (F.col(item) != "")).groupBy(session).agg(F.array_sort(F.collect_set(item)).alias("_items"))
    both = turns.select(session, body).join(lists, session).select(F.col(session).alias("session"), body, "_items")
    return both.mapInArrow(_named, f"session {kind}, item string").distinct().withColumnsRenamed({"session": session, "item": item})


def references(pushes: DataFrame, turns: DataFrame, session: str, item: str, body: str) -> DataFrame:
    """(session, pushed, referenced) of sessions with pushes and a transcript; a session that lacks
    either can't be determined and gives no row."""
    items = pushes.where(F.col(item).isNotNull() & (F.col(item) != "")).select(session, item).distinct()
    pushed = items.groupBy(session).agg(F.count(F.lit(1)).alias("pushed")).join(turns.select(session).distinct(), session, "left_semi")
    hits = named(pushes, turns, session, item, body).groupBy(session).agg(F.count(F.lit(1)).alias("referenced"))
    return pushed.join(hits, session, "left").select(session, "pushed", F.coalesce("referenced", F.lit(0)).cast("long").alias("referenced"))
