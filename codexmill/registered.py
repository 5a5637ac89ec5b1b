"""Where queries register with their DuckDB SQL (None where SQL can't say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        ALL[f.__name__] = (f, sql)
        return f

    return put
