"""Fixtures that both engines read alike: column expressions over a supplied table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codexmill.session import table


def frame(spark: SparkSession, sf: str, name: str, exprs: dict[str, str], where: str = "true") -> DataFrame:
    return table(spark, sf, name).where(where).selectExpr(*[f"{e} AS {c}" for c, e in exprs.items()])


def sub(name: str, exprs: dict[str, str], where: str = "true") -> str:
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in exprs.items())} FROM {name} WHERE {where})"
