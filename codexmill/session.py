"""A session with the settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "codexmill", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold no more than 4 MB, whatever the length of their rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly where their scan has fewer splits than the cluster has cores, as a small
    table of few row groups does; a large table has more and is left where it lies."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
