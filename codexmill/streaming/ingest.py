"""Incremental ingestion with Structured Streaming: the checkpoint is the manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], most_files: int | None = None) -> StreamingQuery:
    """Hand all new files to `handle` in micro-batches, then stop. An empty batch is not handed on."""
    reader = spark.readStream.schema(schema)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)

    def gated(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            handle(batch, number)

    return reader.parquet(source).writeStream.foreachBatch(gated).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(events: DataFrame, ts: str, length: str, late: str, keys: list[str]) -> DataFrame:
    """Counts per window and key; rows later than `late` after the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    """Sessions of a key, closed by a gap; works on batches and streams."""
    return events.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


def temporal_class(observed, recorded, days: int = 730):
    """future, backdated or ok. Late rows are flagged, never dropped."""
    gap = F.date_diff(recorded, observed)
    return F.when(observed.isNull() | recorded.isNull(), "ok").when(gap < 0, "future").when(gap > days, "backdated").otherwise("ok")
