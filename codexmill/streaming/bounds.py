"""Violation counts as keyed streaming state: how often in a row each key broke a bound with the
same content. State lives in the checkpoint, so a run that starts anew goes on counting.

A violation whose content differs from that of the last one starts at one; a row without a
violation clears the key. A row is given out at the violation that reaches the threshold, once for
a count; what the caller then puts aside, it clears with such a row.

Defined results: rows of a null key are ignored; rows of one batch count in the order of `seq`, and
batches in theirs; null content is a content of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

_STATE = StructType([StructField("content", StringType()), StructField("violations", LongType()), StructField("first_seq", LongType())])
OUT = "key string, content string, violations long, first_seq long, last_seq long, crossed boolean"


class _Counts(StatefulProcessor):
    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("count", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        content, n, first = held if held is not None else (None, 0, 0)
        n, last, crossed = n or 0, None, False
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, own, bad in zip(frame["seq"].tolist(), frame["content"].tolist(), frame["violated"].tolist()):
            own = own if isinstance(own, str) else None
            if not bad:
                n = 0
            elif n and own == content:
                n += 1
            else:
                content, n, first = own, 1, seq
            crossed |= bool(bad) and n == self.threshold
            last = seq
        if n:
            self.state.update((content, int(n), int(first)))
        elif held is not None:
            self.state.clear()
        yield pd.DataFrame({"key": [key[0]], "content": [content if n else None], "violations": [n], "first_seq": [first if n else None], "last_seq": [last], "crossed": [crossed]})

    def close(self) -> None:
        pass


def counted(stream: DataFrame, threshold: int) -> DataFrame:
    """A stream of (key, seq, content, violated) as one row per key and batch: its count after the
    batch (0: cleared), and whether the batch reached the threshold."""
    rows = stream.where("key is not null").select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("content").cast("string").alias("content"), F.coalesce("violated", F.lit(False)).alias("violated"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Counts(threshold), outputStructType=OUT, outputMode="Update", timeMode="None")


def run(spark, source: str, schema: str, checkpoint: str, sink: str, threshold: int, most_files: int | None = None) -> None:
    """Count all new files below `source` and add their rows, with their batch, to `sink`. A batch
    that is repeated writes its own folder anew."""
    reader = spark.readStream.schema(schema)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        put = lambda df, number: df.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        query = counted(reader.parquet(source), threshold).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def latest(spark, sink: str) -> DataFrame:
    """(key, content, violations, first_seq, crossed) of keys with an open count; `crossed` if any
    batch so far reached the threshold."""
    rows = spark.read.parquet(sink)
    now = rows.groupBy("key").agg(F.max_by(F.struct("content", "violations", "first_seq"), "batch").alias("s"), F.max("crossed").alias("crossed"))
    return now.select("key", "s.content", "s.violations", "s.first_seq", "crossed").where("violations > 0")


def folded(rows: DataFrame, threshold: int) -> DataFrame:
    """The same of a whole ledger at once."""
    by = Window.partitionBy("key").orderBy("seq")
    rows = rows.where("key is not null").withColumn("violated", F.coalesce("violated", F.lit(False)))
    turned: Column = ~F.coalesce(F.lag("violated").over(by), F.lit(False)) | ~F.lag("content").over(by).eqNullSafe(F.col("content"))
    stretch = F.sum(F.when(~F.col("violated") | turned, 1).otherwise(0)).over(by)
    each = rows.withColumn("stretch", stretch).groupBy("key", "stretch").agg(F.first("content").alias("content"), F.min("seq").alias("first_seq"), F.count_if("violated").alias("violations"))
    last = each.groupBy("key").agg(F.max_by(F.struct("content", "violations", "first_seq"), "stretch").alias("s"), F.max(F.col("violations") >= threshold).alias("crossed"))
    return last.select(F.col("key").cast("string").alias("key"), "s.content", "s.violations", "s.first_seq", "crossed").where("violations > 0")
