"""A global order in native Spark: row numbers and prefix sums over all rows without a
single-partition window.

Rows are range-partitioned on the sort keys and written with their partition's number; totals
per partition (a row each) are prefix-summed; a window inside each partition adds the rest.
Only narrow rows pass through it: callers leave texts out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def with_prefix(rows: DataFrame, keys: list[str], size: str, row: str = "row_index", before: str = "size_before") -> DataFrame:
    """Add the 0-based row number (`row`) and the sum of `size` over all earlier rows (`before`)
    in the order of `keys` (ties among wholly equal keys are interchangeable)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # several ranges for each later task, so that hashing range numbers to tasks stays even
    ranged = rows.repartitionByRange(8 * parts, *keys).withColumn("_range", F.spark_partition_id())
    ranged = common.written(ranged, "ranged")
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_s"))
    # a row for each range: the window over them is as small as the number of partitions
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"))
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ranged.withColumn("_k", F.count(F.lit(1)).over(inside)).withColumn("_c", F.sum(size).over(inside))
    return (
        counted.join(F.broadcast(offsets), "_range")
        .withColumn(row, F.col("_n0") + F.col("_k") - 1)
        .withColumn(before, F.col("_s0") + F.col("_c") - F.col(size))
        .drop("_range", "_n0", "_s0", "_k", "_c")
    )


def unit(text: Column) -> Column:
    """A number in [0, 1) from 32 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
