"""Global row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows in the given total order, numbered from 1 in ``name``.

    Rows are range-partitioned and sorted; ``monotonically_increasing_id`` then holds each
    row's partition and place. Counting rows by partition gives the offsets, one row a partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_row"))
    sizes = placed.groupBy("_part").agg((F.max("_row") + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # One row a partition: a bounded size.
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_row") + 1).drop("_at", "_part", "_row", "_offset")
