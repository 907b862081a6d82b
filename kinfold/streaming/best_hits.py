"""Best hits of hits that arrive in files: Spark's streaming aggregate keeps them, and what changes is appended.

The state holds one row for each item and other group, whatever the number of hits. Each batch appends the rows of the
items and groups that had hits in it, with its number; the last of an item and group is the best hit so far, and after
any order of arrival it is the batch answer. A batch that is run again after a failure replaces its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["set_id", "q", "gq", "gs"]


def best_so_far(stream: DataFrame) -> DataFrame:
    """(set_id, q, gq, gs, s, pident, score): the highest score above 0, of equal ones the lower item. A streaming or a batch frame."""
    first = F.max(F.struct("score", (-F.col("s")).alias("s"), "pident")).alias("b")
    return stream.where("gq <> gs and score > 0").groupBy(*KEY).agg(first).select(*KEY, (-F.col("b.s")).alias("s"), "b.pident", "b.score")


def follow(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what each batch has brought to ``table``, one folder a batch, until the input that is there is exhausted."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return best_so_far(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The best hits so far: of each item and other group the last row."""
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("batch")))
    return spark.read.parquet(table).withColumn("_n", last).where("_n = 1").drop("_n", "batch")
