"""A survey's only incremental parts: hits that arrive in files, and the status of each set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.operators.relational import upsert

#: pending -> fetching -> running -> done | failed
STATES = ("pending", "fetching", "running", "done", "failed")


def todo(status: DataFrame, retry_failed: bool = False, only: list[str] | None = None) -> DataFrame:
    """Sets to work on, smallest first: stale ones (fetching, running) again, done never, failed only if asked for."""
    left = status.where(~F.col("state").isin("done", *(() if retry_failed else ("failed",))))
    if only:
        left = left.where(F.col("genus").isin(only))
    return left.orderBy("n_species", "genus")


def advance(status: DataFrame, genus: str, state: str, now: Column) -> DataFrame:
    """The status table with one set moved on; an attempt is counted when it starts."""
    if state not in STATES:
        raise ValueError(state)
    begins = F.lit(1 if state == "fetching" else 0)
    row = status.where(F.col("genus") == genus).select(
        "genus", "n_species", F.lit(state).alias("state"), (F.coalesce("attempts", F.lit(0)) + begins).cast("int").alias("attempts"),
        F.when(begins == 1, now).otherwise(F.col("started_utc")).alias("started_utc"), now.alias("updated_utc"), "wall_seconds", "note",
    )
    return upsert(status, row, "genus")


def hits_stream(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(directory)


def collect_hits(stream: DataFrame, table: str, checkpoint: str, keep: Column) -> StreamingQuery:
    """Append arriving hits that pass ``keep``, once each, partitioned by set; runs until the input is exhausted."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.where(keep).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "set_id").parquet(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
