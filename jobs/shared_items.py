"""Texts that arrive in files: which words each group uses, and how much of them the groups of a set share.

    python -m jobs.shared_items jobs/shared_items.json input=/data/documents out=/data/shared checkpoint=/data/shared-checkpoint

A file stream takes the files that have come since the last run (availableNow), keeps each (set, group, word) once in
its state, and appends what is new to the items table: Spark's own checkpoint and file log make a file count once,
however often the job is run or broken off. Then the percentage of shared items of all group pairs, the bins by
complete linkage and the totals are made anew for the sets that have grown, and for no other: a set has grown if
its items are more than its totals say. Reports are text, one folder for each report and set, and only folders of
sets that have grown are replaced. Totals are written last, so a run that broke off before is made up for by the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import LOG, checked, existing, main
from kinfold.operators import iterative, relational
from kinfold.sinks.screen_reports import write_lines

REQUIRED = {"input": str, "out": str, "checkpoint": str}
OPTIONAL = {
    "format": "parquet",
    #: The columns of the input that are read, and expressions for the set, the group and the text of a row.
    "schema": "text string, lang string, source string",
    "set": "lang", "group": "source", "text": "text",
    #: An item, and the limit of shared items at which bins merge.
    "item": r"\p{L}+", "min_shared": 50.0, "files_per_batch": 1000,
}
ITEMS = "grp string, item string, set_id string"
TOTALS = "grp string, total long, set_id string"


def arrived(spark: SparkSession, c: dict) -> DataFrame:
    """(set_id, grp, item) of the stream, each once. Null sets, groups and texts have none."""
    rows = spark.readStream.format(c["format"]).schema(c["schema"]).option("maxFilesPerTrigger", c["files_per_batch"]).load(c["input"])
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.expr(c["text"])), F.lit(c["item"]), F.lit(0)))
    rows = rows.select(F.expr(c["set"]).cast("string").alias("set_id"), F.expr(c["group"]).cast("string").alias("grp"), F.explode(found).alias("item"))
    return rows.where("set_id is not null and grp is not null").dropDuplicates(["set_id", "grp", "item"])


def hundredths(part: Column, whole: Column) -> Column:
    """part / whole in per cent at two decimals, halves up, by whole numbers."""
    h = F.floor((part * 20000 + whole) / (whole * 2))
    return F.concat(F.floor(h / 100).cast("string"), F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"))


def shared_lines(items: DataFrame, min_shared: float) -> tuple[DataFrame, DataFrame]:
    """(the lines of pocp_matrix, pocp_bins and genome_totals of every set, and the totals)."""
    matrix = relational.pocp_of_shared(items)
    names = matrix.where("ga = gb").select("set_id", F.col("ga").alias("grp"), (F.col("items") / 2).cast("long").alias("total"))
    place = Window.partitionBy("set_id").orderBy("grp")
    totals = names.withColumn("at", (F.row_number().over(place) - 1).cast("int"))
    line = lambda df, report, no, *cells: df.select("set_id", F.lit(report).alias("report"), no.cast("int").alias("no"), F.concat_ws("\t", *cells).alias("line"))
    sets = totals.groupBy("set_id").agg(F.array_join(F.array_sort(F.collect_list("grp")), "\t").alias("names"))

    cell = F.struct("gb", hundredths(F.col("conserved"), F.col("items")).alias("v"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["v"]), "\t")
    rows = matrix.groupBy("set_id", F.col("ga").alias("grp")).agg(joined.alias("cells")).join(totals, ["set_id", "grp"])
    lines = line(rows, "pocp_matrix", F.col("at") + 1, "grp", "cells")
    lines = lines.unionByName(line(sets, "pocp_matrix", F.lit(0), F.lit("genome"), F.col("names")))
    lines = lines.unionByName(line(totals, "genome_totals", F.col("at") + 1, F.col("at"), F.col("grp"), F.col("total")))
    lines = lines.unionByName(line(sets, "genome_totals", F.lit(0), F.lit("genome_index"), F.lit("genome"), F.lit("proteins_counted")))

    # Clustering goes by numbers: sets get theirs from their names, groups from their place.
    key = F.xxhash64("set_id").alias("key")
    at = lambda side, to: totals.select("set_id", F.col("grp").alias(side), F.col("at").alias(to))
    numbers = matrix.join(at("ga", "a"), ["set_id", "ga"]).join(at("gb", "b"), ["set_id", "gb"]).select(key, F.col("a").alias("ga"), F.col("b").alias("gb"), F.col("pocp").alias("aai"))
    bins = iterative.bins(numbers.withColumnRenamed("key", "set_id"), [min_shared]).withColumnsRenamed({"set_id": "key", "grp": "at"})
    members = bins.join(totals.select(key, "set_id", "at", "grp"), ["key", "at"]).groupBy("set_id", "bin").agg(F.array_sort(F.collect_list("grp")).alias("m"))
    lines = lines.unionByName(line(members, "pocp_bins", F.col("bin"), F.col("bin"), F.size("m"), F.array_join("m", " ")))
    lines = lines.unionByName(line(sets, "pocp_bins", F.lit(0), F.lit("bin"), F.lit("genomes"), F.lit("members")))
    return lines, totals.select("grp", "total", "set_id")


def run(spark: SparkSession, config: dict) -> dict:
    """Take what has arrived and renew the sets that have grown; returns what was read and written."""
    c = checked(config, REQUIRED, OPTIONAL)
    table = f"{c['out']}/items"
    stream = arrived(spark, c).writeStream.format("parquet").partitionBy("set_id").option("path", table)
    query = stream.option("checkpointLocation", c["checkpoint"]).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(int(p["numInputRows"]) for p in query.recentProgress)
    LOG.info("rows that have come: %d", read)

    items = existing(spark, table, ITEMS)
    # Totals are written one folder a run and a set's last ones count; the file log is Spark's.
    known = existing(spark, f"{c['out']}/totals", TOTALS).groupBy("set_id").agg(F.sum("total").alias("known"))
    grown = items.groupBy("set_id").agg(F.count("*").alias("n")).join(known, "set_id", "left").where("known is null or known < n")
    names = [r.set_id for r in grown.select("set_id").collect()]  # names of sets, folders of the output
    LOG.info("sets that have grown: %s", ", ".join(names) or "none")
    report = {"rows_read": read, "sets_done": len(names), "lines_written": 0}
    if names:
        lines, totals = shared_lines(items.where(F.col("set_id").isin(names)), c["min_shared"])
        write_lines(lines, f"{c['out']}/reports")
        totals.repartition("set_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_id").parquet(f"{c['out']}/totals")
        report["lines_written"] = spark.read.text(f"{c['out']}/reports").where(F.col("set_id").isin(names)).count()
        LOG.info("wrote %d lines of %d sets", report["lines_written"], len(names))
    return report


if __name__ == "__main__":
    main(run, "shared-items")
