"""Writers: tables, matrices, FASTA, upserts. Null is written 'NA' here and nowhere else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small report as one tab-separated file with a header."""
    rows = df.select(*[F.concat_ws(" ", c).alias(c) if t.startswith("array<string") else F.col(c).cast("string").alias(c) for c, t in df.dtypes])
    rows.coalesce(1).write.mode(mode).option("sep", "\t").option("header", True).option("nullValue", "NA").option("emptyValue", "").csv(path)


def as_matrix(cells: DataFrame, labels: list, row: str = "ga", col: str = "gb", value: Column | None = None) -> DataFrame:
    """One row a label, one text column a label; missing cells 'NA'."""
    v = value if value is not None else F.when(F.col("aai").isNotNull(), F.format_string("%.2f", F.col("aai")))
    wide = cells.groupBy(F.col(row).alias("genome")).pivot(col, labels).agg(F.first(v))
    return wide.select("genome", *[F.coalesce(F.col(f"`{c}`"), F.lit("NA")).alias(str(c)) for c in labels])


def as_presence(presence: DataFrame, labels: list) -> DataFrame:
    """One row a group, one 0/1 column an item."""
    wide = presence.groupBy(F.col("grp").alias("genome")).pivot("ref_item", labels).agg(F.max("present"))
    return wide.select("genome", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"group{k}") for k, c in enumerate(labels)])


def fasta_text(df: DataFrame, header: Column, sequence: str = "sequence") -> DataFrame:
    return df.select(F.concat(F.lit(">"), header, F.lit("\n"), F.col(sequence)).alias("value"))


def write_fasta(df: DataFrame, path: str, header: Column, order: list, sequence: str = "sequence", mode: str = "errorifexists") -> None:
    """Records in order within each part file."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fasta_text(rows, header, sequence).write.mode(mode).text(path)


def write_parts(df: DataFrame, path: str, by: str, order: list, line: Column, mode: str = "errorifexists") -> None:
    """One folder a value of ``by``, lines in order: id lists, core tables, one FASTA a group."""
    rows = df.withColumn("_line", line).repartition(by).sortWithinPartitions(by, *order)
    rows.select(by, F.col("_line").alias("value")).write.mode(mode).partitionBy(by).text(path)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: str) -> None:
    """Replace the rows of ``new``'s keys in a Parquet table: written beside it, then moved into its place."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    side, old = (jvm.org.apache.hadoop.fs.Path(f"{path}.{x}") for x in ("new", "old"))
    if fs.exists(at):
        kept = spark.read.parquet(path).join(new.select(key).distinct(), key, "left_anti")
        rows = kept.unionByName(new.select(*kept.columns))
    else:
        rows = new
    rows.write.mode("overwrite").parquet(side.toString())
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(side, at)
    fs.delete(old, True)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("sep", "\t").csv(path)


def summary(n_groups: int, n_items: int, anchor: str, core: int, rows: list[dict]) -> str:
    """The human-readable report of one set from its small tables."""
    out = [f"groups: {n_groups:,}", f"items: {n_items:,}", f"anchor: {anchor}", f"core: {core:,}", ""]
    for r in rows:
        out.append(f"{str(r['grp'])[:28]:<28} {'-' if r['nearest'] is None else r['nearest']!s:<28} {'NA' if r['aai'] is None else format(r['aai'], '.2f'):>7}  {r['verdict']}")
    return "\n".join(out) + "\n"
