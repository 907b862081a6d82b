"""FASTA directories as DataFrames, and a ``fasta`` data source for ``spark.read``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinfold.functions.scalars import FASTA_SUFFIXES, is_fasta, stem


def parse(lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    """(name, description, sequence): blank lines and what precedes the first header are skipped."""
    head, parts = None, []
    for line in lines:
        line = line.rstrip("\r\n").strip()
        if line.startswith(">"):
            if head is not None:
                yield head + ("".join(parts),)
            name, _, rest = line[1:].strip().partition(" ")
            words = line[1:].split(None, 1)
            head, parts = (words[0] if words else name, words[1] if len(words) > 1 else rest.strip()), []
        elif line and head is not None:
            parts.append(line)
    if head is not None:
        yield head + ("".join(parts),)


def read_records(spark: SparkSession, directory: str, sets: bool = False, only: list[str] | None = None) -> DataFrame:
    """(file, position, name, description, sequence) of every FASTA file of a directory; empty sequences go.

    Records are split by Spark's text reader at '\\n>', so large files are read in parallel. With ``sets`` each folder of the
    directory is a set of files, and ``file`` is "<folder>/<file>". ``only`` names the files (or with ``sets`` the folders) to read:
    Spark then opens no other.
    """
    at = directory.rstrip("/")
    paths = directory if only is None and not sets else [f"{at}/{x}/*" if sets else f"{at}/{x}" for x in (["*"] if only is None else only)]
    t = spark.read.option("lineSep", "\n>").text(paths)
    part = F.split(F.col("_metadata.file_path"), "/")
    t = t.select(
        (F.concat_ws("/", F.element_at(part, -2), F.element_at(part, -1)) if sets else F.element_at(part, -1)).alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"),
        F.regexp_replace("value", "\r", "").alias("value"),
    )
    # Only a file's first record keeps its '>'; a first record without one is what precedes the first header.
    t = t.where(is_fasta(F.col("file")))
    first = F.row_number().over(Window.partitionBy("file").orderBy("start", "n")) == 1
    t = t.withColumn("first", first)
    lead = F.regexp_extract("value", r"(?s)^(?:[^>]*?\n)??>(.*)$", 1)
    t = t.withColumn("body", F.when(F.col("first"), F.when(F.ltrim("value").startswith(">"), F.substr(F.ltrim("value"), F.lit(2))).otherwise(F.nullif(lead, F.lit("")))).otherwise(F.col("value")))
    head = F.trim(F.split_part(F.col("body"), F.lit("\n"), F.lit(1)))
    rest = F.when(F.instr("body", "\n") > 0, F.regexp_replace(F.expr("substr(body, instr(body, '\n') + 1)"), r"\s", "")).otherwise("")
    words = F.split(head, r"\s+", 2)
    return (
        t.where(F.col("body").isNotNull())
        .select("file", "start", "n", words[0].alias("name"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("description"), rest.alias("sequence"))
        .where(F.length("sequence") > 0)
        .withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("start", "n")) - 1)
        .drop("start", "n")
    )


def lookup(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records that ``wanted`` (file, name) names; of equal names in a file the first."""
    first = F.row_number().over(Window.partitionBy("file", "name").orderBy("position"))
    found = records.join(wanted.select("file", "name").distinct(), ["file", "name"], "left_semi")
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def load_items(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, groups) with dense ids: groups by sorted file name, items by group and position.

    items: item, grp, name, description, sequence; groups: grp, name, n_items, first, stop.
    Fails on fewer than two groups or on two files of one stem.
    """
    files = records.groupBy("file").agg(F.count("*").alias("n_items"))
    # One row a file.
    order = Window.orderBy("file")
    groups = files.select("file", stem(F.col("file")).alias("name"), "n_items").withColumn("grp", F.row_number().over(order) - 1)
    groups = groups.withColumn("stop", F.sum("n_items").over(order)).withColumn("first", F.col("stop") - F.col("n_items"))
    check = groups.agg(F.count("*").alias("n"), F.count_distinct("name").alias("names")).first()
    if check.n < 2:
        raise ValueError("at least two groups with sequences are needed")
    if check.names < check.n:
        raise ValueError("two files have the same stem")
    items = records.join(groups.select("file", "grp", "first"), "file").select(
        (F.col("first") + F.col("position")).alias("item"), "grp", "name", "description", "sequence"
    )
    return items, groups.select("grp", "name", "n_items", "first", "stop")


def load_sets(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, groups, refused) of records that ``read_records`` read with ``sets``.

    items: set_id, item, grp, name, description, sequence; groups: set_id, grp, name, set_name, n_items; refused: set_name,
    note of sets with fewer than two groups or with two files of one stem, which the others don't suffer for. Sets are
    numbered by a hash of their name, so that a set keeps its number when others come; groups and items
    are numbered from 0 in their set.
    """
    of = F.split_part("file", F.lit("/"), F.lit(1))
    files = records.groupBy("file").agg(F.count("*").alias("n_items"))
    files = files.select("file", of.alias("set_name"), stem(F.split_part("file", F.lit("/"), F.lit(2))).alias("name"), "n_items")
    per_set = files.groupBy("set_name").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))
    note = F.when(F.col("n") < 2, "fewer than two groups with sequences").when(F.col("names") < F.col("n"), "two files have the same stem")
    per_set = per_set.withColumn("note", note)
    order = Window.partitionBy("set_name").orderBy("file")
    good = files.join(per_set.where("note is null").select("set_name"), "set_name", "left_semi")
    groups = good.select("*", F.xxhash64("set_name").alias("set_id"), (F.row_number().over(order) - 1).cast("long").alias("grp"), (F.sum("n_items").over(order) - F.col("n_items")).alias("before"))
    items = records.join(groups.select("file", "set_id", "grp", "before"), "file").select(
        "set_id", (F.col("before") + F.col("position")).cast("long").alias("item"), "grp", "name", "description", "sequence"
    )
    return items, groups.select("set_id", "grp", "name", "set_name", "n_items"), per_set.where("note is not null").select("set_name", "note")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import os

        names = sorted(os.listdir(self.path)) if os.path.isdir(self.path) else [""]
        return [_File(os.path.join(self.path, n) if n else self.path) for n in names if not n or n.lower().endswith(FASTA_SUFFIXES)]

    def read(self, partition):
        import os

        with open(partition.path, encoding="utf-8") as f:
            for k, (name, description, seq) in enumerate(r for r in parse(f) if r[2]):
                yield os.path.basename(partition.path), k, name, description, seq


class FastaSource(DataSource):
    """``spark.dataSource.register(FastaSource)``, then ``spark.read.format("fasta").load(path)``: one partition a local file."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file string, position long, name string, description string, sequence string"

    def reader(self, schema):
        return _Reader(self.options["path"])
