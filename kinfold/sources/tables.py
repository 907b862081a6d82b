"""Readers of the engine's text formats. Schemas are explicit; nothing is inferred.

Missing values ('NA', 'nan', '--', '') become null here and nowhere else.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions.scalars import plain_accession, tolerant_number

HITS = "q long, s long, pident double, length int, qlen int, slen int, gapopen int, evalue double, score double"
BLAST6 = (
    "query string, subject string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, "
    "sstart int, send int, evalue double, bitscore double"
)


def _place() -> Column:
    """A line's place in its file: splits are read in any order, the lines of one split in theirs."""
    m = F.col("_metadata")
    return F.struct(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n"))


def read_hits(spark: SparkSession, path: str, set_id: int = 0) -> DataFrame:
    """Nine-column tab-separated hits with the line's place; lines with fewer fields are skipped, more fields ignored."""
    line = spark.read.text(path).select(
        F.split("value", "\t").alias("f"), _place().alias("line")
    )
    kinds = [x.strip().split(" ") for x in HITS.split(",")]
    ok = line.where(F.size("f") >= len(kinds))
    return ok.select(
        F.lit(set_id).cast("long").alias("set_id"), *[F.col("f")[i].try_cast(kind).alias(name) for i, (name, kind) in enumerate(kinds)], "line"
    )


def read_blast(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Twelve-column hits of one file a group pair, with the file's name; malformed rows go."""
    df = spark.read.schema(BLAST6).option("sep", "\t").option("mode", "DROPMALFORMED").csv(paths)
    return df.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Header-keyed table, all columns text."""
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)


def read_matrix(spark: SparkSession, path: str, key: str = "genome") -> DataFrame:
    """(row, col, value) of a labelled square matrix."""
    wide = read_tsv(spark, path)
    names = [c for c in wide.columns if c != key]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias("v")) for c in names]))
    return wide.select(F.col(key).alias("row"), cells.alias("x")).select("row", "x.col", tolerant_number(F.col("x.v")).alias("value"))


def read_presence(spark: SparkSession, path: str, key: str = "genome") -> DataFrame:
    """(row, col) of the cells of a presence matrix that aren't empty, 0, - or NA."""
    wide = read_tsv(spark, path)
    names = [c for c in wide.columns if c != key]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias("v")) for c in names]))
    x = wide.select(F.col(key).alias("row"), cells.alias("x")).select("row", "x.col", F.trim("x.v").alias("v"))
    return x.where(F.col("v").isNotNull() & ~F.col("v").isin("", "0", "-", "NA")).select("row", "col")


def read_assemblies(spark: SparkSession, path: str) -> DataFrame:
    """Positional assembly summary; # lines and rows of fewer than 36 fields go."""
    at = {
        "accession": 0, "refseq_category": 4, "organism_name": 7, "version_status": 10, "assembly_level": 11,
        "ftp_path": 19, "total_genes": 34, "protein_genes": 35,
    }
    f = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 36)
    out = f.select(*[F.col("f")[i].alias(c) for c, i in at.items()])
    return out.withColumn("ftp_path", F.when(~F.lower("ftp_path").isin("", "na"), F.col("ftp_path")))


def read_taxonomy(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(accession, lineage) of several headerless files, prefixes of accessions stripped; a later file adds its rows.

    A file that isn't there is left out; if none is there, that is an error.
    """
    found = []
    for path in paths:
        try:
            found.append(spark.read.text(path))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in (e.getCondition() or "") or (path == paths[-1] and not found):
                raise
    lines = found[0]
    for more in found[1:]:
        lines = lines.unionByName(more)
    f = lines.select(F.split("value", "\t", 2).alias("f")).where(F.size("f") == 2)
    return f.select(plain_accession(F.col("f")[0]).alias("accession"), F.trim(F.col("f")[1]).alias("lineage"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(product, gene, length) of the CDS rows of a (gzip) feature table; rows without a numeric length go."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where((F.size("f") > 18) & (F.col("f")[0] == "CDS"))
    out = f.select(F.col("f")[10].alias("product"), F.col("f")[15].alias("gene"), F.col("f")[18].alias("length"))
    return out.where(F.col("length").rlike("^[0-9]+$")).withColumn("length", F.col("length").cast("long"))


def read_report(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """(file, one number a field): a regular expression's first group in each whole report, thousands separators removed."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return t.select("file", *[F.replace(F.regexp_extract("value", p, 1), F.lit(","), F.lit("")).try_cast("long").alias(k) for k, p in fields.items()])


def read_phi(spark: SparkSession, path: str) -> DataFrame:
    """(group_no, p) of recombination reports: the first normal-test value of each file rec<N>, null where untested."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return t.select(
        F.regexp_extract("file", r"rec(\d+)[^/]*$", 1).try_cast("int").alias("group_no"),
        tolerant_number(F.trim(F.regexp_extract("value", r"PHI \(Normal\):\s*(\S+)", 1))).alias("p"),
    )


def read_sections(spark: SparkSession, path: str, header: str) -> DataFrame:
    """(file, section, fields): rows of a table of several sections.

    A section starts at a row whose first field is ``header`` and ends at a comment or a row
    of one field. One file's rows are ordered by a window: such files are reports, not data.
    """
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), _place().alias("n"), F.split("value", "\t").alias("fields"))
    start = (F.col("fields")[0] == header).cast("int")
    stop = (F.col("fields")[0].startswith("#") | (F.size("fields") < 2)).cast("int")
    upto = Window.partitionBy("file").orderBy("n")
    x = t.withColumn("section", F.sum(start).over(upto)).withColumn("stops", F.sum(stop).over(Window.partitionBy("file", "section").orderBy("n")))
    return x.where((start == 0) & (F.col("section") > 0) & (F.col("stops") == 0)).select("file", "section", "fields")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def read_status(spark: SparkSession, path: str) -> DataFrame:
    schema = "genus string, n_species int, state string, attempts int, started_utc string, updated_utc string, wall_seconds int, note string"
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)
