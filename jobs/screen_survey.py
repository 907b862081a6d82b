"""Survey of many sets: search, screen and report every set that is new or has changed.

    python -m jobs.screen_survey jobs/screen_survey.json items=/data/items.parquet out=/data/survey mark=/data/survey-mark

The items are vectors in a table, sequences in a table ("search": "words" or "proteins"), or protein files, a folder a
set and a file a group ("format": "fasta"); of these the core's names and sequences are written too, and a tree if asked for. A set's fingerprint covers its items and the limits. Sets whose fingerprint stands in the mark are left as they
are; all others are searched and screened in one plan, whatever their sizes. The hits of a search are kept under
the mark by the fingerprint of what was searched, so a run that broke off later finds them again. Reports are
text, one folder for each report and set; the roll-up has one Parquet folder a set. Only folders of sets that were
screened are replaced. Tables that several reports are made from are written under the mark, once a run. A set is marked last, and only if all its reports can be read back and name a bin: until
then a rerun does it again, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, checked, existing, main
from kinfold.operators import core, phylogeny
from kinfold.operators.search import vector_hits
from kinfold.operators.sequence_search import PROTEIN, WORDS, letters, words
from kinfold.operators.sequence_search import search as sequence_search
from kinfold.plans.screen import Screen, Settings
from kinfold.sinks.screen_reports import HEADERS, WIDE, core_lines, read_lines, report_lines, summary_lines, write_core, write_lines
from kinfold.sources.fasta import load_sets, read_records

REQUIRED = {"items": str, "out": str, "mark": str}
OPTIONAL = {
    "format": "parquet",
    #: Expressions over the items table: the set and group of an item, its id, its vector or sequence.
    "set": "set_id", "group": "grp", "item": "item", "content": "vector",
    #: What is compared and the limits of a hit: identity of vectors, e-value and targets an item of sequences.
    "search": "vectors", "min_hit": 57.5, "max_evalue": 1e-4, "max_targets": None,
    #: Of protein files: whether to make a tree of each set's core, and the limit below which a group counts as recombinant and is left out of it.
    "tree": False, "alpha": 0.05,
    #: Limits of the screen; search again what the mark says is done.
    "limits": {}, "force": False,
}
MARK = "fingerprint string, set_id long"
SEARCHES = "hits long, search string"


def fingerprints(items: DataFrame, limits: str) -> DataFrame:
    """(set_id, fingerprint): the number of a set's items, a sum over their hashes, and a hash of the limits; rows in any order."""
    row = F.xxhash64("item", "grp", "content").cast("decimal(38,0)")
    sums = items.groupBy("set_id").agg(F.count("*").alias("n"), F.sum(row).alias("h"))
    return sums.select("set_id", F.concat_ws("-", "n", "h", F.hex(F.xxhash64(F.lit(limits)))).alias("fingerprint"))


def keeper(spark: SparkSession, path: str) -> Callable[[str, DataFrame], DataFrame]:
    """Writes a table under ``path``, in place of an earlier run's, and reads it back."""

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    return keep


def searched(spark: SparkSession, items: DataFrame, search: str, c: dict) -> DataFrame:
    """The hits of ``items`` that a screen needs, from an earlier run's search of the very same items if it ended."""
    path, log = f"{c['mark']}/hits/{search}", f"{c['mark']}/searches"
    if existing(spark, log, SEARCHES).where(F.col("search") == search).isEmpty():
        if c["search"] == "vectors":
            hits = vector_hits(items.withColumnRenamed("content", "vector"), c["min_hit"], best_only=True)
        else:
            code, scheme = {"words": (words, WORDS), "proteins": (letters, PROTEIN)}[c["search"]]
            hits = sequence_search(items.withColumn("codes", code(F.col("content"))), scheme, c["max_evalue"], c["max_targets"], keep=keeper(spark, f"{c['mark']}/search"))
        hits.write.mode("overwrite").parquet(path)
        ended = spark.read.parquet(path).agg(F.count("*").alias("hits"), F.lit(search).alias("search"))
        ended.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("search").parquet(log)
        LOG.info("searched: %s", search)
    else:
        LOG.info("reusing the finished search %s", search)
    return spark.read.parquet(path)


def read_items(spark: SparkSession, c: dict) -> tuple[DataFrame, DataFrame | None]:
    """((set_id, item, grp, content [, name]), names of groups or None). Rows without a set, id, group or content are left out."""
    if c["format"] == "fasta":
        items, groups, refused = load_sets(read_records(spark, c["items"], sets=True))
        for r in refused.orderBy("set_name").limit(20).collect():  # the log's first lines; the sets are left out of all that follows
            LOG.warning("set %s is left out: %s", r.set_name, r.note)
        return items.select("set_id", "item", "grp", F.col("sequence").alias("content"), "name"), groups.select("set_id", "grp", "name")
    table = spark.read.format(c["format"]).load(c["items"])
    kind = "array<float>" if c["search"] == "vectors" else "string"
    items = table.select(*[F.expr(c[k]).cast(t).alias(n) for k, t, n in (("set", "long", "set_id"), ("item", "long", "item"), ("group", "long", "grp"), ("content", kind, "content"))])
    return items.where("set_id is not null and item is not null and grp is not null and content is not null"), None


def write_trees(screen: Screen, sequences: DataFrame, c: dict, keep: Callable[[str, DataFrame], DataFrame]) -> None:
    """Align each core group, test it for recombination, and write the tree of each set's other groups; a set whose groups are all recombinant has none."""
    members = core.core_table(screen.ortholog_groups, screen.partner, screen.full).join(sequences, ["set_id", "item"])
    aligned = keep("aligned", phylogeny.align_groups(members.select("set_id", "group_no", "grp", "sequence")))
    tests = keep("recombination", phylogeny.recombination_test(aligned))
    flagged = tests.where(F.col("p") < c["alpha"]).select("set_id", "group_no")
    joined = keep("joined", phylogeny.supermatrix_of(aligned.join(flagged, ["set_id", "group_no"], "left_anti")))
    edges = phylogeny.neighbour_tree(phylogeny.distances(joined)).join(screen.names.select("set_id", F.col("grp").alias("node"), "name"), ["set_id", "node"], "left")
    for rows, name in ((edges, "trees"), (tests, "recombination")):
        rows.withColumn("set", F.col("set_id")).repartition("set").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set").parquet(f"{c['out']}/{name}")


def check_limits(c: dict) -> None:
    """Values that no search can go by, and folders that would overwrite each other, are errors that name the entry."""
    if c["search"] not in ("vectors", "words", "proteins"):
        raise ValueError("config entry 'search' must be vectors, words or proteins")
    if not 0 < c["min_hit"] <= 100:
        raise ValueError("config entry 'min_hit' must lie in (0, 100]")
    if c["max_evalue"] <= 0:
        raise ValueError("config entry 'max_evalue' must be above 0")
    if c["max_targets"] is not None and c["max_targets"] < 1:
        raise ValueError("config entry 'max_targets' must be 1 or more")
    paths = [(k, c[k].rstrip("/") + "/") for k in ("items", "out", "mark")]
    for k, x in paths:
        for other, y in paths:
            if k < other and (x.startswith(y) or y.startswith(x)):
                raise ValueError(f"config entries {k!r} and {other!r} must not hold each other")


def run(spark: SparkSession, config: dict) -> dict:
    """Screen what is new; returns what was read and written."""
    c = checked(config, REQUIRED, OPTIONAL)
    settings = Settings(**c["limits"])
    check_limits(c)
    items, names = read_items(spark, c)
    known = existing(spark, f"{c['mark']}/sets", MARK)
    found = fingerprints(items, repr((settings, *(c[k] for k in ("search", "min_hit", "max_evalue", "max_targets")))))
    fresh = found if c["force"] else found.join(known, ["set_id", "fingerprint"], "left_anti")
    # Written before anything else, as the mark itself changes at the end.
    fresh.write.mode("overwrite").parquet(f"{c['mark']}/todo")
    todo = spark.read.schema(fresh.schema).parquet(f"{c['mark']}/todo")
    n, total = todo.agg(F.count("*"), F.sum(F.xxhash64("set_id", "fingerprint").cast("decimal(38,0)"))).first()
    search = f"{n}_{total}"
    LOG.info("sets to do: %d", n)
    report = {"sets_done": n, "items_read": 0, "hits": 0, "lines_written": 0}
    if not n:
        return report
    new = items.join(todo.select("set_id"), "set_id", "left_semi")
    hits = searched(spark, new, search, c)

    keep = keeper(spark, f"{c['mark']}/work")
    ids = keep("items", new.select("set_id", "item", "grp"))
    screen = Screen(ids, hits, settings, names=None if names is None else keep("names", names), keep=keep)
    write_lines(report_lines(screen).unionByName(summary_lines(screen)), f"{c['out']}/reports")
    screen.survey.withColumn("set", F.col("set_id")).repartition("set").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set").parquet(f"{c['out']}/survey")

    if names is not None:
        sequences = new.select("set_id", "item", "name", F.col("content").alias("sequence"))
        write_core(core_lines(screen, sequences), f"{c['out']}/core_genes")
        if c["tree"]:
            write_trees(screen, sequences, c, keep)

    # A set is done if every report is there and at least one bin has a line.
    lines = read_lines(spark, f"{c['out']}/reports").join(todo.select(F.col("set_id").cast("string").alias("set_id")), "set_id", "left_semi")
    whole = lines.groupBy("set_id").agg(F.count_distinct("report").alias("reports"), F.count_if(F.col("report") == "proposed_bins").alias("bins"), F.count("*").alias("n"))
    done = whole.where((F.col("reports") == len(HEADERS) + len(WIDE) + 1) & (F.col("bins") > 1))
    marked = todo.join(done.select(F.col("set_id").cast("long").alias("set_id"), "n"), "set_id")
    marked.select("fingerprint", "set_id").repartition("set_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_id").parquet(f"{c['mark']}/sets")
    report["sets_done"], report["lines_written"] = marked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    report["items_read"], report["hits"] = new.count(), hits.count()
    LOG.info("read %(items_read)d items, %(hits)d hits; wrote %(lines_written)d lines of %(sets_done)d sets", report)
    if report["sets_done"] < n:
        raise RuntimeError(f"{n - report['sets_done']} sets lack reports and are left for the next run")
    return report


if __name__ == "__main__":
    main(run, "screen-survey")
