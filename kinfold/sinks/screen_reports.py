"""The screen's reports as lines of text: ten tables with fixed headers and a summary, for one set or thousands.

A line is (set_id, report, no, line), ``no`` counting from 0, the header. ``write_lines`` puts each report
of each set in a folder of its own, in order: report=proposed_bins/set_id=7. Rewriting some sets
leaves the others as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators import core
from kinfold.plans.screen import Screen

#: Reports and their headers (fixed values).
HEADERS = {
    "homolog_counts": ["genome", "homologs"],
    "leave_one_out": ["excluded_genome", "core_size", "change_vs_baseline"],
    "greedy_removal": ["genomes_retained", "core_size", "genome_removed"],
    "soft_core_curve": ["genomes_present", "genomes_total", "percent", "group_count"],
    "speciation_prediction": ["genome", "nearest_genome", "aai_percent", "shared_orthologs", "core_gain_if_removed", "aai_reading", "verdict"],
    "proposed_bins": ["bin", "genomes", "core_genes", "bin_reference", "min_aai", "mean_aai", "members"],
    "merge_trace": ["step", "linkage_aai", "size_a", "size_b", "merged_size", "side_a", "side_b"],
}
#: Reports whose header is "genome" and a column for each group, or each item of the anchor.
WIDE = ("aai_matrix", "shared_orthologs", "pangenome_matrix")
RULE = "-" * 72


def _text(x: Column | str) -> Column:
    return F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit("NA"))


def _two(x: str) -> Column:
    """Two decimals at most, as a number prints; NA for null."""
    return _text(F.round(x, 2))


def _lines(rows: DataFrame, report: str, order: list, cells: list[Column], start: int = 1) -> DataFrame:
    """One line a row, numbered within its set: a set has as many rows as groups, or as steps among them."""
    no = F.row_number().over(Window.partitionBy("set_id").orderBy(*order)) + (start - 1)
    return rows.select("set_id", F.lit(report).alias("report"), no.cast("int").alias("no"), F.concat_ws("\t", *cells).alias("line"))


def _wide(cells: DataFrame, report: str, names: DataFrame, columns: DataFrame) -> DataFrame:
    """cells: (set_id, row, col, value), dense; columns: (set_id, col, title). A line holds one row's cells in the order of ``col``."""
    joined = lambda key, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(v).alias("v")))), lambda c: c["v"]), "\t")
    head = columns.groupBy("set_id").agg(joined("col", "title").alias("t")).select("set_id", F.lit(report).alias("report"), F.lit(0).alias("no"), F.concat_ws("\t", F.lit("genome"), "t").alias("line"))
    rows = cells.groupBy("set_id", "row").agg(joined("col", "value").alias("t")).join(names.select("set_id", F.col("grp").alias("row"), "name"), ["set_id", "row"])
    return head.unionByName(_lines(rows, report, ["row"], [F.col("name"), F.col("t")]))


def report_lines(s: Screen) -> DataFrame:
    """Every line of the ten tables, for all sets of the screen."""
    tables = report_tables(s)
    out = [_lines(tables[r], r, order, cells) for r, order, cells in _rows()]
    heads = s.groups.select("set_id").distinct()
    titles = F.explode(F.array(*[F.struct(F.lit(k).alias("report"), F.lit("\t".join(v)).alias("line")) for k, v in HEADERS.items()])).alias("h")
    out.append(heads.select("set_id", titles).select("set_id", "h.report", F.lit(0).alias("no"), "h.line"))
    columns = s.names.select("set_id", F.col("grp").alias("col"), F.col("name").alias("title"))
    cell = lambda v: s.matrix.select("set_id", F.col("ga").alias("row"), F.col("gb").alias("col"), v.alias("value"))
    out.append(_wide(cell(_text(F.when(F.col("aai").isNotNull(), F.format_string("%.2f", "aai")))), "aai_matrix", s.names, columns))
    out.append(_wide(cell(F.col("shared").cast("string")), "shared_orthologs", s.names, columns))
    present = s.presence.select("set_id", F.col("grp").alias("row"), F.col("ref_item").alias("col"), F.col("present").cast("string").alias("value"))
    numbered = present.select("set_id", "col").distinct()
    place = F.row_number().over(Window.partitionBy("set_id").orderBy("col")) - 1
    titled = numbered.select("set_id", "col", F.concat(F.lit("group"), place).alias("title"))
    out.append(_wide(present, "pangenome_matrix", s.names, titled))
    lines = out[0]
    for more in out[1:]:
        lines = lines.unionByName(more)
    return lines


def report_tables(s: Screen) -> dict[str, DataFrame]:
    """The rows of the tables with fixed headers, with names in place of groups."""
    name = lambda key, alias: s.names.select("set_id", F.col("grp").alias(key), F.col("name").alias(alias))
    side = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == c, F.struct("grp", "name")))), lambda m: m["name"]), ";")
    trace = s.merge_trace.select("set_id", "step", "linkage", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("side_a").alias("g")), F.struct(F.lit("b").alias("side"), F.col("side_b").alias("g")))).alias("x"))
    trace = trace.select("set_id", "step", "linkage", "x.side", F.explode("x.g").alias("grp")).join(name("grp", "name"), ["set_id", "grp"])
    trace = trace.groupBy("set_id", "step", "linkage").agg(
        F.count_if(F.col("side") == "a").alias("size_a"), F.count_if(F.col("side") == "b").alias("size_b"), side("a").alias("side_a"), side("b").alias("side_b")
    )
    return {
        "homolog_counts": s.counts.join(name("grp", "name"), ["set_id", "grp"]),
        "leave_one_out": s.leave_one_out.join(name("excluded", "name"), ["set_id", "excluded"]),
        "greedy_removal": s.greedy_removal.join(name("removed", "name"), ["set_id", "removed"], "left"),
        "soft_core_curve": s.soft_core_curve,
        "speciation_prediction": s.speciation.join(name("grp", "name"), ["set_id", "grp"]).join(name("nearest", "mate"), ["set_id", "nearest"], "left"),
        "proposed_bins": s.bin_report.join(name("ref", "name"), ["set_id", "ref"]),
        "merge_trace": trace,
    }


def _rows() -> list[tuple[str, list, list[Column]]]:
    """(report, order of its rows, cells) of the tables with fixed headers."""
    return [
        ("homolog_counts", ["homologs", "grp"], [F.col("name"), _text("homologs")]),
        ("leave_one_out", [F.desc("core_size"), "excluded"], [F.col("name"), _text("core_size"), _text("change")]),
        ("greedy_removal", [F.desc("retained")], [_text("retained"), _text("core_size"), F.coalesce("name", F.lit(""))]),
        ("soft_core_curve", [F.desc("genomes_present")], [_text("genomes_present"), _text("genomes_total"), _text("percent"), _text("group_count")]),
        (
            "speciation_prediction",
            [F.asc_nulls_first(F.round("aai", 2)), "grp"],
            [F.col("name"), F.coalesce("mate", F.lit("-")), _two("aai"), _text("shared"), _text("gain"), F.col("reading"), F.col("verdict")],
        ),
        ("proposed_bins", ["bin"], [_text("bin"), _text("size"), _text("core_size"), F.col("name"), _two("min_aai"), _two("mean_aai"), F.col("members")]),
        ("merge_trace", ["step"], [_text("step"), _two("linkage"), _text("size_a"), _text("size_b"), _text(F.col("size_a") + F.col("size_b")), F.col("side_a"), F.col("side_b")]),
    ]


def summary_lines(s: Screen) -> DataFrame:
    """The readable report of each set, as report "summary": what was asked, what was found, and every table in columns."""
    t = report_tables(s)
    g, p = s.groups.groupBy("set_id").agg(F.count("*").alias("groups")), s.settings
    items = s.items.groupBy("set_id").agg(F.count("*").alias("items"))
    anchor = s.counts.join(s.ref.withColumnRenamed("ref", "grp"), ["set_id", "subset_id", "grp"]).join(s.names, ["set_id", "grp"]).select("set_id", "name", "homologs")
    core = s.core_of(s.full).select("set_id", "core_size")
    n_bins = s.bins.groupBy("set_id").agg(F.max("bin").alias("bins"))
    head = g.join(items, "set_id").join(anchor, "set_id").join(core, "set_id").join(n_bins, "set_id")
    limits = f"identity >= {p.min_identity:g}%, binning at mean identity >= {p.bin_aai:g}% (complete linkage)"
    top = F.array(
        F.format_string("groups  : %d", "groups"),
        F.format_string("items   : %d", "items"),
        F.format_string("anchor  : %s (fewest homologs, %d)", "name", "homologs"),
        F.lit(f"limits  : {limits}"),
        F.lit(""),
        F.format_string("CORE: %d items shared by all %d groups", "core_size", "groups"),
        F.when(F.col("core_size") == 0, F.lit("No item is shared by every group. Rule out incomplete groups and too strict limits first.")),
        F.when(F.col("bins") == 1, F.lit("One bin: the set is coherent at this limit.")).otherwise(F.format_string("%d bins: the set is not one coherent group at this limit.", "bins")),
    )
    out = [head.select("set_id", F.posexplode(F.filter(top, lambda x: x.isNotNull())).alias("no", "line")).select("set_id", F.lit(0).alias("part"), "no", "line")]

    def section(k: int, report: str, title: str, columns: str, cells: Column) -> None:
        order = next(o for r, o, _ in _rows() if r == report)
        no = (F.row_number().over(Window.partitionBy("set_id").orderBy(*order)) + 3).cast("int")
        out.append(t[report].select("set_id", F.lit(k).alias("part"), no.alias("no"), cells.alias("line")))
        fixed = F.posexplode(F.array(F.lit(RULE), F.lit(title), F.lit(""), F.lit(columns)))
        out.append(g.select("set_id", fixed.alias("no", "line")).select("set_id", F.lit(k).alias("part"), "no", "line"))

    section(1, "proposed_bins", "PROPOSED BINS", f"{'bin':>5} {'groups':>7} {'core':>10} {'min AAI':>8} {'mean AAI':>8}  members", F.format_string("%5d %7d %10d %8s %8s  %s", "bin", "size", "core_size", _two("min_aai"), _two("mean_aai"), "members"))
    section(2, "speciation_prediction", "NEAREST GROUP AND CORE GAINED WITHOUT EACH GROUP", f"{'group':<28} {'nearest':<22} {'AAI%':>7} {'gain':>9}  verdict", F.format_string("%-28s %-22s %7s %+9d  %s", F.substring("name", 1, 28), F.substring(F.coalesce("mate", F.lit("-")), 1, 22), _two("aai"), "gain", "verdict"))
    section(3, "homolog_counts", "HOMOLOGS PER GROUP", f"{'group':<48} {'items':>6}", F.format_string("%-48s %6d", F.substring("name", 1, 48), "homologs"))
    section(4, "leave_one_out", "LEAVE-ONE-OUT", f"{'group left out':<48} {'core':>8} {'change':>8}", F.format_string("%-48s %8d %+8d", F.substring("name", 1, 48), "core_size", "change"))
    section(5, "greedy_removal", "GREEDY REMOVAL", f"{'groups':>8} {'core':>8}   group left out", F.format_string("%8d %8d   %s", "retained", "core_size", F.coalesce("name", F.lit(""))))
    lines = out[0]
    for more in out[1:]:
        lines = lines.unionByName(more)
    no = F.row_number().over(Window.partitionBy("set_id").orderBy("part", "no")) - 1
    return lines.select("set_id", F.lit("summary").alias("report"), no.cast("int").alias("no"), "line")


def core_lines(s: Screen, items: DataFrame) -> DataFrame:
    """The core's items as (report, set_id, part, no, line): names and sequences of each group, and each ortholog group's sequences.

    items: (set_id, item, name, sequence). Line k of every group's names is the same ortholog group.
    """
    table = core.core_table(s.ortholog_groups, s.partner, s.full).join(items.select("set_id", "item", F.col("name").alias("item_name"), "sequence"), ["set_id", "item"])
    table = table.join(s.names, ["set_id", "grp"]).join(s.ortholog_groups.select("set_id", "group_no", "label"), ["set_id", "group_no"])
    fasta = F.concat(F.lit(">"), "item_name", F.lit("\n"), "sequence")
    with_group = F.concat(F.lit(">"), "name", F.lit("|"), "item_name", F.lit("\n"), "sequence")
    kinds = [("gene_names", F.col("name"), F.col("group_no"), F.col("item_name")), ("per_genome", F.col("name"), F.col("group_no"), fasta), ("ortholog_groups", F.concat(F.lit("group"), "label"), F.col("grp"), with_group)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("report"), part.alias("part"), no.cast("long").alias("no"), line.alias("line")) for k, part, no, line in kinds]))
    return table.select("set_id", each.alias("x")).select("set_id", "x.*")


def write_core(lines: DataFrame, path: str) -> None:
    """One folder for each kind, set and group (or ortholog group), its lines in order."""
    rows = lines.repartition("report", "set_id", "part").sortWithinPartitions("report", "set_id", "part", "no")
    rows.select("report", "set_id", "part", F.col("line").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report", "set_id", "part").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """One folder for each report and set, its lines in order; folders of other sets stay.

    A set's report is one file: it has a line a group, and a wide table's line a cell for each item of one group.
    """
    rows = lines.repartition("report", "set_id").sortWithinPartitions("report", "set_id", "no")
    rows.select("report", "set_id", F.col("line").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report", "set_id").text(path)


def read_lines(spark, path: str) -> DataFrame:
    """(report, set_id, line) of what ``write_lines`` wrote."""
    return spark.read.format("text").load(path).select("report", F.col("set_id").cast("string").alias("set_id"), F.col("value").alias("line"))
