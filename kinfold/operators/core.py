"""Core sets: the items of an anchor group that have mates everywhere, by relational division.

All subsets of groups are handled in one plan: ``subset`` is (set_id, subset_id, grp), and
the anchor is chosen anew for each subset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUB = ["set_id", "subset_id"]


def full_subset(groups: DataFrame) -> DataFrame:
    return groups.select("set_id", F.lit(0).cast("long").alias("subset_id"), "grp")


def without_each(groups: DataFrame) -> DataFrame:
    """One subset for each group, without that group; subset_id is the group left out. None for two groups or fewer."""
    n = groups.groupBy("set_id").agg(F.count("*").alias("n")).where("n > 2").select("set_id")
    g = groups.join(n, "set_id")
    out = g.select("set_id", F.col("grp").cast("long").alias("subset_id"))
    return out.join(g, "set_id").where("grp <> subset_id").select("set_id", "subset_id", "grp")


def _sizes(subset: DataFrame) -> DataFrame:
    return subset.groupBy(*SUB).agg(F.count("*").alias("n"))


def homolog_counts(hit_from: DataFrame, subset: DataFrame) -> DataFrame:
    """(set_id, subset_id, grp, homologs): items hit from every other group of the subset; 0 for a lone group."""
    other = subset.select(*SUB, F.col("grp").alias("other"))
    full = (
        hit_from.join(subset, ["set_id", "grp"])
        .join(other, [*SUB, "other"])
        .groupBy(*SUB, "grp", "item")
        .agg(F.count_distinct("other").alias("k"))
        .join(_sizes(subset), SUB)
        .where("k = n - 1")
        .groupBy(*SUB, "grp")
        .agg(F.count("*").alias("homologs"))
    )
    return subset.join(full, [*SUB, "grp"], "left").select(*SUB, "grp", F.coalesce("homologs", F.lit(0)).alias("homologs"))


def reference_group(counts: DataFrame, names: DataFrame) -> DataFrame:
    """(set_id, subset_id, ref): fewest homologs, ties by the group's name."""
    best = F.min(F.struct("homologs", "name", "grp"))
    return counts.join(names, ["set_id", "grp"]).groupBy(*SUB).agg(best.alias("b")).select(*SUB, F.col("b.grp").alias("ref"))


def reference_with_homologs(counts: DataFrame, names: DataFrame) -> DataFrame:
    """``reference_group`` as the older pipeline has it: fails, naming them, if some groups have no homolog in all others."""
    none = counts.where("homologs = 0").join(names, ["set_id", "grp"]).select("set_id", "name").orderBy("set_id", "name")
    if found := none.limit(20).collect():  # the message's first names
        raise ValueError("groups without a homolog in all others: " + ", ".join(f"{r['name']} (set {r['set_id']})" for r in found))
    return reference_group(counts, names)


def core_items(partner: DataFrame, items: DataFrame, subset: DataFrame, ref: DataFrame) -> DataFrame:
    """(set_id, subset_id, ref, item): items of the anchor with a mate in every other group; all of a lone group's."""
    sized = ref.join(_sizes(subset), SUB)
    lone = sized.where("n = 1").join(items.select("set_id", F.col("grp").alias("ref"), "item"), ["set_id", "ref"])
    other = subset.select(*SUB, F.col("grp").alias("other"))
    full = (
        sized.join(partner.select("set_id", F.col("grp").alias("ref"), "item", "other"), ["set_id", "ref"])
        .join(other, [*SUB, "other"])
        .groupBy(*SUB, "ref", "n", "item")
        .agg(F.count_distinct("other").alias("k"))
        .where("k = n - 1")
    )
    cols = [*SUB, "ref", "item"]
    return lone.select(*cols).unionByName(full.where("n > 1").select(*cols))


def core_sizes(hit_from: DataFrame, partner: DataFrame, items: DataFrame, subset: DataFrame, names: DataFrame) -> DataFrame:
    """(set_id, subset_id, ref, core_size) with the anchor chosen for each subset."""
    ref = reference_group(homolog_counts(hit_from, subset), names)
    n = core_items(partner, items, subset, ref).groupBy(*SUB).agg(F.count("*").alias("core_size"))
    return ref.join(n, SUB, "left").select(*SUB, "ref", F.coalesce("core_size", F.lit(0)).alias("core_size"))


def _shortfall(rel: DataFrame, groups: DataFrame) -> DataFrame:
    """(set_id, grp, item, missing, one): how many other groups an item lacks, 0 or 1 of them, and which one.

    One pass over the relation: the one missing group is what the sum of the others' ids lacks of the sum of all.
    """
    total = groups.groupBy("set_id").agg(F.count("*").alias("_n"), F.sum(F.col("grp").cast("decimal(38,0)")).alias("_sum"))
    has = rel.select("set_id", "grp", "item", "other").distinct().join(groups.select("set_id", F.col("grp").alias("other")), ["set_id", "other"])
    k = has.groupBy("set_id", "grp", "item").agg(F.count("*").alias("_k"), F.sum(F.col("other").cast("decimal(38,0)")).alias("_s"))
    lack = F.col("_n") - 1 - F.col("_k")
    return k.join(total, "set_id").where(lack <= 1).select(
        "set_id", "grp", "item", lack.alias("missing"), F.when(lack == 1, F.col("_sum") - F.col("grp") - F.col("_s")).cast("long").alias("one")
    )


def _without(rel: DataFrame, groups: DataFrame, subset: DataFrame) -> DataFrame:
    """(set_id, subset_id, grp, n): items of each group that are complete once group ``subset_id`` is left out."""
    short = _shortfall(rel, groups)
    full = short.where("missing = 0").groupBy("set_id", "grp").agg(F.count("*").alias("_full"))
    one = short.where("missing = 1").groupBy("set_id", "grp", F.col("one").alias("subset_id")).agg(F.count("*").alias("_one"))
    n = F.coalesce("_full", F.lit(0)) + F.coalesce("_one", F.lit(0))
    return subset.join(full, ["set_id", "grp"], "left").join(one, [*SUB, "grp"], "left").select(*SUB, "grp", n.alias("n"))


def sizes_without_each(hit_from: DataFrame, partner: DataFrame, groups: DataFrame, names: DataFrame) -> DataFrame:
    """``core_sizes`` of ``without_each``, from one pass over the hits: rows a pair of groups, not a hit and a subset."""
    subset = without_each(groups)
    ref = reference_group(_without(hit_from, groups, subset).withColumnRenamed("n", "homologs"), names)
    sizes = _without(partner, groups, subset).select(*SUB, F.col("grp").alias("ref"), F.col("n").alias("core_size"))
    return ref.join(sizes, [*SUB, "ref"]).select(*SUB, "ref", "core_size")


def presence(partner: DataFrame, items: DataFrame, groups: DataFrame, ref: DataFrame) -> DataFrame:
    """(set_id, ref_item, grp, present): every anchor item by every group; the anchor has all its own."""
    own = items.join(ref.select("set_id", F.col("ref").alias("grp")), ["set_id", "grp"]).select("set_id", F.col("item").alias("ref_item"), F.col("grp").alias("ref"))
    has = partner.select("set_id", F.col("item").alias("ref_item"), F.col("other").alias("grp"), F.lit(1).alias("has")).distinct()
    return (
        own.join(groups, "set_id")
        .join(has, ["set_id", "ref_item", "grp"], "left")
        .select("set_id", "ref_item", "grp", ((F.col("grp") == F.col("ref")) | F.col("has").isNotNull()).cast("int").alias("present"))
    )


def soft_core_curve(presence: DataFrame, as_fraction: bool = False) -> DataFrame:
    """(set_id, genomes_present, genomes_total, percent, group_count) for total .. 1 groups.

    ``group_count`` counts items present in at least ``genomes_present`` groups. With
    ``as_fraction`` the limit is ceil((present / total) * total) in doubles, which for some
    totals from 25 on is one more.
    """
    held = presence.groupBy("set_id", "ref_item").agg(F.sum("present").cast("long").alias("k"))
    total = presence.groupBy("set_id").agg(F.count_distinct("grp").alias("genomes_total"))
    rows = total.select("set_id", "genomes_total", F.explode(F.sequence(F.lit(1).cast("long"), "genomes_total")).alias("genomes_present"))
    exact = F.ceil((F.col("genomes_present") / F.col("genomes_total")) * F.col("genomes_total")).cast("long")
    need = F.least(exact, F.col("genomes_total")) if as_fraction else F.col("genomes_present")
    upto = Window.partitionBy("set_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    by_k = held.groupBy("set_id", "k").agg(F.count("*").alias("c")).join(total, "set_id")
    every = rows.select("set_id", F.col("genomes_present").alias("k")).join(by_k.select("set_id", "k", "c"), ["set_id", "k"], "left")
    running = every.select("set_id", F.col("k").alias("need"), F.sum(F.coalesce("c", F.lit(0))).over(upto).alias("group_count"))
    return rows.withColumn("need", need).join(running, ["set_id", "need"]).select(
        "set_id",
        "genomes_present",
        "genomes_total",
        F.round(F.col("genomes_present") * 100.0 / F.col("genomes_total"), 1).alias("percent"),
        "group_count",
    )


def soft_core_at(presence: DataFrame, fraction: float) -> DataFrame:
    """(set_id, group_count): items present in at least ceil(fraction * n) groups; all groups if fraction >= 1."""
    n = F.count_distinct("grp")
    total = presence.groupBy("set_id").agg(n.alias("n"))
    need = F.col("n") if fraction >= 1 else F.ceil(F.lit(float(fraction)) * F.col("n"))
    held = presence.groupBy("set_id", "ref_item").agg(F.sum("present").alias("k")).join(total, "set_id")
    return held.groupBy("set_id").agg(F.count_if(F.col("k") >= need).alias("group_count"))


def ortholog_groups(core: DataFrame) -> DataFrame:
    """(set_id, subset_id, group_no, label, item): core items of the anchor numbered from 0, labels of equal width."""
    order = Window.partitionBy(*SUB).orderBy("item")
    out = core.withColumn("group_no", (F.row_number().over(order) - 1).cast("long"))
    last = F.length(F.max("group_no").over(Window.partitionBy(*SUB)).cast("string"))
    return out.withColumn("label", F.lpad(F.col("group_no").cast("string"), last, F.lit("0"))).select(*SUB, "group_no", "label", "item", "ref")


def core_table(groups: DataFrame, partner: DataFrame, subset: DataFrame) -> DataFrame:
    """(set_id, subset_id, group_no, grp, item): the mates of each ortholog group, the anchor's item among them."""
    own = groups.select(*SUB, "group_no", F.col("ref").alias("grp"), "item")
    mates = (
        groups.join(partner.select("set_id", "item", "other", "mate"), ["set_id", "item"])
        .join(subset.select(*SUB, F.col("grp").alias("other")), [*SUB, "other"])
        .select(*SUB, "group_no", F.col("other").alias("grp"), F.col("mate").alias("item"))
    )
    return own.unionByName(mates)


def group_members(groups: DataFrame, partner: DataFrame, subset: DataFrame) -> DataFrame:
    """(set_id, subset_id, group_no, grp, item): every group of the subset; null where an item has no mate."""
    grid = groups.select(*SUB, "group_no").join(subset, SUB)
    return grid.join(core_table(groups, partner, subset), [*SUB, "group_no", "grp"], "left").select(*SUB, "group_no", "grp", "item")


def leave_one_out(full: DataFrame, each: DataFrame) -> DataFrame:
    """(set_id, excluded, core_size, change) of core sizes with and without each group."""
    base = full.select("set_id", F.col("core_size").alias("baseline"))
    return each.join(base, "set_id").select(
        "set_id", F.col("subset_id").alias("excluded"), "core_size", (F.col("core_size") - F.col("baseline")).alias("change"), "baseline"
    )


def greedy_step(partner: DataFrame, items: DataFrame, groups: DataFrame, ref: DataFrame) -> DataFrame:
    """(set_id, candidate, core_size): the anchor's core if ``candidate`` were left out, the anchor kept.

    It counts the items that are complete, and those whose one missing group is the candidate.
    """
    p = presence(partner, items, groups, ref)
    lack = p.groupBy("set_id", "ref_item").agg(F.count_if(F.col("present") == 0).alias("missing"), F.min(F.when(F.col("present") == 0, F.col("grp"))).alias("one"))
    complete = lack.groupBy("set_id").agg(F.count_if(F.col("missing") == 0).alias("complete"))
    short = lack.where("missing = 1").groupBy("set_id", F.col("one").alias("grp")).agg(F.count("*").alias("gain"))
    others = groups.join(ref.select("set_id", F.col("ref").alias("grp")), ["set_id", "grp"], "left_anti")
    return others.join(short, ["set_id", "grp"], "left").join(complete, "set_id", "left").select(
        "set_id", F.col("grp").alias("candidate"), (F.coalesce("complete", F.lit(0)) + F.coalesce("gain", F.lit(0))).alias("core_size")
    )
