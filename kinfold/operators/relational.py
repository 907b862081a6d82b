"""Selection, deduplication, upsert and roll-up operators of a survey over many sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first in ``order`` (which should be total)."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def rank_of(value: Column, ranked: list[str]) -> Column:
    """Place of a value in a preference list; values outside come last."""
    out = F.lit(len(ranked))
    for k in reversed(range(len(ranked))):
        out = F.when(value == ranked[k], k).otherwise(out)
    return out


def first_with_exception(df: DataFrame, key: str, keep_all: Column, unique: str, order: list) -> DataFrame:
    """One row of each key, but every row where ``keep_all`` holds."""
    own = F.when(keep_all, F.col(unique).cast("string"))
    rows = df.withColumn("_own", F.coalesce(own, F.lit("")))
    return first_by(rows, [key, "_own"], order).drop("_own")


def having_count(df: DataFrame, keys: list[str], least: int, most: int | None = None, distinct: str | None = None) -> DataFrame:
    """(keys, n) of keys with at least ``least`` (and at most ``most``) rows, or distinct values."""
    n = F.count_distinct(distinct) if distinct else F.count("*")
    out = df.groupBy(*keys).agg(n.alias("n")).where(F.col("n") >= least)
    return out if most is None else out.where(F.col("n") <= most)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return having_count(df, [key], 2)


def missing_ids(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` in place of the old rows of its keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def clashes(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return new.join(known.select(key).distinct(), key, "left_semi")


def taxonomy_lookup(members: DataFrame, taxonomy: DataFrame, key: str, taxon: str) -> tuple[DataFrame, DataFrame]:
    """(members with a class, (unmatched) count of those without)."""
    x = members.join(taxonomy, key, "left")
    return x.where(F.col(taxon).isNotNull()), x.agg(F.count_if(F.col(taxon).isNull()).alias("unmatched"))


def level_pivot(df: DataFrame, key: str, level: str, levels: list[str]) -> DataFrame:
    """One row a key with a count for each level and one for all others."""
    known = [F.count_if(F.col(level) == v).alias(f"n_{v.lower().replace(' ', '_').replace('-', '_')}") for v in levels]
    other = F.count_if(~F.coalesce(F.col(level).isin(levels), F.lit(False)))
    return df.groupBy(key).agg(*known, other.alias("n_other"), F.count("*").alias("n"))


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, lowest, median, highest): the median is element n div 2 of the sorted values, counted from 0.

    Ranks come from a window sorted on disk, so no group is gathered in one cell.
    """
    w = Window.partitionBy(key).orderBy(value)
    x = df.where(F.col(value).isNotNull()).select(key, value, (F.row_number().over(w) - 1).alias("k"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    return x.groupBy(key).agg(
        F.min(value).alias("lowest"), F.max(F.when(F.expr("k = n div 2"), F.col(value))).alias("median"), F.max(value).alias("highest")
    )


def batches(df: DataFrame, order: list, size: int) -> DataFrame:
    """``batch`` number of rows in order, ``size`` a batch.

    Rows are numbered within range partitions and shifted by the rows of earlier partitions,
    so no single task holds them all.
    """
    from kinfold.operators.numbering import numbered

    return numbered(df, order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def aai_rollup(aai: DataFrame) -> DataFrame:
    """(set_id, pairs, min_aai, mean_aai, pairs_95): of the pairs that share items."""
    return aai.groupBy("set_id").agg(
        F.count("aai").alias("pairs"), F.min("aai").alias("min_aai"), F.avg("aai").alias("mean_aai"), F.count_if(F.col("aai") >= 95).alias("pairs_95")
    )


def boundary_flags(aai: DataFrame, limits: tuple[float, ...], tolerance: float = 1e-9, decimals: int = 2) -> DataFrame:
    """Pairs whose rounded value is a limit, give or take ``tolerance``."""
    at = F.explode(F.array(*[F.lit(float(x)) for x in limits]))
    return aai.withColumn("boundary", at).where(F.abs(F.round("aai", decimals) - F.col("boundary")) < tolerance)


def pocp(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """(set_id, ga, gb, conserved, items, pocp) of all group pairs of each set: (C_ab + C_ba) / (T_a + T_b) * 100; 100 on the diagonal.

    hits: (set_id, ga, gb, item) of items of ga conserved in gb, repeats allowed; totals: (set_id, g, total).
    """
    c = hits.where("ga <> gb").groupBy("set_id", "ga", "gb").agg(F.count_distinct("item").alias("c"))
    low, high = F.least("ga", "gb"), F.greatest("ga", "gb")
    return pocp_matrix(c.groupBy("set_id", low.alias("ga"), high.alias("gb")).agg(F.sum("c").alias("conserved")), totals)


def pocp_of_shared(items: DataFrame) -> DataFrame:
    """``pocp`` where an item is conserved in the groups that hold the very same item. items: (set_id, grp, item), repeats allowed.

    Items that the same groups hold are counted first, so that group pairs are made once for each such
    combination and not once for each item; a list holds groups of one set, never items.
    """
    held = items.groupBy("set_id", "item").agg(F.sort_array(F.collect_set("grp")).alias("groups"))
    alike = held.groupBy("set_id", "groups").agg(F.count("*").alias("n"))
    totals = alike.select("set_id", "n", F.explode("groups").alias("g")).groupBy("set_id", "g").agg(F.sum("n").alias("total"))
    first = alike.where(F.size("groups") > 1).select("set_id", "n", "groups", F.posexplode("groups").alias("at", "ga"))
    pairs = first.select("set_id", "n", "ga", F.explode(F.slice("groups", F.col("at") + 2, F.size("groups"))).alias("gb"))
    return pocp_matrix(pairs.groupBy("set_id", "ga", "gb").agg((2 * F.sum("n")).alias("conserved")), totals)


def pocp_matrix(half: DataFrame, totals: DataFrame) -> DataFrame:
    """All ordered pairs from the conserved items of pairs ga < gb (both directions summed) and each group's total."""
    a = totals.select("set_id", F.col("g").alias("ga"), F.col("total").alias("ta"))
    b = totals.select("set_id", F.col("g").alias("gb"), F.col("total").alias("tb"))
    grid = a.join(b, "set_id").where("ga < gb")  # pairs of one set, as the result has
    x = grid.join(half, ["set_id", "ga", "gb"], "left").select("set_id", "ga", "gb", F.coalesce("conserved", F.lit(0)).cast("long").alias("conserved"), (F.col("ta") + F.col("tb")).alias("items"))
    x = x.withColumn("pocp", F.try_divide(F.col("conserved") * 100.0, F.col("items")))
    swap = x.select("set_id", F.col("gb").alias("ga"), F.col("ga").alias("gb"), "conserved", "items", "pocp")
    same = a.select("set_id", "ga", F.col("ga").alias("gb"), (2 * F.col("ta")).alias("conserved"), (2 * F.col("ta")).alias("items"), F.lit(100.0).alias("pocp"))
    return x.unionByName(swap).unionByName(same)


def supermatrix(parts: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, joined): the values of each key, joined in order."""
    x = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(x, lambda p: p["v"]), "").alias("joined"))


def transposed(parts: DataFrame, row: str, col: str, value: str, expected: DataFrame) -> DataFrame:
    """(row, cells, n, complete): one row's values in the order of ``col``, and whether all of ``expected`` are there."""
    x = F.array_sort(F.collect_list(F.struct(F.col(col).alias("c"), F.col(value).alias("v"))))
    want = expected.agg(F.count_distinct(col).alias("want"))
    g = parts.groupBy(row).agg(F.transform(x, lambda p: p["v"]).alias("cells"), F.count_distinct(col).alias("n"))
    return g.join(F.broadcast(want)).select(row, "cells", "n", (F.col("n") == F.col("want")).alias("complete"))


def split_recombinant(groups: DataFrame, tests: DataFrame, key: str, alpha: float) -> DataFrame:
    """``groups`` with ``recombinant``: p < alpha; groups without a test or a value aren't."""
    return groups.join(tests.select(key, "p"), key, "left").withColumn("recombinant", F.coalesce(F.col("p") < alpha, F.lit(False)))


def without_recombinant(groups: DataFrame, tests: DataFrame, key: str, alpha: float) -> DataFrame:
    """The groups that aren't recombinant; fails if all are, as nothing is left to go on with."""
    split = split_recombinant(groups, tests, key, alpha)
    n, flagged = split.agg(F.count("*"), F.count_if("recombinant")).first()
    if n and n == flagged:
        raise ValueError(f"all {n} groups were flagged as recombinant at alpha {alpha}; take a stricter one")
    return split.where("not recombinant").drop("recombinant")


def homologs_strict(hits: DataFrame, n_groups: DataFrame, min_identity: float) -> DataFrame:
    """Items hit by every other group at ``min_identity`` or more."""
    k = hits.where(F.col("pident") >= min_identity).groupBy("set_id", "s", "gs").agg(F.count_distinct("gq").alias("k"))
    return k.join(n_groups, "set_id").where("k = n - 1").select("set_id", F.col("s").alias("item"), F.col("gs").alias("grp"))


def reuse_index(listing: DataFrame, key: str, preference: list) -> DataFrame:
    """One local copy of each key: the first in the order of preference."""
    return first_by(listing, [key], preference)


def status_counts(df: DataFrame, status: str, states: list[str]) -> DataFrame:
    """One row of counters, one a state."""
    return df.agg(*[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in states], F.count("*").alias("n"))


def side_by_side(labels: DataFrame, key: str, column: str, columns: list) -> DataFrame:
    """One row a key, one column a bin with the bin's number of members; '' where it has none. Rows by name, whatever the case."""
    wide = labels.groupBy(key).pivot(column, columns).agg(F.count(F.lit(1)).cast("string"))
    return wide.select(key, *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(f"bin_{c}") for c in columns]).orderBy(F.lower(key), key)
