"""From similarity hits to reciprocal best matches and the mean identity of group pairs.

Frames are long and sparse; a missing pair is a missing row, a missing value null. Every
frame leads with ``set_id``, so one plan serves thousands of sets.

    item      set_id, item, grp
    hit       set_id, q, s, gq, gs, pident, score [, gapopen, evalue, length, qlen, slen]
    best      set_id, q, gq, gs, s, pident      the best hit of an item in another group
    rbh       set_id, ga, gb, l, r, ident       ga < gb
    partner   set_id, item, grp, other, mate    both directions, identity-filtered
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_groups(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Look up the groups of both sides; hits of unknown items go."""
    side = lambda name, g: items.select("set_id", F.col("item").alias(name), F.col("grp").alias(g))
    return hits.join(side("q", "gq"), ["set_id", "q"]).join(side("s", "gs"), ["set_id", "s"])


def hit_filter(
    hits: DataFrame, max_gapopen: int | None = None, max_evalue: float | None = None, min_coverage: float = 0.0
) -> DataFrame:
    """Hits between groups within the limits: gap openings <=, e-value <, coverage of both sides >= if asked for.

    Identity is not filtered here; that would bias the mean identity.
    """
    out = hits.where("gq <> gs")
    if max_gapopen is not None:
        out = out.where(F.col("gapopen") <= max_gapopen)
    if max_evalue is not None:
        out = out.where(F.col("evalue") < max_evalue)
    if min_coverage > 0:
        least = F.least(F.try_divide("length", "qlen"), F.try_divide("length", "slen"))
        both = F.col("qlen").isNotNull() & F.col("slen").isNotNull() & (F.col("qlen") > 0) & (F.col("slen") > 0)
        out = out.where(both & (least >= min_coverage))
    return out


def hit_counts(hits: DataFrame, kept: DataFrame) -> DataFrame:
    """(set_id, examined, kept)."""
    n = hits.groupBy("set_id").agg(F.count("*").alias("examined"))
    k = kept.groupBy("set_id").agg(F.count("*").alias("kept"))
    return n.join(k, "set_id", "left").select("set_id", "examined", F.coalesce("kept", F.lit(0)).alias("kept"))


def best_hits(kept: DataFrame, tie: str = "s") -> DataFrame:
    """One hit for each item and other group: the highest score above 0; equal scores: the least ``tie``."""
    order = Window.partitionBy("set_id", "q", "gs").orderBy(F.desc("score"), tie, "s")
    return (
        kept.where("score > 0")
        .withColumn("n", F.row_number().over(order))
        .where("n = 1")
        .select("set_id", "q", "gq", "gs", "s", "pident")
    )


def top_k(kept: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest-scored hits of each item."""
    order = Window.partitionBy("set_id", "q").orderBy(F.desc("score"), "s")
    return kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def hit_from(kept: DataFrame) -> DataFrame:
    """(set_id, item, grp, other): items that some item of another group hits."""
    return kept.select("set_id", F.col("s").alias("item"), F.col("gs").alias("grp"), F.col("gq").alias("other")).distinct()


def reciprocal(best: DataFrame) -> DataFrame:
    """Pairs that are each other's best hit; identity is the mean of both directions."""
    x = best.where("gq < gs").select("set_id", F.col("gq").alias("ga"), F.col("gs").alias("gb"), F.col("q").alias("l"), F.col("s").alias("r"), F.col("pident").alias("p1"))
    y = best.where("gq > gs").select("set_id", F.col("s").alias("l"), F.col("q").alias("r"), F.col("pident").alias("p2"))
    return x.join(y, ["set_id", "l", "r"]).select("set_id", "ga", "gb", "l", "r", ((F.col("p1") + F.col("p2")) / 2).alias("ident"))


def strong(rbh: DataFrame, min_identity: float) -> DataFrame:
    return rbh.where(F.col("ident") >= min_identity)


def partners(rbh: DataFrame) -> DataFrame:
    """Both directions of reciprocal pairs."""
    a = rbh.select("set_id", F.col("l").alias("item"), F.col("ga").alias("grp"), F.col("gb").alias("other"), F.col("r").alias("mate"))
    b = rbh.select("set_id", F.col("r").alias("item"), F.col("gb").alias("grp"), F.col("ga").alias("other"), F.col("l").alias("mate"))
    return a.unionByName(b)


def mean_identity(rbh: DataFrame) -> DataFrame:
    """(set_id, ga, gb, aai, shared) over all reciprocal pairs, whatever their identity: one hash aggregate."""
    return rbh.groupBy("set_id", "ga", "gb").agg(F.avg("ident").alias("aai"), F.count("*").alias("shared"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """(set_id, ga, gb) with ga < gb: an equi-join on the set, so pairs of one set only."""
    a = groups.select("set_id", F.col("grp").alias("ga"))
    b = groups.select("set_id", F.col("grp").alias("gb"))
    return a.join(b, "set_id").where("ga < gb")


def aai_matrix(aai: DataFrame, groups: DataFrame) -> DataFrame:
    """All ordered pairs with the diagonal: aai 100 and shared 0 there, null and 0 where no pair is shared."""
    half = group_pairs(groups).join(aai, ["set_id", "ga", "gb"], "left")
    half = half.select("set_id", "ga", "gb", "aai", F.coalesce("shared", F.lit(0)).alias("shared"))
    swap = half.select("set_id", F.col("gb").alias("ga"), F.col("ga").alias("gb"), "aai", "shared")
    same = groups.select("set_id", F.col("grp").alias("ga"), F.col("grp").alias("gb"), F.lit(100.0).alias("aai"), F.lit(0).cast("long").alias("shared"))
    return half.unionByName(swap).unionByName(same)


def nearest(matrix: DataFrame) -> DataFrame:
    """(set_id, grp, nearest, aai, shared): the highest identity, least group on ties; nulls and 0 without any."""
    order = Window.partitionBy("set_id", "ga").orderBy(F.desc_nulls_last("aai"), "gb")
    some = F.col("aai").isNotNull()
    return (
        matrix.where("ga <> gb")
        .withColumn("n", F.row_number().over(order))
        .where("n = 1")
        .select("set_id", F.col("ga").alias("grp"), F.when(some, F.col("gb")).alias("nearest"), "aai", F.when(some, F.col("shared")).otherwise(0).alias("shared"))
    )
