"""Partitions held against an outside classification, and checks of the engine's own results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.scalars import kappa, pairs_of, wilson


def contingency(labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(set_id, a, b, n) of two labelings of the same members."""
    return labels.groupBy("set_id", F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """(set_id, n, ari) of a contingency table; null for fewer than two members or no room for chance."""
    cells = table.groupBy("set_id").agg(F.sum("n").alias("n"), F.sum(pairs_of(F.col("n"))).alias("index"))
    side = lambda c: table.groupBy("set_id", c).agg(F.sum("n").alias("m")).groupBy("set_id").agg(F.sum(pairs_of(F.col("m"))).alias(f"s_{c}"))
    x = cells.join(side("a"), "set_id").join(side("b"), "set_id")
    expected = F.try_divide(F.col("s_a") * F.col("s_b"), pairs_of(F.col("n")))
    most = (F.col("s_a") + F.col("s_b")) / 2
    return x.select("set_id", "n", F.when(F.col("n") > 1, F.try_divide(F.col("index") - expected, most - expected)).alias("ari"))


def ari_band(ari: Column) -> Column:
    return (
        F.when(ari.isNull(), "undefined").when(ari >= 0.75, "strong").when(ari >= 0.40, "moderate").when(ari >= 0.10, "weak").otherwise("little or none")
    )


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str]) -> DataFrame:
    p, a = predicted, actual
    return df.groupBy(*by).agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn")
    )


def screen_metrics(c: DataFrame) -> DataFrame:
    """Precision, recall and specificity beside the counts; null where a denominator is 0."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return (
        c.withColumn("precision", F.try_divide(tp, tp + fp))
        .withColumn("recall", F.try_divide(tp, tp + fn))
        .withColumn("specificity", F.try_divide(tn, tn + fp))
    )


def with_intervals(c: DataFrame) -> DataFrame:
    """Kappa and the Wilson interval of precision beside the counts."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    low, high = wilson(tp, tp + fp)
    return c.withColumn("low", low).withColumn("high", high).withColumn("kappa", kappa(tp, fp, fn, tn))


def shares(df: DataFrame, label: Column) -> DataFrame:
    """(label, n, share) of each label among all rows."""
    g = df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    # One row a label: the window holds as many rows as there are labels.
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def dominant(df: DataFrame, key: str, taxon: str, least: int) -> DataFrame:
    """(key, n, taxa, real_taxa, dominant_pct): taxa of each key, those with ``least`` members, and the largest's share."""
    g = df.groupBy(key, taxon).agg(F.count("*").alias("c"))
    return g.groupBy(key).agg(
        F.sum("c").alias("n"),
        F.count("*").alias("taxa"),
        F.count_if(F.col("c") >= least).alias("real_taxa"),
        F.round(F.max("c") * 100.0 / F.sum("c"), 4).alias("dominant_pct"),
    )


def majority(df: DataFrame, key: str, taxon: str) -> DataFrame:
    """(key, taxon, c): the most frequent taxon of each key, least name on ties."""
    g = df.groupBy(key, taxon).agg(F.count("*").alias("c"))
    order = Window.partitionBy(key).orderBy(F.desc("c"), taxon)
    return g.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def db_agreement(labels: DataFrame) -> DataFrame:
    """(set_id, b, agrees): whether an outside class lies in one bin and that bin holds nothing else."""
    ab = labels.groupBy("set_id", "a", "b").agg(F.count("*").alias("n"))
    bins = ab.groupBy("set_id", "b").agg(F.count("*").alias("bins"), F.min("a").alias("a"))
    pure = ab.groupBy("set_id", "a").agg(F.count("*").alias("classes"))
    return bins.join(pure, ["set_id", "a"]).select("set_id", "b", ((F.col("bins") == 1) & (F.col("classes") == 1)).alias("agrees"))


def canonical(bins: DataFrame) -> DataFrame:
    """(set_id, members) of each bin as a sorted list."""
    return bins.groupBy("set_id", "bin").agg(F.array_sort(F.collect_set("grp")).alias("members")).select("set_id", "members")


def partition_equal(x: DataFrame, y: DataFrame) -> DataFrame:
    """(only_x, only_y): bins that the other partition lacks, both 0 for equal partitions."""
    a, b = canonical(x), canonical(y)
    n = lambda p, q, name: p.exceptAll(q).agg(F.count("*").alias(name))
    return n(a, b, "only_x").join(n(b, a, "only_y"))


def partition_valid(bins: DataFrame, groups: DataFrame) -> DataFrame:
    """(set_id, repeated, missing): both 0 for a true partition of the groups."""
    n = bins.groupBy("set_id", "grp").agg(F.count("*").alias("n"))
    x = groups.join(n, ["set_id", "grp"], "full")
    return x.groupBy("set_id").agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n").isNull()).alias("missing"))


def verify_linkage(pairs: DataFrame, threshold: float, tolerance: float = 1e-9) -> DataFrame:
    """(set_id, within, across): violations of complete linkage, from bin pairs with aai; a missing pair blocks."""
    aai = F.coalesce("aai", F.lit(-1e308))
    within = pairs.where("bin_a = bin_b").groupBy("set_id").agg(F.count_if(aai < threshold - tolerance).alias("within"))
    low, high = F.least("bin_a", "bin_b"), F.greatest("bin_a", "bin_b")
    link = pairs.where("bin_a <> bin_b").groupBy("set_id", low.alias("x"), high.alias("y")).agg(F.min(aai).alias("l"))
    across = link.groupBy("set_id").agg(F.count_if(F.col("l") >= threshold + tolerance).alias("across"))
    every = pairs.select("set_id").distinct()
    out = every.join(within, "set_id", "left").join(across, "set_id", "left")
    return out.select("set_id", F.coalesce("within", F.lit(0)).alias("within"), F.coalesce("across", F.lit(0)).alias("across"))


def verify_symmetry(matrix: DataFrame) -> DataFrame:
    """(set_id, asymmetric, diagonal): cells unlike their mirror, and diagonal cells other than 100."""
    m = matrix.select("set_id", F.col("gb").alias("ga"), F.col("ga").alias("gb"), F.col("aai").alias("mirror"))
    x = matrix.join(m, ["set_id", "ga", "gb"], "left")
    return x.groupBy("set_id").agg(
        F.count_if(~F.col("aai").eqNullSafe(F.col("mirror"))).alias("asymmetric"),
        F.count_if((F.col("ga") == F.col("gb")) & ~F.col("aai").eqNullSafe(F.lit(100.0))).alias("diagonal"),
    )


def max_abs_diff(x: DataFrame, y: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(cells, max_diff) of two tables' common keys."""
    b = y.select(*keys, F.col(value).alias("other"))
    return x.join(b, keys).agg(F.count("*").alias("cells"), F.max(F.abs(F.col(value) - F.col("other"))).alias("max_diff"))


def histogram(df: DataFrame, value: Column, low: float, high: float, width: float) -> DataFrame:
    """(bin_low, n, relative): counts of [low, low + width) ..., the last bin closed, relative to the largest."""
    last = round((high - low) / width) - 1
    b = F.least(F.floor((value - low) / width), F.lit(last))
    g = df.where((value >= low) & (value <= high)).groupBy(b.alias("b")).agg(F.count("*").alias("n"))
    # One row a bin: a fixed number.
    return g.select((F.lit(low) + F.col("b") * width).alias("bin_low"), "n", (F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1)))).alias("relative"))


def bootstrap_median(df: DataFrame, value: str, rounds: int = 5000, seed: int = 20260829) -> DataFrame:
    """(low, high) of the median's 95 per cent bootstrap interval.

    Rows carry an index; each round draws as many indices as there are rows by a hash of
    (seed, round, draw) and joins them back, so the draws are spread over the cluster and
    repeat with the seed.
    """
    # The statistic's input is one row a set, numbered by rank.
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    x = x.withColumn("k", F.row_number().over(Window.orderBy("v")) - 1)
    n = x.agg(F.count("*").alias("n"))
    draws = (
        df.sparkSession.range(rounds)
        .withColumnRenamed("id", "round")
        .join(F.broadcast(n.where("n > 0")))
        .select("round", "n", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("draw"))
        .select("round", F.pmod(F.xxhash64(F.lit(seed), "round", "draw"), "n").cast("int").alias("k"))
    )
    medians = draws.join(x, "k").groupBy("round").agg(F.median("v").alias("m"))
    place = F.row_number().over(Window.orderBy("m", "round")) - 1
    ranked = medians.withColumn("p", place)
    return ranked.agg(F.max(F.when(F.col("p") == int(0.025 * rounds), F.col("m"))).alias("low"), F.max(F.when(F.col("p") == int(0.975 * rounds), F.col("m"))).alias("high"))


def kappa_interval(cells: DataFrame, by: str, rounds: int = 2000, seed: int = 20260829) -> DataFrame:
    """(by, n, kappa, low, high): kappa and its 95 per cent bootstrap interval from (by, tp, fp, fn, tn).

    To draw n rows with replacement is to draw the four cells from a multinomial, so a round costs the same however many
    rows were counted. Each round of each key has a stream of random numbers of its own (seed, key, round): the
    result doesn't depend on partitions, and a lost task draws the same again. Rounds without a kappa don't count.
    """
    names = ["tp", "fp", "fn", "tn"]
    x = cells.select(F.col(by).alias("_key"), F.xxhash64(F.col(by)).alias("_h"), *[F.col(c).cast("long").alias(c) for c in names])
    each = x.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).repartition("_key", F.floor(F.col("_round") / 500))
    kind = cells.schema[by].dataType.simpleString()

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            drawn = np.zeros((len(f), 4), "i8")
            for i, (h, r, *counts) in enumerate(zip(f["_h"], f["_round"], *(f[c] for c in names))):
                n = sum(counts)
                if n:
                    rng = np.random.Generator(np.random.Philox(key=[np.uint64(h % (1 << 64)), np.uint64(seed * 1_000_003 + r)]))
                    drawn[i] = rng.multinomial(n, np.array(counts) / n)
            yield pd.DataFrame({"_key": f["_key"], **{c: drawn[:, k] for k, c in enumerate(names)}})

    def kappas(df: DataFrame) -> Column:
        return kappa(*(F.col(c) for c in names))

    values = each.mapInPandas(draw, f"_key {kind}, tp long, fp long, fn long, tn long")
    values = values.select("_key", kappas(values).alias("k")).where("k is not null and not isnan(k)")
    # At most ``rounds`` numbers a key.
    ranked = values.groupBy("_key").agg(F.sort_array(F.collect_list("k")).alias("k"))
    at = lambda share: F.get("k", F.floor(F.lit(share) * F.size("k")).cast("int"))
    bounds = ranked.select("_key", at(0.025).alias("low"), at(0.975).alias("high"))
    out = x.select("_key", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), kappas(x).alias("kappa")).join(bounds, "_key", "left")
    return out.withColumnRenamed("_key", by)


def rounding_crossings(aai: DataFrame, limits: tuple[float, ...], flagged: DataFrame, decimals: int = 2) -> DataFrame:
    """(pairs, crossings, unflagged): pairs that rounding takes over a limit, and those of them that ``flagged`` lacks (none, if it is right)."""
    at = F.explode(F.array(*[F.lit(float(x)) for x in limits]))
    x = aai.where("aai is not null").withColumn("boundary", at)
    x = x.withColumn("crosses", (F.col("aai") >= F.col("boundary")) != (F.round("aai", decimals) >= F.col("boundary")))
    known = flagged.select("set_id", "ga", "gb", "boundary", F.lit(True).alias("flag"))
    x = x.join(known, ["set_id", "ga", "gb", "boundary"], "left")
    return x.agg(F.count("*").alias("pairs"), F.count_if("crosses").alias("crossings"), F.count_if(F.col("crosses") & F.col("flag").isNull()).alias("unflagged"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """(set_id, threshold, ari, exact_low, exact_high): the lowest threshold of the best index, and where it is 1.

    sweep: (set_id, threshold, ari); null indices don't count.
    """
    best = F.max(F.when(F.col("ari").isNotNull(), F.struct("ari", (-F.col("threshold")).alias("t"))))
    exact = F.when(F.col("ari") >= 1 - 1e-12, F.col("threshold"))
    x = sweep.groupBy("set_id").agg(best.alias("b"), F.min(exact).alias("exact_low"), F.max(exact).alias("exact_high"))
    return x.select("set_id", (-F.col("b.t")).alias("threshold"), F.col("b.ari").alias("ari"), "exact_low", "exact_high")


def window_spread(windows: DataFrame, fixed: float) -> DataFrame:
    """(n, spread, recoverable_pct): how far the windows' middles lie apart, and how many hold one fixed threshold.

    windows: (exact_low, exact_high), null where no threshold is exact.
    """
    mid = (F.col("exact_low") + F.col("exact_high")) / 2
    held = F.count_if(F.col("exact_low").isNotNull() & F.lit(fixed).between(F.col("exact_low"), F.col("exact_high")))
    return windows.agg(F.count(mid).alias("n"), (F.max(mid) - F.min(mid)).alias("spread"), (held * 100.0 / F.count("*")).alias("recoverable_pct"))


def predictions(values: DataFrame, expected: list[tuple[str, str, float]]) -> DataFrame:
    """(name, value, holds) of registered comparisons (name, '<' or '>=', limit) with scalar results (name, value)."""
    want = values.sparkSession.createDataFrame(expected, "name string, op string, bound double")
    ok = F.when(F.col("op") == "<", F.col("value") < F.col("bound")).otherwise(F.col("value") >= F.col("bound"))
    return values.join(F.broadcast(want), "name").select("name", "value", ok.alias("holds"))
