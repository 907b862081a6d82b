"""Bootstrap intervals against plain resampling of rows, and rules that end a run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import scalars
from kinfold.operators import core, evaluation, iterative, relational
from kinfold.sources import tables


def kappa(tp, fp, fn, tn):
    n = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / n**2
    return ((tp + tn) / n - chance) / (1 - chance) if chance != 1 else None


def test_kappa_interval(spark):
    cells = [("all", 140, 60, 215, 732), ("few", 9, 3, 2, 6), ("none", 0, 0, 0, 0), ("sure", 0, 0, 0, 8), (None, 5, 5, 5, 5)]
    df = spark.createDataFrame(cells, "domain string, tp long, fp long, fn long, tn long")
    got = {r.domain: r for r in evaluation.kappa_interval(df, "domain").collect()}
    again = {r.domain: r for r in evaluation.kappa_interval(df.repartition(5), "domain", seed=20260829).collect()}
    assert got == again and set(got) == {c[0] for c in cells}
    rng = np.random.default_rng(1)
    for name, *counts in cells[:2]:
        rows = np.repeat(np.arange(4), counts)
        ks = sorted(k for _ in range(4000) if (k := kappa(*np.bincount(rng.choice(rows, len(rows)), minlength=4))) is not None)
        r = got[name]
        assert r.n == len(rows) and r.kappa == pytest.approx(kappa(*counts))
        # Both bounds have the deviation of an order statistic of 2,000 rounds.
        tolerance = 0.12 * (ks[int(0.975 * len(ks))] - ks[int(0.025 * len(ks))])
        assert abs(r.low - ks[int(0.025 * len(ks))]) < tolerance and abs(r.high - ks[int(0.975 * len(ks))]) < tolerance
    assert got["none"].kappa is None and got["none"].low is None and got["sure"].low is None
    other = {r.domain: r for r in evaluation.kappa_interval(df, "domain", seed=5).collect()}
    assert other["all"].low != got["all"].low


def test_bootstrap_median(spark):
    values = np.random.default_rng(2).normal(10, 3, 60).round(3)
    r = evaluation.bootstrap_median(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double"), "v", rounds=2000).first()
    rng = np.random.default_rng(3)
    medians = np.sort(np.median(rng.choice(values, (4000, 60)), axis=1))
    assert abs(r.low - medians[100]) < 0.5 and abs(r.high - medians[3900]) < 0.5 and r.low < np.median(values) < r.high


def test_rules_that_end_a_run(spark, tmp_path):
    groups = spark.createDataFrame([(1,), (2,), (3,)], "group_no long")
    tests = spark.createDataFrame([(1, 0.01), (2, 0.2), (3, None)], "group_no long, p double")
    assert [r.group_no for r in relational.without_recombinant(groups, tests, "group_no", 0.05).orderBy("group_no").collect()] == [2, 3]
    with pytest.raises(ValueError, match="all 3 groups"):
        relational.without_recombinant(groups, tests.withColumn("p", F.lit(0.0)), "group_no", 0.05)
    assert relational.without_recombinant(groups.where("false"), tests, "group_no", 0.05).count() == 0
    counts = spark.createDataFrame([(0, 0, 1, 5), (0, 0, 2, 3)], "set_id long, subset_id long, grp long, homologs long")
    names = spark.createDataFrame([(0, 1, "a"), (0, 2, "b")], "set_id long, grp long, name string")
    assert core.reference_with_homologs(counts, names).first().ref == 2
    with pytest.raises(ValueError, match=r"b \(set 0\)"):
        core.reference_with_homologs(counts.withColumn("homologs", F.col("homologs") - 3), names)
    (tmp_path / "t").write_text("GB_GCA_2.1\td__A;g__B;s__\n")
    absent = str(tmp_path / "absent")
    assert tables.read_taxonomy(spark, [str(tmp_path / "t"), absent]).count() == tables.read_taxonomy(spark, [absent, str(tmp_path / "t")]).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_taxonomy(spark, [absent])


def test_rounding_crossings(spark):
    aai = spark.createDataFrame([(0, 1, 2, 64.996), (0, 1, 3, 64.99), (0, 2, 3, 65.004), (0, 2, 4, None)], "set_id long, ga long, gb long, aai double")
    flags = relational.boundary_flags(aai, (65.0, 95.0))
    assert {(r.ga, r.gb) for r in flags.collect()} == {(1, 2), (2, 3)}
    assert tuple(evaluation.rounding_crossings(aai, (65.0, 95.0), flags).first()) == (6, 1, 0)
    assert tuple(evaluation.rounding_crossings(aai, (65.0, 95.0), flags.where("ga > 1")).first()) == (6, 1, 1)


def test_sign_test_of_many_coins(spark):
    """Against exact fractions, and in time that follows the number of coins: terms of a million were a million sums of as many logs."""
    from fractions import Fraction
    from math import comb

    cells = [(k, n) for n in (0, 1, 2, 7, 9, 40, 301) for k in {0, 1, n // 2, n // 2 + 1, n} if k <= n] + [(480, 1000), (1030, 2000), (2000, 2000)]
    one = lambda rows: spark.createDataFrame(rows, "k long, n long").withColumn("p", scalars.sign_test(F.col("k"), F.col("n"))).collect()
    for r in one(cells):
        assert r.p == pytest.approx(float(Fraction(sum(comb(r.n, x) for x in range(r.k, r.n + 1)), 2**r.n)), abs=1e-12)
    assert [round(r.p, 6) for r in one([(500500, 1000000), (1000, 1000000)])] == [0.158897, 1.0]


def test_sets_without_a_rejected_linkage(spark):
    """A set of one bin has a row of nulls, as the best of nothing; so has one that only missing pairs keep apart."""
    bins = spark.createDataFrame([(0, 1, 5), (0, 1, 6), (1, 1, 5), (1, 2, 6), (2, 1, 5), (2, 2, 6)], "set_id long, bin int, grp long")
    matrix = spark.createDataFrame([(0, 5, 6, 70.0), (1, 5, 6, 61.0), (2, 5, 6, None)], "set_id long, ga long, gb long, aai double")
    got = iterative.best_rejected_linkage(bins, matrix, 65.0).orderBy("set_id").collect()
    assert [tuple(r) for r in got] == [(0, None, None), (1, 61.0, 4.0), (2, None, None)]
