"""POCP of whole tables against sets of parts."""

import random

import pandas as pd
import pytest

from kinfold.operators import relational
from kinfold.plans import registry, survey_queries


def test_pocp_of_all_rows(spark, sf):
    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    l, s = (pd.read_parquet(f"{sf}/{name}.parquet") for name in ("lineitem", "supplier"))
    parts = l.merge(s, left_on="l_suppkey", right_on="s_suppkey").groupby("s_nationkey").l_partkey.agg(set)
    want = {(a, b): 100.0 if a == b else 200.0 * len(x & y) / (len(x) + len(y)) for a, x in parts.items() for b, y in parts.items()}
    got = {(r.ga, r.gb): r.pocp for r in survey_queries._pocp(t).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pocp_bins(spark, sf):
    """Complete linkage of the whole tables' POCP, by a plain loop over all pairs of bins."""
    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    p = {(r.ga, r.gb): r.pocp for r in survey_queries._pocp(t).collect()}
    bins = [[g] for g in sorted({a for a, _ in p})]
    while True:
        link = lambda x, y: min(p[a, b] for a in x for b in y)
        best = max(((link(x, y), -i, -j) for i, x in enumerate(bins) for j, y in enumerate(bins) if i < j), default=(0, 0, 0))
        if best[0] < 20:
            break
        i, j = -best[1], -best[2]
        bins[i] = sorted(bins[i] + bins.pop(j))
        bins.sort()
    want = {(k + 1, g) for k, b in enumerate(sorted(bins, key=lambda b: (-len(b), b[0]))) for g in b}
    assert {(r.bin, r.grp) for r in registry.QUERIES["pocp_bins"](spark, sf).collect()} == want
    assert 1 < len({g for _, g in want})


def test_pocp_of_hits_and_of_shared_items(spark):
    """Both forms over sets of uneven size, one of them a lone group."""
    random.seed(1)
    rows = [(k, g, random.randrange(40)) for k in range(12) for g in range(1 + k % 6) for _ in range(random.randrange(1, 3 + 10 * k))] + [(99, 7, 1), (99, 7, 1)]
    held = {}
    for k, g, i in rows:
        held.setdefault(k, {}).setdefault(g, set()).add(i)
    want = {
        (k, a, b): (2 * len(x & y), len(x) + len(y), 100.0 if a == b else 200.0 * len(x & y) / (len(x) + len(y)))
        for k, groups in held.items()
        for a, x in groups.items()
        for b, y in groups.items()
    }
    items = spark.createDataFrame(rows, "set_id long, grp long, item long")
    hits = [(k, a, b, i) for k, groups in held.items() for a, x in groups.items() for b, y in groups.items() for i in x & y if a != b]
    totals = spark.createDataFrame([(k, g, len(x)) for k, groups in held.items() for g, x in groups.items()], "set_id long, g long, total long")
    for got in (relational.pocp_of_shared(items), relational.pocp(spark.createDataFrame(hits + hits[:5], "set_id long, ga long, gb long, item long"), totals)):
        assert {(r.set_id, r.ga, r.gb): (r.conserved, r["items"], pytest.approx(r.pocp)) for r in got.collect()} == want
