"""Matches, core sets and diagnostics on a hand-made set, each rule against its case."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinfold.functions import scalars
from kinfold.operators import core, iterative, orthology
from kinfold.plans.screen import Screen, Settings

HIT = "set_id long, q long, s long, gq long, gs long, pident double, score double, gapopen int, evalue double, length int, qlen int, slen int"


def hits(spark, rows):
    """rows: (q, s, pident, score); an item's group is its hundreds."""
    full = [(0, q, s, q // 100, s // 100, float(p), float(b), 0, 0.0, 100, 100, 100) for q, s, p, b in rows]
    return spark.createDataFrame(full, HIT)


def items(spark, ids):
    return spark.createDataFrame([(0, i, i // 100) for i in ids], "set_id long, item long, grp long")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_filter_limits(spark):
    base = dict(set_id=0, q=1, s=101, gq=0, gs=1, pident=50.0, score=1.0, gapopen=3, evalue=1e-6, length=50, qlen=100, slen=100)
    cases = {
        "at the limits": base,
        "gaps over": {**base, "gapopen": 4},
        "e-value at its limit": {**base, "evalue": 1e-5},
        "one side covered": {**base, "slen": 101},
        "same group": {**base, "gs": 0},
        "no length": {**base, "qlen": 0},
        "null length": {**base, "slen": None},
    }
    df = spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in HIT.split(", ")) for r in cases.values()], HIT)
    assert orthology.hit_filter(df, 3, 1e-5, 0.5).count() == 1
    # Without a least coverage, lengths don't matter.
    assert orthology.hit_filter(df, 3, 1e-5).count() == 4


def test_best_hit_ties_and_zero(spark):
    df = hits(spark, [(1, 102, 50, 7), (1, 101, 40, 7), (1, 201, 90, 0), (2, 101, 50, 3)])
    assert rows(orthology.best_hits(df), "q", "s") == [(1, 101), (2, 101)]
    # A hit without a score still counts as a hit.
    assert (201, 2, 0) in rows(orthology.hit_from(df), "item", "grp", "other")


def test_reciprocal_and_identity(spark):
    df = hits(spark, [(1, 101, 50, 9), (101, 1, 70, 9), (2, 101, 90, 8), (3, 102, 58, 5), (102, 3, 60, 5)])
    s = Screen(items(spark, [1, 2, 3, 101, 102]), df, Settings(min_identity=60))
    assert rows(s.rbh, "l", "r", "ident") == [(1, 101, 60.0), (3, 102, 59.0)]
    assert rows(s.partner, "item", "mate") == [(1, 101), (101, 1)]  # at the threshold counts, under it not
    assert rows(s.aai, "ga", "gb", "aai", "shared") == [(0, 1, 59.5, 2)]  # identity isn't filtered here


def brute_core(partner, own, subset, ref):
    need = set(subset) - {ref}
    return sum(need <= {o for i, o in partner if i == x} for x in own[ref])


@pytest.fixture(scope="module")
def made(spark):
    """Five groups of six items; item k of a group matches item k elsewhere unless a rule drops it."""
    ids = [100 * g + k for g in range(5) for k in range(6)]
    pairs = []
    for a, b in itertools.permutations(ids, 2):
        if a // 100 != b // 100 and a % 100 == b % 100 and (a * 7 + b * 7 + a % 100) % 5:
            pairs.append((a, b, 70, 9))
    return Screen(items(spark, ids), hits(spark, pairs)), ids, pairs


def test_core_family(spark, made):
    s, ids, pairs = made
    own = {g: [i for i in ids if i // 100 == g] for g in range(5)}
    hit = {(b, a // 100) for a, b, *_ in pairs}
    mate = {(a, b // 100) for a, b, *_ in pairs if (b, a) in {(x, y) for x, y, *_ in pairs}}

    def homologs(g, subset):
        return sum(set(subset) - {g} <= {o for i, o in hit if i == x} for x in own[g]) if len(subset) > 1 else 0

    def anchor(subset):
        return min(subset, key=lambda g: (homologs(g, subset), str(g)))

    full = list(range(5))
    assert dict(rows(s.counts, "grp", "homologs")) == {g: homologs(g, full) for g in full}
    ref = s.ref.first().ref
    assert ref == anchor(full)
    assert s.core.count() == brute_core(mate, own, full, ref)
    loo = {r.excluded: r.core_size for r in s.leave_one_out.collect()}
    for x in full:
        rest = [g for g in full if g != x]
        assert loo[x] == brute_core(mate, own, rest, anchor(rest))
    lone = spark.createDataFrame([(0, 7, 3)], "set_id long, subset_id long, grp long")
    assert s.core_of(lone).first().core_size == 6  # a lone group's core is all its items
    # Greedy removal never takes the anchor and chooses the anchor anew.
    left, want = set(full), []
    r = anchor(left)
    want.append((5, brute_core(mate, own, left, r), None))
    while len(left) > 2:
        best = max(sorted(left - {r}), key=lambda g: brute_core(mate, own, left - {g}, r))
        left = left - {best}
        r = anchor(left)
        want.append((len(left), brute_core(mate, own, left, r), best))
    got = [(x.retained, x.core_size, x.removed) for x in iterative.greedy_removal(s.hit_from, s.partner, s.items, s.names).orderBy(F.desc("retained")).collect()]
    assert got == want
    step = {x.candidate: x.core_size for x in core.greedy_step(s.partner, s.items, s.groups, s.ref).collect()}
    assert ref not in step and all(v == brute_core(mate, own, set(full) - {g}, ref) for g, v in step.items())
    curve = {x.genomes_present: x.group_count for x in core.soft_core_curve(s.presence).collect()}
    present = {i: 1 + len({o for x, o in mate if x == i}) for i in own[ref]}
    assert curve == {k: sum(v >= k for v in present.values()) for k in range(1, 6)}


def test_two_groups_have_no_leave_one_out(spark):
    s = Screen(items(spark, [1, 101]), hits(spark, [(1, 101, 70, 9), (101, 1, 70, 9)]))
    assert s.leave_one_out.count() == 0
    assert s.speciation.count() == 2


def test_soft_core_rounding(spark):
    cells = [(0, i, g, int(g < i)) for i in range(1, 26) for g in range(25)]
    p = spark.createDataFrame(cells, "set_id long, ref_item long, grp long, present int")
    exact = {r.genomes_present: r.group_count for r in core.soft_core_curve(p).collect()}
    asked = {r.genomes_present: r.group_count for r in core.soft_core_curve(p, as_fraction=True).collect()}
    assert exact[7] == 19 and asked[7] == 18 and exact[14] == 12 and asked[14] == 11 and exact[10] == asked[10]


def test_clustering_rules():
    f = iterative.agglomerate
    assert f([1, 2, 3], {(1, 2): 70.0, (2, 3): 70.0, (1, 3): 60.0}, 65)[0] == [[1, 2], [3]]  # first of tied pairs
    assert f([1, 2], {(1, 2): 65.0}, 65)[0] == [[1, 2]]  # at the threshold
    assert f([1, 2, 3], {(1, 2): 80.0, (2, 3): 80.0}, 65)[0] == [[1, 2], [3]]  # a missing pair blocks
    assert f([1, 2, 3], {}, float("-inf"))[0] == [[1], [2], [3]]  # and ends
    bins, trace = f([4, 7, 9], {(4, 7): 90.0, (4, 9): 70.0, (7, 9): 66.0}, 65)
    assert bins == [[4, 7, 9]] and trace == [(90.0, [4], [7]), (66.0, [4, 7], [9])]


def test_ladders(spark):
    df = spark.createDataFrame([(95.0,), (80.0,), (65.0,), (64.99,), (None,)], "a double")
    got = [r[0] for r in df.select(scalars.classify_pair(F.col("a"))).collect()]
    assert got == ["same species", "same genus, different species", "same genus, divergent", "likely different genus", "no orthologs"]
    v = lambda a, g: scalars.verdict(F.lit(a).cast("double"), F.lit(g), F.lit(5), F.lit(3))
    r = spark.range(1).select(v(None, 5), v(64.0, 5), v(70.0, 5), v(70.0, 4), v(94.0, 4), v(95.0, 5)).first()
    assert [*r] == [
        "CANDIDATE NOVEL TAXON", "CANDIDATE NOVEL TAXON", "REVIEW - collapses the shared core",
        "distinct species within the genus", "distinct species", "consistent with the group",
    ]


def test_one_to_one(spark):
    df = hits(spark, [(1, 101, 0, 9), (2, 101, 0, 8), (2, 102, 0, 7), (1, 102, 0, 8.5), (3, 101, 0, 1)])
    assert rows(iterative.one_to_one(df), "q", "s") == [(1, 101), (2, 102)]


def test_one_to_one_of_random_hits(spark):
    """Rounds of mutually first hits end where taking hits one by one does, with ties and chains."""
    rng = random.Random(3)
    made = [(k, a, b, a * 1000 + rng.randrange(9), b * 1000 + rng.randrange(9), float(rng.randrange(6))) for k in range(2) for a in range(3) for b in range(3) if a != b for _ in range(40)]
    made += [(5, 0, 1, i, 1000 + i + d, float(50 - 2 * i - d)) for i in range(20) for d in (0, 1)]  # each hit waits for the one before
    made = [(k, q, s, gq, gs, v, v) for (k, gq, gs, q, s), v in {(k, a, b, q, s): v for k, a, b, q, s, v in made}.items()]
    want = set()
    for key in {(k, gq, gs) for k, _, _, gq, gs, _, _ in made}:
        left, right = set(), set()
        for k, q, s, gq, gs, _, v in sorted((x for x in made if (x[0], x[3], x[4]) == key), key=lambda x: (-x[6], x[1], x[2])):
            if q not in left and s not in right:
                left.add(q)
                right.add(s)
                want.add((k, gq, gs, q, s, v))
    df = spark.createDataFrame(made, "set_id long, q long, s long, gq long, gs long, pident double, score double")
    assert {tuple(r) for r in iterative.one_to_one(df).collect()} == want
    assert iterative.one_to_one(df.where("false")).count() == 0


def test_settings():
    for bad in ({"min_identity": 101}, {"bin_aai": 0}, {"min_coverage": 2}, {"max_gapopen": -1}, {"max_evalue": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)


# Published mean identities of five groups (fixed values), in the order of their names.
GOLDEN = """
100.00 64.70 62.42 62.78 63.11
64.70 100.00 71.64 72.01 71.02
62.42 71.64 100.00 75.86 77.89
62.78 72.01 75.86 100.00 74.72
63.11 71.02 77.89 74.72 100.00
"""


def test_published_bins(spark):
    m = [[*map(float, x.split())] for x in GOLDEN.strip().splitlines()]
    cells = spark.createDataFrame([(0, a, b, m[a][b]) for a in range(5) for b in range(5)], "set_id long, ga long, gb long, aai double")
    b = iterative.bins(cells, [65.0])
    assert rows(b, "bin", "grp") == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 0)]
    inside = iterative.bin_pairs(b, cells).where("bin_a = bin_b").agg(F.round(F.min("aai"), 2), F.round(F.avg("aai"), 2)).first()
    assert [*inside] == [71.02, 73.86]
    # The two bins' farthest pair, under the threshold.
    best = iterative.best_rejected_linkage(b, cells, 65.0).first()
    assert (round(best.linkage, 2), round(best.margin, 2)) == (62.42, 2.58)


def test_many_sets_in_one_plan(spark):
    cells = [(s, a, b, 70.0 if s else 50.0) for s in (0, 1) for a in range(3) for b in range(3) if a != b]
    df = spark.createDataFrame(cells, "set_id long, ga long, gb long, aai double")
    n = {r.set_id: r.bins for r in iterative.bin_summary(iterative.bins(df, [65.0])).collect()}
    assert n == {0: 3, 1: 1}


# Published counts of 1,147 scored sets (fixed values).
def test_published_metrics(spark):
    from kinfold.operators import evaluation

    c = spark.createDataFrame([(140, 60, 215, 732)], "tp long, fp long, fn long, tn long")
    r = evaluation.with_intervals(evaluation.screen_metrics(c)).first()
    assert round(r.precision * 100, 1) == 70.0 and round(r.specificity * 100, 1) == 92.4 and round(r.recall * 100, 1) == 39.4
    assert round(r.low, 1) == 63.3 and round(r.high, 1) == 75.9
    none = evaluation.with_intervals(evaluation.screen_metrics(spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, fn long, tn long"))).first()
    assert none.precision is None and none.low is None and none.kappa is None


def test_registered_predictions(spark):
    from kinfold.operators import evaluation

    values = spark.createDataFrame([("a", 60.0), ("b", 70.0), ("c", None)], "name string, value double")
    got = {r["name"]: r["holds"] for r in evaluation.predictions(values, [("a", "<", 65.0), ("b", "<", 65.0), ("c", ">=", 1.0)]).collect()}
    assert got == {"a": True, "b": False, "c": None}
