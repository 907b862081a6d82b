"""Star alignments by plain dynamic programming, recombination by plain permutation, trees by their own distances."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.operators import phylogeny, relational

DNA = st.text("ACG", min_size=0, max_size=14)


def score(a, b):
    """Best global score, cell by cell."""
    h = [[-2 * (i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i][j] = max(h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 2, h[i][j - 1] - 2)
    return h[-1][-1]


@settings(max_examples=150, deadline=None)
@given(DNA, DNA)
def test_pairs(a, b):
    x, y = phylogeny.align_pair(a, b)
    assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
    assert sum(-2 if "-" in p else 2 if p[0] == p[1] else -1 for p in zip(x, y)) == score(a, b)
    assert ("-", "-") not in zip(x, y)


@settings(max_examples=100, deadline=None)
@given(st.lists(DNA, min_size=1, max_size=6))
def test_star(sequences):
    rows = phylogeny.star(sequences)
    assert [r.replace("-", "") for r in rows] == sequences and len({len(r) for r in rows}) == 1
    # Each stays aligned to the centre as well as the two alone.
    words = [{s[i : i + 3] for i in range(len(s) - 2)} for s in sequences]
    centre = max(range(len(sequences)), key=lambda c: (sum(len(words[c] & w) for w in words), -c))
    for r, s in zip(rows, sequences):
        pairs = [p for p in zip(rows[centre], r) if p != ("-", "-")]
        assert sum(-2 if "-" in p else 2 if p[0] == p[1] else -1 for p in pairs) == (score(sequences[centre], s) if r is not rows[centre] else 2 * len(s))


def four_gametes(x, y):
    return len(set(zip(x, y))) == 4


@pytest.mark.parametrize("seed", range(4))
def test_recombination(seed):
    random.seed(seed)
    rows = ["".join(random.choice("AC") if random.random() < 0.4 else "A" for _ in range(24)) for _ in range(6)]
    rows[0] = rows[0][:5] + "-" + rows[0][6:]
    columns = [c for c in zip(*rows) if len(set(c)) == 2 and "-" not in c and min(c.count(x) for x in set(c)) >= 2]
    n, index, p = phylogeny.recombination(rows, window=4, rounds=3000, seed=seed)
    assert n == len(columns)
    reach = min(4, max(2, n // 2))
    share = lambda cs: float(np.mean([four_gametes(cs[i], cs[j]) for i in range(n) for j in range(i + 1, min(n, i + reach))]))
    assert index == pytest.approx(share(columns))
    low = sum(share(random.sample(columns, n)) <= index + 1e-12 for _ in range(3000))
    assert abs(p - low / 3000) < 0.06  # two draws of 3,000 orders


def test_recombinants_stand_out():
    """Two halves of one history each, joined crosswise, against a single history."""
    one = ["A" * 40, "A" * 40, "C" * 40, "C" * 40]
    assert phylogeny.recombination(one)[1:] == (0.0, None)
    mixed = [x + y for x, y in zip(["A" * 20, "A" * 20, "C" * 20, "C" * 20], ["A" * 20, "C" * 20, "A" * 20, "C" * 20])]
    n, index, p = phylogeny.recombination(mixed, window=10)
    assert n == 40 and p < 0.01
    assert phylogeny.recombination(["AC", "AC"]) == (0, None, None) and phylogeny.recombination(["", ""])[0] == 0


def tree(leaves, rng):
    """A random binary tree as (splits with their lengths, distances)."""
    parts = [(frozenset([x]), rng.uniform(1, 9)) for x in range(leaves)]
    edges = list(parts)
    groups = [frozenset([x]) for x in range(leaves)]
    while len(groups) > 3:
        a, b = rng.sample(groups, 2)
        groups = [g for g in groups if g not in (a, b)] + [a | b]
        edges.append((a | b, rng.uniform(1, 9)))
    d = np.zeros((leaves, leaves))
    for side, length in edges:
        for i, j in itertools.permutations(range(leaves), 2):
            if (i in side) != (j in side):
                d[i, j] += length
    return {(min(s, frozenset(range(leaves)) - s, key=lambda x: (len(x), sorted(x)))): v for s, v in edges}, d


def splits(edges, leaves):
    below = {}
    for node, parent, _ in edges:
        below.setdefault(parent, []).append(node)
    held = lambda x: frozenset([x]) if x >= 0 else frozenset().union(*map(held, below[x]))
    every = frozenset(leaves)
    return {min(held(n), every - held(n), key=lambda x: (len(x), sorted(x))): v for n, _, v in edges}


@pytest.mark.parametrize("leaves", [3, 4, 5, 12, 30])
def test_additive_trees_are_recovered(leaves):
    want, d = tree(leaves, random.Random(leaves))
    got = splits(phylogeny.join_neighbours(list(range(leaves)), d), range(leaves))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_from_groups_to_trees(spark):
    """Two sets of unlike size: alignments in Spark, joined, tested, and the tree of what they were made from."""
    rng = random.Random(9)
    mutate = lambda s, n: "".join(rng.choice("ACGT") if rng.random() < n else x for x in s)
    rows, families = [], 6
    for k, groups in ((1, 6), (2, 3)):
        for no in range(families):
            base = "".join(rng.choice("ACGT") for _ in range(120))
            left, right = mutate(base, 0.15), mutate(base, 0.15)
            for g in range(groups):
                s = mutate(left if g % 2 else right, 0.03)
                cut = rng.randrange(20, 100)
                rows.append((k, no, g, s[:cut] + s[cut + g % 3 :]))
    rows += [(1, 0, 0, "~"), (3, 0, 4, "ACGT"), (3, 1, 4, None)]
    aligned = phylogeny.align_groups(spark.createDataFrame(rows, "set_id long, group_no long, grp long, sequence string"))
    wide = {}
    for r in aligned.collect():
        wide.setdefault((r.set_id, r.group_no), {})[r.grp] = r.aligned
    given = {(k, no, g): s for k, no, g, s in rows if s != "~"}
    assert all(len({len(x) for x in v.values()}) == 1 for v in wide.values())
    assert {(*k, g): x.replace("-", "") for k, v in wide.items() for g, x in v.items()} == {k: s or "" for k, s in given.items()}
    tests = {(r.set_id, r.group_no): r for r in phylogeny.recombination_test(aligned, rounds=50).collect()}
    assert set(tests) == set(wide) and all(r.p is None or 0 < r.p <= 1 for r in tests.values())
    assert tests == {(r.set_id, r.group_no): r for r in phylogeny.recombination_test(aligned.repartition(5), rounds=50).collect()}
    kept = relational.split_recombinant(aligned.where("set_id = 1"), spark.createDataFrame([(0, 0.01), (1, 0.5)], "group_no long, p double"), "group_no", 0.05)
    assert {r.group_no for r in kept.where("recombinant").collect()} == {0}
    joined = phylogeny.supermatrix_of(aligned)
    found = phylogeny.distances(joined)
    plain = {(r.set_id, r.grp): r.joined for r in joined.collect()}
    for r in found.collect():
        pairs = [p for p in zip(plain[r.set_id, r.ga], plain[r.set_id, r.gb]) if "-" not in p]
        assert r.distance == pytest.approx(100 * sum(a != b for a, b in pairs) / len(pairs))
    edges = phylogeny.neighbour_tree(found).collect()
    first = splits([(r.node, r.parent, r.length) for r in edges if r.set_id == 1], range(6))
    assert frozenset([1, 3, 5]) in first or frozenset([0, 2, 4]) in first
    assert {r.set_id for r in edges} == {1, 2}
    text = phylogeny.newick([(r.node, r.parent, r.length) for r in edges if r.set_id == 2], {0: "a", 1: "b", 2: "c"})
    assert text.startswith("(a:") and text.endswith(");") and text.count(",") == 2
    assert phylogeny.neighbour_tree(found.where("false")).count() == 0
