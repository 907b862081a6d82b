"""Sequence search: the banded alignment against a plain one, and hits against all pairs."""

import random
from math import exp

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.operators import orthology, sequence_search as ss
from kinfold.plans import registry


def plain(a, b, scheme):
    """Local alignment with affine gaps over the whole matrix, cell by cell: score, matches, columns, gaps, places."""
    table = scheme.class_of()
    first = scheme.open + scheme.extend
    zero = (0, 0, 0, 0, 0)  # matches, pairs, letters of a and of b in gaps, gaps
    low = -(10**9)
    h = [[(0, zero)] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[(low, zero)] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = (0, None)
    for i in range(1, len(a) + 1):
        e = (low, zero)
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            s = scheme.match if x == y else scheme.alike if table is not None and table[x] == table[y] else scheme.mismatch
            up, longer = h[i - 1][j], f[i - 1][j]
            if up[0] - first >= longer[0] - scheme.extend:
                m = up[1]
                f[i][j] = (up[0] - first, (m[0], m[1], m[2] + 1, m[3], m[4] + 1))
            else:
                m = longer[1]
                f[i][j] = (longer[0] - scheme.extend, (m[0], m[1], m[2] + 1, m[3], m[4]))
            left = h[i][j - 1]
            if left[0] - first >= e[0] - scheme.extend:
                m = left[1]
                e = (left[0] - first, (m[0], m[1], m[2], m[3] + 1, m[4] + 1))
            else:
                m = e[1]
                e = (e[0] - scheme.extend, (m[0], m[1], m[2], m[3] + 1, m[4]))
            m = h[i - 1][j - 1]
            cell = (m[0] + s, (m[1][0] + (x == y), m[1][1] + 1, *m[1][2:]))
            for other in (f[i][j], e):
                if other[0] > cell[0]:
                    cell = other
            h[i][j] = cell if cell[0] > 0 else (0, zero)
            if h[i][j][0] > best[0]:
                best = (h[i][j][0], (h[i][j][1], i - 1, j - 1))
    if not best[0]:
        return [0]
    (matches, pairs, ga, gb, gaps), i, j = best[1]
    return [best[0], matches, pairs + ga + gb, gaps, i - pairs - ga + 1, i, j - pairs - gb + 1, j]


LETTERS = st.lists(st.sampled_from([ord(x) for x in "LVCKR"]), min_size=1, max_size=24)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(LETTERS, LETTERS), min_size=1, max_size=5), st.sampled_from([ss.PROTEIN, ss.WORDS, ss.Scheme(match=2, mismatch=-1, open=1, extend=1)]))
def test_alignment(pairs, scheme):
    """In a band that holds the whole matrix, several pairs at a time."""
    a, b = ([np.array(p[k], "i8") for p in pairs] for k in (0, 1))
    got = ss.align(a, b, [-len(x) for x in a], 64, scheme)
    for row, (x, y) in zip(got.tolist(), pairs):
        want = plain(x, y, scheme)
        assert row[0] == want[0]
        if want[0]:
            assert row == want


def mutated(seq, rate, alphabet):
    out = []
    for x in seq:
        r = random.random()
        if r < rate * 0.7:
            out.append(random.choice(alphabet))
        elif r < rate * 0.85:
            continue
        elif r < rate:
            out += [x, random.choice(alphabet)]
        else:
            out.append(x)
    return out


def proteins():
    random.seed(4)
    alphabet = "LVIMCAGSTPFYWEDNQKRH"
    new = lambda n: [random.choice(alphabet) for _ in range(n)]
    rows = []
    families = [new(random.randrange(60, 160)) for _ in range(10)]
    for k, base in enumerate(families):
        for g in range(4):
            for _ in range(random.choice([0, 1, 1, 2])):
                rows.append((7 + k % 2, g, mutated(base, random.choice([0.0, 0.05, 0.2, 0.35]), alphabet)))
    shared = new(50)
    rows += [(7, g, new(40) + mutated(shared, 0.1, alphabet) + new(60 * g)) for g in range(4)] + [(7, g, new(100)) for g in range(8)]
    rows += [(7, 1, list("MKV")), (7, 2, [])]
    return [(k, i, g, "".join(s)) for i, (k, g, s) in enumerate(rows)]


def test_search_finds_what_all_pairs_have(spark):
    rows = proteins()
    df = spark.createDataFrame(rows + [rows[0], (7, 900, 3, None)], "set_id long, item long, grp long, sequence string").withColumn("codes", ss.letters(F.col("sequence")))
    got = {(r.q, r.s): r for r in ss.search(df, ss.PROTEIN, max_evalue=1e-3).collect()}
    codes = {i: [ord(x) for x in s] for _, i, _, s in rows}
    letters = {k: sum(len(s) for j, _, _, s in rows if j == k) for k in (7, 8)}
    want = {}
    for k, q, gq, x in rows:
        for j, s, gs, y in rows:
            if k == j and gq != gs and q < s and x and y:
                w = plain(codes[q], codes[s], ss.PROTEIN)
                for u, v in ((q, s), (s, q)):
                    evalue = ss.PROTEIN.k * len(codes[u]) * letters[k] * exp(-ss.PROTEIN.decay * w[0])
                    if evalue < 1e-3:
                        want[u, v] = (w, evalue)
    assert len(want) > 80 and set(got) <= set(want)
    assert len(got) >= 0.95 * len(want)  # the search's recall; what it finds has the columns of the plain alignment
    exact = 0
    for (q, s), r in got.items():
        (score, matches, length, gaps, *at), evalue = want[q, s]
        assert (r.qlen, r.slen) == (len(codes[q]), len(codes[s])) and r.evalue >= evalue * (1 - 1e-9)
        places = [r.qstart - 1, r.qend - 1, r.sstart - 1, r.send - 1]
        exact += (r.raw_score, r.pident, r.length, r.gapopen) == (score, pytest.approx(100 * matches / length), length, gaps) and (q > s or places == at)
        assert r.length - r.mismatch - round(r.pident * r.length / 100) >= 0
    assert exact >= 0.98 * len(got)  # the rest lie partly outside their band


def test_search_of_texts(spark):
    """Equal texts are aligned once but all reported; only those that ask have hits; a hot seed is met in blocks."""
    random.seed(5)
    say = lambda n: " ".join(random.choice("abcdefghijklmnopqrstuvwxyz") + str(random.randrange(40)) for _ in range(n))
    base, passage = say(80), say(30)
    texts = [base] * 9 + [base.replace(" ", "  ").upper()] + [f"{say(20)} {passage} {say(30)}" for _ in range(12)] + [say(60) for _ in range(10)] + ["", None, "one two"]
    rows = [(0, i, i % 3, i % 4 == 0, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "set_id long, item long, grp long, asks boolean, text string").withColumn("codes", ss.words(F.col("text")))
    got = ss.search(df, ss.WORDS, salt=3).collect()
    copies, holders = range(10), range(10, 22)
    want = {(a, b) for side in (copies, holders) for a in side for b in side if a % 4 == 0 and a % 3 != b % 3}
    assert {(r.q, r.s) for r in got} == want
    kept = {}
    again = ss.search(df.union(df), ss.WORDS, keep=lambda name, x: kept.setdefault(name, x)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got)) and set(kept) == {"sequences", "members", "distinct", "alignments"}
    for r in got:
        if r.q in copies:
            assert (r.pident, r.length, r.qstart, r.send, r.gapopen, r.mismatch) == (100.0, 80, 1, 80, 0, 0)
        else:
            assert r.length >= 30 and 20 * ss.WORDS.match < r.raw_score
    top = ss.search(df, ss.WORDS, max_targets=2).collect()
    assert all(sum(r.q == i for r in top) <= 2 for i in range(30)) and {r.q for r in top} == {a for a, _ in want}
    kept = orthology.hit_filter(ss.search(df, ss.WORDS), max_gapopen=0, max_evalue=1e-5, min_coverage=0.9)
    assert {(r.q, r.s) for r in kept.collect()} == {p for p in want if p[0] < 10}
    assert ss.search(df.where("false")).count() == 0


def test_recall_on_texts(spark, sf):
    """Documents that ask, against those of other sources, in bands as wide as both texts: at least nine in ten hits are found."""
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", ss.words(F.col("text")).alias("codes")).collect() if 0 < len(r.codes) <= 400]
    got = {(r.q, r.s): r.raw_score for r in registry.QUERIES["sequence_search"](spark, sf).collect()}
    letters = sum(len(set_) for set_ in (r.codes for r in spark.read.parquet(f"{sf}/documents.parquet").select(ss.words(F.col("text")).alias("codes")).collect()))
    want = {}
    for a in (d for d in docs if d.doc_id % 20 == 0):
        others = [d for d in docs if d.source != a.source]
        for k in range(0, len(others), 32):
            some = others[k : k + 32]
            found = ss.align([np.array(a.codes)] * len(some), [np.array(b.codes) for b in some], [-len(a.codes)] * len(some), 1024, ss.WORDS)
            for b, row in zip(some, found.tolist()):
                if ss.WORDS.k * len(a.codes) * letters * exp(-ss.WORDS.decay * row[0]) < 1e-5:
                    want[a.doc_id, b.doc_id] = row[0]
    assert len(want) >= 5
    assert sum(got.get(k, 0) >= 0.98 * v for k, v in want.items()) >= 0.9 * len(want)
    small = {d.doc_id for d in docs}
    assert {k for k in got if k[0] in small and k[1] in small} <= set(want)


def test_sequences_travel_by_tiles(spark, monkeypatch):
    """However many pairs meet, a sequence goes to each tile once at most; more tiles, the same alignments."""
    random.seed(6)
    passage = [random.randrange(10**6) for _ in range(20)]
    rows = [(k % 2, i, i % 5 < 3, [random.randrange(50) for _ in range(i % 7)] + passage + [i] * (i % 3)) for k, i in enumerate(range(80))]
    items = spark.createDataFrame(rows, "set_id long, item long, asks boolean, codes array<int>")
    pairs = ss.candidates(items, ss.WORDS).cache()
    one = sorted(map(tuple, ss.aligned(pairs, items, ss.WORDS).collect()))
    assert len(one) == pairs.count() == 2 * (24 * 23 // 2 + 24 * 16)
    parts = {r.set_id: (r.queries, r.subjects) for r in ss.grid(items).collect()}
    most = sum(parts[k][1 - side] for k, _, asks, _ in rows for side in ((0, 1) if asks else (1,)))
    sent = ss.tiled(pairs, items).where("kind < 2")
    assert sent.count() == most < pairs.count() and sent.where("codes is null").count() == 0
    monkeypatch.setattr(ss, "LETTERS", 100)
    monkeypatch.setattr(ss, "CHOICE", 7)
    assert all(r.queries > 5 and r.subjects > 5 for r in ss.grid(items).collect())
    assert sorted(map(tuple, ss.aligned(pairs, items, ss.WORDS).collect())) == one


def test_neither_meetings_nor_pairs_travel(spark, monkeypatch):
    """What seeds meet is counted and aligned in a tile, some at a time; each item has the alignments of its sequence's pairs."""
    random.seed(8)
    passages = [[random.randrange(10**6) for _ in range(16)] for _ in range(3)]
    texts = []
    for i in range(40):
        body = [w if random.random() > 0.06 else random.randrange(10**6) for p in random.sample(passages, i % 3) for w in p]
        cut = random.randrange(1 + len(body))
        texts.append([random.randrange(30) for _ in range(i % 9)] + body[:cut] + [i] * (i % 4) + body[cut:])
    rows = [(k % 2, 100 * i + c, (i + c) % 4, (i + c) % 3 < 2, t) for i, t in enumerate(texts) for c in range(1 + (i % 5 == 0) * 3) for k in (i,) if t]
    items = spark.createDataFrame(rows, "set_id long, item long, grp long, asks boolean, codes array<int>")
    classes = {}
    for r in rows:
        classes.setdefault((r[0], tuple(r[4])), []).append(r)
    reps = {(k, min(m)[1]): m for (k, _), m in classes.items()}
    one = spark.createDataFrame([(k, rep, any(x[3] for x in m), m[0][4]) for (k, rep), m in reps.items()], "set_id long, item long, asks boolean, codes array<int>")
    want = set()
    for r in ss.aligned(ss.candidates(one, ss.WORDS), one, ss.WORDS).collect():
        cells = (r.raw_score, r.length, r.gapopen)
        left, right = (r.qstart + 1, r.qend + 1), (r.sstart + 1, r.send + 1)
        for x in reps[r.set_id, r.q]:
            for y in reps[r.set_id, r.s]:
                if x[2] != y[2]:
                    want |= {(u[1], v[1], *cells, *p, *q) for u, v, p, q in ((x, y, left, right), (y, x, right, left)) if u[3]}
    for (k, _), m in reps.items():
        n = len(m[0][4])
        want |= {(x[1], y[1], 5 * n, n, 0, 1, n, 1, n) for x in m for y in m if x[3] and x[2] != y[2]}
    columns = ["q", "s", "raw_score", "length", "gapopen", "qstart", "qend", "sstart", "send"]
    found = ss.search(items, ss.WORDS, max_evalue=1e12).select(*columns)
    assert "seed" not in found._jdf.queryExecution().toString()
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) > 100 and set(got) == want
    few = ss.search(items, ss.WORDS, max_evalue=1e-9)
    limits = {"MEETS": 40, "POOL": 3, "TOGETHER": 4, "HITS": 5, "LETTERS": 100, "AT_ONCE": 2}
    for name, value in limits.items():
        monkeypatch.setattr(ss, name, value)
    again = ss.search(items.union(items), ss.WORDS, max_evalue=1e12)
    assert {tuple(r) for r in again.select(*columns).collect()} == want and again.count() == len(want)
    kept = {tuple(r) for r in again.where("evalue < 1e-9").select(*columns).collect()}
    assert 0 < len(kept) < len(want) and {tuple(r) for r in few.select(*columns).collect()} == kept


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(LETTERS, LETTERS), min_size=1, max_size=6), st.sampled_from([ss.PROTEIN, ss.WORDS, ss.Scheme(match=2, mismatch=-1, open=1, extend=1)]), st.integers(-12, 4), st.integers(1, 40))
def test_scores_first(pairs, scheme, low, width):
    """In any band, what scores and sums along a diagonal give is what the alignment of all cells gives."""
    a, b = ([np.array(p[k], "i4") for p in pairs] for k in (0, 1))
    flat = np.concatenate([x for p in zip(a, b) for x in p])
    end = np.cumsum([len(x) for p in zip(a, b) for x in p])
    start = np.r_[0, end[:-1]]
    lows = low + np.arange(len(a)) % 3
    got = ss.banded(flat, ss.absent(flat, 2), (start[::2], end[::2]), (start[1::2], end[1::2]), lows, width, scheme)
    want = ss.align(a, b, lows.tolist(), width, scheme)
    want[want[:, 0] == 0] = 0
    assert got.tolist() == want.tolist()
