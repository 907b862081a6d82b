"""Operators over a corpus against brute force: lines, phrases, near copies, toxicity, language model, pipeline."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm import components, line_dedup, order_minhash, phrase_index, pitman_yor, queries, toxicity

BLANK = " \t\n\x0b\x0c\r"


def frame(spark, rows, kind="doc_id long, text string"):
    df = spark.createDataFrame(rows, kind)
    # Columns whose names operators use themselves.
    return df.selectExpr("*", "1 as _row", "'x' as lang", "2 as score", "3 as _w", "cast(4 as long) as n_chars", "5 as n_lines", "6 as kept", "7 as `first`")


# ---- lines -----------------------------------------------------------------------------

LINES = [
    (0, "Common line here\nonly in zero\n\tCOMMON line HERE \nshort\n"),
    (1, "common line here\nshort\nÄÖÜ stays as it is"),
    (2, None),
    (3, ""),
    (4, "only own only own\nonly own only own"),
    (5, "äÖÜ stays as it is\ncommon line here\nshort\nend"),
    (5, "äÖÜ stays as it is\ncommon line here\nshort\nend"),
    (6, "common line here"),
    (None, "common line here"),
]


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANK))


def brute_lines(rows):
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [i is None or len(key(x)) < 10 or first[key(x)] == i for x in lines]
        out.append((i, len(lines), keep.count(False), "\n".join(x for x, k in zip(lines, keep) if k)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 1000])
def test_lines(spark, hot):
    got = line_dedup.dedup(spark.createDataFrame(LINES, "doc_id long, text string"), hot=hot).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=str) == brute_lines(LINES)
    for r in got:
        assert sum(r.keep_runs) == r.n_lines and sum(r.keep_runs[1::2]) == r.n_dropped
        lines, at, kept = (r.text or "").split("\n"), 0, []
        for k, n in enumerate(r.keep_runs):
            kept += lines[at : at + n] if k % 2 == 0 else []
            at += n
        assert "\n".join(kept) == r.kept


@pytest.mark.parametrize("hot", [1, 1000])
def test_lines_of_repeated_ids(spark, hot):
    """Texts of unequal length under one id, and a very long text."""
    for rows in (
        [(1, "shared line long"), (2, "x\ny\nz\nq\nshared line long"), (2, "a")],
        [(1, "shared line long"), (2, "shared line long\nmine only here"), (2, "mine other text\nb"), (2, "b\nshared line long"), (2, None)],
        [(1, "\n".join(f"line number {k}" for k in range(9000))), (2, "\n".join(f"line number {k}" for k in range(0, 20000, 3))), (2, "line number 3")],
    ):
        got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=str) == brute_lines(rows)


def test_lines_keep_columns(spark):
    df = frame(spark, LINES)
    got = line_dedup.deduplicated(df)
    assert got.columns == df.columns
    want = {i: (t if not n else k, len(k) if n else 4) for (i, t), (j, _, n, k) in zip(sorted(LINES, key=str), sorted(brute_lines(LINES), key=str)) if i == j}
    for r in got.collect():
        assert r["_row"] == 1 and (r.n_chars == 4 or r.n_chars == len(r.text))
    assert {r.doc_id for r in got.collect()} == set(want)
    assert line_dedup.deduplicated(df.where("false")).count() == 0


# ---- phrases ---------------------------------------------------------------------------


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_phrases(docs, items):
    wanted = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            wanted[tuple(w[k : k + 10])].add(i)
    out = []
    for d, t in docs:
        w, hit, got = split(t), set(), set()
        for p, owners in wanted.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    got |= owners
        out.append((d, len(w), len(hit), sorted(map(str, got))))
    return sorted(out, key=str)


def test_phrases(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["É1", "the"]
    say = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, say(14)) for i in range(8)] + [(20, "the w1"), (21, "THE, w1!"), (22, None), (23, "..."), (24, "absent w1"), (0, None)]
    docs = [(i, say(60)) for i in range(30)] + [(40, items[0][1].upper() + ", " + say(3)), (41, None), (42, ""), (43, "w1"), (None, items[0][1])]
    docs += [(44, " ".join(items[k][1] for k in range(8))), (44, " ".join(items[k][1] for k in range(8)))]
    d, b = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in phrase_index.matches(d, b).collect()), key=str)
    assert got == brute_phrases(docs, items)
    clean = phrase_index.clean(d, b)
    assert clean.columns == d.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(x[0]) for x in got if not x[2])
    assert phrase_index.matches(d, b.where("false")).where("n_hit > 0").count() == 0
    assert phrase_index.matches(d.where("false"), b).count() == 0


def test_proximity(spark):
    items = [(1, "alpha b c d e f g h i omega")]
    docs = [(1, "alpha b c d e f g h i omega"), (2, "alpha x x x x x x x x x x omega"), (3, "alpha omega"), (4, "b c d e f g h i " * 4)]
    docs += [(5, "alpha c b d e f g h i omega"), (6, "alpha b c d x x x x x x x e f g h i omega"), (None, "ALPHA b c d, so e f g h i omega")]
    got = phrase_index.proximity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), slop=2)
    # Every word stands within two words of its place: one word more, or two that changed places.
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "5", "None"]


# ---- near copies -----------------------------------------------------------------------


def test_components(spark):
    random.seed(6)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)] + [(7, 7)]
    root = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    assert root == {x: top(x) for x in up if top(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def common(x, y):
    """The most elements that both hold in the same order, cell by cell."""
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, j in itertools.product(range(len(x)), range(len(y))):
        table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=6), st.randoms(use_true_random=False), st.sampled_from([0.5, 0.8, 0.9]))
def test_alignment(x, more, rng, similarity):
    """Sequences with repeats, each with a few edits of the other."""
    y = list(x)
    for v in more:
        k = rng.randrange(len(y) + 1)
        y[k : k + rng.randrange(2)] = [v] * rng.randrange(2)
    m = common(x, y)
    want = m / (len(x) + len(y) - m) if x or y else 1.0
    for a, b in ((x, y), (y, x)):
        got = order_minhash.aligned(np.array(a, "u4"), np.array(b, "u4"), similarity)
        assert got <= want + 1e-12 and (want < similarity or got == pytest.approx(want))
    if x and y:
        assert order_minhash.at_most(*(order_minhash.bag(np.array(t, "u4")) for t in (x, y))) >= want - 1e-12


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[random.randrange(len(words))] = f"new{random.randrange(10**6)}"
    return words


@pytest.mark.parametrize("block, similarity", [(order_minhash.BLOCK, 0.8), (16, 0.8), (order_minhash.BLOCK, 0.9)])
def test_near_copies(spark, monkeypatch, block, similarity):
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    random.seed(7)
    new = lambda n: [f"v{random.randrange(4000)}" for _ in range(n)]
    texts = [" ".join(new(random.randrange(1, 120))) for _ in range(60)]
    for base in (new(150), new(150), new(40)):
        texts += [" ".join(edited(base, random.randrange(0, 9))) for _ in range(60)]
    shared = new(60)
    texts += [" ".join(shared + new(40)) for _ in range(40)]
    texts += [None, "", "", "!!!", "!!!", "one two", "One, two.", "a b", "word " * 300, "word " * 290, "word " * 200]
    random.shuffle(texts)
    docs = [*enumerate(texts), (None, "one two")] + [(0, texts[0])]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(frame(spark, docs), similarity).collect()}
    ids = range(len(texts))
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    w = [order_minhash.words(t or "") for t in texts]
    k = [order_minhash.codes(x) for x in w]
    for a, b in itertools.combinations(ids, 2):
        same = w[a] == w[b] if w[a] and w[b] else not w[a] and not w[b] and (texts[a] or "") == (texts[b] or "")
        if same or w[a] and w[b] and order_minhash.aligned(k[a], k[b], similarity) >= similarity:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    assert got == {i: top(i) for i in ids}
    kept = order_minhash.distinct_documents(frame(spark, docs), similarity)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i in ids if top(i) == i] + ["None"] + (["0"] if top(0) == 0 else []))


def test_near_copies_by_edit_similarity(spark):
    """Pairs of a text and a copy with words replaced, left out and put in anywhere: those at 0.8 and above are found, nearly all."""
    rng = random.Random(12)
    word = lambda: f"v{rng.randrange(3000)}"
    texts, pairs = [], []
    for k in range(300):
        base = [word() for _ in range(rng.randrange(40, 200))]
        copy = list(base)
        for _ in range(int(len(base) * rng.choice([0.02, 0.05, 0.08, 0.1]))):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
        pairs.append(order_minhash.aligned(order_minhash.codes(base), order_minhash.codes(copy)))
        texts += [" ".join(base), " ".join(copy)]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    found = [got[2 * k] == got[2 * k + 1] for k in range(300)]
    for least, share in ((0.8, 0.95), (0.9, 0.99)):
        right = [f for f, p in zip(found, pairs) if p >= least]
        assert len(right) > 80 and sum(right) >= share * len(right)
    assert not any(f for f, p in zip(found, pairs) if p < 0.8)
    assert all(got[2 * k] // 2 == k for k in range(300))  # nothing else is joined


def test_near_copies_of_nothing(spark):
    assert order_minhash.classes(frame(spark, []).where("false")).count() == 0


# ---- toxicity --------------------------------------------------------------------------


def corpus(n, bad):
    random.seed(8)
    syllables = ["ta", "ri", "mon", "el", "su", "ken", "os"]
    word = lambda: "".join(random.choice(syllables) for _ in range(random.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(random.randrange(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(random.randrange(1, 4)):
                w.insert(random.randrange(len(w)), bad + random.choice(["", "s", "ly", "ness", word()]))
        docs.append((i, " ".join(w)))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = corpus(700, "gruzzle")
    docs += [(9000, None), (9001, ""), (9002, "..."), (9003, "x" * 5000)]
    labels += [(9000, 1, 1), (None, 1, 1), (5, 1, None), (123456, 0, 1)]
    d, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(d, lab).collect()}
    assert len(got) == len(docs)
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [i for i, r in got.items() if r.held_out and i < 700]
    assert sum((i % 5 == 0) == bool(got[i].predicted) for i in held) >= 0.98 * len(held)
    # Labels of the held-out fold change nothing.
    other = spark.createDataFrame([(i, q, 1 - t if t is not None and i and zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels], lab.schema)
    assert {r.doc_id: r.score for r in toxicity.classify(d, other).collect()} == {i: r.score for i, r in got.items()}
    kept = toxicity.ordinary(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert {r.score for r in toxicity.classify(d, lab.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.classify(d.where("false"), lab).count() == 0


def test_toxicity_rows(spark):
    """Null ids aren't held out, repeated ids give one learned text, and every score is the curve's value of the model's own words."""
    docs, labels = corpus(300, "gruzzle")
    docs += [(None, "gruzzle gruzzles"), (5, "another text of an id that is repeated"), (9003, "gruzzleness " * 4000)]
    d, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.sample(d, lab).count() == len({i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1})
    got = toxicity.classify(d, lab).collect()
    assert len(got) == len(docs) and all(r.held_out is False and r.predicted == 1 for r in got if r.doc_id is None)
    model = toxicity.fit(d, lab)
    kn = toxicity.KneserNey(toxicity.unpacked_words(model["words"]))

    def brute(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        diff = lambda w: sum(math.log(kn.probability(("^" + w + "$")[max(0, i - 4) : i + 1], 1) / kn.probability(("^" + w + "$")[max(0, i - 4) : i + 1], 0)) for i in range(1, len(w) + 2))
        each = sorted((diff(w) / (len(w) + 1 + toxicity.PRIOR) for w in words), reverse=True)
        x = [sum(map(diff, words)) / sum(len(w) + 1 for w in words), each[0] ** 2 * (each[0] > 0), each[1] ** 2 * (each[1] > 0) if len(each) > 1 else 0.0] if words else [0.0] * 3
        z = sum((v - m) / s * w for v, m, s, w in zip(x, model["mean"], model["scale"], model["weights"])) + model["weights"][-1]
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    for i, text in docs[:60] + docs[-3:]:
        assert any(r.score == pytest.approx(brute(text), abs=1e-9) for r in got if r.doc_id == i)


def test_kneser_ney_sums_to_one():
    model = toxicity.KneserNey([("abba", 5, 1), ("abc", 2, 7), ("ca", 1, 1), ("b", 3, 0)])
    letters = [g for g in model.count[1]]
    for context in ("", "^", "a", "b", "^a", "ab", "^ab", "abb", "^abb", "zz"):
        for j in (0, 1):
            known = sum(model.probability(context + c, j) for c in letters)
            assert 0 < known <= 1 + 1e-9
            assert 1 - known <= 0.5  # what is left is for letters not seen


# ---- language model --------------------------------------------------------------------


def test_pitman_yor(spark):
    random.seed(9)
    words = ["the", "a", "cat", "dog", "sat", "Ran", "é", "x,", *[f"t{i}" for i in range(60)]]
    docs = [(i, " ".join(random.choice(words) if random.random() < 0.8 else f"z{random.randrange(900)}" for _ in range(random.randrange(0, 60)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "  \n"), (5, docs[5][1]), (903, "q" * 4000)]
    got = pitman_yor.score(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]
    c = collections.Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    text = dict(docs)
    for r in got:
        w = tokens(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {(r.doc_id, round(r.score, 4)) for r in pitman_yor.score(frame(spark, docs)).collect()}
    assert again == {(r.doc_id, round(r.score, 4)) for r in got}
    assert pitman_yor.score(frame(spark, docs).where("false")).count() == 0


def test_spelling_sums_to_one():
    words = [b"abba", b"abc", "\u00e9t\u00e9".encode(), b""]
    _, context, symbol = pitman_yor.spelled(words)
    cells = collections.Counter((context.astype("i8") * pitman_yor.SYMBOLS + symbol).tolist())
    for model in (pitman_yor.spelling(cells), pitman_yor.spelling({})):
        p = 10.0 ** model["log"][:, model["cols"]].astype("f8")
        assert np.allclose(p.sum(1), 1, atol=1e-4)
        assert model["rows"].min() >= 0 and model["rows"].max() < len(p)


@pytest.mark.parametrize("n, w, d", [(2, 2.0, 0.5), (5, 0.3, 0.5), (40, 2.0, 0.5), (60, 5.0, 0.8), (300, 0.01, 0.9), (3000, 20.0, 0.3)])
def test_seating(n, w, d):
    """The distribution of tables is the exact one: w^t times the seatings of n customers at t tables."""
    ways = np.full(n + 1, -np.inf)
    ways[1] = 0.0
    for k in range(1, n):
        t = np.arange(n + 1)
        stay = np.where((t >= 1) & (t <= k), ways + np.log(np.maximum(k - d * t, 1e-300)), -np.inf)
        ways = np.logaddexp(stay, np.r_[-np.inf, ways[:-1]])
    exact = ways + np.arange(n + 1) * math.log(w)
    exact = np.exp(exact - exact.max())
    exact /= exact.sum()
    many = 20_000
    t = pitman_yor.seat(np.full(many, float(n)), np.full(many, w), d, np.arange(many, dtype="u8") * 7 + 1, 5, steps=12)
    got = np.bincount(t.astype(int), minlength=n + 1) / many
    mean, spread = (exact * np.arange(n + 1)).sum(), math.sqrt((exact * np.arange(n + 1) ** 2).sum() - (exact * np.arange(n + 1)).sum() ** 2)
    assert abs(t.mean() - mean) < 0.05 * spread + 0.01
    assert np.abs(got - exact).sum() < 0.1


def test_large_counts_are_kept():
    for x in ([0, 1], [2**40, 3], [], [255, 256, 2**62]):
        assert pitman_yor.unplanes(pitman_yor.planes(np.array(x, "i8"))).tolist() == x
    t = pitman_yor.seat(np.array([1e12, 3e9]), np.array([5.0, 0.5]), 0.7, np.array([3, 4], "u8"), 1)
    assert (t >= 1).all() and (t < 1e9).all()


def test_probabilities_sum_to_one(spark):
    """After each word the outcomes are all training words, the end, and one for what training lacks; scores are their sums."""
    random.seed(11)
    words = ["a", "b", "c", "d", "e"]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    rest = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2]
    docs = [(rest[k], " ".join(random.choices(words, [30, 8, 3, 1, 1], k=random.randrange(0, 30)))) for k in range(150)]
    every = [*words, "zz"]
    docs += [(held[0], " ".join(f"{x} {y}" for x in every for y in every)), (held[1], None)] + [(held[2 + k], x) for k, x in enumerate(every)]
    df = frame(spark, docs)
    p = {(r.word, r.context): r.log10_p for r in pitman_yor.probabilities(df).collect()}
    known = {x for i, t in docs if i in set(rest) for x in (t or "").split()}
    assert known == set(words)
    context = {x: int(pitman_yor.contexts_of([x.encode()])[0]) for x in [*every, ""]}
    for before in [*every, ""]:
        assert sum(10 ** p[x, context[before]] for x in [*every, ""]) == pytest.approx(1, abs=1e-5)
    for r in pitman_yor.score(df).collect():
        w = (dict(docs)[r.doc_id] or "").split()
        assert r.score == pytest.approx(sum(p[y, context[x]] for x, y in zip(["", *w], [*w, ""])), rel=1e-5)


# ---- queries and pipeline --------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - {"op12_spelling_variants"}))
def test_queries_run_whole(spark, sf, name):
    table = "pages" if name.startswith("op8") else "documents"
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, sf).select(*columns).collect()
    by = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert by(got) == by(found.fetchall())


def test_pipeline(spark, sf, tmp_path):
    """Each stage against brute force on what the stage before kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, {r.doc_id: r for r in docs.collect()})
    before, after = kept["toxicity"]
    scores = {r.doc_id: r.predicted for r in queries.QUERIES["op5_toxicity"](spark, sf).collect()}
    assert set(after) == {i for i, p in scores.items() if not p}
    before, after = kept["line_dedup"]
    assert {i: r.text for i, r in after.items()} == {i: t for i, _, _, t in brute_lines([(i, r.text) for i, r in before.items()])}
    before, after = kept["near_dedup"]
    assert set(after) <= set(before) and len({r.text for r in before.values()}) >= len(after)
    before, after = kept["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(after) == {i for i, _, hit, _ in brute_phrases([(i, r.text) for i, r in before.items()], items) if not hit}
    before, after = kept["bpe"]
    assert {i: r.decoded_sha256 for i, r in after.items()} == {i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in before.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))
