"""Spelling variants against a comparison of all pairs of words."""

import collections
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm import spelling_variants


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "1 as word", "'x' as n", "2 as run", "3 as d", "4 as `key`", "5 as form")


def brute_words(docs, slip):
    c = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(count):
    near = {w: [v for v in count if one_apart(w, v)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 5 * count[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), count.get(form[w])) for w, n in count.items())


def corpus():
    random.seed(12)
    stems = ["tionere", "mention", "überall", "aaaaaa", "abcabc", "garçonne", "÷×letter"]
    stems += ["".join(random.choice("abé") for _ in range(random.randrange(6, 10))) for _ in range(25)]
    # A half that very many words share, before and after.
    stems += [random.choice("abcdefgh") + random.choice("klmnop") + random.choice("rstu") + "tion" for _ in range(150)]
    stems += ["inter" + "".join(random.choice("abcd") for _ in range(5)) for _ in range(150)]
    def slip(w):
        k = random.randrange(len(w) + 1)
        return random.choice([w[:k] + w[k + 1 :], w[:k] + random.choice("abé") + w[k:], w[:k] + random.choice("abé") + w[k + 1 :]])

    runs = []
    for w in stems:
        runs += [w] * random.choice([5, 26, 130, 700])
        for _ in range(3):
            runs += [slip(w)] * random.choice([1, 5, 5, 26])
    runs += ["z" * 3000] * 5 + ["z" * 3001] * 26
    random.shuffle(runs)
    docs = [(i, " ".join(r if random.random() < 0.5 else r.upper() for r in runs[i::60])) for i in range(60)]
    return docs + [(None, "mention, mention;\nMention"), (3, docs[3][1]), (3, "short tiny"), (70, None), (71, ""), (72, "12 ... 7")]


@pytest.mark.parametrize("per_shard, slip", [(spelling_variants.PER_SHARD, 199), (25, 3)])
def test_variants(spark, per_shard, slip):
    docs = corpus()
    got = spelling_variants.variants(frame(spark, docs), per_shard=per_shard, slip=slip).collect()
    count = brute_words(docs, slip)
    assert len(count) > 300
    want = brute(count)
    assert sum(w[1] is not None for w in want) > 100 and any(w[1] != w[2] for w in want if w[1])
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == want


def test_nothing(spark):
    df = frame(spark, corpus())
    assert spelling_variants.variants(df.where("false")).count() == 0
    assert spelling_variants.variants(df.where("doc_id > 70")).count() == 0


WORD = st.text("abé", min_size=6, max_size=9)


@settings(max_examples=200, deadline=None)
@given(st.lists(WORD, unique=True, max_size=30), st.lists(WORD, max_size=20))
def test_shard(held, scanned):
    """Both halves of all words in one shard: each near word is found, and once."""
    shard = spelling_variants.Shard([(w, 5, side) for w in held for side in (0, 1)])
    split = [spelling_variants.Shard([(w, 5, side) for w in held]) for side in (0, 1)]
    for w in [*scanned, *held]:
        want = {v for v in held if one_apart(w, v)}
        assert set(shard.near(w)) == want
        assert sorted([*split[0].near(w), *split[1].near(w)]) == sorted(want)
