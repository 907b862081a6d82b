"""The mix of sources against a plain apportionment by a heap, and its spans against its counts."""

import collections
import heapq
import random
import re

import pytest

from kinfold.llm import source_mix


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return df.selectExpr("*", "1 as size", "'x' as rank", "2 as target", "3 as shard", "4 as `start`", "5 as h", "6 as weight")


def corpus(n, seed=3):
    random.seed(seed)
    rows = []
    for i in range(n):
        source = random.choice(["b", "a", "a", "a", "é", "z", None, "A"])
        rows.append((i, source, " ".join(["w"] * random.choice([0, 1, 3, 40, 400]))))
    return rows + [(5000, "tiny", "one two three"), (5001, "void", ""), (5002, "void", None), (None, "a", "x " * 70), (None, "a", "x " * 70), (7, "a", "again an id"), (6000, "long", "y\t" * 90_000)]


def brute_targets(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        level = left / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level > 2 * size[s]}
        if not more:
            return {s: 2 * size[s] if s in full else weight[s] * level for s in order}
        full |= more


@pytest.mark.parametrize("shard_words, block", [(source_mix.SHARD_WORDS, 16), (5000, 16), (5000, 100)])
def test_mix(spark, shard_words, block):
    rows = corpus(400)
    df = frame(spark, rows)
    got = source_mix.mix(df, shard_words=shard_words, block=block).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), str(r.source), r["size"]) for r in got) == sorted((str(i), str(s), count(t)) for i, s, t in rows)
    size = collections.Counter()
    for _, s, t in rows:
        size[s] += count(t)
    target = brute_targets(size)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in size:  # a shard is off by less than a block or two, and a shard of the long text is one document
        shards = 1 + 2 * size[s] // shard_words
        assert abs(taken[s] - target[s]) <= 2 * block * shards
    again = sorted(map(str, source_mix.mix(df.repartition(7), shard_words=shard_words, block=block).collect()))
    assert again == sorted(map(str, got))
    if block == 16:
        other = source_mix.mix(df, seed=1, shard_words=shard_words).collect()
        assert sorted(map(str, other)) != sorted(map(str, got))
    spans = source_mix.spans(df, shard_words=shard_words, block=block).collect()
    of = collections.Counter()
    for r in spans:
        assert 0 < r.n_words <= block and 1 <= r.copies <= 2 and r.first_word >= 0
        of[r.doc_id] += r.copies * r.n_words
    want = collections.Counter()
    for r in got:
        want[r.doc_id] += r.taken
    assert of == +want
    blocks = collections.Counter()
    for r in spans:
        blocks[r.source, r.shard, r.block] += r.n_words
    assert max(blocks.values()) == block


@pytest.mark.parametrize("seed", range(4))
def test_apportionment(spark, seed):
    random.seed(seed)
    cells = [(random.randrange(4), k, random.choice([1, 16, 300, 5000]), 0.0) for k in range(60)]
    cells = [(r, k, n, n * random.choice([0.0, 0.4, 1.0, 1.0, 2.0])) for r, k, n, _ in cells]
    got = {(r.rank, r.shard): r.quota for r in source_mix.quotas(spark.createDataFrame(cells, "rank long, shard long, cell_size long, weight double")).collect()}
    most = {(r, k): 2 * -(-n // 16) for r, k, n, _ in cells}
    heap = [(-w, r, k, 1, w) for r, k, _, w in cells]
    heapq.heapify(heap)
    want = collections.Counter()
    for _ in range(int(sum(w for *_, w in cells) / 16 + 0.5)):
        q, r, k, j, w = heapq.heappop(heap)
        want[r, k] += 1
        if j < most[r, k]:
            heapq.heappush(heap, (-w / (2 * j + 1), r, k, j + 1, w))
    assert {k: v for k, v in got.items() if v} == dict(want)


def test_nothing(spark):
    df = frame(spark, corpus(3))
    assert source_mix.mix(df.where("false")).count() == 0
    assert {r.taken for r in source_mix.mix(df.where("source = 'void'")).collect()} == {0}
    assert source_mix.spans(df.where("source = 'void'")).count() == 0
    one = source_mix.mix(df.where("source = 'tiny'")).collect()
    assert [(r["size"], r.target, r.taken) for r in one] == [(3, 4.5, 0)]
