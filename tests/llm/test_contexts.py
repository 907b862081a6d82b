"""op4's restaurants are those of the words before, whatever their spelling."""

import random
import zlib

import pytest

from kinfold.llm import pitman_yor


def test_words_before_count(spark):
    rng = random.Random(4)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    pairs = [(f"k{i}zz", f"v{i}") for i in range(100)]
    docs, kinds = [], {}
    for i in range(300):
        some = rng.sample(pairs, 20)
        if held(i) and i % 2:  # the same words, each after another one's context
            some = [(a, d) for (a, _), (_, d) in zip(some, some[1:] + some[:1])]
        kinds[i] = held(i), i % 2
        docs.append((i, " ".join(f"{a} {b}" for a, b in some)))
    got = pitman_yor.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(docs)
    mean = lambda kind: sum(x := [r.score / r.n_tokens for r in got if kinds[r.doc_id] == kind]) / len(x)
    right, wrong = mean((True, 0)), mean((True, 1))
    assert right > wrong + 0.5
    assert right == pytest.approx(mean((False, 0)), abs=0.2)
