"""Memory of a Pitman-Yor block, and what it stores against plain counts."""

import random
import tracemalloc
from collections import Counter

import numpy as np

from kinfold.llm import pitman_yor


def test_a_block_is_packed_in_few_bytes_a_token():
    random.seed(8)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(random.choices(words, k=1000)) for _ in range(200)] + ["", "w1"]
    block = pitman_yor._Block()
    for i, x in enumerate(texts):
        block.add(i, i % 7 == 2, x)
    n = len(block.tokens)
    tracemalloc.start()
    data, packets = block.packed(4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    pair, word, pairs = pitman_yor._pairs_of_block(data)
    more = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert most < 52 * n and more < 45 * n
    taught, every = Counter(), Counter()
    for i, x in enumerate(texts):
        found = [*x.encode().split(), b""]
        for a, b in zip([b"", *found], found):
            every[b, a] += 1
            taught[b, a] += i % 7 != 2
    context = dict(zip(pitman_yor.contexts_of([*{w for w, _ in every}]).tolist(), {w for w, _ in every}))
    got, order = {}, []
    for _, packet in sorted(packets.items()):
        own, sizes, contexts, counts = pitman_yor.unpack_words(packet)
        for b, a, c in zip(np.repeat(np.array(own, object), sizes), contexts.tolist(), counts.tolist()):
            got[b, context[a]] = c
            order.append((b, context[a]))
    assert got == {k: taught[k] for k in every} and pairs == len(every) == len(order)
    assert Counter(order[k] for k in pair.tolist()) == every and len(word) == n
