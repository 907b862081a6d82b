"""Texts scored by a hierarchical Pitman-Yor language model.

Restaurants, each drawing from its parent:

    words after a word  ->  words  ->  spelling: bytes after three, two, one and no byte
    classes  ->  all bytes alike

Each word of the training texts has a restaurant of the words after it, known by 48 bits of
the word's hash. The outcomes are the training tokens and one more for all others, as in the
base score; its share of the words' new tables is what the spelling model leaves after the
known words.

Gibbs sampling takes all customers of a dish away and seats them anew, given everything else:
the tables t of c customers then have probability w^t times the number of seatings, each
weighted by its table sizes, with w = (theta + d T) P_parent. ``seat`` draws from that by
proposing whole seatings, customer by customer, and taking each by its exact odds against the
one before (Metropolis within Gibbs). A proposal jumps from one new table to the next, so its
cost follows the tables and the logarithm of the customers; the odds are exact for any number
of customers, and there is no other way for many of them. New tables are customers of
the parent.

Dishes are seated side by side: w takes the T of all restaurants, and the root's totals, as the
pass before left them (one pass starts from one table a dish, the next is from its tables). Each
sample's probabilities are of its own seating with its own totals, so they sum to one; ``SAMPLES``
of them after burn-in are averaged.

How it runs: documents are gathered in blocks (one task's documents up to ``BLOCK_BYTES``),
each with its own dictionary of words and of (word, word before it) pairs; a document becomes
a list of word numbers. A block sends a packet to every bucket of words (by a hash of the
word): the bucket's words of this block with their pairs and training counts, compressed. A
word has at most one entry a packet, however frequent it is, and the number of buckets follows
the input's bytes. Packets are written by bucket, and so is all that is made of them, so that
they are moved once. A restaurant has dishes in many buckets: each bucket sends what it holds
of a restaurant to the restaurant's own bucket, which answers with the totals. The restaurants
grow with the input and none of their tables is on the driver. The spelling tables have a fixed
number of cells (32,768 contexts by 257 bytes), which bounds what the driver collects and
broadcasts. Each packet is answered with the averaged probabilities of its pairs, and a block
adds up its documents from the answers.

Defined results: a null or empty text is its end token alone. Rows with a null doc_id are
scored, in the training part (crc32 of null is none, so they aren't held out) and learned
from. Repeated rows count and score each. With no training text all probabilities come from
the spelling's uniform root. Ids must be whole numbers (or text that spells them). An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, delete, forget_shuffles, give_back, planned_bytes, task, text_of

BLOCK_BYTES = 16_000_000
#: Bytes of input (as the planner knows them) for each bucket of words.
BUCKET_BYTES = 8 << 20
BURN, SAMPLES = 2, 3
#: Seatings that are proposed to each dish in a sweep after the first one. After two, the mean of the tables is
#: within a tenth of a standard deviation of the exact one.
STEPS = 2
THETA, DISCOUNT = 1.0, 0.5
#: The end token is the empty word, which no text has.
END = b""
SYMBOLS = 257


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


# ---- seating ---------------------------------------------------------------------------


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Repeatable uniform numbers, one a key."""
    h = key + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    for mul in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(mul)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype("f8") * 2.0**-53


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series eight steps on."""
    y = x + 8.0
    z = 1.0 / (y * y)
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    tail = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + tail - np.log(product)


def proposed(last: np.ndarray, w: np.ndarray, d: float, key: np.ndarray, salt: int, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tables, odds) of one proposed seating for each dish of ``last`` customers, those of most first; ``scaled`` is w last^-d.

    With i customers at t tables the next one joins them with weight i - d t, or opens a table
    with weight w ((i + 1) / last)^d: the power stands for what the customers after it will make of
    one more table. Runs of customers (an eighth of those seated) share one probability, so the
    next opening in a run is one geometric draw. ``odds`` is the logarithm of the seating's weight
    without w^t, less that of its probability here; with t log w it is what ``seat`` compares.
    """
    t, odds = np.minimum(last, 1.0), np.zeros(len(last))
    # Runs of one customer: all dishes are at the same i, those that are full stand at the end. What the
    # logarithm of the odds adds up is a product until then.
    product = np.ones(len(last))
    for i in range(1, 16):
        n = int(np.searchsorted(-last, -i, "left"))
        if not n:
            break
        weight, stay = scaled[:n] * (i + 1.0) ** d, i - d * t[:n]
        both = weight + stay
        opens = uniform(key[:n], salt + 131 * i) * both < weight
        product[:n] *= np.where(opens, both / weight, both)
        t[:n] += opens
    np.log(product, out=odds)
    n = int(np.searchsorted(-last, -16, "left"))
    live, turn = np.arange(n), 16
    i, last, tl, wl, kl, ol = np.full(n, 16.0), last[:n], t[:n].copy(), w[:n], key[:n], odds[:n].copy()
    while len(live):
        end = np.minimum(last, i + np.floor(i / 8))
        middle = (i + end - 1) / 2
        weight = wl * ((middle + 1) / last) ** d
        p = weight / (weight + np.maximum(middle - d * tl, 1e-12))
        none = np.log1p(-np.minimum(p, 1 - 1e-16))
        skip = np.floor(np.log(np.maximum(uniform(kl, salt + 131 * turn), 1e-300)) / none)
        opens = i + skip < end
        to = np.where(opens, i + skip, end)
        ran = to > i
        ol[ran] += log_gamma((to - d * tl)[ran]) - log_gamma((i - d * tl)[ran])
        ol -= (to - i) * none + np.where(opens, np.log(p), 0.0)
        tl = tl + opens
        i = to + opens
        turn += 1
        done = i >= last
        if done.any():
            t[live[done]], odds[live[done]] = tl[done], ol[done]
            go = ~done
            live, i, last, tl, wl, kl, ol = live[go], i[go], last[go], tl[go], wl[go], kl[go], ol[go]
    return t, odds


def seat(c: np.ndarray, w: np.ndarray, d: float, key: np.ndarray, salt: int, steps: int = STEPS) -> np.ndarray:
    """Tables of ``c`` customers of each dish, given its weight: a proposal, and ``steps`` more that are taken by their odds."""
    t = np.minimum(c, 1.0)
    two = np.flatnonzero(c == 2)  # has one choice, which needs no proposal
    t[two] += uniform(key[two], salt) < w[two] / (w[two] + 1 - d)
    many = np.flatnonzero(c > 2)
    if len(many):
        many = many[np.argsort(-c[many], kind="stable")]  # once for all proposals
        c, w, key, log_w = c[many].astype("f8"), w[many], key[many], np.log(w[many])
        scaled = w * c**-d
        now, odds = proposed(c, w, d, key, salt, scaled)
        for k in range(1, steps + 1):
            new, more = proposed(c, w, d, key, salt + 10_007 * k, scaled)
            take = np.log(np.maximum(uniform(key, salt + 10_007 * k + 7919), 1e-300)) < (new - now) * log_w + more - odds
            now, odds = np.where(take, new, now), np.where(take, more, odds)
        t[many] = now
    return t


# ---- spelling --------------------------------------------------------------------------


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, context of three byte classes, symbol) of every byte of the words, and of their ends."""
    sizes = np.fromiter(map(len, words), "i8", len(words))
    text = np.frombuffer(b"".join([w + b"\0" for w in words]), "u1").astype("i4")
    number = np.repeat(np.arange(len(words)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    at = np.arange(len(text)) - np.repeat(ends - sizes, sizes + 1)
    symbol = text.copy()
    symbol[ends] = SYMBOLS - 1
    context = np.zeros(len(text), "i4")
    for k in (1, 2, 3):
        folded = np.zeros(len(text), "i4")
        folded[k:] = text[:-k] & 31
        folded[at < k] = 0
        context |= folded << (5 * (k - 1))
    return number, context, symbol


def spelling(cells: dict[int, int]) -> dict[str, np.ndarray]:
    """Averaged log10 probability of each symbol after each context; ``cells``: context * SYMBOLS + symbol -> count.

    Rows are the contexts of three byte classes that occur, then all of two; columns the
    symbols that occur, then one for each of the others.
    """
    keys, n = np.fromiter(cells, "i8", len(cells)), np.fromiter(cells.values(), "f8", len(cells))
    contexts, row = np.unique(keys // SYMBOLS, return_inverse=True)
    symbols, col = np.unique(keys % SYMBOLS, return_inverse=True)
    width = len(symbols) + 1
    counts = [np.zeros((r, width)) for r in (1, 32, 1024, len(contexts))]
    counts[3][row, col] = n
    # A parent leaves out the oldest byte class.
    parent = [None, np.zeros(32, "i8"), np.arange(1024) & 31, contexts & 1023]
    seeds = [np.arange(c.size, dtype="u8").reshape(c.shape) + np.uint64(k << 40) for k, c in enumerate(counts)]
    tables = [np.minimum(c, 1) for c in counts]

    def send_up(k: int) -> None:
        counts[k - 1] = np.zeros_like(counts[k - 1])
        np.add.at(counts[k - 1], parent[k], tables[k])

    for k in (3, 2, 1):
        send_up(k)
        tables[k - 1] = np.minimum(counts[k - 1], 1)

    def predict() -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for k in range(4):
            up = out[-1][parent[k]] if k else np.full((1, width), 1 / SYMBOLS)
            free = THETA + DISCOUNT * tables[k].sum(1, keepdims=True)
            out.append((counts[k] - DISCOUNT * tables[k] + free * up) / (THETA + counts[k].sum(1, keepdims=True)))
        return out

    mean = [np.zeros_like(counts[k]) for k in (3, 2)]
    for sweep in range(BURN + SAMPLES):
        p = predict()
        for k in (3, 2, 1, 0):
            up = p[k - 1][parent[k]] if k else np.full((1, width), 1 / SYMBOLS)
            free = (THETA + DISCOUNT * tables[k].sum(1, keepdims=True)) * up
            on = counts[k] > 0
            tables[k][on] = seat(counts[k][on], free[on], DISCOUNT, seeds[k][on], 1000 * sweep + k)
            if k:
                send_up(k)
                tables[k - 1] = np.clip(tables[k - 1], np.minimum(counts[k - 1], 1), counts[k - 1])
        if sweep >= BURN:
            p = predict()
            mean = [m + p[k] / SAMPLES for m, k in zip(mean, (3, 2))]
    rows, cols = np.arange(32**3, dtype="i4") % 1024 + len(contexts), np.full(SYMBOLS, width - 1, "i4")
    rows[contexts], cols[symbols] = np.arange(len(contexts)), np.arange(width - 1)
    return {"rows": rows, "cols": cols, "log": np.log10(np.concatenate(mean)).astype("f4")}


def spelling_logs(words: list[bytes], model: dict[str, np.ndarray]) -> np.ndarray:
    number, context, symbol = spelled(words)
    return np.bincount(number, model["log"][model["rows"][context], model["cols"][symbol]], len(words))


# ---- blocks ----------------------------------------------------------------------------


def contexts_of(words: list[bytes]) -> np.ndarray:
    """The restaurant of each word: 48 bits of its hash."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words)) >> np.uint64(16)


def squeeze(*parts: bytes) -> bytes:
    """Byte strings under zstandard, with their lengths."""
    head = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def expand(x: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(x)
    n = int(np.frombuffer(raw[:8], "<u8")[0])
    ends = np.cumsum(np.frombuffer(raw[8 : 8 + 8 * n], "<u8")).tolist()
    at = 8 + 8 * n
    return [raw[at + a : at + b] for a, b in zip([0, *ends], ends)]


def planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as byte planes, as many as the greatest needs, after their number."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    x = x.astype("i8") if x.dtype.kind != "u" and x.dtype.kind != "i" else x
    return b"".join([bytes([width]), *((x >> 8 * k).astype("u1").tobytes() for k in range(width))])


def fixed(lp: np.ndarray) -> np.ndarray:
    """Logarithms of probabilities in steps of 2^-17: three bytes each down to 10^-128."""
    return np.rint(lp * -(2.0**17)).astype("i8")


def unplanes(x: bytes) -> np.ndarray:
    kept = np.frombuffer(x, "u1", offset=1).reshape(x[0], -1)
    out = np.zeros((kept.shape[1], 8), "u1")
    out[:, : x[0]] = kept.T
    return out.view("<i8").ravel()


def planes48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :6].T).tobytes()


def unplanes48(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), "u1")
    out[:, :6] = np.frombuffer(x, "u1").reshape(6, -1).T
    return out.view("<u8").ravel()


def pack_words(words: list[bytes], sizes: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> bytes:
    """Words, each one's number of pairs, and the pairs' contexts and counts."""
    # Each context once, frequent ones first, so that they have small numbers.
    known, at, often = np.unique(contexts, return_inverse=True, return_counts=True)
    rank = np.argsort(-often, kind="stable")
    small = np.empty(len(rank), "i8")
    small[rank] = np.arange(len(rank))
    return squeeze(b"\n".join(words), planes(sizes), planes48(known[rank]), planes(small[at]), planes(counts))


def unpack_words(x: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    words, sizes, known, small, counts = expand(x)[:5]
    return words.split(b"\n"), unplanes(sizes), unplanes48(known)[unplanes(small)], unplanes(counts)


class _Block:
    """Documents of one block as word numbers."""

    def __init__(self):
        self.ids, self.held, self.sizes, self.size = [], [], [], 0
        self.index: dict[bytes, int] = {END: 0}
        self.tokens = array("I")

    def add(self, doc: int | None, held: bool, text: str) -> None:
        # What lies between words is what bytes.split takes for white space.
        found = text.encode().lower().split()
        index, put = self.index, self.index.setdefault
        self.tokens.extend([put(w, len(index)) for w in found])
        self.tokens.append(0)
        self.ids.append(doc)
        self.held.append(held)
        self.sizes.append(len(found) + 1)
        self.size += len(text) + 8

    def packed(self, buckets: int) -> tuple[bytes, dict[int, bytes]]:
        """(the block's texts, its packets by bucket). The block lets go of its words and tokens."""
        words, tokens = [*self.index], np.frombuffer(self.tokens, "u4")
        self.index, self.tokens = {}, array("I")
        # Words are numbered by bucket, so a packet holds one run of numbers.
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
        bucket = (hashed % np.uint64(buckets)).view("i8")
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(words), "u4")
        number[order] = np.arange(len(words))
        words, bucket, flat = [words[k] for k in order.tolist()], bucket[order], number[tokens]
        del tokens
        end = int(number[0])
        key = _pair_keys(flat, len(words), end)
        train = key[np.repeat(~np.array(self.held, bool), self.sizes)]
        train.sort()
        pair = _distinct(key)
        counts = np.searchsorted(train, pair, "right")
        counts -= np.searchsorted(train, pair)
        del key, train
        # Frequent words get small numbers in the stored texts; ``rank`` leads back.
        rank = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        small = np.empty(len(rank), "u4")
        small[rank] = np.arange(len(rank))
        texts = squeeze(planes(small[flat]), planes(rank), planes(np.array([end])))
        del small, flat, rank
        contexts = hashed[order] >> np.uint64(16)  # as ``contexts_of`` has them
        per_word = np.bincount((pair // len(words)).view("i8"), minlength=len(words))
        pair %= np.uint64(len(words))
        before = pair.view("i8")
        first = np.r_[0, np.cumsum(per_word)]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        packets = {
            b: pack_words(words[lo:hi], per_word[lo:hi], contexts[before[first[lo] : first[hi]]], counts[first[lo] : first[hi]])
            for b, (lo, hi) in enumerate(zip(edges.tolist(), edges[1:].tolist()))
            if hi > lo
        }
        return texts, packets


def _pair_keys(flat: np.ndarray, words: int, end: int) -> np.ndarray:
    """One number for each token and the one before it; what stands before a text is an end."""
    flat = flat.astype("u8")
    key = flat * np.uint64(words)
    key[0] += np.uint64(end)
    key[1:] += flat[:-1]
    return key


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers, in order. ``x`` is sorted where it lies: with the places of all tokens ``np.unique`` takes six times its memory."""
    x.sort()
    return x[_first(x)]


def _first(x: np.ndarray) -> np.ndarray:
    """Whether a sorted number is the first of its like."""
    first = np.empty(len(x), bool)
    first[:1] = True
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return first


def _pairs_of_block(x: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(pair number, word number) of each token, and the number of pairs; pairs are in the packets' order."""
    small, rank, end = map(unplanes, expand(x))
    flat = rank[small].astype("u4")
    del small
    key = _pair_keys(flat, len(rank), int(end[0]))
    order = np.argsort(key)
    number = np.cumsum(_first(key[order]), dtype="u4")
    del key
    at = np.empty(len(order), "u4")
    at[order] = number - np.uint32(1)
    return at, flat, int(number[-1])


def blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of blocks (block, ids, held, sizes, texts) and of packets (block, bucket, packet)."""
    fields = [
        ("block", pa.string()),
        ("bucket", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("held", pa.list_(pa.bool_())),
        ("sizes", pa.list_(pa.int32())),
        ("data", pa.binary()),
    ]

    def run(batches):
        from pyspark import TaskContext

        part, seq, block = TaskContext.get().partitionId(), 0, _Block()

        def rows():
            data, packets = block.packed(buckets)
            name, n = f"{part:08d}-{seq:06d}", len(packets)
            none = [None] * n
            cells = [[name] * (n + 1), [None, *packets], [block.ids, *none], [block.held, *none], [block.sizes, *none], [data, *packets.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cells, fields)], [f for f, _ in fields])

        with task():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    cols = batch.slice(at, 256).to_pydict()
                    for i, h, t in zip(cols["doc_id"], cols["held"], cols["text"]):
                        block.add(i, h, t)
                        if block.size >= BLOCK_BYTES:
                            yield rows()
                            block, seq = _Block(), seq + 1
                            give_back()
            if block.ids:
                yield rows()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), text_of().alias("text"))
    return rows.mapInArrow(run, "block string, bucket int, ids array<long>, held array<boolean>, sizes array<int>, data binary")


def merged(packets: pa.Table, buckets: int) -> pa.Table:
    """One bucket's words with all their pairs and counts, and what it tells the restaurants' buckets."""
    packets = packets.sort_by("block")
    index: dict[bytes, int] = {}
    owners, contexts, counts = [], [], []
    for x in packets.column("data"):
        words, sizes, context, n = unpack_words(x.as_py())
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), "i8", len(words))
        owners.append(np.repeat(ids, sizes))
        contexts.append(context)
        counts.append(n)
    known, cls = np.unique(np.concatenate(contexts), return_inverse=True)
    key, inverse = np.unique(np.concatenate(owners) * len(known) + cls, return_inverse=True)
    n = np.bincount(inverse, np.concatenate(counts)).astype("i8")
    cls = key % len(known)
    data = pack_words([*index], np.bincount(key // len(known), minlength=len(index)), known[cls], n)
    own = packets.column("bucket")[0].as_py()
    del owners, contexts, counts, key, inverse
    give_back()
    # At first each dish has one table.
    return _rows(own, data, known, [np.bincount(cls, n, len(known)), np.bincount(cls, n > 0, len(known))], buckets, [])


# ---- the model -------------------------------------------------------------------------

#: A bucket's own row (``to`` is null) and what it tells the buckets of its restaurants.
ROWS = "bucket int, to int, data binary, sums array<double>"


def _parts(contexts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of restaurants by the bucket of their totals, and where each of the buckets starts."""
    to = (contexts % np.uint64(buckets)).astype("i8")
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(buckets + 1))


def _rows(own: int, data: bytes, contexts: np.ndarray, told: list[np.ndarray], buckets: int, sums: list[float]) -> pa.Table:
    """``ROWS`` of a bucket: ``told`` are its shares of the totals of each of its restaurants."""
    order, edges = _parts(contexts, buckets)
    to, cells = [None], [data]
    for k, (lo, hi) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
        if hi > lo:
            at = order[lo:hi]
            to.append(k)
            cells.append(squeeze(planes48(contexts[at]), *[planes(x[at]) for x in told]))
    n = len(to)
    columns = [pa.array([own] * n, pa.int32()), pa.array(to, pa.int32()), pa.array(cells, pa.binary()), pa.array([sums] + [None] * (n - 1), pa.list_(pa.float64()))]
    return pa.table(columns, ["bucket", "to", "data", "sums"])


def _totals(told: pa.Table) -> pa.Table:
    """For each told row the totals of its restaurants, in its order."""
    got = [expand(x.as_py()) for x in told.column("data")]
    contexts, at = np.unique(np.concatenate([unplanes48(x[0]) for x in got]), return_inverse=True)
    totals = [np.bincount(at, np.concatenate([unplanes(x[k]) for x in got]), len(contexts)).astype("i8") for k in range(1, len(got[0]))]
    ends = np.cumsum([len(x[0]) // 6 for x in got])
    data = [squeeze(*[planes(x[k]) for x in totals]) for k in np.split(at, ends[:-1])]
    return pa.table({"origin": told.column("bucket"), "to": told.column("to"), "data": pa.array(data, pa.binary())})


def _with_totals(words: DataFrame, rows: DataFrame, buckets: int, work, schema: str, seated: bool = False) -> DataFrame:
    """``work(bucket, its words, totals)`` for each bucket; the totals are arrays in the order of its restaurants.

    ``rows`` has what buckets tell, and with ``seated`` each one's own row, which ``work`` gets too. The
    words stay where they are written.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, data = left.column("bucket")[0].as_py(), left.column("data")[0].as_py()
        order, _ = _parts(_restaurants(data), buckets)
        right = right.sort_by("to")
        got = [x.as_py() for x in right.column("data")]
        more = [got.pop(0)] if seated else []  # its number is -1
        parts = [[unplanes(p) for p in expand(x)] for x in got]
        totals = []
        for k in range(len(parts[0])):
            x = np.empty(len(order), "i8")
            x[order] = np.concatenate([g[k] for g in parts])
            totals.append(x)
        try:
            return work(own, data, totals, *more)
        finally:
            give_back()

    told = rows.where("to is not null").select("bucket", "to", "data").repartition(buckets, "to")
    totals = told.groupBy("to").applyInArrow(_totals, "origin int, to int, data binary")
    if seated:
        totals = totals.unionByName(rows.where("to is null").select(F.col("bucket").alias("origin"), F.lit(-1).alias("to"), "data"))
    own = words.where("to is null").select("bucket", "data")
    return own.groupBy("bucket").cogroup(totals.repartition(buckets, "origin").groupBy("origin")).applyInArrow(run, schema)


def _restaurants(data: bytes) -> np.ndarray:
    """The restaurants of a bucket's pairs, in order."""
    return np.sort(unplanes48(expand(data)[2]))


class Seating:
    """The two word levels for one bucket of words, given the totals of all restaurants."""

    def __init__(self, words, sizes, contexts, n, tables, model):
        self.m, self.n = model, n.astype("f8")
        self.contexts, self.cls = np.unique(contexts, return_inverse=True)
        self.free = model["theta"] + model["d"] * tables
        self.owner = np.repeat(np.arange(len(words)), sizes)
        self.size = len(words)
        self.known = np.bincount(self.owner, n, self.size) > 0
        self.base = base_of(words, self.known, model)
        self.word_key = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
        self.key = self.word_key[self.owner] + contexts * np.uint64(0x9E3779B97F4A7C15)
        self.many = np.flatnonzero(self.n > 1)
        self.t = np.minimum(self.n, 1)
        self.up()
        self.t0 = np.minimum(self.c0, 1)

    def up(self) -> None:
        """The tables are the root's customers."""
        self.c0 = np.bincount(self.owner, self.t, self.size)

    def sweep(self, salt: int) -> None:
        m = self.m
        free = m["theta"] + m["d0"] * m["T0"]
        root = (self.c0 - m["d0"] * self.t0 + free * self.base) / (m["theta"] + m["C0"])
        if len(self.many):
            weight = self.free[self.cls[self.many]] * root[self.owner[self.many]]
            self.t[self.many] = seat(self.n[self.many], weight, m["d"], self.key[self.many], salt)
        self.up()
        self.t0 = seat(self.c0, free * self.base, m["d0"], self.word_key, salt + 500_009)


def base_of(words: list[bytes], known: np.ndarray, model: dict) -> np.ndarray:
    """The root's parent: the spelling of a known word; all others are one outcome, which has the rest."""
    base = 10 ** spelling_logs(words, model["spelling"])
    if "unknown" in model:
        base[~known] = model["unknown"]
    return base


def _scan(words: DataFrame, schema: str, work) -> DataFrame:
    """``work`` on the (words, counts of their pairs, owners of the pairs) of each bucket."""

    def run(batches):
        for b in batches:
            for x in b.column("data"):
                w, sizes, _, n = unpack_words(x.as_py())
                yield work(w, n, np.repeat(np.arange(len(w)), sizes))

    return words.where("to is null").select("data").mapInArrow(run, schema)


def basics(words: DataFrame) -> dict:
    """The spelling model, the discounts and the numbers of tokens, pairs and words."""

    def cells(w, n, owner):
        known = [x for x, k in zip(w, np.bincount(owner, n, len(w))) if k]
        _, context, symbol = spelled(known)
        cell, count = np.unique(context.astype("i8") * SYMBOLS + symbol, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count)], ["cell", "n"])

    # A fixed number of cells.
    counted = _scan(words, "cell long, n long", cells).groupBy("cell").agg(F.sum("n").alias("n")).collect()

    def numbers(w, n, owner):
        c = np.bincount(owner, n, len(w))
        flat = np.array([n.sum(), (n > 0).sum(), (n == 1).sum(), (n == 2).sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum()], "i8")
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["k", "n"])

    x = [0] * 7
    for r in _scan(words, "k int, n long", numbers).groupBy("k").agg(F.sum("n").alias("n")).collect():
        x[r["k"]] = r["n"]
    tokens, pairs, one, two, v, v1, v2 = x
    discount = lambda a, b: min(0.95, max(0.1, a / (a + 2 * b))) if a + b else DISCOUNT
    return {
        "theta": THETA,
        "d": discount(one, two),
        "d0": discount(v1, v2),
        "N": tokens,
        "V": v,
        "T0": float(v),
        "C0": float(pairs),
        "spelling": spelling({r["cell"]: r["n"] for r in counted}),
    }


def _summed(rows: DataFrame, n: int) -> list[float]:
    r = rows.where("sums is not null").agg(*[F.sum(F.col("sums")[k]) for k in range(n)]).first()
    return [float(x or 0) for x in r]


def fit(words: DataFrame, buckets: int) -> tuple[dict, DataFrame]:
    """(the model, the buckets' words with the averaged log10 probability of each pair), from the rows of ``merged``."""
    context = words.sparkSession.sparkContext
    model = basics(words)
    start = context.broadcast(model)

    def burn(own, data, totals):
        w, sizes, contexts, n = unpack_words(data)
        s = Seating(w, sizes, contexts, n, totals[1], start.value)
        for k in range(BURN):
            s.sweep(k)
        told = [np.bincount(s.cls, x, len(s.contexts)) for x in (n, s.t)]
        return _rows(own, b"", s.contexts, told, buckets, [s.t.sum(), s.t0.sum(), s.base[s.known].sum()])

    burnt = _with_totals(words, words, buckets, burn, ROWS).persist(StorageLevel.DISK_ONLY)
    c0, t0, known = _summed(burnt, 3)
    model = dict(model, C0=c0, T0=t0, unknown=max(1 - known, 1e-12))
    middle = context.broadcast(model)

    def sample(own, data, totals):
        w, sizes, contexts, n = unpack_words(data)
        s = Seating(w, sizes, contexts, n, totals[1], middle.value)
        s.sweep(1_000_003)
        tables, roots, told, sums = np.zeros(len(n)), [], [np.bincount(s.cls, n, len(s.contexts))], []
        for k in range(SAMPLES):
            s.sweep(2_000_003 + k)
            tables += s.t
            roots += [s.c0, s.t0]
            told.append(np.bincount(s.cls, s.t, len(s.contexts)))
            sums += [s.c0.sum(), s.t0.sum()]
        return _rows(own, squeeze(planes(tables), *map(planes, roots)), s.contexts, told, buckets, sums)

    sampled = _with_totals(words, burnt, buckets, sample, ROWS).persist(StorageLevel.DISK_ONLY)
    x = _summed(sampled, 2 * SAMPLES)
    model = dict(model, C0s=x[::2], T0s=x[1::2])
    burnt.unpersist()
    final = context.broadcast(model)

    def average(own, data, totals, seated):
        w, sizes, contexts, n = unpack_words(data)
        p, count = predicted(w, sizes, contexts, n, [*map(unplanes, expand(seated))], totals, final.value)
        out = squeeze(*expand(data)[:4], planes(count), planes(fixed(np.log10(p))))
        return pa.table({"bucket": pa.array([own], pa.int32()), "data": pa.array([out], pa.binary())})

    answers = bucketed(_with_totals(words, sampled, buckets, average, "bucket int, data binary", seated=True), "probabilities", buckets)
    sampled.unpersist()
    delete(words)
    return model, answers


def predicted(words, sizes, contexts, n, seated, totals, m) -> tuple[np.ndarray, np.ndarray]:
    """(each pair's probability averaged over the samples, each word's training count)."""
    owner, cls = np.repeat(np.arange(len(words)), sizes), np.unique(contexts, return_inverse=True)[1]
    count = np.bincount(owner, n, len(words)).astype("i8")
    base = base_of(words, count > 0, m)
    customers = m["theta"] + totals[0][cls]
    mean = (n - m["d"] * seated[0] / SAMPLES) / customers
    for k in range(SAMPLES):
        c0, t0 = seated[1 + 2 * k], seated[2 + 2 * k]
        root = (c0 - m["d0"] * t0 + (m["theta"] + m["d0"] * m["T0s"][k]) * base) / (m["theta"] + m["C0s"][k])
        mean += (m["theta"] + m["d"] * totals[1 + k][cls]) / customers * root[owner] / SAMPLES
    return mean, count


def answered(packets: pa.Table, bucket: pa.Table) -> pa.Table:
    """(block, bucket, data): for each packet its words' training counts and its pairs' log10 probabilities."""
    data = bucket.column("data")[0].as_py()
    words, sizes, contexts, count, lp = answer_of(data)
    known, cls = np.unique(contexts, return_inverse=True)
    index, key = {w: k for k, w in enumerate(words)}, np.repeat(np.arange(len(words)), sizes) * len(known) + cls
    out = []
    for x in packets.column("data"):
        w, per_word, c, _ = unpack_words(x.as_py())
        ids = np.fromiter(map(index.__getitem__, w), "i8", len(w))
        at = np.searchsorted(key, np.repeat(ids, per_word) * len(known) + np.searchsorted(known, c))
        out.append(squeeze(planes(count[ids]), planes(fixed(lp[at]))))
    return pa.table({"block": packets.column("block"), "bucket": packets.column("bucket"), "data": pa.array(out, pa.binary())})


def answer_of(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, their numbers of pairs, the pairs' contexts, the words' training counts, the pairs' log10 probabilities)."""
    words, sizes, known, small, count, lp = expand(data)
    return words.split(b"\n"), unplanes(sizes), unplanes48(known)[unplanes(small)], unplanes(count), unplanes(lp) * -(2.0**-17)


def added(block: pa.Table, answers: pa.Table, n: int, v: int) -> pa.Table:
    """Sums over each document of a block."""
    answers = answers.sort_by("bucket")
    got = [expand(x.as_py()) for x in answers.column("data")]
    count = np.concatenate([unplanes(c) for c, _ in got])
    lp = np.concatenate([unplanes(x) for _, x in got]) * -(2.0**-17)
    row = block.to_pylist()[0]
    del answers, got
    give_back()
    pair, word, pairs = _pairs_of_block(row["data"])
    if pairs != len(lp):
        raise ValueError("a block's answers don't match its pairs")
    starts = np.r_[0, np.cumsum(row["sizes"])[:-1]].astype("i8")
    base = np.log10((count + 1) / (n + v + 1))
    sums = [np.add.reduceat(x, starts) for x in (lp[pair], base[word], (count > 0).astype("i8")[word])]
    return pa.table(
        {
            "doc_id": pa.array(row["ids"], pa.int64()),
            "held_out": pa.array(row["held"], pa.bool_()),
            "n_tokens": pa.array(row["sizes"], pa.int64()),
            "n_known": pa.array(sums[2], pa.int64()),
            "train_tokens": pa.array([n] * len(row["ids"]), pa.int64()),
            "base_score": pa.array(sums[1]),
            "score": pa.array(sums[0]),
        }
    )


def number_of_buckets(docs: DataFrame) -> int:
    """As many as the input's bytes ask for; at least one a core, at most the shuffle partitions set."""
    session = docs.sparkSession
    most = int(session.conf.get("spark.sql.shuffle.partitions"))
    return min(max(planned_bytes(docs) // BUCKET_BYTES + 1, session.sparkContext.defaultParallelism), most)


def trained(docs: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame, dict, DataFrame]:
    """(blocks of texts, packets by bucket, the model, the buckets' probabilities)."""
    dealt = F.coalesce("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int"))
    made = blocks(docs, buckets).withColumn("text", F.col("bucket").isNull()).withColumn("bucket", dealt)
    made = bucketed(made.repartition(buckets, "bucket"), "blocks", buckets)
    forget_shuffles(docs.sparkSession)
    texts, packets = made.where("text"), made.where("not text").select("block", "bucket", "data")
    words = packets.groupBy("bucket").applyInArrow(lambda t: merged(t, buckets), ROWS)
    model, answers = fit(bucketed(words, "words", buckets), buckets)
    return texts, packets, model, answers


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    buckets = number_of_buckets(docs)
    texts, packets, model, answers = trained(docs, buckets)
    n, v = model["N"], model["V"]
    replies = (
        packets.groupBy("bucket")
        .cogroup(answers.select(F.col("bucket").alias("of"), "data").groupBy("of"))
        .applyInArrow(answered, "block string, bucket int, data binary")
    )
    return (
        texts.select(F.col("block").alias("own"), "ids", "held", "sizes", "data")
        .repartition(buckets, "own")
        .groupBy("own")
        .cogroup(replies.repartition(buckets, "block").groupBy("block"))
        .applyInArrow(
            lambda left, right: added(left, right, n, v),
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


def probabilities(docs: DataFrame) -> DataFrame:
    """(word, context, n, log10_p) of every pair of a word and the one before it that stands in ``docs``.

    ``context`` is 48 bits of the hash of the word before (of the empty word at a text's start),
    ``n`` the word's training count; the empty word is a text's end.
    """
    buckets = number_of_buckets(docs)
    _, _, _, answers = trained(docs, buckets)

    def run(batches):
        for b in batches:
            for x in b.column("data"):
                words, sizes, contexts, count, lp = answer_of(x.as_py())
                owner = np.repeat(np.arange(len(words)), sizes)
                word = pa.array([words[k].decode("utf-8", "replace") for k in owner.tolist()], pa.string())
                cells = [word, pa.array(contexts.astype("i8")), pa.array(count[owner]), pa.array(lp)]
                yield pa.RecordBatch.from_arrays(cells, ["word", "context", "n", "log10_p"])

    return answers.select("data").mapInArrow(run, "word string, context long, n long, log10_p double")


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, tokens, perplexity, base_perplexity) of scored documents."""
    return scores.groupBy("held_out").agg(
        F.sum("n_tokens").alias("tokens"),
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"),
    )
