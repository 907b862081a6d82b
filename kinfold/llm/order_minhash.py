"""Near-duplicate documents by Order MinHash, verified by banded alignment of words.

A text's k-mers are its runs of ``K`` words; repeats are told apart by an occurrence label,
so each labelled k-mer stands once in a text. Each of ``SKETCHES`` hash orders samples the
``PICK`` least labelled k-mers and keeps them in text order; two texts agree on a sketch if
they sampled the same k-mers in the same order.

A pair's similarity is m / (n1 + n2 - m) with n1 and n2 their words and m the most words that both hold in
the same order: an edit costs the words it touches, where k-mers would lose ``K`` times as many. An alignment that
reaches the threshold can't leave a band of unmatched words; in the band m is found bit by bit, a text a number.

A changed word spoils up to ``K`` k-mers: of two texts at similarity 0.8 whose changes lie anywhere, 0.38 of the
k-mers are shared. They agree on a sketch with probability 0.15, and on none of 24 with 0.02; limits of what is aligned
follow from the same numbers. Texts that differ in fewer places are missed more seldom: at 0.9 fewer than 1 in 10^5.

1. Texts with the same words share a fingerprint; only its least document goes on.
2. Texts that share a sketch meet in its bucket. Each is compared with the bucket's least
   document: as many comparisons as members, however large the bucket.
3. Verified links give components. Buckets whose members still lie in several components
   are searched for pairs across components, in blocks of bounded size: pairs that sketches
   and outlines leave open are aligned there, likeliest first, unless links found meanwhile
   already join them, each in the first bucket that both are in. So no link between different
   texts of a bucket that could join two components is lost, and only links leave the task.
4. The components of all links are the classes.

Defined results: a text of 1 to K-1 words is one k-mer. Texts without words (null and empty
ones among them) are copies if their characters are equal. Rows with a null doc_id have no
class; ids must be whole numbers (or text that spells them). Repeated rows with one doc_id stay
together. Other columns are ignored.
"""

from __future__ import annotations

import re
from math import comb, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import arrow_map, packed, small, staged, text_of, unpacked, worker_cache
from .components import components

K, SKETCHES, PICK, SIMILARITY = 5, 24, 2, 0.8
#: Cells of an outline: the least k-mer of each of as many hash cells.
CELLS = 256


def shared_kmers(similarity: float) -> float:
    """The k-mers that two texts of equal length at ``similarity`` share, among all of either, if their changes lie anywhere."""
    whole = (2 * similarity / (1 + similarity)) ** K
    return whole / (2 - whole)


def limits(similarity: float) -> tuple[int, float]:
    """(sketches, share of the outlines) that all but one in 10^4 pairs at ``similarity`` reach; one sketch at least."""
    kmers_alike = shared_kmers(similarity)
    p = kmers_alike**PICK
    tail, agree = 0.0, 0
    while agree < SKETCHES and (tail := tail + comb(SKETCHES, agree) * p**agree * (1 - p) ** (SKETCHES - agree)) < 5e-5:
        agree += 1
    return max(1, agree), kmers_alike - 4 * sqrt(kmers_alike * (1 - kmers_alike) / CELLS)


#: Members of a bucket that one task compares with each other.
BLOCK = 1024
CACHE = 400_000
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class _Hashes(dict):
    """64-bit hashes of words, kept for the life of the worker within a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


_SEEDS = np.array([xxhash.xxh3_64_intdigest(f"order {i}") | 1 for i in range(2 * SKETCHES)], "u8").reshape(2, -1, 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def kmers(found: list[str], k: int = K) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers of a word list, in text order."""
    if not found:
        return np.zeros(0, "u8")
    h = np.fromiter(map(worker_cache("word hashes", _Hashes).__getitem__, found), "u8", len(found))
    k = min(k, len(h))
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = out * _ODD + h[i : i + n]
    out = _mix(out)
    order = np.argsort(out, kind="stable")
    runs = out[order]
    first = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    if len(first) < n:
        label = np.empty(n, "u8")
        label[order] = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
        out = np.where(label > 0, _mix(out + label * _ODD), out)
    return out


def sketch(h: np.ndarray) -> np.ndarray:
    """One 64-bit value for each hash order: the least labelled k-mers, in text order."""
    pick = min(PICK, len(h))
    out = np.empty(SKETCHES, "u8")
    step = max(1, 2_000_000 // (8 * len(h)))
    for at in range(0, SKETCHES, step):
        v = (h ^ _SEEDS[0, at : at + step]) * _SEEDS[1, at : at + step]
        idx = np.argpartition(v, pick - 1, axis=1)[:, :pick] if pick < len(h) else np.tile(np.arange(len(h)), (len(v), 1))
        idx.sort(axis=1)
        s = _SEEDS[0, at : at + step, 0]
        for j in range(pick):
            s = _mix(s * _ODD + h[idx[:, j]])
        out[at : at + step] = s
    return out


def outline(h: np.ndarray) -> bytes:
    """16 bits of the least labelled k-mer of each hash cell; 0 for an empty cell."""
    v = np.sort(h)
    cell, first = np.unique(v % np.uint64(CELLS), return_index=True)
    out = np.zeros(CELLS, "u2")
    out[cell.astype("i8")] = ((v[first] >> np.uint64(17)) & np.uint64(0xFFFF)).astype("u2") | 1
    return out.tobytes()


def shared_part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Part of the cells that either outline (row) fills in which they are equal."""
    return ((x == y) & (x > 0)).sum(1) / np.maximum(((x > 0) | (y > 0)).sum(1), 1)


def outlines(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "u2").reshape(-1, CELLS)


def codes(found: list[str]) -> np.ndarray:
    """32 bits of each word's hash, in text order."""
    h = worker_cache("word hashes", _Hashes)
    return (np.fromiter(map(h.__getitem__, found), "u8", len(found)) >> np.uint64(32)).astype("<u4")


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Order-sensitive similarity of two word sequences; exact where it reaches ``similarity``.

    Each row of the alignment is one number: bit j is 0 where the row's best gains a word at the other text's word j.
    A row adds its word's places, within the band, in three operations on the whole number.
    """
    n = len(a) + len(b)
    if not n:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) < similarity * len(b):
        return 0.0
    # m / (n - m) >= s leaves at most n - 2m <= n (1 - s) / (1 + s) unmatched words: the band.
    band = int(n * (1 - similarity) / (1 + similarity)) + 1
    x, y = a.tolist(), b.tolist()
    places: dict[int, int] = {}
    for j, w in enumerate(y):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(y)) - 1
    window, rows = (1 << 2 * band + 1) - 1, full
    for i, w in enumerate(x):
        here = places.get(w, 0) & (window << i - band if i >= band else window >> band - i)
        if here:
            gain = rows & here
            rows = (rows + gain | rows - gain) & full
    m = len(y) - rows.bit_count()
    return m / (n - m)


def bag(words_: np.ndarray) -> np.ndarray:
    """The words of a text with their occurrences, sorted: each once."""
    x = np.sort(words_)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
    label = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
    return x.astype("u8") << np.uint64(32) | label.astype("u8")


def at_most(a: np.ndarray, b: np.ndarray) -> float:
    """A bound of the similarity of two texts from their bags: that of the words they share in any order."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    m = int((both[1:] == both[:-1]).sum())
    return m / (len(a) + len(b) - m)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, print, n, sketch, outline) of every document with an id."""
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("print", BinaryType()),
            StructField("n", IntegerType()),
            StructField("sketch", ArrayType(LongType())),
            StructField("outline", BinaryType()),
        ]
    )

    def make():
        def work(rows):
            out = {"doc_id": rows["doc_id"], "print": [], "n": [], "sketch": [], "outline": []}
            for t in rows["text"]:
                w = words(t)
                out["print"].append(xxhash.xxh3_128_digest("\n".join(w) if w else f"\0{t}"))
                h = kmers(w)
                out["n"].append(len(w))
                out["sketch"].append(sketch(h).view("i8") if len(h) else np.zeros(0, "i8"))
                out["outline"].append(outline(h))
            return out

        return work

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return arrow_map(rows, schema, make)


def verify(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts are similar enough."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    both = (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    schema = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("same", BooleanType())])

    def make():
        last: list = [None, None]

        def work(rows):
            same = []
            for a, x, y in zip(rows["a"], rows["text_a"], rows["text_b"]):
                if last[0] != (a, x):
                    last[:] = (a, x), codes(words(x))
                same.append(bool(aligned(last[1], codes(words(y)), similarity) >= similarity))
            return {"a": rows["a"], "b": rows["b"], "same": same}

        return work

    return arrow_map(both, schema, make, rows=64).where("same").select("a", "b").distinct()


def likely(pairs: DataFrame, known: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The (a, b) of ``pairs`` whose sketches and outlines leave it open that they are similar."""
    agree, alike = limits(similarity)
    side = lambda c: known.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"), F.col("outline").alias(f"o_{c}"))
    enough = (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")) & (F.size(F.array_intersect("s_a", "s_b")) >= agree)
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(enough).select("a", "b", "o_a", "o_b")
    schema = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("open", BooleanType())])

    def make():
        return lambda rows: {"a": rows["a"], "b": rows["b"], "open": shared_part(outlines(rows["o_a"]), outlines(rows["o_b"])) >= alike if rows["a"] else []}

    return arrow_map(both, schema, make, rows=4096).where("open").select("a", "b")


class _Groups:
    """Whole groups of sorted rows: finds the links between components in them."""

    #: Open pairs that are gathered before they are aligned.
    MOST = 20_000

    def __init__(self, t: pa.Table, similarity: float):
        self.similarity, (self.agree, self.alike) = similarity, limits(similarity)
        self.bucket, self.i, self.j, self.side, self.ids, root, self.n = (
            t.column(c).to_numpy() for c in ("bucket", "i", "j", "side", "doc_id", "root", "n")
        )
        self.sketch = t.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES)
        self.outline = outlines(t.column("outline").to_pylist())
        self.words = [np.frombuffer(x, "<u4") for x in t.column("words").to_pylist()]
        self.bags: dict[int, np.ndarray] = {}
        fresh = (self.bucket[1:] != self.bucket[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])
        self.group = np.r_[0, np.cumsum(fresh)]
        _, self.root = np.unique(root, return_inverse=True)
        self.above = [*range(int(self.root.max()) + 1)]
        #: The component of each row, as far as links have been found.
        self.now = self.root
        self.starts = np.flatnonzero(np.r_[True, fresh])
        self.links: list[tuple[int, int]] = []

    def top(self, k: int) -> int:
        while self.above[k] != k:
            self.above[k] = k = self.above[self.above[k]]
        return k

    def align(self, a: np.ndarray, b: np.ndarray, part: np.ndarray) -> None:
        order = np.argsort(-part, kind="stable")
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            p, q = self.top(self.root[x]), self.top(self.root[y])
            if p != q and self.similar(x, y):
                self.above[max(p, q)] = min(p, q)
                self.links.append((int(min(self.ids[x], self.ids[y])), int(max(self.ids[x], self.ids[y]))))
        self.now = np.array([self.top(k) for k in range(len(self.above))])[self.root]

    def similar(self, x: int, y: int) -> bool:
        """The words that two rows share in any order bound what an alignment can find, and are sooner counted."""
        for k in (x, y):
            if k not in self.bags:
                self.bags[k] = bag(self.words[k])
        if at_most(self.bags[x], self.bags[y]) < self.similarity:
            return False
        return aligned(self.words[x], self.words[y], self.similarity) >= self.similarity

    def joined(self) -> bool:
        """Whether each group is a single component."""
        return bool((np.minimum.reduceat(self.now, self.starts) == np.maximum.reduceat(self.now, self.starts)).all())

    def search(self) -> list[tuple[int, int]]:
        """Rows of a group stand together, so pairs at distance 1, 2, ... are looked at for all groups at once."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for d in range(1, len(self.ids)):
            same = self.group[d:] == self.group[:-d]
            if not same.any():
                break
            low, high = np.minimum(self.n[d:], self.n[:-d]), np.maximum(self.n[d:], self.n[:-d])
            ok = same & (self.now[d:] != self.now[:-d]) & (low >= self.similarity * high)
            at = np.flatnonzero(ok & ((self.i == self.j)[d:] | (self.side[d:] != self.side[:-d])))
            agree = self.sketch[at] == self.sketch[at + d]
            # A pair belongs to the first bucket that both are in.
            first = self.sketch[at, agree.argmax(1)] == self.bucket[at]
            at = at[first & (agree.sum(1) >= self.agree)]
            part = shared_part(self.outline[at], self.outline[at + d])
            at, part = at[part >= self.alike], part[part >= self.alike]
            held.append((at, at + d, part))
            size += len(at)
            if size >= self.MOST:
                self.align(*map(np.concatenate, zip(*held)))
                held, size = [], 0
                if self.joined():
                    break
        if held:
            self.align(*map(np.concatenate, zip(*held)))
        return self.links


def _across(batches, similarity: float = SIMILARITY):
    """Links (a, b) from rows sorted by (bucket, i, j); at most one group is held over from batch to batch."""
    held: pa.Table | None = None

    def result(t: pa.Table):
        if found := _Groups(t, similarity).search():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not t.num_rows:
            continue
        keys = [t.column(c).to_numpy() for c in ("bucket", "i", "j")]
        last = np.logical_and.reduce([k == k[-1] for k in keys])
        start = int(np.argmax(last))
        held = t.slice(start)
        if start:
            yield from result(t.slice(0, start))
    if held is not None and held.num_rows > 1:
        yield from result(held)


def links(known: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links among the distinct texts of ``known`` (doc_id, n, sketch, outline), enough to give every component."""
    sk = known.where("n > 0")
    keyed = sk.select("doc_id", F.explode("sketch").alias("bucket"))
    shared = staged(keyed.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = staged(keyed.join(shared, "bucket"), "members")
    met = members.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = staged(likely(met, sk, similarity), "pairs")
    sure = staged(verify(pairs, docs, similarity), "near")

    # Buckets that still hold several components.
    root = components(sure)
    placed = staged(
        members.join(root, members["doc_id"] == root["node"], "left").select(
            "bucket", "doc_id", F.coalesce("root", "doc_id").alias("root")
        ),
        "placed",
    )
    mixed = (
        placed.groupBy("bucket")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
        .where("low < high")
        .select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    rows = staged(
        placed.join(mixed, "bucket")
        .withColumn("side", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "doc_id", "root"),
        "open-members",
    )
    spelled = staged(sequences(docs, staged(rows.select("doc_id").distinct(), "open-ids")), "open-texts")
    full = rows.join(sk.select("doc_id", "n", "sketch", "outline").join(spelled, "doc_id"), "doc_id").select(
        "bucket", "i", "j", "side", "doc_id", "root", "n", "sketch", "outline", "words"
    )
    # The work grows with the pairs of a bucket, not with its bytes: a number of partitions of its own.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = full.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return sure.unionByName(full.mapInArrow(lambda batches: _across(batches, similarity), "a long, b long"))


def sequences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, words) of the wanted documents: 32 bits of each word, in text order."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = texts.join(small(wanted), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    schema = StructType([StructField("doc_id", LongType()), StructField("words", BinaryType())])

    def make():
        return lambda cols: {"doc_id": cols["doc_id"], "words": [codes(words(t)).tobytes() for t in cols["text"]]}

    return arrow_map(rows, schema, make)


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every document with an id; class_id is the least doc_id of the class."""
    every = staged(sketches(docs), "sketches")
    first = every.groupBy("print").agg(F.min("doc_id").alias("rep"))
    copies = staged(every.select("doc_id", "print").join(first, "print").select("doc_id", "rep").distinct(), "copies")
    reps = copies.where("doc_id = rep").select("doc_id").distinct()
    known = staged(every.select("doc_id", "n", "sketch", "outline").dropDuplicates(["doc_id"]).join(reps, "doc_id", "left_semi"), "distinct")
    root = components(links(known, docs, similarity))
    return copies.join(root, copies["rep"] == root["node"], "left").select(
        "doc_id", F.coalesce("root", "rep").alias("class_id")
    )


def distinct_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that are first of their class, and those without an id; columns as they are."""
    gone = classes(docs, similarity).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    rows = packed(docs)
    rows = rows.join(gone, rows["doc_id"] == F.col("_gone"), "left_anti")
    return rows.select(*unpacked(rows, docs.columns))
