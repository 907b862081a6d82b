"""All-vs-all sequence search: spaced seeds, shared diagonals, banded alignment with affine gaps, e-values.

A sequence is an array of codes: letters of a protein, or hashed words of a text. Two sequences are candidates if
they share at least ``min_seeds`` spaced seeds on neighbouring diagonals; seeds go by classes of alike letters. Each
run of diagonals with seeds is aligned in a band around it, from some letters before its first seed to some after its last,
and again with more of them as long as the alignment ends near that limit; a pair's highest-scoring local alignment
is its hit, with the columns that the screen's filters read.

Spark deals the work in tiles, a part of the sequences that ask against a part of all: a task finds the seeds of both, counts their meetings by
diagonal and aligns the pairs, some at a time, each two different sequences once, whatever the number of their copies. Only letters travel to a task
and only hits leave it, so that what is written in between doesn't follow the pairs. Scores are computed first, in small numbers; what leads to
a cell is followed only where the best alignment has gaps. ``candidates`` and ``aligned`` do the same for pairs as tables: seeds joined by seed, pairs that meet their sequences in tiles.

Defined results: a null, empty or very short sequence has no seeds and no hits but counts for nothing else. Hits
within a group are left out, as the screen has no use for them. Repeated rows of one item are one item; if their sequences
differ, one of them counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Ten classes of alike amino acids (fixed values).
ALIKE = ("LVIM", "C", "A", "G", "ST", "P", "FYW", "EDNQ", "KR", "H")
#: Diagonals counted together, columns added on either side of a band, pairs aligned at a time, parts of a seed's sequences.
DIAGONALS, MARGIN, AT_ONCE, SALT = 16, 24, 64, 4
#: Pairs among which those of like width and length are looked for, letters of one side that a tile of pairs holds, tiles of all sets, at least.
CHOICE, LETTERS, TILES = 1024, 1 << 24, 32
#: Meetings of seeds, and pairs, that a tile holds at a time; pairs that are aligned together, their cells; hits in a batch.
MEETS, POOL, TOGETHER, CELLS, HITS = 1 << 19, 1 << 17, 256, 1 << 21, 1 << 16
#: Letters aligned before the first and after the last seed; an alignment that ends within ``EDGE`` of them is made again with more.
AROUND, EDGE = 64, 16
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Scheme:
    """Scores and seeds. A gap of n letters costs ``open`` + n * ``extend``; ``p_match`` and ``p_alike`` are what chance gives."""

    match: int = 5
    alike: int = 1
    mismatch: int = -4
    open: int = 8
    extend: int = 2
    classes: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ("1110111", "11011011")
    #: Of as many neighbouring places only the seed of the least hash counts; 1: all do.
    window: int = 1
    min_seeds: int = 2
    p_match: float = 0.05
    p_alike: float = 0.0
    k: float = 0.1

    @property
    def decay(self) -> float:
        """The lambda of the score statistics: the positive root of the expectation of exp(lambda * score) = 1."""
        part = ((self.p_match, self.match), (self.p_alike, self.alike), (1 - self.p_match - self.p_alike, self.mismatch))
        low, high = 1e-6, 20.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(p * exp(mid * s) for p, s in part) < 1 else (low, mid)
        return low

    def class_of(self) -> np.ndarray | None:
        """The class of each letter's code; letters of no class are classes of their own. None: codes are their own classes."""
        if not self.classes:
            return None
        out = np.arange(1 << 16, dtype="i8")
        for letters in self.classes:
            for x in letters:
                out[ord(x)] = ord(letters[0])
        return out


PROTEIN = Scheme(match=6, alike=2, mismatch=-3, open=9, extend=1, classes=ALIKE, patterns=("11101011", "1101100111"), p_match=0.06, p_alike=0.12, k=0.05)
#: An exact match of 11 words (8 under the pattern, and 3 places more) holds a seed that both sides choose.
WORDS = Scheme(patterns=("11011011",), window=4, min_seeds=1)


def letters(sequence: Column) -> Column:
    """The codes of a string's letters, upper-cased."""
    return F.transform(F.split(F.upper(sequence), ""), lambda x: F.ascii(x))


def words(text: Column) -> Column:
    """The codes of a text's words, lower-cased: 32 bits of a hash, which is what travels of a text."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.hash(x))


# ---- seeds -----------------------------------------------------------------------------


def spaced(codes: np.ndarray, pattern: str) -> np.ndarray:
    """A hash at each place of the letters under the ones of ``pattern``."""
    n = len(codes) - len(pattern) + 1
    h = np.full(max(n, 0), len(pattern) * 31 + sum(1 << i for i, x in enumerate(pattern) if x == "1"), "u8")
    for i, x in enumerate(pattern):
        if x == "1" and n > 0:
            h = h * _ODD + codes[i : i + n].astype("i8").view("u8")
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def chosen(h: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the least of some ``window`` neighbouring ones: two texts that share them choose the same."""
    if window <= 1 or len(h) <= 1:
        return np.arange(len(h), dtype="i4")
    w = min(window, len(h))
    each = np.lib.stride_tricks.sliding_window_view(h, w)
    return np.unique(each.argmin(1) + np.arange(len(each))).astype("i4")


def seeds(items: DataFrame, scheme: Scheme) -> DataFrame:
    """(set_id, item, asks, seed, at) of every chosen place of every sequence."""
    schema = "set_id long, item long, asks boolean, seed long, at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = scheme.class_of()
        for batch in batches:
            for row in range(batch.num_rows):
                codes = batch.column("codes")[row].values.to_numpy(zero_copy_only=False)
                codes = codes if table is None else table[np.clip(codes, 0, len(table) - 1)]
                found = [spaced(codes, p) for p in scheme.patterns]
                places = [chosen(x, scheme.window) for x in found]
                h, at = np.concatenate([x[i] for x, i in zip(found, places)]).view("i8"), np.concatenate(places)
                same = [pa.repeat(batch.column(c)[row], len(h)) for c in ("set_id", "item", "asks")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(h), pa.array(at)], ["set_id", "item", "asks", "seed", "at"])

    return items.select("set_id", "item", "asks", "codes").mapInArrow(run, schema)


def candidates(items: DataFrame, scheme: Scheme, salt: int = SALT) -> DataFrame:
    """(set_id, q, s, runs) of pairs with enough seeds on neighbouring diagonals. items: (set_id, item, asks, codes), one row a sequence.

    runs: (band, n, low, high, first, last), the seeds of a band, their lowest and highest diagonal and their first and last place in q.
    The sequences that hold a seed are dealt to ``salt`` parts, and each of those that ask goes to all of them.
    A pair of which both ask is met once, from its lower item.
    """
    found = seeds(items, scheme)
    own = F.pmod(F.xxhash64("item"), F.lit(salt)).cast("int")
    q = found.where("asks").select("set_id", "seed", F.col("item").alias("q"), F.col("at").alias("qa"), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("part"))
    s = found.select("set_id", "seed", F.col("item").alias("s"), F.col("asks").alias("s_asks"), F.col("at").alias("sa"), own.alias("part"))
    met = q.join(s, ["set_id", "seed", "part"]).where("q < s or q <> s and not s_asks").select("set_id", "q", "s", "qa", (F.col("sa") - F.col("qa")).alias("d"))
    band = F.floor(F.col("d") / DIAGONALS).cast("int").alias("band")
    runs = met.groupBy("set_id", "q", "s", band).agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), F.min("qa").alias("first"), F.max("qa").alias("last"))
    pairs = runs.groupBy("set_id", "q", "s").agg(F.array_sort(F.collect_list(F.struct("band", "n", "low", "high", "first", "last"))).alias("runs"))
    beside = lambda x, i: F.when(F.get("runs", i + 1)["band"] == x["band"] + 1, F.get("runs", i + 1)["n"]).otherwise(0)
    return pairs.where(F.size(F.filter("runs", lambda x, i: x["n"] + beside(x, i) >= scheme.min_seeds)) > 0)


# ---- alignment -------------------------------------------------------------------------


def align(queries: list[np.ndarray], subjects: list[np.ndarray], low: list[int], width: int, scheme: Scheme) -> np.ndarray:
    """Best local alignment of each pair in a band of ``width`` diagonals from ``low`` (subject place less query place).

    Returns rows of score, matches, columns, gap openings and the places of the first and last letters of both. All pairs go
    row by row together; along a row a gap is a running maximum. Ties: no gap before a gap, a shorter gap before a
    longer one, and the end that comes first.
    """
    n, rows = len(queries), max(map(len, queries))
    table = scheme.class_of()
    first, extend = scheme.open + scheme.extend, scheme.extend
    low_at, columns = np.array(low, "i8"), np.arange(width, dtype="i8")
    none = np.int64(-(1 << 40))
    a = np.full((n, rows), -1, "i8")
    b = np.full((n, max(map(len, subjects))), -2, "i8")
    for k, (x, y) in enumerate(zip(queries, subjects)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    size_a, size_b = np.array([len(x) for x in queries]), np.array([len(x) for x in subjects])
    # What leads to a cell, in two packed numbers: (matches, pairs of letters) and (letters of the query and of the subject in gaps, gaps).
    one_match, one_pair, one_a, one_b = np.int64((1 << 32) + 1), np.int64(1), np.int64(1 << 40), np.int64(1 << 20)
    h, h1, h2 = (np.zeros((n, width + 1), "i8") for _ in range(3))  # a column more, outside the band
    f, f1, f2 = np.full((n, width + 1), none), h1.copy(), h2.copy()
    best = np.zeros((n, 5), "i8")  # score, packed numbers, row, column
    ramp, lanes = columns * extend, np.arange(n)[:, None]
    for i in range(rows):
        j = i + low_at[:, None] + columns
        inside = (j >= 0) & (j < size_b[:, None]) & (i < size_a)[:, None]
        x, y = a[:, i, None], np.take_along_axis(b, np.clip(j, 0, b.shape[1] - 1), 1)
        equal = x == y
        score = np.where(equal, scheme.match, scheme.mismatch)
        if table is not None:
            alike = ~equal & (table[np.clip(x, 0, len(table) - 1)] == table[np.clip(y, 0, len(table) - 1)])
            score = np.where(alike, scheme.alike, score)
        # Down: a letter of the query against a gap.
        opened, longer = h[:, 1:] - first, f[:, 1:] - extend
        fresh = opened >= longer
        g, g1 = np.where(fresh, opened, longer), np.where(fresh, h1[:, 1:], f1[:, 1:])
        g2 = np.where(fresh, h2[:, 1:] + 1, f2[:, 1:]) + one_a
        d = h[:, :-1] + score
        down = g > d
        x0, x1, x2 = np.where(down, g, d), np.where(down, g1, h1[:, :-1] + np.where(equal, one_match, one_pair)), np.where(down, g2, h2[:, :-1])
        x0 = np.where(inside, x0, none)
        nothing = x0 <= 0
        x0, x1, x2 = np.where(nothing & inside, 0, x0), np.where(nothing, 0, x1), np.where(nothing, 0, x2)
        # Along: a letter of the subject against a gap that opened at the best place before.
        place = np.maximum.accumulate((x0 + ramp) * 65536 + columns, axis=1)
        source = np.concatenate([np.zeros((n, 1), "i8"), place[:, :-1] & 65535], axis=1)
        e = np.concatenate([np.full((n, 1), none), (place[:, :-1] >> 16) - first - ramp[:-1]], axis=1)
        along = inside & (e > x0)
        e1 = x1[lanes, source]
        e2 = x2[lanes, source] + 1 + (columns - source) * one_b
        h[:, :-1], h1[:, :-1], h2[:, :-1] = np.where(along, e, np.where(inside, x0, 0)), np.where(along, e1, x1), np.where(along, e2, x2)
        f[:, :-1], f1[:, :-1], f2[:, :-1] = np.where(inside, g, none), g1, g2
        at = h[:, :-1].argmax(1)
        top = h[lanes[:, 0], at]
        better = top > best[:, 0]
        if better.any():
            k = lanes[better, 0]
            best[k] = np.stack([top[better], h1[k, at[k]], h2[k, at[k]], np.full(len(k), i), i + low_at[k] + at[k]], 1)
    matches, pairs = best[:, 1] >> 32, best[:, 1] & 0xFFFFFFFF
    gap_a, gap_b, gaps = best[:, 2] >> 40, (best[:, 2] >> 20) & 0xFFFFF, best[:, 2] & 0xFFFFF
    return np.stack([best[:, 0], matches, pairs + gap_a + gap_b, gaps, best[:, 3] - pairs - gap_a + 1, best[:, 3], best[:, 4] - pairs - gap_b + 1, best[:, 4]], 1)


def bands(runs: list[dict]) -> list[list[int]]:
    """[seeds, lowest, highest diagonal, first, last place] of each run of neighbouring bands."""
    out: list[list[int]] = []
    last = None
    for r in runs:
        if last is not None and r["band"] == last + 1:
            run = out[-1]
            run[0], run[2], run[3], run[4] = run[0] + r["n"], r["high"], min(run[3], r["first"]), max(run[4], r["last"])
        else:
            out.append([r["n"], r["low"], r["high"], r["first"], r["last"]])
        last = r["band"]
    return out


def align_runs(codes: list[tuple[np.ndarray, np.ndarray]], runs: list[list[dict]], scheme: Scheme) -> dict[int, np.ndarray]:
    """The best alignment of each pair that has one, from all its runs: those of like width and length go together."""
    span = max(map(len, scheme.patterns))
    tasks = []
    for pair, each in enumerate(runs):
        for n, low, high, first, last in bands(each):
            if n >= scheme.min_seeds:
                width = -(-(high - low + 1 + 2 * MARGIN) // 32) * 32
                tasks.append((pair, low - MARGIN, width, first, last + span, AROUND))
    best: dict[int, np.ndarray] = {}
    while tasks:
        placed = []
        for pair, low, width, first, last, around in tasks:
            start, end = max(0, first - around), min(len(codes[pair][0]), last + around)
            placed.append((width, end - start, pair, low, start, end, (pair, low, width, first, last, 4 * around)))
        placed.sort()
        tasks, at = [], 0
        while at < len(placed):
            to = at + 1
            while to < len(placed) and placed[to][0] == placed[at][0] and placed[to][1] <= 2 * placed[at][1] and to - at < AT_ONCE:
                to += 1
            some = placed[at:to]
            cut = [max(0, start + low) for *_, low, start, _, _ in some]
            width = some[0][0]
            queries = [codes[pair][0][start:end] for _, _, pair, _, start, end, _ in some]
            subjects = [codes[pair][1][c : max(c, end + low + width)] for (_, _, pair, low, _, end, _), c in zip(some, cut)]
            got = align(queries, subjects, [low + start - c for (*_, low, start, _, _), c in zip(some, cut)], width, scheme)
            for (_, _, pair, _, start, end, more), c, found in zip(some, cut, got):
                found[4:6] += start
                found[6:8] += c
                if found[0] and (start and found[4] - start < EDGE or end < len(codes[pair][0]) and end - found[5] <= EDGE):
                    tasks.append(more)
                elif found[0] and (pair not in best or (-found[0], *found[4:]) < (-best[pair][0], *best[pair][4:])):
                    best[pair] = found
            at = to
    return best


ALIGNED = StructType(
    [StructField(c, LongType()) for c in ("set_id", "q", "s")]
    + [StructField(c, IntegerType()) for c in ("raw_score", "matches", "length", "gapopen", "qstart", "qend", "sstart", "send", "qlen", "slen")]
)


def grid(items: DataFrame) -> DataFrame:
    """(set_id, queries, subjects): into how many parts a set's sequences are cut on either side of its pairs.

    A part has at most ``LETTERS`` letters or so; a set with a large part of all letters has as large a part of ``TILES`` tiles, cut so that few letters travel.
    """
    n = F.size("codes").cast("double")
    sizes = items.groupBy("set_id").agg(F.sum(n).alias("s"), F.sum(F.when(F.col("asks"), n).otherwise(0.0)).alias("q"))
    tiles = F.ceil(TILES * F.col("s") / F.col("total"))
    x = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("s").alias("total")))).withColumn("tiles", tiles)
    x = x.withColumn("queries", F.greatest(F.lit(1), F.ceil(F.col("q") / LETTERS), F.round(F.sqrt(F.col("tiles") * F.col("q") / F.col("s")))).cast("int"))
    subjects = F.greatest(F.ceil(F.col("s") / LETTERS), F.ceil(F.col("tiles") / F.col("queries"))).cast("int")
    return x.select("set_id", "queries", subjects.alias("subjects"))


TILE = ("set_id", "i", "j")


def tiled(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(set_id, i, j, kind, q, s, runs, codes): each tile's queries (kind 0) and subjects (1), which stand before its pairs (2).

    A tile is a part of the queries against a part of the subjects. What travels of sequences doesn't follow the pairs.
    """
    cut = grid(items)
    part = lambda name, parts: F.pmod(F.xxhash64(name), parts).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    runs = dict(pairs.dtypes)["runs"]
    codes = dict(items.dtypes)["codes"]
    x = items.join(cut, "set_id")
    q = x.where("asks").select("set_id", part("item", "queries").alias("i"), all_of("subjects").alias("j"), F.lit(0).alias("kind"), F.col("item").alias("q"), none("s", "long"), none("runs", runs), "codes")
    s = x.select("set_id", all_of("queries").alias("i"), part("item", "subjects").alias("j"), F.lit(1).alias("kind"), none("q", "long"), F.col("item").alias("s"), none("runs", runs), "codes")
    met = pairs.join(cut, "set_id").select("set_id", part("q", "queries").alias("i"), part("s", "subjects").alias("j"), F.lit(2).alias("kind"), "q", "s", "runs", none("codes", codes))
    slots = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return q.unionByName(s).unionByName(met).repartition(max(slots, TILES), *TILE).sortWithinPartitions(*TILE, "kind")


def aligned(pairs: DataFrame, items: DataFrame, scheme: Scheme) -> DataFrame:
    """The best local alignment of each candidate pair; places count from 0.

    A task holds one tile's sequences and takes its pairs as they come: memory follows the letters of a tile, whatever the number of its pairs.
    """
    schema = to_arrow_schema(ALIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ({}, {})
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*TILE, "kind"))))
            start = 0
            while start < len(keys):
                key, end = keys[start], start + 1
                while end < len(keys) and keys[end] == key:
                    end += 1
                if key[:3] != at:
                    at, held = key[:3], ({}, {})
                if key[3] == 2:
                    for k in range(start, end, CHOICE):
                        yield from work(batch.slice(k, min(CHOICE, end - k)), *held)
                else:
                    some = batch.slice(start, end - start)
                    for item, c in zip(some.column("qs"[key[3]]).to_pylist(), some.column("codes")):
                        held[key[3]][item] = c.values.to_numpy(zero_copy_only=False)
                start = end

    def work(some: pa.RecordBatch, of_q: dict, of_s: dict) -> Iterator[pa.RecordBatch]:
        codes = [(of_q[x], of_s[y]) for x, y in zip(some.column("q").to_pylist(), some.column("s").to_pylist())]
        best = align_runs(codes, some.column("runs").to_pylist(), scheme)
        rows = sorted(best)
        if rows:
            cells = [some.column(c).take(pa.array(rows)) for c in ("set_id", "q", "s")]
            found = np.stack([best[r] for r in rows])
            cells += [pa.array(found[:, k], pa.int32()) for k in range(8)] + [pa.array([len(codes[r][side]) for r in rows], pa.int32()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays(cells, schema=schema)

    return tiled(pairs, items).mapInArrow(run, ALIGNED)


# ---- tiles of sequences ----------------------------------------------------------------


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, "i8")
    return np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in columns], axis=0)])


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``begin`` and as many numbers after it as ``count`` says, one after another."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


def absent(flat: np.ndarray, n: int) -> list[int]:
    """Codes that no letter has."""
    out, x = [], -1
    while len(out) < n:
        if not (flat == x).any():
            out.append(x)
        x -= 1
    return out


def banded(flat: np.ndarray, none: list[int], a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], low: np.ndarray, width: int, scheme: Scheme) -> np.ndarray:
    """``align`` of letters ``a`` with ``b``, each as places in ``flat`` (from, to); ``low``: the diagonal of their first letters.

    Scores are computed first, in small numbers. The score of the diagonal on which the best alignment ends shows if that is the best without
    gaps: then it is what ``align`` finds, as no gap comes before a gap. Only the other pairs are aligned with all that leads to a cell.
    """
    n, size = len(low), a[1] - a[0]
    rows, each = int(size.max()), np.arange(len(low))
    table = scheme.class_of()
    first, extend = scheme.open + scheme.extend, scheme.extend
    kind = "i2" if (rows + 1) * scheme.match + width * extend + first < 32000 else "i8"
    r = np.arange(rows)[:, None]
    x = np.where(r < size, flat[np.minimum(a[0] + r, a[1] - 1)], none[0])
    place = np.arange(rows + width - 1)[:, None] + low + b[0]
    y = np.where((place >= b[0]) & (place < b[1]), flat[np.clip(place, b[0], b[1] - 1)], none[1])
    like = None if table is None else [np.where(z < 0, z, table[np.clip(z, 0, len(table) - 1)]) for z in (x, y)]

    h, before = np.zeros((2, width + 1, n), kind)  # a diagonal more, outside the band
    f = np.full((width + 1, n), -first, kind)
    d, g, t, none_left = np.zeros((4, width, n), kind)
    ramp = np.repeat((np.arange(width) * extend).astype(kind)[:, None], n, 1)
    back = ramp[:-1] + np.array(first, kind)
    equal, alike, score = np.empty((width, n), bool), np.empty((width, n), bool), np.empty((width, n), "i1")
    best, at, column, high = np.zeros(n, kind), np.zeros(n, "i8"), np.zeros(n, "i8"), 0
    rising = np.zeros(n, bool)
    for i in range(rows):
        h, before = before, h
        np.equal(x[i], y[i : i + width], out=equal)
        np.multiply(equal.view("i1"), np.int8(scheme.match - scheme.mismatch), out=score)
        if like is not None:
            np.equal(like[0][i], like[1][i : i + width], out=alike)
            np.greater(alike, equal, out=alike)
            score += alike.view("i1") * np.int8(scheme.alike - scheme.mismatch)
        np.add(score, np.int8(scheme.mismatch), out=score)
        np.add(before[:-1], score, out=d)
        np.subtract(before[1:], first, out=g)
        np.subtract(f[1:], extend, out=t)
        np.maximum(g, t, out=f[:-1])
        np.maximum(d, f[:-1], out=d)
        np.maximum(d, none_left, out=d)
        high += scheme.match
        if high > first:
            # The highest before each diagonal, from 1, 2, 4 ... places before: no further than a gap can pay.
            np.add(d, ramp, out=g)
            k, far = 1, min(width, (high - scheme.open) // extend + 1)
            while k < far:
                t[:k] = g[:k]
                np.maximum(g[k:], g[:-k], out=t[k:])
                g, t, k = t, g, 2 * k
            np.subtract(g[:-1], back, out=t[:-1])
            h[0] = d[0]
            np.maximum(d[1:], t[:-1], out=h[1:-1])
        else:
            h[:-1] = d
        top = h[:-1].max(0)
        high = int(top.max())
        better = top > best
        # A pair's column is looked for where its scores stop to rise.
        ended = np.flatnonzero(rising & ~better)
        if len(ended):
            column[ended] = before[:-1, ended].argmax(0)
        rising = better
        np.maximum(best, top, out=best)
        at[better] = i
    ended = np.flatnonzero(rising)
    if len(ended):
        column[ended] = h[:-1, ended].argmax(0)

    # The best without gaps that ends there, from the sums along its diagonal.
    on = y[r + column, each]
    equal = x == on
    score = np.where(equal, scheme.match, scheme.mismatch)
    if like is not None:
        score = np.where(~equal & (like[0] == like[1][r + column, each]), scheme.alike, score)
    sums = np.concatenate([np.zeros((1, n), "i8"), score.cumsum(0)])
    least = np.minimum.accumulate(sums, axis=0)[at, each]
    begin = rows - 1 - ((sums[:-1] == least) & (r <= at))[::-1].argmax(0)
    matches = np.concatenate([np.zeros((1, n), "i8"), equal.cumsum(0)])
    length = at + 1 - begin
    s = low + column
    out = np.stack([best.astype("i8"), matches[at + 1, each] - matches[begin, each], length, np.zeros(n, "i8"), begin, at, begin + s, at + s], 1)
    out[best == 0] = 0
    rest = np.flatnonzero((best > 0) & (sums[at + 1, each] - least != best))
    for k in range(0, len(rest), AT_ONCE):
        some = rest[k : k + AT_ONCE]
        cut = np.maximum(0, low[some])
        queries = [flat[p:q] for p, q in zip(a[0][some], a[1][some])]
        subjects = [flat[p + c : max(p + c, min(q, p + e + o + width))] for p, q, c, e, o in zip(b[0][some], b[1][some], cut, size[some], low[some])]
        out[some] = align(queries, subjects, (low[some] - cut).tolist(), width, scheme)
        out[some, 6:8] += cut[:, None]
    return out


def best_alignments(flat: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], pair: np.ndarray, run: list[np.ndarray], scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(pair, alignment) of each pair that has one, as ``align_runs`` has it. a, b: each pair's letters as places in ``flat``; run: (low, high, first, last) of each run of a pair."""
    low, high, first, last = run
    width = -(-(high - low + 1 + 2 * MARGIN) // 32) * 32
    low, last, around = low - MARGIN, last + max(map(len, scheme.patterns)), np.full(len(pair), AROUND)
    none = absent(flat, 2)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(pair):
        size = (a[1] - a[0])[pair]
        start, end = np.maximum(0, first - around), np.minimum(size, last + around)
        order = np.lexsort((low, pair, end - start, width))
        pair, low, width, first, last, around, start, end, size = (z[order] for z in (pair, low, width, first, last, around, start, end, size))
        length, found, at = end - start, np.zeros((len(pair), 8), "i8"), 0
        while at < len(pair):
            most = at + max(1, min(TOGETHER, CELLS // int(2 * length[at] + width[at])))
            alike = int(np.searchsorted(width[at:most], width[at], "right"))
            to = at + max(1, int(np.searchsorted(length[at : at + alike], 2 * length[at], "right")))
            p, s = pair[at:to], start[at:to]
            found[at:to] = banded(flat, none, (a[0][p] + s, a[0][p] + end[at:to]), (b[0][p], b[1][p]), low[at:to] + s, int(width[at]), scheme)
            at = to
        some = found[:, 0] > 0
        found[some, 4:6] += start[some, None]
        again = some & ((start > 0) & (found[:, 4] - start < EDGE) | (end < size) & (end - found[:, 5] <= EDGE))
        done.append((pair[some & ~again], found[some & ~again]))
        pair, low, width, first, last, around = (z[again] for z in (pair, low, width, first, last, 4 * around))
    pair, found = (np.concatenate(z) for z in zip(*done)) if done else (np.zeros(0, "i8"), np.zeros((0, 8), "i8"))
    order = np.lexsort((*found[:, :3:-1].T, -found[:, 0], pair))
    pair, found = pair[order], found[order]
    top = starts(pair)
    return pair[top], found[top]


class Members:
    """The items of one side of a tile by their sequences: what is looked up of each sequence (a place in ``rep``) and of the items that have it."""

    def __init__(self, parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).sort_by([("rep", "ascending"), ("item", "ascending")])
        rep, self.item, self.grp, asks, h1, h2 = (t.column(c).to_numpy() for c in ("rep", "item", "grp", "asks", "h1", "h2"))
        self.asks = asks.astype(bool)
        self.first = starts(rep)
        self.rep, self.count = rep[self.first], np.diff(np.r_[self.first, len(rep)])
        over = lambda f, x: f.reduceat(x, self.first) if len(rep) else x
        self.rep_asks = t.column("rep_asks").to_numpy().astype(bool)[self.first]
        self.lowest, self.free = over(np.minimum, self.item), over(np.logical_or, ~self.asks)
        self.highest = over(np.maximum, np.where(self.asks, self.item, np.iinfo("i8").min))
        self.group, self.mixed = over(np.minimum, self.grp), over(np.minimum, self.grp) != over(np.maximum, self.grp)
        of = np.repeat(np.arange(len(self.rep)), self.count)
        self.of = dict(zip(self.item.tolist(), zip(of.tolist(), h1.tolist(), h2.tolist())))
        self.held: set[int] = set()

    def take(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        """The sequences of a batch that aren't held yet, those of repeated rows or of copies once."""
        own, codes = [], []
        for k, (item, h1, h2) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("item", "h1", "h2")))):
            x = self.of.get(item)
            if x is not None and x[1:] == (h1, h2) and x[0] not in self.held:
                self.held.add(x[0])
                own.append(x[0])
                codes.append(batch.column("codes")[k].values.to_numpy(zero_copy_only=False))
        return np.array(own, "i8"), codes


class Letters:
    """Sequences one after another, and their seeds."""

    def __init__(self, own: np.ndarray, codes: list[np.ndarray], scheme: Scheme):
        self.own, self.flat = own, np.concatenate(codes) if codes else np.zeros(0, "i4")
        self.end = np.cumsum([len(x) for x in codes]).astype("i8")
        self.start = np.r_[0, self.end[:-1]].astype("i8")[: len(own)]
        table = scheme.class_of()
        seed, at, of = [np.zeros(0, "i8")], [np.zeros(0, "i4")], [np.zeros(0, "i4")]
        for k, x in enumerate(codes):
            x = x if table is None else table[np.clip(x, 0, len(table) - 1)]
            for p in scheme.patterns:
                h = spaced(x, p)
                some = chosen(h, scheme.window)
                seed.append(h[some].view("i8"))
                at.append(some)
                of.append(np.full(len(some), k, "i4"))
        self.seed, self.at, self.of = (np.concatenate(x) for x in (seed, at, of))

    def by_seed(self) -> None:
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.at, self.of = self.seed[order], self.at[order], self.of[order]


def summed(key: list[np.ndarray], runs: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of (n, low, high, first, last) with equal keys (s, q, band) made one, by key."""
    s, q, band = key
    low = band.min(initial=0)
    parts, many = int(q.max(initial=0)) + 1, int(band.max(initial=0)) - int(low) + 1
    if (int(s.max(initial=0)) + 1) * parts * many < 1 << 62:
        order = np.argsort((s.astype("i8") * parts + q) * many + (band - low), kind="stable")
    else:
        order = np.lexsort((band, q, s))
    key = [x[order] for x in key]
    at = starts(*key)
    if not len(at):
        return key, runs
    how = (np.add, np.minimum, np.maximum, np.minimum, np.maximum)
    return [x[at] for x in key], [f.reduceat(x[order], at) for f, x in zip(how, runs)]


def met_runs(q: Letters, s: Letters, wanted: Callable, turned: Callable) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """What ``candidates`` counts by diagonal, of whole subjects, some ``MEETS`` meetings of seeds at a time: ((s, q, band), (n, low, high, first, last))."""
    begin = np.searchsorted(q.seed, s.seed, "left")
    count = np.searchsorted(q.seed, s.seed, "right") - begin
    some = np.flatnonzero(count)
    some = some[np.argsort(s.of[some], kind="stable")]
    begin, count, of, at = begin[some], count[some], s.of[some], s.at[some]
    work = np.r_[0, np.cumsum(count)]
    x, held = 0, []
    while x < len(of):
        y = max(x + 1, int(np.searchsorted(work, work[x] + MEETS, "right")) - 1)
        if y < len(of) and of[y - 1] == of[y]:
            whole = int(np.searchsorted(of, of[y], "left"))
            y = whole if whole > x else y
        place, each = ranges(begin[x:y], count[x:y]), np.repeat(np.arange(x, y), count[x:y])
        a, b = q.of[place], of[each]
        keep = wanted(a, b)
        a, b, qa, sa = a[keep], b[keep], q.at[place[keep]].astype("i8"), at[each[keep]].astype("i8")
        back = turned(a, b)
        d, first = np.where(back, qa - sa, sa - qa), np.where(back, sa, qa)
        held.append(summed([b, a, d // DIAGONALS], [np.ones(len(d), "i8"), d, d, first, first]))
        if y == len(of) or of[y - 1] != of[y]:
            key, runs = held[0] if len(held) == 1 else summed(*([np.concatenate(z) for z in zip(*(h[k] for h in held))] for k in (0, 1)))
            held = []
            if len(key[0]):
                yield key, runs
        x = y


def joined_runs(key: list[np.ndarray], runs: list[np.ndarray], scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(s, q) of the pairs with enough seeds on neighbouring diagonals, and (pair, [low, high, first, last]) of their ``bands`` with as many."""
    s, q, band = key
    n, low, high, first, last = runs
    beside = np.zeros(len(n), bool)
    beside[1:] = (s[1:] == s[:-1]) & (q[1:] == q[:-1]) & (band[1:] == band[:-1] + 1)
    with_next = n + np.r_[np.where(beside[1:], n[1:], 0), 0]
    at = starts(s, q)
    pair = np.cumsum(np.isin(np.arange(len(n)), at, assume_unique=True)) - 1
    enough = np.maximum.reduceat(with_next, at) >= scheme.min_seeds
    run = np.flatnonzero(~beside)
    end = np.r_[run[1:], len(n)] - 1
    total, run_pair = np.add.reduceat(n, run), pair[run]
    keep = enough[run_pair] & (total >= scheme.min_seeds)
    out = [low[run], high[end], np.minimum.reduceat(first, run), np.maximum.reduceat(last, run)]
    return s[at], q[at], run_pair[keep], [x[keep] for x in out]


def gathered(met: Iterator[tuple[list[np.ndarray], list[np.ndarray]]], scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """``joined_runs``, so many pairs together that those of one shape can be aligned together."""
    held, pairs = [], 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        offsets = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
        s, q = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        return s, q, np.concatenate([x[2] + o for x, o in zip(held, offsets)]), [np.concatenate(x) for x in zip(*(x[3] for x in held))]

    for key, runs in met:
        held.append(joined_runs(key, runs, scheme))
        pairs += len(held[-1][0])
        if pairs >= POOL:
            yield out()
            held, pairs = [], 0
    if held:
        yield out()


PAIRS = StructType(
    [StructField(c, LongType()) for c in ("set_id", "q", "s", "gq", "gs")]
    + [StructField(c, IntegerType()) for c in ("raw_score", "matches", "length", "gapopen", "qstart", "qend", "sstart", "send", "qlen", "slen")]
)


def between(q: Letters, s: Letters, of_q: Members, of_s: Members, letters: int, scheme: Scheme, max_evalue: float) -> Iterator[dict]:
    """The hits of the items of two sides: each two different sequences are aligned once, and what they have in common is their items'.

    A pair of items of which both ask is met once, from its lower item, and has its hits both ways. Of two sequences the one of the lowest
    item is the query, if it has one that asks.
    """
    flat = np.concatenate([q.flat, s.flat])

    def wanted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = q.own[a], s.own[b]
        one = ~of_q.mixed[x] & ~of_s.mixed[y] & (of_q.group[x] == of_s.group[y])
        return (of_q.rep[x] != of_s.rep[y]) & (of_s.free[y] | (of_q.lowest[x] < of_s.highest[y])) & ~one

    def turned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return of_s.rep_asks[s.own[b]] & (of_s.rep[s.own[b]] < of_q.rep[q.own[a]])

    for b, a, pair, run in gathered(met_runs(q, s, wanted, turned), scheme):
        back = turned(a, b)
        left = [q.start[a], q.end[a]]
        right = [s.start[b] + len(q.flat), s.end[b] + len(q.flat)]
        ends = [[np.where(back, x, y) for x, y in zip(*z)] for z in ((right, left), (left, right))]
        pair, found = best_alignments(flat, ends[0], ends[1], pair, run, scheme)
        found[back[pair]] = found[back[pair]][:, [0, 1, 2, 3, 6, 7, 4, 5]]
        qlen, slen = (left[1] - left[0])[pair], (right[1] - right[0])[pair]
        # Nothing is cut here that the limit of e-values doesn't cut.
        chance = scheme.k * letters * np.exp(-scheme.decay * found[:, 0]) / 1.0001
        good = [chance * n < max_evalue for n in (qlen, slen)]
        some = np.flatnonzero(good[0] | good[1])
        x, y = q.own[a[pair[some]]], s.own[b[pair[some]]]
        total = np.r_[0, np.cumsum(of_q.count[x] * of_s.count[y])]
        for at in range(0, int(total[-1]), HITS):
            flat_at = np.arange(at, min(at + HITS, total[-1]))
            k = np.searchsorted(total, flat_at, "right") - 1
            rest = flat_at - total[k]
            l = of_q.first[x[k]] + rest // of_s.count[y[k]]
            r = of_s.first[y[k]] + rest % of_s.count[y[k]]
            hit = (of_q.grp[l] != of_s.grp[r]) & (~of_s.asks[r] | (of_q.item[l] < of_s.item[r]))
            k, l, r = some[k[hit]], l[hit], r[hit]
            for way in (0, 1):
                this = good[way][k] if way == 0 else good[way][k] & of_s.asks[r]
                kk, ll, rr = k[this], l[this], r[this]
                cells = found[kk] if way == 0 else found[kk][:, [0, 1, 2, 3, 6, 7, 4, 5]]
                sides = [(of_q.item[ll], of_q.grp[ll], qlen[kk]), (of_s.item[rr], of_s.grp[rr], slen[kk])][:: 1 - 2 * way]
                if len(kk):
                    yield {"q": sides[0][0], "s": sides[1][0], "gq": sides[0][1], "gs": sides[1][1], "qlen": sides[0][2], "slen": sides[1][2]} | dict(zip(("raw_score", "matches", "length", "gapopen", "qstart", "qend", "sstart", "send"), cells.T))


def compared(sequences: DataFrame, members: DataFrame, scheme: Scheme, max_evalue: float) -> DataFrame:
    """The hits of items with different sequences, found and aligned tile by tile; places count from 0.

    sequences: (set_id, item, h1, h2, asks, codes), members: one row an item that counts. A tile is a part of the items that ask against a part of all items: it holds
    the sequences and seeds of the former and takes the others as they come. Neither meetings of seeds nor pairs leave a task,
    so what is written between tasks follows the letters, whatever the number of pairs.
    """
    cut = grid(sequences.select("set_id", "asks", "codes"))
    total = members.groupBy("set_id").agg(F.sum("n").alias("letters"))
    cut = F.broadcast(cut.join(total, "set_id"))
    part = lambda parts: F.pmod(F.xxhash64("item"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    codes = dict(sequences.dtypes)["codes"]
    dealt = []
    for kind, df in ((0, members.where("item is not null and grp is not null")), (2, sequences)):
        more = ["grp", "asks", "rep", "rep_asks", none("codes", codes)] if kind == 0 else [none("grp", "long"), none("asks", "boolean"), none("rep", "long"), none("rep_asks", "boolean"), "codes"]
        x = df.join(cut, "set_id")
        dealt.append(x.where("asks").select("set_id", part("queries").alias("i"), every("subjects").alias("j"), F.lit(kind).alias("kind"), "letters", "item", "h1", "h2", *more))
        dealt.append(x.select("set_id", every("queries").alias("i"), part("subjects").alias("j"), F.lit(kind + 1).alias("kind"), "letters", "item", "h1", "h2", *more))
    rows = dealt[0]
    for x in dealt[1:]:
        rows = rows.unionByName(x)
    slots = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(slots, TILES), *TILE).sortWithinPartitions(*TILE, "kind")
    schema = to_arrow_schema(PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, sides, q = None, ([], []), None, []
        for batch in batches:
            key = [batch.column(c).to_numpy() for c in (*TILE, "kind")]
            cuts = starts(*key)
            for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
                *tile, kind = (x[start] for x in key)
                some = batch.slice(start, end - start)
                if tile != at:
                    at, own, sides, q = tile, ([], []), None, []
                if kind < 2:
                    own[kind].append(some.select(["item", "grp", "asks", "rep", "rep_asks", "h1", "h2"]))
                    continue
                if not own[0] or not own[1]:
                    continue
                if sides is None:
                    sides = [Members(x) for x in own]
                if kind == 2:
                    q.append(sides[0].take(some))
                    continue
                if not q:
                    continue
                if isinstance(q, list):
                    q = Letters(np.concatenate([x for x, _ in q]), [c for _, x in q for c in x], scheme)
                    q.by_seed()
                s = Letters(*sides[1].take(some), scheme)
                for hits in between(q, s, *sides, some.column("letters")[0].as_py(), scheme, max_evalue):
                    hits["set_id"] = np.full(len(hits["q"]), tile[0])
                    yield pa.RecordBatch.from_arrays([pa.array(hits[f.name], f.type, safe=False) for f in schema], schema=schema)

    return rows.mapInArrow(run, PAIRS)


# ---- search ----------------------------------------------------------------------------


def search(
    items: DataFrame,
    scheme: Scheme = WORDS,
    max_evalue: float = 1e-5,
    max_targets: int | None = None,
    salt: int = SALT,
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> DataFrame:
    """Hits of the items that ask, against all items of other groups in their set.

    items: (set_id, item, grp, codes [, asks]); without ``asks`` all ask. Returns (set_id, q, s, gq, gs, pident, length, mismatch, gapopen,
    qstart, qend, sstart, send, evalue, score, raw_score, qlen, slen), places counted from 1 and score in bits, of hits with an e-value below
    ``max_evalue``. ``max_targets`` keeps a report's best hits of each item, ties by the lower one; without it all are kept.
    ``keep`` gets the tables that are read more than once, sequences and their copies, and returns them or the same rows read
    back from where it has written them. ``salt`` is for ``candidates``; the tiles need none.
    """
    rows = items if "asks" in items.columns else items.withColumn("asks", F.lit(True))
    rows = rows.where("codes is not null and size(codes) > 0").select("set_id", "item", "grp", F.coalesce("asks", F.lit(False)).alias("asks"), "codes")
    rows = keep("sequences", rows.withColumns({"n": F.size("codes"), "h1": F.xxhash64("codes"), "h2": F.xxhash64(F.lit(1), "codes")}))
    # Of an item that comes with several sequences the least hash counts, of those that ask if some do. What is grouped here is without sequences.
    least = F.min(F.struct((~F.col("asks")).alias("quiet"), "h1", "h2", "n", "grp")).alias("x")
    each = rows.groupBy("set_id", "item").agg(least).select("set_id", "item", (~F.col("x.quiet")).alias("asks"), "x.h1", "x.h2", "x.n", "x.grp")
    alike = ["set_id", "n", "h1", "h2"]
    reps = keep("distinct", each.groupBy(*alike).agg(F.min("item").alias("rep"), F.max("asks").alias("rep_asks"), F.count("*").alias("copies")))
    members = keep("members", each.join(reps, alike).select(*alike, "rep", "rep_asks", "copies", "item", "grp", "asks"))
    total = F.broadcast(members.groupBy("set_id").agg(F.sum("n").alias("letters")))
    # The limit of e-values is applied where a pair is aligned too, so that few of the others are handed on.
    worth = lambda df: df.join(total, "set_id").withColumn("evalue", scheme.k * F.col("qlen") * F.col("letters") * F.exp(-scheme.decay * F.col("raw_score"))).where(F.col("evalue") < max_evalue).drop("letters")
    others = worth(compared(rows, members, scheme, max_evalue))

    # Each sequence against its copies.
    zero, n, last = F.lit(0), F.col("n"), F.col("n") - 1
    same = members.where("item = rep and copies > 1").select("set_id", F.col("rep").alias("q"), F.col("rep").alias("s"), (n * scheme.match).alias("raw_score"), n.alias("matches"), n.alias("length"), zero.alias("gapopen"), zero.alias("qstart"), last.alias("qend"), zero.alias("sstart"), last.alias("send"), n.alias("qlen"), n.alias("slen"))
    same = keep("alignments", worth(same))
    side = lambda name, item, grp, asks: members.where("asks" if asks else "true").select("set_id", F.col("rep").alias(name), F.col("item").alias(item), F.col("grp").alias(grp))
    copies = same.join(side("q", "l", "gq", True), ["set_id", "q"]).join(side("s", "r", "gs", False), ["set_id", "s"]).where("gq <> gs and l <> r")
    hits = others.unionByName(copies.drop("q", "s").withColumnsRenamed({"l": "q", "r": "s"}))
    out = hits.select(
        "set_id", "q", "s", "gq", "gs", (100.0 * F.col("matches") / F.col("length")).alias("pident"), "length",
        (F.col("qend") - F.col("qstart") + 1 + F.col("send") - F.col("sstart") + 1 - F.col("length") - F.col("matches")).alias("mismatch"), "gapopen",
        (F.col("qstart") + 1).alias("qstart"), (F.col("qend") + 1).alias("qend"), (F.col("sstart") + 1).alias("sstart"), (F.col("send") + 1).alias("send"),
        "evalue", ((scheme.decay * F.col("raw_score") - log(scheme.k)) / log(2)).alias("score"), "raw_score", "qlen", "slen",
    )
    if max_targets is None:
        return out
    from kinfold.operators.orthology import top_k

    return top_k(out, max_targets)
