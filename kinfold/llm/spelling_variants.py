"""Spelling variants by Aho-Corasick halves: frequent words one edit apart, and the form that each is a slip of.

An edit of one code point leaves one half of a word as it is: its first half still starts the other word, or its
second half still ends it. Both halves of every word lie in automaton shards, dealt by the half's length and its
outer letters; every word is scanned by the shards where its own outer letters may stand. A hit of the automaton
must start or end the scanned word and stem from words of a fitting length; what is left of both words is then
compared by what remains when one letter is taken out, so a half that very many words share costs a word no more
than its own letters. A pair that both halves find is counted with the first.

A shard holds at most about ``per_shard`` halves: outer letters with more are dealt to several shards, and the words
that start or end with them are scanned by each of those. Rows are streamed by shard, halves first, so a task holds
one shard and no scanned word.

Defined results: a null or empty text has no words; a null doc_id counts as an empty one in the seeded slips. Equal
doc_ids (repeated rows) each count. Very long runs of letters are words like others. An empty table, or one without
frequent words, gives no rows. Columns other than doc_id and text are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small, staged, task, text_of

#: Letters of a run, and the share of runs that lose a letter (fixed values).
LETTERS = "A-Za-z\\u00C0-\\u00FF"
SLIP = 199
#: Outer letters that deal halves to shards, and halves a shard.
OUTER, PER_SHARD = 5, 20_000


def words(docs: DataFrame, least_letters: int = 6, least_count: int = 5, slip: int = SLIP) -> DataFrame:
    """(word, n) of every lower-cased run of letters with its slip made, of enough letters and occurrences.

    A run only gets shorter, so shorter runs are never rows.
    """
    runs = F.regexp_extract_all(text_of(), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    low = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    low = low.select("d", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    out = low.select(F.when(h % slip == 0, cut).otherwise(F.col("run")).alias("word"))
    return out.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _key(side: int, size: Column, word: Column) -> Column:
    """Names a half of ``size`` letters at a word's start or end by its length and outer letters."""
    outer = F.least(size, F.lit(OUTER))
    text = F.substr(word, F.lit(1), outer) if side == 0 else F.substr(word, F.char_length(word) - outer + 1, outer)
    return F.concat_ws(":", F.lit(side), size.cast("string"), text)


def _routed(counted: DataFrame, per_shard: int) -> DataFrame:
    """(shard, scanned, word, n, side): each word's halves in their shards, and each word in the shards that scan it."""
    n = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.char_length("word")
    first, second = F.floor(size / 2).cast("int"), F.ceil(size / 2).cast("int")
    halves = counted.select("word", "n", F.posexplode(F.array(_key(0, first, F.col("word")), _key(1, second, F.col("word")))).alias("side", "key"))
    # The other word is a letter shorter, as long, or a letter longer.
    near = [_key(side, half.cast("int"), F.col("word")) for side, up in ((0, F.floor), (1, F.ceil)) for half in (up((size - 1) / 2), up(size / 2), up((size + 1) / 2))]
    shards = max(n, -(-2 * counted.count() // per_shard))
    many = halves.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > per_shard).select("key", F.ceil(F.col("m") * 2 / per_shard).cast("int").alias("parts"))
    many = small(staged(many, "frequent-halves"))
    plain = F.pmod(F.xxhash64("key"), F.lit(shards))
    held = halves.join(many, "key", "left").select(
        F.when(F.col("parts").isNull(), plain).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("word"), "parts"))).alias("shard"), F.lit(False).alias("scanned"), "word", "n", "side"
    )
    keys = counted.select("word", "n", F.explode(F.array_distinct(F.array(*near))).alias("key")).join(many, "key", "left")
    ways = F.when(F.col("parts").isNull(), F.array(plain)).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.xxhash64(F.col("key"), p.cast("long"))))
    # Two keys of a word may name one shard, where it is scanned once: both its rows come to one task, next to each other.
    scanned = keys.select(F.explode(ways).alias("shard"), F.lit(True).alias("scanned"), "word", "n", F.lit(0).alias("side"))
    return held.unionByName(scanned)


class Shard:
    """The halves of some words: an automaton, and for each half its words by what is left of them."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        self.rest: dict[tuple[int, str], dict[tuple[int, str], list[tuple[str, int]]]] = {}
        self.automaton = ahocorasick.Automaton()
        for word, n, side in rows:
            cut = len(word) // 2
            half, left = (word[:cut], word[cut:]) if side == 0 else (word[cut:], word[:cut])
            if half not in self.automaton:
                self.automaton.add_word(half, half)
            into = self.rest.setdefault((side, half), {})
            for key in [(-1, left), *((i, left[:i] + left[i + 1 :]) for i in range(len(left)))]:
                into.setdefault(key, []).append((word, n))
        if len(self.automaton):
            self.automaton.make_automaton()

    def near(self, word: str) -> dict[str, int]:
        """The shard's words one edit from ``word``, with their counts."""
        found: dict[str, int] = {}
        if not len(self.automaton):
            return found
        size = len(word)
        for end, half in self.automaton.iter(word):
            k = len(half)
            if end == k - 1 and 2 * k - 1 <= size <= 2 * k + 2 and (0, half) in self.rest:
                found.update(self._apart(self.rest[0, half], word[k:], word, False))
            if end == size - 1 and 2 * k - 2 <= size <= 2 * k + 1 and (1, half) in self.rest:
                found.update(self._apart(self.rest[1, half], word[: size - k], word, True))
        return found

    @staticmethod
    def _apart(rest: dict, left: str, word: str, second: bool) -> Iterator[tuple[str, int]]:
        keys = [(i, left) for i in range(len(left) + 1)]  # a letter of the other word is missing here
        for i in range(len(left)):
            less = left[:i] + left[i + 1 :]
            keys += [(i, less), (-1, less)]  # replaced, or too much here
        for key in keys:
            for other, n in rest.get(key, ()):
                if other != word and not (second and word.startswith(other[: len(other) // 2])):
                    yield other, n


def neighbours(counted: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """(word, n_near, near_n, near): how many words are one edit away, and the most frequent, the first among equals."""
    routed = _routed(counted, per_shard)
    n = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = routed.repartition(n, "shard").sortWithinPartitions("shard", "scanned", "word")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task():
            at, held, shard, last = None, [], None, None
            for batch in batches:
                out: list[tuple[str, int, int, str]] = []
                for where, scanned, word, count, side in zip(*(batch.column(c).to_pylist() for c in ("shard", "scanned", "word", "n", "side"))):
                    if where != at:
                        at, held, shard, last = where, [], None, None
                    if not scanned:
                        held.append((word, count, side))
                    elif held and word != last:
                        shard, last = shard or Shard(held), word
                        if got := shard.near(word):
                            best = min(got, key=lambda w: (-got[w], w))
                            out.append((word, len(got), got[best], best))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "near_n", "near"])

    part = routed.mapInArrow(scan, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    return part.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("near_n"), "b.near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last, twice as far each round.

    A form is far more frequent than its word, so there are no rings and the rounds are few.
    """
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, least_letters: int = 6, least_count: int = 5, ratio: int = 5, slip: int = SLIP, per_shard: int = PER_SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word; ``form`` is its most frequent near word if ``ratio`` times as frequent."""
    counted = staged(words(docs, least_letters, least_count, slip), "words")
    near = counted.join(neighbours(counted, per_shard), "word", "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    near = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "near-words")
    linked = near.where("form is not null")
    out = near.join(roots(linked), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
