"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word is a list of parts. ``starts`` holds the part boundaries and ``ranks`` the
merge rank of each part with its right neighbour. The smallest rank is found by a
scan, its boundary is deleted, and only the two neighbouring ranks are looked up
again. Words longer than ``LONG`` bytes hold the same ranks in a heap instead, so
that one very long word costs n log n and not n squared; the merges are the same.

The result equals the tokenizers library's: special strings inside a text become
their own id, everything else is cut by the vocabulary's pre-tokenisation pattern.

Defined results: a null or empty text has no ids and decodes to ''. Ids that the
vocabulary lacks fail. Repeated rows give repeated results; other columns are kept
out of the output, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array

import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import arrow_map, text_of, worker_cache

#: Words up to this many bytes use the scanned rank array.
LONG = 256
#: Bytes that a Python worker's caches of units and words may hold, all together.
CACHE_BYTES = 100_000_000
#: What an entry takes besides its characters and ids: two objects and its share of the table.
ENTRY = 180

# The white space of the pre-tokenisation pattern and the pattern itself.
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A unit is a run without white space with the space before it, or white space: no piece crosses a unit.
UNIT = re.compile(rf" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]")
#: Code points whose class depends on the Unicode version; the library's pre-tokeniser cuts texts with them.
UNSURE = re.compile(
    "[\u0530-\u058f\u0870-\u089f\u0c00-\u0cff\u1c80-\u1cff\u2080-\u209f\ua700-\ua7ff\uab60-\uab6f"
    "\U00010000-\U0001efff\U0001fb00-\U0010ffff]"
)

#: White space that keeps a text from being cut at its spaces and line ends.
UNEVEN = ("  ", "\n ", " \n", "\n\n", "\t", "\r", "\x0b", "\x0c")
WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class _Words(dict):
    """Ids of what stands between two spaces, with what stands before it. Part of its codec's bound of bytes.

    When the bound is met the entries become the old ones; those that are used again come back.
    """

    def __init__(self, bpe: "ByteBpe", before: str):
        self.bpe, self.before, self.old = bpe, before, {}

    def __missing__(self, part: str) -> bytes:
        out = self.old.get(part)
        if out is None:
            out = self.bpe._ids_of(self.before + part)
        if len(part) < 64:
            self[part] = out
            self.bpe.grown(ENTRY + len(part) + len(out))
        return out


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    """One vocabulary. ``load`` keeps it for the life of the Python worker."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        #: (left id << 32 | right id) -> (merge order << 32 | id of the merged part)
        self.pairs = {(vocab[a] << 32 | vocab[b]): (k << 32 | vocab[a + b]) for k, (a, b) in reversed([*enumerate(merges)])}
        to_byte = {c: b for b, c in byte_letters().items()}
        self.of_byte = [vocab[c] for _, c in sorted(byte_letters().items())]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items() if s not in self.specials}
        self.bytes_of |= {i: s.encode() for s, i in self.specials.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.path, self._library = path, None
        # Half of the bound is for the entries in use, half for the old ones.
        self.held, self.limit = 0, cache_bytes // 2
        self.spaced, self.bare, self.cache = _Words(self, " "), _Words(self, ""), _Words(self, "")
        self.letter_byte = to_byte

    @classmethod
    def load(cls, path: str) -> "ByteBpe":
        return worker_cache(f"{cls.__name__} {path}", lambda: cls(path))

    def grown(self, size: int) -> None:
        """Counts what the caches hold; at the bound they turn over."""
        self.held += size
        if self.held > self.limit:
            self.held = 0
            for words in (self.spaced, self.bare, self.cache):
                words.old = dict(words)
                words.clear()

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def merge(self, word: bytes) -> tuple[list[int], list[int]]:
        """Ids of a word's parts and the byte at which each part starts."""
        ids = [self.of_byte[b] for b in word]
        if len(word) > LONG:
            return self._merge_long(ids)
        starts, get, none = [*range(len(word))], self.pairs.get, 1 << 62
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = best & 0xFFFFFFFF
            del ids[i + 1], starts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
        return ids, starts

    def ids(self, piece: str) -> list[int]:
        """Ids of one pre-tokenised piece."""
        return self.merge(piece.encode())[0]

    def _merge_long(self, ids: list[int]) -> tuple[list[int], list[int]]:
        n, get = len(ids), self.pairs.get
        right, left = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r >> 32, i, r) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1]))  is not None]
        heapq.heapify(heap)
        while heap:
            _, i, r = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j], right[i] = r & 0xFFFFFFFF, -1, right[j]
            if right[i] < n:
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] < n and (r := get(ids[a] << 32 | ids[right[a]])) is not None:
                    heapq.heappush(heap, (r >> 32, a, r))
        starts = [i for i in range(n) if ids[i] >= 0]
        return [ids[i] for i in starts], starts

    def _ids_of(self, unit: str) -> bytes:
        # Letters alone, or after one space, are one piece.
        if (unit[1:] if unit[:1] == " " else unit).isalpha():
            return array("I", self.ids(unit)).tobytes()
        ids = array("I")
        for piece in PIECE.findall(unit):
            ids.extend(self.ids(piece))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, packed as little-endian unsigned 32-bit integers."""
        if self.split and any(s in text for s in self.specials):
            return b"".join(
                array("I", [self.specials[x]]).tobytes() if x in self.specials else self._plain(x)
                for x in self.split.split(text)
                if x
            )
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text.isascii() and UNSURE.search(text):
            return self._cut_by_library(text)
        if any(x in text for x in UNEVEN) or not text.isascii() and WIDE.search(text):
            return self._units(text)
        # White space is single spaces and single line ends that don't touch: each is cut as here.
        out, bare, spaced, end = [], self.bare.__getitem__, self.spaced.__getitem__, self.bare["\n"]
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(bare(first))
            out += map(spaced, rest)
            out.append(end)
        out.pop()
        return b"".join(out)

    def _units(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, UNIT.findall(text)))

    def _cut_by_library(self, text: str) -> bytes:
        """The pieces are the library's, as their bounds depend on its Unicode version; their merges are made here."""
        ids = array("I")
        for letters, _ in self.library.pre_tokenizer.pre_tokenize_str(text):
            ids.extend(self.merge(bytes(map(self.letter_byte.__getitem__, letters)))[0])
        return ids.tobytes()

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


class LibraryBpe(ByteBpe):
    """The same ids from a compiled merge loop: tiktoken's, over the ranks and the pattern of the vocabulary file.

    It needs no cache of words. Its pattern is that of the tokenizers library, whose pre-tokeniser
    cuts the texts whose code points the two may class differently.
    """

    #: White space in a row from which the pattern's look-ahead would go back too far.
    BLANK = re.compile(rf"[{WS}]{{20000}}")

    def __init__(self, path: str):
        super().__init__(path, 2_000_000)
        order = [merged & 0xFFFFFFFF for merged in sorted(self.pairs.values())]
        if order != sorted(order):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        ranks = {x: i for i, x in self.bytes_of.items() if i not in {*self.specials.values()}}
        self._encode = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _plain(self, text: str) -> bytes:
        if not text.isascii() and UNSURE.search(text) or len(text) > 100_000 and self.BLANK.search(text):
            return super()._plain(text)
        return array("I", self._encode(text)).tobytes()


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the whole text's ids as packed little-endian unsigned 32-bit integers."""
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("ids", BinaryType())])

    def make():
        bpe = ByteBpe.load(path)
        return lambda rows: {key: rows[key], "ids": [bpe.encode(t) for t in rows[text]]}

    return arrow_map(df.select(key, text_of(text).alias(text)), schema, make, through=(key,))


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, text): the text that packed ids stand for; bytes that aren't UTF-8 become U+FFFD."""
    schema = StructType([StructField(key, df.schema[key].dataType), StructField(ids, BinaryType()), StructField("text", StringType())])

    def make():
        bpe = ByteBpe.load(path)
        return lambda rows: {key: rows[key], ids: rows[ids], "text": [bpe.decode(x or b"") for x in rows[ids]]}

    return arrow_map(df.select(key, ids), schema, make, through=(key,))


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded in one pass."""
    names = {"n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType()}
    schema = StructType([StructField(key, df.schema[key].dataType), *(StructField(k, v) for k, v in names.items())])

    def make():
        bpe = ByteBpe.load(path)

        def work(rows):
            ids = [bpe.encode(t) for t in rows[text]]
            return {
                key: rows[key],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
            }

        return work

    return arrow_map(df.select(key, text_of(text).alias(text)), schema, make, through=(key,))
