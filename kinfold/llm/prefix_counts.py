"""Exact token counts at every prefix of a text, by dynamic programming.

A sequence of parts is a word's BPE encoding exactly when each part encodes to itself
and each neighbouring pair does. So each prefix of a word has one last part: the part
``t`` at its end for which (last part of what precedes ``t``, ``t``) is such a pair, and
count[prefix] = count[prefix without t] + 1. The vocabulary marks the last letter of a
word, so two tables are kept for each prefix: ``open`` (the word goes on) and ``closed``
(the text is cut here), the second giving the count of the text cut at that point.

Words are independent, so a text's prefix counts are its words' counts on top of what
came before; they are stored as differences, one signed byte a code point (wider if ever
needed) under zstandard. ``count_at`` and ``fit`` answer truncation and budget questions
from them without encoding again.

Prefixes are of the normalised text (NFC, white space as one space, lower case), which is
what the vocabulary counts. Special strings inside texts count as one token where whole
and as ordinary text where cut.

Defined results: null and empty texts have 0 tokens and an empty prefix table; repeated
rows repeat; an empty table gives no rows; other columns, whatever their names, are not returned.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import accumulate, pairwise

import numpy as np
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .bpe_codec import UNSURE, WS, byte_letters
from .common import arrow_map, text_of, worker_cache

# Fixed value: the pre-tokenisation pattern of the vocabulary.
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WS}\p{{L}}\p{{N}}]+")
SPACES = re.compile(rf"[{WS}]+")
#: Contractions are cut as whole pieces but not when they are cut short.
SHORT = {"'re", "'ve", "'ll"}
#: Bounds of each Python worker's caches: text units, their pieces, and pairs of parts.
UNITS, PIECES, PAIRS = 800_000, 400_000, 1_000_000
NONE = 0xFFFFFFFF
WIDTHS = {1: "i1", 4: "<i4"}

class PrefixCounter:
    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left, right) -> merge order; the merged part is the two joined.
        self.order = {(a, b): k for k, (a, b) in reversed([*enumerate(merges)])}
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.parts_of = {i: p for p, i in model["vocab"].items() if p not in self.specials}
        #: Finds every part that ends at a letter: (length, id within a word or -1, id at a word's end or -1).
        self.ending = ahocorasick.Automaton()
        inner, last = {}, {}
        for i, p in self.parts_of.items():
            if self.end and p.endswith(self.end):
                last[p[: -len(self.end)]] = i
            else:
                inner[p] = i
        for p in inner.keys() | last.keys():
            if p:
                self.ending.add_word(p, (len(p), inner.get(p, -1), last.get(p, -1) if self.end else inner.get(p, -1)))
        self.ending.make_automaton()
        self.letters = byte_letters()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.units: dict[str, tuple[bytes, np.ndarray | None]] = {}
        self.pieces: dict[str, list[int]] = {}
        #: (left id << 32 | right id) -> whether the two are an encoding; left NONE: the right one alone.
        self.pairs: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> "PrefixCounter":
        return worker_cache(f"PrefixCounter {path}", lambda: cls(path))

    def parts(self, letters: list[str]) -> list[str]:
        """BPE by repeated minimum over adjacent merge orders."""
        parts, none = [*letters], 1 << 60
        order = [self.order.get(x, none) for x in zip(parts, parts[1:])]
        while order and (best := min(order)) < none:
            i = order.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i < len(order):
                order[i] = self.order.get((parts[i], parts[i + 1]), none)
            if i:
                order[i - 1] = self.order.get((parts[i - 1], parts[i]), none)
        return parts

    def _spell(self, part: str) -> list[str]:
        if self.end and part.endswith(self.end):
            body = part[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return [*part]

    def _fits(self, key: int) -> bool:
        """Whether part ``key >> 32``, then part ``key & NONE``, is the encoding of the two joined."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        want = [self.parts_of[i] for i in (key >> 32, key & NONE) if i != NONE]
        got = self.pairs[key] = self.parts([x for p in want for x in self._spell(p)]) == want
        return got

    def _table(self, word: str) -> list[int]:
        """Closed counts of the prefixes of 0, 1, 2, ... byte letters of a word."""
        n = len(word)
        last, count, closed = [NONE] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        get, fits = self.pairs.get, self._fits
        for at, (size, inner, end) in self.ending.iter(word):
            i, j = at + 1, at + 1 - size
            if j and not count[j]:
                continue
            left = last[j] << 32
            if inner >= 0 and not count[i]:
                ok = get(left | inner)
                if fits(left | inner) if ok is None else ok:
                    last[i], count[i] = inner, count[j] + 1
            if end >= 0 and not closed[i]:
                ok = get(left | end)
                if fits(left | end) if ok is None else ok:
                    closed[i] = count[j] + 1
        return closed

    def piece(self, piece: str) -> list[int]:
        """Counts of every non-empty prefix (in code points) of one pre-tokenised piece."""
        if piece in SHORT:
            cut = self.piece("'")
            return [cut[-1], cut[-1] + self.piece(piece[1])[-1], self._closed(piece)[-1]]
        return self._closed(piece)

    def _closed(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isprintable():
            return self._table(piece)[1:]
        sizes = [len(c.encode()) for c in piece]
        closed = self._table("".join(map(self.letters.__getitem__, piece.encode())))
        return [closed[i] for i in accumulate(sizes)]

    def _unit(self, unit: str) -> tuple[bytes, np.ndarray | None]:
        """Differences of the counts along a run without white space; the array if a byte can't hold them."""
        counts, base = [0], 0
        for p in PIECE.findall(unit):
            got = self.pieces.get(p)
            if got is None:
                got = self.piece(p)
                if len(self.pieces) >= PIECES:
                    self.pieces.clear()
                if len(p) < 64:
                    self.pieces[p] = got
            counts += [base + c for c in got] if base else got
            base = counts[-1]
        steps = [b - a for a, b in pairwise(counts)]
        if max(steps) < 128 and min(steps) >= -128:
            out = (bytes([x & 255 for x in steps]), None)
        else:
            out = (b"", np.array(steps, "<i8"))
        if len(self.units) >= UNITS:
            self.units.clear()
        if len(unit) < 64:
            self.units[unit] = out
        return out

    def normalise(self, text: str) -> str:
        if text.isascii():
            return SPACES.sub(" ", text).lower()
        if UNSURE.search(text) or "Σ" in text or "İ" in text:
            return self.library.normalizer.normalize_str(text)
        return SPACES.sub(" ", unicodedata.normalize("NFC", text)).lower()

    def _plain(self, text: str) -> list[np.ndarray | bytes]:
        """Differences for normalised text; in order, with one zero a space."""
        get, slow, out, wide = self.units.get, self._unit, [], False
        for u in text.split(" "):
            small, big = (get(u) or slow(u)) if u else (b"", None)
            wide |= big is not None
            out.append(small if big is None else big)
        if not wide:
            return [b"\0".join(out)]
        return [x for u in out for x in (b"\0", u)][1:]

    def _sure(self, text: str) -> list[np.ndarray | bytes]:
        if not text.isascii() and UNSURE.search(text):  # cut by the library
            counts, at, total = np.zeros(len(text), "<i8"), 0, 0
            for piece, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text):
                raw = text[a:b]
                counts[at:a] = total
                counts[a:b] = [total + c for c in self.piece(raw)]
                total, at = int(counts[b - 1]), b
            counts[at:] = total
            return [np.diff(counts, prepend=0)]
        return self._plain(text)

    def deltas(self, text: str) -> np.ndarray:
        """Signed differences of the token counts at each prefix of the normalised text."""
        if not any(s in text for s in self.specials):
            got = self._sure(self.normalise(text))
            return self._joined(got)
        out: list[np.ndarray] = []
        for x in self.split.split(text):
            if x in self.specials:
                # Cut inside, it is ordinary text that goes on from the piece before it.
                before = self._tail
                counts = [len(self._encode(before + x[: k + 1])) - len(self._encode(before)) for k in range(len(x) - 1)] + [1]
                out.append(np.diff(np.array(counts, "<i8"), prepend=0))
                self._tail = ""
            elif x:
                norm = self.normalise(x)
                out.append(self._joined(self._sure(norm)).astype("<i8"))
                self._tail = norm[norm.rfind(" ") + 1 :]
        self._tail = ""
        return np.concatenate(out)

    _tail = ""

    def _encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _joined(got: list[np.ndarray | bytes]) -> np.ndarray:
        if len(got) == 1 and isinstance(got[0], bytes):
            return np.frombuffer(got[0], "i1")
        return np.concatenate([np.frombuffer(x, "i1").astype("<i8") if isinstance(x, bytes) else x for x in got])


def pack(deltas: np.ndarray, squeeze=None) -> bytes:
    """Width in bytes, then the differences under zstandard."""
    narrow = deltas.dtype.itemsize == 1 or not len(deltas) or int(np.abs(deltas).max()) < 128
    width = 1 if narrow else 4
    return bytes([width]) + (squeeze or zstandard.ZstdCompressor(level=1)).compress(deltas.astype(WIDTHS[width]).tobytes())


def counts(packed: bytes) -> np.ndarray:
    """Token count at every prefix of 0, 1, 2, ... code points of the normalised text."""
    raw = zstandard.ZstdDecompressor().decompress(packed[1:])
    return np.concatenate([[0], np.cumsum(np.frombuffer(raw, WIDTHS[packed[0]]), dtype=np.int64)])


def count_at(packed: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` code points."""
    c = counts(packed)
    return int(c[min(chars, len(c) - 1)])


def fit(packed: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts(packed) <= budget)[-1])


def prefix_counts(df: DataFrame, path: str, budget: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_chars, n_tokens, fit_chars, prefix).

    ``prefix`` is the packed table; ``n_chars`` the length of the normalised text,
    ``n_tokens`` the table's last entry and ``fit_chars`` the answer of ``fit``.
    """
    names = {"n_bytes": LongType(), "n_chars": LongType(), "n_tokens": LongType(), "fit_chars": LongType(), "prefix": BinaryType()}
    schema = StructType([StructField(key, df.schema[key].dataType), *(StructField(k, v) for k, v in names.items())])

    def make():
        counter, squeeze = PrefixCounter.load(path), zstandard.ZstdCompressor(level=1)

        def work(rows):
            out = {k: [] for k in names}
            for t in rows[text]:
                d = counter.deltas(t) if t else np.zeros(0, "i1")
                c = np.cumsum(d, dtype=np.int32)
                out["n_bytes"].append(len(t.encode()))
                out["n_chars"].append(len(d))
                out["n_tokens"].append(int(c[-1]) if len(c) else 0)
                out["fit_chars"].append(len(d) if not len(c) or c.max() <= budget else int(np.flatnonzero(np.append(0, c) <= budget)[-1]))
                out["prefix"].append(pack(d, squeeze))
            return {key: rows[key], **out}

        return work

    return arrow_map(df.select(key, text_of(text).alias(text)), schema, make, through=(key,))
