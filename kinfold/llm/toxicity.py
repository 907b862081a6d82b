"""Toxicity by two class-conditional Kneser-Ney models.

The expressions of a text are its words. A toxic and an ordinary model of the letters of
a word are trained by interpolated Kneser-Ney; the orders above ``SHARED`` have counts of
their own for each class, the lower ones are shared, so rare and new expressions are
smoothed through common backoff counts. The two log-likelihoods of each word, and of the
whole text, are compared after division by their number of letters, the word's end among
them. A text's evidence is its length-normalised difference as a whole, and those of its two
strongest words; a logistic curve, fitted on labelled texts that the models have not seen,
turns it into a score between 0 and 1.

The models are fitted on at most ``rows`` labelled texts of each class (two thirds for
the counts, one third for the curve), picked by a hash of the id over all labelled rows.
Their words are counted, and their evidence is computed, by Spark: the driver and the
broadcast hold the distinct words of so many texts, and three numbers a text. All texts are scored.

Defined results: null and empty texts, and texts without words, get the curve's value for no
evidence. A label row without text, or a null label, is not learned from; of several labels
of one document the highest counts, of several texts the last in order. Documents with a null
id are not held out. If a class has no labelled text, every score is 0.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import arrow_filter, arrow_map, staged, text_of, worker_cache

ORDER, SHARED, DISCOUNT = 5, 2, 0.75
#: Letters that a word is longer when its difference is normalised: rare letters of a short word are weak evidence.
PRIOR = 5
#: Labelled texts of each class that are learned from, at most.
ROWS = 3000
CACHE = 150_000
WORD = re.compile(r"[^\W\d_]+")
#: Words longer than this are one expression of their own and are not kept in the cache.
LONG = 64


class KneserNey:
    """Letters of ``^word$`` under two classes: 0 ordinary, 1 toxic."""

    def __init__(self, words: list[tuple[str, int, int]]):
        """words: (word, ordinary count, toxic count)."""
        raw: list[dict[str, list[int]]] = [defaultdict(lambda: [0, 0]) for _ in range(ORDER + 1)]
        for word, *n in words:
            w = f"^{word}$"
            for i in range(1, len(w)):
                for k in range(1, min(ORDER, i + 1) + 1):
                    c = raw[k][w[i - k + 1 : i + 1]]
                    c[0] += n[0]
                    c[1] += n[1]
        # Below the highest order an n-gram counts once for each letter seen before it,
        # except at the start of a word, where nothing can stand before it.
        self.count: list[dict[str, tuple[float, float]]] = [{} for _ in range(ORDER + 1)]
        for k in range(1, ORDER + 1):
            own: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            if k == ORDER:
                own = raw[k]
            else:
                for g, c in raw[k + 1].items():
                    own[g[1:]][0] += c[0] > 0
                    own[g[1:]][1] += c[1] > 0
                for g, c in raw[k].items():
                    if g[0] == "^":
                        own[g] = c
            if k <= SHARED:
                own = {g: [sum(c)] * 2 for g, c in own.items()}
            self.count[k] = {g: tuple(c) for g, c in own.items()}
        self.total: dict[str, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
        for k in range(1, ORDER + 1):
            for g, c in self.count[k].items():
                t = self.total[g[:-1]]
                for j in (0, 1):
                    t[j] += c[j]
                    t[2 + j] += c[j] > 0
        self.total = dict(self.total)
        self.base = 1 / (len(self.count[1]) + 1)
        self.memo: dict[str, float] = {}
        self.words: dict[str, tuple[float, float]] = {}

    def probability(self, gram: str, j: int) -> float:
        """Of the last letter after those before it, in class ``j``."""
        lower = self.probability(gram[1:], j) if len(gram) > 1 else self.base
        t = self.total.get(gram[:-1])
        if not t or not t[j]:
            return lower
        c = self.count[len(gram)].get(gram, (0, 0))[j]
        return (max(c - DISCOUNT, 0) + min(DISCOUNT * t[2 + j], t[j]) * lower) / t[j]

    def ratio(self, gram: str) -> float:
        got = self.memo.get(gram)
        if got is None:
            got = math.log(self.probability(gram, 1) / self.probability(gram, 0))
            if len(self.memo) >= CACHE:
                self.memo.clear()
            self.memo[gram] = got
        return got

    def word(self, word: str) -> tuple[float, float]:
        """Toxic less ordinary log-likelihood of a word, and the same after division by its length."""
        w, ratio = f"^{word}$", self.ratio
        total = sum([ratio(w[max(0, i - ORDER + 1) : i + 1]) for i in range(1, len(w))])
        out = total, total / (len(word) + 1 + PRIOR)
        if len(word) < LONG:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = out
        return out

    def evidence(self, text: str) -> tuple[float, float, float]:
        """Differences a letter: of the whole text, and of its two strongest words."""
        words = WORD.findall(text.lower())
        if not words:
            return 0.0, 0.0, 0.0
        get, slow = self.words.get, self.word
        got = [get(w) or slow(w) for w in words]
        each = [x[1] for x in got]
        best = max(each)
        total = math.fsum([x[0] for x in got])
        each[each.index(best)] = -1e9
        second = max(each) if len(each) > 1 else 0.0
        return total / (sum(map(len, words)) + len(words)), best, second


def held_out(key: Column, fold: int = 3, rest: int = 1) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % fold == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(text, toxic, tuning) of at most ``rows`` labelled texts of each class outside the held-out fold."""
    known = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
        .withColumn("place", F.xxhash64("doc_id"))
    )
    picked = [known.where(F.col("toxic") == c).orderBy("place", "doc_id").limit(rows) for c in (0, 1)]
    few = picked[0].unionByName(picked[1]).withColumn("tuning", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)) == 0)
    # At most 2 * rows ids: a fixed size. One text each, however often an id is repeated.
    return (
        docs.where("text is not null")
        .select("doc_id", "text")
        .join(F.broadcast(few), "doc_id")
        .groupBy("doc_id", "toxic", "tuning")
        .agg(F.max("text").alias("text"))
        .select("text", "toxic", "tuning")
    )


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> dict | None:
    """The models and the curve; None if a class has no text."""
    data = staged(sample(docs, labels, rows), "labelled-texts")
    have = {(r["tuning"], r["toxic"]) for r in data.select("tuning", "toxic").distinct().collect()}
    if {toxic for _, toxic in have} != {0, 1}:
        return None
    # With few texts the curve is fitted on those that the models have seen.
    part = lambda tuning: data.where(F.col("tuning") == tuning) if {(tuning, 0), (tuning, 1)} <= have else data
    words = [(r["word"], r["n0"], r["n1"]) for r in word_counts(part(False)).collect()]
    model = {"name": uuid.uuid4().hex, "words": packed_words(sorted(words))}
    tuned = evidences(part(True), model, ("toxic",)).toPandas().sort_values(["toxic", *EVIDENCE], ignore_index=True)
    x = features(tuned[[*EVIDENCE]].to_numpy())
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weights = logistic((x - mean) / scale, tuned["toxic"].to_numpy(float))
    return {**model, "mean": mean, "scale": scale, "weights": weights}


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n0, n1): how often each word stands in ordinary and in toxic texts."""

    def make():
        return lambda rows: {"toxic": rows["toxic"], "words": [WORD.findall(t.lower()) for t in rows["text"]]}

    each = arrow_map(texts.select("toxic", "text"), StructType.fromDDL("toxic int, words array<string>"), make, through=("toxic",))
    n = [F.count_if(F.col("toxic") == c).alias(f"n{c}") for c in (0, 1)]
    return each.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(*n)


def packed_words(words: list[tuple[str, int, int]]) -> bytes:
    """Words and counts in few bytes: a worker may hold the broadcasts of several models."""
    return zlib.compress("\n".join(f"{w} {a} {b}" for w, a, b in words).encode(), 1)


def unpacked_words(data: bytes) -> list[tuple[str, int, int]]:
    rows = (x.split(" ") for x in zlib.decompress(data).decode().split("\n") if x)
    return [(w, int(a), int(b)) for w, a, b in rows]


def features(evidence: list[tuple[float, float, float]] | np.ndarray) -> np.ndarray:
    """The curve's inputs: words' differences count by their square, so that one clear word outweighs many weak ones."""
    x = np.asarray(evidence, float).reshape(-1, 3)
    return np.column_stack([x[:, 0], np.square(np.maximum(x[:, 1:], 0))])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; each class weighs one half; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    share = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    w = np.zeros(x.shape[1])
    ridge = penalty * np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (share * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


EVIDENCE = ("whole", "best", "second")


def _loaded(shared) -> KneserNey:
    m = shared.value
    return worker_cache(f"Kneser-Ney {m['name']}", lambda: KneserNey(unpacked_words(m["words"])))


def evidences(docs: DataFrame, model: dict, cols: tuple[str, ...]) -> DataFrame:
    """``cols`` and the three kinds of evidence of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*(docs.schema[c] for c in cols), *(StructField(e, DoubleType()) for e in EVIDENCE)])

    def make():
        kn = _loaded(shared)

        def work(rows):
            x = [kn.evidence(t) for t in rows["_text"]]
            return {**{c: rows[c] for c in cols}, **{e: [v[k] for v in x] for k, e in enumerate(EVIDENCE)}}

        return work

    return arrow_map(docs.select(*cols, text_of().alias("_text")), schema, make, through=cols)


def _scorer(shared) -> Callable[[list], np.ndarray]:
    m, kn = shared.value, _loaded(shared)

    def scores(texts: list) -> np.ndarray:
        x = features([kn.evidence(t or "") for t in texts])
        z = (x - m["mean"]) / m["scale"] @ m["weights"][:-1] + m["weights"][-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return scores


def score(docs: DataFrame, model: dict | None, cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``cols`` and ``score`` of every text."""
    if model is None:
        return docs.select(*cols, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*(docs.schema[c] for c in cols), StructField("score", DoubleType())])

    def make():
        scores = _scorer(shared)
        return lambda rows: {**{c: rows[c] for c in cols}, "score": scores(rows["_text"]).tolist()}

    return arrow_map(docs.select(*cols, text_of().alias("_text")), schema, make, through=cols)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs, fit(docs, labels, rows))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def ordinary(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with their columns as they are."""
    model = fit(docs, labels, rows)
    if model is None:
        return docs if threshold > 0 else docs.where("false")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scores = _scorer(shared)
        return lambda texts: (scores(texts) < threshold).tolist()

    return arrow_filter(docs, make, "text")
