"""Five stages from raw documents to verified token ids.

Each stage takes all that the stage before kept, decides by its operator and returns the
columns of ``documents``; the last returns what its codec made of each text.

Defined results: a null or empty text scores like an empty one, is one empty line, and is a copy of
other empty texts, of which the first stays. Rows with a null doc_id pass the filters on their own words and are
never copies of others. Repeated rows of one id stay or go together. Other columns are handed on as they are,
whatever their names; ``n_chars``, if there, follows the text. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import bpe_codec, line_dedup, order_minhash, phrase_index, toxicity
from kinfold.llm.common import release, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return toxicity.ordinary(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; documents stay."""
    return line_dedup.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return order_minhash.distinct_documents(docs, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word passage of a benchmark item go."""
    return phrase_index.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text is encoded, and decoded again."""
    return bpe_codec.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _stage(step):
    def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)  # what earlier stages wrote for themselves; their results are in ``docs``
        return step(spark, docs, sf_dir)

    apply.__doc__ = step.__doc__
    return apply


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("line_dedup", _stage(drop_lines)),
    ("near_dedup", _stage(drop_near_duplicates)),
    ("decontaminate", _stage(drop_leaks)),
    ("bpe", _stage(encode)),
]

#: Toxicity has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    steps = (drop_toxic, drop_lines, drop_near_duplicates, drop_leaks, encode)
    for (name, _), step in zip(STAGES, steps):
        docs = step(spark, docs, sf_dir)
        if step is not encode:
            docs = staged(docs, f"stage-{name}")
    return docs
