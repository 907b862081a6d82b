"""Empty tables, nulls in every column, very long texts and names that clash, for operators and each stage of the pipeline."""

import public_tokenizers
import pytest

from kinfold.llm import bpe_codec, html_text, line_dedup, media_chunks, order_minhash, phrase_index, prefix_counts, toxicity

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
CLASH = ["*", "1 as _row", "2 as h", "'x' as words", "3 as ids", "4 as score", "5 as n", "6 as line", "7 as item_id", "8 as `sketch`"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    long = " ".join(f"word{k % 977} of a very long text" for k in range(30_000))
    rows = [(1, "plain words of a first text", "en", "a", 27), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "an id that is null", "en", None, 18), (None, None, None, None, None)]
    rows += [(4, long, "en", "b", len(long)), (5, long + " more", "en", "b", len(long) + 5), (6, "twice there", "de", "c", 11), (6, "twice there", "de", "c", 11), (7, "\n\n \n", "de", "c", 4)]
    return spark.createDataFrame(rows, DOCS).selectExpr(*CLASH)


def test_empty_tables(spark):
    none = odd(spark).where("false")
    pages = spark.createDataFrame([], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    items = spark.createDataFrame([], "item_id long, text string")
    assert html_text.extract(pages).count() == 0
    assert prefix_counts.prefix_counts(none, WORDS, budget=8).count() == 0
    assert bpe_codec.digests(none, BYTES).count() == 0
    assert media_chunks.media(none).count() == 0
    assert phrase_index.matches(none, items).count() == 0 and phrase_index.proximity(none, items).count() == 0
    assert order_minhash.classes(none).count() == 0 and line_dedup.dedup(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.classify(none, labels).count() == 0
    assert {r.predicted for r in toxicity.classify(odd(spark), labels).collect()} == {0}


def test_odd_rows(spark):
    df, n = odd(spark), 10
    assert prefix_counts.prefix_counts(df, WORDS, budget=8).count() == n
    assert bpe_codec.digests(df, BYTES).count() == n and media_chunks.media(df).count() == n
    items = spark.createDataFrame([(1, None), (None, "very long text word5"), (2, "of a first")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r.n_hit for r in phrase_index.matches(df, items).collect()}
    assert got[1, 6] == 3 and got[4, 180_000] > 0 and got[2, 0] == got[3, 0] == got[None, 0] == 0 and len(phrase_index.matches(df, items).collect()) == n
    got = {r.doc_id: r.class_id for r in order_minhash.classes(df).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 7}
    assert {(r.doc_id, r.n_lines) for r in line_dedup.dedup(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 4), (None, 1)}


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_odd_rows(spark, sf, tmp_path, empty):
    import corpus_pipeline

    docs = odd(spark).where("false") if empty else odd(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "near_dedup" and not empty:
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "4", "6", "6", "7", "None", "None"]
    assert docs.count() == (0 if empty else 8)
