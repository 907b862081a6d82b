"""Benchmark decontamination by a positional inverted index. DataFrame functions only.

1. Test items become phrases: every window of ``n`` words, or the whole item if it is shorter.
2. The training frequency of each test word is counted; every phrase names its two rarest
   words as anchors.
3. The index stores the training postings of the anchors: (term, document, sorted positions).
4. For each phrase the rarest anchor's list, less the anchor's offset, gives starts; the
   second anchor's list of the same document, less its own offset, is intersected with them.
5. In the documents that are left, the postings of all test words are stored too, and the
   lists of the phrase's other words, less their offsets, are intersected with the starts. What
   stands in all lists is an exact match; with ``slop`` a list may miss a start by so many words.
   The texts themselves are not looked at again.

A document is known to the index by its id and a hash of its text, so null and repeated ids are
matched by their own words. What is broadcast is small by its written size (``small``), else it
is joined by shuffle. No list spans more than one document.

Defined results: a null or empty text has no words and no hits. An item without words has
no phrase. Equal phrases of several items are matched once and credited to each item;
repeated item rows count once. Documents with a null id are matched like others; repeated
rows each have the result. Document ids must be whole numbers (or text that spells them). Very long texts
have long lists, one a word. Empty tables give no rows, or no hits. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, packed, small, staged, text_of, unpacked

#: What lies between words once A-Z are lower case (fixed values).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BETWEEN, -1), "")


def phrases(items: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """((phrase, words), (phrase, item_id)): the distinct phrases, and the items that each is of."""
    w = items.select("item_id", words(text_of()).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("words"))
    # No word holds a space, so the joined words are the phrase's identity.
    each = each.select(F.array_join("words", " ").alias("phrase"), "words", "item_id")
    return each.select("phrase", "words").distinct(), each.select("phrase", "item_id").distinct()


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, freq) of the given terms over all documents; 0 where absent."""
    seen = (
        docs.select(F.explode(words(text_of())).alias("term"))
        .join(small(terms), "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("freq"))
    )
    return terms.join(seen, "term", "left").select("term", F.coalesce("freq", F.lit(0)).alias("freq"))


def anchors(found: DataFrame, freq: DataFrame, k: int = 2) -> DataFrame:
    """(phrase, rank, term, at): each phrase's ``k`` rarest words and their offsets; none if a word never occurs."""
    rarest = Window.partitionBy("phrase").orderBy("freq", "at")
    each = found.select("phrase", F.posexplode("words").alias("at", "term")).join(freq, "term")
    return (
        each.withColumn("rank", F.row_number().over(rarest))
        .withColumn("least", F.min("freq").over(Window.partitionBy("phrase")))
        .where((F.col("rank") <= k) & (F.col("least") > 0))
        .select("phrase", "rank", "term", "at")
    )


#: A document's key in the index: its id (0 for null) and a hash of its text.
KEY = ["_d", "_h"]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``KEY``."""
    return docs.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("_h", F.xxhash64(text_of()))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, KEY, positions) of the given terms, positions counted from 0 and sorted."""
    each = docs.select(*KEY, F.posexplode(words(text_of())).alias("pos", "term"))
    return each.join(small(terms), "term", "left_semi").groupBy("term", *KEY).agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def starts_of(index: DataFrame, picked: DataFrame, slop: int = 0) -> DataFrame:
    """(phrase, KEY, starts) where both anchors stand at their offsets, give or take ``slop`` words."""
    first = picked.where("rank = 1").select("phrase", "term", F.col("at").alias("at1"))
    second = picked.where("rank = 2").select("phrase", F.col("term").alias("term2"), F.col("at").alias("at2"))
    both = staged(first.join(second, "phrase", "left"), "anchor-pairs")
    begun = index.join(small(both), "term").select(
        "phrase", *KEY, F.transform("positions", lambda p: p - F.col("at1")).alias("starts"), "term2", "at2"
    )
    begun = begun.withColumn("starts", F.filter("starts", lambda s: s >= 0)).where(F.size("starts") > 0)
    lone = begun.where("term2 is null").select("phrase", *KEY, "starts")
    other = index.select(F.col("term").alias("term2"), *KEY, F.col("positions").alias("positions2"))
    joined = begun.where("term2 is not null").join(other, ["term2", *KEY])
    shifted = F.transform("positions2", lambda p: p - F.col("at2"))
    met = F.array_intersect("starts", shifted) if slop == 0 else F.filter("starts", lambda s: F.exists(shifted, lambda t: F.abs(t - s) <= slop))
    return lone.unionByName(joined.select("phrase", *KEY, met.alias("starts")).where(F.size("starts") > 0))


def build(docs: DataFrame, items: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(phrases, their items, all their words, anchors, index of the anchors), each written to the shared folder."""
    found, owners = phrases(items, n)
    found, owners = staged(found, "phrases"), staged(owners, "phrase-items")
    terms = staged(found.select(F.explode("words").alias("term")).distinct(), "test-terms")
    picked = staged(anchors(found, staged(frequencies(docs, terms), "term-freq")), "anchors")
    rare = staged(picked.select("term").distinct(), "anchor-terms")
    return found, owners, terms, picked, staged(postings(keyed(docs), rare), "postings")


def found_in(docs: DataFrame, items: DataFrame, n: int = 10, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """((KEY, hits: [(phrase, n, starts)]) of the documents that hold a phrase; the phrases' items)."""
    found, owners, terms, picked, index = build(docs, items, n)
    near = starts_of(index, picked, slop).join(small(found), "phrase")
    open_ = staged(near.groupBy(*KEY).agg(F.collect_list(F.struct("phrase", "words", "starts")).alias("open")), "open-documents")
    keys = staged(open_.select(*KEY), "open-keys")
    rest = postings(keyed(docs).join(small(keys), KEY, "left_semi"), terms)
    lists = rest.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("lists"))
    none = F.array().cast("array<int>")

    def met(c, s):
        at = lambda w: F.coalesce(F.get(F.map_values(F.map_filter("lists", lambda k, _: k == w)), F.lit(0)), none)
        here = lambda w, i: F.exists(at(w), lambda p: F.abs(p - (s + i)) <= slop) if slop else F.array_contains(at(w), s + i)
        return F.forall(F.transform(c["words"], here), lambda x: x)

    hits = F.transform(
        "open", lambda c: F.struct(c["phrase"].alias("phrase"), F.size(c["words"]).alias("n"), F.filter(c["starts"], lambda s: met(c, s)).alias("starts"))
    )
    hits = F.filter(hits, lambda c: F.size(c["starts"]) > 0)
    return staged(open_.join(lists, KEY).select(*KEY, hits.alias("hits")).where(F.size("hits") > 0), "phrase-hits"), owners


def proximity(docs: DataFrame, items: DataFrame, n: int = 10, slop: int = 3) -> DataFrame:
    """(doc_id, item_id, phrase, start): phrases of which every word stands within ``slop`` words of its place after the start."""
    hits, owners = found_in(docs, items, n, slop)
    near = keyed(docs.select("doc_id", "text")).select("doc_id", *KEY).distinct().join(hits, KEY)
    each = near.select("doc_id", F.explode("hits").alias("hit"))
    return each.select("doc_id", F.col("hit.phrase").alias("phrase"), F.explode("hit.starts").alias("start")).join(small(owners), "phrase")


def clean(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no phrase of ``items``, with their columns as they are."""
    hits, _ = found_in(docs.select("doc_id", "text"), items, n)
    rows = keyed(packed(docs))
    rows = rows.join(small(staged(hits.select(*KEY), "hit-keys")), KEY, "left_anti")
    return rows.select(*unpacked(rows, docs.columns))


def matches(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, hit_spans, item_ids, contaminated); item_ids are sorted as strings."""
    docs = docs.select("doc_id", "text")
    hits, owners = found_in(docs, items, n)
    spans = F.flatten(F.transform("hits", lambda c: F.transform(c["starts"], lambda s: F.struct(s.alias("start"), (s + c["n"]).alias("stop")))))
    credited = (
        hits.select(*KEY, F.explode("hits.phrase").alias("phrase"))
        .join(small(owners), "phrase")
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    hit = hits.select(*KEY, F.array_sort(F.array_distinct(spans)).alias("hit_spans")).join(credited, KEY)
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("hit_spans", lambda s: F.sequence(s["start"], s["stop"] - 1)))))
    hit = staged(hit.select(*KEY, n_hit.cast("long").alias("n_hit"), "hit_spans", "item_ids"), "phrase-matches")
    rows = keyed(docs).select("doc_id", F.size(words(text_of())).cast("long").alias("n_words"), *KEY)
    return rows.join(small(hit), KEY, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("hit_spans", F.array()).alias("hit_spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
