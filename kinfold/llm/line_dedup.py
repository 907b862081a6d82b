"""Line deduplication that returns keep bitmaps instead of text. DataFrame functions only.

Line keys are hashed (128 bits), range-partitioned by hash and sorted inside each
partition by document and position; one window then streams over each hash's lines
and marks those whose document is not the first. What comes back for each document
is a run-length compressed bitmap (kept, dropped, kept, ... line counts).

A hash that holds many lines would fill one range. The ``hot`` most frequent hashes
are found first by a pre-aggregated count, so each hash left over has at most
1/(hot+1) of all lines; the hot ones are resolved without moving their lines, by a
broadcast of at most ``hot`` (hash, first document) rows.

Defined results: a null or empty text is one empty line, which is kept. Keys shorter
than ``min_chars`` code points never count. Of equal doc_ids (repeated rows) all count
as one document, so their own repeats stay; each row has its own bitmap, found by the id and a hash
of its text, and rows equal in both have equal bitmaps. A very long text is as many rows as it has
lines. Null doc_ids are documents of their own that
neither drop nor are dropped. Other columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, packed, staged, text_of, unpacked

#: Characters stripped at both ends of a key (fixed values).
BLANKS = " \t\n\x0b\x0c\r"
HOT = 1000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def row_of() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(text_of())


def occurrences(df: DataFrame, min_chars: int = 10) -> DataFrame:
    """(h1, h2, doc_id, row, pos) of every line whose key counts; ``row`` is a hash of the text that it stands in."""
    key = line_key(F.col("line"))
    return (
        df.where("doc_id is not null")
        .select("doc_id", row_of().alias("row"), F.posexplode(lines_of(text_of())).alias("pos", "line"))
        .select("doc_id", "row", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "row", "pos")
    )


def dropped_lines(df: DataFrame, min_chars: int = 10, hot: int = HOT) -> DataFrame:
    """(doc_id, row, pos) of every line whose key an earlier document holds."""
    occ = staged(occurrences(df, min_chars), "line-hashes")
    # orderBy.limit keeps `hot` rows a task, so what is broadcast has a fixed size.
    top = (
        occ.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
        .where("n > 1")
        .orderBy(F.desc("n"), "h1", "h2")
        .limit(hot)
        .select("h1", "h2", "first")
    )
    known = occ.join(F.broadcast(top), ["h1", "h2"], "left")
    frequent = known.where("first is not null and doc_id > first").select("doc_id", "row", "pos")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    others = (
        known.where("first is null")
        .select("h1", "h2", "doc_id", "row", "pos")
        .repartitionByRange(n, "h1", "h2")
        .sortWithinPartitions("h1", "h2", "doc_id", "pos")
        .withColumn("first", F.first("doc_id").over(order))
        .where("doc_id > first")
        .select("doc_id", "row", "pos")
    )
    return frequent.unionByName(others)


def keep_bitmaps(df: DataFrame, min_chars: int = 10, hot: int = HOT) -> DataFrame:
    """(doc_id, row, ends): for each text that loses lines, its bitmap, compressed by runs.

    ``ends`` are the line numbers at which runs end: kept, dropped, kept, ..., dropped. The first
    run may be empty; lines after the last end are kept.
    """
    drops = F.sort_array(F.collect_set("pos"))
    return dropped_lines(df, min_chars, hot).groupBy("doc_id", "row").agg(drops.alias("d")).select("doc_id", "row", ends_of(F.col("d")).alias("ends"))


def ends_of(drops: Column) -> Column:
    """Run ends of sorted dropped positions, in one pass over them."""
    first = F.filter(drops, lambda p, i: (i == 0) | (F.get(drops, i - 1) != p - 1))
    last = F.filter(drops, lambda p, i: (i == F.size(drops) - 1) | (F.get(drops, i + 1) != p + 1))
    return F.flatten(F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda r: F.array(r["a"], r["b"] + 1)))


def dedup(df: DataFrame, min_chars: int = 10, hot: int = HOT) -> DataFrame:
    """``df`` with ``n_lines``, ``n_dropped``, ``keep_runs`` and ``kept``, the text of the kept lines.

    ``keep_runs`` are the lengths of the bitmap's runs, which sum to ``n_lines``; all that is returned is made
    from the bitmap and the text. Columns of ``df`` come first and as they are; if one has the name of a new
    column, both are there, as in a join.
    """
    bitmaps = keep_bitmaps(df, min_chars, hot).select(F.col("doc_id").alias("_drop_doc"), F.col("row").alias("_drop_row"), F.col("ends").alias("_ends"))
    rows = packed(df)
    joined = rows.join(bitmaps, (rows["doc_id"] == F.col("_drop_doc")) & (row_of() == F.col("_drop_row")), "left").drop("_drop_doc", "_drop_row")
    out = joined.withColumn("_lines", lines_of(text_of())).withColumn("_ends", F.coalesce("_ends", F.array().cast("array<int>")))
    n, ends = F.size("_lines"), F.col("_ends")
    before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
    # Run 2k is kept: from the end of run 2k - 1 to its own, or to the last line.
    parts = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(ends) / 2).cast("int")),
        lambda k: F.slice(F.col("_lines"), before(2 * k) + 1, F.coalesce(F.get(ends, 2 * k), n) - before(2 * k)),
    )
    sizes = F.transform(ends, lambda e, i: e - before(i))
    dropped = F.aggregate(F.filter(sizes, lambda x, i: i % 2 == 1), F.lit(0), lambda a, x: a + x)
    rest = n - F.coalesce(F.element_at(F.when(F.size(ends) > 0, ends), -1), F.lit(0))
    return out.select(
        *unpacked(out, df.columns),
        n.cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
        F.concat(sizes, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))).alias("keep_runs"),
        F.when(F.size(ends) == 0, text_of()).otherwise(F.array_join(F.flatten(parts), "\n")).alias("kept"),
    )


def deduplicated(df: DataFrame, min_chars: int = 10, hot: int = HOT) -> DataFrame:
    """``df`` with the kept lines as ``text``, and ``n_chars``, if there, their code points."""
    rows = df.select("doc_id", "text", F.struct(*df.columns).alias("_row"))
    out = dedup(rows, min_chars, hot)
    text = F.when(out["n_dropped"] > 0, out["kept"]).otherwise(out["text"])
    new = {"text": text}
    if "n_chars" in df.columns:
        kind = df.schema["n_chars"].dataType
        new["n_chars"] = F.when(out["n_dropped"] > 0, F.char_length("kept").cast(kind)).otherwise(out["_row"]["n_chars"])
    return out.select(*[(new[c] if c in new else out["_row"][c]).alias(c) for c in df.columns])
