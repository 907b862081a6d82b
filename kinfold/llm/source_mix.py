"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame functions only.

A source's documents are dealt by a seeded hash to shards of about ``shard_words`` words, and each shard is
laid out in hash order as blocks of ``block`` words. All shards of all sources then compete for the mix's blocks:
the j-th block of a shard has the quotient target / (2j - 1), and the highest quotients win, no shard more than
``most`` times its own blocks. The quotas are integers that sum to the blocks of the mix. A quota of full rounds
and a rest takes every block that many times, and a seeded, evenly spread choice of the rest once more.

Which blocks are chosen has a closed form, so a document's share follows from where it starts and ends in its
shard: no row a block is made unless ``spans`` asks for them. The seat at which quotas are full is found by
counting seats above a grid of quotients, one aggregate a round; only the seats between two close quotients are
ever rows.

Defined results: a null or empty text has size 0 and takes nothing. A null source is a source, the last. Equal
doc_ids (repeated rows) are documents of their own; rows equal in id and text share a place in hash order, so which
of them is cut is arbitrary but the set of rows isn't. An empty table gives none. Columns other than doc_id, text
and source are ignored and may have any name; doc_id may have any type and be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.numbering import numbered

from .common import small, staged, text_of

#: A word (a fixed value).
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BLOCK = 16
SHARD_WORDS = 1 << 20
#: Quotients counted in one aggregate, and seats that may be left to rank.
GRID, FEW = 31, 1000


def _number(hexed: Column) -> Column:
    """The first 60 bits of a hash."""
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, h): words of each text, and its seeded hash."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), text_of())).alias("h"),
    )


def targets(by_doc: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, rank, source_size, rows, target) of each source; ``weights`` repeat over sources in code-point order.

    Targets share ``share`` of all sizes by weight. A source whose part is above ``most`` times its size stops there
    and the rest is shared again, until none is above: one small aggregate a round, at most one round a source.
    """
    totals = by_doc.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    ranked = numbered(totals, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = staged(ranked.withColumn("weight", weight), "sources")
    cap = most * F.col("source_size").cast("double")
    level, full = None, F.lit(False)
    while True:
        got = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, cap)).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        was, level = level, (share * (got["all"] or 0) - (got["held"] or 0.0)) / got["open"] if got["open"] else None
        if level is None or level == was:
            break
        full = full | (F.col("weight") * level > cap)
    target = cap if level is None else F.when(full, cap).otherwise(F.col("weight") * level)
    return ranked.select("source", "rank", "source_size", "rows", target.alias("target"))


def _placed(by_doc: DataFrame, sources: DataFrame, shard_words: int) -> DataFrame:
    """Documents with words, their source's numbers and their shard."""
    known = sources.select(F.col("source").alias("_s"), "rank", "source_size", "target", F.ceil((F.col("source_size") + F.col("rows")) / shard_words).alias("shards"))
    joined = by_doc.join(small(known), by_doc["source"].eqNullSafe(F.col("_s"))).drop("_s")
    return joined.withColumn("shard", F.pmod(_number(F.col("h")), F.col("shards")))


def quotas(cells: DataFrame, block: int = BLOCK, most: int = 2) -> DataFrame:
    """``cells`` (rank, shard, cell_size, weight) with ``blocks`` and ``quota``, the seats that Sainte-Laguë gives each.

    Equal quotients go to the lower rank, shard and seat.
    """
    cells = cells.withColumn("blocks", F.ceil(F.col("cell_size") / block).cast("long"))
    above = lambda x: F.least(most * F.col("blocks"), F.floor((F.col("weight") / x + 1) / 2))
    seats = int((cells.agg(F.sum("weight")).first()[0] or 0.0) / block + 0.5)
    low, high, at_high, step = block * 2.0**-44, block * 2.0**8, 0, 2.0 ** (52 / (GRID + 1))
    at_low = None
    while seats and (at_low is None or at_low - at_high > FEW) and high / low > 1 + 1e-9:
        grid = [low * step**k for k in range(GRID + 1)]
        counts = list(cells.agg(*[F.coalesce(F.sum(above(x)), F.lit(0)) for x in grid]).first())
        k = max((k for k in range(GRID + 1) if counts[k] >= seats), default=0)
        low, at_low = grid[k], counts[k]
        high, at_high = (grid[k + 1], counts[k + 1]) if k < GRID else (high, at_high)
        step = (high / low) ** (1 / (GRID + 1))
    if not seats:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    # A seat's quotient is compared as it is only within the bracket; 1e-9 is far above the arithmetic's error.
    sure, likely = above(high * (1 + 1e-9)), above(low * (1 - 1e-9))
    cells = cells.withColumn("sure", sure).withColumn("likely", likely)
    left = seats - cells.agg(F.sum("sure")).first()[0]
    open_seats = cells.where("likely > sure").select("rank", "shard", "weight", F.explode(F.sequence(F.col("sure") + 1, F.col("likely"))).alias("seat"))
    open_seats = open_seats.withColumn("quotient", F.col("weight") / (2 * F.col("seat") - 1))
    won = numbered(open_seats, [F.desc("quotient"), F.asc("rank"), F.asc("shard"), F.asc("seat")], "place").where(F.col("place") <= left)
    won = won.groupBy("rank", "shard").agg(F.count("*").alias("won"))
    return cells.join(won, ["rank", "shard"], "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0))).drop("sure", "likely", "won")


def _laid_out(docs: DataFrame, seed: int, weights: tuple, share: float, most: int, block: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """(all documents with their size, those with words: where they start in their shard and what is chosen of it)."""
    by_doc = staged(sizes(docs, seed), "sizes")
    sources = targets(by_doc, weights, share, most)
    placed = _placed(by_doc, sources, shard_words)
    cells = placed.where("size > 0").groupBy("rank", "shard").agg(F.sum("size").alias("cell_size"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    cells = staged(cells.select("rank", "shard", "cell_size", (F.col("target") * F.col("cell_size") / F.col("source_size")).alias("weight")), "shards")
    won = staged(quotas(cells, block, most), "quotas")
    phase = F.pmod(_number(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rank"), F.col("shard")))), F.col("blocks"))
    chosen = won.select("rank", "shard", "blocks", F.floor(F.col("quota") / F.col("blocks")).alias("rounds"), F.expr("quota % blocks").alias("rest"), phase.alias("phase"))
    before = Window.partitionBy("rank", "shard").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = placed.where("size > 0").withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return placed, start.join(small(chosen), ["rank", "shard"])


def _words_before(x: Column, block: int) -> Column:
    """Words of the blocks chosen once more that lie before word ``x`` of the shard: blocks * rest / blocks of them, evenly spread."""
    b = F.floor(x / block)
    turn = (b + F.col("phase")) * F.col("rest")
    count = F.floor(_div(turn, F.col("blocks"))) - F.floor(_div(F.col("phase") * F.col("rest"), F.col("blocks")))
    chosen = F.pmod(turn, F.col("blocks")) >= F.col("blocks") - F.col("rest")
    return block * count + F.when(chosen & (F.col("rest") > 0), x - b * block).otherwise(0)


def _div(a: Column, b: Column) -> Column:
    return (a - F.pmod(a, b)) / b


def mix(docs: DataFrame, seed: int = 0, weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document; ``taken`` counts repeats."""
    every, laid = _laid_out(docs, seed, weights, share, most, block, shard_words)
    end = F.col("start") + F.col("size")
    taken = F.col("rounds") * F.col("size") + _words_before(end, block) - _words_before(F.col("start"), block)
    out = ["doc_id", "source", "size", "source_size", "target"]
    none = every.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken"))
    return laid.select(*out, taken.cast("long").alias("taken")).unionByName(none)


def spans(docs: DataFrame, seed: int = 0, weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, source, shard, block, copies, first_word, n_words): the mix itself, each document's part of each chosen block."""
    _, laid = _laid_out(docs, seed, weights, share, most, block, shard_words)
    end = F.col("start") + F.col("size")
    each = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    chosen = F.pmod((F.col("block") + F.col("phase")) * F.col("rest"), F.col("blocks")) >= F.col("blocks") - F.col("rest")
    first = F.greatest(F.col("start"), F.col("block") * block)
    return each.select(
        "doc_id",
        "source",
        "shard",
        "block",
        (F.col("rounds") + F.when((F.col("rest") > 0) & chosen, 1).otherwise(0)).alias("copies"),
        (first - F.col("start")).alias("first_word"),
        (F.least(end, (F.col("block") + 1) * block) - first).alias("n_words"),
    ).where("copies > 0")
