"""Inherently sequential operators: one small matrix or bitmap for each set, sets in parallel."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def agglomerate(ids: list[int], pairs: dict[tuple[int, int], float], threshold: float) -> tuple[list[list[int]], list[tuple[float, list[int], list[int]]]]:
    """Complete linkage: bins of sorted ids, and the merges in order.

    A bin goes by its least id and knows its linkage to those bins only that it has no missing pair with. A heap
    offers the closest two bins first (ties: the lowest first, then second bin); entries that a merge has overtaken are
    passed over. Linkages only fall, so it ends at the first one under ``threshold``, or with the heap.
    """
    members = {g: [g] for g in sorted(ids)}
    near: dict[int, dict[int, float]] = {g: {} for g in members}
    for (a, b), v in pairs.items():
        if a != b and a in near and b in near and v is not None and v == v:
            near[a][b] = near[b][a] = float(v)
    offers = [(-v, a, b) for a, others in near.items() for b, v in others.items() if a < b]
    heapq.heapify(offers)
    trace = []
    while offers:
        v, a, b = heapq.heappop(offers)
        v = -v
        if v < threshold:
            break
        if near.get(a, {}).get(b) != v:
            continue
        trace.append((v, members[a], members[b]))
        members[a] = sorted(members[a] + members.pop(b))
        first, second = near.pop(a), near.pop(b)
        for other in first.keys() | second.keys():
            if other not in (a, b):
                near[other].pop(a, None)
                near[other].pop(b, None)
        near[a] = {other: min(first[other], second[other]) for other in first.keys() & second.keys()}
        for other, link in near[a].items():
            near[other][a] = link
            heapq.heappush(offers, (-link, min(a, other), max(a, other)))
    return sorted(members.values(), key=lambda bin: (-len(bin), bin[0])), trace


def _matrix(pdf: pd.DataFrame) -> tuple[list[int], dict]:
    ids = sorted(set(pdf["ga"]) | set(pdf["gb"]))
    return ids, {(a, b): v for a, b, v in zip(pdf["ga"], pdf["gb"], pdf["aai"]) if a != b}


def _rows(aai_matrix: DataFrame) -> DataFrame:
    """One half of the matrix and the diagonal (which names lone groups)."""
    return aai_matrix.where("ga <= gb").select("set_id", "ga", "gb", "aai")


def bins(aai_matrix: DataFrame, thresholds: list[float]) -> DataFrame:
    """(set_id, threshold, bin, grp) of complete linkage at each threshold; bins are numbered from 1.

    One dendrogram a set, cut at every threshold by union of its merges.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, pairs = _matrix(pdf)
        sid = pdf["set_id"].iloc[0]
        _, trace = agglomerate(ids, pairs, -np.inf)
        out = []
        for t in thresholds:
            root = {g: g for g in ids}
            for v, a, b in trace:
                if v >= t:
                    low = min(root[a[0]], root[b[0]])
                    for g in a + b:
                        root[g] = low
            sizes: dict[int, list[int]] = {}
            for g in ids:
                sizes.setdefault(root[g], []).append(g)
            for k, b in enumerate(sorted(sizes.values(), key=lambda b: (-len(b), b[0]))):
                out += [(sid, float(t), k + 1, g) for g in b]
        return pd.DataFrame(out, columns=["set_id", "threshold", "bin", "grp"])

    return _rows(aai_matrix).groupBy("set_id").applyInPandas(work, "set_id long, threshold double, bin int, grp int")


def merge_trace(aai_matrix: DataFrame, threshold: float) -> DataFrame:
    """(set_id, step, linkage, side_a, side_b) of every merge."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, pairs = _matrix(pdf)
        sid = pdf["set_id"].iloc[0]
        _, trace = agglomerate(ids, pairs, threshold)
        return pd.DataFrame([(sid, k + 1, v, a, b) for k, (v, a, b) in enumerate(trace)], columns=["set_id", "step", "linkage", "side_a", "side_b"])

    return _rows(aai_matrix).groupBy("set_id").applyInPandas(work, "set_id long, step int, linkage double, side_a array<int>, side_b array<int>")


threshold_sweep = bins


def greedy_removal(hit_from: DataFrame, partner: DataFrame, items: DataFrame, names: DataFrame) -> DataFrame:
    """(set_id, retained, core_size, removed): groups left out one by one, down to two.

    Each round leaves out the group that gains the fixed anchor's core most, never the anchor
    (ties: the least), and records the core after the anchor is chosen anew. The first row
    removes nothing. Items that the same groups hit, or hold mates of, are alike here: Spark counts them by that list of groups,
    and a set's task gets the lists with their counts, not its hits.
    """
    key = ["set_id", "kind", "grp"]
    rel = hit_from.select("set_id", F.lit("hit").alias("kind"), "grp", "item", "other").unionByName(partner.select("set_id", F.lit("mate").alias("kind"), "grp", "item", "other"))
    lists = rel.groupBy(*key, "item").agg(F.sort_array(F.collect_set("other")).alias("others")).groupBy(*key, "others").agg(F.count("*").alias("n"))
    own = items.groupBy("set_id", F.lit("item").alias("kind"), "grp").agg(F.count("*").alias("n")).withColumn("others", F.array("grp"))
    rel = lists.unionByName(own).join(names, ["set_id", "grp"])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        sid = pdf["set_id"].iloc[0]
        name = dict(zip(pdf["grp"], pdf["name"]))
        counted: dict[tuple[str, int], list[tuple[set[int], int]]] = {}
        for kind, grp, others, n in zip(pdf["kind"], pdf["grp"], pdf["others"], pdf["n"]):
            counted.setdefault((kind, grp), []).append((set(others), n))

        def full(kind: str, g: int, left: set[int]) -> int:
            need = left - {g}
            return sum(n for others, n in counted.get((kind if need else "item", g), []) if need <= others)

        def anchor(left: set[int]) -> int:
            return min(left, key=lambda g: (full("hit", g, left) if len(left) > 1 else 0, name[g]))

        left = set(name)
        ref = anchor(left)
        out = [(sid, len(left), full("mate", ref, left), None)]
        while len(left) > 2:
            best = max(sorted(left - {ref}), key=lambda g: full("mate", ref, left - {g}))
            left = left - {best}
            ref = anchor(left)
            out.append((sid, len(left), full("mate", ref, left), best))
        return pd.DataFrame(out, columns=["set_id", "retained", "core_size", "removed"]).astype({"removed": "Int64"})

    return rel.groupBy("set_id").applyInPandas(work, "set_id long, retained int, core_size long, removed long")


def one_to_one(hits: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df.checkpoint()) -> DataFrame:
    """(set_id, gq, gs, q, s, score): hits taken in descending score (ties: q, s) while both sides are free.

    A hit that comes first both for its query and for its subject is taken whatever else there is, so each round takes all of
    those and drops the hits of items that are no longer free, until none is left. No group pair is gathered.
    ``keep`` cuts the lineage of a round.
    """
    pair = ["set_id", "gq", "gs"]
    rest = keep("open-0", hits.select(*pair, "q", "s", "score"))
    taken, round_ = None, 0
    order = F.struct((-F.col("score")).alias("score"), "q", "s")
    while not rest.isEmpty():
        first_q = rest.groupBy(*pair, "q").agg(F.min(order).alias("o")).select(*pair, "o.*")
        first_s = rest.groupBy(*pair, "s").agg(F.min(order).alias("o")).select(*pair, "o.*")
        got = first_q.join(first_s, [*pair, "score", "q", "s"], "left_semi").select(*pair, "q", "s", (-F.col("score")).alias("score"))
        round_ += 1
        got = keep(f"taken-{round_}", got)
        taken = got if taken is None else taken.unionByName(got)
        rest = keep(f"open-{round_}", rest.join(got.select(*pair, "q"), [*pair, "q"], "left_anti").join(got.select(*pair, "s"), [*pair, "s"], "left_anti"))
    return rest if taken is None else taken


def bin_summary(bins: DataFrame) -> DataFrame:
    """(set_id, threshold, bins, largest, singletons)."""
    size = bins.groupBy("set_id", "threshold", "bin").agg(F.count("*").alias("n"))
    return size.groupBy("set_id", "threshold").agg(
        F.count("*").alias("bins"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons")
    )


def number_bins(members: DataFrame) -> DataFrame:
    """(set_id, bin, grp) from (set_id, label, grp): larger bins first, then the least member."""
    b = members.groupBy("set_id", "label").agg(F.count("*").alias("n"), F.min("grp").alias("low"))
    order = Window.partitionBy("set_id").orderBy(F.desc("n"), "low")
    return members.join(b.withColumn("bin", F.row_number().over(order)), ["set_id", "label"]).select("set_id", "bin", "grp")


def bin_pairs(bins: DataFrame, matrix: DataFrame) -> DataFrame:
    """(set_id, bin_a, bin_b, ga, gb, aai) of group pairs ga < gb with both bins."""
    a = bins.select("set_id", F.col("grp").alias("ga"), F.col("bin").alias("bin_a"))
    b = bins.select("set_id", F.col("grp").alias("gb"), F.col("bin").alias("bin_b"))
    return matrix.where("ga < gb").join(a, ["set_id", "ga"]).join(b, ["set_id", "gb"])


def best_rejected_linkage(bins: DataFrame, matrix: DataFrame, threshold: float) -> DataFrame:
    """(set_id, linkage, margin) of every set: the closest two bins' farthest pair, missing pairs blocking; margin = threshold - linkage.

    Nulls where a set has one bin, or only bins that missing pairs keep apart.
    """
    low, high = F.least("bin_a", "bin_b"), F.greatest("bin_a", "bin_b")
    cross = bin_pairs(bins, matrix).where("bin_a <> bin_b")
    link = cross.groupBy("set_id", low.alias("x"), high.alias("y")).agg(F.min(F.coalesce("aai", F.lit(-1e308))).alias("l"))
    best = bins.select("set_id").distinct().join(link.groupBy("set_id").agg(F.max("l").alias("l")), "set_id", "left")
    return best.select("set_id", F.when(F.col("l") > -1e308, F.col("l")).alias("linkage")).withColumn("margin", F.lit(float(threshold)) - F.col("linkage"))
