"""From ortholog groups to a tree: star alignments, a test for recombination, neighbour joining.

Each ortholog group is one small task: its sequences, one of each group of items, are aligned to a centre, so that columns have
equal length; informative columns are tested for recombination by permutation; and a set's identities, or the distances of
its joined alignments, become a tree. Groups and sets run side by side, none is large: a group holds one
sequence of each genome, a set's matrix one number a pair of genomes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = "-"


# ---- alignment -------------------------------------------------------------------------


def align_pair(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = 2) -> tuple[str, str]:
    """A global alignment of highest score; a gap costs ``gap`` a letter. Ties: letters before gaps, then a gap in ``b``."""
    x, y = (np.frombuffer(s.encode("utf-32-le"), "<u4") for s in (a, b))
    n, m = len(x), len(y)
    h = np.zeros((n + 1, m + 1), "i4")
    h[0] = -gap * np.arange(m + 1)
    ramp = gap * np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.empty(m + 1, "i4")
        best[0] = -gap * i
        np.maximum(h[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch), h[i - 1, 1:] - gap, out=best[1:])
        h[i] = np.maximum.accumulate(best + ramp) - ramp
    i, j, left, right = n, m, [], []
    while i or j:
        if i and j and h[i, j] == h[i - 1, j - 1] + (match if x[i - 1] == y[j - 1] else mismatch):
            i, j = i - 1, j - 1
            left.append(a[i])
            right.append(b[j])
        elif i and h[i, j] == h[i - 1, j] - gap:
            i -= 1
            left.append(a[i])
            right.append(GAP)
        else:
            j -= 1
            left.append(GAP)
            right.append(b[j])
    return "".join(reversed(left)), "".join(reversed(right))


def star(sequences: list[str], k: int = 3) -> list[str]:
    """The sequences with gaps, in columns: all are aligned to the one that shares most ``k``-mers with the others (ties: the first)."""
    words = [{s[i : i + k] for i in range(len(s) - k + 1)} for s in sequences]
    centre = max(range(len(sequences)), key=lambda c: (sum(len(words[c] & w) for w in words), -c))
    pairs = [align_pair(sequences[centre], s) if i != centre else (sequences[centre], sequences[centre]) for i, s in enumerate(sequences)]
    # Letters that stand before each letter of the centre (and after its last) in some sequence: the longest run makes room for all.
    length = len(sequences[centre])
    runs = []
    for c, s in pairs:
        before, at = [""] * (length + 1), 0
        own = []
        for u, v in zip(c, s):
            if u == GAP:
                before[at] += v
            else:
                own.append(v)
                at += 1
        runs.append((before, own))
    room = [max(len(before[p]) for before, _ in runs) for p in range(length + 1)]
    return ["".join(before[p].ljust(room[p], GAP) + (own[p] if p < length else "") for p in range(length + 1)) for before, own in runs]


def align_groups(members: DataFrame) -> DataFrame:
    """(set_id, group_no, grp, aligned) of (set_id, group_no, grp, sequence): columns of equal length in each ortholog group.

    Null sequences are empty. Of several rows of one group of items the first sequence in order counts.
    """
    one = members.groupBy("set_id", "group_no", "grp").agg(F.min(F.coalesce("sequence", F.lit(""))).alias("sequence"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("grp")
        return pdf[["set_id", "group_no", "grp"]].assign(aligned=star(pdf["sequence"].tolist()))

    return one.groupBy("set_id", "group_no").applyInPandas(work, "set_id long, group_no long, grp long, aligned string")


def supermatrix_of(aligned: DataFrame) -> DataFrame:
    """(set_id, grp, joined): each group of items' alignments, joined in the order of the ortholog groups."""
    from kinfold.operators.relational import supermatrix

    return supermatrix(aligned, ["set_id", "grp"], "group_no", "aligned")


# ---- recombination ---------------------------------------------------------------------


def informative(aligned: list[str]) -> np.ndarray:
    """Columns of two letters, each in two sequences or more, as 0 and 1; columns with gaps or other numbers of letters don't count."""
    if not aligned or not aligned[0]:
        return np.zeros((len(aligned), 0), bool)
    cells = np.array([list(s) for s in aligned])
    first = cells[0]
    other = cells != first
    keep = []
    for c in range(cells.shape[1]):
        letters, n = np.unique(cells[:, c], return_counts=True)
        keep.append(len(letters) == 2 and GAP not in letters and n.min() >= 2)
    return other[:, keep]


def incompatible(sites: np.ndarray) -> np.ndarray:
    """Pairs of columns in which all four combinations occur: no tree without recombination or a repeated change has both."""
    a = sites.astype("i4")
    b = 1 - a
    return ((a.T @ a) > 0) & ((a.T @ b) > 0) & ((b.T @ a) > 0) & ((b.T @ b) > 0)


def recombination(aligned: list[str], window: int = 100, rounds: int = 999, seed: int = 1) -> tuple[int, float | None, float | None]:
    """(informative columns, index, p): the share of incompatible pairs among columns less than ``window`` informative columns apart.

    Recombination leaves near columns more compatible than far ones: p is the share of orders of the columns, the true one among
    them, whose index is as low. None where fewer than three columns are informative, or nothing is incompatible.
    """
    sites = informative(aligned)
    n = sites.shape[1]
    if n < 3:
        return n, None, None
    bad = incompatible(sites)
    reach = min(window, max(2, n // 2))
    near = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    near = np.triu((near > 0) & (near < reach))
    index = float(bad[near].mean())
    if not bad.any():
        return n, index, None
    rng, low = np.random.default_rng(seed), 1
    for _ in range(rounds):
        order = rng.permutation(n)
        low += bool(bad[np.ix_(order, order)][near].mean() <= index + 1e-12)
    return n, index, low / (rounds + 1)


def recombination_test(aligned: DataFrame, window: int = 100, rounds: int = 999, seed: int = 1) -> DataFrame:
    """(set_id, group_no, sites, index, p) of every aligned ortholog group; the draws of a group depend on its number and ``seed`` alone."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        sid, no = int(pdf["set_id"].iloc[0]), int(pdf["group_no"].iloc[0])
        n, index, p = recombination(pdf.sort_values("grp")["aligned"].tolist(), window, rounds, seed + 7919 * no)
        return pd.DataFrame({"set_id": [sid], "group_no": [no], "sites": [n], "index": pd.array([index], "Float64"), "p": pd.array([p], "Float64")})

    return aligned.groupBy("set_id", "group_no").applyInPandas(work, "set_id long, group_no long, sites int, index double, p double")


# ---- tree ------------------------------------------------------------------------------


def distances(joined: DataFrame) -> DataFrame:
    """(set_id, ga, gb, distance), ga < gb: the share of unlike letters among columns that are no gap in either, in per cent."""
    letters = lambda c: F.split(c, "")
    a = joined.select("set_id", F.col("grp").alias("ga"), letters("joined").alias("x"))
    b = joined.select("set_id", F.col("grp").alias("gb"), letters("joined").alias("y"))
    both = a.join(b, "set_id").where("ga < gb")  # pairs of one set's groups, as the result has
    cells = F.zip_with("x", "y", lambda u, v: F.when((u == GAP) | (v == GAP), None).otherwise((u != v).cast("int")))
    seen = F.filter(cells, lambda u: u.isNotNull())
    return both.select("set_id", "ga", "gb", seen.alias("s")).select(
        "set_id", "ga", "gb", F.try_divide(100.0 * F.aggregate("s", F.lit(0), lambda t, u: t + u), F.size("s")).alias("distance")
    )


def join_neighbours(ids: list[int], d: np.ndarray) -> list[tuple[int, int, float]]:
    """(node, parent, length) of the neighbour-joining tree; inner nodes are -1, -2, ..., the last joins three (or two) and is the root.

    Ties go to the pair that comes first in the order of nodes. Lengths may be below 0 where distances fit no tree.
    """
    nodes, d, out, inner = list(ids), d.astype("f8").copy(), [], 0
    while len(nodes) > 3:
        n = len(nodes)
        total = d.sum(1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        q[np.tril_indices(n)] = np.inf
        i, j = np.unravel_index(np.argmin(q.round(9)), q.shape)
        inner -= 1
        x = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        out += [(nodes[i], inner, x), (nodes[j], inner, d[i, j] - x)]
        new = (d[i] + d[j] - d[i, j]) / 2
        rest = [k for k in range(n) if k not in (i, j)]
        d = np.vstack([np.column_stack([d[np.ix_(rest, rest)], new[rest]]), np.append(new[rest], 0.0)])
        nodes = [nodes[k] for k in rest] + [inner]
    inner -= 1
    if len(nodes) == 3:
        a, b, c = d[0, 1], d[0, 2], d[1, 2]
        out += [(nodes[0], inner, (a + b - c) / 2), (nodes[1], inner, (a + c - b) / 2), (nodes[2], inner, (b + c - a) / 2)]
    elif len(nodes) == 2:
        out += [(nodes[0], inner, d[0, 1] / 2), (nodes[1], inner, d[0, 1] / 2)]
    return out


def neighbour_tree(pairs: DataFrame, farthest: float = 100.0) -> DataFrame:
    """(set_id, node, parent, length) of each set's tree from (set_id, ga, gb, distance), ga < gb; a null distance is ``farthest``.

    Nodes from 0 on are groups, below 0 inner nodes; the lowest is the root, which has no row. A set of one group has no pairs and no tree.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({*pdf["ga"], *pdf["gb"]})
        at = {g: k for k, g in enumerate(ids)}
        d = np.full((len(ids), len(ids)), farthest)
        np.fill_diagonal(d, 0.0)
        for a, b, v in zip(pdf["ga"], pdf["gb"], pdf["distance"]):
            if v == v and v is not None:
                d[at[a], at[b]] = d[at[b], at[a]] = v
        return pd.DataFrame([(pdf["set_id"].iloc[0], *row) for row in join_neighbours(ids, d)], columns=["set_id", "node", "parent", "length"])

    return pairs.select("set_id", "ga", "gb", "distance").groupBy("set_id").applyInPandas(work, "set_id long, node long, parent long, length double")


def newick(edges: list[tuple[int, int, float]], names: dict[int, str]) -> str:
    """One tree's edges as text, children in the order of their nodes' least leaf."""
    below: dict[int, list[tuple[int, float]]] = {}
    for node, parent, length in edges:
        below.setdefault(parent, []).append((node, length))

    def leaf(node: int) -> int:
        return node if node >= 0 else min(leaf(x) for x, _ in below[node])

    def text(node: int) -> str:
        if node >= 0:
            return names[node]
        return "(" + ",".join(f"{text(x)}:{length:.6g}" for x, length in sorted(below[node], key=lambda e: leaf(e[0]))) + ")"

    return text(min(parent for _, parent, _ in edges)) + ";" if edges else ";"
