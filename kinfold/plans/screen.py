"""The whole screen as one lazy plan over (set_id, item, grp) and hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.scalars import classify_pair, verdict
from kinfold.operators import core, iterative, orthology


@dataclass(frozen=True)
class Settings:
    """Limits of a screen; checked when made."""

    min_identity: float = 60.0
    bin_aai: float = 65.0
    max_gapopen: int | None = None
    max_evalue: float | None = None
    min_coverage: float = 0.0

    def __post_init__(self):
        if not 0 <= self.min_identity <= 100:
            raise ValueError("min_identity must lie in 0 .. 100")
        if not 0 < self.bin_aai <= 100:
            raise ValueError("bin_aai must lie in (0, 100]")
        if not 0 <= self.min_coverage <= 1:
            raise ValueError("min_coverage must lie in 0 .. 1")
        if self.max_gapopen is not None and self.max_gapopen < 0 or self.max_evalue is not None and self.max_evalue <= 0:
            raise ValueError("limits of gaps and e-values must be positive")


class Screen:
    """Each property is a DataFrame; nothing runs until one is used."""

    def __init__(
        self,
        items: DataFrame,
        hits: DataFrame,
        settings: Settings = Settings(),
        names: DataFrame | None = None,
        keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
    ):
        """names: (set_id, grp, name); without it groups go by their ids.

        ``keep`` gets every table that several others are made from and returns it, or the same rows read back
        from where it has written them: a caller that wants many results has each table made once.
        """
        self.items, self.hits, self.settings, self.keep = items, hits, settings, keep
        self.groups = keep("groups", items.select("set_id", "grp").distinct())
        self.names = names if names is not None else self.groups.withColumn("name", F.col("grp").cast("string"))

    @cached_property
    def kept(self) -> DataFrame:
        s = self.settings
        return orthology.hit_filter(self.hits, s.max_gapopen, s.max_evalue, s.min_coverage)

    @cached_property
    def best(self) -> DataFrame:
        return self.keep("best", orthology.best_hits(self.kept, "line" if "line" in self.kept.columns else "s"))

    @cached_property
    def hit_from(self) -> DataFrame:
        return self.keep("hit_from", orthology.hit_from(self.kept))

    @cached_property
    def rbh(self) -> DataFrame:
        return self.keep("rbh", orthology.reciprocal(self.best))

    @cached_property
    def partner(self) -> DataFrame:
        return self.keep("partner", orthology.partners(orthology.strong(self.rbh, self.settings.min_identity)))

    @cached_property
    def aai(self) -> DataFrame:
        return orthology.mean_identity(self.rbh)

    @cached_property
    def matrix(self) -> DataFrame:
        return self.keep("matrix", orthology.aai_matrix(self.aai, self.groups))

    @cached_property
    def full(self) -> DataFrame:
        return core.full_subset(self.groups)

    @cached_property
    def counts(self) -> DataFrame:
        return self.keep("counts", core.homolog_counts(self.hit_from, self.full))

    @cached_property
    def ref(self) -> DataFrame:
        return self.keep("ref", core.reference_group(self.counts, self.names))

    @cached_property
    def core(self) -> DataFrame:
        return core.core_items(self.partner, self.items, self.full, self.ref)

    @cached_property
    def ortholog_groups(self) -> DataFrame:
        return core.ortholog_groups(self.core)

    @cached_property
    def presence(self) -> DataFrame:
        return self.keep("presence", core.presence(self.partner, self.items, self.groups, self.ref))

    def core_of(self, subset: DataFrame) -> DataFrame:
        return core.core_sizes(self.hit_from, self.partner, self.items, subset, self.names)

    @cached_property
    def leave_one_out(self) -> DataFrame:
        return self.keep("leave_one_out", core.leave_one_out(self.core_of(self.full), self.without_each))

    @cached_property
    def without_each(self) -> DataFrame:
        return core.sizes_without_each(self.hit_from, self.partner, self.groups, self.names)

    @cached_property
    def nearest(self) -> DataFrame:
        return orthology.nearest(self.matrix)

    @cached_property
    def speciation(self) -> DataFrame:
        """Each group's nearest neighbour, its reading, and the verdict with the core gained without the group."""
        loo = self.leave_one_out.select("set_id", F.col("excluded").alias("grp"), F.col("change").alias("gain"), "baseline")
        best = self.leave_one_out.groupBy("set_id").agg(F.max("change").alias("best"))
        x = self.nearest.join(loo, ["set_id", "grp"], "left").join(best, "set_id", "left")
        gain, top, base = (F.coalesce(c, F.lit(0)) for c in ("gain", "best", "baseline"))
        out = x.select(
            "set_id", "grp", "nearest", "aai", "shared", gain.alias("gain"), classify_pair(F.col("aai")).alias("reading"),
            verdict(F.col("aai"), gain, top, base).alias("verdict"),
        )
        return self.keep("speciation", out)

    @cached_property
    def greedy_removal(self) -> DataFrame:
        return self.keep("greedy_removal", iterative.greedy_removal(self.hit_from, self.partner, self.items, self.names))

    @cached_property
    def soft_core_curve(self) -> DataFrame:
        return core.soft_core_curve(self.presence)

    @cached_property
    def merge_trace(self) -> DataFrame:
        return self.keep("merge_trace", iterative.merge_trace(self.matrix, self.settings.bin_aai))

    @cached_property
    def bins(self) -> DataFrame:
        return self.keep("bins", iterative.bins(self.matrix, [self.settings.bin_aai]))

    @cached_property
    def bin_report(self) -> DataFrame:
        """(set_id, bin, size, ref, core_size, min_aai, mean_aai, members) of each bin, members by name; nulls for lone groups."""
        b = self.bins.select("set_id", "bin", "grp")
        sub = b.select("set_id", F.col("bin").cast("long").alias("subset_id"), "grp")
        pairs = iterative.bin_pairs(b, self.matrix).where("bin_a = bin_b")
        stats = pairs.groupBy("set_id", F.col("bin_a").alias("bin")).agg(F.min("aai").alias("min_aai"), F.avg("aai").alias("mean_aai"))
        named = F.transform(F.array_sort(F.collect_list(F.struct("grp", "name"))), lambda m: m["name"])
        size = b.join(self.names, ["set_id", "grp"]).groupBy("set_id", "bin").agg(F.count("*").alias("size"), F.array_join(named, " ").alias("members"))
        sizes = self.core_of(sub).withColumnRenamed("subset_id", "bin")
        return self.keep("bin_report", size.join(sizes, ["set_id", "bin"]).join(stats, ["set_id", "bin"], "left"))

    @cached_property
    def survey(self) -> DataFrame:
        """One row a set: its size, core and bins, its identities, and the group without which the core gains most (ties: the least)."""
        key = "set_id"
        size = self.groups.groupBy(key).agg(F.count("*").alias("groups")).join(self.items.groupBy(key).agg(F.count("*").alias("items")), key)
        whole = self.core_of(self.full).select(key, "core_size")
        per_bin = self.bins.groupBy(key, "bin").agg(F.count("*").alias("n"))
        bins = per_bin.groupBy(key).agg(F.count("*").alias("bins"), F.max("n").alias("largest_bin"), F.count_if(F.col("n") == 1).alias("lone_groups"))
        found = self.aai.groupBy(key).agg(F.count("*").alias("pairs"), F.min("aai").alias("min_aai"), F.avg("aai").alias("mean_aai"), F.count_if(F.col("aai") >= 95).alias("pairs_95"))
        most = F.max(F.struct("change", (-F.col("excluded")).alias("g"))).alias("m")
        gain = self.leave_one_out.groupBy(key).agg(most).select(key, F.col("m.change").alias("most_gain"), (-F.col("m.g")).alias("most_gain_without"))
        out = size.join(whole, key).join(bins, key).join(found, key, "left").join(gain, key, "left")
        return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pairs", "pairs_95")})
