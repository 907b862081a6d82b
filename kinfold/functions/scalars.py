"""Column expressions: ladders, statistics and string rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of mean identity and file suffixes (fixed values).
SPECIES, DIVERGENT, GENUS = 95.0, 80.0, 65.0
#: Two-sided 95 per cent quantile of the normal distribution.
Z95 = 1.959963985
FASTA_SUFFIXES = (".faa", ".fa", ".fasta", ".fas", ".pep", ".protein")


def classify_pair(aai: Column) -> Column:
    return (
        F.when(aai.isNull() | F.isnan(aai), "no orthologs")
        .when(aai >= SPECIES, "same species")
        .when(aai >= DIVERGENT, "same genus, different species")
        .when(aai >= GENUS, "same genus, divergent")
        .otherwise("likely different genus")
    )


def verdict(aai: Column, gain: Column, best_gain: Column, baseline: Column) -> Column:
    """Reading of a group's nearest neighbour and of what the core gains without the group."""
    collapses = (gain == best_gain) & (best_gain > 0) & (gain >= F.greatest(F.lit(1), baseline))
    return (
        F.when(aai.isNull() | F.isnan(aai) | (aai < GENUS), "CANDIDATE NOVEL TAXON")
        .when(collapses & (aai < SPECIES), "REVIEW - collapses the shared core")
        .when(aai < DIVERGENT, "distinct species within the genus")
        .when(aai < SPECIES, "distinct species")
        .otherwise("consistent with the group")
    )


def outcome(predicted: Column, actual: Column) -> Column:
    return (
        F.when(predicted & actual, "split/split corroborated")
        .when(predicted, "split/coherent only here")
        .when(actual, "coherent/split too permissive")
        .otherwise("coherent/coherent agree")
    )


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval in per cent, within 0 and 100; null for n = 0."""
    p, zz = F.try_divide(k, n), z * z
    centre, spread = p + zz / (2 * n), z * F.sqrt(F.try_divide(p * (1 - p), n) + zz / (4 * n * n))
    low = F.greatest(F.lit(0.0), F.try_divide(centre - spread, 1 + zz / n))
    high = F.least(F.lit(1.0), F.try_divide(centre + spread, 1 + zz / n))
    some = n > 0
    return F.when(some, low * 100), F.when(some, high * 100)


def kappa(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Cohen's kappa; null where chance agreement is complete or nothing was counted."""
    n = (tp + fp + fn + tn).cast("double")
    chance = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return F.try_divide(F.try_divide(tp + tn, n) - chance, 1 - chance)


def pairs_of(n: Column) -> Column:
    """n choose 2."""
    return n * (n - 1) / 2


def _stirling_error(x: Column) -> Column:
    """log(x!) less Stirling's formula for it, x > 0."""
    exact = [0.08106146679532726, 0.0413406959554093, 0.02767792568499834, 0.020790672103765093, 0.016644691189821193, 0.013876128823070748, 0.011896709945891770, 0.010411265261972096]
    square = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / square) / square) / square) / square) / x
    for k, error in reversed(list(enumerate(exact))):
        series = F.when(x == k + 1, error).otherwise(series)
    return series


def _deviance(x: Column, mean: Column) -> Column:
    """x * log(x / mean) + mean - x, without the loss of digits where x is near the mean."""
    v = (x - mean) / (x + mean)
    near, power = (x - mean) * v, 2 * x * v
    for k in range(1, 8):
        power = power * v * v
        near = near + power / (2 * k + 1)
    return F.when(F.abs(v) < 0.1, near).otherwise(x * F.log(x / mean) + mean - x)


def sign_test(wins: Column, n: Column) -> Column:
    """P(X >= wins) for X of n fair coins.

    The first term is the probability of its count, by Stirling's formula and its error; each next one is the last times
    (n - x) / (x + 1). The sum starts in the upper half, where terms fall; below it, it is 1 less the sum of the other tail.
    """
    k, n = wins.cast("double"), n.cast("double")
    low = 2 * k <= n
    start = F.when(low, n - k + 1).otherwise(k)
    other, half = n - start, n / 2
    log_first = (
        _stirling_error(n) - _stirling_error(start) - _stirling_error(other) - _deviance(start, half) - _deviance(other, half)
        + F.log(n / (start * other)) / 2 - 0.9189385332046728  # half the log of 2 pi
    )
    first = F.when(start > n, 0.0).when(start == n, F.pow(F.lit(0.5), n)).otherwise(F.exp(log_first))
    step = lambda a, x: F.struct((a["term"] * (n - x) / (x + 1)).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    tail = F.aggregate(
        F.when(start <= n, F.sequence(start.cast("long"), n.cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
        lambda a, x: step(a, x.cast("double")),
        lambda a: a["sum"],
    )
    return F.when(low, 1 - tail).otherwise(tail)


def overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return (low_a <= high_b) & (low_b <= high_a)


def margin_band(margin: Column) -> Column:
    return F.when(margin <= 1, "within 1").when(margin <= 5, "within 5").otherwise("wider")


def expectation(found: Column, expected: Column) -> Column:
    return F.when(expected.isNull(), "NA").when(found == expected, "MATCH").otherwise("MISMATCH")


def stem(name: Column) -> Column:
    """A file name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def is_fasta(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(False)
    for s in FASTA_SUFFIXES:
        out = out | low.endswith(s)
    return out


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9._-]", "_")


def label(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def accession(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"GC[AF]_\d+\.\d+", 0), F.lit(""))


def genus_of_lineage(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, "g__([^;]*)", 1), F.lit(""))


def plain_accession(x: Column) -> Column:
    return F.regexp_replace(x, "^(RS_|GB_)", "")


def members(x: Column) -> Column:
    """A list-valued cell: names between white space or semicolons."""
    return F.filter(F.split(F.btrim(x), r"[;\s]+"), lambda m: m != "")


def https(x: Column) -> Column:
    return F.regexp_replace(x, "^ftp://", "https://")


def base_name(x: Column) -> Column:
    return F.substring_index(F.rtrim(x, F.lit("/")), "/", -1)


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def tolerant_number(x: Column) -> Column:
    """A number, or null for '', NA, nan, '--' and any other text."""
    return F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))


def utc_stamp(x: Column) -> Column:
    """A timestamp as ISO text in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
