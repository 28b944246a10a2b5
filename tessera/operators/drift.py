"""Drift between a reference and a current table, all columns in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import finite
from tessera.sources.files import roundtrip

BINS, EPSILON = 10, 1e-10


def long_form(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, side, v): 0 the reference, 1 the current table; nulls and values that aren't finite go; columns that either lacks are left out."""

    def cells(df: DataFrame, side: int) -> DataFrame:
        cols = [c for c in columns if c in reference.columns and c in current.columns]
        x = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols]))
        return df.select(x.alias("x")).select("x.feature", F.lit(side).alias("side"), "x.v").where(finite(F.col("v")))

    return cells(reference, 0).union(cells(current, 1))


def tally(cells: DataFrame) -> DataFrame:
    """(feature, v, a, b): how often each value stands in the reference and in the current table."""
    return cells.groupBy("feature", "v").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))


#: Up to so many rows on either side the p-value is exact, beyond it is the asymptotic series.
EXACT = 10_000


def ks(cells: DataFrame, ranges: int | None = None) -> DataFrame:
    """(feature, n_ref, n_cur, ks, p_value): the largest distance of the two empirical distributions.

    Values are counted first and dealt to ranges of (feature, value); the running sums need only the totals of the ranges before, so
    no feature's values are ever sorted in one task.
    """
    return ks_of(tally(cells), ranges)


def ks_of(counts: DataFrame, ranges: int | None = None) -> DataFrame:
    """The same from counts (feature, v, a, b). ranges: how many, if not as many as the session's shuffles have."""
    ranged = roundtrip(counts.repartitionByRange(*([ranges] if ranges else []), "feature", "v").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("feature", "part").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))  # a row for each range and feature in it
    before, whole = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("feature")
    offsets = sums.select("feature", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o) for c, o in (("sa", "oa"), ("sb", "ob"))], F.sum("sa").over(whole).alias("n_ref"), F.sum("sb").over(whole).alias("n_cur"))
    w = Window.partitionBy("feature", "part").orderBy("v")
    run = ranged.join(offsets, ["feature", "part"]).withColumns({"fa": (F.col("oa") + F.sum("a").over(w)) / F.col("n_ref"), "fb": (F.col("ob") + F.sum("b").over(w)) / F.col("n_cur")})
    stat = run.where("n_ref > 0 AND n_cur > 0").groupBy("feature", "n_ref", "n_cur").agg(F.max(F.abs(F.col("fa") - F.col("fb"))).alias("ks"))
    return _with_p_value(stat)


def _with_p_value(stat: DataFrame) -> DataFrame:
    d, n, m = F.col("ks"), F.col("n_ref"), F.col("n_cur")
    return stat.withColumn("p_value", F.when(F.greatest(n, m) <= EXACT, _exact(d, n, m)).otherwise(ks_p_value(d, n, m)))


def ks_exact(d: float, n: int, m: int) -> float:
    """The share of all orders of n and m values, equally likely, whose distance is d at least.

    An order is a path from (0, 0) to (n, m) in a lattice. Of all paths to (i, j) the share that has met a point of distance d or more
    is 1 at such a point, else the mean of the shares one step back, weighed by i and j. Diagonals follow one another, each an array.
    """
    n, m = max(n, m), min(n, m)
    a, b = n // gcd(n, m), m // gcd(n, m)
    least = round(d * a * m)  # the distance in units of 1 / lcm(n, m)
    if least <= 0:
        return 1.0
    met = np.zeros(m + 2)  # met[j + 1]: the share at (s - j, j)
    for s in range(1, n + m + 1):
        lo, hi = max(0, s - n), min(m, s)
        j = np.arange(lo, hi + 1)
        now = (met[lo : hi + 1] * j + met[lo + 1 : hi + 2] * (s - j)) / s
        now[np.abs(j * a - (s - j) * b) >= least] = 1.0
        met[lo + 1 : hi + 2] = now
    return float(met[m + 1])


@F.pandas_udf(T.DoubleType())
def _exact(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Rows are features; those beyond EXACT are left to the series."""
    return pd.Series([ks_exact(x, int(i), int(j)) if max(i, j) <= EXACT else None for x, i, j in zip(d, n, m, strict=True)], dtype=float)


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """The asymptotic Kolmogorov series, for large samples."""
    x = F.sqrt(n * m / (n + m)) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def histogram(cells: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, bin, p, q): shares of the reference and the current table in bins with common edges, empty ones as epsilon."""
    return histogram_of(tally(cells), bins)


def histogram_of(counts: DataFrame, bins: int = BINS) -> DataFrame:
    ends = counts.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("a").alias("n"), F.sum("b").alias("m"))
    ends = ends.where("n > 0 AND m > 0")
    bin_of = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    of_bin = counts.join(ends, "feature").groupBy("feature", bin_of.alias("bin")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    every = ends.select("feature", "n", "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    share = lambda k, n: F.greatest(F.coalesce(F.col(k) / F.col(n), F.lit(0.0)), F.lit(EPSILON))
    return every.join(of_bin, ["feature", "bin"], "left").select("feature", "bin", share("a", "n").alias("p"), share("b", "m").alias("q"))


def divergences(hist: DataFrame) -> DataFrame:
    """(feature, psi, kl, js)."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    return hist.groupBy("feature").agg(F.sum((p - q) * F.log(p / q)).alias("psi"), F.sum(p * F.log(p / q)).alias("kl"), (0.5 * F.sum(p * F.log(p / m)) + 0.5 * F.sum(q * F.log(q / m))).alias("js"))


@dataclass
class Reference:
    """A reference counted once: ascending edges of each feature's bins, and (feature, bin, a), the rows in each: bin k is above k edges and at most the next."""

    edges: dict[str, list[float]]
    counts: DataFrame


def in_bins(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """(feature, bin) of each finite value of the features that df has; also for streams."""
    value = {c: F.col(c).cast("double") for c in edges if c in df.columns}
    place = lambda c: F.when(finite(value[c]), F.size(F.filter(F.array(*map(F.lit, edges[c])), lambda e: e < value[c])))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), place(c).alias("bin")) for c in value]))
    return df.select(cells.alias("x")).select("x.*").where("bin IS NOT NULL")


def counted_reference(df: DataFrame, columns: Sequence[str], bins: int = 256, edges: Mapping[str, Sequence[float]] | None = None) -> Reference:
    """Bins at quantiles of the reference, or at given edges, and its counts, written once. Columns without a finite value are left out."""
    if edges is None:
        cuts = [F.percentile_approx(F.when(finite(F.col(c).cast("double")), F.col(c).cast("double")), [i / bins for i in range(1, bins)], 20 * bins).alias(str(k)) for k, c in enumerate(columns)]
        row = df.agg(*cuts).first()  # a row whose size the bins bound
        edges = {c: sorted(set(row[str(k)])) for k, c in enumerate(columns) if row[str(k)]}
    known = {c: sorted(map(float, e)) for c, e in edges.items()}
    return Reference(known, roundtrip(in_bins(df, known).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("a"))))


def report_of_bins(reference: Reference, counts: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(feature, n_ref, n_cur, ks, p_value, drifted, psi, kl, js) from counts (feature, bin, b) of what came: a few rows for each feature, however many were counted.

    ks is the largest distance at the edges; between edges it may be larger by the share of a bin at most.
    """
    both = reference.counts.join(counts.select("feature", "bin", "b"), ["feature", "bin"], "full").select("feature", "bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("a", "b")])
    whole, upto = Window.partitionBy("feature"), Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    n, m = F.sum("a").over(whole), F.sum("b").over(whole)
    both = both.select("feature", "a", "b", n.alias("n_ref"), m.alias("n_cur"), F.abs(F.sum("a").over(upto) / n - F.try_divide(F.sum("b").over(upto), m)).alias("off")).where("n_ref > 0 AND n_cur > 0")
    share = lambda k, n: F.greatest(F.col(k) / F.col(n), F.lit(EPSILON))
    stat = _with_p_value(both.groupBy("feature", "n_ref", "n_cur").agg(F.max("off").alias("ks")))
    apart = divergences(both.select("feature", share("a", "n_ref").alias("p"), share("b", "n_cur").alias("q")))
    return stat.withColumn("drifted", F.col("p_value") < threshold).join(apart, "feature")


def psi_level(psi: Column) -> Column:
    return F.when(psi < 0.1, "NO_DRIFT").when(psi < 0.25, "MODERATE_DRIFT").otherwise("SIGNIFICANT_DRIFT")


def report(reference: DataFrame, current: DataFrame, columns: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """(feature, ks, p_value, drifted, threshold)."""
    return ks(long_form(reference, current, columns)).select("feature", "ks", "p_value", (F.col("p_value") < threshold).alias("drifted"), F.lit(threshold).alias("threshold"))


def full_report(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, psi, psi_level, ks, ks_drift, kl, kl_drift, js, js_drift)."""
    counts = roundtrip(tally(long_form(reference, current, columns)))  # read by both
    both = divergences(histogram_of(counts)).join(ks_of(counts).select("feature", "ks"), "feature")
    return both.select("feature", "psi", psi_level(F.col("psi")).alias("psi_level"), "ks", (F.col("ks") > 0.2).alias("ks_drift"), "kl", (F.col("kl") > 0.1).alias("kl_drift"), "js", (F.col("js") > 0.1).alias("js_drift"))


def gate(drift: DataFrame, limit: float = 0.3) -> DataFrame:
    """One row: score (1 less the mean p-value), stopped, any_drifted (the sounder test: a column below its threshold)."""
    score = 1 - F.avg("p_value")
    return drift.agg(score.alias("score"), (score > limit).alias("stopped"), F.bool_or("drifted").alias("any_drifted"))


def manifold(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std): population standard deviation, 1e-9 at least."""
    row = df.agg(*[F.struct(F.avg(c).alias("mean"), F.greatest(F.stddev_pop(c), F.lit(1e-9)).alias("std")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.std").alias("std")) for c in columns])).alias("x")).select("x.*")


def with_risk(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds distance (norm of z) and risk, 1 - exp(-distance / sqrt(columns))."""
    know = {r.feature: (r["mean"], r["std"]) for r in fitted.collect()}  # a row for each column
    z2 = sum(F.pow((F.col(c) - F.lit(know[c][0])) / F.lit(know[c][1]), 2) for c in columns)
    return df.withColumn("distance", F.sqrt(z2)).withColumn("risk", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.exp(-F.col("distance") / F.lit(len(columns) ** 0.5)))))


def population_drift(with_distance: DataFrame, n_columns: int) -> DataFrame:
    return with_distance.agg((1 - F.exp(-F.avg("distance") / F.lit(n_columns**0.5))).alias("population_drift"))
