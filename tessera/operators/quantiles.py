"""Exact medians of any number of groups and columns, without all values in one buffer or one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.files import roundtrip

#: Accuracy of the sketch that brackets the median; what lies between the brackets, some 4 of so many rows, is sorted. Each task of the
#: input sends such a sketch for each group to one task, so it is small.
ACCURACY = 2_000


def medians(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., median) of a column of doubles: the mean of the two middle values; nulls don't count, groups without a value are left out.

    A sketch gives bounds that surely hold the middle; rows below are only counted, and those between the bounds are counted by value.
    The bounds, one row for each group, are written first: Spark then knows their size, and rows aren't shuffled by group to meet a few of them.
    """
    keys = [f"k{i}" for i in range(len(by))] or ["k0"]
    rows = df.select(*([F.col(c).alias(k) for c, k in zip(by, keys)] if by else [F.lit(0).alias("k0")]), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")  # noqa: B905
    away = 2.0 / ACCURACY
    bounds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", [0.5 - away, 0.5 + away], ACCURACY).alias("b"))
    bounds = roundtrip(bounds.select(*[F.col(k).alias(f"b_{k}") for k in keys], "n", F.get("b", F.lit(0)).alias("lo"), F.get("b", F.lit(1)).alias("hi")))
    same = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
    placed = rows.join(bounds, same).where("v <= hi").select(*keys, "n", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v"))
    counts = placed.groupBy(*keys, "n", "v").agg(F.count(F.lit(1)).alias("k"))  # one row for all that lie below
    upto = F.sum("k").over(Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("k"))
    first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    held = lambda rank: F.max(F.when((F.col("before") < rank) & (rank <= F.col("upto")), F.col("v")))
    found = at.groupBy(*keys).agg(((held(first) + held(second)) / 2).alias("median"))
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "median") if by else found.select("median")  # noqa: B905
