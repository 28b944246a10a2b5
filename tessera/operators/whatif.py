"""Sensitivity, lever search and counterfactual status for whole tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relative step (absolute where the value is 0), and the bounds of the search.
STEP, ROUNDS, PRECISION = 0.05, 15, 0.01


def sensitivity(df: DataFrame, key: str, columns: Sequence[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, feature, shift, sensitivity, rank): the largest change of the score when a feature moves 5 % up or down.

    score adds `score` to a table with the columns; it is called once, on each row with all its moved copies.
    """
    moves = [F.struct(F.lit(None).cast("string").alias("feature"), F.lit(0).alias("way"))]
    moves += [F.struct(F.lit(c).alias("feature"), F.lit(w).alias("way")) for c in columns for w in (1, -1)]
    moved = df.select(key, *columns, F.explode(F.array(*moves)).alias("m"))
    step = lambda c: F.when(F.col(c) == 0, F.lit(STEP)).otherwise(F.abs(F.col(c)) * STEP)
    moved = moved.select(key, "m.feature", *[F.when(F.col("m.feature") == c, F.col(c) + F.col("m.way") * step(c)).otherwise(F.col(c)).alias(c) for c in columns])
    scored = score(moved).select(key, "feature", "score")
    base = scored.where("feature IS NULL").select(key, F.col("score").alias("base"))
    shift = scored.where("feature IS NOT NULL").join(base, key).groupBy(key, "feature").agg(F.max(F.abs(F.col("score") - F.col("base"))).alias("shift"))
    w = Window.partitionBy(key)
    return shift.withColumn("sensitivity", F.coalesce(F.try_divide(F.col("shift"), F.max("shift").over(w)), F.lit(0.0))).withColumn("rank", F.row_number().over(w.orderBy(F.desc("shift"), "feature")))


def check_lever(df: DataFrame, lever: str) -> None:
    if lever not in df.columns:
        raise ValueError(f"no such lever: {lever}")
    if not isinstance(df.schema[lever].dataType, T.NumericType):
        raise TypeError(f"the lever {lever} is no number")


def lever_search(df: DataFrame, lever: str, lo: Column, hi: Column, goal: Column, score: Callable[[Column, Mapping[str, Column]], Column], rounds: int = ROUNDS, precision: float = PRECISION) -> DataFrame:
    """Adds best (the lever's value, 4 digits) and reached (its score): bisection of all rows at once for a score that is monotone in the lever.

    score(value, columns) is an expression. Where an end comes nearest to an unreachable goal, that end is the result. The
    fold keeps the rounds inside one expression, so the plan doesn't grow with them. Raises if the lever is no numeric column.
    """
    check_lever(df, lever)
    cols = {c: F.col(c) for c in df.columns}
    up = score(hi, cols) >= score(lo, cols)

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        got = score(mid, cols)
        done = s["done"] | (F.abs(got - goal) <= precision)
        low = F.when(up, got < goal).otherwise(got > goal)
        return F.struct(F.when(~done & low, mid).otherwise(s["lo"]).alias("lo"), F.when(~done & ~low, mid).otherwise(s["hi"]).alias("hi"), F.when(s["done"], s["mid"]).otherwise(mid).alias("mid"), done.alias("done"))

    start = F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), ((lo + hi) / 2).cast("double").alias("mid"), F.lit(False).alias("done"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["mid"])
    at_lo, at_hi = score(lo, cols), score(hi, cols)
    inside = goal.between(F.least(at_lo, at_hi), F.greatest(at_lo, at_hi))
    nearest = F.when(F.abs(at_lo - goal) <= F.abs(at_hi - goal), lo).otherwise(hi).cast("double")
    best = F.round(F.when(inside, found).otherwise(nearest), 4)
    return df.withColumn("best", best).withColumn("reached", score(F.col("best"), cols))


def outcome(df: DataFrame, reached: Column, goal: Column, risk: Column, lo: Column, hi: Column, lever: str | None = None, strict: bool = False) -> DataFrame:
    """Adds status and risk; a FAILED row has risk 1. Raises if a lever is named that is no numeric column, and (strict) if a row fails."""
    if lever is not None:
        check_lever(df, lever)
    df = df.withColumn("status", status(reached, goal, risk, lo, hi))
    if strict and df.where("status = 'FAILED'").limit(1).count():
        raise ValueError("a row has missing or inverted bounds")
    return df.withColumn("risk", F.when(F.col("status") == "FAILED", 1.0).otherwise(risk))


def status(reached: Column, goal: Column, risk: Column, lo: Column, hi: Column) -> Column:
    """FAILED for inverted or missing bounds, UNREACHABLE beyond 5 % of the goal, else by risk: HIGH_RISK above .7, MODERATE_RISK above .35, SAFE."""
    off = F.try_divide(F.abs(reached - goal), F.greatest(F.abs(goal), F.lit(1e-9)))
    return F.when(lo.isNull() | hi.isNull() | (lo > hi), "FAILED").when(off > 0.05, "UNREACHABLE").when(risk > 0.7, "HIGH_RISK").when(risk > 0.35, "MODERATE_RISK").otherwise("SAFE")
