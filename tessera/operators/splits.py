"""Train/test splits and walk-forward folds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.files import roundtrip


def dates_of(panel: DataFrame) -> DataFrame:
    """(ts, i): the distinct dates numbered from 0. A panel has few dates, however many entities; only they are ordered in one place."""
    return panel.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)


def temporal_split(panel: DataFrame, horizon: int) -> DataFrame:
    """Adds role: test for the last `horizon` dates, train before. Raises if there aren't more dates."""
    last = panel.select("ts").distinct().orderBy(F.desc("ts")).limit(horizon + 1).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("cut")).first()
    if last.n <= horizon:
        raise ValueError(f"a panel of {last.n} dates can't hold back {horizon}")
    return panel.withColumn("role", F.when(F.col("ts") > F.lit(last.cut), "test").otherwise("train"))


def _order(series: DataFrame) -> list[Column]:
    """Rows of a series by time; those of one time by a hash of all they hold."""
    return [F.col("ts"), F.xxhash64(*series.columns)]


def numbered_rows(series: DataFrame) -> DataFrame:
    """Adds i, from 0, in the order of time. Ranges of the order are written and counted, and each is numbered for itself from the count of those before."""
    ts, tie = _order(series)
    dealt = roundtrip(series.withColumn("__tie", tie).repartitionByRange("ts", "__tie").withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    i = F.row_number().over(Window.partitionBy("__part").orderBy("ts", "__tie")) - 1 + F.col("__before")
    return dealt.join(before, "__part").withColumn("i", i).drop("__part", "__before", "__tie")


def row_split(series: DataFrame, horizon: int) -> DataFrame:
    """The same by rows of a single series: the last `horizon` rows are the test, also where times repeat (rows that are the same in all count together)."""
    ts, tie = _order(series)
    key = F.struct(ts, tie.alias("tie"))
    last = series.select(key.alias("k")).orderBy(F.desc("k")).limit(horizon + 1).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("cut")).first()
    if last.n <= horizon:
        raise ValueError(f"a series of {last.n} rows can't hold back {horizon}")
    return series.withColumn("role", F.when(key > F.struct(F.lit(last.cut.ts).alias("ts"), F.lit(last.cut.tie).alias("tie")), "test").otherwise("train"))


def random_split(df: DataFrame, key: str, label: str | None = None, seed: int = 42) -> DataFrame:
    """Adds role: 15 % test below 500 rows, else 20 %, by a hash (60 bits of the MD5 of seed and key); exact within each label if there are at most 50."""
    few = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(51).collect() if label else []
    few = few if len(few) <= 50 else []
    n = sum(r.n for r in few) if few else df.count()  # rows and labels in one pass
    ratio = 0.15 if n < 500 else 0.20
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    if few:
        # Hashes are even: a threshold of the hash is the split, and no group is sorted. Rounded within a label only.
        w = Window.partitionBy(label, "__bin")
        df = df.withColumn("__bin", F.pmod(h, F.lit(max(1, n // 100_000)))).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__r", F.row_number().over(w.orderBy(h, key)))
        # Written, as both sides are read more than once and each time would shuffle and sort all rows.
        return roundtrip(df.withColumn("role", F.when(F.col("__r") <= F.round(F.col("__n") * ratio), "test").otherwise("train")).drop("__bin", "__n", "__r"))
    return df.withColumn("role", F.when(F.pmod(h, F.lit(10_000)) < ratio * 10_000, "test").otherwise("train"))


def fold_table(n: int, initial: int, horizon: int, step: int, sliding: bool, panel: bool) -> list[tuple[int, int, int, int]]:
    """(fold, first training index, first test index, last test index). A panel's test holds horizon + 1 dates, a series' horizon rows."""
    out, cut = [], initial
    while cut + horizon <= (n - 1 if panel else n):
        out.append((len(out), cut - initial if sliding else 0, cut, cut + horizon - (0 if panel else 1)))
        cut += step
    return out


def folds(df: DataFrame, initial: int, horizon: int, step: int, sliding: bool = False, panel: bool = True) -> DataFrame:
    """df once for each fold that holds it, with fold and role: a range join of numbered dates (of a series: rows) with the small table of folds."""
    numbered = dates_of(df) if panel else numbered_rows(df)
    n = numbered.count()
    table = df.sparkSession.createDataFrame(fold_table(n, initial, horizon, step, sliding, panel), "fold int, first int, cut int, last int")
    role = F.when(F.col("i") >= F.col("cut"), "test").otherwise("train").alias("role")
    placed = numbered.join(F.broadcast(table), F.col("i").between(F.col("first"), F.col("last")))
    return df.join(placed.select("ts", "fold", role), "ts") if panel else placed.select(*df.columns, "fold", role)


def default_sizes(n: int, horizon: int) -> tuple[int, int] | None:
    """Initial window and step, or None if the panel is too short for a backtest."""
    initial = max(horizon + 1, int(0.7 * n))
    return None if initial >= n else (initial, 7)


def backtest(folded: DataFrame, fit_predict: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], by: str = "entity") -> DataFrame:
    """(fold, entity, ts, y, yhat, error) of a model fitted for each fold and entity; one that fails has a row with its error and nulls, one without rows none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        train, test = (rows[rows.role == r].sort_values("ts") for r in ("train", "test"))
        if train.empty or test.empty:
            return pd.DataFrame({"fold": [], by: [], "ts": [], "y": [], "yhat": [], "error": []})
        try:
            return test.assign(yhat=fit_predict(train, test), error=None)[["fold", by, "ts", "y", "yhat", "error"]]
        except (ValueError, ArithmeticError, IndexError, np.linalg.LinAlgError) as e:
            return pd.DataFrame({"fold": [rows.fold.iloc[0]], by: [rows[by].iloc[0]], "ts": [None], "y": [None], "yhat": [None], "error": [f"{type(e).__name__}: {e}"]})

    kind = folded.schema[by].dataType.simpleString()
    return folded.groupBy("fold", by).applyInPandas(run, f"fold int, {by} {kind}, ts date, y double, yhat double, error string")


def summary(predicted: DataFrame) -> DataFrame:
    """One row: n_folds, mae, rmse (means over folds), the population standard deviation of mae, n_failed. Reading it raises if no fold has a forecast."""
    per = predicted.groupBy("fold").agg(F.count("yhat").alias("n"), F.count("error").alias("failed"), F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"), F.sqrt(F.avg(F.pow(F.col("y") - F.col("yhat"), 2))).alias("rmse"))
    n = F.count_if(F.col("n") > 0)
    return per.agg(F.when(n > 0, n).otherwise(F.raise_error(F.lit("no fold could be evaluated")).cast("long")).alias("n_folds"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.stddev_pop("mae").alias("mae_std"), F.coalesce(F.sum("failed"), F.lit(0)).alias("n_failed"))


def regime_change(expanding: DataFrame, sliding: DataFrame, limit: float = 0.15) -> DataFrame:
    """One row from two summaries: gap, drift, winner."""
    both = expanding.select(F.lit(1).alias("k"), F.col("mae").alias("mae_expanding")).join(sliding.select(F.lit(1).alias("k"), F.col("mae").alias("mae_sliding")), "k")
    gap = F.try_divide(F.col("mae_expanding") - F.col("mae_sliding"), F.col("mae_expanding"))
    return both.select("mae_expanding", "mae_sliding", gap.alias("gap"), F.coalesce(gap > limit, F.lit(False)).alias("drift"), F.when(F.col("mae_sliding") < F.col("mae_expanding"), "sliding").otherwise("expanding").alias("winner"))
