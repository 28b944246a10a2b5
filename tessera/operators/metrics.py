"""Evaluation metrics as aggregates over (y, yhat), by any group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import finite
from tessera.operators.quantiles import medians
from tessera.sources.files import roundtrip

TINY = 1e-9


def _group(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by)


def regression(df: DataFrame, by: Sequence[str] = (), n_features: int | None = None) -> DataFrame:
    """mae, mse, rmse, median_ae, max_error, r2, adjusted_r2, explained_variance, msle, mape, n_excluded. Raises on values that aren't finite.

    The values are written first: they are read several times, and a model may have to work them out.
    """
    df = roundtrip(df.select(*dict.fromkeys([*by, "y", "yhat"])))
    y, p = F.col("y").cast("double"), F.col("yhat").cast("double")
    if df.where(~(finite(y) & finite(p))).limit(1).count():
        raise ValueError("y and yhat must be finite")
    e, apart = y - p, F.abs(y) > TINY
    n = F.count(F.lit(1))
    agg = _group(df, by).agg(
        n.alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.max(F.abs(e)).alias("max_error"),
        F.sum(e * e).alias("ss_res"),
        (F.var_pop(y) * n).alias("ss_tot"),
        F.when(F.var_pop(y) >= TINY, 1 - F.var_pop(e) / F.var_pop(y)).alias("explained_variance"),
        F.when(~F.bool_or(y < 0), F.avg(F.pow(F.log1p(F.greatest(y, F.lit(0.0))) - F.log1p(F.greatest(p, F.lit(0.0))), 2))).alias("msle"),
        (F.avg(F.when(apart, F.abs(e / y))) * 100).alias("mape"),
        F.count_if(~apart).alias("n_excluded"),
    )
    middle = medians(df.withColumn("__e", F.abs(e)), "__e", by).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("median").alias("median_ae"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] or [F.col("__one") == F.col("__k")]
    agg = agg.withColumn("__one", F.lit(1)).join(middle.withColumn("__k", F.lit(1)), on, "left").drop("__one", "__k", *[f"__{c}" for c in by])
    r2 = F.when(F.col("ss_tot") == 0, F.when(F.col("ss_res") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("ss_res") / F.col("ss_tot"))
    agg = agg.withColumn("r2", r2)
    k = n_features
    adjusted = F.lit(None).cast("double") if k is None else F.when(F.col("n") > k + 1, 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - k - 1))
    return agg.withColumn("adjusted_r2", adjusted).drop("ss_res", "ss_tot")


def forecast(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mae, rmse, mape, smape, wape, bias over the rows where both values are finite."""
    y, p = F.col("y").cast("double"), F.col("yhat").cast("double")
    e, size = y - p, F.abs(y) + F.abs(p)
    total = F.sum(F.abs(y))
    return _group(df.where(finite(y) & finite(p)), by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.when(F.abs(y) > TINY, F.abs(e / y))) * 100).alias("mape"),
        F.coalesce(F.avg(F.when(size > TINY, 200 * F.abs(e) / size)), F.lit(0.0)).alias("smape"),
        F.when(total > TINY, 100 * F.sum(F.abs(e)) / total).when(F.sum(F.abs(p)) > TINY, 100.0).otherwise(0.0).alias("wape"),
        (F.sum(e) / (F.sum(y) + TINY)).alias("bias"),
    )


def seasonal_scale(train: DataFrame, season: int, group: str = "entity", order: str = "ts") -> DataFrame:
    """One row: scale, the mean absolute seasonal difference over all groups that are long enough."""
    w = Window.partitionBy(group).orderBy(order)
    return train.select(F.abs(F.col("y") - F.lag("y", season).over(w)).alias("d")).agg(F.avg("d").alias("scale"))


def mase(test: DataFrame, train: DataFrame, season: int, group: str = "entity", order: str = "ts") -> DataFrame:
    """One row: mae, scale, mase (null if the scale is next to nothing)."""
    mae = test.agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae")).withColumn("k", F.lit(1))
    scale = seasonal_scale(train, season, group, order).withColumn("k", F.lit(1))
    return mae.join(scale, "k").select("mae", "scale", F.when(F.col("scale") >= TINY, F.col("mae") / F.col("scale")).alias("mase"))


def classification(df: DataFrame) -> DataFrame:
    """One row: accuracy, weighted precision and weighted F1 from the confusion counts of (y, yhat)."""
    c = df.groupBy(F.col("y").cast("string").alias("y"), F.col("yhat").cast("string").alias("yhat")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0))
    true = c.groupBy("y").agg(F.sum("n").alias("support"), hit.alias("tp"))
    said = c.groupBy(F.col("yhat").alias("y")).agg(F.sum("n").alias("predicted"))
    per = true.join(said, "y", "left").withColumn("precision", F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0)))
    recall = F.col("tp") / F.col("support")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * recall, F.col("precision") + recall), F.lit(0.0))
    total = F.sum("support")
    return per.withColumn("f1", f1).agg((F.sum("tp") / total).alias("accuracy"), (F.sum(F.col("precision") * F.col("support")) / total).alias("precision_weighted"), (F.sum(F.col("f1") * F.col("support")) / total).alias("f1_weighted"))


def feedback_errors(df: DataFrame, y: Column, p: Column) -> DataFrame:
    return df.withColumns({"absolute_error": F.abs(y - p), "squared_error": (y - p) * (y - p), "relative_error": F.try_divide(F.abs(y - p), F.when(y != 0, F.abs(y)))})
