"""Model registry and monitoring queries over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_versions(registry: DataFrame, models: DataFrame) -> DataFrame:
    """(model, next_version) for each asked model, 1 for a new one."""
    have = registry.groupBy("model").agg(F.max("version").alias("v"))
    return models.select("model").distinct().join(have, "model", "left").select("model", (F.coalesce("v", F.lit(0)) + 1).alias("next_version"))


def register(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """registry with rows (model, ...) as new versions in stage `staging`."""
    new = rows.join(next_versions(registry, rows), "model").withColumns({"version": F.col("next_version"), "stage": F.lit("staging")}).drop("next_version")
    return registry.unionByName(new.select(registry.columns))


def promote(registry: DataFrame, model: str, version: int, stage: str) -> DataFrame:
    """The version gets the stage; what had it before is archived."""
    mine = F.col("model") == model
    return registry.withColumn("stage", F.when(mine & (F.col("version") == version), stage).when(mine & (F.col("stage") == stage), "archived").otherwise(F.col("stage")))


def resolve(registry: DataFrame, stage: str | None = None, version: int | None = None) -> DataFrame:
    """For each model the row of that version, or the latest in the stage, or the latest."""
    rows = registry.where(F.col("version") == version) if version is not None else registry.where(F.col("stage") == stage) if stage else registry
    others = [c for c in registry.columns if c not in ("model", "version")]
    best = rows.groupBy("model").agg(F.max(F.struct("version", *others)).alias("b"))
    return best.select("model", "b.*").select(registry.columns)


def list_versions(registry: DataFrame, model: str, stage: str | None = None) -> DataFrame:
    rows = registry.where(F.col("model") == model)
    return (rows.where(F.col("stage") == stage) if stage else rows).orderBy(F.desc("version"))


def products(registry: DataFrame, prefix: str, stage: str = "production") -> DataFrame:
    """Names of products that have a model in the stage: model names without the prefix."""
    return registry.where((F.col("stage") == stage) & F.startswith("model", F.lit(prefix))).select(F.substring("model", len(prefix) + 1, 1_000).alias("product")).distinct()


def batch_status(ids: DataFrame, have: DataFrame) -> DataFrame:
    """(status, n): products with a model succeed, the others become failed rows."""
    joined = ids.select("product").distinct().join(have.select("product").distinct().withColumn("ok", F.lit(True)), "product", "left")
    return joined.groupBy(F.when(F.col("ok"), "succeeded").otherwise("failed").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def forecast_checks(rows: DataFrame, periods: int) -> DataFrame:
    """(product, violation): wrong number of rows, null forecasts, repeated dates."""
    per = rows.groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("yhat").isNull()).alias("nulls"), F.count_distinct("ds").alias("dates"))
    bad = F.array_compact(F.array(F.when(F.col("n") != periods, "row_count"), F.when(F.col("nulls") > 0, "null_forecast"), F.when(F.col("dates") < F.col("n"), "repeated_date")))
    return per.select("product", F.explode(bad).alias("violation"))


def batch_summary(items: DataFrame, batch: str = "batch", status: str = "status") -> DataFrame:
    ok, cached, failed = (F.count_if(F.col(status) == s) for s in ("success", "cached", "failed"))
    per = items.groupBy(batch).agg(F.count(F.lit(1)).alias("total"), (ok + cached).alias("succeeded"), failed.alias("failed"), cached.alias("cached"))
    return per.withColumn("result", F.when(F.col("failed") == 0, "SUCCESS").when(F.col("succeeded") == 0, "FAILED").otherwise("PARTIAL"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def hourly(audit: DataFrame, as_of, days: int = 7) -> DataFrame:
    """(hour, n, avg_latency) of the days before as_of."""
    recent = audit.where((F.col("ts") > F.lit(as_of) - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= F.lit(as_of)))
    return recent.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg("latency").alias("avg_latency"))


def job_status(history: DataFrame) -> DataFrame:
    """(job, status, progress, updated_at): the latest state of each job."""
    b = history.groupBy("job").agg(F.max(F.struct("updated_at", "seq", "status", "progress")).alias("b"))
    return b.select("job", "b.status", "b.progress", "b.updated_at")
