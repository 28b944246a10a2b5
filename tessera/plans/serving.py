"""Queries: registry, batch forecasts, monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import registry as reg
from tessera.plans.catalog import REGISTRY, query, r, registry, table

Spark = SparkSession


@query(f"SELECT model, CAST(max(version) + 1 AS BIGINT) AS next_version FROM {REGISTRY} r GROUP BY 1 UNION ALL SELECT 'new', 1")
def next_version(spark: Spark, d: str) -> DataFrame:
    g = registry(spark, d)
    return reg.next_versions(g, g.select("model").union(g.select(F.lit("new").alias("model")).limit(1)))


@query(f"SELECT model, version, CASE WHEN model = '1-URGENT' AND version = 3 THEN 'production' WHEN model = '1-URGENT' AND stage = 'production' THEN 'archived' ELSE stage END AS stage, metric FROM {REGISTRY} r UNION ALL SELECT model, CAST(max(version) + 1 AS BIGINT), 'staging', 0.5 FROM {REGISTRY} q GROUP BY 1")
def register_promote(spark: Spark, d: str) -> DataFrame:
    g = registry(spark, d)
    rows = g.select("model").distinct().withColumns({"version": F.lit(0).cast("long"), "stage": F.lit(""), "metric": F.lit(0.5)})
    return reg.promote(reg.register(g, rows), "1-URGENT", 3, "production")


@query(f"SELECT model, version, stage, metric FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY version DESC) AS n FROM {REGISTRY} r WHERE stage = 'production') t WHERE n = 1")
def resolve_model(spark: Spark, d: str) -> DataFrame:
    return reg.resolve(registry(spark, d), stage="production")


@query(f"SELECT model, version, stage, metric FROM {REGISTRY} r WHERE model = '2-HIGH' AND stage = 'staging' ORDER BY version DESC")
def list_versions(spark: Spark, d: str) -> DataFrame:
    return reg.list_versions(registry(spark, d), "2-HIGH", "staging")


@query(f"SELECT DISTINCT substr(model, 3) AS product FROM {REGISTRY} r WHERE stage = 'production' AND model LIKE '1-%'")
def list_product_models(spark: Spark, d: str) -> DataFrame:
    return reg.products(registry(spark, d), "1-")


@query("SELECT CASE WHEN c_custkey % 10 IN (SELECT s_suppkey % 10 FROM supplier WHERE s_acctbal > 8000) THEN 'succeeded' ELSE 'failed' END AS status, count(*) AS n FROM customer GROUP BY 1")
def batch_forecast_status(spark: Spark, d: str) -> DataFrame:
    have = table(spark, d, "supplier").where("s_acctbal > 8000").select((F.col("s_suppkey") % 10).alias("k")).distinct()
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("product"), (F.col("c_custkey") % 10).alias("k"))
    return reg.batch_status(ids, ids.join(have, "k", "left_semi"))


@query(
    "WITH p AS (SELECT user_id AS product, count(*) AS n, count(*) FILTER (WHERE event_id % 97 = 0) AS nulls, count(DISTINCT CAST(ts AS DATE)) AS dates FROM events GROUP BY 1) SELECT product, 'row_count' AS violation FROM p WHERE n <> 20 UNION ALL SELECT product, 'null_forecast' FROM p WHERE nulls > 0 UNION ALL SELECT product, 'repeated_date' FROM p WHERE dates < n"
)
def forecast_checks(spark: Spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("product"), F.to_date("ts").alias("ds"), F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("yhat"))
    return reg.forecast_checks(e, 20)


@query("SELECT event_id, event_type, round(value, 2) AS value FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def paged_listing(spark: Spark, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'click'")
    return reg.page(e, [F.desc("ts"), F.desc("event_id")], 20, 40).select("event_id", "event_type", r("value", 2).alias("value"))


@query(
    "WITH t AS (SELECT user_id AS batch, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'cached' ELSE 'success' END AS s FROM events), g AS (SELECT batch, count(*) AS total, count(*) FILTER (WHERE s <> 'failed') AS succeeded, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'cached') AS cached FROM t GROUP BY 1) "
    "SELECT *, CASE WHEN failed = 0 THEN 'SUCCESS' WHEN succeeded = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS result FROM g"
)
def batch_summary(spark: Spark, d: str) -> DataFrame:
    s = F.when(F.col("event_id") % 5 == 0, "failed").when(F.col("event_id") % 3 == 0, "cached").otherwise("success")
    return reg.batch_summary(table(spark, d, "events").select(F.col("user_id").alias("batch"), s.alias("status")))


def _audit(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("model"), "ts", F.col("value").alias("latency"), "user_id")


@query("SELECT count(*) AS total FROM events")
def mon_total(spark: Spark, d: str) -> DataFrame:
    return _audit(spark, d).agg(F.count(F.lit(1)).alias("total"))


@query("SELECT round(avg(value), 2) AS avg_latency FROM events")
def mon_avg_latency(spark: Spark, d: str) -> DataFrame:
    return _audit(spark, d).agg(F.round(F.avg("latency"), 2).alias("avg_latency"))


@query("SELECT count(DISTINCT event_type) AS n_models FROM events")
def mon_models(spark: Spark, d: str) -> DataFrame:
    return _audit(spark, d).agg(F.count_distinct("model").alias("n_models"))


_HOURLY = "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, {} FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1"


def _hourly(spark: Spark, d: str) -> DataFrame:
    a = _audit(spark, d)
    return reg.hourly(a, a.agg(F.max("ts")).first()[0]).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query(_HOURLY.format("count(*) AS n"))
def mon_hourly(spark: Spark, d: str) -> DataFrame:
    return _hourly(spark, d).select("hour", "n")


@query(_HOURLY.format("round(avg(value), 4) AS avg_latency"))
def mon_hourly_latency(spark: Spark, d: str) -> DataFrame:
    return _hourly(spark, d).select("hour", r("avg_latency").alias("avg_latency"))


@query("SELECT user_id AS model, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def mon_top_models(spark: Spark, d: str) -> DataFrame:
    return _audit(spark, d).groupBy(F.col("user_id").alias("model")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "model").limit(10)


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS model, round(avg(abs(value - 10)), 4) AS mae FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1, 2")
def mon_mae_time(spark: Spark, d: str) -> DataFrame:
    a = _audit(spark, d)
    recent = a.where(F.col("ts") > F.lit(a.agg(F.max("ts")).first()[0]) - F.make_dt_interval(F.lit(30)))
    return recent.groupBy(F.to_date("ts").cast("string").alias("day"), "model").agg(r(F.avg(F.abs(F.col("latency") - 10))).alias("mae"))


@query("SELECT user_id AS model, round(avg(200 * abs(value - 10) / nullif(abs(value) + 10, 0)), 4) AS smape FROM events GROUP BY 1 ORDER BY avg(200 * abs(value - 10) / nullif(abs(value) + 10, 0)), 1 LIMIT 10")
def mon_smape(spark: Spark, d: str) -> DataFrame:
    s = F.avg(F.try_divide(200 * F.abs(F.col("latency") - 10), F.abs("latency") + 10))
    return _audit(spark, d).groupBy(F.col("user_id").alias("model")).agg(s.alias("s")).orderBy("s", "model").limit(10).select("model", r("s").alias("smape"))


@query("SELECT event_id AS id, event_type AS model FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def mon_recent(spark: Spark, d: str) -> DataFrame:
    return reg.page(_audit(spark, d), [F.desc("ts"), F.desc("id")], 50).select("id", "model")
