"""Queries: streams over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import drift
from tessera.plans.catalog import query, r
from tessera.sources.files import workspace
from tessera.streaming import monitor

Spark = SparkSession


@query("WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events) SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type AS model, count(*) AS n, round(avg(value), 4) AS avg_latency FROM events, m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2")
def stream_hourly(spark: Spark, d: str) -> DataFrame:
    w = workspace(spark)
    h = monitor.drained(monitor.hourly(monitor.source(spark, f"{d}/events.parquet"), "event_type", "value"), f"{w}/out", f"{w}/state")
    return h.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "model", "n", r("avg_latency").alias("avg_latency"))


@query("SELECT event_type AS model, count(*) AS n, round(avg(abs(value - 10)), 4) AS mae, round(avg((value - 10) * (value - 10)), 4) AS mse FROM events GROUP BY 1")
def stream_feedback(spark: Spark, d: str) -> DataFrame:
    w = workspace(spark)
    s = monitor.source(spark, f"{d}/events.parquet").withColumn("ten", F.lit(10.0))
    f = monitor.drained(monitor.feedback(s, "event_id", "event_type", "value", "ten"), f"{w}/out", f"{w}/state", "update")
    last = f.groupBy("model").agg(F.max(F.struct("batch", "n", "mae", "mse")).alias("b"))
    return last.select("model", "b.n", r("b.mae").alias("mae"), r("b.mse").alias("mse"))


@query()
def stream_drift(spark: Spark, d: str) -> DataFrame:
    w = workspace(spark)
    reference = spark.read.parquet(f"{d}/events.parquet").where("event_id % 2 = 0")
    start = monitor.drift_of_batches(monitor.source(spark, f"{d}/events.parquet"), reference, ["value"], f"{w}/out")
    start(f"{w}/state").awaitTermination()
    return spark.read.parquet(f"{w}/out").select("feature", "ks", "p_value", "drifted", "batch")


_EDGES = [5.0 * k for k in range(1, 40)]


@query(
    "WITH c AS (SELECT CAST(least(39, greatest(0, ceil(value / 5) - 1)) AS INTEGER) AS bin, count(*) FILTER (WHERE event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_id % 3 = 0) AS b FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY 1), "
    "n AS (SELECT sum(a) AS n, sum(b) AS m FROM c), f AS (SELECT greatest(a / n, 1e-10) AS p, greatest(b / m, 1e-10) AS q, abs(sum(a) OVER (ORDER BY bin) / n - sum(b) OVER (ORDER BY bin) / m) AS off, n, m FROM c, n WHERE a + b > 0) "
    "SELECT 'value' AS feature, CAST(max(n) AS BIGINT) AS n_ref, CAST(max(m) AS BIGINT) AS n_cur, round(max(off), 6) AS ks, round(sum((p - q) * ln(p / q)), 6) AS psi FROM f"
)
def stream_drift_so_far(spark: Spark, d: str) -> DataFrame:
    """The drift of a stream from a reference counted once, after its last batch."""
    w = workspace(spark)
    events = spark.read.parquet(f"{d}/events.parquet")
    reference = drift.counted_reference(events.where("event_id % 2 = 0"), ["value"], edges={"value": _EDGES})
    monitor.drift_so_far(monitor.source(spark, f"{d}/events.parquet").where("event_id % 3 = 0"), reference, f"{w}/out")(f"{w}/state").awaitTermination()
    last = spark.read.parquet(f"{w}/out")
    return last.where(F.col("batch") == last.agg(F.max("batch")).first()[0]).select("feature", "n_ref", "n_cur", r("ks", 6).alias("ks"), r("psi", 6).alias("psi"))
