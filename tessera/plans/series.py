"""Queries: panels, features, windows, metrics, splits and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import features, metrics, panel as panels, rules, splits
from tessera.plans.catalog import PANEL, panel, query, r, table

Spark = SparkSession


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("string"))


@query(f"SELECT entity, CAST(ts AS VARCHAR) AS ts, y FROM {PANEL} p")
def panel_aggregate(spark: Spark, d: str) -> DataFrame:
    return _day(panel(spark, d))


@query(f"SELECT entity, CAST(ts AS VARCHAR) AS ts, round(s, 4) AS scale, round(y / s, 4) AS y_scaled FROM (SELECT *, greatest(avg(y) OVER (PARTITION BY entity), 0.001) AS s FROM {PANEL} p) t")
def scale_normalize(spark: Spark, d: str) -> DataFrame:
    return _day(panels.scaled(panel(spark, d))).select("entity", "ts", r("scale").alias("scale"), r("y_scaled").alias("y_scaled"))


@query("SELECT l_returnflag AS entity, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ts, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return _day(panels.duplicate_keys(t, "l_returnflag", "day"))


_PARTS = "(SELECT CAST(l_partkey AS VARCHAR) AS entity, CAST(l_shipdate AS DATE) AS ts, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2)"


def _parts(spark: Spark, d: str) -> DataFrame:
    return panels.build(table(spark, d, "lineitem"), "l_partkey", "l_shipdate", "l_quantity")


@query(f"SELECT entity, count(*) AS n FROM {_PARTS} p GROUP BY 1 HAVING count(*) <= 28")
def insufficient_history(spark: Spark, d: str) -> DataFrame:
    return panels.insufficient(_parts(spark, d))


@query(f"SELECT CAST(greatest(gap, 1) AS INTEGER) AS step_days, count(*) AS n_gaps FROM (SELECT date_diff('day', lag(ts) OVER (PARTITION BY entity ORDER BY ts), ts) AS gap FROM {PANEL} p) t WHERE gap IS NOT NULL GROUP BY gap ORDER BY 2 DESC, 1 LIMIT 1")
def infer_cadence(spark: Spark, d: str) -> DataFrame:
    return panels.cadence(panel(spark, d))


@query(f"SELECT entity, CAST(ts AS VARCHAR) AS ts, y FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC) AS n FROM {PANEL} p) t WHERE n <= 58")
def history_tail(spark: Spark, d: str) -> DataFrame:
    return _day(panels.tail(panel(spark, d)))


@query(f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE entity IS NULL) AS null_entities, count(DISTINCT entity) AS n_entities FROM {PANEL} p")
def panel_guard(spark: Spark, d: str) -> DataFrame:
    return panels.guard(panel(spark, d)).select("n_rows", "null_entities", "n_entities")


@query(f"SELECT entity, CAST(ts AS VARCHAR) AS ts, y FROM {PANEL} p ORDER BY entity, ts")
def sorted_panel(spark: Spark, d: str) -> DataFrame:
    return _day(panel(spark, d).orderBy("entity", "ts"))


@query(f"SELECT count(DISTINCT entity) AS n_entities, count(DISTINCT ts) AS n_dates FROM {_PARTS} p")
def entity_count(spark: Spark, d: str) -> DataFrame:
    return _parts(spark, d).agg(F.count_distinct("entity").alias("n_entities"), F.count_distinct("ts").alias("n_dates"))


_CAL = "CAST(year(o_orderdate) AS INTEGER) AS t_year, CAST(month(o_orderdate) AS INTEGER) AS t_month, CAST(day(o_orderdate) AS INTEGER) AS t_day, CAST(isodow(o_orderdate) AS INTEGER) AS t_weekday"


def _orders(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("t"))


@query(f"SELECT o_orderkey, {_CAL}, isodow(o_orderdate) >= 6 AS t_is_weekend FROM orders")
def calendar_features(spark: Spark, d: str) -> DataFrame:
    return features.calendar(_orders(spark, d), "t").drop("t")


@query("SELECT event_id, CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(minute(ts) AS INTEGER) AS ts_minute FROM events")
def calendar_high_res(spark: Spark, d: str) -> DataFrame:
    return features.calendar(table(spark, d, "events").select("event_id", "ts"), "ts", high=True).select("event_id", "ts_hour", "ts_minute")


@query("SELECT o_orderkey, round(sin(month(o_orderdate) * 2 * pi() / 12), 6) + 0 AS ms, round(cos(month(o_orderdate) * 2 * pi() / 12), 6) + 0 AS mc, round(sin(isodow(o_orderdate) * 2 * pi() / 7), 6) + 0 AS ws, round(cos(isodow(o_orderdate) * 2 * pi() / 7), 6) + 0 AS wc FROM orders")
def cyclic_features(spark: Spark, d: str) -> DataFrame:
    f = features.calendar(_orders(spark, d), "t", cyclic=True)
    return f.select("o_orderkey", *[(r(f"t_{a}_{b}", 6) + 0).alias(a[0] + b[0]) for a in ("month", "weekday") for b in ("sin", "cos")])


@query(f"SELECT o_orderkey, {_CAL}, CAST(dayofyear(o_orderdate) AS INTEGER) AS t_day_of_year FROM orders")
def date_expand(spark: Spark, d: str) -> DataFrame:
    return features.expand_date(_orders(spark, d), "t")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount, round(l_quantity * l_tax, 6) AS l_quantity_x_l_tax FROM lineitem")
def interactions(spark: Spark, d: str) -> DataFrame:
    f = features.interactions(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])
    return f.select("l_orderkey", "l_linenumber", r("l_quantity_x_l_discount", 6).alias("l_quantity_x_l_discount"), r("l_quantity_x_l_tax", 6).alias("l_quantity_x_l_tax"))


@query("SELECT c_custkey, c_acctbal, round(ln(k), 6) AS k_log FROM (SELECT c_custkey, c_acctbal, c_custkey + 1.0 AS k FROM customer) t")
def safe_log(spark: Spark, d: str) -> DataFrame:
    f = features.safe_logs(table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") + 1.0).alias("k")), ["c_acctbal", "k"]).drop("k")
    return f.withColumn("k_log", r("k_log", 6))


@query(
    "SELECT o_orderkey, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(year(o_orderdate) AS INTEGER) AS t_year, CAST(month(o_orderdate) AS INTEGER) AS t_month, CAST(day(o_orderdate) AS INTEGER) AS t_day, CAST(isodow(o_orderdate) AS INTEGER) AS t_weekday, round(o_totalprice * size, 2) AS o_totalprice_x_size, round(ln(o_totalprice), 6) AS o_totalprice_log "
    "FROM (SELECT *, CAST(o_custkey % 3 AS INTEGER) AS size FROM orders) t"
)
def engineer_features(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 3).cast("int").alias("size"), F.col("o_orderdate").alias("t"))
    f = features.engineered(t.select("o_totalprice", "size", "t", F.col("o_orderkey").cast("string").alias("key")))
    return f.select(F.col("key").cast("long").alias("o_orderkey"), "o_totalprice", F.to_date("t").cast("string").alias("day"), "t_year", "t_month", "t_day", "t_weekday", r("o_totalprice_x_size", 2).alias("o_totalprice_x_size"), r("o_totalprice_log", 6).alias("o_totalprice_log"))


_W = "(PARTITION BY entity ORDER BY ts)"
_LAGS = ", ".join(f"lag(y, {k}) OVER {_W} AS y_lag_{k}" for k in panels.LAGS)
_ROLL = ", ".join(f"CASE WHEN count(y) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) = {k} THEN avg(y) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END AS y_roll_{k}" for k in panels.WINDOWS)


@query(f"SELECT entity, CAST(ts AS VARCHAR) AS ts, y, {_LAGS} FROM {PANEL} p")
def lag_features(spark: Spark, d: str) -> DataFrame:
    return _day(panels.lagged(panel(spark, d), windows=()))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({f"y_roll_{k}": r(f"y_roll_{k}") for k in panels.WINDOWS})


_ROUND = ", ".join(f"round(y_roll_{k}, 4) AS y_roll_{k}" for k in panels.WINDOWS)


@query(f"SELECT entity, CAST(ts AS VARCHAR) AS ts, y, {_ROUND} FROM (SELECT *, {_ROLL} FROM {PANEL} p) t")
def rolling_features(spark: Spark, d: str) -> DataFrame:
    return _rounded(_day(panels.lagged(panel(spark, d), lags=())))


_SUP = f"SELECT entity, CAST(ts AS VARCHAR) AS ts, y, {', '.join(f'y_lag_{k}' for k in panels.LAGS)}, {_ROUND}, CAST(year(ts) AS INTEGER) AS cal_year, CAST(month(ts) AS INTEGER) AS cal_month, CAST(day(ts) AS INTEGER) AS cal_day, CAST(isodow(ts) AS INTEGER) AS cal_weekday, CAST(dayofyear(ts) AS INTEGER) AS cal_day_of_year FROM (SELECT *, {_LAGS}, {_ROLL} FROM {PANEL} p) t WHERE y_lag_28 IS NOT NULL AND y_roll_28 IS NOT NULL"


@query(_SUP)
def supervised_frame(spark: Spark, d: str) -> DataFrame:
    return _rounded(_day(panels.supervised(panel(spark, d))))


@query("WITH t AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE was IS NOT NULL AND was <> event_type) AS changes, count(*) FILTER (WHERE was IS NOT NULL AND was <> event_type) > count(*) // 2 AS flapping FROM t GROUP BY 1")
def flapping(spark: Spark, d: str) -> DataFrame:
    return rules.flapping(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


_STATES = ("uploaded", "validated", "queued", "running", "completed", "failed", "cancelled")
_CASE = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATES)) + " END"
_OK = ", ".join(f"('{a}', '{b}')" for a, to in rules.TRANSITIONS.items() for b in to)


def _history(spark: Spark, d: str) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("ts").alias("updated_at"), state.alias("status"), (F.col("event_id") % 101).alias("progress"))


@query(f"WITH t AS (SELECT user_id AS job, event_id AS seq, {_CASE} AS status, lag({_CASE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT job, seq, was, status FROM t WHERE was IS NOT NULL AND was <> status AND (was, status) NOT IN ({_OK})")
def illegal_transitions(spark: Spark, d: str) -> DataFrame:
    return rules.illegal_transitions(_history(spark, d), "job", "status", ["updated_at", "seq"]).select("job", "seq", "was", "status")


@query(f"SELECT job, status, progress FROM (SELECT user_id AS job, {_CASE} AS status, event_id % 101 AS progress, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) t WHERE n = 1")
def job_status(spark: Spark, d: str) -> DataFrame:
    from tessera.operators import registry

    return registry.job_status(_history(spark, d)).select("job", "status", "progress")


_PAIR = "(SELECT l_returnflag AS g, l_extendedprice AS y, p_retailprice * l_quantity AS p FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _pairs(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return t.select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("y"), (F.col("p_retailprice") * F.col("l_quantity")).alias("yhat"))


@query(
    "SELECT g, count(*) AS n, round(avg(abs(y - p)), 2) AS mae, round(sqrt(avg((y - p) * (y - p))), 2) AS rmse, round(median(abs(y - p)), 2) AS median_ae, round(max(abs(y - p)), 2) AS max_error, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS r2, "
    "round(1 - (sum((y - p) * (y - p)) / (var_pop(y) * count(*))) * (count(*) - 1) / (count(*) - 4), 4) AS adjusted_r2, round(1 - var_pop(y - p) / var_pop(y), 4) AS explained_variance, round(avg(pow(ln(1 + y) - ln(1 + p), 2)), 4) AS msle "
    f"FROM {_PAIR} t GROUP BY 1"
)
def regression_metrics(spark: Spark, d: str) -> DataFrame:
    m = metrics.regression(_pairs(spark, d), ["g"], n_features=3)
    return m.select("g", "n", *[r(c, 2).alias(c) for c in ("mae", "rmse", "median_ae", "max_error")], *[r(c).alias(c) for c in ("r2", "adjusted_r2", "explained_variance", "msle")])


@query(f"SELECT g, round(100 * avg(abs((y - p) / y)) FILTER (WHERE abs(y) > 1e-9), 4) AS mape, count(*) FILTER (WHERE abs(y) <= 1e-9) AS n_excluded FROM {_PAIR} t GROUP BY 1")
def mape(spark: Spark, d: str) -> DataFrame:
    return metrics.regression(_pairs(spark, d), ["g"]).select("g", r("mape").alias("mape"), "n_excluded")


_NAIVE = f"(SELECT entity, ts, y, lag(y, 7) OVER (PARTITION BY entity ORDER BY ts) AS p FROM {PANEL} q)"


def _naive(spark: Spark, d: str) -> DataFrame:
    w = Window.partitionBy("entity").orderBy("ts")
    return panel(spark, d).withColumn("yhat", F.lag("y", 7).over(w)).where("yhat IS NOT NULL")


@query(f"SELECT entity, count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(200 * avg(abs(y - p) / (abs(y) + abs(p))), 4) AS smape, round(100 * sum(abs(y - p)) / sum(abs(y)), 4) AS wape, round(sum(y - p) / (sum(y) + 1e-9), 6) AS bias FROM {_NAIVE} t WHERE p IS NOT NULL GROUP BY 1")
def forecast_metrics(spark: Spark, d: str) -> DataFrame:
    m = metrics.forecast(_naive(spark, d), ["entity"])
    return m.select("entity", "n", r("mae").alias("mae"), r("smape").alias("smape"), r("wape").alias("wape"), r("bias", 6).alias("bias"))


@query(f"SELECT entity, round(100 * sum(abs(y - p)) / sum(abs(y)), 4) AS wape FROM {_NAIVE} t WHERE p IS NOT NULL GROUP BY 1")
def wape_by_entity(spark: Spark, d: str) -> DataFrame:
    return metrics.forecast(_naive(spark, d), ["entity"]).select("entity", r("wape").alias("wape"))


@query(f"WITH t AS (SELECT *, date_diff('day', CAST(date_trunc('month', ts) AS DATE), ts) + 1 AS ahead FROM {_NAIVE} n WHERE p IS NOT NULL) SELECT CAST(ahead AS INTEGER) AS ahead, round(avg(abs(y - p)), 4) AS mae, round(100 * sum(abs(y - p)) / sum(abs(y)), 4) AS wape FROM t GROUP BY 1")
def error_by_horizon(spark: Spark, d: str) -> DataFrame:
    """Each month is a forecast from its first day on."""
    t = _naive(spark, d).withColumn("ahead", F.datediff("ts", F.trunc("ts", "month")) + 1)
    return metrics.forecast(t, ["ahead"]).select("ahead", r("mae").alias("mae"), r("wape").alias("wape"))


@query(f"WITH s AS (SELECT avg(abs(y - p)) AS scale FROM {_NAIVE} t WHERE ts < DATE '1998-01-01'), e AS (SELECT avg(abs(y - p)) AS mae FROM {_NAIVE} t WHERE ts >= DATE '1998-01-01') SELECT round(mae, 4) AS mae, round(scale, 4) AS scale, round(mae / scale, 6) AS mase FROM s, e")
def mase(spark: Spark, d: str) -> DataFrame:
    cut = F.lit("1998-01-01").cast("date")
    m = metrics.mase(_naive(spark, d).where(F.col("ts") >= cut), panel(spark, d).where(F.col("ts") < cut), 7)
    return m.select(r("mae").alias("mae"), r("scale").alias("scale"), r("mase", 6).alias("mase"))


@query(
    "WITH t AS (SELECT CAST(quality AS VARCHAR) AS y, CAST(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS VARCHAR) AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT y AS k, count(*) AS support, count(*) FILTER (WHERE p = y) AS tp FROM t GROUP BY y), s AS (SELECT p AS k, count(*) AS said FROM t GROUP BY p), "
    "m AS (SELECT support, tp, coalesce(tp / said, 0) AS pr, tp / support AS re FROM c LEFT JOIN s USING (k)) SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision_weighted, round(sum(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END * support) / sum(support), 6) AS f1_weighted FROM m"
)
def classification_metrics(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("yhat"))
    m = metrics.classification(t)
    return m.select(*[r(c, 6).alias(c) for c in m.columns])


@query("SELECT l_orderkey, l_linenumber, round(abs(l_extendedprice - l_quantity * 1000), 4) AS absolute_error, round(pow(l_extendedprice - l_quantity * 1000, 2), 2) AS squared_error, round(abs(l_extendedprice - l_quantity * 1000) / nullif(abs(l_extendedprice), 0), 6) AS relative_error FROM lineitem")
def feedback_errors(spark: Spark, d: str) -> DataFrame:
    f = metrics.feedback_errors(table(spark, d, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity") * 1000)
    return f.select("l_orderkey", "l_linenumber", r("absolute_error").alias("absolute_error"), r("squared_error", 2).alias("squared_error"), r("relative_error", 6).alias("relative_error"))


@query(f"SELECT entity, round(avg(abs(y - p)) / (SELECT avg(abs(y - p)) FROM {_NAIVE} t), 6) AS mase FROM {_NAIVE} u WHERE p IS NOT NULL GROUP BY 1 HAVING avg(abs(y - p)) / (SELECT avg(abs(y - p)) FROM {_NAIVE} t) <= 1.0")
def promotion_candidates(spark: Spark, d: str) -> DataFrame:
    per = metrics.forecast(_naive(spark, d), ["entity"]).select("entity", "mae")
    scale = metrics.seasonal_scale(panel(spark, d), 7).select("scale", F.lit(1).alias("k"))
    return per.withColumn("k", F.lit(1)).join(scale, "k").withColumn("mase", F.col("mae") / F.col("scale")).where("mase <= 1.0").select("entity", r("mase", 6).alias("mase"))


@query(f"SELECT entity, CAST(ts AS VARCHAR) AS ts, y, CASE WHEN ts > (SELECT DISTINCT ts FROM {PANEL} q ORDER BY ts DESC LIMIT 1 OFFSET 30) THEN 'test' ELSE 'train' END AS role FROM {PANEL} p")
def temporal_split(spark: Spark, d: str) -> DataFrame:
    return _day(splits.temporal_split(panel(spark, d), 30))


_ONE = "(SELECT CAST(l_shipdate AS DATE) AS ts, sum(l_quantity) AS y FROM lineitem GROUP BY 1)"


def _one(spark: Spark, d: str) -> DataFrame:
    return panel(spark, d).groupBy("ts").agg(F.sum("y").alias("y"))


@query(f"SELECT CAST(ts AS VARCHAR) AS ts, y, CASE WHEN row_number() OVER (ORDER BY ts DESC) <= 20 THEN 'test' ELSE 'train' END AS role FROM {_ONE} t")
def row_split(spark: Spark, d: str) -> DataFrame:
    return _day(splits.row_split(_one(spark, d), 20))


@query(
    "WITH n AS (SELECT count(*) AS n FROM orders), t AS (SELECT o_orderkey, o_orderstatus, CAST('0x' || substr(md5('42:' || o_orderkey), 1, 15) AS BIGINT) AS h, CASE WHEN n < 500 THEN 0.15 ELSE 0.2 END AS ratio, greatest(1, n // 100000) AS bins FROM orders, n), "
    "w AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, h % bins ORDER BY h, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus, h % bins) AS m FROM t) "
    "SELECT o_orderkey, o_orderstatus, CASE WHEN k <= round(m * ratio) THEN 'test' ELSE 'train' END AS role FROM w"
)
def stratified_split(spark: Spark, d: str) -> DataFrame:
    return splits.random_split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


def _folds_sql(source: str, cols: str, sliding: bool, is_panel: bool, step: int = 100) -> str:
    end = "cut + 30" + ("" if is_panel else " - 1")
    last = "n - 1 - 30" if is_panel else "n - 30"
    first = "cut - 2000" if sliding else "0"
    return (
        f"WITH d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM {source} s) u), "
        f"f AS (SELECT CAST((cut - 2000) // {step} AS INTEGER) AS fold, cut, {first} AS first, {end} AS last FROM (SELECT unnest(range(2000, (SELECT max({last}) + 1 FROM d), {step})) AS cut) c) "
        f"SELECT {cols}, CAST(s.ts AS VARCHAR) AS ts, y, fold, CASE WHEN i >= cut THEN 'test' ELSE 'train' END AS role FROM f JOIN d ON i BETWEEN first AND last JOIN {source} s ON s.ts = d.ts"
    )


@query(_folds_sql(PANEL, "entity", False, True))
def folds_expanding_panel(spark: Spark, d: str) -> DataFrame:
    return _day(splits.folds(panel(spark, d), 2000, 30, 100))


@query(_folds_sql(PANEL, "entity", True, True))
def folds_sliding_panel(spark: Spark, d: str) -> DataFrame:
    return _day(splits.folds(panel(spark, d), 2000, 30, 100, sliding=True))


@query(_folds_sql(_ONE, "1 AS one", False, False))
def folds_expanding_rows(spark: Spark, d: str) -> DataFrame:
    return _day(splits.folds(_one(spark, d), 2000, 30, 100, panel=False)).withColumn("one", F.lit(1))


@query(_folds_sql(_ONE, "1 AS one", True, False))
def folds_sliding_rows(spark: Spark, d: str) -> DataFrame:
    return _day(splits.folds(_one(spark, d), 2000, 30, 100, sliding=True, panel=False)).withColumn("one", F.lit(1))


def _seasonal(train, test):
    """The last value of the same weekday."""
    last = train.set_index("ts").y.iloc[-7:].tolist()
    return [last[k % len(last)] for k in range(len(test))]


_BT = _folds_sql(PANEL, "entity", False, True)
_BT_SQL = (
    f"WITH folds AS ({_BT}), l AS (SELECT fold, entity, y, row_number() OVER (PARTITION BY fold, entity ORDER BY ts DESC) AS back FROM folds WHERE role = 'train'), t AS (SELECT fold, entity, y, row_number() OVER (PARTITION BY fold, entity ORDER BY ts) - 1 AS k FROM folds WHERE role = 'test'), "
    "m AS (SELECT t.fold, avg(abs(t.y - l.y)) AS mae, sqrt(avg(pow(t.y - l.y, 2))) AS rmse FROM t JOIN l ON t.fold = l.fold AND t.entity = l.entity AND l.back = 7 - t.k % 7 GROUP BY 1) SELECT count(*) AS n_folds, round(avg(mae), 4) AS mae, round(avg(rmse), 4) AS rmse, round(stddev_pop(mae), 4) AS mae_std FROM m"
)


@query(_BT_SQL)
def backtest_naive(spark: Spark, d: str) -> DataFrame:
    s = splits.summary(splits.backtest(splits.folds(panel(spark, d), 2000, 30, 100), _seasonal))
    return s.select("n_folds", *[r(c).alias(c) for c in ("mae", "rmse", "mae_std")])


def _mean_mae(sliding: bool) -> str:
    return f"(WITH folds AS ({_folds_sql(PANEL, 'entity', sliding, True, 200)}), t AS (SELECT fold, entity, avg(y) AS yhat FROM folds WHERE role = 'train' GROUP BY 1, 2), m AS (SELECT f.fold, avg(abs(f.y - t.yhat)) AS mae FROM folds f JOIN t ON f.fold = t.fold AND f.entity = t.entity WHERE role = 'test' GROUP BY 1) SELECT avg(mae) FROM m)"


@query(f"WITH x AS (SELECT {_mean_mae(False)} AS a, {_mean_mae(True)} AS b) SELECT round(a, 4) AS mae_expanding, round(b, 4) AS mae_sliding, round((a - b) / a, 6) AS gap, (a - b) / a > 0.15 AS drift, CASE WHEN b < a THEN 'sliding' ELSE 'expanding' END AS winner FROM x")
def regime_change(spark: Spark, d: str) -> DataFrame:
    def mean(train, test):
        return train.y.mean()

    both = [splits.summary(splits.backtest(splits.folds(panel(spark, d), 2000, 30, 200, sliding=s), mean)) for s in (False, True)]
    return splits.regime_change(*both).withColumns({"mae_expanding": r("mae_expanding"), "mae_sliding": r("mae_sliding"), "gap": r("gap", 6)})


@query(f"SELECT entity, CAST(CAST(mx + CAST(step AS INTEGER) * 1 AS DATE) AS VARCHAR) AS ts, CAST(step AS INTEGER) AS step FROM (SELECT entity, max(ts) AS mx FROM {PANEL} p GROUP BY 1) t, (SELECT unnest(range(1, 15)) AS step) s")
def future_frame(spark: Spark, d: str) -> DataFrame:
    return _day(panels.future(panel(spark, d), 14))
