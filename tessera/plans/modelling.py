"""Queries: models, attribution, batch forecasts and whole pipelines. SQL can't express them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import block_trees, boosting, clean, drift, metrics, models, panel as panels, panel_boosting, pipelines, profile, registry as reg, rules, splits
from tessera.plans.catalog import panel, query, registry, table
from tessera.sources import files

Spark = SparkSession
FEATURES, TEXTS = ["l_quantity", "l_discount", "l_tax", "p_size"], ["l_returnflag"]


def _rows(spark: Spark, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return t.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("key"), "l_quantity", "l_discount", "l_tax", "p_size", "l_returnflag", "l_linestatus", "l_extendedprice")


def _model(spark: Spark, d: str) -> PipelineModel:
    return models.boosted(_rows(spark, d), "l_extendedprice", FEATURES, TEXTS)


@query()
def gbt_regression(spark: Spark, d: str) -> DataFrame:
    t = splits.random_split(_rows(spark, d), "key")
    m = models.boosted(t.where("role = 'train'"), "l_extendedprice", FEATURES, TEXTS)
    return metrics.regression(m.transform(t.where("role = 'test'")).select(F.col("l_extendedprice").alias("y"), F.col("prediction").alias("yhat")))


@query()
def gbt_classification(spark: Spark, d: str) -> DataFrame:
    t = splits.random_split(_rows(spark, d), "key", "l_linestatus")
    m = block_trees.fit(t.where("role = 'train'"), "l_linestatus", ["l_extendedprice", *FEATURES], TEXTS, kind="classification")
    return metrics.classification(m.predict(t.where("role = 'test'")).select(F.col("__label").alias("y"), F.col("prediction").alias("yhat")))


@query()
def gain_importance(spark: Spark, d: str) -> DataFrame:
    return models.gain_importance(_model(spark, d), [*FEATURES, *TEXTS])


@query()
def model_roundtrip(spark: Spark, d: str) -> DataFrame:
    m = _model(spark, d)
    again = models.save_and_load(m)
    features = [*FEATURES, *TEXTS]
    t = _rows(spark, d).groupBy(*features).agg(F.count(F.lit(1)).alias("n"))  # rows with equal features have one prediction
    both = again.transform(m.transform(t).select(*features, "n", F.col("prediction").alias("before")))
    return both.agg(F.sum("n").alias("n"), F.max(F.abs(F.col("before") - F.col("prediction"))).alias("most"))


@query()
def batch_score(spark: Spark, d: str) -> DataFrame:
    t = _rows(spark, d)
    p = clean.Processor(target="l_extendedprice", protected=["key"]).fit(t)
    m = models.boosted(p.transform(t), "l_extendedprice", FEATURES, TEXTS)
    return m.transform(p.transform(t)).select("key", "prediction")


@query()
def shap_values(spark: Spark, d: str) -> DataFrame:
    return models.shap_values(_rows(spark, d), _model(spark, d), "key", [*FEATURES, *TEXTS])


@query()
def shap_importance(spark: Spark, d: str) -> DataFrame:
    return models.importance(_rows(spark, d), _model(spark, d), "key", [*FEATURES, *TEXTS])


@query()
def panel_forecast_fit(spark: Spark, d: str) -> DataFrame:
    p = splits.temporal_split(panel(spark, d), 30)
    m = models.fit_panel(p.where("role = 'train'").drop("role"))
    test = models.panel_frame(panel(spark, d)).join(p.where("role = 'test'").select("entity", "ts"), ["entity", "ts"])
    return metrics.forecast(m.transform(test).select("entity", "y", (F.col("prediction") * F.col("scale")).alias("yhat")), ["entity"])


@query()
def panel_forecast(spark: Spark, d: str) -> DataFrame:
    p = panel(spark, d)
    return models.forecast_panel(models.fit_panel(p), p, 14)


@query("SELECT l_suppkey AS entity, CAST(7 AS BIGINT) AS n_steps, TRUE AS finite FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT CAST(l_shipdate AS DATE)) > 28")
def panel_forecast_suppliers(spark: Spark, d: str) -> DataFrame:
    """Forecasts for each supplier with more than four weeks of lines: as many entities as there are, none of them a category."""
    p = panels.build(table(spark, d, "lineitem"), "l_suppkey", "l_shipdate", "l_quantity")
    p = files.roundtrip(p.join(p.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 28").select("entity"), "entity"), "parquet")
    f = panel_boosting.fit_on_blocks(p).forecast(p, 7)
    return f.groupBy(F.col("entity").cast("long").alias("entity")).agg(F.count(F.lit(1)).alias("n_steps"), F.every(F.col("yhat").isNotNull() & ~F.isnan("yhat")).alias("finite"))


@query()
def regularised_boosting(spark: Spark, d: str) -> DataFrame:
    """Errors on held-back rows of boosting with penalties and samples of rows and columns."""
    t = splits.random_split(_rows(spark, d), "key")
    m = boosting.fit(t.where("role = 'train'"), "l_extendedprice", FEATURES, TEXTS, rounds=8, rate=0.4)
    return metrics.regression(m.predict(t.where("role = 'test'")).select(F.col("l_extendedprice").alias("y"), F.col("prediction").alias("yhat")))


@query()
def softmax_boosting(spark: Spark, d: str) -> DataFrame:
    """Three classes in one softmax: the prediction of each held-back row with the probabilities of all classes."""
    t = splits.random_split(_rows(spark, d), "key", "l_returnflag")
    m = boosting.fit(t.where("role = 'train'"), "l_returnflag", ["l_extendedprice", *FEATURES], ["l_linestatus"], kind="classification", rounds=4, rate=0.4)
    return m.predict(t.where("role = 'test'")).select("key", F.col("l_returnflag").alias("y"), F.col("prediction").alias("yhat"), *[F.get("probabilities", F.lit(k)).alias(f"p_{k}") for k in range(3)])


@query(
    "WITH t AS (SELECT l_extendedprice AS y, l_quantity AS q, l_linenumber AS k FROM lineitem), m AS (SELECT avg(y) AS b FROM t), "
    "c AS (SELECT 0 AS f, 'l_quantity' AS feature, CAST(q AS DOUBLE) AS v, sum(b - y) AS g, count(*) AS n FROM t, m GROUP BY q UNION ALL SELECT 1, 'l_linenumber', CAST(k AS DOUBLE), sum(b - y), count(*) FROM t, m GROUP BY k), "
    "l AS (SELECT f, feature, v, sum(g) OVER (PARTITION BY f ORDER BY v) AS gl, sum(n) OVER (PARTITION BY f ORDER BY v) AS nl, sum(g) OVER (PARTITION BY f) AS g, sum(n) OVER (PARTITION BY f) AS n FROM c), "
    "s AS (SELECT *, 0.5 * (gl * gl / (nl + 1) + (g - gl) * (g - gl) / (n - nl + 1) - g * g / (n + 1)) AS gain FROM l WHERE nl < n) "
    "SELECT feature, v AS threshold, round(ln(gain), 6) AS log_gain, round(-gl / (nl + 1), 4) AS weight_left, round(-(g - gl) / (n - nl + 1), 4) AS weight_right FROM s ORDER BY gain DESC, f, v LIMIT 1"
)
def boosting_step(spark: Spark, d: str) -> DataFrame:
    """The split, gain and weights of one step of depth 1."""
    m = boosting.fit(table(spark, d, "lineitem").select("l_extendedprice", "l_quantity", "l_linenumber"), "l_extendedprice", ["l_quantity", "l_linenumber"], rounds=1, depth=1, rate=1.0, rows=1.0, columns=1.0)
    t = m.rounds[0][0]
    out = [(m.names[t.feature[0]], float(m.edges[t.feature[0]][t.bin[0]]), float(t.gain[0]), t.weight[1], t.weight[2])]
    return spark.createDataFrame(out, "feature string, threshold double, gain double, l double, r double").select("feature", "threshold", F.round(F.log("gain"), 6).alias("log_gain"), F.round("l", 4).alias("weight_left"), F.round("r", 4).alias("weight_right"))


@query()
def model_levers(spark: Spark, d: str) -> DataFrame:
    """The quantity between 1 and 50 at which a fitted model's price comes nearest to each line's price and a tenth."""
    t, m = _rows(spark, d), _model(spark, d)
    found = models.lever_search(t, m, [*FEATURES, *TEXTS], "l_quantity", F.lit(1.0), F.lit(50.0), F.col("l_extendedprice") * 1.1)
    off = F.abs(F.col("reached") - F.col("l_extendedprice") * 1.1) / (F.col("l_extendedprice") * 1.1)
    return found.select("key", "l_quantity", "best", "reached", (off > 0.05).alias("unreachable"))


@query()
def seasonal_forecast(spark: Spark, d: str) -> DataFrame:
    return models.seasonal_forecast(panel(spark, d), 28)


@query()
def rolling_origin_cv(spark: Spark, d: str) -> DataFrame:
    return models.rolling_origin(panel(spark, d), horizon=30, period=180, initial=1500)


@query()
def backtest_model(spark: Spark, d: str) -> DataFrame:
    return splits.summary(splits.backtest(splits.folds(panel(spark, d), 2000, 30, 200), trend_and_week))


@query()
def batch_forecast(spark: Spark, d: str) -> DataFrame:
    """Forecasts of products that have a model; the others are rows of status failed."""
    p = panels.build(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")
    have = registry(spark, d).where("stage = 'production' AND model < '4'").select(F.col("model").alias("entity")).distinct()
    ids = p.select("entity").distinct()
    f = models.seasonal_forecast(p.join(have, "entity", "left_semi"), 7).select("entity", "ts", "yhat", F.lit("succeeded").alias("status"))
    return f.unionByName(ids.join(have, "entity", "left_anti").select("entity", F.lit(None).cast("date").alias("ts"), F.lit(None).cast("double").alias("yhat"), F.lit("failed").alias("status")))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def load_training_sample(spark: Spark, d: str) -> DataFrame:
    """The sample that the production model of the registry points to."""
    path = files.write(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    g = registry(spark, d).withColumn("sample", F.lit(path))
    return files.load(spark, reg.resolve(g, stage="production").where("model = '1-URGENT'").first().sample, kind="parquet")


def tabular_run(t: DataFrame, overrides=None) -> pipelines.Run:
    def split(state: dict) -> str:
        s = splits.random_split(t, "key")
        state["train"], state["test"] = s.where("role = 'train'").drop("role"), s.where("role = 'test'").drop("role")
        return "80/20"

    def train(state: dict) -> str:
        state["processor"] = clean.Processor(target="l_extendedprice", protected=["key"], numeric_target=True).fit(state["train"])
        state["model"] = models.boosted(state["processor"].transform(state["train"]), "l_extendedprice", FEATURES, TEXTS)
        return "trained"

    def evaluate(state: dict) -> str:
        scored = state["model"].transform(state["processor"].transform(state["test"]))
        return f"{metrics.regression(scored.select(F.col('l_extendedprice').alias('y'), F.col('prediction').alias('yhat'))).first().r2:.4f}"

    steps = [
        ("problem", lambda s: profile.tabular_problem(t, "l_extendedprice").first().problem_type),
        ("validation", lambda s: profile.report(profile.findings(t, "l_extendedprice")).first().status),
        ("split", split),
        ("train", train),
        ("evaluate_r2", evaluate),
        ("drift", lambda s: drift.report(s["train"], s["test"], FEATURES).where("drifted").count()),
        ("importance", lambda s: models.gain_importance(s["model"], [*FEATURES, *TEXTS]).first().feature),
    ]
    return pipelines.Run(steps, overrides)


@query()
def tabular_pipeline(spark: Spark, d: str) -> DataFrame:
    return tabular_run(_rows(spark, d))(spark)


def trend_and_week(train, test):
    """A fold's forecasts by trend and seasons."""
    import numpy as np
    import pandas as pd

    days = [pd.to_datetime(x.ts).to_numpy("datetime64[D]").astype("int64").astype(float) for x in (train, test)]
    origin, span = days[0][0], days[0][-1] - days[0][0]
    x, z = (models.seasonal_design(v, origin, span, None) for v in days)
    return z @ np.linalg.lstsq(x.T @ x + np.eye(x.shape[1]), x.T @ train.y.to_numpy(float), rcond=None)[0]


def temporal_run(p: DataFrame, overrides=None) -> pipelines.Run:
    def train(state: dict) -> str:
        s = splits.temporal_split(p, 28)
        state["train"], state["test"] = s.where("role = 'train'").drop("role"), s.where("role = 'test'").drop("role")
        state["model"] = models.fit_panel(state["train"])
        return "trained"

    def evaluate(state: dict) -> str:
        f = models.forecast_panel(state["model"], state["train"], 28).select("entity", "ts", "yhat")
        return f"{metrics.forecast(f.join(state['test'], ['entity', 'ts'])).first().wape:.2f}"

    def backtest(state: dict) -> str:
        initial, step = splits.default_sizes(splits.dates_of(p).count(), 28)
        return f"{splits.summary(splits.backtest(splits.folds(p, initial, 28, step), trend_and_week)).first().mae:.2f}"

    steps = [
        ("panel", lambda s: panels.guard(p, least_rows=30).first().n_rows),
        ("validation", lambda s: profile.report(profile.findings(p, "y")).first().status),
        ("contract", lambda s: profile.contract(p, "y", "forecasting").count()),
        ("cadence", lambda s: panels.cadence(p).first().step_days),
        ("train", train),
        ("evaluate_wape", evaluate),
        ("backtest_mae", backtest),
    ]
    return pipelines.Run(steps, overrides)


@query()
def temporal_pipeline(spark: Spark, d: str) -> DataFrame:
    """The backtest fits trend and seasons anew for each of the default folds; fitting the trees for each would take a job a fold."""
    return temporal_run(panel(spark, d))(spark)


_DRIFTING = ["l_quantity", "l_discount"]


def _halves(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    t, cut = table(spark, d, "lineitem"), F.lit("1998-06-01").cast("timestamp_ntz")
    return t.where(F.col("l_shipdate") < cut), t.where(F.col("l_shipdate") >= cut)


@query()
def validation_run(spark: Spark, d: str) -> DataFrame:
    """One row: schema, transitions, gates, drift, its statistics and the leading feature of a run."""
    a, b = _halves(spark, d)
    history = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "queued").otherwise("running").alias("status"))
    illegal = rules.illegal_transitions(history, "job", "status", ["seq"]).agg(F.count(F.lit(1)).alias("n_illegal"))
    broken = profile.contract(a, "l_quantity").agg(F.count(F.lit(1)).alias("n_broken"))
    gate = drift.gate(drift.report(a, b, _DRIFTING)).select("score", "stopped", "any_drifted")
    most = drift.full_report(a, b, _DRIFTING).agg(*[F.max(c).alias(c) for c in ("psi", "kl", "js")])
    top = shap_importance(spark, d).limit(1).select(F.col("feature").alias("top_feature"), F.col("importance").alias("top_importance"))
    out = illegal.withColumn("k", F.lit(1))
    for part in (broken, gate, most, top):  # one row each
        out = out.join(part.withColumn("k", F.lit(1)), "k")
    run = out.drop("k").withColumns({"quality": F.lit(0.9), "drift": F.col("score"), "performance": F.lit(0.8), "seconds": F.lit(10), "failures": F.lit(0)})
    return rules.gates(run)


@query()
def validation_drift_rows(spark: Spark, d: str) -> DataFrame:
    """The drift rows that a validation run stores, beside its own."""
    a, b = _halves(spark, d)
    return files.roundtrip(drift.full_report(a, b, _DRIFTING).join(drift.report(a, b, _DRIFTING).select("feature", "p_value", "drifted"), "feature"), "parquet")


@query()
def gbt_multiclass(spark: Spark, d: str) -> DataFrame:
    """Three classes, each against the rest: the prediction of each held-back row with the probabilities of all classes."""
    t = splits.random_split(_rows(spark, d), "key", "l_returnflag")
    m = block_trees.fit(t.where("role = 'train'"), "l_returnflag", ["l_extendedprice", *FEATURES], ["l_linestatus"], kind="classification")
    return m.predict(t.where("role = 'test'")).select("key", F.col("__label").alias("y"), F.col("prediction").alias("yhat"), *[F.get("probabilities", F.lit(k)).alias(f"p_{k}") for k in range(3)])


@query("SELECT 14 * count(DISTINCT l_returnflag) AS n, CAST(0 AS DOUBLE) AS most FROM lineitem")
def panel_model_roundtrip(spark: Spark, d: str) -> DataFrame:
    """Forecasts of a stored and loaded panel model differ from the model's own by nothing."""
    p = panel(spark, d)
    m = models.fit_panel(p)
    again, tails = models.load_panel(spark, models.save_panel(m, p))
    f, g = models.forecast_panel(m, p, 14), models.forecast_panel(again, tails, 14).withColumnRenamed("yhat", "after")
    return f.join(g, ["entity", "ts", "step"]).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("yhat") - F.col("after"))).alias("most"))


@query()
def seasonal_with_regressors(spark: Spark, d: str) -> DataFrame:
    """Multiplicative seasons with a regressor that is known ahead, for each kind of part."""
    o = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    p = panels.build(o, "p_brand", "l_shipdate", "l_quantity").withColumn("month_end", (F.dayofmonth("ts") >= 28).cast("double"))
    ahead = panels.future(p, 28).withColumn("month_end", (F.dayofmonth("ts") >= 28).cast("double"))
    return models.seasonal_forecast(p, 28, multiplicative=True, regressors=["month_end"], ahead=ahead)
