"""Medians, label codes, CSV types, panel guards, seasonal fits, backtests, runs, gates and processors on small tables."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import clean, drift, models, panel, pipelines, rules, splits, whatif
from tessera.operators.quantiles import medians
from tessera.sources import files

SERIES = "entity string, ts date, y double"


def days(n, start=dt.date(2023, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_medians(spark):
    rng = np.random.default_rng(3)
    rows = [(g, None if k % 11 == 0 else float(v)) for g in ("a", "b", None) for k, v in enumerate(np.round(rng.exponential(3, 157 if g else 80), 1))] + [("c", None), ("d", 4.0), ("d", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {g: float(np.median([v for h, v in rows if h == g and v is not None])) for g in ("a", "b", None, "d")}
    assert {r.g: r["median"] for r in medians(df, "v", ["g"]).collect()} == pytest.approx(want)
    assert medians(df, "v").first()[0] == pytest.approx(float(np.median([v for _, v in rows if v is not None])))
    assert medians(df.limit(0), "v").count() == 0


def test_medians_leave_rows_where_they_are(spark):
    df = spark.range(3_000_000).select(F.when(F.col("id") >= 0, "all").alias("g"), (F.col("id") * 7919 % 3_000_001).cast("double").alias("v"))
    for by in ([], ["g"]):
        got = medians(df, "v", by)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert got.first()["median"] == float(np.median(np.arange(3_000_000) * 7919 % 3_000_001))


def test_label_codes_of_many_values(spark, monkeypatch):
    df = spark.createDataFrame([(f"v{i % 37:03d}",) for i in range(200)] + [(None,)], "x string")
    few = {r.x: r.code for r in clean.encode_labels(df, "x", "code").collect()}
    monkeypatch.setattr(clean, "FEW_VALUES", 5)
    many = {r.x: r.code for r in clean.encode_labels(df, "x", "code").collect()}
    assert few == many and many["v000"] == 0 and many["v036"] == 36 and many[None] is None


def test_csv_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("i,x,b,d,t,s,n\n1,1.5,true,2026-01-31,2026-01-31 10:00:00,NA ,NA\n2,N/A,false,2026-02-01,2026-02-01T11:00:00,na,null\n,2,true,,2026-02-02 00:00:00,N/A,\n")
    t = files.load(spark, str(path), kind="csv")
    assert [k for _, k in t.dtypes] == ["bigint", "double", "boolean", "date", "timestamp", "string", "string"]
    # Only exact tokens are null.
    assert [r.s for r in t.collect()] == ["NA ", "na", None] and [r.x for r in t.collect()] == [1.5, None, 2.0]
    assert dict(files.load(spark, str(path), kind="csv", types={"i": "double"}).dtypes)["i"] == "double"


def test_panel_guard(spark):
    p = spark.createDataFrame([("a", d, 1.0) for d in days(40)], SERIES)
    assert panel.guard(p, least_rows=30).first().n_rows == 40
    bad = [p.limit(0), p.union(p.limit(1)), p.union(spark.createDataFrame([(None, days(1)[0], 1.0)], SERIES)), p.limit(10)]
    for b in bad:
        with pytest.raises(ValueError):
            panel.guard(b, least_rows=30)
    with pytest.raises(TypeError):
        panel.guard(p.withColumn("ts", F.col("ts").cast("string")))
    with pytest.raises(ValueError):
        panel.guard(p.drop("y"))


def test_future_frames(spark):
    p = spark.createDataFrame([("a", d, 1.0) for d in days(3)], SERIES)
    assert [r.ts for r in panel.future(p, 2, freq="MS").orderBy("ts").collect()] == [dt.date(2023, 2, 1), dt.date(2023, 3, 1)]
    assert [r.ts for r in panel.future(p, 1, freq="W").collect()] == [dt.date(2023, 1, 10)]
    assert [(r.ts.day, r.step) for r in panel.future(p, 1, history=True).orderBy("ts").collect()] == [(1, -2), (2, -1), (3, 0), (4, 1)]
    hours = p.withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.ts.hour for r in panel.future(hours, 2, freq="h").orderBy("ts").collect()] == [1, 2]
    with pytest.raises(ValueError):
        panel.future(p, 1, freq="h")


def test_seasons_with_regressors(spark):
    # Negative and positive values, seasons that grow with the level, a regressor known ahead.
    rows = [("a", d, (50 + 0.5 * i) * (1 + 0.2 * math.sin(2 * math.pi * i / 7) + 0.3 * (i % 10 == 0)), float(i % 10 == 0)) for i, d in enumerate(days(300))]
    df = spark.createDataFrame(rows[:280], f"{SERIES}, promo double")
    ahead = spark.createDataFrame([(e, d, x) for e, d, _, x in rows[280:]], "entity string, ts date, promo double")
    f = models.seasonal_forecast(df, 20, multiplicative=True, regressors=["promo"], ahead=ahead).toPandas().sort_values("ts")
    assert np.abs(f.yhat.to_numpy() / [r[2] for r in rows[280:]] - 1).max() < 0.03 and (f.lower <= f.yhat).all()
    plain = models.seasonal_forecast(df, 20).toPandas().sort_values("ts")
    assert np.abs(plain.yhat.to_numpy() / [r[2] for r in rows[280:]] - 1).max() > 0.1
    with pytest.raises(ValueError):
        models.seasonal_forecast(df, 20, regressors=["promo"])
    with pytest.raises(ValueError):
        models.seasonal_forecast(df, 20, regressors=["promo"], ahead=ahead.withColumn("promo", F.lit(None).cast("double")))
    with pytest.raises(ValueError):
        models.seasonal_forecast(df.limit(1), 5)
    below = spark.createDataFrame([("a", d, -100 - 0.1 * i) for i, d in enumerate(days(60))], SERIES)
    assert models.seasonal_forecast(below, 5, multiplicative=True).toPandas().yhat.between(-110, -104).all()


def test_daily_season(spark):
    times = [dt.datetime(2026, 1, 1) + dt.timedelta(hours=i) for i in range(24 * 20)]
    df = spark.createDataFrame([("a", t, 10 + 3 * math.sin(2 * math.pi * t.hour / 24)) for t in times], "entity string, ts timestamp, y double")
    f = models.seasonal_forecast(df, 24, step_days=1 / 24, history=True).toPandas().sort_values("ts")
    assert len(f) == 24 * 21
    last = f.tail(24)
    assert np.abs(last.yhat - [10 + 3 * math.sin(2 * math.pi * t.hour / 24) for t in last.ts]).max() < 0.2


def test_forecasts_refuse_what_they_don_t_know(spark):
    p = spark.createDataFrame([(e, d, float(10 + d.weekday())) for e in "ab" for d in days(150)], SERIES)
    m = models.fit_panel(p, maxIter=2, maxDepth=2)
    again, tails = models.load_panel(spark, models.save_panel(m, p))
    a, b = (f.orderBy("entity", "ts").toPandas() for f in (models.forecast_panel(m, p, 5), models.forecast_panel(again, tails, 5)))
    assert a.equals(b) and len(a) == 10
    for bad in (p.union(p.withColumn("entity", F.lit("new"))), p.where("entity = 'a' OR ts < '2023-01-20'")):
        with pytest.raises(ValueError):
            models.forecast_panel(m, bad, 5)
    with pytest.raises(ValueError):
        models.fit_panel(p.union(p.limit(1)))


def test_backtest_errors(spark):
    p = spark.createDataFrame([(e, d, 1.0) for e in "ab" for d in days(60)], SERIES)
    folded = splits.folds(p, 20, 5, 10)

    def sometimes(train, test):
        if test.entity.iloc[0] == "a":
            raise ValueError("no")
        return train.y.mean()

    def never(train, test):
        raise ValueError("no")

    s = splits.summary(splits.backtest(folded, sometimes)).first()
    assert s.n_folds == s.n_failed > 1 and s.mae == 0
    with pytest.raises(Exception, match="no fold could be evaluated"):
        splits.summary(splits.backtest(folded, never)).collect()


def test_classes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (400, 2))
    y = np.where(x[:, 0] > 0.5, "high", np.where(x[:, 0] < -0.5, "low", "mid"))
    df = spark.createDataFrame([(i, float(a), float(b), str(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "key long, a double, b double, y string")
    m = models.boosted(df, "y", ["a", "b"], kind="classification", maxIter=5, maxDepth=3)
    p = models.with_probabilities(df, m).select("__label", "prediction", "probabilities").toPandas()
    assert (p.__label == p.prediction).mean() > 0.95
    assert all(abs(sum(v) - 1) < 1e-9 and len(v) >= 3 for v in p.probabilities) and np.mean([np.argmax(v) == k for v, k in zip(p.probabilities, p.prediction, strict=True)]) > 0.99
    v = models.shap_values(df, m, "key", ["a", "b"]).toPandas()
    s = v.groupby(["key", "class"]).agg(total=("value", "sum"), base=("base", "first"), prediction=("prediction", "first"))
    assert v["class"].nunique() >= 3 and np.allclose(s.total + s.base, s.prediction, atol=1e-6)
    assert v[v.feature == "a"].value.abs().mean() > 5 * v[v.feature == "b"].value.abs().mean()


def test_runs(spark):
    steps = [("one", lambda s: s.setdefault("x", 1)), ("two", lambda s: s["x"] + 1)]
    run = pipelines.Run(steps, {"one": lambda s: s.setdefault("x", 5)})
    assert [(r.step, r.result) for r in run(spark).collect()] == [("one", "5"), ("two", "6")]
    with pytest.raises(RuntimeError):
        run(spark)
    with pytest.raises(ValueError):
        pipelines.Run(steps, {"three": lambda s: 0})


def test_gates_raise(spark):
    t = spark.createDataFrame([(0.9, 0.1, 0.8, 10, 0), (0.9, 0.5, 0.8, 10, 0)], "quality double, drift double, performance double, seconds int, failures int")
    assert rules.enforce(rules.gates(t.limit(1))).count() == 1
    with pytest.raises(ValueError, match="drift_ok"):
        rules.enforce(rules.gates(t))


def test_processor_metadata(spark):
    t = spark.createDataFrame([("1", 1.0, "x", None), ("n/a", None, "y", None), ("3", 5.0, None, None)], "y string, a double, s string, gone double")
    p = clean.Processor(target="y", numeric_target=True).fit(t)
    m = p.metadata
    assert m["rows_dropped"] == 1 and m["dropped_columns"] == ["gone"] and m["imputed_columns"] == {"s": 1} and m["milliseconds"] >= 0
    out = clean.Processor.from_json(p.to_json()).transform(t)
    assert sorted(r.y for r in out.collect()) == [1.0, 3.0]
    with pytest.raises(ValueError):
        clean.Processor(target="y", numeric_target=True).fit(t.withColumn("y", F.lit("word")))


def test_outcomes(spark):
    t = spark.createDataFrame([(10.0, 10.0, 0.9, 1.0, 2.0), (10.0, 10.0, 0.5, 3.0, 2.0)], "reached double, goal double, r double, lo double, hi double")
    got = whatif.outcome(t, F.col("reached"), F.col("goal"), F.col("r"), F.col("lo"), F.col("hi")).orderBy("lo").collect()
    assert [(r.status, r.risk) for r in got] == [("HIGH_RISK", 0.9), ("FAILED", 1.0)]


def test_ks_of_heavy_tails(spark):
    rng = np.random.default_rng(8)
    x, y = rng.pareto(0.3, 3000) * 1.0, rng.pareto(0.35, 2000) * 1.0
    counts = drift.tally(drift.long_form(spark.createDataFrame(pd.DataFrame({"v": x})), spark.createDataFrame(pd.DataFrame({"v": y})), ["v"]))
    grid = np.sort(np.concatenate([x, y]))
    want = np.abs(np.searchsorted(np.sort(x), grid, "right") / 3000 - np.searchsorted(np.sort(y), grid, "right") / 2000).max()
    assert drift.ks_of(counts).first().ks == pytest.approx(want) and drift.ks_of(counts, 16).first().ks == pytest.approx(want)
