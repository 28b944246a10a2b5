"""Operators on small tables with known results."""

import datetime as dt
from itertools import combinations
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import clean, drift, features, metrics, models, panel, profile, registry, rules, splits, tables, whatif


def one(df):
    return df.collect()[0].asDict()


def pairs(spark, y, p):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, yhat double")


def test_forecast_metrics(spark):
    m = one(metrics.forecast(pairs(spark, (10, 20, 30), (12, 18, 35))))
    assert m["mae"] == 3 and m["wape"] == pytest.approx(15) and m["rmse"] == pytest.approx(math.sqrt(11))
    z = one(metrics.forecast(pairs(spark, (0, 0, 0), (1, 2, 3))))
    assert z["mape"] is None and z["smape"] == 200 and z["wape"] == 100
    assert one(metrics.forecast(pairs(spark, (100, 100), (80, 80))))["bias"] == pytest.approx(0.2)
    assert one(metrics.forecast(pairs(spark, (1, float("nan")), (1, 2))))["n"] == 1


def test_mase(spark):
    train = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((10, 10, 10, 20, 20, 20))], "entity string, ts int, y double")
    test = pairs(spark, (30, 30, 30), (25, 25, 25))
    assert one(metrics.mase(test, train, 3))["mase"] == pytest.approx(0.5)


def test_regression_metrics(spark):
    m = one(metrics.regression(pairs(spark, (3, -0.5, 2, 7), (2.5, 0, 2, 8))))
    assert m["mae"] == 0.5 and m["mse"] == 0.375 and m["msle"] is None
    c = one(metrics.regression(pairs(spark, (10, 10, 10), (11, 11, 11))))
    assert c["explained_variance"] is None and c["mae"] == 1 and c["r2"] == 0
    with pytest.raises(ValueError):
        metrics.regression(pairs(spark, (1,), (float("inf"),)))


def test_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12),), (dt.datetime(2024, 6, 15, 18, 30),), (dt.datetime(2024, 12, 31, 23, 59),)], "t timestamp")
    r = features.calendar(df, "t", high=True, cyclic=True).orderBy("t").collect()
    assert [x.t_is_weekend for x in r] == [False, True, False]
    assert abs(r[1].t_month_sin) < 1e-9 and r[2].t_month_cos == pytest.approx(1) and (r[2].t_hour, r[2].t_minute) == (23, 59)
    with pytest.raises(TypeError):
        features.calendar(df.select(F.lit(1).alias("t")), "t")


def test_safe_logs_and_interactions(spark):
    df = spark.createDataFrame([(1, -1), (10, 2), (100, 3)], "positive int, mixed int")
    cols = features.safe_logs(features.interactions(df, ["positive", "mixed"]), ["positive", "mixed"]).columns
    assert "positive_x_mixed" in cols and "positive_log" in cols and "mixed_log" not in cols


def test_messy_table(spark):
    rows = [(1, 10, 10.0, 5, None, "a"), (2, 20, 20.0, 5, 4.0, "b"), (2, 20, 20.0, 5, 4.0, "b"), (3, 30, 30.0, 5, 5.0, "N/A"), (4, 40, 40.0, 5, 3.0, "b"), (5, 50, 50.0, 5, 6.0, "c")]
    df = spark.createDataFrame(rows, "id long, target long, leaked double, constant long, gaps double, cat string").dropDuplicates()
    assert df.count() == 5
    assert [r.column for r in clean.leaking(df.drop("id"), "target").collect()] == ["leaked"]
    p = clean.Processor(target="target", protected=["id"]).fit(df)
    assert p.dropped == ["constant"] and p.numeric["gaps"] == 4.5 and p.text["cat"] == "b"
    assert clean.Processor.from_json(p.to_json()).transform(df).where("gaps IS NULL OR cat IS NULL").count() == 0
    with pytest.raises(RuntimeError):
        p.fit(df)
    codes = {r.cat: r.code for r in clean.encode_labels(df.where("cat <> 'N/A'"), "cat", "code").collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}


def test_clean_target(spark):
    df = spark.createDataFrame([("1.5",), (" nan ",), ("2",)], "t string")
    assert sorted(r.t for r in clean.clean_target(df, "t", True).collect()) == [1.5, 2.0]
    with pytest.raises(ValueError):
        clean.clean_target(spark.createDataFrame([("x1",)], "t string"), "t", True)


def test_quality_findings(spark):
    def status(df, target=None):
        f = profile.findings(df, target)
        return {r.check for r in f.collect()}, one(profile.report(f))

    checks, rep = status(spark.createDataFrame([(1, 10), (2, 20), (2, 20), (3, 30)], "f long, target long"), "target")
    assert "duplicates" in checks and rep["status"] != "invalid"
    checks, rep = status(spark.createDataFrame([(1, 1, 1), (2, 5, 5), (3, 2, 2), (4, 9, 9)], "f long, target long, leak long"), "target")
    assert "leakage" in checks and rep["status"] == "invalid"
    checks, _ = status(spark.createDataFrame([(i, 0 if i < 2 else 1) for i in range(100)], "f long, target long"), "target")
    assert "imbalance" in checks
    checks, rep = status(spark.createDataFrame([(i, i * 2 % 50, i % 7) for i in range(50)], "a long, b long, target long"), "target")
    assert not checks and rep["status"] == "valid" and rep["score"] == 1
    checks, rep = status(spark.createDataFrame([], "a long, b string"))
    assert "empty" in checks and rep["status"] == "invalid"


def test_semantics(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2, dt.datetime(2024, 1, i + 1), i % 2) for i in range(5)], "order_id long, rating long, store_location_id long, day timestamp, is_fraud long")
    r = {x.column: x for x in profile.semantics(df).collect()}
    assert r["order_id"].is_id and not r["store_location_id"].is_id and r["store_location_id"].semantic == "categorical"
    assert one(profile.problem_type(df))["problem_type"] == "forecasting"
    assert one(profile.problem_type(spark.createDataFrame([(1.5 * i,) for i in range(25)], "y double")))["problem_type"] == "regression"


def test_identify_target(spark):
    t = one(profile.identify_target(spark.createDataFrame([(i, 20 + i, i * 1.5, i % 2) for i in range(5)], "customer_id long, age long, spend_score double, outcome long")))
    assert t["target"] == "outcome" and t["problem_type"] == "binary" and t["confidence"] >= 0.6
    t = one(profile.identify_target(spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 5.0)], "feature long, price double")))
    assert t["target"] == "price" and t["problem_type"] == "regression"


def test_contract(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, 1), (dt.datetime(2024, 1, 2), 2.0, 2)], "t timestamp, f double, target long")
    assert profile.contract(df, "target", "forecasting").count() == 0
    broken = {r.rule for r in profile.contract(df.select("f", F.lit(1).alias("target")), "target", "forecasting").collect()}
    assert broken == {"target_constant", "no_date"}


def test_drift(spark):
    rng = np.random.default_rng(1)
    ref = spark.createDataFrame(pd.DataFrame({"a": rng.normal(0, 1, 2000), "b": rng.normal(0, 1, 2000)}))
    cur = spark.createDataFrame(pd.DataFrame({"a": rng.normal(0, 1, 2000), "b": rng.normal(3, 1.8, 2000)}))
    r = {x.feature: x for x in drift.full_report(ref, cur, ["a", "b", "gone"]).collect()}
    assert set(r) == {"a", "b"}
    assert r["a"].psi < 0.1 and r["a"].ks < 0.1 and r["b"].psi > 0.25 and r["b"].ks > 0.2 and r["b"].js > 0.1
    same = {x.feature: x for x in drift.full_report(ref, ref, ["a"]).collect()}["a"]
    assert same.psi == pytest.approx(0, abs=1e-9) and same.ks == 0


def test_ks_against_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = np.round(rng.normal(0, 1, 700), 1), np.round(rng.normal(0.3, 1, 500), 1)
    got = one(drift.ks(drift.long_form(spark.createDataFrame(pd.DataFrame({"v": x})), spark.createDataFrame(pd.DataFrame({"v": y})), ["v"])))
    grid = np.unique(np.concatenate([x, y]))
    want = max(abs(np.mean(x <= g) - np.mean(y <= g)) for g in grid)
    assert got["ks"] == pytest.approx(want)


def test_row_folds_with_repeated_times(spark):
    rows = [(dt.date(2024, 1, 1 + i // 4), float(i)) for i in range(100)] + [(dt.date(2024, 1, 3), 8.0)] * 3
    df = spark.createDataFrame(rows, "ts date, y double").repartition(5)
    numbered = [(r.ts, r.i) for r in splits.numbered_rows(df).orderBy("i").collect()]
    assert [i for _, i in numbered] == list(range(103)) and [t for t, _ in numbered] == sorted(t for t, _ in rows)
    for sliding in (False, True):
        got = splits.folds(df, 40, 7, 10, sliding=sliding, panel=False).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("hi"), F.min("ts").alias("lo")).collect()
        assert {r["n"] for r in got if r.role == "test"} == {7}
        assert all(r["n"] == (40 if sliding else 40 + 10 * r.fold) for r in got if r.role == "train")
        ends = {(r.fold, r.role): r for r in got}
        assert all(ends[f, "train"].hi <= ends[f, "test"].lo for f, role in ends if role == "test")
    assert splits.folds(df.limit(0), 4, 1, 1, panel=False).count() == 0
    distinct = df.withColumn("y", F.monotonically_increasing_id().cast("double"))
    split = splits.row_split(distinct, 6).groupBy("role").count().collect()
    assert {r.role: r["count"] for r in split} == {"train": 97, "test": 6}


def test_fallback_targets(spark):
    of = lambda *columns: profile.fallback_target(spark.createDataFrame([tuple(range(k, len(columns) + k)) for k in range(9)], [*columns]).withColumn("few", F.col(columns[0]) % 3))
    assert of("a", "Label", "CLASS") == "CLASS" and of("y", "label") == "label" and of("a", "b") == "few"
    t = spark.createDataFrame([(i, f"t{i}", [i]) for i in range(8)], "a long, b string, c array<long>")
    assert profile.fallback_target(t) == "c" and profile.fallback_target(t.select("c", "b")) == "b"


def test_exact_ks_equals_enumeration(spark):
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (6, 4)):
        paths = [set(c) for c in combinations(range(n + m), n)]
        far = [max(abs(sum(k in p for k in range(s)) * m - sum(k not in p for k in range(s)) * n) for s in range(1, n + m + 1)) for p in paths]
        for d in sorted(set(far)):
            assert drift.ks_exact(d / (n * m), n, m) == pytest.approx(np.mean([f >= d for f in far]))
            assert drift.ks_exact(d / (n * m), m, n) == pytest.approx(np.mean([f >= d for f in far]))
    assert drift.ks_exact(0.0, 5, 7) == 1
    assert 0 < drift.ks_exact(1.0, 40, 40) < 1e-22


def test_p_values_by_size(spark):
    v = lambda k, off: spark.range(k).select((F.col("id") % 97 + off).cast("double").alias("v"))
    small = drift.report(v(300, 0), v(200, 9), ["v"]).first()
    assert small.p_value == pytest.approx(drift.ks_exact(small.ks, 300, 200)) and 0 < small.p_value < 1
    assert drift.report(v(12_000, 0), v(200, 9), ["v"]).first().p_value == pytest.approx(small.p_value, abs=0.2)
    assert drift.report(v(5, 0), v(0, 0), ["v"]).count() == 0


def test_folds(spark):
    days = [(dt.date(2026, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(100)]
    df = spark.createDataFrame(days, "ts date, y double")
    f = {(r.fold, r.role): r["n"] for r in splits.folds(df, 20, 5, 10, panel=False).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert f[0, "train"] == 20 and f[0, "test"] == 5 and f[1, "train"] == 30
    s = {(r.fold, r.role): r["n"] for r in splits.folds(df, 20, 5, 10, sliding=True, panel=False).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {n for (_, role), n in s.items() if role == "train"} == {20}
    p = splits.folds(df, 20, 5, 10)
    assert p.where("fold = 0 AND role = 'test'").count() == 6
    late = p.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("ts"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("ts"))).alias("b"))
    assert late.where("a >= b").count() == 0


def test_regime(spark):
    a, b = (spark.createDataFrame([(m,)], "mae double") for m in (10.0, 5.0))
    r = one(splits.regime_change(a, b))
    assert r["drift"] and r["winner"] == "sliding" and r["gap"] == 0.5


def test_random_split_is_stratified(spark):
    df = spark.range(1000).withColumn("y", F.col("id") % 4)
    s = splits.random_split(df, "id", "y")
    assert {r["n"] for r in s.where("role = 'test'").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()} == {50}


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, v int")
    s = spark.createDataFrame([(2, 5, 1), (2, 6, 2), (3, 7, 1)], "k int, v int, o int")
    once = tables.upsert(t, s, "k", ["o"])
    assert sorted(map(tuple, once.collect())) == sorted([(1, "a", 1), (2, "b", 6), (3, None, 7)], key=str)
    assert sorted(map(str, tables.upsert(once, s, "k", ["o"]).collect())) == sorted(map(str, once.collect()))
    with pytest.raises(ValueError):
        tables.append_rows(t, s)


def test_merge_suffix(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "key int, v string")
    assert tables.merge(a, b, "id", "key", "outer").orderBy("id").collect() == [(1, "x", "y"), (2, None, "z")]


def test_rules(spark):
    df = spark.createDataFrame([("ok-model", "1.2.3"), ("bad name", "1.2.3"), ("ok", "v1"), (None, None)], "m string, v string")
    ok, bad = rules.split_valid(df, rules.request_rules(F.col("m"), F.col("v"), F.lit(1), F.lit(3), F.lit(10)))
    assert ok.count() == 1 and sorted(r.violations[0] for r in bad.collect()) == ["bad_model_name", "bad_model_name", "bad_version"]
    assert all(not rules.TRANSITIONS[s] for s in ("completed", "failed", "cancelled"))


def test_registry(spark):
    g = spark.createDataFrame([("a", 1, "production"), ("a", 2, "staging")], "model string, version long, stage string")
    new = registry.register(g, spark.createDataFrame([("a", 0, ""), ("b", 0, "")], g.schema))
    assert {(r.model, r.version) for r in new.where("stage = 'staging'").collect()} == {("a", 2), ("a", 3), ("b", 1)}
    up = registry.promote(new, "a", 3, "production")
    assert [(r.version, r.stage) for r in registry.list_versions(up, "a").collect()] == [(3, "production"), (2, "staging"), (1, "archived")]


def test_lever_search(spark):
    df = spark.createDataFrame([(10.0, 20.0), (10.0, 1e6)], "x double, goal double")
    out = whatif.lever_search(df, "x", F.lit(5.0), F.lit(15.0), F.col("goal"), lambda v, c: 2 * v).orderBy("goal").collect()
    assert out[0].reached == pytest.approx(20, abs=0.02) and out[1].best == 15


def test_recursive_forecast_and_shap(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(150)]
    p = spark.createDataFrame([(e, d, float(10 + d.weekday() + k)) for k, e in enumerate("ab") for d in days], "entity string, ts date, y double")
    m = models.fit_panel(p, maxIter=4, maxDepth=3)
    f = models.forecast_panel(m, p, 7).toPandas()
    assert len(f) == 14 and (f.yhat > 5).all() and f.ts.min() == dt.date(2024, 5, 30)
    frame = models.panel_frame(p).withColumn("key", F.monotonically_increasing_id())
    v = models.shap_values(frame, m, "key", models.FRAME).toPandas()
    s = v.groupby("key").agg(total=("value", "sum"), base=("base", "first"), prediction=("prediction", "first"))
    assert np.allclose(s.total + s.base, s.prediction, atol=1e-5)
    want = m.transform(frame).select("key", "prediction").toPandas().set_index("key").prediction
    assert np.allclose(s.prediction.sort_index(), want.sort_index())


def test_seasonal_forecast(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    p = spark.createDataFrame([("a", d, 100 + 0.1 * i + 5 * math.sin(2 * math.pi * i / 7)) for i, d in enumerate(days)], "entity string, ts date, y double")
    f = models.seasonal_forecast(p, 14).toPandas()
    assert len(f) == 14 and (f.lower <= f.upper).all() and abs(f.yhat.mean() - 140.6) < 3


def test_masking(spark):
    t = spark.createDataFrame([("write to a.b@c.org, 10.0.0.1, 123-45-6789, password=hunter2",)], "t string").select(S.mask_text(F.col("t"))).first()[0]
    assert "@" not in t and "10.0.0.1" not in t and "6789" not in t and "hunter2" not in t


def test_values_are_dealt_out_before_they_are_counted(spark):
    """No task of the input holds the different values of a whole file's split: nothing is aggregated before the shuffle, but for each batch."""
    import math

    from tessera.operators import clean, profile

    rows = [(i, "often" if i % 3 else None, math.nan if i % 7 else (0.0 if i % 2 else -0.0), i % 10) for i in range(500)] + [(1, "often", 0.0, 1)] * 40
    t = spark.createDataFrame(rows, "id long, word string, x double, digit int")
    counts = profile.value_counts(t, t.columns)
    before = counts._jdf.queryExecution().executedPlan().toString().rsplit("Exchange hashpartitioning(position", 1)
    assert len(before) == 2 and "Aggregate" not in before[1]
    expected = {}
    for r in rows:
        for i, v in enumerate(r):
            text = None if v is None else str(v).replace("nan", "NaN")
            expected[i, text] = expected.get((i, text), 0) + 1
    assert {(r.position, r.value): r.n for r in counts.collect()} == expected
    p = {r.column: r for r in profile.column_profile(t).collect()}
    assert (p["word"].n_null, p["word"].n_unique, p["word"].top_n, p["digit"].n_unique, p["id"].top_n) == (167, 2, 373, 10, 41)
    assert profile.duplicate_rows(t).first()[0] == 39
    assert profile.duplicate_rows(t.limit(0)).first()[0] == 0 and profile.column_profile(t.limit(0)).count() == 0
    same = spark.range(1).selectExpr("0D AS x").union(spark.range(1).selectExpr("-0D AS x")).union(spark.range(2).selectExpr("double('NaN') AS x"))
    assert profile.duplicate_rows(same).first()[0] == 2
    assert profile.duplicate_rows(spark.sql("SELECT array(id % 2) AS a FROM range(6)")).first()[0] == 4
    assert clean.mode_fills(spark.sql("SELECT * FROM VALUES ('b', null), ('a', null), ('b', null), ('a', null) AS t(u, v)").selectExpr("u", "string(v) AS v"), ["u", "v"]) == {"u": "a", "v": ""}
