"""Panels of many entities, wide categories, Shapley values and lever search on fitted trees, against brute force."""

import datetime as dt
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import block_trees, models, panel_boosting, whatif


def some_rows(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 10, (n, 3))
    y = 3 * x[:, 0] + np.where(x[:, 1] > 5, 10, 0) + x[:, 2] * (x[:, 0] > 3)
    return pd.DataFrame({"key": range(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(some_rows())
    return df, models.boosted(df, "y", ["a", "b", "c"], maxIter=4, maxDepth=4)


def test_three_hundred_entities(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    rows = [(f"e{k:03}", d, float((k + 1) * (10 + d.weekday()))) for k in range(300) for d in days]
    p = spark.createDataFrame(rows, "entity string, ts date, y double").repartition(4)
    m = models.fit_panel(p, maxIter=5, maxDepth=4)
    f = models.forecast_panel(m, p, 3).toPandas()
    assert len(f) == 900 and f.entity.nunique() == 300
    want = [(int(e[1:]) + 1) * (10 + t.weekday()) for e, t in zip(f.entity, f.ts, strict=True)]
    assert np.mean(np.abs(f.yhat - want) / want) < 0.1


def test_past_has_no_future(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    p = spark.createDataFrame([("a", d, float(i % 5 + 1)) for i, d in enumerate(days)], "entity string, ts date, y double")
    got = models.panel_frame(p).orderBy("ts").toPandas()
    y = np.array([i % 5 + 1 for i in range(40)], float)
    y /= y.mean()
    for r in got.itertuples():
        k = days.index(r.ts)
        assert r.past_rows == k and r.past_mean == pytest.approx(y[:k].mean()) and r.past_spread == pytest.approx(y[:k].std())


@pytest.mark.parametrize("kind", ["regression", "classification"])
def test_more_categories_than_bins(spark, kind):
    rows = [(i, f"v{i % 400:03}", float((i % 400) % 7), None) for i in range(2400)] + [(9999, None, 3.0, None)]
    df = spark.createDataFrame(rows, "key long, t string, y double, nothing string").drop("nothing")
    df = df.withColumn("y", F.when(F.col("y") > 3, "high").otherwise("low")) if kind == "classification" else df
    m = models.boosted(df, "y", [], ["t"], kind=kind, maxIter=10, maxDepth=4, stepSize=0.5)
    got = models.save_and_load(m).transform(df.union(spark.createDataFrame([(-1, "unseen", "0" if kind != "regression" else 0.0)], df.schema))).toPandas()
    assert len(got) == 2402
    known = got[(got.key >= 0) & (got.key < 9999)]
    assert (np.abs(known.prediction - known.y) < 1).mean() > 0.95 if kind == "regression" else (known.prediction == known.__getattr__("__label")).mean() > 0.99


def brute_shapley(trees, row, n):
    """By all subsets of features: known ones follow the row, others are averaged by cover."""

    def value(t, known, k=0):
        if t["left"][k] < 0:
            return t["prediction"][k]
        left, right = int(t["left"][k]), int(t["right"][k])
        if int(t["feature"][k]) in known:
            return value(t, known, left if trees._goes_left(t, k, row[None])[0] else right)
        return sum(t["cover"][c] * value(t, known, c) for c in (left, right)) / t["cover"][k]

    total = lambda s: sum(w * value(t, s) for w, t in zip(trees.weights, trees.trees, strict=True))
    out = np.zeros(n)
    for f in range(n):
        rest = [g for g in range(n) if g != f]
        for size in range(n):
            for s in combinations(rest, size):
                out[f] += (total({*s, f}) - total(set(s))) / (n * comb(n - 1, size))
    return out


def test_shapley_by_masks(fitted, monkeypatch):
    df, m = fitted
    trees, x = models.trees_of(m), some_rows(40, 1)[["a", "b", "c"]].to_numpy()
    values, base = trees.shap(x)
    assert np.allclose(values.sum(axis=1) + base, trees.predict(x), atol=1e-9)
    assert np.allclose(values[:8], [brute_shapley(trees, r, 3) for r in x[:8]], atol=1e-9)
    wide = models.trees_of(m)
    monkeypatch.setattr(models.Trees, "WIDE", 0)
    again, _ = wide.shap(x)
    assert all("table" not in leaf for t in wide.leaves() for leaf in t) and np.allclose(values, again, atol=1e-12)
    assert trees.shap(x[:0])[0].shape == (0, 3)


def test_levers_equal_a_grid(fitted):
    df, m = fitted
    trees = models.trees_of(m)
    goals = df.withColumns({"goal": F.col("y") + F.pmod("key", F.lit(9)) - 4, "lo": F.lit(1.0), "hi": F.lit(9.0)})
    got = models.lever_search(goals, m, ["a", "b", "c"], "a", F.col("lo"), F.col("hi"), F.col("goal")).limit(60).toPandas()
    edges = np.unique([float(v) for t in trees.trees for v, f in zip(t["threshold"], t["feature"], strict=True) if f == 0])
    grid = np.unique(np.concatenate([edges, np.nextafter(edges, np.inf), [1.0, 9.0]]))
    grid = grid[(grid >= 1) & (grid <= 9)]
    for r in got.itertuples():
        x = np.stack([grid, np.full(len(grid), r.b), np.full(len(grid), r.c)], axis=1)
        assert abs(r.reached - r.goal) == pytest.approx(np.abs(trees.predict(x) - r.goal).min(), abs=1e-9)
        assert 1 <= r.best <= 9 and trees.predict(np.array([[r.best, r.b, r.c]]))[0] == pytest.approx(r.reached, abs=1e-9)


def test_levers_of_a_class_and_odd_rows(spark):
    t = some_rows()
    t["label"] = np.where(t.a + t.b > 10, "yes", "no")
    df = spark.createDataFrame(t)
    m = models.boosted(df, "label", ["a", "b"], kind="classification", maxIter=4, maxDepth=3)
    got = models.lever_search(df, m, ["a", "b"], "a", F.lit(0.0), F.lit(10.0), F.lit(0.9)).toPandas()
    assert ((got.reached >= 0) & (got.reached <= 1)).all()
    moved = spark.createDataFrame(got[["key", "best", "b", "label"]].rename(columns={"best": "a"}))
    p = models.with_probabilities(moved, m).select("key", F.get("probabilities", F.lit(1)).alias("p")).toPandas().set_index("key").p
    assert np.allclose(p[got.key], got.reached, atol=1e-9)
    odd = models.lever_search(df.limit(3), m, ["a", "b"], "a", F.when(F.col("key") < 0, 0.0), F.lit(10.0), F.lit(0.9)).toPandas()
    assert odd.best.isna().all() and odd.reached.isna().all()
    assert models.lever_search(df.limit(3), m, ["a", "b"], "a", F.lit(9.0), F.lit(1.0), F.lit(0.9)).toPandas().best.isna().all()
    assert models.lever_search(df.limit(0), m, ["a", "b"], "a", F.lit(1.0), F.lit(9.0), F.lit(0.9)).count() == 0


def test_levers_refused(fitted):
    df, m = fitted
    with pytest.raises(ValueError):
        models.lever_search(df, m, ["a", "b", "c"], "z", F.lit(0.0), F.lit(1.0), F.lit(1.0))
    with pytest.raises(TypeError):
        models.lever_search(df.withColumn("a", F.lit("x")), m, ["a", "b", "c"], "a", F.lit(0.0), F.lit(1.0), F.lit(1.0))
    for bad, error in (("z", ValueError), ("t", TypeError)):
        t = df.withColumn("t", F.lit("x"))
        with pytest.raises(error):
            whatif.lever_search(t, bad, F.lit(0.0), F.lit(1.0), F.lit(1.0), lambda v, c: v)
        with pytest.raises(error):
            whatif.outcome(t, F.col("a"), F.col("a"), F.lit(0.1), F.lit(0.0), F.lit(1.0), lever=bad)
    with pytest.raises(ValueError):
        whatif.outcome(df, F.col("a"), F.col("a"), F.lit(0.1), F.lit(2.0), F.lit(1.0), strict=True)


def repeated(spark):
    """Few sets of features, with other labels each time; one price in ten is null, some texts are."""
    rng = np.random.default_rng(5)
    n = 4000
    t = pd.DataFrame({"key": range(n), "a": rng.integers(0, 6, n) / 2, "b": rng.integers(0, 5, n), "t": [None if v == 3 else f"v{v}" for v in rng.integers(0, 4, n)]})
    t["y"] = 3 * t.a + np.where(t.b > 2, 5, 0) + rng.normal(0, 1, n)
    t["c"] = np.where(t.y > 8, "high", np.where(t.y > 4, "mid", "low"))
    return spark.createDataFrame(t, "key long, a double, b int, t string, y double, c string")


@pytest.mark.parametrize("label,kind", [("y", "regression"), ("c", "classification")])
def test_rows_with_equal_features_are_fitted_once(spark, monkeypatch, label, kind):
    df, how = repeated(spark), {"maxIter": 4, "maxDepth": 3}
    sizes, fit = [], models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, t: sizes.append(t.count()) or fit(self, t))
    once = models.boosted(df, label, ["a", "b"], ["t"], kind=kind, **how)
    monkeypatch.setattr(models, "EACH", 10**9)
    each = models.boosted(df, label, ["a", "b"], ["t"], kind=kind, **how)
    assert sizes[0] <= 6 * 5 * 4 * (3 if kind == "classification" else 1) and sizes[1] == 4000
    x = np.array([(a / 2, b, t) for a in range(6) for b in range(5) for t in range(4)], float)
    for k in range(3 if kind == "classification" else 1):  # nodes whose rows are all alike may be split once more or less
        p, q = (models.trees_of(m, k) for m in (once, each))
        assert np.allclose(p.predict(x), q.predict(x), atol=1e-9) and [t["cover"][0] for t in p.trees] == [t["cover"][0] for t in q.trees] == [4000] * 4
        assert np.allclose(p.shap(x)[0], q.shap(x)[0], atol=1e-9) and np.allclose(p.gains(3)[1:], q.gains(3)[1:], rtol=0.5)


@pytest.mark.parametrize("label,kind", [("y", "regression"), ("c", "classification")])
def test_shapley_values_of_equal_features_are_worked_out_once(spark, monkeypatch, label, kind):
    df = repeated(spark)
    m = models.boosted(df, label, ["a", "b"], ["t"], kind=kind, maxIter=3, maxDepth=3)
    order = ["key", "class", "feature"]
    joined = models.shap_values(df, m, "key", ["a", "b", "t"])
    assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString()  # Python sees the sets, not the rows
    monkeypatch.setattr(models, "EACH", 10**9)
    alone = models.shap_values(df, m, "key", ["a", "b", "t"])
    p, q = (t.toPandas().sort_values(order).reset_index(drop=True) for t in (joined, alone))
    assert len(p) == 4000 * 3 * (3 if kind == "classification" else 1) and p.columns.tolist() == [*order[:2], "feature", "value", "base", "prediction"]
    assert p[order].equals(q[order]) and np.allclose(p[["value", "base", "prediction"]], q[["value", "base", "prediction"]], atol=1e-9)
    sums = p.groupby(["key", "class"]).agg(v=("value", "sum"), b=("base", "first"), f=("prediction", "first"))
    assert np.allclose(sums.v + sums.b, sums.f, atol=1e-9)


def test_a_panel_model_is_fitted_from_files(spark, monkeypatch):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    p = spark.createDataFrame([("a", d, float(i % 5 + 1)) for i, d in enumerate(days)], "entity string, ts date, y double")
    seen, fit = [], models.boosted
    monkeypatch.setattr(models, "boosted", lambda df, *a, **k: seen.append(df) or fit(df, *a, **k))
    models.fit_panel(p, maxIter=1, maxDepth=1)
    assert seen[0].inputFiles() and seen[0].count() == 12


def test_values_and_splits_are_worked_out_once(spark):
    from tessera.operators import metrics, splits

    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    df = spark.range(600).select("id", F.col("id").cast("double").alias("y"), (F.col("id") + F.pmod("id", F.lit(3))).cast("double").alias("yhat"))
    got = metrics.regression(df.mapInPandas(counted, df.schema)).first()
    assert calls.value == 600 and got.n == 600 and got.mae == pytest.approx(1.0) and got.median_ae == 1.0
    s = splits.random_split(df.withColumn("c", F.pmod("id", F.lit(2))).mapInPandas(counted, "id long, y double, yhat double, c long"), "id", "c")
    before = calls.value
    assert s.where("role = 'test'").count() == 120 and s.count() == 600 and calls.value == before


def test_steps_are_worked_out_once(fitted, monkeypatch):
    """Rows that are equal but for the lever share their steps, over batches too, also where more sets come than are remembered."""
    trees = models.trees_of(fitted[1])
    rng = np.random.default_rng(3)
    asked, steps = [], models.Trees.steps
    monkeypatch.setattr(models.Trees, "steps", lambda self, x, f: asked.append(len(x)) or steps(self, x, f))
    for most, sets in ((100, 12), (5, None)):
        asked.clear()
        of = models.remembered_steps(trees, 0, most)
        for _ in range(4):
            x = np.column_stack([rng.uniform(0, 10, 60), rng.integers(0, 3, 60) * 4.0, rng.integers(0, 4, 60) * 3.0])
            want, got = steps(trees, x, 0), of(x)
            assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])
        assert sets is None or sum(asked) <= sets


def test_importance_of_repeated_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 4), float(i % 3), "xy"[i % 2], float((i % 4) * 3 + i % 3)) for i in range(240)], "key long, a double, b double, c string, y double")
    m = models.boosted(df, "y", ["a", "b"], ["c"], maxIter=3, maxDepth=3)
    want = models.shap_importance(models.shap_values(df, m, "key", ["a", "b", "c"])).collect()
    taken, values = [], models.shap_values
    monkeypatch.setattr(models, "shap_values", lambda t, *a: taken.append(t.count()) or values(t, *a))
    got = models.importance(df, m, "key", ["a", "b", "c"]).collect()
    assert [r.feature for r in got] == [r.feature for r in want] and taken == [12]
    assert [r.importance for r in got] == pytest.approx([r.importance for r in want], rel=1e-12)


@pytest.mark.parametrize("label,kind", [("y", "regression"), ("two", "classification"), ("c", "classification")])
def test_trees_on_blocks_are_sparks_own(spark, monkeypatch, label, kind):
    monkeypatch.setattr(block_trees, "REWRITE", 2)
    df = repeated(spark).withColumn("two", F.when(F.col("y") > 6, "more").otherwise("less"))
    ours = block_trees.fit(df, label, ["a", "b"], ["t"], kind=kind, trees=5, depth=3, step=0.2)
    theirs = models.boosted(df, label, ["a", "b"], ["t"], kind=kind, maxIter=5, maxDepth=3, stepSize=0.2)
    x = np.array([(a / 2, b, t) for a in range(6) for b in range(5) for t in range(4)], float)
    for k in range(3 if label == "c" else 1):
        p, q = ours.trees(k), models.trees_of(theirs, k)
        assert np.allclose(p.predict(x), q.predict(x), atol=1e-9) and p.weights == q.weights and p.trees[0]["cover"][0] == 4000
    got = ours.predict(df.withColumn("t", F.when(F.col("key") == 7, "new").otherwise(F.col("t"))).withColumn("x", F.lit(1))).toPandas()
    assert len(got) == 4000 and {"key", "x", "prediction"} <= set(got.columns)
    if kind == "classification":
        assert np.allclose(got.probabilities.map(sum), 1) and (got.probabilities.map(np.argmax) == got.prediction).all()
        assert (got["__label"] == got[label].map({c: float(i) for i, c in enumerate(sorted(got[label].unique()))})).all()


def test_trees_on_blocks_keep_bytes_for_rows(spark):
    """A row costs a byte a feature and sixteen more, where Spark's own trees keep objects; nothing stays in memory after the fit."""
    rows = next(block_trees._blocks([[1.0, 2.0], None], 1)(iter([block_trees.pa.RecordBatch.from_arrays([block_trees.pa.array([0.0] * 1000), block_trees._lists(np.ones((1000, 2)))], names=["y", "x"])])))
    assert rows.num_rows == 1 and sum(len(rows.column(k)[0].as_py()) for k in (1, 2, 3)) == 1000 * (2 + 16)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    block_trees.fit(spark.createDataFrame(some_rows()), "y", ["a", "b", "c"], trees=8, depth=2)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    for bad in (spark.createDataFrame(some_rows()).withColumn("y", F.lit("one")), spark.createDataFrame(some_rows()).limit(0)):
        with pytest.raises(ValueError):
            block_trees.fit(bad, "y", ["a"], kind="classification")


def test_queries_of_unlike_rows_grow_on_blocks(spark, monkeypatch):
    """Spark's own trees pass over objects of all rows where prices differ; that is what fails by time."""
    from tessera.plans import modelling

    def none(*a, **k):
        raise AssertionError("Spark's own trees")

    monkeypatch.setattr(models, "boosted", none)
    fit = block_trees.fit
    monkeypatch.setattr(block_trees, "fit", lambda *a, **k: fit(*a, **k, trees=2, depth=2))
    assert modelling.gbt_classification(spark, "/root/testdata/sf0.001").count() == 1
    got = modelling.gbt_multiclass(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) > 1000 and np.allclose(got.p_0 + got.p_1 + got.p_2, 1) and got.dtypes.astype(str)[["y", "yhat"]].tolist() == ["float64"] * 2


def test_a_panel_on_blocks_is_forecast_many_entities_at_once(spark, monkeypatch):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    rows = [(f"e{k:02}", d, float((k + 1) * (10 + d.weekday() + (d.day * (k + 3)) % 4))) for k in range(40) for d in days[: 60 - k % 3]]
    p = spark.createDataFrame(rows, "entity string, ts date, y double")
    m = panel_boosting.fit_on_blocks(p, trees=4, depth=3)
    together = m.forecast(p, 3).toPandas().sort_values(["entity", "step"]).reset_index(drop=True)
    monkeypatch.setattr(models, "TOGETHER", 1)
    alone = m.forecast(p, 3).toPandas().sort_values(["entity", "step"]).reset_index(drop=True)
    assert len(together) == 120 and together[["entity", "ts", "step"]].equals(alone[["entity", "ts", "step"]]) and np.allclose(together.yhat, alone.yhat)
    assert together.groupby("entity").ts.min()["e01"] == days[58] + dt.timedelta(days=1)
    plan = m.forecast(p, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "__part" in plan
