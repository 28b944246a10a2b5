"""Trends with sparse bends, bounds that widen, and holidays."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import holidays, models, trend

SERIES = "entity string, ts date, y double"


def days(n, start=dt.date(2022, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


@pytest.mark.parametrize("at", [(0.35,), (0.2, 0.6)])
def test_planted_bends(at):
    rng = np.random.default_rng(3)
    t = np.linspace(0, 1, 400)
    y = 10 + 5 * t + sum((-1) ** k * 20 * np.maximum(0, t - b) for k, b in enumerate(at)) + rng.normal(0, 0.05, 400)
    fit = trend.Fit(t, y, np.zeros((400, 0)), 1.0)
    step = np.diff(fit.bends).max()
    found = fit.bends[np.abs(fit.weights) * fit.unit > 2]
    assert len(found) and all(min(abs(b - found)) <= step for b in at) and all(min(abs(f - b) for b in at) <= 1.5 * step for f in found)
    assert np.abs(fit.trend(t) - y).std() < 0.1


def test_straight_lines_have_no_bends():
    rng = np.random.default_rng(4)
    t = np.linspace(0, 1, 300)
    fit = trend.Fit(t, 3 + 2 * t + rng.normal(0, 0.2, 300), np.zeros((300, 0)), 1.0)
    assert np.abs(fit.weights).sum() * fit.unit < 0.5
    assert len(trend.candidates(np.array([0.0, 1.0]))) == 0 and len(trend.candidates(np.linspace(0, 1, 1000))) == 25
    two = trend.Fit(np.array([0.0, 1.0]), np.array([1.0, 3.0]), np.zeros((2, 0)), 1.0)
    assert two.trend(np.array([2.0]))[0] == pytest.approx(5, abs=1e-3)


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(5)
    x, y = rng.normal(0, 1, (60, 6)), rng.normal(0, 1, 60)
    g, c = x.T @ x, x.T @ y
    w = trend.lasso(g, c, 5.0, np.zeros(6))
    pull = c - g @ w
    assert all(abs(p) <= 5 + 1e-6 if v == 0 else abs(p - 5 * np.sign(v)) < 1e-6 for p, v in zip(pull, w, strict=True))


def test_coverage_by_rolling_origins(spark):
    """Of held-out steps 1 to 28 from several origins, the 95 % bounds hold from .9 to .98."""
    rng, rows, truth = np.random.default_rng(6), [], {}
    for k in range(60):
        n = 228
        slope = 0.1 + np.where(np.arange(n) > rng.integers(30, 120), rng.normal(0, 0.1), 0.0)
        y = 50 + np.cumsum(slope) + 4 * np.sin(2 * np.pi * np.arange(n) / 7) + rng.normal(0, 2, n)
        for origin in (170, 200):
            name = f"{k}-{origin}"
            rows += [(name, d, float(v)) for d, v in zip(days(n)[:origin], y[:origin], strict=True)]
            truth |= {(name, d): v for d, v in zip(days(n)[origin : origin + 28], y[origin : origin + 28], strict=True)}
    f = models.seasonal_forecast(spark.createDataFrame(rows, SERIES), 28).toPandas()
    inside = [r.lower <= truth[r.entity, r.ts] <= r.upper for r in f.itertuples()]
    assert len(inside) == 60 * 2 * 28 and 0.9 <= np.mean(inside) <= 0.98


def test_bounds_widen(spark):
    rng = np.random.default_rng(7)
    y = 20 + np.cumsum(np.where(np.arange(300) // 60 % 2, 0.3, -0.2)) + rng.normal(0, 0.5, 300)
    f = models.seasonal_forecast(spark.createDataFrame([("a", d, float(v)) for d, v in zip(days(300), y, strict=True)], SERIES), 120).toPandas().sort_values("ts")
    width = (f.upper - f.lower).to_numpy()
    assert width[27] > width[0] and width[119] > 1.5 * width[27]


def test_easter_and_other_rules(spark):
    from dateutil.easter import easter

    years = spark.range(1990, 2060).select(F.col("id").cast("int").alias("year"))
    got = {r.year: r.d for r in years.select("year", holidays.easter(F.col("year")).alias("d")).collect()}
    assert got == {y: easter(y) for y in range(1990, 2060)}
    us = {(r.name, r.day) for r in holidays.dates(years.where("year = 2024"), holidays.COUNTRIES["US"]).collect()}
    assert {("thanksgiving", dt.date(2024, 11, 28)), ("memorial", dt.date(2024, 5, 27)), ("labor", dt.date(2024, 9, 2)), ("martin_luther_king", dt.date(2024, 1, 15))} <= us and len(us) == 11
    for month, weekday, n in ((5, 0, -1), (11, 3, 4), (2, 6, 1)):
        for r in years.select("year", holidays.nth(month, weekday, n)(F.col("year")).alias("d")).collect():
            fit = [d for d in days(31, dt.date(r.year, month, 1)) if d.month == month and d.weekday() == weekday]
            assert r.d == (fit[-1] if n < 0 else fit[n - 1])


def test_flags_and_windows(spark):
    df = spark.createDataFrame([(d, 1) for d in (dt.date(2023, 12, 31), dt.date(2024, 1, 1), dt.date(2024, 1, 2), None)], "ts date, name int")
    rules = {"new_year": holidays.fixed(1, 1)}
    one = {r.ts: r.holiday_new_year for r in holidays.flagged(df, rules).collect()}
    assert one == {dt.date(2023, 12, 31): 0, dt.date(2024, 1, 1): 1, dt.date(2024, 1, 2): 0, None: 0}
    wide = {r.ts: r.holiday_new_year for r in holidays.flagged(df, rules, before=1, after=1).collect()}
    assert wide == {dt.date(2023, 12, 31): 1, dt.date(2024, 1, 1): 1, dt.date(2024, 1, 2): 1, None: 0}
    assert holidays.flagged(df.limit(0), rules).count() == 0


def test_holiday_effect_is_learned(spark):
    rng = np.random.default_rng(8)
    t = days(365 * 3 + 120, dt.date(2021, 1, 1))
    rules = {"easter_monday": holidays.from_easter(1), "labour": holidays.fixed(5, 1)}
    table = {r.day for r in holidays.dates(spark.range(2021, 2025).select(F.col("id").cast("int").alias("year")), {"easter_monday": rules["easter_monday"]}).collect()}
    y = [100 + 30 * (d in table) + rng.normal(0, 1) for d in t]
    cut = t.index(dt.date(2024, 3, 20))
    p = spark.createDataFrame([("a", d, float(v)) for d, v in zip(t[:cut], y[:cut], strict=True)], SERIES)
    f = models.seasonal_forecast(p, 30, rules=rules).toPandas().set_index("ts").yhat
    assert f[dt.date(2024, 4, 1)] - f.drop(dt.date(2024, 4, 1)).mean() > 20
    assert abs(f.drop(dt.date(2024, 4, 1)).mean() - 100) < 3
