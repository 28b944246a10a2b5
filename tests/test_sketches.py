"""Error bounds of sketched profiles on unique, skewed and empty columns, and of merged runs."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tessera.operators import profile, sketches


def frame(n, seed):
    rng = np.random.default_rng(seed)
    skewed = rng.zipf(1.4, n).clip(max=10**6)
    return pd.DataFrame({"unique": np.arange(n) + seed * 10**9, "skewed": skewed, "same": "x", "gone": [None if i % 4 == 0 else str(i % 3) for i in range(n)]})


def bounds_hold(found, tables, kept):
    t = pd.concat(tables)
    for r in found.collect():
        true = Counter(map(str, t[r.column].dropna()))
        assert (r.n_rows, r.n_null) == (len(t), int(t[r.column].isna().sum())) and r.lost <= len(t) / kept
        heavy = {h.value: h.n for h in r.heavy}
        assert len(heavy) <= kept and all(n <= true[v] <= n + r.lost for v, n in heavy.items())
        assert all(n <= r.lost for v, n in true.items() if v not in heavy)


def test_bounds(spark):
    t = frame(20_000, 1)
    df = spark.createDataFrame(t).repartition(5)
    s = sketches.sketch(df, kept=50)
    bounds_hold(s, [t], 50)
    got = {r.column: r for r in sketches.estimates(s).collect()}
    exact = {r.column: r for r in profile.column_profile(df).collect()}
    for c in t.columns:
        assert got[c].n_unique == pytest.approx(exact[c].n_unique, rel=0.06)
    for c in ("skewed", "same"):
        assert got[c].top_n <= exact[c].top_n <= got[c].top_most
    assert got["skewed"].top_value == "1" and got["same"].top_n == 20_000 and got["gone"].n_unique == 4


def test_runs_merge(spark):
    tables = [frame(n, k) for k, n in enumerate((3000, 50, 8000))]
    runs = [sketches.sketch(spark.createDataFrame(t), kept=40) for t in tables]
    both = sketches.merged(*runs, kept=40)
    bounds_hold(both, tables, 40)
    assert {r.column: r.n_unique for r in sketches.estimates(both).collect()}["unique"] == pytest.approx(11_050, rel=0.06)


def test_empty(spark):
    empty = sketches.sketch(spark.createDataFrame(frame(5, 0)).limit(0))
    assert {(r.column, r.n_rows, r.n_unique, r.top_n) for r in sketches.estimates(empty).collect()} == {(c, 0, 0, None) for c in ("unique", "skewed", "same", "gone")}
    one = sketches.sketch(spark.createDataFrame(frame(5, 0)))
    assert {r.column: r.n_rows for r in sketches.merged(empty, one).collect()} == {c: 5 for c in ("unique", "skewed", "same", "gone")}
