"""Drift from a reference that is counted once, in batches and as a stream's state."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import drift
from tessera.streaming import monitor


def frame(spark, n, off, seed):
    rng = np.random.default_rng(seed)
    df = spark.createDataFrame(pd.DataFrame({"v": rng.normal(off, 1, n), "w": rng.integers(0, 5, n).astype(float)}))
    return df.withColumns({"v": F.when(F.col("v") < 3, F.col("v")), "ts": F.current_timestamp()})


def rows(df):
    return {r.feature: (r.n_ref, r.n_cur, round(r.ks, 9), round(r.p_value, 9), r.drifted, round(r.psi, 9), round(r.js, 9)) for r in df.collect()}


def test_bins_against_the_whole(spark):
    a, b = frame(spark, 3000, 0, 1), frame(spark, 2000, 0.3, 2)
    reference = drift.counted_reference(a, ["v", "w", "v"])
    counts = drift.in_bins(b, reference.edges).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("b"))
    got = {r.feature: r for r in drift.report_of_bins(reference, counts).collect()}
    want = {r.feature: r for r in drift.ks(drift.long_form(a, b, ["v", "w"])).collect()}
    assert set(got) == {"v", "w"} and got["v"].drifted
    for f in got:
        assert (got[f].n_ref, got[f].n_cur) == (want[f].n_ref, want[f].n_cur)
        assert 0 <= want[f].ks - got[f].ks < 0.01
    assert got["w"].ks == pytest.approx(want["w"].ks)  # every value is an edge
    assert drift.report_of_bins(reference, counts.limit(0)).count() == 0


def test_state_equals_the_batch_and_survives_a_restart(spark, tmp_path):
    a = frame(spark, 2000, 0, 1)
    reference = drift.counted_reference(a, ["v", "w"], bins=32)
    parts = [frame(spark, 700, 0.1 * k, 10 + k) for k in range(3)]
    seen = None
    for k, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # Each round starts a new query from the checkpoint of the one before.
        monitor.drift_so_far(monitor.source(spark, f"{tmp_path}/in"), reference, f"{tmp_path}/out")(f"{tmp_path}/state").awaitTermination()
        seen = p if seen is None else seen.union(p)
        counts = drift.in_bins(seen, reference.edges).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("b"))
        got = spark.read.parquet(f"{tmp_path}/out")
        assert got.agg(F.max("batch")).first()[0] == k
        assert rows(got.where(F.col("batch") == k)) == rows(drift.report_of_bins(reference, counts))
