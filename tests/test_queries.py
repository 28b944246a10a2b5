"""Each query that SQL can express gives the rows that its SQL gives on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(df):
    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "null"
        return f"{float(v):.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, db, name):
    got, want = plans.QUERIES[name](spark, DATA).toPandas(), db.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_model_roundtrip_scores_sets_of_features(spark):
    """Both models score each set of features once, all rows count, and no rows are joined by key."""
    from tessera.plans import modelling

    d = "/root/testdata/sf0.001"
    got = modelling.model_roundtrip(spark, d)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "xxhash64" not in plan  # lines with their parts
    r = got.first()
    assert r.n == modelling._rows(spark, d).count() and r.most == 0
