"""Registration of queries: a function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The panel of daily quantities by return flag.
PANEL = "(SELECT l_returnflag AS entity, CAST(l_shipdate AS DATE) AS ts, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2)"
#: A registry: a version of a model for each order of a priority.
REGISTRY = "(SELECT o_orderpriority AS model, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS version, CASE o_orderstatus WHEN 'F' THEN 'production' WHEN 'O' THEN 'staging' ELSE 'archived' END AS stage, o_totalprice AS metric FROM orders)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import panel as p

    return p.build(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_shipdate", "l_quantity")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    version = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")).cast("long")
    stage = F.when(F.col("o_orderstatus") == "F", "production").when(F.col("o_orderstatus") == "O", "staging").otherwise("archived")
    return o.select(F.col("o_orderpriority").alias("model"), version.alias("version"), stage.alias("stage"), F.col("o_totalprice").alias("metric"))


def half_up(c: Column | str, digits: int = 4) -> Column:
    """Rounds the scaled double itself, where `round` goes by its shortest decimal form; for values of at least 0."""
    x = F.col(c) if isinstance(c, str) else c
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round(c, digits)
