"""Merging, appending, upserting and looking up tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A side up to so many rows is sent to all tasks; a larger one is joined by shuffling.
SMALL = 100_000


def merge(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner") -> DataFrame:
    """An equi-join of two tables with one key column (named left_on; right_on for a right join) and clashing names suffixed _right."""
    kinds = {"inner": "inner", "left": "left", "right": "right", "outer": "full_outer"}
    if how not in kinds:
        raise ValueError(f"how must be one of {sorted(kinds)}")
    renamed = right.select(*[F.col(c).alias("__key" if c == right_on else f"{c}_right" if c in left.columns else c) for c in right.columns])
    joined = left.join(renamed, left[left_on] == renamed["__key"], kinds[how])
    if how == "outer":
        return joined.withColumn(left_on, F.coalesce(left_on, "__key")).drop("__key")
    return joined.drop(left_on).withColumnRenamed("__key", right_on) if how == "right" else joined.drop("__key")


def append_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with rows below; raises unless both have the same columns."""
    if set(table.columns) != set(rows.columns):
        raise ValueError(f"columns differ: {sorted(set(table.columns) ^ set(rows.columns))}")
    return table.unionByName(rows)


def upsert(table: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """table with rows written over it: of several rows of a key the last by `order` counts, and only columns that rows have change."""
    last = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("__n = 1").drop("__n")
    new = last.select(*[F.col(c).alias(f"__{c}") for c in last.columns])
    both = table.join(new, table[key] == new[f"__{key}"], "full_outer")
    hit = F.col(f"__{key}").isNotNull()
    return both.select(*[F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in last.columns else F.col(c) for c in table.columns])


def lookup(rows: DataFrame, dim: DataFrame, key: str, value: str, default) -> DataFrame:
    """rows with dim's value of each key, or the default. A dim of at most SMALL rows is broadcast."""
    side = dim.select(key, value)
    side = F.broadcast(side) if side.limit(SMALL + 1).count() <= SMALL else side
    return rows.join(side, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def distinct_ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("id")).dropna().distinct()


def missing_keys(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted but not there."""
    return wanted.select(key).distinct().join(there.select(key), key, "left_anti")


def top_k(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)
