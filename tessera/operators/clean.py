"""Cleaning, imputation, leakage and encoding, learned on one table and replayed on another."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import fill_missing, finite_or_null, kind_of, sentinel_to_null, strip_all
from tessera.operators.profile import column_profile, value_counts
from tessera.operators.quantiles import medians
from tessera.sources.files import roundtrip

FEW_VALUES = 100_000


def columns_of(df: DataFrame, kind: str, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind and f.name not in but]


def texts(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in but]


def clean_sentinels(df: DataFrame, target: str | None = None) -> DataFrame:
    """Texts that mean "no value" become null in all text columns but the target."""
    return df.withColumns({c: sentinel_to_null(F.col(c)) for c in texts(df, [target] if target else [])})


def clean_target(df: DataFrame, target: str, numeric: bool) -> DataFrame:
    """Sentinels become null, rows without a target go; a numeric target is cast. Raises if a value can't be cast or no row is left."""
    c = F.col(target)
    if isinstance(df.schema[target].dataType, T.StringType):
        c = sentinel_to_null(strip_all(c))
    cast = c.try_cast("double") if numeric else c
    bad, left = df.agg(F.count_if(c.isNotNull() & cast.isNull()), F.count(cast)).first()
    if bad or not left:
        raise ValueError(f"{bad} values of {target} can't be cast" if bad else f"no row has a value of {target}")
    return df.withColumn(target, cast).where(F.col(target).isNotNull())


def low_variance(df: DataFrame, protected: Sequence[str] = (), threshold: int = 1) -> list[str]:
    """Columns with at most `threshold` distinct values, null counted as one."""
    rows = column_profile(df).where(F.col("n_unique") <= threshold).select("column").collect()
    return sorted(r.column for r in rows if r.column not in protected)


def high_null(df: DataFrame, protected: Sequence[str] = (), threshold: float = 0.60) -> list[str]:
    rows = column_profile(df).where(F.col("n_null") >= threshold * F.col("n_rows")).select("column").collect()
    return sorted(r.column for r in rows if r.column not in protected)


def numeric_fills(df: DataFrame, columns: Sequence[str], strategy: str = "median") -> dict[str, float]:
    """Mean or exact median of each column without its NaNs; 0.0 where there is none."""
    if strategy not in ("mean", "median"):
        raise ValueError(f"no strategy {strategy}")
    if not columns:
        return {}
    if strategy == "mean":
        row = df.agg(*[F.avg(finite_or_null(F.col(c).cast("double"))).alias(c) for c in columns]).first()
        return {c: 0.0 if row[c] is None else float(row[c]) for c in columns}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), finite_or_null(F.col(c).cast("double")).alias("v")) for c in columns])).alias("x")).select("x.*")
    return {c: 0.0 for c in columns} | {r.column: float(r["median"]) for r in medians(long, "v", ["column"]).collect()}  # a row for each column


def mode_fills(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The most frequent text of each column (the smallest of equals, "" where there is none)."""
    if not columns:
        return {}
    counts = value_counts(df, columns).where("value IS NOT NULL")
    best = counts.groupBy("position").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b")).collect()
    return {c: "" for c in columns} | {columns[r.position]: r.b.value for r in best}


def fill(df: DataFrame, numeric: dict[str, float], text: dict[str, str]) -> DataFrame:
    return df.withColumns({c: fill_missing(F.col(c).cast("double"), v) for c, v in numeric.items()} | {c: F.coalesce(F.col(c), F.lit(v)) for c, v in text.items()})


def leaking(df: DataFrame, target: str, threshold: float = 0.995) -> DataFrame:
    """(column, corr) of numeric columns whose correlation with the target is at least the threshold."""
    cols = columns_of(df, "numeric", [target])

    def corr(c: str) -> Column:
        """Null for a constant, where the built-in function divides by zero."""
        x, y = F.when(F.col(target).isNotNull(), F.col(c).cast("double")), F.when(F.col(c).isNotNull(), F.col(target).cast("double"))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    row = df.agg(*[corr(c).alias(c) for c in cols])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("corr")) for c in cols])).alias("x")).select("x.*")
    return long.where(F.abs("corr") >= threshold)


def encode_labels(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds the number of the value among the sorted distinct values, from 0; null stays null.

    Few values are numbered in one place and broadcast; more than `FEW_VALUES` are dealt to ranges, numbered within each, and moved on by
    the sizes of the ranges before.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    if values.limit(FEW_VALUES + 1).count() <= FEW_VALUES:
        return df.join(F.broadcast(values.withColumn(to, F.row_number().over(Window.orderBy(column)) - 1)), column, "left")
    dealt = roundtrip(values.repartitionByRange(column).withColumn("__range", F.spark_partition_id()))  # kept: ranges differ from run to run
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__range").orderBy(column)) - 1
    codes = dealt.withColumn("__at", number).join(F.broadcast(before), "__range").select(column, (F.col("__at") + F.col("__before")).cast("int").alias(to))
    return df.join(codes, column, "left")


class Processor:
    """Learns drops and fills on one table and replays them on others; can be saved as JSON. A second fit is refused.

    With numeric_target set, the target is cleaned first (see clean_target). metadata holds dropped_columns, imputed_columns (with how
    many values each lacked), rows_dropped and milliseconds of the fit.
    """

    def __init__(self, target: str | None = None, protected: Sequence[str] = (), strategy: str = "median", null_threshold: float = 0.60, variance_threshold: int = 1, numeric_target: bool | None = None):
        self.numeric_target = numeric_target
        self.metadata: dict[str, object] = {}
        self.target, self.protected, self.strategy = target, tuple(protected), strategy
        self.null_threshold, self.variance_threshold = null_threshold, variance_threshold
        self.dropped: list[str] | None = None
        self.numeric: dict[str, float] = {}
        self.text: dict[str, str] = {}

    def fit(self, df: DataFrame) -> Processor:
        if self.dropped is not None:
            raise RuntimeError("this processor is fitted already")
        began, rows = time.time(), df
        df = self._cleaned(df)
        keep = [*self.protected, *([self.target] if self.target else [])]
        profile = column_profile(df).select("column", "n_rows", "n_null", "n_unique").collect()
        self.dropped = sorted(r.column for r in profile if r.column not in keep and (r.n_unique <= self.variance_threshold or r.n_null >= self.null_threshold * r.n_rows))
        left = df.drop(*self.dropped)
        self.numeric = numeric_fills(left, columns_of(left, "numeric", keep), self.strategy)
        self.text = mode_fills(left, texts(left, keep))
        filled = [*self.numeric, *self.text]
        lacking = left.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(finite_or_null(F.col(c).cast("double")).isNull() if c in self.numeric else F.col(c).isNull()).alias(c) for c in filled]).first()
        gone = rows.count() - lacking["__n"] if self.target and self.numeric_target is not None else 0
        self.metadata = {"dropped_columns": self.dropped, "imputed_columns": {c: lacking[c] for c in filled if lacking[c]}, "rows_dropped": gone, "milliseconds": round(1000 * (time.time() - began))}
        return self

    def _cleaned(self, df: DataFrame) -> DataFrame:
        df = clean_sentinels(df, self.target)
        return clean_target(df, self.target, self.numeric_target) if self.target and self.numeric_target is not None and self.target in df.columns else df

    def transform(self, df: DataFrame) -> DataFrame:
        if self.dropped is None:
            raise RuntimeError("this processor isn't fitted")
        return fill(self._cleaned(df).drop(*self.dropped), self.numeric, self.text)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> Processor:
        out = cls()
        out.__dict__.update(json.loads(text))
        return out


def parse_dates(df: DataFrame, column: str, pattern: str | None = None) -> DataFrame:
    """Text dates as timestamps; rows that can't be read go."""
    parsed: Column = F.try_to_timestamp(F.col(column), F.lit(pattern)) if pattern else F.try_to_timestamp(F.col(column))
    return df.withColumn(column, parsed).where(F.col(column).isNotNull())
