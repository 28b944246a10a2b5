"""Row-wise features: calendar parts, cycles, interactions, logarithms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import iso_weekday, kind_of


def _must_be_date(df: DataFrame, ts: str) -> None:
    if ts not in df.columns:
        raise ValueError(f"no such column: {ts}")
    if kind_of(df.schema[ts].dataType) != "datetime":
        raise TypeError(f"{ts} is no date or timestamp")


def calendar(df: DataFrame, ts: str, high: bool = False, weekend: bool = True, cyclic: bool = False) -> DataFrame:
    """Adds year, month, day, weekday (Monday 1), is_weekend; hour and minute if high; sines and cosines of month and weekday if cyclic."""
    _must_be_date(df, ts)
    c = F.col(ts)
    cols = {f"{ts}_year": F.year(c), f"{ts}_month": F.month(c), f"{ts}_day": F.dayofmonth(c), f"{ts}_weekday": iso_weekday(c)}
    if high:
        cols |= {f"{ts}_hour": F.hour(c), f"{ts}_minute": F.minute(c)}
    if weekend:
        cols[f"{ts}_is_weekend"] = iso_weekday(c) >= 6
    if cyclic:
        for part, value, period in (("month", F.month(c), 12), ("weekday", iso_weekday(c), 7)):
            angle = value * (2 * math.pi / period)
            cols |= {f"{ts}_{part}_sin": F.sin(angle), f"{ts}_{part}_cos": F.cos(angle)}
    return df.withColumns(cols)


def expand_date(df: DataFrame, ts: str) -> DataFrame:
    """Calendar parts with the day of the year in place of the date."""
    return calendar(df, ts, weekend=False).withColumn(f"{ts}_day_of_year", F.dayofyear(ts)).drop(ts)


def interactions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Products of the first column with the next two."""
    return df.withColumns({f"{columns[0]}_x_{c}": F.col(columns[0]) * F.col(c) for c in columns[1:3]}) if len(columns) > 1 else df


def safe_logs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds c_log for each column whose values are all positive; one pass finds which."""
    if not columns:
        return df
    least = df.agg(*[F.min(c).alias(c) for c in columns]).first()
    return df.withColumns({f"{c}_log": F.ln(c) for c in columns if least[c] is not None and least[c] > 0})


def engineered(df: DataFrame, target: str | None = None) -> DataFrame:
    numeric = [f.name for f in df.schema.fields if kind_of(f.dataType) == "numeric" and f.name != target]
    dates = [f.name for f in df.schema.fields if kind_of(f.dataType) == "datetime"]
    for ts in dates:
        df = calendar(df, ts, weekend=False)
    return safe_logs(interactions(df, numeric), numeric)
