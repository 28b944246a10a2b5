"""Reading and writing tables by kind, with typed CSV, and appends."""

from __future__ import annotations

import tempfile
import uuid
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Texts of a CSV file that stand for null. Fixed values.
NULL_TOKENS = ("", "NA", "null", "N/A")
#: Rows that a CSV file's types are told from, and how a date starts.
SNIFFED, DATE = 10_000, r"^\d{4}-\d{1,2}-\d{1,2}$"


def workspace(spark: SparkSession) -> str:
    """A new folder in the place that driver and executors share; without the setting only a local master gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def sniffed(df: DataFrame, rows: int = SNIFFED) -> dict[str, str]:
    """The type of each text column by its first rows: bigint, double, boolean, date or timestamp if all values (but nulls) are such, else string."""
    first = df.limit(rows)
    kinds = ("bigint", "double", "boolean", "date", "timestamp")
    fits = {"date": lambda c: F.col(c).rlike(DATE) & F.col(c).try_cast("date").isNotNull(), "timestamp": lambda c: F.col(c).rlike(f"{DATE[:-1]}[ T]") & F.col(c).try_cast("timestamp").isNotNull()}
    test = lambda c, k: fits[k](c) if k in fits else F.col(c).try_cast(k).isNotNull()
    found = first.agg(*[F.count(c).alias(f"{i}") for i, c in enumerate(df.columns)], *[F.count_if(test(c, k)).alias(f"{i}{k}") for i, c in enumerate(df.columns) for k in kinds]).first()
    return {c: next((k for k in kinds if found[f"{i}"] and found[f"{i}{k}"] == found[f"{i}"]), "string") for i, c in enumerate(df.columns)}


def load(spark: SparkSession, path: str, kind: str | None = None, types: Mapping[str, str] | None = None) -> DataFrame:
    """A Parquet, ORC, JSON or CSV table, by the ending of its path unless kind says so.

    CSV columns are read as text, values that are exactly a null token become null, and columns are cast as `types` says, the others to
    the type that the first rows show (values that can't be cast become null).
    """
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "orc", "json"):
        return spark.read.format(kind).load(path)
    if kind != "csv":
        raise ValueError(f"can't read {path}: use csv, parquet, orc or json")
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=False, escape='"')
    text = raw.select(*[F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)).alias(c) for c in raw.columns])
    wanted = {c: t for c, t in (types or {}).items() if c in raw.columns}
    left = [c for c in raw.columns if c not in wanted]
    wanted |= sniffed(text.select(*left)) if left else {}
    return text.select(*[F.col(c).try_cast(wanted[c]).alias(c) for c in raw.columns])


def write(df: DataFrame, kind: str = "parquet") -> str:
    path = workspace(df.sparkSession)
    (df.write.csv(path, header=True, escape='"') if kind == "csv" else df.write.format(kind).save(path))
    return path


def roundtrip(df: DataFrame, kind: str = "parquet") -> DataFrame:
    return load(df.sparkSession, write(df, kind), kind)


def append(df: DataFrame, more: DataFrame) -> DataFrame:
    """Writes df, appends more to it, and reads both back."""
    path = write(df)
    more.select(df.columns).write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)
