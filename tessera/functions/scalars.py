"""Column functions that the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that mean "no value", compared after trimming and lower-casing. Fixed values.
SENTINELS = ("unknown", "none", "na", "n/a", "null", "nan", "nil", "missing", "undefined", "?", "-", "--", "not available", "not applicable", "n.a.", "")
#: Masking rules in the order in which they apply: name, pattern, replacement. Fixed values.
MASKS = (
    ("email", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "[REDACTED-EMAIL]"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED-IP]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED-SSN]"),
    ("credit_card", r"\b(?:\d[ -]?){13,16}\b", "[REDACTED-CC]"),
    ("bearer_token", r"(?i)Bearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer [REDACTED-TOKEN]"),
    ("api_key", r"(?i)(api[_-]?key|token|secret|password)\s*[=:]\s*\S+", "$1=[REDACTED]"),
)
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def strip_all(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sentinel_to_null(c: Column, sentinels: Iterable[str] = SENTINELS) -> Column:
    return F.when(F.lower(strip_all(c)).isin(*sentinels), F.lit(None)).otherwise(c)


def fill_missing(c: Column, value) -> Column:
    """Nulls and NaNs become value."""
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(value))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def iso_weekday(c: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(c) + 1


def model_name(c: Column) -> Column:
    """The last part of a path without its .parquet ending."""
    return F.replace(F.replace(F.substring_index(c, "/", -1), F.lit(".parquet_"), F.lit("_")), F.lit(".parquet"), F.lit(""))


def mask_text(c: Column) -> Column:
    for _, pattern, to in MASKS:
        c = F.regexp_replace(c, pattern, to)
    return c


def request_key(model: Column, version: Column, features: Mapping[str, Column]) -> Column:
    """SHA-256 of the canonical text of a request: model, version ("latest" if null), features in order of their names."""
    parts = [F.lit("model="), model, F.lit("|version="), F.coalesce(version, F.lit("latest"))]
    for k in sorted(features):
        parts += [F.lit(f"|{k}="), F.coalesce(features[k].cast("string"), F.lit("null"))]
    return F.sha2(F.concat(*parts), 256)


def kind_of(data_type: T.DataType) -> str:
    """numeric, categorical (text, boolean), datetime or other."""
    if isinstance(data_type, NUMERIC):
        return "numeric"
    if isinstance(data_type, TEMPORAL):
        return "datetime"
    return "categorical" if isinstance(data_type, (T.StringType, T.BooleanType)) else "other"


def registration(name: Column) -> tuple[Column, Column]:
    """(model name, data key) of a registration path; names without a dataset folder stay, with no key."""
    is_path = F.contains(name, F.lit("datasets/"))
    key = F.regexp_extract(name, r"^(.*\.parquet)", 1)
    suffix = F.when(F.contains(name, F.lit(".parquet_")), F.substring_index(name, ".parquet_", -1)).otherwise("model")
    base = F.replace(F.substring_index(key, "/", -1), F.lit(".parquet"), F.lit(""))
    model = F.when(F.length(base) > 25, F.concat(F.lit("auto_"), suffix, F.lit("_model"))).otherwise(F.concat(base, F.lit("_"), suffix))
    return F.when(is_path, model).otherwise(name), F.when(is_path, key)
