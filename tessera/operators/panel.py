"""Panels: one row for each entity and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAGS, WINDOWS = (1, 7, 14, 28), (7, 14, 28)


def build(df: DataFrame, entity: str, ts: str, target: str) -> DataFrame:
    """(entity, ts, y): the sum of the target for each entity and day; rows with a null, or a value that can't be read, go."""
    missing = {entity, ts, target} - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    rows = df.select(F.col(entity).cast("string").alias("entity"), F.col(ts).cast("date").alias("ts"), F.col(target).cast("string").try_cast("double").alias("y") if dict(df.dtypes)[target] == "string" else F.col(target).cast("double").alias("y"))
    return rows.dropna().groupBy("entity", "ts").agg(F.sum("y").alias("y"))


def guard(panel: DataFrame, entity: str = "entity", ts: str = "ts", y: str = "y", least_rows: int = 0, strict: bool = True) -> DataFrame:
    """One row: n_rows, null_entities, n_entities, repeated_keys. Raises on missing columns, on times and values of a wrong type, and (strict) on null entities, repeated keys, no entity, or fewer than least_rows rows."""
    missing = {entity, ts, y} - set(panel.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    if not isinstance(panel.schema[ts].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{ts} is no date or time")
    if not isinstance(panel.schema[y].dataType, T.NumericType):
        raise TypeError(f"{y} is no number")
    keys = panel.groupBy(F.col(entity).alias("entity"), F.col(ts).alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    of_entity = keys.groupBy("entity").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("more"))
    counts = of_entity.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("entity").isNull(), F.col("n"))), F.lit(0)).alias("null_entities"), F.count("entity").alias("n_entities"), F.coalesce(F.sum("more"), F.lit(0)).alias("repeated_keys"))
    if strict:
        got = counts.first()
        if got.null_entities or got.repeated_keys or not got.n_entities or got.n_rows < least_rows:
            raise ValueError(f"panel refused: {got.n_rows} rows, {got.n_entities} entities, {got.null_entities} rows without an entity, {got.repeated_keys} repeated keys")
    return counts


def scaled(panel: DataFrame, floor: float = 1e-3) -> DataFrame:
    """Adds scale, max(mean of the entity, floor), and y_scaled."""
    scale = F.greatest(F.avg("y").over(Window.partitionBy("entity")), F.lit(floor))
    return panel.withColumn("scale", scale).withColumn("y_scaled", F.col("y") / F.col("scale"))


def duplicate_keys(df: DataFrame, entity: str, ts: str) -> DataFrame:
    return df.groupBy(F.col(entity).alias("entity"), F.col(ts).alias("ts")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def insufficient(panel: DataFrame, needed: int = max(LAGS + WINDOWS)) -> DataFrame:
    return panel.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= needed)


def cadence(panel: DataFrame) -> DataFrame:
    """One row: the most frequent gap in days between an entity's successive dates (the smaller of equals, 1 at least)."""
    gap = F.datediff("ts", F.lag("ts").over(Window.partitionBy("entity").orderBy("ts")))
    gaps = panel.select("entity", "ts").distinct().select(gap.alias("gap")).where("gap IS NOT NULL").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    return gaps.orderBy(F.desc("n"), "gap").limit(1).select(F.greatest(F.col("gap"), F.lit(1)).alias("step_days"), F.col("n").alias("n_gaps"))


def tail(panel: DataFrame, n: int = max(LAGS) + max(WINDOWS) + 2) -> DataFrame:
    """The last n rows of each entity."""
    return panel.withColumn("__n", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("ts")))).where(F.col("__n") <= n).drop("__n")


def lagged(panel: DataFrame, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS, y: str = "y") -> DataFrame:
    """Adds y_lag_k and y_roll_w: values k rows before, and means of the w rows before; null until there are that many. One shuffle, one sort."""
    w = Window.partitionBy("entity").orderBy("ts")
    cols = {f"{y}_lag_{k}": F.lag(y, k).over(w) for k in lags}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        cols[f"{y}_roll_{n}"] = F.when(F.count(y).over(frame) == n, F.avg(y).over(frame))
    return panel.withColumns(cols)


def supervised(panel: DataFrame, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS, y: str = "y") -> DataFrame:
    """Lags, rolling means and calendar columns; rows without a full history go."""
    f = lagged(panel, lags, windows, y)
    f = f.withColumns({"cal_year": F.year("ts"), "cal_month": F.month("ts"), "cal_day": F.dayofmonth("ts"), "cal_weekday": F.weekday("ts") + 1, "cal_day_of_year": F.dayofyear("ts")})
    return f.dropna(subset=[c for c in f.columns if c.startswith((f"{y}_lag_", f"{y}_roll_"))])


#: Frequencies of a future frame, as intervals.
FREQUENCIES = {"h": "make_interval(0, 0, 0, 0, 1)", "D": "make_interval(0, 0, 0, 1)", "W": "make_interval(0, 0, 1)", "MS": "make_interval(0, 1)", "QS": "make_interval(0, 3)", "YS": "make_interval(1)"}


def future(panel: DataFrame, periods: int, step_days: int = 1, freq: str = "D", history: bool = False) -> DataFrame:
    """(entity, ts, step) of the `periods` times after each entity's last: every step_days days (D), hours (h), weeks (W), or starts of months, quarters or years (MS, QS, YS).

    history puts the entity's own times before them, as steps 0 and less, the last of them 0.
    """
    kind = panel.schema["ts"].dataType.simpleString()
    if freq not in FREQUENCIES or (freq == "h" and kind == "date"):
        raise ValueError(f"no frequency {freq} for times of type {kind}")
    last = panel.groupBy("entity").agg(F.max("ts").alias("last"))
    if freq in ("MS", "QS", "YS"):
        last = last.withColumn("last", F.date_trunc({"MS": "month", "QS": "quarter", "YS": "year"}[freq], "last"))
    ahead = last.select("entity", "last", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))
    step = F.expr(FREQUENCIES[freq]) * F.col("step") * (step_days if freq == "D" else 1)
    ahead = ahead.select("entity", (F.col("last").cast("timestamp_ntz") + step).cast(kind).alias("ts"), "step")
    if not history:
        return ahead
    own = panel.select("entity", "ts", (1 - F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("ts")))).alias("step"))
    return own.unionByName(ahead)
