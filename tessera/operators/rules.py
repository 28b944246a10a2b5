"""Row rules for request, job and upload tables; job histories; gates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed transitions of a job's state; terminal states have none. Fixed values.
TRANSITIONS = {
    "uploaded": ("validated", "failed", "cancelled"),
    "validated": ("queued", "failed", "cancelled"),
    "queued": ("running", "failed", "cancelled"),
    "running": ("completed", "failed", "cancelled"),
    "completed": (),
    "failed": (),
    "cancelled": (),
}
#: Formats and limits of requests, jobs and uploads. Fixed values.
NAME, VERSION = r"^[a-zA-Z0-9_\-]+$", r"^\d+\.\d+\.\d+(-[a-zA-Z0-9]+)?$|^latest$|^staging$|^production$"
UUID, JOB_VERSION = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^\d+\.\d+\.\d+(-[a-zA-Z0-9]+)?$"
IDEMPOTENCY_KEY = r"^[\x21-\x7E]{16,128}$"
MOST_FEATURES, MOST_KEY, MOST_BATCH, MOST_NAME, MOST_MB = 500, 128, 1000, 128, 200
UTC = r"(Z|[+-]00:?00)$"
UPLOAD_TYPES = ("csv", "parquet", "excel")


def violations(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that a row breaks; a rule that gives null counts as broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()]))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with their violations."""
    checked = df.withColumn("violations", violations(rules))
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def request_rules(model: Column, version: Column, n_features: Column, longest_key: Column, batch: Column) -> dict[str, Column]:
    return {
        "bad_model_name": model.rlike(NAME) & (F.length(model) <= MOST_NAME),
        "bad_version": version.isNull() | version.rlike(VERSION),
        "no_features": n_features > 0,
        "too_many_features": n_features <= MOST_FEATURES,
        "long_feature_name": longest_key <= MOST_KEY,
        "bad_batch": batch.between(1, MOST_BATCH),
    }


def job_rules(job_id: Column, version: Column, key: Column, filename: Column, column: Column, progress: Column, created: Column | None = None) -> dict[str, Column]:
    return {
        "bad_job_id": job_id.rlike(UUID),
        "bad_version": version.isNull() | (version.rlike(JOB_VERSION) & (F.length(version) <= 32)),
        "bad_key": key.isNull() | key.rlike(IDEMPOTENCY_KEY),
        "bad_filename": F.length(filename).between(1, 255) & filename.rlike(r"^[A-Za-z0-9_. \-]+$"),
        "bad_column": column.isNull() | (F.length(column).between(1, 128) & ~column.rlike(r"[\x00-\x1F\x7F]")),
        "bad_progress": progress.between(0, 100),
    } | ({} if created is None else {"not_utc": created.isNull() | created.rlike(UTC)})


def upload_rules(kind: Column, mb: Column, filename: Column, n_files: Column | None = None, merged: Column | None = None) -> dict[str, Column]:
    """merged says whether the upload has a merge configuration: it needs one with two files, and has none otherwise."""
    rules = {"bad_type": kind.isin(*UPLOAD_TYPES), "bad_size": (mb > 0) & (mb <= MOST_MB), "bad_filename": (F.length(filename) >= 3) & F.contains(filename, F.lit("."))}
    return rules if n_files is None or merged is None else rules | {"bad_merge": (n_files == 2) == merged}


def flapping(df: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """(key, n, changes, flapping): a key flaps if its status changes in more than half of its snapshots."""
    was = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    per = df.withColumn("__was", was).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__was").isNotNull() & (F.col("__was") != F.col(status))).alias("changes"))
    return per.withColumn("flapping", F.col("changes") > F.floor(F.col("n") / 2))


def illegal_transitions(df: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The rows whose state doesn't follow from the one before, with was and status. The table of transitions is fixed."""
    pairs = [(a, b) for a, to in TRANSITIONS.items() for b in to]
    allowed = F.broadcast(df.sparkSession.createDataFrame(pairs, f"was string, {status} string"))
    moved = df.withColumn("was", F.lag(status).over(Window.partitionBy(key).orderBy(*order))).where(F.col("was").isNotNull() & (F.col("was") != F.col(status)))
    return moved.join(allowed, ["was", status], "left_anti")


def gates(df: DataFrame, quality: str = "quality", drift: str = "drift", performance: str = "performance", seconds: str = "seconds", failures: str = "failures") -> DataFrame:
    """Adds a boolean for each gate and passed. Limits: quality at least .4, drift at most .3, performance at least .5, 600 s, fewer than 5 failures."""
    g = {"quality_ok": F.col(quality) >= 0.4, "drift_ok": F.col(drift) <= 0.3, "performance_ok": F.col(performance) >= 0.5, "time_ok": F.col(seconds) <= 600, "failures_ok": F.col(failures) < 5}
    passed = F.lit(True)
    for c in g:
        passed = passed & F.col(c)
    return df.withColumns(g).withColumn("passed", passed)


def enforce(gated: DataFrame) -> DataFrame:
    """The rows of gates(), if all passed; raises with the gates of the first that didn't."""
    bad = gated.where("NOT passed").limit(1).collect()
    if bad:
        raise ValueError("gates failed: " + ", ".join(c for c in gated.columns if c.endswith("_ok") and not bad[0][c]))
    return gated
