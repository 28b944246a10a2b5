"""What the operators share: words, scratch tables in the shared folder, small column helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """(row, id, hash) of each row: all its columns as one, so that no name clashes with those of a join, its doc_id and the hash of its text."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("hash"))


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir. Where it is unset, a local master gets one of its own; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        folder = _OWN[app]
    return folder.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/tessera-{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str = "table") -> DataFrame:
    """Writes a table to the shared folder and reads it back: the lineage ends there, so a lost executor costs a read. The files go with the application."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*settled: DataFrame) -> None:
    """Deletes the files of settled tables that nothing reads any more."""
    for df in settled:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that nothing reads any more: it does so when the driver collects its garbage, which is seldom if there is little."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, also where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    """The words of a text (null: none)."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.filter(parts, lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words, from the number of splits less the empty ends."""
    return bind(
        F.split(F.coalesce(text, F.lit("")), SPACES),
        lambda w: F.size(w) - (F.get(w, F.lit(0)) == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int"),
    ).cast("long")


def sql_bytes(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
