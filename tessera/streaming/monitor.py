"""Streaming monitors: hourly counts, feedback errors, drift of each micro-batch and of all that came."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators import drift


def source(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file, ts as a timestamp with a zone."""
    there = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(there.schema)
    alone = all(f.rpartition("/")[2] == name for f in there.inputFiles())
    df = reader.option("pathGlobFilter", name).parquet(folder) if alone else reader.parquet(path)
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def hourly(stream: DataFrame, model: str, latency: str, late: str = "1 hour") -> DataFrame:
    """(hour, model, n, avg_latency) in hourly windows, closed when the watermark has passed."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), F.col(model).alias("model"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(latency).alias("avg_latency")).select(F.col("w.start").alias("hour"), "model", "n", "avg_latency")


def feedback(stream: DataFrame, request: str, model: str, y: str, yhat: str, late: str = "1 hour") -> DataFrame:
    """(model, n, mae, mse) as feedback arrives; a request counts once."""
    e = F.col(y) - F.col(yhat)
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([request])
    return once.groupBy(F.col(model).alias("model")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))


def drift_of_batches(stream: DataFrame, reference: DataFrame, columns: Sequence[str], out: str, threshold: float = 0.05) -> Callable[[str], StreamingQuery]:
    """Appends to `out` a drift row for each column of each micro-batch. A batch that is run again writes the same folder again."""

    def one(batch: DataFrame, number: int) -> None:
        drift.report(reference, batch, columns, threshold).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/run={number}")

    return lambda checkpoint: stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drift_so_far(stream: DataFrame, reference: drift.Reference, out: str, threshold: float = 0.05) -> Callable[[str], StreamingQuery]:
    """Writes to `out`, after each micro-batch, the drift of all that has come from a reference that was counted once.

    What is kept between batches is the count of each bin, in the stream's state: it survives a restart from the checkpoint, is added up
    within tasks before it moves, and doesn't grow. No batch reads the reference's rows, or earlier ones of the stream.
    """
    counts = drift.in_bins(stream, reference.edges).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("b"))

    def one(batch: DataFrame, number: int) -> None:
        drift.report_of_bins(reference, batch, threshold).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/run={number}")

    return lambda checkpoint: counts.writeStream.outputMode("complete").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote: appended rows, or the last state of each key."""
    spark = df.sparkSession
    if mode == "append":
        df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/run={number}")

    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*df.schema.fields, StructField("batch", IntegerType())])).parquet(out)
