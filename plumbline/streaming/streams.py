"""Structured Streaming over a folder of Parquet files, with batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_folder(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def inserts(changes: DataFrame, action: str = "action") -> DataFrame:
    """Append-only view of a change feed; the same plan serves batch and stream."""
    return changes.filter(F.col(action) == "INSERT").drop(action)


def daily_counts(events: DataFrame, ts: str = "ts", status: str = "event_type", late: str | None = None) -> DataFrame:
    """(day, status, n, value) per event-time day. A stream needs ``late``, its watermark."""
    src = events.withWatermark(ts, late) if late else events
    return (
        src.groupBy(F.window(ts, "1 day").alias("w"), F.col(status).alias("status"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("day"), "status", "n", "value")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available and return the written table.

    Append mode goes to a Parquet sink with exactly-once files; complete mode rewrites the result
    table with each batch.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(path)
    else:
        def store(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        query = writer.outputMode("complete").foreachBatch(store).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
