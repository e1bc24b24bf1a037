"""Structured Streaming over event feeds. Each query has a batch twin with the same result on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str | None = "1 day", slide: str | None = None) -> DataFrame:
    """Events by window and type: n and total. On a stream, windows close `late` after the newest event."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late and events.isStreaming else rows
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user_id, start, n: bursts of a user's events with no longer gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, total so far (complete or update mode)."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def upsert_into(path: str, key: str):
    """A foreachBatch function that upserts each micro-batch into a Parquet table by writing the next
    version beside it: versions are folders path/v=<batch>, the newest complete one counts. A batch
    that runs again overwrites its own version from the one before."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        from tallyline.sources.matches import upsert

        spark = batch.sparkSession
        before = latest(spark, path, below=batch_id)
        out = batch if before is None else upsert(before, batch, key)
        out.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return apply


def latest(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[2:]))
    found = [v for v in found if below is None or v < below]
    return spark.read.parquet(f"{path}/v={max(found)}") if found else None
