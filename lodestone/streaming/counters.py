"""Live counters, retention and rate windows over an event stream (Structured Streaming)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Used only where a session on this machine alone names no shared folder, as in tests.
OWN_FOLDER = "file:///tmp/checkpoints"


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; without it, a cluster raises ValueError."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name the folder that driver and executors share")
        shared = OWN_FOLDER
    return f"{shared.rstrip('/')}/lodestone/{label}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """The events of a table, one file or a folder of part files, as a stream; ``ts`` is a timestamp.

    A replay takes all there is in one micro-batch, so a watermark that one
    file moves on makes no row of another late. ``files_per_trigger`` is for
    files that arrive in the order of their times.
    """
    path = f"{folder}/{name}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern, the path may be a file or a folder
    raw = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def session_counters(events: DataFrame) -> DataFrame:
    """Running totals of each session (user): events, value, errors, last seen. Update or complete mode."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").alias("last_seen"))


def windowed_counts(events: DataFrame, span: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by event-time window and type; state older than the watermark is dropped (an extension of the live counters)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", span), "event_type").agg(F.count("*").alias("n"))


def busy_users(events: DataFrame, limit: int = 5, span: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Users with ``limit`` or more events in one window: the windowed form of a rate limit."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", span), "user_id").agg(F.count("*").alias("n")).where(F.col("n") >= limit)


def first_seen(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Events without repeats of an id within the watermark: the state of an id expires after ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def retained(events: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``."""
    return events.where(F.col("ts") >= F.expr(f"timestamp'{as_of}' - interval {days} days"))


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is now and return its result, which executors write to the shared folder.

    In complete mode the last micro-batch is the result; in append mode all are.
    """
    spark = stream.sparkSession
    home = new_folder(spark, "stream")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{home}/out" if mode == "complete" else f"{home}/out/batch={batch}")

    run = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{home}/at").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def sink_batches(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch under its number, so that a repeated batch overwrites itself; ``checkpoint`` lets a restart go on."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append each event, as it is, to a log in folders by day and micro-batch; a batch that runs again overwrites its own entries only."""

    def write(df: DataFrame, batch: int) -> None:
        dated = df.withColumn("day", F.to_date("ts")).withColumn("batch", F.lit(batch))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a log, each with its ``day``; days are folders, so a span of days reads no others."""
    return spark.read.parquet(path).drop("batch")
