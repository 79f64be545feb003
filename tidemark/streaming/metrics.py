"""Running counts and hourly metrics as versioned update logs.

Update-mode results are written per micro-batch under ``batch_id=N``.  A
replayed batch overwrites its own folder, and readers take each key's newest
version, so the table is right after any restart and never waits for a window
to close.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import floor_hour, wall_clock, wall_instant
from tidemark.operators import latest_rows
from tidemark.streaming.ingest import LATENESS


def _log_updates(stream: DataFrame, target: str, checkpoint: str, once: bool,
                 interval: str) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def latest_versions(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """Current state of an update log: the newest row of each key."""
    log = spark.read.parquet(target)
    packed = log.withColumn("_key", F.struct(*keys))
    return latest_rows(packed, "_key", "batch_id", ties=False).drop("_key", "batch_id")


def compact_updates(spark: SparkSession, target: str, keys: Sequence[str]) -> int:
    """Make one folder of an update log: the newest row of each key, under the newest batch id.

    The rows are written under a name that readers do not list, which is then
    renamed; a run that dies before leaves nothing a later one stumbles over.
    The new folder's name pads the id with zeros, which reads as the same
    number: until the folders it stands for are deleted, a reader finds equal
    rows in both.  Run it between batches, when no reader is at work; returns
    the number of folders deleted.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(target)
    system = files.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f.getPath() for f in system.listStatus(files) if f.getPath().getName().startswith("batch_id=")]
    if len(folders) < 2:
        return 0
    newest = max(int(f.getName().partition("=")[2]) for f in folders)
    width = max(len(f.getName().partition("=")[2]) for f in folders) + 1
    hidden = f"{target}/_compacting-{uuid.uuid4().hex}"
    latest_versions(spark, target, keys).write.parquet(hidden)
    if not system.rename(hadoop(hidden), hadoop(f"{target}/batch_id={newest:0{width}d}")):
        raise OSError(f"cannot rename {hidden}")
    for folder in folders:
        system.delete(folder, True)
    return len(folders)


def live_counts(events: DataFrame, target: str, checkpoint: str, once: bool = True,
                interval: str = "1 minute") -> StreamingQuery:
    """Running event count per type."""
    counts = events.groupBy("event_type").agg(F.count("*").alias("events"))
    return _log_updates(counts, target, checkpoint, once, interval)


def live_windows(events: DataFrame, target: str, checkpoint: str, width: str = "10 minutes",
                 lateness: str = LATENESS, once: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Event count per tumbling window; state ends with the watermark."""
    timed = events.withColumn("_event_time", wall_instant(F.col("event_timestamp")))
    counts = timed.withWatermark("_event_time", lateness).groupBy(F.window("_event_time", width)).agg(
        F.count("*").alias("events")
    ).select(wall_clock(F.col("window.start")).alias("window_start"), "events")
    return _log_updates(counts, target, checkpoint, once, interval)


def recent_events(events: DataFrame, since) -> DataFrame:
    """Newest-first view over the ingested table, from ``since`` on."""
    return events.filter(F.col("event_timestamp") >= since).orderBy(
        F.col("event_timestamp").desc(), "event_id")


def monitored_stream(predictions: DataFrame, store: DataFrame, features: Sequence[str]) -> DataFrame:
    """Labelled prediction stream enriched from the (static) feature table.

    The static side is read anew in each micro-batch, so a rewritten store is
    picked up without a restart.
    """
    labelled = predictions.filter(F.col("actual_conversion").isNotNull())
    return labelled.join(store.select("client_id", *features), "client_id", "left").withColumn(
        "monitor_hour", floor_hour(F.col("monitor_timestamp")))


def refresh_monitored(stream: DataFrame, target: str, checkpoint: str, once: bool = True,
                      lag: str = "1 hour") -> StreamingQuery:
    """The self-refreshing table: append with at most ``lag`` delay."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=lag)
    return writer.start(target)


def live_hourly_performance(monitored: DataFrame, target: str, checkpoint: str,
                            lateness: str = LATENESS, once: bool = True,
                            interval: str = "1 hour") -> StreamingQuery:
    """Hourly confusion counts of a monitored-prediction stream.

    Counts, not rates, are kept: they merge, and the rates follow at read.
    """
    hit = F.col("prediction") == F.col("actual_conversion")
    predicted, actual = F.col("prediction") == 1, F.col("actual_conversion") == 1
    timed = monitored.withColumn("_event_time", wall_instant(F.col("monitor_timestamp")))
    counts = timed.withWatermark("_event_time", lateness).groupBy(F.window("_event_time", "1 hour")).agg(
        F.count("*").alias("predictions_count"),
        F.count_if(hit).alias("hits"),
        F.count_if(predicted).alias("predicted"),
        F.count_if(actual).alias("actual"),
        F.count_if(predicted & actual).alias("true_positives"),
    ).withColumn("monitor_hour", wall_clock(F.col("window.start"))).drop("window")
    return _log_updates(counts, target, checkpoint, once, interval)
