"""Continuous file ingest: staged JSON events into a Parquet event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import wall_instant
from tidemark.sources.readers import accepted, parsed_lines, rejected

LATENESS = "1 day"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of staged JSON-lines events under the declared schema.

    Keeps what the batch form keeps, rows without an id included.  Lines that
    do not parse are the rows of :func:`rejected_stream`.
    """
    return accepted(parsed_lines(_lines(spark, path, files_per_trigger)))


def rejected_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the lines that do not parse, to be written to a table beside the events."""
    return rejected(parsed_lines(_lines(spark, path, files_per_trigger)))


def _lines(spark: SparkSession, path: str, files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def deduplicated(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """First arrival of each event id.

    State is dropped once the watermark passes an event's time plus the
    lateness, so its size follows the lateness, not the stream's age.  Events
    without an id are all kept.
    """
    first = (
        events.filter(F.col("event_id").isNotNull())
        .withColumn("_event_time", wall_instant(F.col("event_timestamp")))
        .withWatermark("_event_time", lateness)
        .dropDuplicatesWithinWatermark(["event_id"])
        .drop("_event_time")
    )
    return first.unionByName(events.filter(F.col("event_id").isNull()))


def ingest_events(events: DataFrame, target: str, checkpoint: str, once: bool = True,
                  interval: str = "1 minute") -> StreamingQuery:
    """Append the stream to a Parquet table, exactly once per checkpoint."""
    writer = events.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start(target)
