"""Daily per-client partial counts: rolling windows without rescanning events.

One row per client and day is additive, so 7/30/90-day counters are sums over
days at read time.  A stream writes partials per micro-batch; merging them is
the same sum.  Distinct clients do not add up, but their bitmaps do: a day has
a bitmap per 32,768 client numbers, and a window's is the union of its days'.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import days_back
from tidemark.sources.batch_log import BatchLog

COUNTED = {
    "events": None, "web_visits": "web_visit", "email_opens": "email_open",
    "email_clicks": "email_click", "meetings": "advisor_meeting",
}


def daily_rollup(events: DataFrame) -> DataFrame:
    """Additive counts per client and calendar day."""
    kind = F.col("event_type")
    return events.groupBy("client_id", F.to_date("event_timestamp").alias("activity_date")).agg(*[
        (F.count("*") if value is None else F.count_if(kind == value)).alias(name)
        for name, value in COUNTED.items()
    ], F.max("event_timestamp").alias("last_event"))


def stream_daily_rollup(events: DataFrame, target: str, checkpoint: str, once: bool = True,
                        interval: str = "5 minutes") -> StreamingQuery:
    """Log each micro-batch's partials; no streaming state is held at all."""
    return _log_partials(events, daily_rollup, target, checkpoint, once, interval)


def _log_partials(events: DataFrame, partials, target: str, checkpoint: str, once: bool, interval: str) -> StreamingQuery:
    spark = events.sparkSession
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: BatchLog(spark, target).append(partials(batch), batch_id) and None)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def _summed(partials: DataFrame) -> DataFrame:
    return partials.groupBy("client_id", "activity_date").agg(
        *[F.sum(name).alias(name) for name in COUNTED], F.max("last_event").alias("last_event"))


def merge_days(spark: SparkSession, target: str) -> DataFrame:
    """Partials of all micro-batches summed to one row per client and day."""
    return _summed(BatchLog(spark, target).read())


def fold_days(spark: SparkSession, target: str) -> int:
    """Replace the log of partials by one batch of their sums; returns how many batches it stands for.  Files that
    no reader needs any more go with ``BatchLog.vacuum``."""
    return BatchLog(spark, target).fold(_summed)


# --------------------------------------------------------------------------
# Distinct clients from mergeable bitmaps
# --------------------------------------------------------------------------

def daily_client_bitmaps(events: DataFrame, numbers: DataFrame) -> DataFrame:
    """``activity_date, event_type, block, clients``: who was active, as bitmaps over ``numbers`` (client_id,
    client_number; gapless from 1, so the bitmaps are dense).  Events of clients without a number are left out."""
    known = events.select("client_id", F.to_date("event_timestamp").alias("activity_date"), "event_type").join(numbers, "client_id")
    number = F.col("client_number")
    return known.groupBy("activity_date", "event_type", F.bitmap_bucket_number(number).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("clients"))


def _united(partials: DataFrame) -> DataFrame:
    return partials.groupBy("activity_date", "event_type", "block").agg(F.bitmap_or_agg("clients").alias("clients"))


def stream_client_bitmaps(events: DataFrame, numbers: DataFrame, target: str, checkpoint: str, once: bool = True,
                          interval: str = "5 minutes") -> StreamingQuery:
    """Log each micro-batch's bitmaps."""
    return _log_partials(events, lambda batch: daily_client_bitmaps(batch, numbers), target, checkpoint, once, interval)


def merge_client_bitmaps(spark: SparkSession, target: str) -> DataFrame:
    return _united(BatchLog(spark, target).read())


def fold_client_bitmaps(spark: SparkSession, target: str) -> int:
    return BatchLog(spark, target).fold(_united)


def distinct_clients(bitmaps: DataFrame, as_of: datetime, windows: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """``event_type, window_days, clients``: different clients with an event of the type in the last days before the
    clock, a midnight.  Each day's bitmaps go once into every window that holds the day; no client id is read."""
    _midnight(as_of)
    day = F.col("activity_date")
    inside = [F.when(day >= days_back(as_of, days=n).cast("date"), F.lit(n)) for n in windows]
    parts = bitmaps.filter(day < F.lit(as_of.date())).withColumn("window_days", F.explode(F.array_compact(F.array(*inside))))
    united = parts.groupBy("event_type", "window_days", "block").agg(F.bitmap_or_agg("clients").alias("clients"))
    return united.groupBy("event_type", "window_days").agg(F.sum(F.bitmap_count("clients")).alias("clients"))


def _midnight(as_of: datetime) -> None:
    if (as_of.hour, as_of.minute, as_of.second, as_of.microsecond) != (0, 0, 0, 0):
        raise ValueError("daily rows cannot tell which events of the edge day lie inside a clock off midnight")


def engagement_from_days(days: DataFrame, as_of: datetime) -> DataFrame:
    """Trailing counters per client from daily rows.

    The clock must be a midnight, else a ValueError: only then every window
    starts on a day boundary and the counters equal those of the events.  The
    day that begins at the clock does not count, nor do later ones.
    """
    _midnight(as_of)
    day = F.col("activity_date")
    days = days.filter(day < F.lit(as_of.date()))

    def trailing(name: str, n: int) -> Column:
        return F.sum(F.when(day >= days_back(as_of, days=n).cast("date"), F.col(name)).otherwise(0))

    return days.groupBy("client_id").agg(
        *[trailing("events", n).alias(f"total_events_{n}d") for n in (7, 30, 90)],
        *[trailing("web_visits", n).alias(f"web_visits_{n}d") for n in (7, 30, 90)],
        *[trailing("email_opens", n).alias(f"email_opens_{n}d") for n in (7, 30)],
        *[trailing("email_clicks", n).alias(f"email_clicks_{n}d") for n in (7, 30)],
        trailing("meetings", 30).alias("personal_interactions_30d"),
        F.count_if(day >= days_back(as_of, days=30).cast("date")).alias("active_days_30d"),
        F.max("last_event").alias("last_activity_timestamp"),
    )
