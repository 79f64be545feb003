"""The monitored table kept up to date by rewriting only the hours that changed.

Labels arrive after their prediction, and clients get new store rows.  A refresh compares versions: a fingerprint of
each hour's predictions and labels, and one of each client's features, with those of the last refresh.  Hours with
another fingerprint, and hours in which a changed client was scored, are joined with the store again and swapped; all
others are not touched, nor joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import floor_hour
from tidemark.sources.batch_log import BatchLog

HOUR = "hour_key"
#: What is rewritten together: an hour, or a day where hours hold too few rows for a folder each.
UNITS = {"hour": "yyyy-MM-dd-HH", "day": "yyyy-MM-dd"}


def _versions(predictions: DataFrame, store: DataFrame, features: Sequence[str]) -> DataFrame:
    """``kind, key, version``: of hours the sum of their rows' hashes, so no order matters; of clients a hash."""
    row = F.xxhash64(*[F.col(c) for c in predictions.columns if c != HOUR]).cast("decimal(20,0)")
    hours = predictions.groupBy(F.col(HOUR).alias("key")).agg(F.concat_ws("/", F.count("*"), F.sum(row)).alias("version"))
    clients = store.groupBy(F.col("client_id").alias("key")).agg(F.sum(F.xxhash64(*features).cast("decimal(20,0)")).cast("string").alias("version"))
    return hours.withColumn("kind", F.lit("hour")).unionByName(clients.withColumn("kind", F.lit("client")))


def _changed(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """``kind, key, gone`` of versions that are new, different or no longer there."""
    if old is None:
        return new.select("kind", "key", F.lit(False).alias("gone"))
    both = old.withColumnRenamed("version", "was").join(new, ["kind", "key"], "full")
    return both.filter(~F.col("was").eqNullSafe(F.col("version"))).select("kind", "key", F.col("version").isNull().alias("gone"))


def refresh_hours(predictions: DataFrame, store: DataFrame, features: Sequence[str], target: str,
                  unit: str = "hour") -> list[str]:
    """Bring the table at ``target`` up to date; returns the hours it rewrote or removed, as text.

    ``predictions`` has ``client_id``, ``monitor_timestamp`` and ``actual_conversion``; rows without a label wait.  The
    versions are saved after the hours are swapped: a run that dies in between is repeated whole by the next one.
    With ``unit="day"`` whole days stand for the hours; a table keeps the unit it began with.
    """
    spark = predictions.sparkSession
    log = BatchLog(spark, f"{target.rstrip('/')}_versions")
    last = None if log.empty() else log.numbers().agg(F.max("number")).first()[0]
    labelled = predictions.filter(F.col("actual_conversion").isNotNull()).withColumn(HOUR, F.date_format("monitor_timestamp", UNITS[unit]))
    number = 0 if last is None else last + 1
    new = _versions(labelled, store, features)
    changed = _changed(None if last is None else log.read(last).drop("batch_id"), new)
    clients = changed.filter("kind = 'client'").select(F.col("key").alias("client_id"))
    direct = changed.filter("kind = 'hour' AND NOT gone").select(F.col("key").alias(HOUR))
    hours = direct.unionByName(labelled.join(clients, "client_id", "left_semi").select(HOUR)).distinct()
    listed = sorted(r[0] for r in hours.collect())  # an hour a row
    gone = sorted(r[0] for r in changed.filter("kind = 'hour' AND gone").select("key").collect())
    if listed:
        touched = labelled.filter(F.col(HOUR).isin(listed))
        rows = touched.join(store.select("client_id", *features), "client_id", "left").withColumn("monitor_hour", floor_hour(F.col("monitor_timestamp")))
        rows.hint("rebalance", HOUR).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(HOUR).parquet(target)
    for hour in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{HOUR}={hour}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if listed or gone or last is None:
        log.append(new, number)
    return sorted({*listed, *gone})


def monitored_table(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop(HOUR)
