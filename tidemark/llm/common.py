"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: A word is a run of characters other than the space and TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One output batch per Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = make(batch)
            if out is not None:
                yield out
    return df.mapInArrow(run, schema)


def hashed_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the least hashes of ``key``.

    A cut of the hash range that holds a few more than ``limit`` rows goes first, so the tasks together send little
    more than that to where the sample is ordered; were they fewer, all rows are ordered.
    """
    place, count = F.xxhash64(key), rows.count()
    if count > 2 * limit:
        share = (limit + 6 * limit ** 0.5 + 20) / count
        near = rows.filter(place <= int(-(2 ** 63) + min(1.0, share) * (2 ** 64 - 1024)))
        rows = near if near.count() >= limit else rows
    return rows.orderBy(place, key).limit(limit)


def slots(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salted_join(big: DataFrame, small: DataFrame, key: str, salt_from: str, salts: int = 16) -> DataFrame:
    """Left join where one key may hold a third of ``big``: the key's rows spread over ``salts`` tasks."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
