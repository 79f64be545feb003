"""Gapless row numbers in a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import scratch_path

#: ``monotonically_increasing_id`` has the row's place in its partition in the low bits, the partition above them.
PLACE_BITS = 33


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "row_number", start: int = 1) -> DataFrame:
    """``df`` with the numbers ``start``, ``start`` + 1, … in the given order.

    Rows are range-partitioned by ``order`` and sorted in each partition; the partitions' sizes, one number each, give
    every partition the number that its first row gets.  The sorted rows are written once, so what is counted is what is
    numbered, and a lost executor cannot deal rows anew.  Bounds come from a sample of all order columns, so a heavy
    leading value is split by the following ones; rows equal in all of them lie in one partition, in no fixed order.
    """
    spark, keys = df.sparkSession, [F.col(c) if isinstance(c, str) else c for c in order]
    path = scratch_path(spark, "numbered")
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    part, place = F.shiftrightunsigned("_at", PLACE_BITS), F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    sizes = sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    firsts, at = [], start
    for p, n in sizes:
        firsts.append((p, at))
        at += n
    table = spark.createDataFrame(firsts, "_part long, _first long")
    met = rows.withColumn("_part", part).join(F.broadcast(table), "_part")
    return met.withColumn(name, F.col("_first") + place).drop("_part", "_first", "_at")


def append_numbered(df: DataFrame, path: str, order: Sequence[str | Column], name: str = "id") -> int:
    """Append ``df`` to the table at ``path`` with ids that go on from its greatest one; returns the last id given.

    One writer at a time, as with any sequence that may have no gaps.
    """
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    last = 0
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        last = spark.read.parquet(path).agg(F.max(name)).first()[0] or 0  # from the file footers
    rows = numbered(df, order, name, last + 1)
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path).agg(F.max(name)).first()[0] or 0
