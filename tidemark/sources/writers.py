"""Sinks and table mutation on plain Parquet tables.

Rows are never updated in place: a change rewrites only the day partitions it
touches (dynamic partition overwrite), so cost follows the change, not the
table.  Day tables are catalog tables partitioned by one date column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import at
from tidemark.operators.absence import not_exists


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write (replace) and read back: the created table as a frame."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_absent(new: DataFrame, existing: DataFrame, keys: Sequence[str], path: str) -> None:
    """Append only rows whose keys the table does not hold yet."""
    append_rows(not_exists(new, existing, keys), path)


def copy_table(spark: SparkSession, source: str, target: str) -> DataFrame:
    return materialize(spark.read.parquet(source), target)


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], partitions: int | None = None) -> None:
    """Globally ordered files by range-partitioning, then sorting each task.

    Range bounds come from a sample, so a heavy leading key is split by the
    following keys instead of landing in one task.
    """
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, location: str | None = None) -> DataFrame:
    """A catalog table whose rows lie in ``buckets`` files by ``key``, sorted: joins, windows and aggregates on the key
    with tables of as many buckets need no shuffle, now or in any later query.

    Choose ``buckets`` like shuffle partitions for the table's size, the same for all tables that meet.
    """
    writer = df.repartition(buckets, key).write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", location) if location else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def _place(spark: SparkSession, table: str) -> str:
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").first()["data_type"]


def _names(spark: SparkSession, folder: str) -> set[str]:
    """Names in one folder; none where it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in system.listStatus(path)} if system.exists(path) else set()


def _swap_days(df: DataFrame, table: str, day_column: str) -> None:
    """Replace exactly the partitions ``df`` has rows for.

    The mode is an option of this one write, so writers in other threads of
    the session are not touched.  New files are moved in when the job commits.
    """
    spark = df.sparkSession
    _by_day(df, day_column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_column).parquet(_place(spark, table))
    spark.catalog.refreshTable(table)


def _add_days(spark: SparkSession, table: str, day_column: str) -> None:
    """Tell the catalog of day folders that it does not know: one listing of the folders' names, none of their files."""
    known = {row[0] for row in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    new = sorted(n for n in _names(spark, _place(spark, table)) if n.startswith(f"{day_column}=") and n not in known)
    specs = " ".join(f"PARTITION ({day_column} = {_day(n.partition('=')[2])})" for n in new)
    if specs:
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {specs}")
        spark.catalog.refreshTable(table)


def _day(text: str) -> str:
    return "NULL" if text == "__HIVE_DEFAULT_PARTITION__" else f"DATE '{text}'"


def _drop_days(spark: SparkSession, table: str, day_column: str, days: Sequence[date]) -> None:
    if days:
        specs = ", ".join(f"PARTITION ({day_column} = DATE '{day}')" for day in days)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")


def _by_day(df: DataFrame, day_column: str) -> DataFrame:
    """Group rows of a day for writing.

    A rebalance, not a repartition: adaptive execution splits a day that is
    too large for one task and merges small ones, so a table written for one
    day still uses the cluster and a long history does not shatter into files.
    """
    return df.hint("rebalance", day_column)


def replace_days(df: DataFrame, table: str, day_column: str, location: str | None = None,
                 days: Sequence[date] = ()) -> None:
    """Idempotent per-day replace: the days present in ``df`` are swapped whole.

    Days named in ``days`` are replaced even where ``df`` has no row for them:
    they end up empty.  Creates the table on first use, at ``location`` if
    given.  Nothing is deleted before the new files are in place.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        writer = _by_day(df, day_column).write.partitionBy(day_column).format("parquet")
        (writer.option("path", location) if location else writer).saveAsTable(table)
        return
    # A named day whose files the write left as they were got no row.
    files = lambda: {day: _names(spark, f"{_place(spark, table)}/{day_column}={day}") for day in days}
    before = files()
    _swap_days(df.select(*spark.table(table).columns), table, day_column)
    _add_days(spark, table, day_column)
    after = files()
    _drop_days(spark, table, day_column, sorted(day for day in set(days) if before[day] == after[day]))


def retained(df: DataFrame, ts: str, as_of: datetime, days: int = 30) -> DataFrame:
    """Rows a retention delete keeps: everything not older than ``days``.

    A NULL timestamp is not older than anything, so it stays.
    """
    old = F.col(ts) < at(as_of - timedelta(days=days))
    return df.filter(~F.coalesce(old, F.lit(False)))


def drop_days_before(spark: SparkSession, table: str, day_column: str, ts: str,
                     as_of: datetime, days: int = 30) -> list[date]:
    """Apply :func:`retained` to a day table.

    Whole days before the cutoff are dropped as metadata; only the day the
    cutoff falls in is rewritten.  Returns the dropped days.
    """
    cutoff = as_of - timedelta(days=days)
    listed = spark.sql(f"SHOW PARTITIONS {table}").collect()
    present = {row[0].split("=", 1)[1] for row in listed} - {"__HIVE_DEFAULT_PARTITION__"}
    dropped = sorted(d for d in map(date.fromisoformat, present) if d < cutoff.date())

    boundary = spark.table(table).filter(F.col(day_column) == F.lit(cutoff.date()))
    kept = retained(boundary, ts, as_of, days)
    if cutoff.date().isoformat() in present:
        if kept.isEmpty():
            dropped.append(cutoff.date())
        else:
            _swap_days(kept, table, day_column)
    _drop_days(spark, table, day_column, dropped)
    return dropped


def updated(df: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """Conditional update as a projection; other rows pass unchanged."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        name: F.when(condition, value.cast(kinds[name])).otherwise(F.col(name))
        for name, value in values.items()
    })


def update_days(spark: SparkSession, table: str, day_column: str, condition: Column,
                values: Mapping[str, Column]) -> None:
    """Conditional update of a day table, rewriting only the days with a hit."""
    stored = spark.table(table)
    touched = [r[0] for r in stored.filter(condition).select(day_column).distinct().collect()]
    if not touched:
        return
    known, day = [d for d in touched if d is not None], F.col(day_column)
    affected = stored.filter(day.isin(known) | day.isNull() if None in touched else day.isin(known))
    _swap_days(updated(affected, condition, values), table, day_column)
