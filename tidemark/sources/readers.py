"""Scans: tables, Parquet, staged JSON lines, CSV keys, literals, the catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.schemas import STREAM_EVENT
from tidemark.session import scratch_path

CORRUPT = "_corrupt_record"


def scan(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table by name, or Parquet when ``name`` looks like a path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A VALUES source (request tables, single log rows)."""
    return spark.createDataFrame(rows, schema)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """JSON lines (column ``value``) as events, with the line itself in ``_corrupt_record`` where it does not parse.

    No inference pass; unknown keys are ignored and blank lines skipped.  Works
    on batch and streaming frames, so both keep and reject the same lines.
    """
    schema = T.StructType(STREAM_EVENT.fields + [T.StructField(CORRUPT, T.StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.filter(F.trim("value") != "").select(F.from_json("value", schema, options).alias("e")).select("e.*")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))


def event_files(spark: SparkSession, path: str, quarantine: bool = False) -> DataFrame:
    """Staged JSON-lines events under the declared schema.

    With ``quarantine`` lines that do not parse are rows too, the line in
    ``_corrupt_record``; otherwise see :func:`rejected_event_lines` for them.
    """
    parsed = parsed_lines(spark.read.text(path))
    return parsed if quarantine else accepted(parsed)


def rejected_event_lines(spark: SparkSession, path: str) -> DataFrame:
    return rejected(parsed_lines(spark.read.text(path)))


def ingest_event_files(spark: SparkSession, source: str, target: str, quarantine: str | None = None) -> int:
    """Batch copy of staged JSON files into a Parquet event table (append).

    Lines that do not parse go to a table beside it, ``<target>_rejected`` by
    default; returns how many there were in this call.  The folder is listed
    and its lines are parsed once, into a table both sides are copied from: a
    file that arrives meanwhile is in neither.
    """
    path = scratch_path(spark, "parsed-lines")
    found = event_files(spark, source, quarantine=True).withColumn("_bad", F.col(CORRUPT).isNotNull())
    found.write.partitionBy("_bad").parquet(path)
    parsed = spark.read.schema(found.schema).parquet(path)
    accepted(parsed.filter("NOT _bad").drop("_bad")).write.mode("append").parquet(target)
    bad = rejected(parsed.filter("_bad").drop("_bad"))
    bad.write.mode("append").parquet(quarantine or f"{target.rstrip('/')}_rejected")
    return bad.count()


def csv_client_ids(spark: SparkSession, path: str) -> DataFrame:
    """Client ids from a headed CSV; other columns are not parsed."""
    head = spark.read.option("header", True).csv(path)
    return head.select(F.col("client_id"))


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Expose a frame to SQL users under ``name``; nothing is materialised."""
    df.createOrReplaceTempView(name)
    return df


def stored_view(spark: SparkSession, name: str, query: str) -> DataFrame:
    """A view kept in the catalog, over catalog tables; replaces an earlier one of the name."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query}")
    return spark.table(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def table_columns(df: DataFrame, table: str) -> DataFrame:
    """Column listing of a frame: one row per column (metadata only)."""
    rows = [(table, f.name, f.dataType.simpleString(), i + 1) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "table_name string, column_name string, data_type string, ordinal_position int"
    )
