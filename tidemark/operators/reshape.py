"""Small-result shapes: one-row frames, metric rows, unpivoted statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def one_row(spark, **values: Column) -> DataFrame:
    """A single row of expressions (scalar subqueries, literals)."""
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()])


def attach_row(df: DataFrame, row: DataFrame, required: bool = True) -> DataFrame:
    """Pair every row of ``df`` with the single row of ``row``.

    ``row`` runs once as a scalar subquery; ``df`` is neither shuffled nor
    joined.  With ``required`` an empty ``row`` empties the result (cross
    join); without it the columns are NULL (left join on a true condition).
    Spark fails the query when ``row`` holds more than one row.
    """
    packed = row.select(F.struct("*").alias("row")).scalar()
    paired = df.withColumn("_row", packed)
    if required:
        paired = paired.filter(F.col("_row").isNotNull())
    return paired.select(*[F.col(c) for c in df.columns], *[F.col("_row")[c].alias(c) for c in row.columns])


def metric_rows(df: DataFrame, metrics: Mapping[str, Column], label: str = "metric",
                value: str = "value") -> DataFrame:
    """Several aggregates of one frame as (label, value) rows from one scan."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias(label), agg.alias(value)) for name, agg in metrics.items()
    ])
    return df.agg(pairs.alias("pairs")).select(F.inline("pairs"))


def unpivot_doubles(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep…, feature_name, value) with every value as a double."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature_name"), F.col(c).cast("double").alias("value")) for c in columns
    ])
    return df.select(*keep, F.inline(cells))


def feature_moments(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    """Mean and sample deviation per feature: one scan, one row per feature.

    All features share a single aggregate; only its one result row is
    unpivoted, so the scan is not multiplied by the number of features.
    """
    stats = F.array(*[
        F.struct(
            F.lit(c).alias("feature_name"),
            F.avg(F.col(c).cast("double")).alias(f"{prefix}_mean"),
            F.stddev_samp(F.col(c).cast("double")).alias(f"{prefix}_std"),
        )
        for c in columns
    ])
    return df.agg(stats.alias("stats")).select(F.inline("stats"))
