"""Anti joins with the two SQL meanings of "is not there"."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def not_exists(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a match; a NULL key never matches, so it stays.

    The right side is reduced to its distinct keys first, which keeps a key
    repeated millions of times from loading one join task.
    """
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key NOT IN (SELECT key FROM right)`` under three-valued logic.

    A NULL on the right makes every comparison unknown, hence no rows; a NULL
    on the left only survives an empty right side.  Spark's own null-aware
    anti join must broadcast ``right``; here the matching is an ordinary
    shuffled anti join and the two NULL cases are one scalar aggregate.
    """
    facts = right.agg(
        F.struct(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")).alias("facts")
    ).scalar()
    flagged = not_exists(left, right, [key]).withColumn("_right", facts)
    keep = (F.col("_right.n") == 0) | ((F.col("_right.nulls") == 0) & F.col(key).isNotNull())
    return flagged.filter(keep).drop("_right")
