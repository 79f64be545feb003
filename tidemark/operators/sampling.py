"""Repeatable Bernoulli samples and train/test splits keyed by a row id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import hash_uniform


def hash_sample(df: DataFrame, key: str, fraction: float, salt: str = "sample") -> DataFrame:
    """Each row is kept with probability ``fraction``, decided by its key."""
    return df.filter(hash_uniform(F.col(key), salt) < fraction)


def hash_split(df: DataFrame, key: str, test_fraction: float = 0.2, salt: str = "42") -> tuple[DataFrame, DataFrame]:
    """(train, test) by key; a key never appears on both sides."""
    draw = hash_uniform(F.col(key), salt)
    return df.filter(draw >= test_fraction), df.filter(draw < test_fraction)
