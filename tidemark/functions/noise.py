"""Repeatable randomness: a uniform draw that is a function of key and salt.

``rand()`` changes with partitioning and with every retry of a lost task; a
hash of the key does not, which keeps labels and samples stable.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_uniform(key: Column, salt: str) -> Column:
    """Double in [0, 1) from the first 32 bits of md5(key|salt)."""
    digest = F.md5(F.concat(key, F.lit("|" + salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def bernoulli(key: Column, salt: str, p: Column) -> Column:
    """1 with probability ``p``; 0 otherwise, also when ``p`` is NULL."""
    return F.when(hash_uniform(key, salt) < p, 1).otherwise(0)
