"""Ordered rules and code tables as native CASE expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def first_match(rules: Iterable[tuple[Column, object]], default: object) -> Column:
    """Value of the first rule whose condition holds; NULL conditions do not."""
    chain = None
    for condition, value in rules:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    if chain is None:
        return default if isinstance(default, Column) else F.lit(default)
    return chain.otherwise(default)


def code_map(x: Column, codes: Mapping[str, int], default: int = 0) -> Column:
    return first_match(((x == label, code) for label, code in codes.items()), default)


def flag(condition: Column) -> Column:
    """1 when the condition holds, else 0 (also for NULL)."""
    return F.when(condition, 1).otherwise(0)
