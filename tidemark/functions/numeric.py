"""Column arithmetic with the null and division rules the plans rely on.

Spark's ``greatest``/``least`` skip NULL; the semantics wanted here propagate
it, so bounds are written as ``when`` chains whose ELSE keeps the operand.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F


def _col(value: Column | str | float) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def at_least(x: Column, low: float) -> Column:
    """``max(x, low)``, NULL when ``x`` is NULL."""
    return F.when(x < low, F.lit(low)).otherwise(x)


def at_most(x: Column, high: float) -> Column:
    """``min(x, high)``, NULL when ``x`` is NULL."""
    return F.when(x > high, F.lit(high)).otherwise(x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def _any_null(cols: list[Column]) -> Column:
    return reduce(or_, [c.isNull() for c in cols])


def greatest_strict(*cols: Column | str) -> Column:
    cols = [_col(c) for c in cols]
    return F.when(~_any_null(cols), F.greatest(*cols))


def least_strict(*cols: Column | str) -> Column:
    cols = [_col(c) for c in cols]
    return F.when(~_any_null(cols), F.least(*cols))


def ratio(num: Column, den: Column) -> Column:
    """Double division that yields NULL for a zero denominator."""
    return num.cast("double") / F.nullif(den, F.lit(0))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(part * 100.0 / F.nullif(whole, F.lit(0)), digits)


def squash(x: Column, slope: float, centre: float) -> Column:
    """Logistic curve through 0.5 at ``centre``."""
    return 1.0 / (1.0 + F.exp(-slope * (x - centre)))


def exact_sum(x: Column, digits: int = 18) -> Column:
    """Sum of a double through a decimal accumulator.

    Adding doubles depends on the order partial sums arrive in; decimals do
    not, so a report does not change with the shuffle layout.  Each value
    counts as it prints, to ``digits`` places; the total may have ``38 -
    digits`` before the point.  Use :func:`money_sum` for amounts.
    """
    return F.sum(x.cast(f"decimal(38,{digits})")).cast("double")


def exact_avg(x: Column, digits: int = 18) -> Column:
    return exact_sum(x, digits) / F.nullif(F.count(x), F.lit(0))


def money_sum(x: Column, digits: int = 6) -> Column:
    """Order-independent sum of amounts (decimal accumulator)."""
    return F.sum(x.cast(f"decimal({14 + digits},{digits})")).cast("double")
