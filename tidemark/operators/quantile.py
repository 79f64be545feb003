"""Exact interpolated quantiles without holding a group in memory.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer.  Here a sketch gives a bracket around the wanted rank; one
more pass counts what lies outside it and the distinct values inside.  While a
group has more of those than one task should order, rounds of equal-depth
cells narrow them down, without reading the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.reshape import attach_row
from tidemark.session import scratch_path

#: Distinct values that one task orders at last, and cells of a round.
LIMIT, CELLS = 200_000, 256


def _meet(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Adds the columns of the one row per group; NULL is a group."""
    if not by:
        return attach_row(rows, groups)
    named = groups.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    return rows.join(named, same).drop(*[f"_by_{c}" for c in by])


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "quantile")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _running(by: list[str], order: str) -> Column:
    groups = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return F.sum("_rows").over(groups.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def _holds(index: Column) -> Column:
    return (F.col("_upto") > index) & (F.col("_upto") - F.col("_rows") <= index)


def bracket(known: DataFrame, q: float, by: list[str], accuracy: int, width: float = 2.0) -> DataFrame:
    """``by…, _n, _before, _v, _rows, _edge``: of each group the distinct values that may hold the rank, ascending.

    The sketch errs by ``1 / accuracy`` of the ranks at most, and the bracket spans ``width`` times that to either
    side.  What lies below it is one row with its greatest value, what lies above one with its least: in small groups
    the rank may be the last one below or the first one above.
    """
    low, high = max(0.0, q - width / accuracy), min(1.0, q + width / accuracy)
    sketch = F.percentile_approx("_v", [low, high], accuracy)
    bounds = known.groupBy(*by).agg(F.count("*").alias("_n"), sketch[0].alias("_low"), sketch[1].alias("_high"))
    v = F.col("_v")
    side = F.when(v < F.col("_low"), -1).when(v > F.col("_high"), 1).otherwise(0)
    placed = _meet(known, bounds, by).withColumn("_edge", side)
    counted = placed.groupBy(*by, "_n", "_edge", F.when(side == 0, v).alias("_in")).agg(
        F.count("*").alias("_rows"), F.max("_v").alias("_most"), F.min("_v").alias("_least"))
    value = F.when(F.col("_edge") < 0, F.col("_most")).otherwise(F.col("_least"))
    return counted.select(*by, "_n", F.lit(0).cast("long").alias("_before"), value.alias("_v"), "_rows", "_edge")


def narrowed(values: DataFrame, q: float, by: list[str], accuracy: int) -> DataFrame:
    """One round: the values of each group are cut in ``CELLS`` cells of about equal numbers of distinct values, and
    those of the cells that hold the rank stay; ``_before`` counts the rows below them."""
    grid = [i / CELLS for i in range(1, CELLS)]
    bounds = values.groupBy(*by).agg(F.percentile_approx("_v", grid, accuracy).alias("_bounds"))
    cell = F.size(F.filter("_bounds", lambda b: b < F.col("_v")))
    placed = _meet(values, bounds, by).withColumn("_cell", cell).drop("_bounds")
    position = F.lit(q) * (F.col("_n") - 1)
    cells = placed.groupBy(*by, "_n", "_before", "_cell").agg(F.sum("_rows").alias("_rows"))
    cells = cells.withColumn("_upto", F.col("_before") + _running(by, "_cell"))
    first, last = _holds(F.floor(position)), _holds(F.ceil(position))
    wanted = cells.groupBy(*by).agg(
        F.max(F.when(first, F.col("_cell"))).alias("_a"), F.max(F.when(last, F.col("_cell"))).alias("_b"),
        F.max(F.when(first, F.col("_upto") - F.col("_rows"))).alias("_below"))
    # No row lies between the two cells, so the counts go on from the first to the second.
    kept = _meet(placed, wanted, by).filter((F.col("_cell") == F.col("_a")) | (F.col("_cell") == F.col("_b")))
    return kept.select(*by, "_n", F.col("_below").alias("_before"), "_v", "_rows", "_edge")


def candidates(df: DataFrame, value: str, q: float, by: list[str], accuracy: int, limit: int) -> DataFrame:
    """What :func:`bracket` gives, narrowed in rounds until no group has more than ``limit`` values.

    Should the sketch be further off than it promises, the rank is found outside; then all values are candidates.
    """
    known = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    position = F.lit(q) * (F.col("_n") - 1)
    side = lambda edge: F.sum(F.when(F.col("_edge") == edge, F.col("_rows")).otherwise(0))

    def state(values: DataFrame):
        """The most values of a group, and whether some group's rank lies outside its bracket."""
        groups = values.groupBy(*by, "_n", "_before").agg(F.count("*").alias("values"), side(-1).alias("below"), side(0).alias("inside"))
        missed = (F.ceil(position) < F.col("below") - 1) | (F.floor(position) > F.col("below") + F.col("inside"))
        return groups.agg(F.max("values"), F.max(missed)).first()

    values = _written(bracket(known, q, by, accuracy))
    most, missed = state(values)
    if missed:
        plain = known.groupBy(*by, "_v").agg(F.count("*").alias("_rows"))
        sizes = known.groupBy(*by).agg(F.count("*").alias("_n"))
        values = _written(_meet(plain, sizes, by).select(*by, "_n", F.lit(0).cast("long").alias("_before"), "_v", "_rows", F.lit(0).alias("_edge")))
        most = state(values)[0]
    while (most or 0) > limit:
        values = _written(narrowed(values, q, by, min(accuracy, 4 * CELLS)))
        most = values.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return values


def exact_quantile(df: DataFrame, value: str, q: float, by: Sequence[str] = (),
                   name: str = "quantile", accuracy: int = 10000, limit: int = LIMIT) -> DataFrame:
    """``percentile_cont(q)`` of ``value`` per group: (by…, name).

    Reads the rows twice, when it is called: for the sketch, and for the counts of the values around the rank, which
    are written once.  A round leaves at most about 1 in ``CELLS / 4`` of a group's values, whatever their
    distribution, so what one task orders in the end is bounded by ``limit``.
    """
    by = list(by)
    position = F.lit(q) * (F.col("_n") - 1)
    ranked = candidates(df, value, q, by, accuracy, limit).withColumn("_upto", F.col("_before") + _running(by, "_v"))
    picked = ranked.groupBy(*by).agg(
        F.max(F.when(_holds(F.floor(position)), F.col("_v"))).alias("_lower"),
        F.max(F.when(_holds(F.ceil(position)), F.col("_v"))).alias("_upper"),
        F.max(position - F.floor(position)).alias("_part"),
    )
    return picked.select(
        *by, (F.col("_lower") + (F.col("_upper") - F.col("_lower")) * F.col("_part")).alias(name)
    )
