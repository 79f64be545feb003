"""The explicit clock: every plan takes ``as_of`` instead of reading wall time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F


def at(moment: datetime) -> Column:
    """Zone-less timestamp literal; folds to a constant the scan can use."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def days_back(as_of: datetime, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    """Literal ``as_of - n``, computed once on the driver."""
    return at(as_of - timedelta(days=days, hours=hours, minutes=minutes))


def days_between(start: Column, end: Column) -> Column:
    """Calendar-day boundaries crossed (1 across any midnight)."""
    return F.datediff(F.to_date(end), F.to_date(start))


def same_day(ts: Column, as_of: datetime) -> Column:
    """``date(ts) = date(as_of)`` as a half-open range, so Parquet can prune."""
    start = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    return (ts >= at(start)) & (ts < at(start + timedelta(days=1)))


def resolve_as_of(df: DataFrame, ts: str, as_of: datetime | None) -> datetime:
    """``as_of`` itself, or the newest timestamp in ``df`` (runs one aggregate)."""
    if as_of is not None:
        return as_of
    newest = df.agg(F.max(ts)).first()[0]
    if newest is None:
        raise ValueError(f"no {ts} value to take the clock from; pass as_of")
    return newest


def floor_day(ts: Column) -> Column:
    """Midnight of the timestamp's day, zone-less."""
    return F.to_date(ts).cast("timestamp_ntz")


def floor_hour(ts: Column) -> Column:
    """Start of the timestamp's hour.  ``date_trunc`` would pass through the
    session zone, where an hour can be missing or doubled."""
    return floor_day(ts) + F.make_dt_interval(hours=F.hour(ts))


def wall_instant(ts: Column) -> Column:
    """Instant whose UTC reading is the zone-less ``ts``.

    Watermarks need an instant.  A plain cast would read the session zone and
    move the hour a clock change skips.
    """
    minutes = (F.unix_date(F.to_date(ts)).cast("bigint") * 24 + F.hour(ts)) * 60 + F.minute(ts)
    seconds = F.extract(F.lit("SECOND"), ts) * 1000000
    return F.timestamp_micros(minutes * 60000000 + seconds.cast("bigint"))


def wall_clock(instant: Column) -> Column:
    """Zone-less UTC reading of an instant; undoes :func:`wall_instant`."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / 1000000).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
