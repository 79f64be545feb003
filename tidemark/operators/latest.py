"""Newest-row selection and point-in-time joins that tolerate hot keys."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import floor_day


def latest_rows(df: DataFrame, key: str, ts: str, ties: bool = True) -> DataFrame:
    """Rows of each key at its newest timestamp (all of them when tied).

    Written as ``rank() = 1`` so Spark plants a partial group limit before the
    shuffle: each task sends only its local winners, whatever the key's size.
    Rows with a NULL key or timestamp never win an equality, so they go first.
    """
    rank = F.rank() if ties else F.row_number()
    newest = Window.partitionBy(key).orderBy(F.col(ts).desc())
    known = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    return known.withColumn("_rank", rank.over(newest)).filter("_rank = 1").drop("_rank")


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k report (TakeOrderedAndProject: k rows per task, then k)."""
    return df.orderBy(*order).limit(k)


def latest_row(df: DataFrame, ts: str, *tie_break: str) -> DataFrame:
    return top_rows(df, [F.col(ts).desc(), *[F.col(c) for c in tie_break]], 1)


def first_rows(df: DataFrame, ts: str, n: int, newest: bool, *tie_break: str) -> DataFrame:
    """The first (or last) ``n`` rows by time."""
    order = F.col(ts).desc() if newest else F.col(ts).asc()
    return top_rows(df, [order, *[F.col(c) for c in tie_break]], n)


def as_of_join(spine: DataFrame, features: DataFrame, key: str, spine_ts: str,
               feature_ts: str, columns: Sequence[str], bucket=floor_day) -> DataFrame:
    """Attach to each spine row the newest feature row at or before its time.

    One sorted pass over a key would put a hot key into one task.  Instead the
    timeline is cut into buckets:

    1. per (key, bucket) the last feature row is found by a map-side combined
       aggregate, and a window over those few rows gives what each bucket
       inherits from the past;
    2. spine and feature rows meet within (key, bucket) only, where the newest
       earlier row wins and the inherited one fills the gap.

    Groups are therefore one key in one bucket; pick a finer ``bucket``
    (``floor_hour``) where a single day of one key is still large.  Features tied on
    time resolve to the greatest row, so the result is repeatable.
    """
    value = F.struct(F.col(feature_ts).alias("_at"), *[F.col(c) for c in columns])
    feats = features.filter(F.col(key).isNotNull() & F.col(feature_ts).isNotNull()).select(
        F.col(key).alias("_key"), F.col(feature_ts).alias("_ts"), value.alias("_value"),
    ).withColumn("_bucket", bucket(F.col("_ts")))

    points = spine.withColumns({
        "_key": F.col(key), "_ts": F.col(spine_ts), "_bucket": bucket(F.col(spine_ts)),
    })

    # What every (key, bucket) hands on to later buckets.
    closing = feats.groupBy("_key", "_bucket").agg(F.max("_value").alias("_closing"))
    wanted = points.select("_key", "_bucket").distinct()
    timeline = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inherited = (
        closing.unionByName(wanted, allowMissingColumns=True)
        .groupBy("_key", "_bucket").agg(F.max("_closing").alias("_closing"))
        .withColumn("_inherited", F.last("_closing", ignorenulls=True).over(timeline))
        .select("_key", "_bucket", "_inherited")
    )

    within = (
        Window.partitionBy("_key", "_bucket").orderBy("_ts", "_is_spine", "_value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    tagged = points.withColumn("_is_spine", F.lit(1)).unionByName(
        feats.withColumn("_is_spine", F.lit(0)), allowMissingColumns=True
    )
    met = tagged.withColumn("_local", F.last("_value", ignorenulls=True).over(within)).filter("_is_spine = 1")
    joined = met.join(inherited, ["_key", "_bucket"], "left")
    best = F.coalesce("_local", "_inherited")
    return joined.select(
        *[F.col(c) for c in spine.columns],
        best.getField("_at").alias("matched_feature_timestamp"),
        *[best.getField(c).alias(c) for c in columns],
    )


@dataclass
class TimedView:
    """Feature rows of a key, each valid from its ``timestamp`` on."""

    name: str
    frame: DataFrame
    timestamp: str
    columns: Sequence[str]


def as_of_views(spine: DataFrame, views: Sequence[TimedView], keys: Sequence[str], spine_ts: str,
                bucket: Callable[[Column], Column] = floor_day) -> DataFrame:
    """Attach to each spine row, from every view, the newest row of its keys at or before its time.

    Spine and all views are tagged and shuffled once, by keys and time bucket.  Inside a group one window carries the
    newest row of every view forward.  What a bucket inherits from earlier ones comes from the same shuffle's groups: a
    row per group with each view's last one, over which a second window runs along the key.  So a further view adds its
    own rows to the shuffle and nothing else, and a hot key is as many groups as it has buckets; pick a finer ``bucket``
    where a day of one key is large.

    Gives the spine's columns, and per view ``<name>_timestamp`` and its columns, which are prefixed with the view's
    name where another view or the spine has one of that name.  Views tied on time resolve to the greatest row; rows
    without a key or time match nothing.
    """
    values = [f"_v{i}" for i in range(len(views))]

    def placed(df: DataFrame, at: str) -> list[Column]:
        # Structs, as they are never NULL: a filter for NULLs below one use of the shuffle would keep it from being reused.
        return [F.struct(*[F.col(key).alias(f"k{i}") for i, key in enumerate(keys)]).alias("_key"), F.struct(bucket(F.col(at)).alias("b")).alias("_bucket")]

    row = F.struct(*[F.col(c) for c in spine.columns])
    tagged = spine.select(*placed(spine, spine_ts), F.struct(F.col(spine_ts).alias("_at"), row.alias("_row")).alias("_point"))
    for value, view in zip(values, views):
        known = view.frame.dropna(subset=[*keys, view.timestamp])
        packed = F.struct(F.col(view.timestamp).alias("_at"), *[F.col(c).alias(f"c{n}") for n, c in enumerate(view.columns)])
        tagged = tagged.unionByName(known.select(*placed(known, view.timestamp), packed.alias(value)), allowMissingColumns=True)
    # Both uses below read all columns, so they are one exchange.
    dealt = tagged.repartition("_key", "_bucket")

    along = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    closing = dealt.groupBy("_key", "_bucket").agg(
        F.count_if(F.col("_point").isNotNull()).alias("_points"), *[F.max(v).alias(v) for v in values])
    inherited = closing.select("_key", "_bucket", "_points", *[F.last(v, ignorenulls=True).over(along).alias(f"{v}_past") for v in values])
    inherited = inherited.filter("_points > 0").drop("_points")

    when = F.coalesce(F.col("_point._at"), *[F.col(f"{v}._at") for v in values])
    within = Window.partitionBy("_key", "_bucket").orderBy("_when", F.col("_point").isNotNull(), *values).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    met = dealt.withColumn("_when", when).withColumns({f"{v}_now": F.last(v, ignorenulls=True).over(within) for v in values})
    joined = met.filter(F.col("_point").isNotNull()).join(inherited, ["_key", "_bucket"], "left")

    names = Counter([*spine.columns, *[c for view in views for c in view.columns]])
    out = [F.col(f"_point._row.{c}").alias(c) for c in spine.columns]
    for i, view in enumerate(views):
        best = F.coalesce(F.col(f"_v{i}_now"), F.col(f"_v{i}_past"))
        out.append(best["_at"].alias(f"{view.name}_timestamp"))
        out += [best[f"c{n}"].alias(c if names[c] == 1 else f"{view.name}_{c}") for n, c in enumerate(view.columns)]
    return joined.select(*out)
