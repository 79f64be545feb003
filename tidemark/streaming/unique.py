"""Each event id once in the whole table, however late a copy arrives.

The state of a stream forgets ids with the watermark.  Here every stored day has a Bloom filter: blocks of 32,768 bits,
the block chosen by the id's hash.  A micro-batch first asks the filters; only the days that may hold one of its ids are
read, only their id column, and there the check is exact.  So a batch of new events reads the filters, about ``BITS``
bits an id, and none of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.batch_log import BatchLog

#: Bits of one block (the size of Spark's bitmaps), bits set for an id, and blocks of a day in a table of the default size.
BITS, HASHES, BLOCKS = 32768, 4, 64


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("event_id"), F.lit(blocks)).cast("int")


def _each_place() -> list[Column]:
    return [F.pmod(F.xxhash64("event_id", F.lit(i)), F.lit(BITS)) for i in range(HASHES)]


def day_filters(ids: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``day, block, bits`` of the rows' ``day, event_id``: at most ``blocks`` rows a day, aggregated in the tasks first."""
    set_bits = ids.filter(F.col("event_id").isNotNull()).select("day", _block(blocks).alias("block"), F.explode(F.array(*_each_place())).alias("place"))
    return set_bits.groupBy("day", "block").agg(F.bitmap_construct_agg("place").alias("bits"))


def may_be_stored(ids: DataFrame, filters: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``event_id, day`` wherever a day's filter has all bits of an id: every stored id, and by chance a few others."""
    return _matches(ids, filters, blocks, pairs=True)


def _matches(ids: DataFrame, filters: DataFrame, blocks: int, pairs: bool) -> DataFrame:
    """The ids that some day's filter cannot rule out, as rows ``event_id, day``; without ``pairs`` one row an id, with
    no day, beside a row for each such day of a block, with no id: as many rows as ids, however many days there are.

    The bitmaps of a block meet its ids in one task (a block with more ids than its share in several).  There they are
    turned: each place gets the set of days that have its bit, and an id's days are the intersection of its four sets.
    """
    slots = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, -(-slots // blocks))
    size, day_type = BITS // 8, pa.date32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, days, maps, table, seen = None, [], [], None, None

        def rows(found, on):
            return pa.RecordBatch.from_arrays([found.cast(pa.string()), on.cast(day_type)], names=["event_id", "day"])

        def hit_days():
            if seen is not None and not pairs:
                on = np.flatnonzero(np.unpackbits(seen, bitorder="little"))
                yield rows(pa.nulls(len(on)), pa.array([days[d] for d in on], day_type))

        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * shares + batch.column(1).to_numpy()
            is_id = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (is_id[1:] != is_id[:-1])])
            for i, j in zip(starts, np.r_[starts[1:], len(key)]):
                if key[i] != group:
                    yield from hit_days()
                    group, days, maps, table, seen = key[i], [], [], None, None
                part = batch.slice(i, j - i)
                if not is_id[i]:
                    days += part.column(3).to_pylist()
                    maps += [np.frombuffer(x.as_buffer(), np.uint8) for x in part.column(4)]
                    continue
                if not days:
                    continue
                if table is None:  # a byte of eight days for every place
                    eights = (np.stack(maps[d:d + 8]) for d in range(0, len(maps), 8))
                    table = np.stack([np.packbits(np.unpackbits(x, axis=1, bitorder="little"), axis=0, bitorder="little")[0] for x in eights])
                    seen, maps = np.zeros(len(table), np.uint8), []
                hit = table[:, part.column(6).to_numpy()]
                for c in range(7, 6 + HASHES):
                    hit &= table[:, part.column(c).to_numpy()]
                if pairs:
                    on, who = np.nonzero(np.unpackbits(hit, axis=0, bitorder="little"))
                    yield rows(part.column(5).take(pa.array(who)), pa.array([days[d] for d in on], day_type))
                else:
                    seen |= np.bitwise_or.reduce(hit, axis=1)
                    found = part.column(5).filter(pa.array(hit.any(axis=0)))
                    yield rows(found, pa.nulls(len(found)))
        yield from hit_days()

    share = F.pmod(F.xxhash64("event_id", F.lit(HASHES)), F.lit(shares)).cast("int")
    places = [place.cast("int").alias(f"place_{i}") for i, place in enumerate(_each_place())]
    asked = ids.filter(F.col("event_id").isNotNull()).select(
        _block(blocks).alias("block"), share.alias("share"), F.lit(True).alias("is_id"), F.lit(None).cast("date").alias("day"),
        F.lit(None).cast("binary").alias("bits"), "event_id", *places)
    a_day = filters.groupBy("day", "block").agg(F.bitmap_or_agg("bits").alias("bits"))  # of all batches that wrote to it
    a_day = a_day.select("block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(False).alias("is_id"), "day", "bits",
                         F.lit(None).cast("string").alias("event_id"), *[F.lit(0).alias(f"place_{i}") for i in range(HASHES)])
    dealt = asked.unionByName(a_day).repartition(slots, "block", "share").sortWithinPartitions("block", "share", "is_id")
    return dealt.mapInArrow(run, "event_id string, day date")


def append_unique(batch: DataFrame, target: str, batch_id: int, blocks: int = BLOCKS) -> int:
    """Append the batch's rows whose id the table lacks; returns how many of its ids the filters could not rule out.

    Of rows that share an id in the batch the earliest stays.  Rows without an id are all kept.  A batch that is sent
    again changes nothing; one that died half-way is done again.  ``blocks`` must stay what it was for the first batch;
    choose it so that a day has about 2,000 ids a block.
    """
    spark = batch.sparkSession
    table, filters = BatchLog(spark, target), BatchLog(spark, f"{target.rstrip('/')}_filters")
    asked, kept = 0, []
    if not table.holds(batch_id):
        named = batch.filter(F.col("event_id").isNotNull())
        earliest = F.min(F.struct("event_timestamp", *[c for c in batch.columns if c not in ("event_id", "event_timestamp")])).alias("_row")
        named = named.groupBy("event_id").agg(earliest).select("event_id", "_row.*")
        if not filters.empty():
            kept.append(named := named.persist())  # asked about, then written
            kept.append(maybe := _matches(named, filters.read(before=batch_id), blocks, pairs=False).persist())
            days = [r.day for r in maybe.select("day").dropna().distinct().collect()]  # as many as stored days at most
            if days:
                stored = table.read(before=batch_id).filter(F.col("day").isin(days)).select("event_id")
                ids = maybe.select("event_id").dropna()
                asked = ids.count()
                known = stored.join(ids, "event_id", "left_semi")
                named = named.join(known, "event_id", "left_anti")
        rows = named.select(*batch.columns).unionByName(batch.filter(F.col("event_id").isNull()))
        table.append(rows.withColumn("day", F.to_date("event_timestamp")).hint("rebalance", "day"), batch_id, ["day"])  # few files a day
        for frame in kept:
            frame.unpersist()
    filters.append(day_filters(table.read(batch_id), blocks), batch_id)
    return asked


def ingest_unique(events: DataFrame, target: str, checkpoint: str, blocks: int = BLOCKS, once: bool = True,
                  interval: str = "1 minute") -> StreamingQuery:
    """Append a stream of events to the table at ``target``, each id once; read it with :func:`unique_events`."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: append_unique(batch, target, batch_id, blocks) and None)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def unique_events(spark, target: str) -> DataFrame:
    return BatchLog(spark, target).read().drop("batch_id", "day")
