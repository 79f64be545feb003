"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import word_count, words, written

#: Source weights by rank, the share of all sizes to draw, and the cap on repeats.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per source: its size and target.

    ``sized`` has ``source`` and ``size``.  Targets are ``share`` of all sizes split by weight; a source stops at
    ``cap`` times its size and the excess is shared again by weight until none is above.  Each round of that fill is
    one aggregate over the source table, and only its three totals reach the driver.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    totals = written(_ranked(totals).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))), "mix-sources")
    budget = share * (totals.agg(F.sum("source_size")).first()[0] or 0)
    level, limit = None, F.col("source_size") * cap
    while True:
        full = F.lit(False) if level is None else limit <= F.col("weight") * F.lit(level[0]) / F.lit(level[1])
        filled, open_weight, count = totals.agg(
            F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))),
            F.sum(full.cast("long"))).first()
        if not open_weight or (level and level[2] == count):
            break
        level = (budget - float(cap) * (filled or 0), open_weight, count)
    if level is None:
        target = F.lit(0.0)
    else:
        share_of = F.col("weight") * F.lit(float(level[0])) / F.lit(float(level[1]))
        target = F.least(share_of, limit.cast("double"))
    return totals.select("source", "source_size", "source_docs", target.alias("target"))


def _ranked(totals: DataFrame) -> DataFrame:
    """Rank of each source by code point, NULL last.

    Strings compare by their UTF-8 bytes, which is code point order.  Sources of one two-character prefix are ranked
    in one window, and the number before each prefix is a prefix sum over the few distinct prefixes.
    """
    head = totals.withColumn("head", F.coalesce(F.substring("source", 1, 2), F.lit("")))
    head = head.withColumn("last", F.col("source").isNull())
    counts = head.groupBy("last", "head").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("last", "head").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("last").alias("l"), F.col("head").alias("h"), F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("last", "head").orderBy("source"))
    return head.withColumn("within", within).join(before, (F.col("last") == F.col("l")) & (F.col("head") == F.col("h"))).select(
        "source", "source_size", "source_docs", (F.col("before") + F.col("within")).alias("rank"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, digits: int = 3) -> DataFrame:
    """How many words of each document the mix takes: ``doc_id, size, source_size, target, taken, source``.

    Every document gets the random key md5(doc_id).  Within a source, documents stand in key order; the first
    ``digits`` hexadecimal digits of the key cut that order into equal ranges, totals of the ranges are summed up
    first, and each range sums its own rows, so no task orders more than a 4096th of a source.  Whole epochs take
    each document once; the last epoch cuts at the source's budget to the word, so one document per source may be
    taken in part.  Nothing depends on partitions or on task order: reruns agree.

    NULL text has size 0; NULL source is a source of its own, last in order; a row without an id gets the key of its
    text, so such rows spread over the ranges too; rows of equal id and size go by a hash of the text; an empty table
    gives an empty result.  Long texts are counted whole; columns beside those named are not read.
    """
    sized = written(_sized(docs.select("doc_id", "source", "text"), digits).select("doc_id", "source", "_source", "_size", "_key", "_range", "_print"), "mix-sizes")
    return _taken(sized, sized, weights, share, cap).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), "source")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, digits: int = 3) -> DataFrame:
    """The documents of the mix with all their columns: a row for each time a document is taken, none if it is not.

    A document taken in part keeps its first words, joined by single spaces, and ``n_chars``, where there is one, is
    counted anew.  Documents without words are never taken.
    """
    sized = _sized(docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text"), digits)
    narrow = written(sized.select("source", "_source", "_size", "_range"), "mix-sizes")
    taken = _taken(sized, narrow, weights, share, cap).filter(F.col("_taken") > 0)
    whole, part = F.floor(F.col("_taken") / F.col("_size")).cast("int"), (F.col("_taken") % F.col("_size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = taken.withColumn("_part", F.explode(copies))
    cut = F.when(F.col("_part") > 0, F.array_join(F.slice(words(F.col("text")), F.lit(1), F.greatest(F.col("_part"), F.lit(1))), " "))
    rows = rows.withColumn("text", F.coalesce(cut, F.col("text")))
    kept = {c: F.col("_row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("_part") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(kept["n_chars"])
    return rows.select(*(value.alias(c) for c, value in kept.items()))


def _sized(docs: DataFrame, digits: int) -> DataFrame:
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.coalesce(F.md5("text"), F.lit("")))))
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # NULL is a source too
    return docs.withColumns({"_size": word_count(F.col("text")), "_key": key, "_range": F.substring(key, 1, digits), "_source": named, "_print": F.xxhash64("text")})


def _taken(rows: DataFrame, narrow: DataFrame, weights, share: float, cap: int) -> DataFrame:
    """``rows`` with ``_source_size, _target, _taken``; ``narrow`` has their sources, sizes and ranges, written.

    The window and the join share their keys, so the rows are shuffled once.
    """
    targets = source_targets(narrow.select("source", F.col("_size").alias("size")), weights, share, cap)
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    targets = targets.select(named.alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    ranges = narrow.groupBy("_source", "_range").agg(F.sum("_size").alias("size"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_source", "_range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_start")).join(targets, "_source")
    order = Window.partitionBy("_source", "_range").orderBy("_key", "doc_id", "_size", "_print").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("_size").over(order), F.lit(0)))
    placed = placed.join(starts, ["_source", "_range"])
    budget = F.floor("_target")
    epochs = F.when(F.col("_source_size") > 0, F.floor(budget / F.greatest(F.col("_source_size"), F.lit(1)))).otherwise(0)
    left = budget - epochs * F.col("_source_size") - F.col("_start") - F.col("_inside")
    return placed.withColumn("_taken", (epochs * F.col("_size") + F.greatest(F.lit(0), F.least(left, F.col("_size")))).cast("long"))


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
o AS (SELECT *, 2.0 * source_size / weight AS ratio FROM w),
c AS (SELECT *, coalesce(sum(source_size) OVER before, 0) AS filled, sum(weight) OVER after AS open_weight,
  sum(source_size) OVER () AS total FROM o
  WINDOW before AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  after AS (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT CAST(1.5 * total - 2 * filled AS DOUBLE) AS num, CAST(open_weight AS DOUBLE) AS den FROM c
  WHERE 2 * source_size * open_weight > weight * (1.5 * total - 2 * filled) ORDER BY ratio, source LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(weight * (SELECT num FROM l) / (SELECT den FROM l), CAST(2 * source_size AS DOUBLE)), 0.0) AS target FROM w),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source, coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source
  ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(epochs * size + greatest(0, least(budget - epochs * source_size - ahead, size)) AS BIGINT) AS taken, source FROM e
"""
