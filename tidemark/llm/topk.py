"""Exact top-k inner products: norm order, rotated partial sums and Cauchy-Schwarz bounds on the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.operators.numbering import numbered

ROWS, QUERIES, HEAD, STEP = 4096, 4096, 16, 512


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, vec, norm`` with components floor(scale * x); vectors NULL, or with NULL or non-finite components,
    and rows without an id are left out.  Components are whole doubles, exact up to 2**53."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    kept = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
    whole = kept.select("vec_id", F.transform(x, lambda v: _floor(v.cast("double") * scale)).alias("vec"))
    return whole.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)))


def _floor(v):
    return F.when(F.abs(v) < 2.0 ** 53, F.floor(v).cast("double")).otherwise(v)


def gram(whole: DataFrame) -> np.ndarray:
    """Sum of the outer products of all vectors: one d x d matrix per task, added up by cell; d*d cells come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0))
        for batch in batches:
            for m in _matrices(batch.column(0), None):
                part = m.T @ m
                if len(part) > len(total):
                    part, total = total, part
                total[:len(part), :len(part)] += part
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(total[i, j], pa.float64())})

    cells = whole.select("vec").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    d = int(cells[["i", "j"]].max().max()) + 1 if len(cells) else 0
    out = np.zeros((d, d))
    out[cells["i"], cells["j"]] = cells["v"]
    return out


def _matrices(column: pa.Array, d: int | None) -> Iterator[np.ndarray]:
    """The vectors of a batch as one matrix; shorter vectors are filled up with zeros."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy()
    if not len(sizes):
        return
    d = max(sizes.max(), d or 0)
    if (sizes == d).all():
        yield values.reshape(len(sizes), d)
    else:
        m = np.zeros((len(sizes), d))
        m[np.arange(d) < sizes[:, None]] = values
        yield m


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: higher score, then smaller id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    start = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - start < k
    return q[keep], ids[keep], scores[keep]


def search_block(query_rows, queries, floors, rows, ids, vectors, rotation, k: int):
    """The k best rows of a block for each query, as (query place, id, score); exact.  A row never meets itself.

    Rows stand by descending length.  For each step of rows a query goes on only while |q||c| can reach its floor;
    then the first HEAD rotated components are multiplied out and the rest is bounded by the product of the residual
    lengths; only pairs whose bound reaches the floor get their whole inner product.  A floor is a score that k rows
    reach already, so equal scores stay in.
    """
    order = np.argsort(-np.linalg.norm(vectors, axis=1), kind="stable")
    rows, ids, vectors = rows[order], ids[order], vectors[order]
    floors = floors.copy()
    norm_q, norm_c = np.linalg.norm(queries, axis=1), np.linalg.norm(vectors, axis=1)
    turned_q, turned_c = queries @ rotation, vectors @ rotation
    rest_q, rest_c = np.linalg.norm(turned_q[:, HEAD:], axis=1), np.linalg.norm(turned_c[:, HEAD:], axis=1)
    exact = norm_q.max(initial=0) * norm_c.max(initial=0) < 2.0 ** 52
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for at in range(0, len(ids), STEP):
        part = slice(at, at + STEP)
        slack = 1e-9 * (1 + norm_q * norm_c[at])
        live = np.flatnonzero(norm_q * norm_c[at] + slack >= floors)
        if not len(live):
            break
        bound = turned_q[live, :HEAD] @ turned_c[part, :HEAD].T + rest_q[live, None] * rest_c[None, part]
        maybe = bound + slack[live, None] >= floors[live, None]
        maybe &= query_rows[live, None] != rows[None, part]
        if maybe.mean() > 0.1:
            i, j = np.nonzero(maybe)
            s = (queries[live] @ vectors[part].T)[i, j]
        else:
            i, j = np.nonzero(maybe)
            s = np.einsum("ij,ij->i", queries[live[i]], vectors[part][j])
        if not exact:  # beyond double precision: whole numbers of any size, cut to 64 bits
            s = np.array([min(2**63 - 1, max(-2**63, sum(int(a) * int(b) for a, b in zip(queries[live[x]], vectors[part][y])))) for x, y in zip(i, j)], object)
        good = s >= floors[live[i]]
        i, j, s = i[good], j[good], s[good]
        found = _best(*(np.concatenate(x) for x in zip(found, (live[i], ids[part][j], s))), k)
        counts = np.bincount(found[0], minlength=len(floors))
        full = np.flatnonzero(counts >= k)
        if len(full):
            last = np.cumsum(counts)[full] - 1
            floors[full] = np.maximum(floors[full], found[2][last].astype(float))
    return found


_OUT = "row long, query_id long, vec_id long, score long"


def _searcher(rotation: np.ndarray, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("row", "query_id", "vec_id", "score")
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        d = len(rotation)
        q = next(_matrices(left["vec"].combine_chunks(), d))
        c = next(_matrices(right["vec"].combine_chunks(), d))
        q_rows, floors = left["row"].to_numpy(), left["floor"].to_numpy()
        at, ids, scores = search_block(q_rows, q, floors, right["row"].to_numpy(), right["vec_id"].to_numpy(), c, rotation, k)
        found = (q_rows[at], left["vec_id"].to_numpy()[at], ids, [int(x) for x in scores])
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, found)})
    return run


def live_pairs(asked: DataFrame, placed: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """For each query group the number of blocks that it can still gain from, and for each block of its query groups.

    ``asked`` has ``part`` and ``ratio``, the length a row needs to reach a query's floor; groups ascend by it.
    ``placed`` has ``block`` and ``norm``; blocks descend by it.  So a group's live blocks are the first ones, a block's
    live groups too, and one common order of both, with a row a group or block, gives the numbers: no pair is formed.
    """
    parts = asked.groupBy("part").agg(F.min("ratio").alias("value")).select("value", F.lit(1).alias("kind"), F.col("part").alias("number"))
    tops = placed.groupBy("block").agg(F.max("norm").alias("value")).select("value", F.lit(0).alias("kind"), F.col("block").alias("number"))
    order = [F.desc("value"), F.col("kind"), F.when(F.col("kind") == 0, F.col("number")).otherwise(-F.col("number"))]
    merged = numbered(tops.unionByName(parts), order, "place", 0)
    before = F.col("place") - F.when(F.col("kind") == 0, F.col("number")).otherwise(groups - 1 - F.col("number"))
    merged = written(merged.select("kind", "number", before.cast("int").alias("before")), "topk-live")
    reach = merged.filter("kind = 1").select(F.col("number").alias("part"), F.col("before").alias("blocks"))
    fans = merged.filter("kind = 0").select(F.col("number").alias("block"), (groups - F.col("before")).alias("parts"))
    return reach, fans


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query with all other rows.

    Queries are the rows whose id is divisible by ``every``; a query's candidates are all other rows.  Rows are
    numbered by descending length and cut into blocks of ``rows``; the first block gives every query a floor.  Queries
    are numbered by the length that a row needs to reach their floor and cut into groups of ``queries``, so only the
    blocks whose longest row has that length meet a group, each such pair in its own task; what is copied is what these
    tasks read.  The winners of the blocks meet in a limit per query, which Spark applies before the shuffle.  The
    rotation is the eigenbasis of the Gram matrix.

    Vectors that are NULL or hold NULL or non-finite components take no part, nor do rows without an id; shorter
    vectors count as filled up with zeros; ties go to the smaller id; of repeated ids, every row is a query of its own
    and a candidate of the others, so their ranks come once for each row; an empty table gives an empty result; scores
    beyond 64 bits are cut to the range of long.  Columns beside ``vec_id`` and ``embedding`` are not read.
    """
    spark = vectors.sparkSession
    placed = numbered(quantized(vectors, scale), [F.desc("norm"), "vec_id"], "row", 0)
    placed = placed.withColumn("block", F.floor(F.col("row") / rows).cast("int"))
    asked = written(placed.filter(F.col("vec_id") % every == 0).drop("block"), "topk-queries")
    groups = -(-asked.count() // queries)
    if not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    search = _searcher(np.linalg.eigh(gram(placed))[1][:, ::-1], k)

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select("part", "block", "row", "vec_id", "vec")
        return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(search, _OUT)

    low, longest = F.lit(float("-inf")), placed.filter("block = 0")
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("block", F.lit(0)).withColumn("floor", low)
    first = pairs(dealt, longest.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    found = first = written(first, "topk-first")
    if not placed.filter("block > 0").isEmpty():
        best = first.groupBy("row").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
        known = asked.join(best.filter(F.col("n") >= k).select("row", F.col("floor").cast("double")), "row", "left")
        known = known.withColumn("floor", F.coalesce("floor", low))
        slack = F.lit(2e-9) * (1 + F.abs("floor"))  # more than the bound's own in search_block
        ratio = F.when(F.col("norm") > 0, (F.col("floor") - slack) / F.col("norm")).when(F.col("floor") > 0, F.lit(float("inf"))).otherwise(low)
        known = known.withColumn("ratio", F.when(F.col("floor") == low, low).otherwise(F.nanvl(ratio, low)))
        known = numbered(known, ["ratio", "row"], "at", 0).withColumn("part", F.floor(F.col("at") / queries).cast("int"))
        reach, fans = live_pairs(known, placed, groups)
        left = known.join(reach.filter("blocks > 1"), "part").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
        right = placed.filter("block > 0").join(fans.filter("parts > 0"), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        found = first.unionByName(pairs(left, right))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
