"""Quality of documents: a classifier's evidence under hierarchical empirical Bayes priors of host and path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemark.llm.common import hashed_sample, salted_join, written

FEATURES = ("upper", "digit", "blank", "point", "exclaim", "bar", "symbol", "foreign", "word_length", "distinct", "repeat_lines", "adjacent")
SAMPLE, RIDGE, STEPS = 20_000, 1e-2, 25
CUT = 0.35

_POINT, _SYMBOL = np.frombuffer(b".,;:?'\"()-", np.uint8), np.frombuffer(b"#*$%&<>@^~=+_/\\{}[]`", np.uint8)


def features(text: str | None) -> list[float]:
    """Shares of byte classes, mean word length, share of different words, of repeated lines and of words that repeat the
    word before; all 0 for a text without words."""
    data = (text or "").encode("utf-8", "replace")
    ws = data.split()
    if not ws:
        return [0.0] * len(FEATURES)
    n = len(data)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    adjacent = sum(map(bytes.__eq__, ws, ws[1:]))
    return [hist[65:91].sum() / n, hist[48:58].sum() / n, (hist[32] + hist[9:14].sum()) / n, hist[_POINT].sum() / n, hist[33] / n, hist[124] / n,
            hist[_SYMBOL].sum() / n, hist[128:].sum() / n, min(3.0, n / len(ws) / 10), (len(set(ws)) / len(ws)) ** 0.5,
            1 - len(set(lines)) / len(lines), adjacent / len(ws)]


def with_features(docs: DataFrame, name: str = "_quality") -> DataFrame:
    """All columns of ``docs`` and the array of features under ``name``."""
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(batches):
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column(at)]
            columns = [*batch.columns, pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on standardized features by Newton steps; weights for the raw features, intercept last.

    Without both classes the weights are 0 and the intercept is the log-odds with one pseudo-row of each class."""
    out = np.zeros(len(FEATURES) + 1)
    out[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return out
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z / len(z) + RIDGE * np.eye(len(w))
        w = w - np.linalg.solve(h, z.T @ (p - y) / len(z) + RIDGE * w)
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - raw @ mean)


def evidence(name: str, weights: np.ndarray) -> Column:
    """The classifier's log-odds from the feature array."""
    total = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        total = total + F.get(F.col(name), F.lit(i)) * F.lit(float(w))
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def priors(judged: DataFrame) -> tuple[DataFrame, float]:
    """Counts, sums, strengths and posterior means of quality per (host, path), and the global mean.

    ``judged`` has ``host``, ``path`` and ``p``, the classifier's probability.  Counts and sums are grouped by path,
    then by host, so a host with a third of all rows costs one row per task.  Each level's strength is its expected
    count of rows by the method of moments: the variance of probabilities within the sites against the variance
    between the sites' true means.
    """
    paths = judged.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = written(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("q").alias("host_q"))
    total, good = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    mean = ((good or 0.0) + 1) / ((total or 0) + 2)

    def strength(rows: DataFrame, n: str, s: str, q: str, at: Column) -> float:
        spread, inner, groups, size = rows.filter(F.col(n) >= 2).agg(
            F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - at, 2)), F.sum(F.col(q) - F.col(s) * F.col(s) / F.col(n)), F.count(F.lit(1)), F.sum(n)).first()
        if not groups or groups < 2:
            return 10.0
        within = max(0.0, inner) / (size - groups)
        between = max(1e-6, (spread - groups * within) / size)
        return float(min(1e6, max(1.0, within / between)))

    k = strength(hosts, "host_n", "host_s", "host_q", F.lit(mean))
    hosts = hosts.withColumn("host_mean", (F.col("host_s") + k * mean) / (F.col("host_n") + k))
    both = paths.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
    both = written(both.drop("of", "host_q"), "quality-sites")
    k2 = strength(both, "n", "s", "q", F.col("host_mean"))
    both = both.withColumn("path_mean", (F.col("s") + k2 * F.col("host_mean")) / (F.col("n") + k2))
    return both.withColumn("host_strength", F.lit(k)).withColumn("path_strength", F.lit(k2)), mean


def _judged(docs: DataFrame, labels: DataFrame, host: str, path: str, sample: int):
    """Features of all documents, the fitted weights and the site priors."""
    narrow = with_features(docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), "text")).drop("text")
    narrow = written(narrow, "quality-features")
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = hashed_sample(narrow.join(known, "doc_id").select("doc_id", "_quality", "quality"), "doc_id", sample).collect()
    weights = fit(np.array([r[1] for r in rows]).reshape(-1, len(FEATURES)), np.array([float(r[2] > 0) for r in rows]))
    judged = narrow.withColumn("evidence", evidence("_quality", weights)).withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    sites, mean = priors(judged)
    return judged, weights, sites, mean


def _decided(rows: DataFrame, sites: DataFrame, mean: float, host: str, path: str, cut: float) -> DataFrame:
    """Adds the site's means and the posterior: the document's odds times the site's odds over the global odds.

    The document's own probability is taken out of its host's and its path's sums first, so it counts once.
    """
    keyed = rows.withColumn("_site", F.struct(F.coalesce(host, F.lit("")), F.col(host).isNull(), F.coalesce(path, F.lit("")), F.col(path).isNull()).cast("string"))
    named = sites.select(
        F.struct(F.coalesce("host", F.lit("")), F.col("host").isNull(), F.coalesce("path", F.lit("")), F.col("path").isNull()).cast("string").alias("_site"),
        F.struct("n", "s", "host_n", "host_s", "host_strength", "path_strength").alias("_of"))
    joined = salted_join(keyed.withColumn("_spread", F.xxhash64("text" if "text" in rows.columns else "doc_id")), named, "_site", "_spread").drop("_site", "_spread")
    p, k, k2 = 1 / (1 + F.exp(-F.col("_evidence"))), F.col("_of.host_strength"), F.col("_of.path_strength")
    others = lambda s: F.greatest(F.lit(0.0), F.col(s) - p)
    joined = joined.withColumn("_host_mean", (others("_of.host_s") + k * mean) / (F.col("_of.host_n") - 1 + k))
    joined = joined.withColumn("_path_mean", (others("_of.s") + k2 * F.col("_host_mean")) / (F.col("_of.n") - 1 + k2)).drop("_of")
    odds = F.col("_evidence") + _logit(F.col("_path_mean")) - F.lit(float(np.log(mean / (1 - mean))))
    return joined.withColumn("_posterior", 1 / (1 + F.exp(-odds))).withColumn("_keep", F.col("_posterior") >= cut)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """``doc_id, evidence, host_mean, path_mean, posterior, keep`` of every document.

    The classifier is fitted on at most ``sample`` labelled documents (least hashes of the id); everything else covers
    all rows.  Documents have no URL, so the host is the ``source`` and the path below it the ``lang``.  A site with few rows
    stays near its host's mean, a small host near the global mean; both are of the site's other documents.  A document
    is kept from a posterior of ``cut`` up, below one half, as a clean document lost costs more than a poor one kept.

    NULL or empty text has zero features; NULL host or path is a site of its own; repeated ids take the lowest label
    and are judged row by row; without labels every document has even odds and is kept; an empty table gives an empty
    result.  Long texts are measured whole, one at a time; columns beside those named are not read.
    """
    judged, _, sites, mean = _judged(docs, labels, host, path, sample)
    rows = judged.select("doc_id", F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("evidence").alias("_evidence"))
    out = _decided(rows, sites, mean, "_host", "_path", cut)
    return out.select("doc_id", F.col("_evidence").alias("evidence"), F.col("_host_mean").alias("host_mean"), F.col("_path_mean").alias("path_mean"),
                      F.col("_posterior").alias("posterior"), F.col("_keep").alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """The documents that ``classify`` keeps, with all their columns.

    Features are computed a second time beside the rows, instead of shuffling the texts to join them by id."""
    _, weights, sites, mean = _judged(docs, labels, host, path, sample)
    rows = docs.select(F.struct("*").alias("_row"), F.col(host).alias("_host"), F.col(path).alias("_path"), "text")
    rows = with_features(rows).withColumn("_evidence", evidence("_quality", weights))
    return _decided(rows, sites, mean, "_host", "_path", cut).filter("_keep").select("_row.*")
