"""Model training on ``pyspark.ml`` and a table-backed model registry."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import at, ratio
from tidemark.operators import hash_split, top_rows
from tidemark.plans.scoring import CATEGORICAL_FEATURES, EMITTED_LABELS, NUMERIC_FEATURES, ordinal
from tidemark.session import cut_lineage

TARGETS = ("conversion_target", "churn_target", "next_best_action")
MISSING = "missing_inputs"
DEAL = 5_000  # rows that are worth a task of their own in training
ENCODED = tuple(f"{c}_encoded" for c in CATEGORICAL_FEATURES)


def labelled_frame(store: DataFrame) -> DataFrame:
    """Key, 27 numeric and 3 categorical features; all three targets known."""
    return store.select("client_id", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, *TARGETS).dropna(
        subset=list(TARGETS))


def complete_rows(frame: DataFrame, features: Sequence[str] = NUMERIC_FEATURES[:10]) -> DataFrame:
    return frame.dropna(subset=list(features))


def ordinal_encoded(frame: DataFrame, labels: Mapping[str, Sequence[str]] = EMITTED_LABELS) -> DataFrame:
    return frame.withColumns({f"{c}_encoded": ordinal(c, labels[c]) for c in CATEGORICAL_FEATURES})


def one_hot(frame: DataFrame, columns: Sequence[str] = CATEGORICAL_FEATURES, limit: int = 5) -> DataFrame:
    """0/1 columns for the ``limit`` most frequent values of each column.

    Value discovery brings back at most ``limit`` labels per column; ties in
    frequency go to the smaller label.
    """
    new = {}
    for column in columns:
        counts = frame.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        for row in top_rows(counts, [F.col("n").desc(), F.col(column)], limit).collect():
            name = f"{column}_{row[0]}".replace(" ", "_").replace("-", "_").lower()
            new[name] = F.when(F.col(column) == row[0], 1).otherwise(0)
    return frame.withColumns(new) if new else frame


def split(frame: DataFrame, test_fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """80/20 split by client, repeatable over any partitioning."""
    return hash_split(frame, "client_id", test_fraction, str(seed))


def boosted_trees(label: str, trees: int = 100, depth: int = 6, rate: float = 0.1, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(labelCol=label, featuresCol="features", maxDepth=depth, maxIter=trees,
                         stepSize=rate, seed=seed)


def random_forest(label: str, trees: int = 100, depth: int = 10, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees,
                                  maxDepth=depth, seed=seed)


def _filled(frame: DataFrame, inputs: Sequence[str]) -> DataFrame:
    known = [F.col(c).cast("double") for c in inputs]
    missing = sum((F.when(v.isNull() | F.isnan(v), 1).otherwise(0) for v in known), F.lit(0))
    return frame.withColumns({MISSING: missing, **{c: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) for c, v in zip(inputs, known)}})


def dealt(frame: DataFrame) -> DataFrame:
    """A checkpointed frame, spread by client over as many tasks as there are cores or ``DEAL`` rows in it.

    The feature plan leaves as few partitions as its bytes fill, and the passes over them would use no more cores.
    """
    wanted = min(frame.sparkSession.sparkContext.defaultParallelism, -(-frame.count() // DEAL))
    if frame.rdd.getNumPartitions() >= wanted:
        return frame
    return cut_lineage(frame.repartition(wanted, "client_id"))


def fit(train: DataFrame, classifier, inputs: Sequence[str] = NUMERIC_FEATURES) -> PipelineModel:
    """Assemble and fit, on the 27 numeric inputs by default.  Trees read the data once per level, so the frame is
    checkpointed: the feature plan runs once and survives lost executors, and the rows are dealt over the cores.
    A missing input counts as 0, and how many a row misses is an input too, so
    only rows without a label are left out."""
    label = classifier.getLabelCol()
    ready = _filled(train.select("client_id", label, *inputs).dropna(subset=[label]), inputs)
    assembler = VectorAssembler(inputCols=[*inputs, MISSING], outputCol="features")
    return Pipeline(stages=[assembler, classifier]).fit(dealt(cut_lineage(ready)))


def predict(model: PipelineModel, frame: DataFrame, label: str = "conversion_target") -> DataFrame:
    """(client_id, label, prediction, probability of class 1) of every row."""
    inputs = [c for c in model.stages[0].getInputCols() if c != MISSING]
    scored = model.transform(_filled(frame, inputs))
    return scored.select(
        "client_id", F.col(label).alias("actual_conversion"), "prediction",
        vector_to_array("probability")[1].alias("probability"))


def classification_metrics(scored: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 in one aggregate row."""
    predicted, actual = F.col("prediction") == 1, F.col("actual_conversion") == 1
    tp = F.count_if(predicted & actual)
    row = scored.agg(
        ratio(F.count_if(F.col("prediction") == F.col("actual_conversion")), F.count("*")).alias("accuracy"),
        F.coalesce(ratio(tp, F.count_if(predicted)), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(tp, F.count_if(actual)), F.lit(0.0)).alias("recall"),
        F.count("*").alias("rows"),
    )
    p, r = F.col("precision"), F.col("recall")
    return row.withColumn("f1", F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)))


def area_under_roc(scored: DataFrame) -> float:
    renamed = scored.select(F.col("actual_conversion").cast("double").alias("label"), "probability")
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability").evaluate(renamed)


@dataclass
class Champion:
    name: str
    model: PipelineModel
    metrics: dict[str, float]


def train_champion(store: DataFrame, label: str = "conversion_target", trees: int = 100,
                   candidates: Mapping[str, object] | None = None) -> Champion:
    """Train boosted trees and a random forest; the better F1 wins, boosted
    trees on a tie."""
    frame = cut_lineage(ordinal_encoded(labelled_frame(store)))
    train, test = split(frame)
    candidates = candidates or {
        "BoostedTrees": boosted_trees(label, trees), "RandomForest": random_forest(label, trees),
    }
    best = None
    for name, classifier in candidates.items():
        model = fit(train, classifier)
        metrics = classification_metrics(predict(model, test, label)).first().asDict()
        if best is None or (metrics["f1"] or 0.0) > (best.metrics["f1"] or 0.0):
            best = Champion(name, model, metrics)
    return best


# --------------------------------------------------------------------------
# Registry: a folder of saved models plus one Parquet log
# --------------------------------------------------------------------------

REGISTRY_SCHEMA = (
    "model_name string, model_version string, model_type string, path string, "
    "metrics map<string,double>, tags map<string,string>, registered_timestamp timestamp_ntz, "
    "row_timestamp timestamp_ntz"
)


def _registry(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(os.path.join(root, "registry"))


def register_model(model: PipelineModel, root: str, name: str, version: str, model_type: str,
                   metrics: Mapping[str, float], tags: Mapping[str, str], as_of: datetime) -> str:
    """Save the model and log it.  A (name, version) can be saved only once."""
    spark = SparkSession.active()
    path = os.path.join(root, "models", name, version)
    model.save(path)
    row = (name, version, model_type, path, {k: float(v) for k, v in metrics.items() if v is not None},
           dict(tags), as_of, as_of)
    spark.createDataFrame([row], REGISTRY_SCHEMA).write.mode("append").parquet(os.path.join(root, "registry"))
    return path


def set_tags(root: str, name: str, version: str, tags: Mapping[str, str], as_of: datetime) -> None:
    """Add tags by appending a newer row of the same registration that carries them."""
    current = registered(SparkSession.active(), root, name, version).first()
    row = current.asDict() | {"tags": {**(current["tags"] or {}), **tags}, "row_timestamp": as_of}
    spark = SparkSession.active()
    spark.createDataFrame([tuple(row[c] for c in current.__fields__)], REGISTRY_SCHEMA).write.mode(
        "append").parquet(os.path.join(root, "registry"))


def registered(spark: SparkSession, root: str, name: str, version: str = "LAST") -> DataFrame:
    """Newest registry row of a version, or of the newest version (``LAST``)."""
    rows = _registry(spark, root).filter(F.col("model_name") == name)
    if version != "LAST":
        rows = rows.filter(F.col("model_version") == version)
    order = ("registered_timestamp", "model_version", "row_timestamp")
    return top_rows(rows, [F.col(c).desc() for c in order], 1)


def load_model(spark: SparkSession, root: str, name: str, version: str = "LAST") -> PipelineModel:
    row = registered(spark, root, name, version).first()
    if row is None:
        raise LookupError(f"no model {name} version {version} under {root}")
    return PipelineModel.load(row["path"])


def registry_predictions(spark: SparkSession, root: str, name: str, store: DataFrame,
                         version: str = "LAST", label: str = "conversion_target") -> DataFrame:
    """Batch inference by registered name and version, keyed by client.

    Every client is returned and scored.
    """
    model = load_model(spark, root, name, version)
    context = store.select("client_id", "lifecycle_stage", "age_segment", "business_priority_score",
                           F.col(label).alias("actual_conversion"))
    scored = predict(model, ordinal_encoded(store), label).drop("actual_conversion")
    return context.join(scored, "client_id", "left").select(
        "client_id", "lifecycle_stage", "age_segment", "business_priority_score",
        "prediction", "probability", "actual_conversion")


def deployment_metadata(champion: Champion, name: str, version: str, as_of: datetime) -> DataFrame:
    spark = SparkSession.active()
    return spark.range(1).select(
        F.lit(name).alias("model_name"), F.lit(version).alias("model_version"),
        F.lit(champion.name).alias("model_type"),
        F.lit(round(champion.metrics["f1"] or 0.0, 4)).alias("f1_score"),
        at(as_of).alias("registered_timestamp"), F.lit(True).alias("deployment_ready"),
        F.lit("Production").alias("deployment_stage"),
    )


def register_sql_scorer(spark: SparkSession, name: str, function, returns: str = "double") -> None:
    """Expose a vectorised Python scorer to SQL (extension point; the built-in
    scorers are column expressions and do not need it)."""
    spark.udf.register(name, F.pandas_udf(function, returns))
