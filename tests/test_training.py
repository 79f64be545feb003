import pytest
from pyspark.sql import functions as F

from checks.domain import Domain
from frames import NOW
from tidemark.plans import training
from tidemark.session import shared_dir


@pytest.fixture(scope="module")
def store(spark):
    return Domain(spark, "/root/testdata/sf0.01").store.persist()


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named if named else shared_dir(spark)


def test_frames(spark, store):
    frame = training.labelled_frame(store)
    assert len(frame.columns) == 1 + 27 + 3 + 3
    assert training.complete_rows(frame).count() <= frame.count()
    hot = training.one_hot(frame.select("client_id", "lifecycle_stage"), ["lifecycle_stage"], limit=2)
    assert len(hot.columns) == 4 and all(c == c.lower() for c in hot.columns)


def test_split_is_stable(spark, store):
    train, test = training.split(store)
    again = training.split(store.repartition(5))[1]
    assert train.count() + test.count() == store.count() and test.exceptAll(again).isEmpty()


def test_champion_registry_and_inference(spark, store, tmp_path):
    small = {"BoostedTrees": training.boosted_trees("conversion_target", trees=2, depth=2),
             "RandomForest": training.random_forest("conversion_target", trees=3, depth=3)}
    best = training.train_champion(store, candidates=small)
    assert best.name in small and 0 <= best.metrics["accuracy"] <= 1
    root = str(tmp_path / "registry")
    training.register_model(best.model, root, "M", "V1", best.name, best.metrics, {"target": "conversion"}, NOW)
    with pytest.raises(Exception, match="exists"):
        training.register_model(best.model, root, "M", "V1", best.name, best.metrics, {}, NOW)
    training.set_tags(root, "M", "V1", {"latest_accuracy": "0.7"}, NOW.replace(hour=13))
    row = training.registered(spark, root, "M").first()
    assert row.tags == {"target": "conversion", "latest_accuracy": "0.7"} and row.metrics["f1"] == pytest.approx(best.metrics["f1"])
    training.register_model(best.model, root, "M", "V2", best.name, best.metrics, {}, NOW.replace(hour=14))
    training.set_tags(root, "M", "V1", {"late": "yes"}, NOW.replace(hour=15))
    assert training.registered(spark, root, "M").first().model_version == "V2"
    assert training.registered(spark, root, "M", "V1").first().tags["late"] == "yes"
    scored = training.registry_predictions(spark, root, "M", store.withColumn("annual_income", F.when(F.col("annual_income") % 2 == 0, F.col("annual_income"))))
    assert scored.count() == store.count()
    assert scored.filter(~F.col("probability").between(0, 1)).isEmpty()
    assert 0 <= training.area_under_roc(scored) <= 1
    with pytest.raises(LookupError):
        training.load_model(spark, root, "M", "V9")
    assert training.deployment_metadata(best, "M", "V1", NOW).first().deployment_ready


def test_scores_of_unseen_rows_beat_the_base_rate(spark, store):
    """A label that two of the inputs decide: models must find it in clients they have not seen."""
    decided = store.withColumn("conversion_target", F.when((F.col("annual_income") > 250_000) | (F.col("age") > 60), 1).otherwise(0))
    train, test = training.split(decided)
    for classifier in (training.boosted_trees("conversion_target", trees=5, depth=3), training.random_forest("conversion_target", trees=10, depth=6)):
        scored = training.predict(training.fit(train, classifier), test).persist()
        base = scored.agg(F.avg("actual_conversion")).first()[0]
        assert training.classification_metrics(scored).first().accuracy > max(base, 1 - base) + 0.1
        assert training.area_under_roc(scored) > 0.85
        assert scored.select("probability").distinct().count() > 1


def test_registry_inference_builds_the_store_once(spark, monkeypatch):
    from checks import live
    seen = []
    monkeypatch.setattr(live.training, "train_champion", lambda store: seen.append(store) or training.Champion("M", None, {}))
    monkeypatch.setattr(live.training, "register_model", lambda *args: "")
    monkeypatch.setattr(live.training, "registry_predictions", lambda spark, root, name, store: seen.append(store) or store)
    live._registry(Domain(spark, "/root/testdata/sf0.001"))
    assert seen[0] is seen[1] and all("feature-store" in name for name in seen[0].inputFiles())


def test_metrics_by_hand(spark):
    rows = [(1, 1.0), (1, 0.0), (0, 1.0), (0, 0.0), (1, 1.0)]
    row = training.classification_metrics(spark.createDataFrame(rows, "actual_conversion int, prediction double")).first()
    assert (row.accuracy, row.precision, row.recall) == (0.6, pytest.approx(2 / 3), pytest.approx(2 / 3))
    none = training.classification_metrics(spark.createDataFrame([(1, 0.0)], "actual_conversion int, prediction double")).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_sql_scorer(spark):
    training.register_sql_scorer(spark, "halve", lambda s: s / 2)
    assert spark.sql("SELECT halve(3.0D)").first()[0] == 1.5


def test_training_rows_in_one_partition_are_dealt_over_the_cores(spark):
    from pyspark.ml import Estimator
    from pyspark.ml.feature import VectorAssembler

    class Seen(Estimator):
        def getLabelCol(self):
            return "label"

        def _fit(self, data):
            self.parts, self.rows = data.rdd.getNumPartitions(), sorted(r.client_id for r in data.select("client_id").collect())
            return VectorAssembler(inputCols=["a"], outputCol="b")

    cores = spark.sparkContext.defaultParallelism
    for rows in (100, 3 * training.DEAL):
        seen = Seen()
        training.fit(spark.range(rows).coalesce(1).selectExpr("id AS client_id", "id % 2 AS label", "id * 0.5 AS a"), seen, ["a"])
        assert seen.parts == min(cores, max(1, rows // training.DEAL)) and seen.rows == list(range(rows))
