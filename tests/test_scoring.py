import math

import pytest
from pyspark.sql import functions as F

from frames import NOW
from tidemark.plans import scoring

INPUTS = "engagement double, income int, balance double, age int, tier int, days int"


def rule(spark, rows):
    frame = spark.createDataFrame(rows, INPUTS)
    score = scoring.batch_rule(*[F.col(c) for c in frame.columns])
    return [tuple(r) for r in frame.select(score.alias("s")).select("s.*").collect()]


def test_batch_rule_boundaries(spark):
    got = rule(spark, [
        (0.61, 100001, 0.0, 20, 1, 0), (0.6, 100001, 80000.0, 20, 1, 0), (0.4, 70000, 80000.0, 20, 2, 29),
        (0.4, 75001, 0.0, 35, 1, 30), (0.3, 75001, 0.0, 55, 3, 61), (0.3, 75001, 0.0, 56, 3, 60),
        (None, None, None, None, None, None),
    ])
    assert [g[0] for g in got] == [0.85, 0.70, 0.55, 0.40, 0.40, 0.25, 0.25]
    assert [g[1] for g in got] == [0.90, 0.90, 0.75, 0.75, 0.60, 0.60, 0.60]
    assert [g[2] for g in got] == [
        "Schedule_Wealth_Consultation", "Upgrade_Service_Tier", "Educational_Content", "Upgrade_Service_Tier",
        "Re_engagement_Campaign", "Educational_Content", "Educational_Content"]


def arrays(spark, scorer, rows):
    rows = [[None if v is None else float(v) for v in r] for r in rows]
    frame = spark.createDataFrame([(r,) for r in rows], "f array<double>")
    return [r.s for r in frame.select(scorer(F.col("f")).alias("s")).collect()]


def test_points_score(spark):
    full = [12.0] + [1.5] * 29  # activity, engagement, income and priority decide
    full[5], full[8], full[26] = 40, 60000, 70
    empty = [0.0] * 30
    missing = [None] * 30
    capped = list(full)
    capped[0], capped[5], capped[8], capped[26] = 21, 1000, 150001, 400
    got = arrays(spark, scoring.points_score, [full, full[:29], empty, missing, capped])
    assert got[0] == pytest.approx((20 + 10 + 10 + 14) / 100)
    assert got[1] == 0.5
    # Zero and missing inputs: income 50 000 earns nothing, priority counts 50.
    assert got[2] == got[3] == pytest.approx(0.10)
    assert got[4] == 1.0


def test_logistic_score(spark):
    got = arrays(spark, scoring.logistic_score, [[10.0] * 7 + [9e9], [0.0] * 30, [], [None] + [1.0] * 29, [3.0, 5.0]])
    assert got[0] == pytest.approx(0.5)
    assert got[1] == pytest.approx(1 / (1 + math.exp(1)))
    assert got[2] == got[3] == 0.5
    assert got[4] == pytest.approx(1 / (1 + math.exp(0.6)))


def test_fallback_rules(spark):
    frame = spark.createDataFrame(
        [(0.61, 100001, 0.0), (0.31, 10, 50001.0), (0.3, 10, 50001.0), (None, 80000, 1.0), (0.51, None, 0.0), (0.5, None, 0.0), (0.51, 75001, 0.0)],
        "e double, i int, b double")
    tiered = frame.select(scoring.fallback_tiered(F.col("e"), F.col("i"), F.col("b")).alias("s")).select("s.*").collect()
    assert [r.conversion_probability for r in tiered] == [0.75, 0.55, 0.30, 0.30, 0.30, 0.30, 0.30]
    assert {r.source for r in tiered} == {"fallback"} and {r.confidence for r in tiered} == {0.7}
    simple = frame.select(scoring.fallback_simple(F.col("e"), F.col("i")).alias("s")).select("s.*").collect()
    assert [r.conversion_probability for r in simple] == [0.7, 0.3, 0.3, 0.3, 0.3, 0.3, 0.7]
    assert simple[3].next_action == "Educational_Content" and {r.confidence for r in simple} == {0.8}


STORE = ("client_id string, lifecycle_stage string, age_segment string, tenure_segment string, total_events_30d bigint, "
         "engagement_score_30d double, business_priority_score double, annual_income int, years_to_retirement int, "
         "conversion_target int")


def test_rule_scores_and_predictions(spark):
    rows = [("a", "Active", "Young", "New", 30, 1.0, 0.9, 150001, 10, 1), ("b", "New", "Young", "New", 0, 0.0, 0.0, 50000, 10, 0),
            ("c", None, None, None, None, None, None, None, None, None), ("d", "New", "Young", "New", 20, 0.4, 0.5, 75000, 1, 0)]
    got = {r.client_id: r for r in scoring.rule_scores(spark.createDataFrame(rows, STORE)).collect()}
    assert got["a"].raw_score == pytest.approx(40 + 0.25 + 20 + 0.135) and got["a"].conversion_likelihood == "Medium"
    assert got["b"].raw_score == 0 and got["b"].conversion_likelihood == "Low"
    assert got["c"].conversion_probability is None and got["c"].conversion_likelihood == "Low"
    preds = {r.client_id: r.prediction for r in scoring.predictions(scoring.rule_scores(spark.createDataFrame(rows, STORE))).collect()}
    assert preds == {"a": 1.0, "b": 0.0, "c": None, "d": 0.0}


def test_ordinal_labels_are_a_parameter(spark):
    frame = spark.createDataFrame([("At Risk",), ("At_Risk",), ("New",), (None,)], "lifecycle_stage string")
    emitted = [r.c for r in frame.select(scoring.ordinal("lifecycle_stage", scoring.EMITTED_LABELS["lifecycle_stage"]).alias("c")).collect()]
    declared = [r.c for r in frame.select(scoring.ordinal("lifecycle_stage", scoring.DECLARED_LABELS["lifecycle_stage"]).alias("c")).collect()]
    assert emitted == [4, 4, 1, 0] and declared == [5, 5, 1, 0]


def test_thirty_inputs():
    assert len(scoring.NUMERIC_FEATURES) == 27 and len(scoring.CATEGORICAL_FEATURES) == 3


DAILY = ("client_id string, lifecycle_stage string, engagement_score_30d double, annual_income int, current_401k_balance double, "
         "age int, service_tier_numeric int, days_since_last_activity int, business_priority_score double")


def daily_store(spark):
    return spark.createDataFrame([
        ("a", "Active", 0.7, 120000, 0.0, 40, 3, 1, 0.8), ("b", "Dormant", 0.7, 120000, 0.0, 40, 3, 200, 0.8),
        ("c", None, 0.0, 1, 0.0, 40, 1, 5, 0.1), ("d", "At_Risk", 0.0, 1, 0.0, 40, 1, 95, 0.1)], DAILY)


def test_daily_scores_leave_out_dormant_and_unknown(spark):
    rows = scoring.daily_scores(daily_store(spark), NOW).orderBy("client_id").collect()
    assert [r.client_id for r in rows] == ["a", "d"]
    assert rows[0].conversion_probability == 0.85 and rows[0].conversion_likelihood == "High"
    assert rows[0].churn_probability is None and rows[0].inference_source == "batch"


def test_daily_job_is_idempotent(spark, tmp_path):
    location = str(tmp_path / "predictions")
    assert scoring.run_daily_scoring(daily_store(spark), "daily_predictions", NOW, location=location) == 2
    assert scoring.run_daily_scoring(daily_store(spark), "daily_predictions", NOW) == 2
    assert scoring.run_daily_scoring(daily_store(spark), "daily_predictions", NOW.replace(day=2)) == 2
    assert spark.table("daily_predictions").count() == 4


def test_score_unscored(spark):
    done = spark.createDataFrame([("a",)], "client_id string")
    fresh = scoring.score_unscored(daily_store(spark), done, NOW, limit=2)
    assert [r.client_id for r in fresh.orderBy("client_id").collect()] == ["b", "c"]
    assert {r.inference_source for r in fresh.collect()} == {"Batch_Process"}


def test_score_and_log(spark, tmp_path):
    path = str(tmp_path / "log")
    answer = scoring.score_and_log(daily_store(spark), path, NOW)
    assert answer.count() == 4
    log = spark.read.parquet(path)
    assert log.count() == 4 and log.select("inference_id").distinct().count() == 4
    assert {r.source for r in log.collect()} == {"fallback"}
