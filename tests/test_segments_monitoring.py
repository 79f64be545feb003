from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frames import NOW
from tidemark.plans import catalog, dashboards, impact, monitoring, reports, segments

PREDS = ("client_id string, lifecycle_stage string, age_segment string, business_priority_score double, prediction double, "
         "probability double, actual_conversion int")


def preds(spark, rows):
    return spark.createDataFrame([(f"c{n}", *r) for n, r in enumerate(rows)], PREDS)


def test_action_segments(spark):
    rows = [
        ("Active", "Young", 0.81, 1.0, 0.9, 1), ("Engaged", "Pre-Retirement", 0.8, 1.0, 0.9, 1), ("New", "Young", 0.1, 1.0, 0.9, 0),
        ("Growing", "Young", 0.1, 1.0, 0.9, 0), ("Active", "Young", 0.71, 0.0, 0.1, 0), ("At_Risk", "Young", 0.7, 0.0, 0.1, 0),
        ("At Risk", "Early Career", 0.1, 0.0, 0.1, 0), ("Onboarding", "Early Career", 0.1, 0.0, 0.1, 0), ("Dormant", "Young", 0.1, 0.0, 0.1, 0),
        (None, None, None, None, None, None),
    ]
    got = segments.client_segments(preds(spark, rows), NOW).orderBy("client_id").collect()
    assert [r.action_segment for r in got] == [
        "High Value - Immediate Outreach", "High Potential - Quick Follow-up", "New High Potential - Nurture",
        "Predicted Converter - Standard Outreach", "High Priority Non-Converter - Special Attention",
        "At Risk - Retention Focus", "At Risk - Retention Focus", "New Client - Education Focus",
        "Standard - Monitor", "Standard - Monitor"]
    assert [r.recommended_action for r in got][:3] == [
        "Schedule advisor meeting within 48 hours", "Send personalized wealth advisory email",
        "Include in targeted conversion campaign"]
    assert got[5].recommended_action == "Retention outreach - check satisfaction"
    assert got[7].recommended_action == "Educational content series"


def test_hundred_point_scale_is_a_parameter(spark):
    got = segments.client_segments(preds(spark, [("Active", "Young", 81.0, 1.0, 0.9, 1)]), NOW, high=80, elevated=70).first()
    assert got.action_segment == "High Value - Immediate Outreach"


STORE = ("client_id string, lifecycle_stage string, age_segment string, client_tenure_months int, total_assets_under_management double, "
         "days_since_last_activity int, engagement_score_30d double, total_events_30d bigint, churn_probability double, "
         "business_priority_score double, churn_target int, annual_income int")


def store(spark, rows):
    return spark.createDataFrame([(f"c{n}", *r, 0.5, 0, 1000) for n, r in enumerate(rows)], STORE)


def test_churn_rules(spark):
    rows = [
        ("Active", "Young", 24, 500000.01, 61, 0.5, 5, 0.1), ("Active", "Young", 24, 250000.01, 61, 0.5, 5, 0.1),
        ("Active", "Pre-Retirement", 24, 500000.0, 60, 0.5, 5, 0.1), ("Active", "Young", 11, 100000.0, 30, 0.09, 5, 0.1),
        ("Active", "Young", 24, 1.0, 0, 0.5, 0, 0.1), ("At_Risk", "Young", 24, 1.0, 0, 0.5, 1, 0.1),
        ("Dormant", "Young", 24, 1.0, None, 0.5, 1, 0.1), ("Active", "Young", 24, 1.0, 15, 0.1, 1, None),
        ("Active", "Young", 24, 1.0, 14, 0.1, 1, 0.12345),
    ]
    frame = store(spark, rows)
    scored = segments.client_segments(
        frame.select("client_id", "lifecycle_stage", "age_segment", "business_priority_score",
                     F.lit(0.0).alias("prediction"), F.lit(0).alias("actual_conversion")), NOW)
    got = segments.churn_segments(frame, scored, NOW).orderBy("client_id").collect()
    assert [r.churn_risk_score for r in got] == [0.9, 0.9, 0.7, 0.6, 0.5, 0.7, 0.8, 0.2, 0.123]
    assert [r.value_tier for r in got][:4] == ["High Value", "Medium Value", "Medium Value", "Growth Potential"]
    assert [r.retention_segment for r in got] == [
        "Critical - Immediate Executive Intervention", "Critical - Urgent Advisor Outreach",
        "High Risk - Proactive Retention Required", "New Client Risk - Enhanced Onboarding",
        "Medium Risk - Re-engagement Campaign", "Medium Risk - Re-engagement Campaign",
        "Medium Risk - Re-engagement Campaign", "Early Warning - Check-in Required", "Low Risk - Standard Monitoring"]
    assert got[0].retention_action == "CEO/Senior Advisor personal call within 24 hours"
    assert got[2].retention_action == "Schedule retirement planning review"
    assert got[3].retention_action == "Educational webinar invitation"
    summary = segments.churn_executive_summary(segments.churn_segments(frame, scored, NOW), frame).first()
    assert (summary.critical_count, summary.assets_at_risk) == (2, 500000.01)


def test_performance_has_nulls_for_undefined_rates(spark):
    none_predicted = monitoring.model_performance(preds(spark, [("a", "b", 0.1, 0.0, 0.1, 1), ("a", "b", 0.1, 0.0, 0.1, 0)])).first()
    assert none_predicted.precision is None and none_predicted.recall == 0.0 and none_predicted.f1_score is None
    none_actual = monitoring.model_performance(preds(spark, [("a", "b", 0.1, 1.0, 0.9, 0)])).first()
    assert none_actual.recall is None and none_actual.precision == 0.0
    empty = monitoring.model_performance(preds(spark, [])).first()
    assert empty.total_predictions == 0 and empty.accuracy is None
    mixed = monitoring.model_performance(preds(spark, [
        ("a", "b", 0.1, 1.0, 0.9, 1), ("a", "b", 0.1, 1.0, 0.9, 0), ("a", "b", 0.1, 0.0, 0.9, 0), ("a", "b", 0.1, 0.0, 0.9, 1)])).first()
    assert (mixed.true_positives, mixed.false_positives, mixed.true_negatives, mixed.false_negatives) == (1, 1, 1, 1)
    assert mixed.accuracy == mixed.precision == mixed.recall == mixed.f1_score == 0.5


def test_performance_check_texts(spark):
    bad = monitoring.check_model_performance(preds(spark, [("a", "b", 0.1, 1.0, 0.9, 0)] * 3 + [("a", "b", 0.1, 1.0, 0.9, 1)])).first()
    assert bad.result == "RETRAINING RECOMMENDED: Performance dropped by 50.0%"
    good = monitoring.check_model_performance(preds(spark, [("a", "b", 0.1, 1.0, 0.9, 1)])).first()
    assert good.result == "Model performing well. Current accuracy: 100.0%"


def test_drift_scores(spark):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=n), f"c{n}", float(n % 2), 7.0, 100 + (50 if n >= 10 else 0)) for n in range(20)]
    frame = spark.createDataFrame(rows, "monitor_timestamp timestamp_ntz, client_id string, total_events_30d double, engagement_score_30d double, annual_income int")
    got = {r.feature_name: r for r in monitoring.window_drift(frame, n=10).collect()}
    assert got["total_events_30d"].drift_score == 0.0
    assert got["engagement_score_30d"].drift_score is None  # no deviation
    assert got["annual_income"].drift_score is None and got["annual_income"].current_mean == 150


def test_sampled_drift_severity(spark):
    rows = [(f"c{n}", 0.0 if n < 900 else 1.0, n % 2, 100 if n < 900 else 1) for n in range(1000)]
    frame = spark.createDataFrame(rows, "client_id string, engagement_score_30d double, total_events_30d int, days_since_last_activity int")
    got = {r.feature_name: r for r in monitoring.sampled_drift(frame).collect()}
    assert got["engagement_score_30d"].drift_severity == "High" and got["engagement_score_30d"].alert_triggered
    assert got["total_events_30d"].drift_severity == "Low" and not got["total_events_30d"].alert_triggered
    alerts = monitoring.drift_alert_rows(monitoring.sampled_drift(frame), NOW).collect()
    assert {r.feature_name for r in alerts} == {"engagement_score_30d", "days_since_last_activity"}


def test_prediction_drift_newest_seven_days(spark):
    rows = [(datetime(2024, 1, d, 5), float(d % 3 == 0)) for d in range(1, 11)]
    got = monitoring.prediction_drift(spark.createDataFrame(rows, "batch_timestamp timestamp_ntz, conversion_probability double")).collect()
    assert [r.prediction_date.day for r in got] == [10, 9, 8, 7, 6, 5, 4]
    assert got[-1].prev_positive_rate is None and got[0].daily_change == 1.0


PERF = "tracking_id string, evaluation_timestamp timestamp_ntz, model_name string, model_version string, metric_name string, metric_value double"
DRIFT = "drift_id string, check_timestamp timestamp_ntz, feature_name string, drift_score double, alert_triggered boolean"


@pytest.mark.parametrize("accuracy,score,text", [
    (0.64, 9.0, "ALERT: Model accuracy below threshold - 0.64"), (0.65, 2.5, "ALERT: High feature drift detected - 2.5"),
    (0.9, 2.0, "All systems normal"),
])
def test_alert_order(spark, accuracy, score, text):
    perf = spark.createDataFrame([("1", NOW, "m", "V1", "ACCURACY", accuracy), ("2", NOW - timedelta(hours=25), "m", "V1", "ACCURACY", 0.0)], PERF)
    drift = spark.createDataFrame([("1", NOW, "f", score, score > 2), ("2", NOW - timedelta(hours=25), "f", 99.0, True)], DRIFT)
    assert monitoring.check_alerts(perf, drift, NOW).first().alert_status == text
    assert monitoring.check_alerts(perf.limit(0), drift.limit(0), NOW).first().alert_status == "All systems normal"


def test_deployment_dashboard(spark):
    deployments = spark.createDataFrame([("m", "V1", NOW, "ACTIVE"), ("m", "V0", NOW, "RETIRED")], "model_name string, model_version string, deployment_timestamp timestamp_ntz, status string")
    snaps = spark.createDataFrame([("1", NOW, 5, 0.5), ("2", NOW - timedelta(1), 9, 0.9)], "monitoring_id string, prediction_timestamp timestamp_ntz, total_predictions bigint, avg_prediction_value double")
    drift = spark.createDataFrame([("1", NOW, "f", 3.0, True), ("2", NOW, "g", 0.1, False), ("3", NOW - timedelta(days=1), "h", 3.0, True)], DRIFT)
    row = monitoring.deployment_dashboard(deployments, snaps, drift, NOW).collect()
    assert len(row) == 1 and (row[0].predictions_last_batch, row[0].drift_alerts) == (5, 1)
    assert monitoring.deployment_dashboard(deployments, snaps, drift.limit(0), NOW).first().drift_alerts == 0
    assert monitoring.deployment_dashboard(deployments, snaps.limit(0), drift, NOW).isEmpty()


def test_impact_row(spark):
    conversion = spark.createDataFrame([(10, 4, 1000.0)], "clients_targeted bigint, predicted_conversions bigint, total_potential_revenue double")
    churn = spark.createDataFrame([(2, 500.0, 200, 1)], "at_risk_clients bigint, net_revenue_saved double, total_retention_cost bigint, high_value_at_risk bigint")
    row = impact.business_impact(conversion, churn, NOW).first()
    assert (row.conversion_rate, row.retention_rate, row.total_business_value, row.roi_percentage) == (0.4, 0.8, 1500.0, 650.0)
    free = churn.withColumn("total_retention_cost", F.lit(0))
    assert impact.business_impact(conversion, free, NOW).first().roi_percentage is None


def test_retention_costs(spark):
    frame = spark.createDataFrame([("Special Offer",), ("Something else",)], "a string")
    assert [r.c for r in frame.select(impact.retention_cost(F.col("a")).alias("c")).collect()] == [200, 100]


def test_client_360_merges_equal_rows(spark):
    clients = spark.createDataFrame([("a", "ADV_1"), ("b", "ADV_9")], "client_id string, assigned_advisor_id string")
    advisors = spark.createDataFrame([("ADV_1", "Ann", "x")], "advisor_id string, advisor_name string, specialization string")
    store_rows = spark.createDataFrame([("a", NOW, 0.1, 0.2, 0.3), ("a", NOW, 0.1, 0.2, 0.3), ("a", NOW - timedelta(1), 0.9, 0.9, 0.9)],
                                       "client_id string, feature_timestamp timestamp_ntz, engagement_score_30d double, churn_probability double, conversion_probability double")
    predictions = spark.createDataFrame([("a", NOW, "x", 0.5), ("a", NOW, "y", 0.5)], "client_id string, prediction_timestamp timestamp_ntz, recommended_action string, conversion_probability double")
    events = spark.createDataFrame([("e1", "a", NOW), ("e2", "a", NOW - timedelta(30)), ("e3", "a", NOW - timedelta(31)), (None, "a", NOW)],
                                   "event_id string, client_id string, event_timestamp timestamp_ntz")
    got = sorted((r.client_id, r.recommended_action or "", r.total_events_30d)
                 for r in dashboards.client_360(clients, advisors, store_rows, predictions, events, NOW).collect())
    # Two equal feature rows double the count; two different predictions give two rows.
    assert got == [("a", "x", 4), ("a", "y", 4), ("b", "", 0)]


def test_deployment_status_rows(spark):
    table = spark.createDataFrame([(NOW,), (NOW - timedelta(days=1),)], "prediction_timestamp timestamp_ntz")
    rows = dashboards.deployment_status(table, NOW).collect()
    assert [(r.status, r.daily_predictions) for r in rows] == [("ACTIVE", 1), ("INACTIVE", 0)]
    services = spark.createDataFrame([("scoring_realtime_v1",)], "service_name string")
    assert dashboards.deployment_status(table, NOW, services).collect()[1].status == "ACTIVE"


def test_catalog_definitions_and_registries(spark):
    from checks.domain import Domain
    frame = Domain(spark, "/root/testdata/sf0.001").store
    assert len(catalog.feature_view(frame).columns) == 45
    definitions = catalog.feature_definitions(frame)
    told = {r.feature_name: r.feature_description for r in definitions.collect()}
    assert len(told) == 52 and told["total_events_7d"] == "Engagement metrics over 7 days"
    assert told["age"] == "Client demographic features" and told["income_to_age_ratio"] == "Behavioral ratio metrics"
    assert told["lifecycle_stage"] == "Client feature"
    assert catalog.definition_listing(definitions).count() == 20
    counts = catalog.definitions_by_description(definitions).collect()
    assert sum(r.num_features for r in counts) == 52 and counts[0].num_features >= counts[-1].num_features
    assert catalog.feature_metadata(spark, NOW).first().version == "1.0"

    none = spark.createDataFrame([], "name string, version string")
    entity = catalog.new_entity(none, "CLIENT", ["client_id"], "Client entity", NOW)
    assert entity.count() == 1 and catalog.new_entity(entity, "CLIENT", ["client_id"], "again", NOW).isEmpty()
    view = catalog.new_feature_view(none, "V", "1.0", ["CLIENT"], "feature_timestamp", "d", "q", NOW)
    assert view.first().status == "ACTIVE" and view.first().schema_version == "1.0"
    assert catalog.new_feature_view(view, "V", "1.0", ["CLIENT"], None, "d", "q", NOW).isEmpty()
    assert catalog.new_feature_view(view, "V", "2.0", ["CLIENT"], None, "d", "q", NOW).count() == 1
    active = catalog.new_deployment(spark.createDataFrame([], "model_name string, status string"), "M", "V1", "table", "n", NOW)
    assert active.count() == 1 and catalog.new_deployment(active, "M", "V2", "table", "n", NOW).isEmpty()


def test_missing_key_features(spark):
    frame = spark.createDataFrame([(1, None, 2, 1), (1, 1, 1, 1), (None, 1, 1, None)], "a int, b int, c int, conversion_target int")
    row = reports.missing_key_features(frame, ["a", "b", "c"]).first()
    assert (row.total_records, row.missing_key_features) == (2, 1)
