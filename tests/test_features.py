from datetime import datetime

import pytest
from pyspark.sql import functions as F

from frames import CLIENTS, EVENTS, MICRO, NOW, client, days, event
from tidemark.plans import features


def events_frame(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def clients_frame(spark, rows):
    return spark.createDataFrame(rows, CLIENTS)


def test_window_bounds_are_inclusive(spark):
    rows = []
    for n, width in enumerate((7, 30, 90)):
        rows += [event(2 * n, back=days(width)), event(2 * n + 1, back=days(width) + MICRO)]
    row = features.engagement_features(events_frame(spark, rows), NOW).first()
    assert (row.total_events_7d, row.total_events_30d, row.total_events_90d) == (1, 3, 5)
    assert (row.web_visits_7d, row.web_visits_30d, row.web_visits_90d) == (1, 3, 5)


def test_events_after_the_clock_do_not_exist(spark):
    rows = [event(1), event(2, back=-days(1)), event(3, back=-MICRO)]
    row = features.engagement_features(events_frame(spark, rows), NOW).first()
    assert row.total_events_7d == 1 and row.days_since_last_activity == 0


def test_events_without_a_time_count_for_life_only(spark):
    rows = [(f"e{n}", "a", None, "web_visit", "Website", "Mobile", None, None, None) for n in range(2)]
    frame = events_frame(spark, rows)
    life = features.client_behaviors(frame, NOW).first()
    assert (life.total_lifetime_events, life.mobile_usage, life.engagement_span_days) == (2, 2, None)
    row = features.engagement_features(frame, NOW).first()
    assert (row.total_events_90d, row.active_days_30d, row.days_since_last_activity) == (0, 0, None)
    people = clients_frame(spark, [client("a")])
    assert features.feature_store(frame, people, NOW).first().lifecycle_stage == "Dormant"


def test_active_days_count_calendar_dates(spark):
    rows = [event(1), event(2, back=days(0.2)), event(3, back=days(1)), event(4, back=days(30)), event(5, back=days(31))]
    row = features.engagement_features(events_frame(spark, rows), NOW).first()
    assert row.active_days_30d == 3 and row.engagement_frequency_30d == round(4 / 3, 4)


def test_all_thirty_one_dates_fit(spark):
    rows = [event(n, back=days(n)) for n in range(31)]
    assert features.engagement_features(events_frame(spark, rows), NOW).first().active_days_30d == 31


def test_nulls_and_defaults(spark):
    rows = [event(1, value=None, converted=None), event(2, value=0.25, seconds=10, converted=True),
            event(3, seconds=None, converted=False)]
    row = features.engagement_features(events_frame(spark, rows), NOW).first()
    assert row.total_touchpoint_value_30d == 1.25
    assert row.avg_touchpoint_value_30d == 0.4167
    assert (row.avg_session_duration_30d, row.max_session_duration_30d, row.conversions_30d) == (10.0, 10, 1)


def test_client_without_recent_events(spark):
    row = features.engagement_features(events_frame(spark, [event(1, back=days(100))]), NOW).first()
    assert row.active_days_30d == 0
    assert row.engagement_frequency_30d == row.email_click_rate_30d == row.engagement_trend_30d == 0.0
    assert row.total_touchpoint_value_30d is None and row.avg_session_duration_30d is None


def test_email_rate_trend_and_score_cap(spark):
    rows = [event(n, kind="email_open", channel="Email") for n in range(400)]
    rows += [event(1000 + n, kind="email_click", channel="Email") for n in range(100)]
    row = features.engagement_features(events_frame(spark, rows), NOW).first()
    assert row.email_click_rate_30d == 0.25 and row.engagement_trend_30d == 3.0
    assert row.engagement_score_30d == 1.0


def test_clock_defaults_to_newest_event(spark):
    frame = events_frame(spark, [event(1, back=days(3)), event(2, back=days(9))])
    row = features.engagement_features(frame).first()
    assert row.feature_timestamp == NOW - days(3) and row.total_events_7d == 2


def test_days_since_counts_midnights(spark):
    rows = [event(1, back=NOW - datetime(2024, 5, 31, 23, 59))]
    assert features.engagement_features(events_frame(spark, rows), NOW).first().days_since_last_activity == 1


def test_behaviors_and_span(spark):
    rows = [event(1, channel="Phone", device="Mobile", kind="document_download", value=0.2),
            event(2, back=days(10), channel="In-Person", device="Tablet", kind="advisor_meeting", value=0.4)]
    row = features.client_behaviors(events_frame(spark, rows), NOW).first()
    assert (row.phone_preference_count, row.inperson_preference_count, row.mobile_usage, row.tablet_usage) == (1, 1, 1, 1)
    assert (row.education_engagement, row.advisor_meetings_total, row.engagement_span_days) == (1, 1, 10)
    assert row.avg_touchpoint_value == pytest.approx(0.3)


def test_financial_profile_codes_and_clamps(spark):
    rows = [client("low", age=20, income=1, balance=0.0, assets=0.0, tier="Gold", risk="x", experience=None),
            client("high", age=30, income=4000000, balance=9e9, assets=100000.0, tier="Elite"),
            client("over", assets=100000.01), client("unknown", age=None, income=None)]
    got = {r.client_id: r for r in features.financial_profile(clients_frame(spark, rows)).collect()}
    assert got["low"].income_to_age_ratio == 0.04
    assert (got["low"].service_tier_numeric, got["low"].risk_tolerance_numeric, got["low"].investment_experience_numeric) == (0, 0, 0)
    assert got["high"].retirement_readiness_score == 1.0 and got["high"].wealth_growth_potential == 1.0
    assert got["high"].premium_client_indicator == 0 and got["over"].premium_client_indicator == 1
    # A missing operand makes the bounded value unknown rather than the bound.
    assert got["unknown"].retirement_readiness_score is None and got["unknown"].wealth_growth_potential is None
    assert got["unknown"].income_to_age_ratio is None


def test_ratios_are_null_without_events(spark):
    store = features.financial_behavioral_features(
        clients_frame(spark, [client("a"), client("b")]), events_frame(spark, [event(1, device="Mobile")]), NOW)
    got = {r.client_id: r for r in store.collect()}
    assert got["a"].web_preference_ratio == 1.0 and got["a"].mobile_adoption_score == 1.0
    assert got["a"].lifetime_engagement_frequency == 1.0
    assert got["b"].total_lifetime_events == 0 and got["b"].avg_touchpoint_value == 0.0
    assert got["b"].web_preference_ratio is None and got["b"].mobile_adoption_score is None


@pytest.mark.parametrize("gap,tenure,stage", [
    (None, 24, "Dormant"), (181, 24, "Dormant"), (180, 24, "At_Risk"), (91, 24, "At_Risk"),
    (90, 5, "New"), (90, 6, "Growing"), (0, 17, "Growing"), (0, 18, "Active"),
])
def test_lifecycle_stage(spark, gap, tenure, stage):
    row = spark.range(1).select(features.lifecycle_stage(F.lit(gap).cast("int"), F.lit(tenure)).alias("s")).first()
    assert row.s == stage


def test_age_and_tenure_segments(spark):
    ages = {24: "Young", 34: "Young", 35: "Mid-Career", 49: "Mid-Career", 50: "Pre-Retirement",
            59: "Pre-Retirement", 60: "Near-Retirement", 80: "Near-Retirement"}
    tenures = {5: "New", 6: "Growing", 17: "Growing", 18: "Established", 35: "Established", 36: "Mature"}
    a = spark.createDataFrame([(k,) for k in ages], "v int").withColumn("s", features.age_segment(F.col("v")))
    t = spark.createDataFrame([(k,) for k in tenures], "v int").withColumn("s", features.tenure_segment(F.col("v")))
    assert dict(a.collect()) == ages and dict(t.collect()) == tenures


def test_targets_stay_in_range_and_repeat(spark):
    people = [client(f"c{n}", age=20 + n % 60, income=20000 + 997 * n, tenure=n % 50,
                     tier=("Basic", "Premium", "Elite", None)[n % 4], assets=1000.0 * n) for n in range(400)]
    acts = [event(n, client=f"c{n}", back=days(n % 220)) for n in range(0, 400, 2)]
    frames = clients_frame(spark, people), events_frame(spark, acts)
    segments = features.lifecycle_segments(frames[0], features.engagement_features(frames[1], NOW))
    targets = features.propensity_targets(segments, NOW)
    rows = targets.orderBy("client_id").collect()
    assert len(rows) == 400
    assert all(0.05 <= r.conversion_probability <= 0.95 and 0.05 <= r.churn_probability <= 0.8 for r in rows)
    assert {r.conversion_target for r in rows} == {0, 1} and {r.churn_target for r in rows} == {0, 1}
    shuffled = features.propensity_targets(segments.repartition(7), NOW).orderBy("client_id").collect()
    assert rows == shuffled


def test_store_forms_agree_and_cover_event_clients(spark):
    people = clients_frame(spark, [client(f"c{n}", tenure=n) for n in range(20)])
    acts = events_frame(spark, [event(n, client=f"c{n % 8}", back=days(n)) for n in range(60)]
                        + [event(900, client="stranger"), event(901, client=None)])
    engagement = features.engagement_features(acts, NOW)
    three = features.unify_features(
        engagement, features.financial_behavioral_features(people, acts, NOW),
        features.propensity_targets(features.lifecycle_segments(people, engagement), NOW))
    one = features.feature_store(acts, people, NOW)
    assert one.schema == three.schema and len(one.columns) == 57
    assert one.exceptAll(three).isEmpty() and three.exceptAll(one).isEmpty()
    got = {r.client_id: r for r in one.collect()}
    assert set(got) == {f"c{n}" for n in range(8)} | {"stranger"}
    # An event client without a client row has engagement only.
    assert got["stranger"].total_events_30d == 1
    assert got["stranger"].lifecycle_stage is None and got["stranger"].service_tier_numeric is None
    assert got["stranger"].total_lifetime_events is None and got["stranger"].conversion_target is None
    everyone = features.feature_store(acts, people, NOW, include_inactive=True)
    quiet = everyone.filter("client_id = 'c15'").first()
    assert everyone.count() == 20 and quiet.lifecycle_stage == "Dormant" and quiet.total_events_30d is None


def test_one_scan_and_one_exchange_of_the_events(spark, tmp_path):
    events_frame(spark, [event(1)]).write.parquet(str(tmp_path / "events"))
    stored = spark.read.parquet(str(tmp_path / "events"))
    plan = features.engagement_features(stored, NOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "PushedFilters: [Or(IsNull(event_timestamp),LessThanOrEqual(event_timestamp" in plan
    assert "device_type" not in plan.split("ReadSchema")[1]
