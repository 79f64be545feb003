"""The registered queries against their SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from checks.compare import connect, difference
from checks.domain import Domain
from tidemark.plans import monitoring, segments

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "q01_engagement_features", "q04_financial_behavioral", "q07_feature_store", "q18_rule_scores", "q26_churn_segments",
    "q33_performance_by_hour", "q42_business_impact", "q49_latency_by_day", "q50_client_360", "x03_points_scores",
    "j03_latest_per_key", "j12_as_of_join", "s16_retention_delete", "t08_daily_rollup_counters",
)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_invariants(spark):
    d = Domain(spark, FOLDER).settled()
    ratios = [c for c in d.store.columns if c.endswith("_ratio") and c not in ("income_to_age_ratio", "assets_to_income_ratio")]
    ratios += ["mobile_adoption_score", "engagement_score_30d", "retirement_readiness_score"]
    outside = [~F.coalesce(F.col(c).between(0, 1), F.lit(True)) for c in ratios]
    assert d.store.filter(F.greatest(*outside)).isEmpty()
    assert d.store.count() == d.events.select("client_id").distinct().count()
    total = d.segments.count()
    assert segments.segment_summary(d.segments).agg(F.sum("client_count")).first()[0] == total
    assert segments.retention_summary(d.churn).agg(F.sum("client_count")).first()[0] == total
    assert d.churn.filter(~F.col("churn_risk_score").between(0, 1)).isEmpty()
    assert monitoring.sampled_drift(d.store).filter("drift_score < 0").isEmpty()


def test_plans_hold_no_cross_join(spark):
    for name in ("q26_churn_segments", "q43_observability_dashboard", "q50_client_360", "q52_score_unscored", "j08_not_in", "j12_as_of_join"):
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
