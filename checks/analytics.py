"""Named analytics: each Spark query beside the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from checks.domain import Domain
from checks.sqltext import AS_OF, CTES, NOW, back, big, msum, rnd, sql, uniform, xavg
from tidemark.operators import hash_split, metric_rows
from tidemark.plans import (
    catalog, dashboards, features, impact, monitoring, reports, scoring, segments, sql_functions,
)
from tidemark.session import scratch_path
from tidemark.sources import as_view, write_bucketed

QUERIES: dict[str, Callable[[Domain], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CTES["snapshots"] = f"""
SELECT date_trunc('day', prediction_timestamp) AS prediction_timestamp, count(*) AS total_predictions,
 {xavg('probability')} AS avg_prediction_value FROM pred_log GROUP BY 1"""
CTES["requests"] = "SELECT client_id FROM clients WHERE assigned_advisor_id < 'ADV_010'"


def query(name: str, check: str | None = None):
    def add(build: Callable[[Domain], DataFrame]):
        QUERIES[name] = build
        if check is not None:
            ORACLE[name] = sql(check)
        return build
    return add


def settled_query(name: str, check: str):
    """A query that uses the store more than once: it is written first."""
    return lambda build: query(name, check)(lambda d: build(d.settled()))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Deviations and logarithms differ in the last bits between engines."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --------------------------------------------------------------------------
# Feature tables
# --------------------------------------------------------------------------

query("q01_engagement_features", "SELECT * FROM engagement")(lambda d: d.engagement)
query("q01_engaged_sample", """
SELECT client_id, total_events_30d, web_visits_30d, email_opens_30d, engagement_frequency_30d, engagement_score_30d, days_since_last_activity
FROM engagement WHERE total_events_30d > 0 ORDER BY engagement_score_30d DESC, client_id LIMIT 10"""
      )(lambda d: reports.engaged_sample(d.engagement))
query("q02_client_behaviors", "SELECT * FROM behaviors")(lambda d: features.client_behaviors(d.events, d.now))
query("q03_financial_profile", f"""
SELECT * REPLACE ({rnd('wealth_growth_potential', 6)} AS wealth_growth_potential) FROM profile"""
      )(lambda d: rounded(features.financial_profile(d.clients), 6, "wealth_growth_potential"))
query("q04_financial_behavioral", "SELECT * FROM financial")(lambda d: d.financial)
query("q05_lifecycle_segments", "SELECT * FROM lifecycle"
      )(lambda d: features.lifecycle_segments(d.clients, d.engagement))
query("q06_propensity_targets", "SELECT * FROM targets")(lambda d: d.targets)
query("q07_feature_store", "SELECT * FROM store")(lambda d: d.store)
query("q07_store_from_buckets", "SELECT * FROM store")(lambda d: _store_from_buckets(d))
query("q07_feature_store_three_tables", "SELECT * FROM store"
      )(lambda d: features.unify_features(d.engagement, d.financial, d.targets))
query("q07_feature_store_with_inactive", """
SELECT f.client_id, f.feature_timestamp, e.* EXCLUDE (client_id, feature_timestamp, max_session_duration_30d, last_activity_timestamp),
 f.* EXCLUDE (client_id, feature_timestamp), t.* EXCLUDE (client_id, feature_timestamp, days_since_last_activity)
FROM financial f LEFT JOIN engagement e ON e.client_id = f.client_id JOIN targets t ON t.client_id = f.client_id"""
      )(lambda d: features.feature_store(d.events, d.clients, d.now, include_inactive=True))


def _store_from_buckets(d: Domain) -> DataFrame:
    """The three feature tables bucketed by client, then joined where they lie."""
    tables = []
    for label, frame in {"engagement": d.engagement, "financial": d.financial, "targets": d.targets}.items():
        name = f"{label}_{uuid.uuid4().hex}"
        tables.append(write_bucketed(frame, name, "client_id", 8, scratch_path(d.spark, name)))
    return features.unify_features(*tables)


query("q08_feature_completeness", f"""
SELECT count(*) AS total_records, count(engagement_score_30d) AS with_engagement_score,
 count(retirement_readiness_score) AS with_retirement_score, count(conversion_target) AS with_conversion_target,
 count(churn_target) AS with_churn_target, {rnd('count(engagement_score_30d) * 100e0 / count(*)', 2)} AS completeness_percentage
FROM store""")(lambda d: reports.feature_completeness(d.store))


def _avg4(column: str) -> str:
    return rnd(xavg(column), 4)


query("q09_key_feature_stats", f"""
SELECT {_avg4('engagement_score_30d')} AS avg_engagement_score, {_avg4('retirement_readiness_score')} AS avg_retirement_readiness,
 {_avg4('conversion_probability')} AS avg_conversion_prob, {_avg4('churn_probability')} AS avg_churn_prob,
 {big('sum(conversion_target)')} AS total_conversion_targets, {big('sum(churn_target)')} AS total_churn_targets FROM store"""
      )(lambda d: reports.key_feature_stats(d.store))
query("q09_financial_distributions", f"""
SELECT {_avg4('retirement_readiness_score')} AS avg_retirement_readiness, {_avg4('wealth_growth_potential')} AS avg_wealth_potential,
 {_avg4('mobile_adoption_score')} AS avg_mobile_adoption, count(*) FILTER (WHERE premium_client_indicator = 1) AS premium_clients,
 {_avg4('lifetime_engagement_frequency')} AS avg_engagement_freq FROM financial"""
      )(lambda d: reports.financial_distributions(d.financial))
query("q10_lifecycle_distribution", f"""
SELECT lifecycle_stage, count(*) AS client_count, {_avg4('conversion_probability')} AS avg_conversion_prob,
 {_avg4('churn_probability')} AS avg_churn_prob, {big('sum(conversion_target)')} AS conversion_targets,
 {big('sum(churn_target)')} AS churn_targets FROM targets GROUP BY 1 ORDER BY client_count DESC"""
      )(lambda d: reports.lifecycle_distribution(d.targets))
query("q10_next_action_distribution", f"""
SELECT next_best_action, count(*) AS client_count, {_avg4('business_priority_score')} AS avg_priority_score
FROM targets GROUP BY 1 ORDER BY client_count DESC""")(lambda d: reports.next_action_distribution(d.targets))
query("q10_high_growth_sample", """
SELECT client_id, engagement_score_30d, retirement_readiness_score, annual_income, lifecycle_stage
FROM store WHERE wealth_growth_potential > 0.7e0 ORDER BY client_id LIMIT 5""")(lambda d: reports.high_growth_sample(d.store))

query("q11_feature_view", """
SELECT client_id, feature_timestamp, total_events_7d, web_visits_7d, email_opens_7d, email_clicks_7d, total_events_30d,
 web_visits_30d, email_opens_30d, email_clicks_30d, personal_interactions_30d, total_events_90d, web_visits_90d,
 avg_session_duration_30d, active_days_30d, total_touchpoint_value_30d, avg_touchpoint_value_30d,
 days_since_last_activity, engagement_frequency_30d, email_click_rate_30d, engagement_trend_30d, engagement_score_30d,
 age, annual_income, current_401k_balance, years_to_retirement, total_assets_under_management, client_tenure_months,
 income_to_age_ratio, assets_to_income_ratio, retirement_readiness_score, wealth_growth_potential,
 service_tier_numeric, risk_tolerance_numeric, total_lifetime_events, engagement_span_days, advisor_meetings_total,
 web_preference_ratio, email_preference_ratio, mobile_adoption_score, lifetime_engagement_frequency,
 avg_touchpoint_value, lifecycle_stage, age_segment, tenure_segment FROM store"""
      )(lambda d: catalog.feature_view(d.store))

# Columns hidden from the definitions are the key, the clock and the targets.
_DEFINED = [c for c in features.STORE_COLUMNS if c not in ("client_id", "feature_timestamp", *catalog.TARGETS)]
CTES["filled"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature_name, count({c}) AS filled_rows,
 CASE any_value(typeof({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(any_value(typeof({c}))) END AS feature_type FROM store"""
    for c in _DEFINED)
CTES["defined"] = """
SELECT feature_name, feature_type, filled_rows, CASE WHEN feature_name LIKE '%_7d' THEN 'Engagement metrics over 7 days'
 WHEN feature_name LIKE '%_30d' THEN 'Engagement metrics over 30 days' WHEN feature_name LIKE '%_90d' THEN 'Engagement metrics over 90 days'
 WHEN feature_name IN ('age', 'annual_income', 'current_401k_balance') THEN 'Client demographic features'
 WHEN feature_name LIKE '%ratio%' THEN 'Behavioral ratio metrics' ELSE 'Client feature' END AS feature_description FROM filled"""


def _filled(d: Domain) -> DataFrame:
    """The number of store rows that fill each feature."""
    return metric_rows(d.store, {c: F.count(c) for c in _DEFINED}, "feature_name", "filled_rows")


query("q12_definition_listing", """
SELECT feature_name, feature_type, feature_description, filled_rows FROM defined ORDER BY feature_name LIMIT 20"""
      )(lambda d: catalog.definition_listing(catalog.feature_definitions(d.store)).join(_filled(d), "feature_name"))
query("q12_definitions_by_description", f"""
SELECT feature_description, count(*) AS num_features, {big('sum(filled_rows)')} AS filled_values FROM defined GROUP BY 1"""
      )(lambda d: _by_description(d))


def _by_description(d: Domain) -> DataFrame:
    definitions = catalog.feature_definitions(d.store)
    filled = definitions.join(_filled(d), "feature_name").groupBy("feature_description").agg(F.sum("filled_rows").alias("filled_values"))
    return catalog.definitions_by_description(definitions).join(filled, "feature_description")


query("q13_engaged_clients_default", """
SELECT client_id, engagement_score_30d, retirement_readiness_score, lifecycle_stage, total_assets_under_management, annual_income
FROM store WHERE engagement_score_30d > 0.8e0 ORDER BY total_assets_under_management DESC, client_id LIMIT 10"""
      )(lambda d: reports.engaged_clients(catalog.feature_view(d.store)))
query("q13_engaged_clients", """
SELECT client_id, engagement_score_30d, retirement_readiness_score, lifecycle_stage, total_assets_under_management, annual_income
FROM store WHERE engagement_score_30d > 0.1e0 ORDER BY total_assets_under_management DESC, client_id LIMIT 10"""
      )(lambda d: reports.engaged_clients(catalog.feature_view(d.store), score=0.1))
query("q13_high_value_clients", """
SELECT client_id, age, annual_income, current_401k_balance, total_assets_under_management, wealth_growth_potential, service_tier_numeric
FROM store WHERE wealth_growth_potential > 0.7e0 AND service_tier_numeric >= 3 ORDER BY total_assets_under_management DESC, client_id LIMIT 20"""
      )(lambda d: reports.high_value_clients(catalog.feature_view(d.store)))
query("q14_age_segment_distribution", f"""
SELECT age_segment, count(*) AS client_count, {xavg('engagement_score_30d')} AS avg_engagement,
 {xavg('retirement_readiness_score')} AS avg_readiness FROM store GROUP BY 1"""
      )(lambda d: reports.age_segment_distribution(catalog.feature_view(d.store)))
query("q14_engagement_patterns", f"""
SELECT lifecycle_stage, avg(total_events_30d) AS avg_monthly_events, {xavg('email_click_rate_30d')} AS avg_email_engagement,
 {xavg('web_preference_ratio')} AS avg_web_preference, count(*) AS client_count FROM store GROUP BY 1"""
      )(lambda d: reports.engagement_patterns(catalog.feature_view(d.store)))
query("q15_store_summary", """
SELECT 'Total Clients' AS metric, count(DISTINCT client_id) AS value FROM store
UNION ALL SELECT 'Total Features', count(*) FROM defined UNION ALL SELECT 'Feature Categories', count(DISTINCT feature_description) FROM defined"""
      )(lambda d: reports.store_summary(catalog.feature_view(d.store), catalog.feature_definitions(d.store)))
query("q16_time_on_page_stats", f"""
SELECT event_type, count(*) AS events_with_time, {rnd('avg(time_on_page)', 1)} AS avg_time_seconds,
 min(time_on_page) AS min_time_seconds, max(time_on_page) AS max_time_seconds
FROM marketing_events WHERE time_on_page IS NOT NULL GROUP BY 1""")(lambda d: reports.time_on_page_stats(d.events))
query("q16_recent_timed_events", """
SELECT event_type, channel, time_on_page, touchpoint_value, conversion_flag
FROM marketing_events WHERE time_on_page IS NOT NULL ORDER BY event_timestamp DESC, event_id LIMIT 10"""
      )(lambda d: reports.recent_timed_events(d.events))

# --------------------------------------------------------------------------
# Scores
# --------------------------------------------------------------------------

_INPUTS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in scoring.NUMERIC_FEATURES if c != "business_priority_score")
_CODES = """
 CASE lifecycle_stage WHEN 'New' THEN 1 WHEN 'Growing' THEN 2 WHEN 'Active' THEN 3 WHEN 'At_Risk' THEN 4 WHEN 'Dormant' THEN 5 ELSE 0 END AS lifecycle_stage_encoded,
 CASE age_segment WHEN 'Young' THEN 1 WHEN 'Mid-Career' THEN 2 WHEN 'Pre-Retirement' THEN 3 WHEN 'Near-Retirement' THEN 4 ELSE 0 END AS age_segment_encoded,
 CASE tenure_segment WHEN 'New' THEN 1 WHEN 'Growing' THEN 2 WHEN 'Established' THEN 3 WHEN 'Mature' THEN 4 ELSE 0 END AS tenure_segment_encoded"""
query("q17_model_input", f"""
SELECT client_id, lifecycle_stage, age_segment, conversion_target, {_INPUTS}, business_priority_score, {_CODES} FROM store"""
      )(lambda d: scoring.model_input(d.store).drop("business_priority_score").select(
          "client_id", "lifecycle_stage", "age_segment", "conversion_target", "features.*"))
query("q18_rule_scores", "SELECT * FROM scores")(lambda d: d.scores)
query("q19_score_summary", f"""
SELECT count(*) AS total_clients, {xavg('conversion_probability')} AS avg_probability, min(conversion_probability) AS min_probability,
 max(conversion_probability) AS max_probability, count(*) FILTER (WHERE conversion_probability > 0.7e0) AS high_probability_count,
 count(*) FILTER (WHERE actual_conversion = 1) AS actual_conversions FROM scores""")(lambda d: reports.score_summary(d.scores))
query("q19_likelihood_summary", f"""
SELECT count(*) AS total_clients, {xavg('conversion_probability')} AS avg_probability,
 count(*) FILTER (WHERE conversion_likelihood = 'High') AS high_count, count(*) FILTER (WHERE conversion_likelihood = 'Medium') AS medium_count,
 count(*) FILTER (WHERE conversion_likelihood = 'Low') AS low_count,
 avg(CASE WHEN actual_conversion = 1 THEN 1e0 ELSE 0e0 END) AS actual_conversion_rate FROM scores"""
      )(lambda d: reports.likelihood_summary(d.scores))
settled_query("q19_score_spread", f"""
SELECT count(*) AS total_clients, {xavg('conversion_probability')} AS avg_probability, min(conversion_probability) AS min_probability,
 max(conversion_probability) AS max_probability, {rnd('stddev_samp(conversion_probability)', 8)} AS stddev_probability,
 {rnd('median(conversion_probability)', 8)} AS median_probability FROM scores"""
      )(lambda d: rounded(reports.score_spread(d.scores), 8, "stddev_probability", "median_probability"))
query("q20_scores_by_age_segment", f"""
SELECT age_segment, count(*) AS client_count, {xavg('conversion_probability')} AS avg_probability,
 count(*) FILTER (WHERE actual_conversion = 1) AS actual_conversions,
 avg(CASE WHEN actual_conversion = 1 THEN 1e0 ELSE 0e0 END) AS actual_rate FROM scores GROUP BY 1"""
      )(lambda d: reports.scores_by_age_segment(d.scores))
query("q20_scores_by_stage", f"""
SELECT lifecycle_stage, count(*) AS client_count, {xavg('conversion_probability')} AS avg_probability,
 {xavg('business_priority_score')} AS avg_priority FROM scores GROUP BY 1""")(lambda d: reports.scores_by_stage(d.scores))
query("q21_calibration_three_bands", f"""
SELECT CASE WHEN conversion_probability > 0.7e0 THEN 'High (>0.7)' WHEN conversion_probability > 0.4e0 THEN 'Medium (0.4-0.7)'
 ELSE 'Low (<0.4)' END AS probability_band, count(*) AS client_count, {big('sum(actual_conversion)')} AS actual_conversions,
 avg(actual_conversion) AS conversion_rate FROM scores GROUP BY 1""")(lambda d: reports.calibration_three_bands(d.scores))
query("q21_calibration_five_bands", f"""
SELECT CASE WHEN conversion_probability < 0.2e0 THEN '0.0-0.2' WHEN conversion_probability < 0.4e0 THEN '0.2-0.4'
 WHEN conversion_probability < 0.6e0 THEN '0.4-0.6' WHEN conversion_probability < 0.8e0 THEN '0.6-0.8' ELSE '0.8-1.0' END AS prob_band,
 count(*) AS client_count, {big('sum(actual_conversion)')} AS conversions, avg(actual_conversion) AS conversion_rate
FROM scores GROUP BY 1""")(lambda d: reports.calibration_five_bands(d.scores))
query("q22_top_candidates", """
SELECT client_id, lifecycle_stage, age_segment, conversion_probability, business_priority_score
FROM scores ORDER BY conversion_probability DESC, client_id LIMIT 10""")(lambda d: reports.top_candidates(d.scores))
query("q22_top_banded_candidates", """
SELECT client_id, lifecycle_stage, age_segment, business_priority_score, conversion_probability, actual_conversion, conversion_likelihood
FROM scores WHERE conversion_probability > 0.5e0 ORDER BY conversion_probability DESC, client_id LIMIT 20"""
      )(lambda d: reports.top_banded_candidates(d.scores, floor=0.5))

# --------------------------------------------------------------------------
# Segments, churn
# --------------------------------------------------------------------------

query("q23_client_segments", "SELECT * FROM segments")(lambda d: d.segments)
query("q24_segment_summary", """
SELECT action_segment, count(*) AS client_count, avg(conversion_probability) AS avg_probability,
 count(*) FILTER (WHERE actual_conversion = 1) AS actual_conversions FROM segments GROUP BY 1"""
      )(lambda d: segments.segment_summary(d.segments))
query("q24_batch_summary", """
SELECT batch_timestamp, count(DISTINCT client_id) AS total_clients_scored,
 count(*) FILTER (WHERE action_segment LIKE 'High%') AS high_priority_clients,
 avg(conversion_probability) AS average_conversion_prediction,
 count(*) FILTER (WHERE conversion_probability = 1) AS predicted_conversions,
 count(*) FILTER (WHERE actual_conversion = 1) AS actual_conversions FROM segments GROUP BY 1"""
      )(lambda d: segments.batch_summary(d.segments))
query("q24_prediction_outcomes", """
SELECT count(*) FILTER (WHERE conversion_probability = 1) AS predicted_to_convert,
 count(*) FILTER (WHERE conversion_probability = 0) AS predicted_not_convert,
 count(*) FILTER (WHERE conversion_probability = 1 AND actual_conversion = 1) AS true_positives,
 count(*) AS total_clients FROM segments""")(lambda d: segments.prediction_outcomes(d.segments))
query("q24_top_priority_clients", """
SELECT client_id, action_segment, conversion_probability, business_priority_score, recommended_action
FROM segments WHERE action_segment LIKE 'High%' ORDER BY business_priority_score DESC, client_id LIMIT 10"""
      )(lambda d: segments.top_priority_clients(d.segments))
query("q25_churn_indicators", """
SELECT count(*) AS total_clients, count(*) FILTER (WHERE churn_target = 1) AS churned_clients,
 count(*) FILTER (WHERE days_since_last_activity > 30) AS inactive_30d,
 count(*) FILTER (WHERE lifecycle_stage IN ('At_Risk', 'At Risk')) AS at_risk_clients FROM store"""
      )(lambda d: segments.churn_indicators(d.store))
settled_query("q26_churn_segments", "SELECT * FROM churn")(lambda d: d.churn)
settled_query("q27_retention_summary", f"""
SELECT retention_segment, value_tier, count(*) AS client_count, {xavg('churn_risk_score')} AS avg_risk_score,
 avg(days_since_last_activity) AS avg_days_inactive FROM churn GROUP BY 1, 2""")(lambda d: segments.retention_summary(d.churn))
settled_query("q27_churn_prevention_summary", f"""
SELECT analysis_timestamp, count(*) AS total_clients, count(*) FILTER (WHERE retention_segment LIKE 'Critical%') AS critical_risk_clients,
 count(*) FILTER (WHERE retention_segment LIKE 'High Risk%') AS high_risk_clients,
 count(*) FILTER (WHERE value_tier = 'High Value' AND churn_risk_score >= 0.7e0) AS high_value_at_risk,
 count(*) FILTER (WHERE churn_risk_score >= 0.7e0) AS total_high_risk, {xavg('churn_risk_score')} AS avg_churn_risk,
 avg(days_since_last_activity) AS avg_days_inactive FROM churn GROUP BY 1""")(lambda d: segments.churn_prevention_summary(d.churn))
settled_query("q27_critical_clients", f"""
SELECT c.client_id, c.value_tier, {rnd('s.total_assets_under_management', 0)} AS assets, c.days_since_last_activity,
 c.churn_risk_score, c.retention_action FROM churn c JOIN store s ON s.client_id = c.client_id
WHERE c.retention_segment LIKE 'Critical%' AND c.value_tier IN ('High Value', 'Medium Value')
ORDER BY s.total_assets_under_management DESC, c.churn_risk_score DESC, c.client_id LIMIT 15"""
      )(lambda d: segments.critical_clients(d.churn, d.store))
settled_query("q27_retention_opportunities", """
SELECT client_id, lifecycle_stage, churn_risk_score, conversion_probability, retention_action FROM churn
WHERE churn_risk_score >= 0.5e0 AND conversion_probability = 1 ORDER BY churn_risk_score DESC, client_id LIMIT 10"""
      )(lambda d: segments.retention_opportunities(d.churn))
settled_query("q27_churn_executive_summary", f"""
SELECT count(*) FILTER (WHERE c.retention_segment LIKE 'Critical%') AS critical_count,
 count(*) FILTER (WHERE c.retention_segment LIKE '%Risk%') AS total_at_risk,
 {msum("CASE WHEN c.retention_segment LIKE 'Critical%' AND c.value_tier = 'High Value' THEN s.total_assets_under_management ELSE 0e0 END")} AS assets_at_risk
FROM churn c JOIN store s ON s.client_id = c.client_id""")(lambda d: segments.churn_executive_summary(d.churn, d.store))

# --------------------------------------------------------------------------
# Monitoring
# --------------------------------------------------------------------------

query("q28_prediction_snapshot", f"""
SELECT {NOW} AS prediction_timestamp, 'CONVERSION_PREDICTOR' AS model_name, 'V1' AS model_version, count(*) AS total_predictions,
 {xavg('probability')} AS avg_prediction_value, min(probability) AS min_prediction_value, max(probability) AS max_prediction_value,
 count(*) FILTER (WHERE probability > 0.7e0) AS high_prob, count(*) FILTER (WHERE probability BETWEEN 0.4e0 AND 0.7e0) AS medium_prob,
 count(*) FILTER (WHERE probability < 0.4e0) AS low_prob, {big('sum(actual_conversion)')} AS actual_conversions,
 avg(actual_conversion) AS conversion_rate FROM preds"""
      )(lambda d: monitoring.prediction_snapshot(d.preds, d.now).select(
          "prediction_timestamp", "model_name", "model_version", "total_predictions", "avg_prediction_value",
          "min_prediction_value", "max_prediction_value", "prediction_distribution.*", "performance_metrics.*"))
query("q29_baseline_drift_check", f"""
SELECT {NOW} AS check_timestamp, 'total_events_30d' AS feature_name, 50e0 AS baseline_mean, m AS current_mean,
 abs(m - 50e0) / 50e0 AS drift_score, abs(m - 50e0) / 50e0 > 0.3e0 AS alert_triggered
FROM (SELECT avg(total_events_30d) AS m FROM store)"""
      )(lambda d: monitoring.baseline_drift_check(d.store, d.now).drop("drift_id"))
settled_query("q30_deployment_dashboard", f"""
SELECT dep.model_name, dep.model_version, dep.deployment_timestamp, lp.total_predictions AS predictions_last_batch,
 lp.avg_prediction_value AS avg_prediction_score, count(CASE WHEN ld.alert_triggered THEN 1 END) AS drift_alerts, {NOW} AS dashboard_updated
FROM deployments dep CROSS JOIN (SELECT * FROM snapshots ORDER BY prediction_timestamp DESC LIMIT 1) lp
LEFT JOIN (SELECT * FROM drift_history WHERE check_timestamp > {back(8)}) ld ON 1 = 1
WHERE dep.status = 'ACTIVE' GROUP BY ALL"""
      )(lambda d: monitoring.deployment_dashboard(
          d.deployments, d.snapshots,
          d.drift_history.withColumn("check_timestamp", F.expr("check_timestamp + INTERVAL '7' DAY")), d.now))
settled_query("q30_deployment_summary", f"""
SELECT dep.model_name, dep.model_version, dep.status, dep.deployment_timestamp, p.clients_scored, p.avg_score
FROM deployments dep, (SELECT count(DISTINCT client_id) AS clients_scored, {xavg('probability')} AS avg_score FROM preds) p
WHERE dep.status = 'ACTIVE'""")(lambda d: monitoring.deployment_summary(d.deployments, d.preds))
query("q31_model_performance_check", f"""
SELECT a AS current_accuracy, (0.5e0 - a) / 0.5e0 AS performance_drop,
 CASE WHEN (0.5e0 - a) / 0.5e0 > 0.1e0 THEN 'RETRAINING RECOMMENDED: Performance dropped by ' || CAST({rnd('(0.5e0 - a) / 0.5e0 * 100', 1)} AS VARCHAR) || '%'
  ELSE 'Model performing well. Current accuracy: ' || CAST({rnd('a * 100', 1)} AS VARCHAR) || '%' END AS result
FROM (SELECT count(*) FILTER (WHERE prediction = actual_conversion) / nullif(count(*), 0) AS a FROM preds)"""
      )(lambda d: monitoring.check_model_performance(d.preds))
settled_query("q31_system_validation", """
SELECT (SELECT count(*) FROM preds) AS total_predictions, (SELECT count(*) FROM segments) AS segmented_clients,
 (SELECT count(*) FROM deployments WHERE status = 'ACTIVE') AS active_models, (SELECT count(*) FROM perf_history) AS performance_records"""
      )(lambda d: monitoring.system_validation(d.preds, d.segments, d.deployments, d.perf_history))
settled_query("q32_monitored_predictions", "SELECT * FROM monitored")(lambda d: d.monitored)

_RATES = """avg(CASE WHEN prediction = actual_conversion THEN 1 ELSE 0 END) AS accuracy,
 avg(CASE WHEN prediction = 1 THEN CASE WHEN actual_conversion = 1 THEN 1 ELSE 0 END END) AS precision,
 avg(CASE WHEN actual_conversion = 1 THEN CASE WHEN prediction = 1 THEN 1 ELSE 0 END END) AS recall"""
CTES["hourly"] = f"SELECT monitor_hour, count(*) AS predictions_count, {_RATES} FROM monitored GROUP BY 1"
settled_query("q33_performance_by_hour", """
SELECT *, 2 * (precision * recall) / nullif(precision + recall, 0e0) AS f1_score FROM hourly"""
      )(lambda d: monitoring.performance_by_hour(d.monitored))


def _ends(n: int) -> str:
    parts = []
    for c in ("total_events_30d", "engagement_score_30d", "annual_income"):
        parts.append(f"""SELECT '{c}' AS feature_name, {rnd('b.m', 6)} AS baseline_mean, {rnd('c.m', 6)} AS current_mean,
 {rnd('abs(c.m - b.m) / nullif(b.s, 0e0)', 6)} AS drift_score
FROM (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM (SELECT * FROM monitored ORDER BY monitor_timestamp, client_id LIMIT {n})) b,
 (SELECT avg({c}) AS m FROM (SELECT * FROM monitored ORDER BY monitor_timestamp DESC, client_id LIMIT {n})) c""")
    return " UNION ALL ".join(parts)


settled_query("q34_window_drift", _ends(1000)
      )(lambda d: rounded(monitoring.log_window_drift(d.pred_log, d.store, d.now), 6, "baseline_mean", "current_mean", "drift_score"))
query("q35_labelled_metrics", """
SELECT count(*) AS total_predictions, avg(CASE WHEN prediction = actual_conversion THEN 1 ELSE 0 END) AS accuracy,
 count(*) FILTER (WHERE prediction = 1) AS positive_predictions, count(*) FILTER (WHERE actual_conversion = 1) AS actual_positives
FROM preds WHERE actual_conversion IS NOT NULL""")(lambda d: monitoring.labelled_metrics(d.preds))
query("q35_confusion_matrix", """
SELECT count(*) FILTER (WHERE prediction = 1 AND actual_conversion = 1) AS tp, count(*) FILTER (WHERE prediction = 1 AND actual_conversion = 0) AS fp,
 count(*) FILTER (WHERE prediction = 0 AND actual_conversion = 0) AS tn, count(*) FILTER (WHERE prediction = 0 AND actual_conversion = 1) AS fn
FROM preds WHERE actual_conversion IS NOT NULL""")(lambda d: monitoring.confusion_matrix(d.preds))
CTES["cells"] = """
SELECT count(*) AS total_predictions, count(*) FILTER (WHERE prediction = 1) AS predicted_conversions,
 count(*) FILTER (WHERE actual_conversion = 1) AS actual_conversions,
 count(*) FILTER (WHERE prediction = actual_conversion) / nullif(count(*), 0) AS accuracy,
 count(*) FILTER (WHERE prediction = 1 AND actual_conversion = 1) AS true_positives,
 count(*) FILTER (WHERE prediction = 1 AND actual_conversion = 0) AS false_positives,
 count(*) FILTER (WHERE prediction = 0 AND actual_conversion = 0) AS true_negatives,
 count(*) FILTER (WHERE prediction = 0 AND actual_conversion = 1) AS false_negatives FROM preds"""
query("q36_model_performance", """
SELECT *, 2 * (precision * recall) / nullif(precision + recall, 0e0) AS f1_score FROM (
 SELECT 'CONVERSION_PREDICTOR' AS model_name, 'V1' AS model_version, *, true_positives / nullif(true_positives + false_positives, 0) AS precision,
  true_positives / nullif(true_positives + false_negatives, 0) AS recall FROM cells)"""
      )(lambda d: monitoring.model_performance(d.preds))
query("q36_accuracy_log_row", f"""
SELECT {NOW} AS evaluation_timestamp, 'CONVERSION_PREDICTOR' AS model_name, 'V1' AS model_version, 'ACCURACY' AS metric_name,
 count(*) FILTER (WHERE prediction = actual_conversion) / nullif(count(*), 0) AS metric_value, 'PRODUCTION' AS evaluation_set FROM preds"""
      )(lambda d: monitoring.accuracy_row(d.preds, d.now).drop("tracking_id"))
query("q37_data_quality_profile", """
SELECT count(*) AS total_clients, count(DISTINCT client_id) AS unique_clients, avg(days_since_last_activity) AS avg_days_inactive,
 count(*) FILTER (WHERE total_events_30d IS NULL) AS null_events, count(*) FILTER (WHERE annual_income IS NULL) AS null_income,
 min(days_since_last_activity) AS most_active_days_ago, max(days_since_last_activity) AS least_active_days_ago FROM store"""
      )(lambda d: monitoring.data_quality_profile(d.store))


def _sampled() -> str:
    parts = []
    for c in monitoring.SAMPLE_DRIFT_FEATURES:
        parts.append(f"""SELECT '{c}' AS feature_name, b.m AS bm, c.m AS cm, abs(c.m - b.m) / nullif(b.s, 0e0) AS score
FROM (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM store WHERE {uniform('client_id', 'baseline_sample')} < 0.25e0) b,
 (SELECT avg({c}) AS m FROM store WHERE days_since_last_activity <= 30) c""")
    return f"""
SELECT feature_name, {rnd('bm', 6)} AS baseline_mean, {rnd('cm', 6)} AS current_mean, {rnd('score', 6)} AS drift_score,
 CASE WHEN score > 2 THEN 'High' WHEN score > 1 THEN 'Medium' ELSE 'Low' END AS drift_severity, coalesce(score > 2, false) AS alert_triggered
FROM ({' UNION ALL '.join(parts)})"""


settled_query("q38_sampled_drift", _sampled()
      )(lambda d: rounded(monitoring.sampled_drift(d.store), 6, "baseline_mean", "current_mean", "drift_score"))
CTES["daily_rates"] = """
SELECT date_trunc('day', batch_timestamp) AS prediction_date, avg(conversion_probability) AS avg_prediction,
 count(*) FILTER (WHERE conversion_probability = 1) / count(*) AS positive_rate, count(*) AS daily_volume
FROM segment_log GROUP BY 1 ORDER BY prediction_date DESC LIMIT 7"""
query("q39_prediction_drift", """
SELECT *, lag(positive_rate) OVER (ORDER BY prediction_date) AS prev_positive_rate,
 abs(positive_rate - lag(positive_rate) OVER (ORDER BY prediction_date)) AS daily_change FROM daily_rates"""
      )(lambda d: monitoring.prediction_drift(d.segment_log))

# --------------------------------------------------------------------------
# Impact, dashboards, alerts
# --------------------------------------------------------------------------

settled_query("q40_conversion_impact", "SELECT * FROM impact_conversion"
      )(lambda d: impact.conversion_impact(d.segments, d.store, d.now))
settled_query("q41_churn_impact", "SELECT * FROM impact_churn")(lambda d: impact.churn_impact(d.churn, d.store))
settled_query("q42_business_impact", "SELECT * FROM impact")(lambda d: d.impact.drop("impact_id"))
settled_query("q43_observability_dashboard", f"""
SELECT m.model_name, m.model_version, m.avg_accuracy, m.last_evaluated, dr.drifted_features, dr.max_drift_score,
 v.daily_predictions, v.positive_predictions, v.unique_clients, b.total_value, b.avg_roi, b.total_conversions, b.total_churns_prevented,
 CASE WHEN m.avg_accuracy < 0.6e0 THEN 'Critical' WHEN dr.drifted_features > 3 OR dr.max_drift_score > 2 THEN 'Warning' ELSE 'Healthy' END AS model_health_status,
 {NOW} AS dashboard_updated
FROM (SELECT model_name, model_version, max(evaluation_timestamp) AS last_evaluated, {xavg('metric_value')} AS avg_accuracy
  FROM perf_history WHERE metric_name = 'ACCURACY' GROUP BY 1, 2) m,
 (SELECT count(DISTINCT feature_name) AS drifted_features, max(drift_score) AS max_drift_score FROM drift_history WHERE alert_triggered) dr,
 (SELECT count(*) AS daily_predictions, count(*) FILTER (WHERE conversion_probability = 1) AS positive_predictions,
   count(DISTINCT client_id) AS unique_clients FROM segments WHERE batch_timestamp >= {NOW}) v,
 (SELECT sum(total_business_value) AS total_value, avg(roi_percentage) AS avg_roi, {big('sum(total_conversions)')} AS total_conversions,
   {big('sum(churns_prevented)')} AS total_churns_prevented FROM impact WHERE evaluation_date >= CAST({back(30)} AS DATE)) b"""
      )(lambda d: monitoring.observability_dashboard(d.perf_history, d.drift_history, d.segments, d.impact, d.now))
settled_query("q44_alert_rows", f"""
SELECT 'Performance' AS type, 'High' AS severity, 'Model accuracy (' || CAST({rnd('a * 100', 2)} AS VARCHAR) || '%) below threshold (65%)' AS message,
 'Consider model retraining' AS action
FROM (SELECT avg(CASE WHEN prediction = actual_conversion THEN 1 ELSE 0 END) AS a FROM preds WHERE actual_conversion IS NOT NULL) WHERE a < 0.65e0
UNION ALL SELECT 'Drift', 'Medium', 'High drift detected in ' || feature_name || ' (score: ' || CAST({rnd('drift_score', 2)} AS VARCHAR) || ')',
 'Investigate feature distribution changes' FROM drift_history WHERE drift_score > 0.75e0"""
      )(lambda d: monitoring.alert_rows(monitoring.labelled_metrics(d.preds), d.drift_history, drift_ceiling=0.75))
settled_query("q44_check_alerts", f"""
SELECT CASE WHEN a < 0.65e0 THEN 'ALERT: Model accuracy below threshold - ' || CAST({rnd('a', 4)} AS VARCHAR)
 WHEN w > 2e0 THEN 'ALERT: High feature drift detected - ' || CAST({rnd('w', 4)} AS VARCHAR) ELSE 'All systems normal' END AS alert_status
FROM (SELECT (SELECT {xavg('metric_value')} FROM perf_history WHERE metric_name = 'ACCURACY' AND evaluation_timestamp >= TIMESTAMP '2024-01-29 00:00:00') AS a,
 (SELECT max(drift_score) FROM drift_history WHERE check_timestamp >= TIMESTAMP '2024-01-29 00:00:00') AS w)"""
      )(lambda d: monitoring.check_alerts(d.perf_history, d.drift_history, AS_OF.replace(month=1, day=30)))
settled_query("q45_alert_history", """
SELECT check_timestamp, feature_name, drift_score, alert_triggered FROM drift_history WHERE alert_triggered
ORDER BY check_timestamp DESC, feature_name LIMIT 10""")(lambda d: monitoring.alert_history(d.drift_history))

query("q46_conversion_kpis", """
SELECT count(DISTINCT client_id) AS total_clients, count(*) FILTER (WHERE conversion_probability = 1) AS predicted_conversions,
 count(*) FILTER (WHERE conversion_probability = 1) AS high_priority_clients,
 avg(CASE WHEN conversion_probability = 1 THEN 1 ELSE 0 END) AS conversion_rate FROM segments""")(lambda d: impact.conversion_kpis(d.segments))
query("q46_prediction_kpis", """
SELECT count(DISTINCT client_id) AS total_clients, count(*) FILTER (WHERE prediction = 1) AS predicted_conversions,
 count(*) FILTER (WHERE business_priority_score > 0.8e0) AS high_priority_clients,
 avg(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) AS conversion_rate FROM preds WHERE actual_conversion IS NOT NULL"""
      )(lambda d: impact.prediction_kpis(d.preds))
settled_query("q46_churn_kpis", f"""
SELECT count(*) AS at_risk_clients, count(*) FILTER (WHERE value_tier = 'High Value') AS high_value_at_risk,
 {xavg('churn_risk_score')} AS avg_churn_risk FROM churn WHERE churn_risk_score > 0.6e0""")(lambda d: impact.churn_kpis(d.churn))
query("q46_revenue_by_segment", """
SELECT action_segment, count(*) AS client_count, avg(CASE WHEN conversion_probability = 1 THEN 50000 ELSE 0 END) AS avg_revenue_per_group
FROM segments GROUP BY 1""")(lambda d: impact.revenue_by_segment(d.segments))
query("q46_conversion_groups", f"""
SELECT CASE WHEN prediction = 1 THEN 'High Conversion' ELSE 'Low Conversion' END AS conversion_group, count(*) AS client_count,
 {xavg('business_priority_score')} AS avg_priority_score FROM preds WHERE actual_conversion IS NOT NULL GROUP BY 1"""
      )(lambda d: impact.conversion_groups(d.preds))
query("q46_conversion_groups_by_rate", """
SELECT CASE WHEN conversion_probability = 1 THEN 'High Conversion' ELSE 'Low Conversion' END AS conversion_group, count(*) AS client_count,
 avg(conversion_probability) AS avg_conversion_rate FROM segments GROUP BY 1""")(lambda d: impact.conversion_groups_by_rate(d.segments))

query("q47_daily_scores", "SELECT * FROM daily")(lambda d: d.daily)
query("q48_deployment_status", """
SELECT 'Batch Inference' AS deployment_type, 'ACTIVE' AS status, (SELECT count(*) FROM daily) AS daily_predictions,
 'Daily at 6 AM' AS schedule, 'Low' AS cost, 'Primary approach for financial ML' AS description
UNION ALL SELECT 'Real-time Inference', 'INACTIVE', CAST(0 AS BIGINT), 'On-demand', 'High', 'Use only when millisecond response required'"""
      )(lambda d: dashboards.deployment_status(d.daily, d.now))
query("q48_recent_prediction_count", f"""
SELECT count(*) AS count FROM prediction_history WHERE prediction_timestamp >= TIMESTAMP '2024-01-29 00:00:00'"""
      )(lambda d: dashboards.recent_prediction_count(d.prediction_history, AS_OF.replace(month=1, day=30)))
CTES["request_log"] = """
SELECT 'client_' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS client_id, value AS response_time_ms,
 CASE WHEN event_type = 'error' THEN 'fallback' ELSE 'container_service' END AS source, ts FROM events"""
query("q49_latency_by_day", f"""
SELECT CAST(ts AS DATE) AS date, count(*) AS total_requests, {rnd(xavg('response_time_ms'), 2)} AS avg_response_time_ms,
 {rnd('quantile_cont(response_time_ms, 0.95)', 2)} AS p95_response_time_ms,
 count(*) FILTER (WHERE source = 'container_service') AS service_requests, count(*) FILTER (WHERE source = 'fallback') AS fallback_requests,
 {rnd("count(*) FILTER (WHERE source = 'container_service') * 100e0 / count(*)", 2)} AS service_success_rate_pct
FROM request_log WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1"""
      )(lambda d: dashboards.latency_by_day(d.inference_log, AS_OF.replace(month=1, day=31)))
query("q50_client_360", f"""
SELECT c.*, a.advisor_name, a.specialization AS advisor_specialization, s.engagement_score_30d AS engagement_score,
 s.churn_probability AS churn_risk_score, s.conversion_probability AS conversion_propensity_score,
 p.recommended_action, p.conversion_probability, count(e.event_id) AS total_events_30d
FROM clients c LEFT JOIN advisors a ON a.advisor_id = c.assigned_advisor_id
LEFT JOIN (SELECT * FROM store_history QUALIFY feature_timestamp = max(feature_timestamp) OVER (PARTITION BY client_id)) s ON s.client_id = c.client_id
LEFT JOIN (SELECT * FROM prediction_history QUALIFY prediction_timestamp = max(prediction_timestamp) OVER (PARTITION BY client_id)) p ON p.client_id = c.client_id
LEFT JOIN marketing_events e ON e.client_id = c.client_id AND e.event_timestamp >= {back(30)} GROUP BY ALL"""
      )(lambda d: _client_360(d.bucketed()))


def _client_360(d: Domain) -> DataFrame:
    return dashboards.client_360(d.clients, d.advisors, d.store_history, d.prediction_history, d.events, d.now)



settled_query("q51_table_counts", """
SELECT (SELECT count(*) FROM clients) AS clients, (SELECT count(*) FROM deployments) AS deployed_models,
 (SELECT count(*) FROM store) AS feature_records, (SELECT count(*) FROM daily) AS predictions"""
      )(lambda d: dashboards.table_counts(clients=d.clients, deployed_models=d.deployments, feature_records=d.store, predictions=d.daily))
query("q51_latest_accuracy", """
SELECT metric_value AS accuracy FROM perf_history ORDER BY evaluation_timestamp DESC LIMIT 1""")(lambda d: dashboards.latest_accuracy(d.perf_history))
settled_query("q51_open_severe_alerts", """
SELECT count(*) AS count FROM alerts WHERE status = 'open' AND severity IN ('critical', 'high')""")(lambda d: dashboards.open_severe_alerts(d.alerts))
settled_query("q51_latest_drift", """
SELECT drift_score FROM drift_history ORDER BY check_timestamp DESC, feature_name LIMIT 1""")(lambda d: dashboards.latest_drift(d.drift_history))
settled_query("q51_performance_series", """
SELECT monitor_hour AS evaluation_timestamp, accuracy, 2 * (precision * recall) / nullif(precision + recall, 0e0) AS f1_score FROM hourly"""
      )(lambda d: dashboards.performance_series(
          monitoring.performance_by_hour(d.monitored).withColumnRenamed("monitor_hour", "evaluation_timestamp")))
query("q51_store_statistics", """
SELECT count(*) AS total_features, count(DISTINCT client_id) AS unique_clients, max(feature_timestamp) AS last_updated FROM store_history"""
      )(lambda d: dashboards.store_statistics(d.store_history))
query("q51_likelihood_distribution", f"""
SELECT conversion_likelihood, count(*) AS client_count, {rnd(xavg('conversion_probability'), 3)} AS avg_probability FROM daily GROUP BY 1"""
      )(lambda d: dashboards.likelihood_distribution(d.daily))
query("q51_high_likelihood_count", "SELECT count(*) AS count FROM daily WHERE conversion_likelihood = 'High'"
      )(lambda d: dashboards.high_likelihood_count(d.daily))
settled_query("q52_score_unscored", f"""
SELECT d.client_id, d.prediction_timestamp, d.model_name, d.model_version, d.conversion_probability, d.churn_probability, d.recommended_action,
 d.prediction_confidence, d.lifecycle_stage, d.business_priority_score, 'Batch_Process' AS inference_source, d.inference_latency_ms, d.conversion_likelihood
FROM daily_all d WHERE d.client_id NOT IN (SELECT client_id FROM segments WHERE conversion_probability = 1) ORDER BY client_id LIMIT 100"""
      .replace("daily_all", "(" + CTES["daily"].replace("WHERE lifecycle_stage <> 'Dormant'", "").strip() + ")")
      )(lambda d: scoring.score_unscored(d.store, d.segments.filter("conversion_probability = 1"), d.now))
query("q53_predictions_today", """
SELECT client_id, conversion_probability, recommended_action FROM daily""")(lambda d: dashboards.predictions_today(d.daily, d.now))
query("q53_high_value_prospects", "SELECT * FROM prediction_history WHERE conversion_probability > 0.5e0"
      )(lambda d: dashboards.high_value_prospects(d.prediction_history, 0.5))
settled_query("q53_open_alerts", "SELECT * FROM alerts WHERE status = 'open'")(lambda d: dashboards.open_alerts(d.alerts))
query("q54_target_statistics", f"""
SELECT {big('sum(conversion_target)')} AS conversion_positives, {big('count(*) - sum(conversion_target)')} AS conversion_negatives,
 {big('sum(churn_target)')} AS churn_positives, {big('count(*) - sum(churn_target)')} AS churn_negatives,
 count(DISTINCT next_best_action) AS action_classes, count(*) AS total_samples FROM store WHERE conversion_target IS NOT NULL"""
      )(lambda d: reports.target_statistics(d.store))
query("q54_missing_key_features", """
SELECT count(*) AS total_records, count(*) FILTER (WHERE total_events_30d IS NULL OR web_visits_30d IS NULL OR email_opens_30d IS NULL
 OR email_clicks_30d IS NULL OR engagement_frequency_30d IS NULL) AS missing_key_features FROM store WHERE conversion_target IS NOT NULL"""
      )(lambda d: reports.missing_key_features(d.store))

# --------------------------------------------------------------------------
# Scorers
# --------------------------------------------------------------------------

query("x01_batch_rule", f"""
SELECT client_id, rule_p AS conversion_probability, prediction_confidence AS confidence, recommended_action AS next_action
FROM ({CTES['daily'][CTES['daily'].index('(SELECT *') + 1:CTES['daily'].rindex(')')]})"""
      )(lambda d: d.store.select("client_id", scoring.batch_rule(*[F.col(c) for c in (
          "engagement_score_30d", "annual_income", "current_401k_balance", "age", "service_tier_numeric",
          "days_since_last_activity")]).alias("s")).select("client_id", "s.*"))
_SEVEN = scoring.NUMERIC_FEATURES[:7]
query("x02_logistic_scores", f"""
SELECT client_id, lifecycle_stage, age_segment, business_priority_score, {rnd('p', 9)} AS conversion_probability, actual_conversion,
 CASE WHEN p > 0.7e0 THEN 'High' WHEN p > 0.4e0 THEN 'Medium' ELSE 'Low' END AS conversion_likelihood
FROM (SELECT *, conversion_target AS actual_conversion, 1 / (1 + exp(-0.1e0 * (({' + '.join(_SEVEN)}) / 7 - 10))) AS p FROM store)"""
      )(lambda d: rounded(scoring.array_scores(d.store, scoring.logistic_score), 9, "conversion_probability"))
query("x03_points_scores", f"""
SELECT client_id, lifecycle_stage, age_segment, business_priority_score, {rnd('p', 9)} AS conversion_probability, actual_conversion,
 CASE WHEN p > 0.7e0 THEN 'High' WHEN p > 0.4e0 THEN 'Medium' ELSE 'Low' END AS conversion_likelihood
FROM (SELECT *, conversion_target AS actual_conversion, least(1e0, greatest(0e0, (
  CASE WHEN total_events_30d > 20 THEN 30 WHEN total_events_30d > 10 THEN 20 WHEN total_events_30d > 5 THEN 10 ELSE 0 END
  + least(coalesce(engagement_score_30d, 0e0) / 4, 25e0)
  + CASE WHEN annual_income > 150000 THEN 25 WHEN annual_income > 100000 THEN 20 WHEN annual_income > 75000 THEN 15 WHEN annual_income > 50000 THEN 10 ELSE 0 END
  + business_priority_score * 0.2e0) / 100e0)) AS p FROM store)"""
      )(lambda d: rounded(scoring.array_scores(d.store), 9, "conversion_probability"))


def _sql_jobs(d: Domain) -> str:
    """The domain's tables as views, and the functions over them; returns the suffix of their names."""
    mark = uuid.uuid4().hex
    for name, frame in {"store": d.store, "preds": d.preds, "performance": d.perf_history, "drift": d.drift_history}.items():
        as_view(frame, f"{name}_{mark}")
    sql_functions.register_jobs(d.spark, *[f"{name}_{mark}" for name in ("store", "preds", "performance", "drift")])
    return mark


query("x10_sql_scorers", f"""
SELECT client_id, rule_p AS conversion_probability, prediction_confidence AS confidence, recommended_action AS next_action,
 CASE WHEN rule_p > 0.7e0 THEN 'High' WHEN rule_p > 0.4e0 THEN 'Medium' ELSE 'Low' END AS likelihood
FROM ({CTES['daily'][CTES['daily'].index('(SELECT *') + 1:CTES['daily'].rindex(')')]})"""
      )(lambda d: d.spark.sql(f"""
SELECT client_id, s.*, conversion_likelihood(s.conversion_probability) AS likelihood FROM (
 SELECT client_id, predict_conversion(engagement_score_30d, annual_income, current_401k_balance, age, service_tier_numeric, days_since_last_activity) AS s
 FROM store_{_sql_jobs(d)})"""))
query("x10_sql_array_scores", f"""
SELECT client_id, {rnd('1 / (1 + exp(-0.1e0 * ((' + ' + '.join(_SEVEN) + ') / 7 - 10)))', 9)} AS logistic, {rnd("""least(1e0, greatest(0e0, (
  CASE WHEN total_events_30d > 20 THEN 30 WHEN total_events_30d > 10 THEN 20 WHEN total_events_30d > 5 THEN 10 ELSE 0 END
  + least(coalesce(engagement_score_30d, 0e0) / 4, 25e0)
  + CASE WHEN annual_income > 150000 THEN 25 WHEN annual_income > 100000 THEN 20 WHEN annual_income > 75000 THEN 15 WHEN annual_income > 50000 THEN 10 ELSE 0 END
  + business_priority_score * 0.2e0) / 100e0))""", 9)} AS points FROM store WHERE total_events_30d IS NOT NULL AND engagement_score_30d IS NOT NULL AND days_since_last_activity IS NOT NULL"""
      )(lambda d: _array_scores(d))


def _array_scores(d: Domain) -> DataFrame:
    sql_functions.register_scorers(d.spark)
    name = f"inputs_{uuid.uuid4().hex}"
    known = d.store.dropna(subset=["total_events_30d", "engagement_score_30d", "days_since_last_activity"])
    as_view(known.select("client_id", scoring.feature_array().alias("features")), name)
    return d.spark.sql(f"SELECT client_id, round(logistic_score(features), 9) AS logistic, round(points_score(features), 9) AS points FROM {name}")


query("x11_sql_daily_scoring", f"""
SELECT client_id, {NOW} AS prediction_timestamp, conversion_probability, recommended_action, prediction_confidence, conversion_likelihood,
 CAST({NOW} AS DATE) AS prediction_date FROM daily
UNION ALL SELECT client_id, {NOW} - INTERVAL '1' DAY, conversion_probability, recommended_action, prediction_confidence, conversion_likelihood,
 CAST({NOW} - INTERVAL '1' DAY AS DATE) FROM daily"""
      )(lambda d: _scored_days(d.settled()))


def _scored_days(d: Domain) -> DataFrame:
    """The script for two days, and for one of them again."""
    table = f"daily_{_sql_jobs(d)}"
    location = scratch_path(d.spark, table)
    for back_days in (1, 0, 0):
        sql_functions.run_daily_scoring_sql(d.spark, table, (d.now - timedelta(days=back_days)).date(), location)
    return d.spark.table(table).drop("model_name", "lifecycle_stage")


query("x12_sql_performance_check", f"""
SELECT a AS current_accuracy, (0.5e0 - a) / 0.5e0 AS performance_drop,
 CASE WHEN (0.5e0 - a) / 0.5e0 > 0.1e0 THEN 'RETRAINING RECOMMENDED: Performance dropped by ' || CAST({rnd('(0.5e0 - a) / 0.5e0 * 100', 1)} AS VARCHAR) || '%'
  ELSE 'Model performing well. Current accuracy: ' || CAST({rnd('a * 100', 1)} AS VARCHAR) || '%' END AS result
FROM (SELECT count(*) FILTER (WHERE prediction = actual_conversion) / nullif(count(*), 0) AS a FROM preds)"""
      )(lambda d: _called(d, "SELECT * FROM performance_check(0.5D, 0.1D)"))
settled_query("x13_sql_alert_check", f"""
SELECT CASE WHEN a < 0.65e0 THEN 'ALERT: Model accuracy below threshold - ' || CAST({rnd('a', 4)} AS VARCHAR)
 WHEN w > 2e0 THEN 'ALERT: High feature drift detected - ' || CAST({rnd('w', 4)} AS VARCHAR) ELSE 'All systems normal' END AS alert_status
FROM (SELECT (SELECT {xavg('metric_value')} FROM perf_history WHERE metric_name = 'ACCURACY' AND evaluation_timestamp >= TIMESTAMP '2024-01-29 00:00:00') AS a,
 (SELECT max(drift_score) FROM drift_history WHERE check_timestamp >= TIMESTAMP '2024-01-29 00:00:00') AS w)"""
              )(lambda d: _called(d, "SELECT * FROM alert_check(TIMESTAMP_NTZ '2024-01-30 00:00:00', 0.65D, 2D)"))


def _called(d: Domain, text: str) -> DataFrame:
    _sql_jobs(d)
    return d.spark.sql(text)


CTES["lookup"] = """
SELECT p.*, s.days_since_last_activity, s.total_assets_under_management, s.retirement_readiness_score, s.years_to_retirement,
 CASE WHEN p.prediction = 1 THEN 'Will Convert' ELSE 'Will Not Convert' END AS text,
 CASE WHEN p.prediction = 1 AND p.business_priority_score >= 0.8e0 THEN 'Schedule immediate advisor meeting'
  WHEN p.prediction = 1 THEN 'Include in conversion campaign' WHEN s.days_since_last_activity > 30 THEN 'Re-engagement required'
  ELSE 'Standard communication' END AS act,
 CASE WHEN s.days_since_last_activity > 60 THEN 'High' WHEN s.days_since_last_activity > 30 THEN 'Medium' ELSE 'Low' END AS risk
FROM preds p JOIN store s ON s.client_id = p.client_id WHERE p.client_id IN (SELECT client_id FROM requests)"""
settled_query("x04_client_intelligence", f"""
SELECT client_id, prediction, text AS prediction_text, {rnd('business_priority_score', 1)} AS priority_score, lifecycle_stage, age_segment,
 days_since_last_activity AS days_inactive, {rnd('total_assets_under_management', 0)} AS total_assets,
 {rnd('retirement_readiness_score * 100', 1)} AS retirement_readiness, years_to_retirement, act AS primary_action, risk AS churn_risk,
 {NOW} AS timestamp FROM lookup""")(lambda d: scoring.client_intelligence(d.requests, d.preds, d.store, d.now).select("intelligence.*"))
settled_query("x05_client_score_table", f"""
SELECT client_id, text AS prediction, business_priority_score AS priority_score,
 CASE WHEN business_priority_score >= 0.8e0 THEN 'High Priority' WHEN business_priority_score >= 0.6e0 THEN 'Medium Priority' ELSE 'Low Priority' END AS priority_tier,
 act AS recommended_action, risk AS churn_risk, {rnd('total_assets_under_management', 0)} AS total_assets FROM lookup"""
      )(lambda d: scoring.client_score_table(d.requests, d.preds, d.store))
query("x06_fallback_simple", """
SELECT client_id, CASE WHEN coalesce(engagement_score_30d, 0) > 0.5e0 AND coalesce(annual_income, 0) > 75000 THEN 0.7e0 ELSE 0.3e0 END AS conversion_probability,
 0.8e0 AS confidence,
 CASE WHEN coalesce(engagement_score_30d, 0) > 0.5e0 AND coalesce(annual_income, 0) > 75000 THEN 'Schedule_Consultation' ELSE 'Educational_Content' END AS next_action,
 50e0 AS response_time_ms
FROM (SELECT c.client_id, c.annual_income, e.engagement_score_30d FROM clients c LEFT JOIN engagement e ON e.client_id = c.client_id)"""
      )(lambda d: features.lifecycle_segments(d.clients, d.engagement).select(
          "client_id", scoring.fallback_simple(F.col("engagement_score_30d"), F.col("annual_income")).alias("s")
      ).select("client_id", "s.*"))
_TIERED = """CASE WHEN engagement_score_30d > 0.6e0 AND annual_income > 100000 THEN 0.75e0
  WHEN engagement_score_30d > 0.3e0 AND current_401k_balance > 50000 THEN 0.55e0 ELSE 0.3e0 END AS conversion_probability, 0.7e0 AS confidence,
 CASE WHEN engagement_score_30d > 0.6e0 AND annual_income > 100000 THEN 'Schedule_Wealth_Consultation'
  WHEN engagement_score_30d > 0.3e0 AND current_401k_balance > 50000 THEN 'Schedule_Planning_Session' ELSE 'Educational_Content' END AS next_action"""
query("x07_fallback_tiered", f"SELECT client_id, {_TIERED}, 'fallback' AS source FROM store"
      )(lambda d: d.store.select("client_id", scoring.fallback_tiered(
          F.col("engagement_score_30d"), F.col("annual_income"), F.col("current_401k_balance")).alias("s")).select("client_id", "s.*"))
query("x08_online_score_log", f"""
SELECT client_id, 'CONVERSION_PREDICTOR' AS model_name, 'fallback' AS source, 0e0 AS response_time_ms, {NOW} AS timestamp, {_TIERED} FROM store"""
      )(lambda d: scoring.online_scores(d.store, d.now).select(
          "client_id", "model_name", "source", "response_time_ms", "timestamp", "prediction_result.conversion_probability",
          "prediction_result.confidence", "prediction_result.next_action"))

query("m05_train_split", f"""
SELECT CASE WHEN {uniform('client_id', '42')} < 0.2e0 THEN 'test' ELSE 'train' END AS part, count(*) AS clients,
 {big('sum(conversion_target)')} AS positives FROM store GROUP BY 1"""
      )(lambda d: _split_counts(d))


def _split_counts(d: Domain) -> DataFrame:
    train, test = hash_split(d.store, "client_id")
    parts = train.select(F.lit("train").alias("part"), "conversion_target").unionByName(
        test.select(F.lit("test").alias("part"), "conversion_target"))
    return parts.groupBy("part").agg(F.count("*").alias("clients"), F.sum("conversion_target").alias("positives"))
