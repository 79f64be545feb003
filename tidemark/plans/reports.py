"""Analyst reports over events, the feature store and the scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import exact_avg, first_match, percent
from tidemark.operators import exact_quantile, metric_rows, attach_row, top_rows
from tidemark.plans.scoring import NUMERIC_FEATURES
from tidemark.session import scratch_path
from tidemark.sources.writers import materialize


def _avg4(column: str) -> Column:
    """Mean of a four-digit score, shown at four digits."""
    return F.round(exact_avg(F.col(column)), 4)


def _filled(column: str) -> Column:
    return F.count(column)


# --------------------------------------------------------------------------
# Events
# --------------------------------------------------------------------------

def time_on_page_stats(events: DataFrame) -> DataFrame:
    seconds = F.col("time_on_page")
    return events.filter(seconds.isNotNull()).groupBy("event_type").agg(
        F.count("*").alias("events_with_time"),
        F.round(F.avg(seconds), 1).alias("avg_time_seconds"),
        F.min(seconds).alias("min_time_seconds"),
        F.max(seconds).alias("max_time_seconds"),
    ).orderBy(F.col("avg_time_seconds").desc(), "event_type")


def recent_timed_events(events: DataFrame, k: int = 10) -> DataFrame:
    timed = events.filter(F.col("time_on_page").isNotNull())
    newest = top_rows(timed, [F.col("event_timestamp").desc(), F.col("event_id")], k)
    return newest.select("event_type", "channel", "time_on_page", "touchpoint_value", "conversion_flag")


# --------------------------------------------------------------------------
# Feature tables
# --------------------------------------------------------------------------

def engaged_sample(engagement: DataFrame, k: int = 10) -> DataFrame:
    active = engagement.filter(F.col("total_events_30d") > 0).select(
        "client_id", "total_events_30d", "web_visits_30d", "email_opens_30d",
        "engagement_frequency_30d", "engagement_score_30d", "days_since_last_activity")
    return top_rows(active, [F.col("engagement_score_30d").desc(), F.col("client_id")], k)


def feature_completeness(store: DataFrame) -> DataFrame:
    return store.agg(
        F.count("*").alias("total_records"),
        _filled("engagement_score_30d").alias("with_engagement_score"),
        _filled("retirement_readiness_score").alias("with_retirement_score"),
        _filled("conversion_target").alias("with_conversion_target"),
        _filled("churn_target").alias("with_churn_target"),
        percent(_filled("engagement_score_30d"), F.count("*")).alias("completeness_percentage"),
    )


def key_feature_stats(store: DataFrame) -> DataFrame:
    return store.agg(
        _avg4("engagement_score_30d").alias("avg_engagement_score"),
        _avg4("retirement_readiness_score").alias("avg_retirement_readiness"),
        _avg4("conversion_probability").alias("avg_conversion_prob"),
        _avg4("churn_probability").alias("avg_churn_prob"),
        F.sum("conversion_target").alias("total_conversion_targets"),
        F.sum("churn_target").alias("total_churn_targets"),
    )


def financial_distributions(financial: DataFrame) -> DataFrame:
    return financial.agg(
        _avg4("retirement_readiness_score").alias("avg_retirement_readiness"),
        _avg4("wealth_growth_potential").alias("avg_wealth_potential"),
        _avg4("mobile_adoption_score").alias("avg_mobile_adoption"),
        F.count_if(F.col("premium_client_indicator") == 1).alias("premium_clients"),
        _avg4("lifetime_engagement_frequency").alias("avg_engagement_freq"),
    )


def lifecycle_distribution(targets: DataFrame) -> DataFrame:
    return targets.groupBy("lifecycle_stage").agg(
        F.count("*").alias("client_count"),
        _avg4("conversion_probability").alias("avg_conversion_prob"),
        _avg4("churn_probability").alias("avg_churn_prob"),
        F.sum("conversion_target").alias("conversion_targets"),
        F.sum("churn_target").alias("churn_targets"),
    ).orderBy(F.col("client_count").desc(), "lifecycle_stage")


def next_action_distribution(targets: DataFrame) -> DataFrame:
    return targets.groupBy("next_best_action").agg(
        F.count("*").alias("client_count"),
        _avg4("business_priority_score").alias("avg_priority_score"),
    ).orderBy(F.col("client_count").desc(), "next_best_action")


def high_growth_sample(store: DataFrame, k: int = 5, growth: float = 0.7) -> DataFrame:
    chosen = store.filter(F.col("wealth_growth_potential") > growth).select(
        "client_id", "engagement_score_30d", "retirement_readiness_score", "annual_income", "lifecycle_stage")
    return top_rows(chosen, [F.col("client_id")], k)


def engaged_clients(view: DataFrame, k: int = 10, score: float = 0.8) -> DataFrame:
    chosen = view.filter(F.col("engagement_score_30d") > score).select(
        "client_id", "engagement_score_30d", "retirement_readiness_score", "lifecycle_stage",
        "total_assets_under_management", "annual_income")
    return top_rows(chosen, [F.col("total_assets_under_management").desc(), F.col("client_id")], k)


def high_value_clients(view: DataFrame, k: int = 20, growth: float = 0.7, tier: int = 3) -> DataFrame:
    chosen = view.filter(
        (F.col("wealth_growth_potential") > growth) & (F.col("service_tier_numeric") >= tier)
    ).select(
        "client_id", "age", "annual_income", "current_401k_balance", "total_assets_under_management",
        "wealth_growth_potential", "service_tier_numeric")
    return top_rows(chosen, [F.col("total_assets_under_management").desc(), F.col("client_id")], k)


def age_segment_distribution(view: DataFrame) -> DataFrame:
    return view.groupBy("age_segment").agg(
        F.count("*").alias("client_count"),
        exact_avg(F.col("engagement_score_30d")).alias("avg_engagement"),
        exact_avg(F.col("retirement_readiness_score")).alias("avg_readiness"),
    ).orderBy("age_segment")


def engagement_patterns(view: DataFrame) -> DataFrame:
    return view.groupBy("lifecycle_stage").agg(
        F.avg("total_events_30d").alias("avg_monthly_events"),
        exact_avg(F.col("email_click_rate_30d")).alias("avg_email_engagement"),
        exact_avg(F.col("web_preference_ratio")).alias("avg_web_preference"),
        F.count("*").alias("client_count"),
    ).orderBy(F.col("avg_monthly_events").desc(), "lifecycle_stage")


def store_summary(view: DataFrame, definitions: DataFrame) -> DataFrame:
    """Three metric rows: clients, features, feature categories."""
    return metric_rows(view, {"Total Clients": F.count_distinct("client_id")}).unionByName(
        metric_rows(definitions, {
            "Total Features": F.count("*"),
            "Feature Categories": F.count_distinct("feature_description"),
        }))


def target_statistics(store: DataFrame) -> DataFrame:
    positives = {name: F.sum(f"{name}_target") for name in ("conversion", "churn")}
    return store.filter(F.col("conversion_target").isNotNull()).agg(
        *[column for name, total in positives.items() for column in (
            total.alias(f"{name}_positives"), (F.count("*") - total).alias(f"{name}_negatives"))],
        F.count_distinct("next_best_action").alias("action_classes"),
        F.count("*").alias("total_samples"),
    )


def missing_key_features(store: DataFrame, features: Sequence[str] = NUMERIC_FEATURES[:5]) -> DataFrame:
    """Labelled rows with any of the key features missing."""
    missing = F.greatest(*[F.col(c).isNull() for c in features])
    return store.filter(F.col("conversion_target").isNotNull()).agg(
        F.count("*").alias("total_records"), F.count_if(missing).alias("missing_key_features"))


# --------------------------------------------------------------------------
# Scores
# --------------------------------------------------------------------------

def _converted() -> Column:
    return F.count_if(F.col("actual_conversion") == 1)


def _converted_share() -> Column:
    return F.avg(F.when(F.col("actual_conversion") == 1, 1.0).otherwise(0.0))


def score_summary(scores: DataFrame) -> DataFrame:
    p = F.col("conversion_probability")
    return scores.agg(
        F.count("*").alias("total_clients"), exact_avg(p).alias("avg_probability"),
        F.min(p).alias("min_probability"), F.max(p).alias("max_probability"),
        F.count_if(p > 0.7).alias("high_probability_count"),
        _converted().alias("actual_conversions"),
    )


def likelihood_summary(scores: DataFrame) -> DataFrame:
    band = F.col("conversion_likelihood")
    return scores.agg(
        F.count("*").alias("total_clients"),
        exact_avg(F.col("conversion_probability")).alias("avg_probability"),
        *[F.count_if(band == name).alias(f"{name.lower()}_count") for name in ("High", "Medium", "Low")],
        _converted_share().alias("actual_conversion_rate"),
    )


def score_spread(scores: DataFrame) -> DataFrame:
    """Range, deviation and exact median of the probability.

    The scores are written once, as the one column that both sides read.
    """
    p = F.col("conversion_probability")
    scores = materialize(scores.select(p), scratch_path(scores.sparkSession, "scores"))
    moments = scores.agg(
        F.count("*").alias("total_clients"), exact_avg(p).alias("avg_probability"),
        F.min(p).alias("min_probability"), F.max(p).alias("max_probability"),
        F.stddev_samp(p).alias("stddev_probability"),
    )
    median = exact_quantile(scores, "conversion_probability", 0.5, name="median_probability")
    return attach_row(moments, median, required=False)


def scores_by_age_segment(scores: DataFrame) -> DataFrame:
    return scores.groupBy("age_segment").agg(
        F.count("*").alias("client_count"),
        exact_avg(F.col("conversion_probability")).alias("avg_probability"),
        _converted().alias("actual_conversions"),
        _converted_share().alias("actual_rate"),
    ).orderBy(F.col("avg_probability").desc(), "age_segment")


def scores_by_stage(scores: DataFrame) -> DataFrame:
    return scores.groupBy("lifecycle_stage").agg(
        F.count("*").alias("client_count"),
        exact_avg(F.col("conversion_probability")).alias("avg_probability"),
        exact_avg(F.col("business_priority_score")).alias("avg_priority"),
    ).orderBy(F.col("avg_probability").desc(), "lifecycle_stage")


def calibration_three_bands(scores: DataFrame) -> DataFrame:
    p = F.col("conversion_probability")
    band = first_match([(p > 0.7, "High (>0.7)"), (p > 0.4, "Medium (0.4-0.7)")], "Low (<0.4)")
    return scores.groupBy(band.alias("probability_band")).agg(
        F.count("*").alias("client_count"),
        F.sum("actual_conversion").alias("actual_conversions"),
        F.avg("actual_conversion").alias("conversion_rate"),
    ).orderBy("probability_band")


def calibration_five_bands(scores: DataFrame) -> DataFrame:
    p = F.col("conversion_probability")
    # Band edges and labels.
    band = first_match([
        (p >= 0.8, "0.8-1.0"), (p >= 0.6, "0.6-0.8"), (p >= 0.4, "0.4-0.6"), (p >= 0.2, "0.2-0.4"),
    ], "0.0-0.2")
    return scores.groupBy(band.alias("prob_band")).agg(
        F.count("*").alias("client_count"),
        F.sum("actual_conversion").alias("conversions"),
        F.avg("actual_conversion").alias("conversion_rate"),
    ).orderBy(F.col("prob_band").desc())


def top_candidates(scores: DataFrame, k: int = 10) -> DataFrame:
    chosen = scores.select(
        "client_id", "lifecycle_stage", "age_segment", "conversion_probability", "business_priority_score")
    return top_rows(chosen, [F.col("conversion_probability").desc(), F.col("client_id")], k)


def top_banded_candidates(scores: DataFrame, k: int = 20, floor: float | None = None) -> DataFrame:
    """Top scores with their band; ``floor`` keeps only better ones."""
    pool = scores if floor is None else scores.filter(F.col("conversion_probability") > floor)
    chosen = pool.select(
        "client_id", "lifecycle_stage", "age_segment", "business_priority_score",
        "conversion_probability", "actual_conversion", "conversion_likelihood")
    return top_rows(chosen, [F.col("conversion_probability").desc(), F.col("client_id")], k)
