"""Action and retention segmentation of scored clients, with their summaries.

Stage labels are compared with ``_`` read as a space, so ``At_Risk`` and
``At Risk`` are one stage.  Priority thresholds are on the 0..1 scale of the
priority score and can be passed for any other scale.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import at, exact_avg, first_match, money_sum
from tidemark.operators import top_rows


def _stage() -> Column:
    return F.replace(F.col("lifecycle_stage"), F.lit("_"), F.lit(" "))


def _starts(column: str, prefix: str) -> Column:
    return F.col(column).startswith(prefix)


def client_segments(preds: DataFrame, as_of: datetime, high: float = 0.8, elevated: float = 0.7,
                    version: str = "V1") -> DataFrame:
    """Action segment and recommended action of every prediction."""
    converts, stays = F.col("prediction") == 1, F.col("prediction") == 0
    priority, age, stage = F.col("business_priority_score"), F.col("age_segment"), _stage()
    active, fresh = stage.isin("Active", "Engaged"), stage.isin("New", "Onboarding")
    at_risk = stage == "At Risk"

    # Segment labels, first matching rule wins.
    segment = first_match([
        (converts & active & (priority > high), "High Value - Immediate Outreach"),
        (converts & active, "High Potential - Quick Follow-up"),
        (converts & fresh, "New High Potential - Nurture"),
        (converts, "Predicted Converter - Standard Outreach"),
        (stays & (priority > elevated), "High Priority Non-Converter - Special Attention"),
        (stays & at_risk, "At Risk - Retention Focus"),
        (stays & fresh, "New Client - Education Focus"),
    ], "Standard - Monitor")

    # Recommended actions, first matching rule wins.
    action = first_match([
        (converts & (priority > high), "Schedule advisor meeting within 48 hours"),
        (converts & age.isin("Pre-Retirement", "Peak Earning"), "Send personalized wealth advisory email"),
        (converts, "Include in targeted conversion campaign"),
        (stays & at_risk, "Retention outreach - check satisfaction"),
        (stays & age.isin("Young Professional", "Early Career"), "Educational content series"),
    ], "Continue standard communications")

    return preds.select(
        "client_id", "lifecycle_stage", "age_segment", "business_priority_score",
        F.col("prediction").alias("conversion_probability"), "actual_conversion",
        segment.alias("action_segment"), action.alias("recommended_action"),
        at(as_of).alias("batch_timestamp"), F.lit(version).alias("model_version"),
    )


def segment_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("action_segment").agg(
        F.count("*").alias("client_count"),
        F.avg("conversion_probability").alias("avg_probability"),
        F.count_if(F.col("actual_conversion") == 1).alias("actual_conversions"),
    ).orderBy(F.col("avg_probability").desc(), "action_segment")


def batch_summary(segments: DataFrame) -> DataFrame:
    """One row per scoring batch."""
    return segments.groupBy("batch_timestamp").agg(
        F.count_distinct("client_id").alias("total_clients_scored"),
        F.count_if(_starts("action_segment", "High")).alias("high_priority_clients"),
        F.avg("conversion_probability").alias("average_conversion_prediction"),
        F.count_if(F.col("conversion_probability") == 1).alias("predicted_conversions"),
        F.count_if(F.col("actual_conversion") == 1).alias("actual_conversions"),
    )


def prediction_outcomes(segments: DataFrame) -> DataFrame:
    predicted = F.col("conversion_probability") == 1
    return segments.agg(
        F.count_if(predicted).alias("predicted_to_convert"),
        F.count_if(F.col("conversion_probability") == 0).alias("predicted_not_convert"),
        F.count_if(predicted & (F.col("actual_conversion") == 1)).alias("true_positives"),
        F.count("*").alias("total_clients"),
    )


def top_priority_clients(segments: DataFrame, k: int = 10) -> DataFrame:
    chosen = segments.filter(_starts("action_segment", "High")).select(
        "client_id", "action_segment", "conversion_probability", "business_priority_score",
        "recommended_action")
    return top_rows(chosen, [F.col("business_priority_score").desc(), F.col("client_id")], k)


# --------------------------------------------------------------------------
# Churn
# --------------------------------------------------------------------------

def churn_indicators(store: DataFrame) -> DataFrame:
    return store.agg(
        F.count("*").alias("total_clients"),
        F.count_if(F.col("churn_target") == 1).alias("churned_clients"),
        F.count_if(F.col("days_since_last_activity") > 30).alias("inactive_30d"),
        F.count_if(_stage() == "At Risk").alias("at_risk_clients"),
    )


def value_tier(assets: Column) -> Column:
    return first_match([
        (assets > 500000, "High Value"), (assets > 250000, "Medium Value"),
        (assets > 100000, "Standard Value"),
    ], "Growth Potential")


def churn_risk() -> Column:
    days = F.col("days_since_last_activity")
    return first_match([
        (days > 60, 0.9),
        (days > 30, 0.7),
        (F.col("engagement_score_30d") < 0.1, 0.6),
        (F.col("total_events_30d") == 0, 0.5),
        (_stage() == "At Risk", 0.7),
        (F.col("lifecycle_stage") == "Dormant", 0.8),
    ], F.coalesce("churn_probability", F.lit(0.2)))


def churn_segments(store: DataFrame, segments: DataFrame, as_of: datetime) -> DataFrame:
    """Churn risk, value tier, retention segment and action per client.

    The rules read the unrounded risk; the output shows it at three digits.
    """
    scored = segments.select("client_id", F.col("conversion_probability").alias("_converts"))
    df = store.join(scored, "client_id", "left").withColumns({
        "_risk": churn_risk(), "value_tier": value_tier(F.col("total_assets_under_management")),
    })
    risk, value, tenure = F.col("_risk"), F.col("value_tier"), F.col("client_tenure_months")
    days, engagement = F.col("days_since_last_activity"), F.col("engagement_score_30d")

    # Retention segments, first matching rule wins.
    segment = first_match([
        ((risk >= 0.8) & (value == "High Value"), "Critical - Immediate Executive Intervention"),
        ((risk >= 0.8) & (value == "Medium Value"), "Critical - Urgent Advisor Outreach"),
        ((risk >= 0.7) & value.isin("High Value", "Medium Value"),
         "High Risk - Proactive Retention Required"),
        ((risk >= 0.6) & (F.col("_converts") == 1),
         "Risk & Opportunity - Convert to Prevent Churn"),
        ((risk >= 0.5) & (tenure < 12), "New Client Risk - Enhanced Onboarding"),
        (risk >= 0.5, "Medium Risk - Re-engagement Campaign"),
        (days > 14, "Early Warning - Check-in Required"),
    ], "Low Risk - Standard Monitoring")

    # Retention actions, first matching rule wins.
    action = first_match([
        ((risk >= 0.8) & (F.col("total_assets_under_management") > 500000),
         "CEO/Senior Advisor personal call within 24 hours"),
        (risk >= 0.8, "Dedicated advisor call within 48 hours"),
        ((risk >= 0.7) & F.col("age_segment").isin("Pre-Retirement", "Retirement"),
         "Schedule retirement planning review"),
        (risk >= 0.7, "Send personalized retention offer"),
        ((engagement < 0.1) & (tenure > 24), "Win-back campaign with service upgrade"),
        (engagement < 0.1, "Educational webinar invitation"),
        (days > 30, "Automated check-in email sequence"),
    ], "Continue regular engagement")

    return df.select(
        "client_id", "lifecycle_stage", "age_segment", "value_tier", "client_tenure_months",
        "days_since_last_activity", F.round("_risk", 3).alias("churn_risk_score"),
        segment.alias("retention_segment"), action.alias("retention_action"),
        F.col("_converts").alias("conversion_probability"), "business_priority_score", at(as_of).alias("analysis_timestamp"),
    )


def retention_summary(churn: DataFrame) -> DataFrame:
    return churn.groupBy("retention_segment", "value_tier").agg(
        F.count("*").alias("client_count"),
        exact_avg(F.col("churn_risk_score")).alias("avg_risk_score"),
        F.avg("days_since_last_activity").alias("avg_days_inactive"),
    ).orderBy(F.col("avg_risk_score").desc(), "retention_segment", "value_tier")


def churn_prevention_summary(churn: DataFrame) -> DataFrame:
    risk = F.col("churn_risk_score")
    return churn.groupBy("analysis_timestamp").agg(
        F.count("*").alias("total_clients"),
        F.count_if(_starts("retention_segment", "Critical")).alias("critical_risk_clients"),
        F.count_if(_starts("retention_segment", "High Risk")).alias("high_risk_clients"),
        F.count_if((F.col("value_tier") == "High Value") & (risk >= 0.7)).alias("high_value_at_risk"),
        F.count_if(risk >= 0.7).alias("total_high_risk"),
        exact_avg(risk).alias("avg_churn_risk"),
        F.avg("days_since_last_activity").alias("avg_days_inactive"),
    )


def _with_assets(churn: DataFrame, store: DataFrame) -> DataFrame:
    return churn.join(store.select("client_id", "total_assets_under_management"), "client_id")


def critical_clients(churn: DataFrame, store: DataFrame, k: int = 15) -> DataFrame:
    urgent = churn.filter(
        _starts("retention_segment", "Critical") & F.col("value_tier").isin("High Value", "Medium Value"))
    ranked = top_rows(_with_assets(urgent, store), [
        F.col("total_assets_under_management").desc(), F.col("churn_risk_score").desc(), F.col("client_id"),
    ], k)
    return ranked.select(
        "client_id", "value_tier", F.round("total_assets_under_management", 0).alias("assets"),
        "days_since_last_activity", "churn_risk_score", "retention_action",
    )


def retention_opportunities(churn: DataFrame, k: int = 10) -> DataFrame:
    """At risk, yet predicted to convert."""
    chosen = churn.filter((F.col("churn_risk_score") >= 0.5) & (F.col("conversion_probability") == 1)).select(
        "client_id", "lifecycle_stage", "churn_risk_score", "conversion_probability", "retention_action")
    return top_rows(chosen, [F.col("churn_risk_score").desc(), F.col("client_id")], k)


def churn_executive_summary(churn: DataFrame, store: DataFrame) -> DataFrame:
    critical = _starts("retention_segment", "Critical")
    exposed = F.when(
        critical & (F.col("value_tier") == "High Value"), F.col("total_assets_under_management")
    ).otherwise(0.0)
    return _with_assets(churn, store).agg(
        F.count_if(critical).alias("critical_count"),
        F.count_if(F.col("retention_segment").contains("Risk")).alias("total_at_risk"),
        money_sum(exposed).alias("assets_at_risk"),
    )
