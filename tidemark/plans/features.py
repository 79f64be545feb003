"""Feature tables: engagement, financial/behavioural, lifecycle/targets, store.

All event metrics, trailing and lifetime, come out of :func:`client_activity`:
one scan, one map-side combined aggregate, one shuffle on ``client_id``.  The
public feature functions project what they need from it; Catalyst drops the
aggregates they do not use.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import (
    at, at_least, at_most, bernoulli, clamp, code_map, days_back, days_between,
    exact_avg, exact_sum, first_match, flag, hash_uniform, ratio, resolve_as_of,
)

# Code tables and labels of the feature definitions.
SERVICE_TIER_CODES = {"Basic": 1, "Premium": 2, "Elite": 3}
RISK_TOLERANCE_CODES = {"Conservative": 1, "Moderate": 2, "Aggressive": 3}
EXPERIENCE_CODES = {"Beginner": 1, "Intermediate": 2, "Advanced": 3}
DEFAULT_TOUCHPOINT = 0.5

# Feature table columns, in order.
ENGAGEMENT_COLUMNS = (
    "client_id", "feature_timestamp",
    "total_events_7d", "web_visits_7d", "email_opens_7d", "email_clicks_7d",
    "total_events_30d", "web_visits_30d", "email_opens_30d", "email_clicks_30d",
    "personal_interactions_30d", "total_events_90d", "web_visits_90d",
    "avg_session_duration_30d", "max_session_duration_30d", "active_days_30d",
    "total_touchpoint_value_30d", "avg_touchpoint_value_30d", "conversions_30d",
    "last_activity_timestamp", "days_since_last_activity", "engagement_frequency_30d",
    "email_click_rate_30d", "engagement_trend_30d", "engagement_score_30d",
)
BEHAVIOR_COLUMNS = (
    "client_id", "web_preference_count", "email_preference_count", "phone_preference_count",
    "inperson_preference_count", "desktop_usage", "mobile_usage", "tablet_usage",
    "total_lifetime_events", "education_engagement", "advisor_meetings_total",
    "avg_touchpoint_value", "engagement_span_days",
)
FINANCIAL_COLUMNS = (
    "age", "annual_income", "current_401k_balance", "years_to_retirement",
    "total_assets_under_management", "client_tenure_months", "income_to_age_ratio",
    "assets_to_income_ratio", "retirement_readiness_score", "wealth_growth_potential",
    "premium_client_indicator", "service_tier_numeric", "risk_tolerance_numeric",
    "investment_experience_numeric",
)
BEHAVIORAL_COLUMNS = (
    "total_lifetime_events", "engagement_span_days", "education_engagement",
    "advisor_meetings_total", "web_preference_ratio", "email_preference_ratio",
    "phone_preference_ratio", "inperson_preference_ratio", "mobile_adoption_score",
    "lifetime_engagement_frequency", "avg_touchpoint_value",
)
TARGET_COLUMNS = (
    "lifecycle_stage", "age_segment", "tenure_segment", "conversion_probability",
    "churn_probability", "conversion_target", "churn_target", "next_best_action",
    "business_priority_score",
)
# Kept in the engagement table but not carried into the store.
STORE_ENGAGEMENT_COLUMNS = tuple(
    c for c in ENGAGEMENT_COLUMNS if c not in ("max_session_duration_30d", "last_activity_timestamp")
)
STORE_COLUMNS = STORE_ENGAGEMENT_COLUMNS + FINANCIAL_COLUMNS + BEHAVIORAL_COLUMNS + TARGET_COLUMNS


# --------------------------------------------------------------------------
# One pass over the events
# --------------------------------------------------------------------------

def client_activity(events: DataFrame, as_of: datetime) -> DataFrame:
    """One row per client with every trailing and lifetime event metric.

    ``as_of`` is the clock: events stamped later have not happened yet.  That
    bound also lets the distinct active days of the 30-day window (31 calendar
    days at most) live in one 64-bit mask, so there is no distinct-expansion
    and no second shuffle.
    """
    ts, kind = F.col("event_timestamp"), F.col("event_type")
    recent = {n: ts >= days_back(as_of, days=n) for n in (7, 30, 90)}

    def typed(days: int, name: str) -> Column:
        return F.count_if(recent[days] & (kind == name))

    def equals(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value)

    in_month = recent[30]
    touch = F.when(in_month, F.coalesce(F.col("touchpoint_value").cast("double"), F.lit(DEFAULT_TOUCHPOINT)))
    page_time = F.when(in_month, F.col("time_on_page"))
    day_index = F.datediff(F.to_date(ts), F.lit((as_of - timedelta(days=30)).date()))
    day_bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), day_index)

    # An event without a time is in no window but counts towards the lifetime.
    known = events.filter(ts.isNull() | (ts <= at(as_of)))
    return known.groupBy("client_id").agg(
        F.count_if(recent[7]).alias("total_events_7d"),
        typed(7, "web_visit").alias("web_visits_7d"),
        typed(7, "email_open").alias("email_opens_7d"),
        typed(7, "email_click").alias("email_clicks_7d"),
        F.count_if(in_month).alias("total_events_30d"),
        typed(30, "web_visit").alias("web_visits_30d"),
        typed(30, "email_open").alias("email_opens_30d"),
        typed(30, "email_click").alias("email_clicks_30d"),
        typed(30, "advisor_meeting").alias("personal_interactions_30d"),
        F.count_if(recent[90]).alias("total_events_90d"),
        typed(90, "web_visit").alias("web_visits_90d"),
        F.round(F.avg(page_time), 2).alias("avg_session_duration_30d"),
        F.max(page_time).alias("max_session_duration_30d"),
        F.coalesce(F.bit_count(F.bit_or(F.when(in_month, day_bit))), F.lit(0)).cast("bigint")
        .alias("active_days_30d"),
        F.round(exact_sum(touch), 4).alias("total_touchpoint_value_30d"),
        F.round(exact_avg(touch), 4).alias("avg_touchpoint_value_30d"),
        F.count_if(in_month & F.col("conversion_flag")).alias("conversions_30d"),
        F.max(ts).alias("last_activity_timestamp"),
        equals("channel", "Website").alias("web_preference_count"),
        equals("channel", "Email").alias("email_preference_count"),
        equals("channel", "Phone").alias("phone_preference_count"),
        equals("channel", "In-Person").alias("inperson_preference_count"),
        equals("device_type", "Desktop").alias("desktop_usage"),
        equals("device_type", "Mobile").alias("mobile_usage"),
        equals("device_type", "Tablet").alias("tablet_usage"),
        F.count("*").alias("total_lifetime_events"),
        equals("event_type", "document_download").alias("education_engagement"),
        equals("event_type", "advisor_meeting").alias("advisor_meetings_total"),
        exact_avg(F.col("touchpoint_value").cast("double")).alias("avg_touchpoint_value"),
        days_between(F.min(ts), F.max(ts)).alias("engagement_span_days"),
    )


def _engagement_columns(as_of: datetime) -> dict[str, Column]:
    """Rates and the composite score, from the counts of ``client_activity``."""
    events_30d, opens_30d = F.col("total_events_30d"), F.col("email_opens_30d")
    weighted = (
        events_30d * 0.3 + F.col("web_visits_30d") * 0.2 + opens_30d * 0.2
        + F.col("personal_interactions_30d") * 0.3
    )
    zero = F.lit(0.0)
    return {
        "feature_timestamp": at(as_of),
        "days_since_last_activity": days_between(F.col("last_activity_timestamp"), at(as_of)),
        "engagement_frequency_30d": F.round(
            F.coalesce(ratio(events_30d, F.col("active_days_30d")), zero), 4),
        "email_click_rate_30d": F.round(
            F.coalesce(ratio(F.col("email_clicks_30d"), opens_30d), zero), 4),
        "engagement_trend_30d": F.round(
            F.coalesce(ratio(events_30d, F.col("total_events_90d") / 3), zero), 4),
        "engagement_score_30d": F.round(at_most(weighted / 100, 1.0), 4),
    }


def engagement_features(events: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Engagement metrics per client over trailing 7/30/90 days."""
    as_of = resolve_as_of(events, "event_timestamp", as_of)
    activity = client_activity(events, as_of)
    return activity.withColumns(_engagement_columns(as_of)).select(*ENGAGEMENT_COLUMNS)


def client_behaviors(events: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Lifetime channel, device and content counts per client."""
    as_of = resolve_as_of(events, "event_timestamp", as_of)
    return client_activity(events, as_of).select(*BEHAVIOR_COLUMNS)


# --------------------------------------------------------------------------
# Client attributes
# --------------------------------------------------------------------------

def financial_profile(clients: DataFrame) -> DataFrame:
    """Ratios, scores and numeric codes of one client row (no shuffle)."""
    income = F.col("annual_income")
    balance = F.col("current_401k_balance").cast("double")
    assets = F.col("total_assets_under_management").cast("double")
    growth = (
        (65 - F.col("age")) / 40 * 0.3
        + F.ln(income) / F.ln(F.lit(200000.0)) * 0.4
        + F.ln(at_least(assets, 1.0)) / F.ln(F.lit(1000000.0)) * 0.3
    )
    return clients.select(
        "client_id", "age", "annual_income",
        balance.alias("current_401k_balance"),
        "years_to_retirement",
        assets.alias("total_assets_under_management"),
        "client_tenure_months", "service_tier", "risk_tolerance", "investment_experience",
        F.round(income / at_least(F.col("age"), 25), 2).alias("income_to_age_ratio"),
        F.round(assets / at_least(income, 1), 4).alias("assets_to_income_ratio"),
        clamp(balance / at_least(income.cast("bigint") * 10, 1), 0.0, 1.0).alias("retirement_readiness_score"),
        at_most(growth, 1.0).alias("wealth_growth_potential"),
        flag(assets > 100000).alias("premium_client_indicator"),
        code_map(F.col("service_tier"), SERVICE_TIER_CODES).alias("service_tier_numeric"),
        code_map(F.col("risk_tolerance"), RISK_TOLERANCE_CODES).alias("risk_tolerance_numeric"),
        code_map(F.col("investment_experience"), EXPERIENCE_CODES).alias("investment_experience_numeric"),
    )


def _behavioral_columns() -> dict[str, Column]:
    """Ratios over a client/activity row; NULL where the client has no events."""
    total = F.col("total_lifetime_events")
    known = lambda name: F.coalesce(F.col(name), F.lit(0))
    per_event = lambda name: F.round(known(name) / at_least(total, 1), 4)
    screens = F.col("mobile_usage") + F.col("desktop_usage")
    return {
        "total_lifetime_events": known("total_lifetime_events"),
        "engagement_span_days": known("engagement_span_days"),
        "education_engagement": known("education_engagement"),
        "advisor_meetings_total": known("advisor_meetings_total"),
        "web_preference_ratio": per_event("web_preference_count"),
        "email_preference_ratio": per_event("email_preference_count"),
        "phone_preference_ratio": per_event("phone_preference_count"),
        "inperson_preference_ratio": per_event("inperson_preference_count"),
        "mobile_adoption_score": F.round(known("mobile_usage") / at_least(screens, 1), 4),
        "lifetime_engagement_frequency": F.round(
            known("total_lifetime_events") / at_least(F.col("engagement_span_days"), 1), 4),
        "avg_touchpoint_value": F.round(F.coalesce("avg_touchpoint_value", F.lit(0.0)), 4),
    }


def _rounded_scores() -> dict[str, Column]:
    return {
        name: F.round(name, 4) for name in ("retirement_readiness_score", "wealth_growth_potential")
    }


def financial_behavioral_features(clients: DataFrame, events: DataFrame,
                                  as_of: datetime | None = None) -> DataFrame:
    """Financial profile joined with lifetime behaviour, one row per client."""
    as_of = resolve_as_of(events, "event_timestamp", as_of)
    behaviors = client_activity(events, as_of).select(*BEHAVIOR_COLUMNS)
    joined = financial_profile(clients).join(behaviors, "client_id", "left")
    return joined.withColumns({
        "feature_timestamp": at(as_of), **_rounded_scores(), **_behavioral_columns(),
    }).select("client_id", "feature_timestamp", *FINANCIAL_COLUMNS, *BEHAVIORAL_COLUMNS)


# --------------------------------------------------------------------------
# Lifecycle, targets
# --------------------------------------------------------------------------

def lifecycle_stage(days_inactive: Column, tenure_months: Column) -> Column:
    return first_match([
        (days_inactive.isNull() | (days_inactive > 180), "Dormant"),
        (days_inactive > 90, "At_Risk"),
        (tenure_months < 6, "New"),
        (tenure_months < 18, "Growing"),
    ], "Active")


def age_segment(age: Column) -> Column:
    return first_match([
        (age < 35, "Young"), (age < 50, "Mid-Career"), (age < 60, "Pre-Retirement"),
    ], "Near-Retirement")


def tenure_segment(tenure_months: Column) -> Column:
    return first_match([
        (tenure_months < 6, "New"), (tenure_months < 18, "Growing"), (tenure_months < 36, "Established"),
    ], "Mature")


def _segment_columns() -> dict[str, Column]:
    return {
        "lifecycle_stage": lifecycle_stage(F.col("days_since_last_activity"), F.col("client_tenure_months")),
        "age_segment": age_segment(F.col("age")),
        "tenure_segment": tenure_segment(F.col("client_tenure_months")),
    }


def lifecycle_segments(clients: DataFrame, engagement: DataFrame) -> DataFrame:
    """Lifecycle stage, age and tenure segments of every client."""
    seen = engagement.select("client_id", "days_since_last_activity", "engagement_score_30d")
    return clients.join(seen, "client_id", "left").select(
        "client_id", "client_tenure_months", "age", "service_tier", "annual_income",
        F.col("total_assets_under_management").cast("double").alias("total_assets_under_management"),
        "days_since_last_activity", "engagement_score_30d",
    ).withColumns(_segment_columns())


def _by_tier(elite: float, premium: float, other: float) -> Column:
    tier = F.col("service_tier")
    return first_match([(tier == "Elite", elite), (tier == "Premium", premium)], other)


def _when_above(name: str, bound: float, above: float, otherwise: float) -> Column:
    return F.when(F.col(name) > bound, above).otherwise(otherwise)


def _with_targets(df: DataFrame) -> DataFrame:
    """Probabilities, labels, next action and priority.

    The random terms are uniform draws hashed from the client id.  Labels,
    action and priority read the unrounded probabilities.
    """
    client = F.col("client_id")
    score = F.coalesce("engagement_score_30d", F.lit(0.0))
    conversion = clamp(
        _by_tier(0.3, 0.2, 0.1)
        + _when_above("annual_income", 75000, 0.2, 0.1)
        + _when_above("total_assets_under_management", 50000, 0.2, 0.1)
        + score * 0.3
        + hash_uniform(client, "conversion_noise") * 0.1,
        0.05, 0.95,
    )
    churn = clamp(
        0.4 - _by_tier(0.2, 0.15, 0.05) - score * 0.2
        + _when_above("days_since_last_activity", 60, 0.3, 0.0)
        + (hash_uniform(client, "churn_noise") * 0.2 - 0.1),
        0.05, 0.8,
    )
    drawn = df.withColumns({"_conv": conversion, "_churn": churn})
    p = F.col("_conv")
    action = first_match([
        ((F.col("service_tier") == "Basic") & (p > 0.3), "Upgrade_Service_Tier"),
        ((F.col("total_assets_under_management") < 25000) & (p > 0.25), "Schedule_Planning_Session"),
        ((F.col("age_segment") == "Near-Retirement") & (p > 0.2), "Retirement_Planning_Review"),
        (p > 0.4, "Wealth_Advisory_Consultation"),
        (p < 0.1, "Educational_Content"),
    ], "Relationship_Building")
    return drawn.withColumns({
        "conversion_probability": F.round("_conv", 4),
        "churn_probability": F.round("_churn", 4),
        "conversion_target": bernoulli(client, "conversion_label", p),
        "churn_target": bernoulli(client, "churn_label", F.col("_churn")),
        "next_best_action": action,
        "business_priority_score": F.round(
            p * 0.4 + (1 - F.col("_churn")) * 0.3 + _by_tier(0.3, 0.2, 0.1), 4),
    }).drop("_conv", "_churn")


def propensity_targets(segments: DataFrame, as_of: datetime) -> DataFrame:
    """Propensities, binary labels, next best action and priority per client."""
    return _with_targets(segments).withColumn("feature_timestamp", at(as_of)).select(
        "client_id", "feature_timestamp", "lifecycle_stage", "age_segment", "tenure_segment",
        "days_since_last_activity", *TARGET_COLUMNS[3:],
    )


# --------------------------------------------------------------------------
# The store
# --------------------------------------------------------------------------

def feature_store(events: DataFrame, clients: DataFrame, as_of: datetime | None = None,
                  include_inactive: bool = False) -> DataFrame:
    """The unified feature table: one event aggregate, one join with clients.

    Rows start from clients with events, as in the three-table form
    (:func:`unify_features`), without building and re-joining three tables.
    ``include_inactive`` starts from the clients instead; clients without
    events then have NULL engagement columns and stage ``Dormant``.
    """
    as_of = resolve_as_of(events, "event_timestamp", as_of)
    activity = client_activity(events, as_of).filter(F.col("client_id").isNotNull())
    engaged = activity.withColumns(_engagement_columns(as_of)).withColumnRenamed(
        "avg_touchpoint_value", "avg_touchpoint_value_lifetime")
    profile = financial_profile(clients).withColumn("_known", F.lit(True))
    joined = (
        profile.join(engaged, "client_id", "left") if include_inactive
        else engaged.join(profile, "client_id", "left")
    ).withColumnRenamed("avg_touchpoint_value_lifetime", "avg_touchpoint_value")

    full = _with_targets(joined.withColumns(_segment_columns())).withColumns({
        **_rounded_scores(), **_behavioral_columns(), "feature_timestamp": at(as_of),
    })
    # An event client missing from the client table has no client-side columns.
    guarded = set(BEHAVIORAL_COLUMNS + TARGET_COLUMNS)
    return full.selectExpr(*[f"if(_known, {c}, NULL) AS {c}" if c in guarded else c for c in STORE_COLUMNS])


def unify_features(engagement: DataFrame, financial_behavioral: DataFrame, targets: DataFrame) -> DataFrame:
    """The store from three already written feature tables (two left joins)."""
    return (
        engagement.filter(F.col("client_id").isNotNull()).select(*STORE_ENGAGEMENT_COLUMNS)
        .join(financial_behavioral.select("client_id", *FINANCIAL_COLUMNS, *BEHAVIORAL_COLUMNS),
              "client_id", "left")
        .join(targets.select("client_id", *TARGET_COLUMNS), "client_id", "left")
        .select(*STORE_COLUMNS)
    )
