"""Scorers as column expressions, and the tables built from them."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import at, at_most, clamp, first_match, squash
from tidemark.operators import not_in
from tidemark.schemas import conform
from tidemark.sources.batch_log import BatchLog
from tidemark.sources.writers import replace_days

# Model inputs, in the order the scorers index them.
NUMERIC_FEATURES = (
    "total_events_30d", "web_visits_30d", "email_opens_30d", "email_clicks_30d",
    "engagement_frequency_30d", "engagement_score_30d", "days_since_last_activity",
    "age", "annual_income", "current_401k_balance", "years_to_retirement",
    "total_assets_under_management", "client_tenure_months", "income_to_age_ratio",
    "assets_to_income_ratio", "retirement_readiness_score", "wealth_growth_potential",
    "service_tier_numeric", "risk_tolerance_numeric", "total_lifetime_events",
    "education_engagement", "advisor_meetings_total", "web_preference_ratio",
    "email_preference_ratio", "mobile_adoption_score", "lifetime_engagement_frequency",
    "business_priority_score",
)
CATEGORICAL_FEATURES = ("lifecycle_stage", "age_segment", "tenure_segment")

# Ordinal codes count from 1 in list order; anything else is 0.
EMITTED_LABELS: Mapping[str, Sequence[str]] = {
    "lifecycle_stage": ("New", "Growing", "Active", "At_Risk", "Dormant"),
    "age_segment": ("Young", "Mid-Career", "Pre-Retirement", "Near-Retirement"),
    "tenure_segment": ("New", "Growing", "Established", "Mature"),
}
# The label lists the original encoding names, of which the
# feature tables emit only some.
DECLARED_LABELS: Mapping[str, Sequence[str]] = {
    "lifecycle_stage": ("New", "Onboarding", "Active", "Engaged", "At Risk", "Dormant"),
    "age_segment": ("Young Professional", "Early Career", "Peak Earning", "Pre-Retirement", "Retirement"),
    "tenure_segment": ("New", "Developing", "Established", "Long-term"),
}

MODEL_NAME = "CONVERSION_PREDICTOR"


# --------------------------------------------------------------------------
# Model input
# --------------------------------------------------------------------------

def ordinal(column: str, labels: Sequence[str]) -> Column:
    """Place of the label, 0 for others; ``At_Risk`` and ``At Risk`` are one."""
    spaced = F.replace(F.col(column), F.lit("_"), F.lit(" "))
    return first_match([(spaced == label.replace("_", " "), i) for i, label in enumerate(labels, 1)], 0)


def feature_array(labels: Mapping[str, Sequence[str]] = EMITTED_LABELS) -> Column:
    """The 30 model inputs as ``array<double>``: 27 numeric, 3 ordinal codes."""
    return F.array(
        *[F.col(c).cast("double") for c in NUMERIC_FEATURES],
        *[ordinal(c, labels[c]).cast("double") for c in CATEGORICAL_FEATURES],
    )


def feature_struct(labels: Mapping[str, Sequence[str]] = EMITTED_LABELS) -> Column:
    return F.struct(
        *[F.col(c).cast("double").alias(c) for c in NUMERIC_FEATURES],
        *[ordinal(c, labels[c]).alias(f"{c}_encoded") for c in CATEGORICAL_FEATURES],
    )


def model_input(store: DataFrame, labels: Mapping[str, Sequence[str]] = EMITTED_LABELS) -> DataFrame:
    """Scoring frame: context columns, label, and the inputs keyed by name."""
    return store.select(
        "client_id", "lifecycle_stage", "age_segment", "business_priority_score",
        "conversion_target", feature_struct(labels).alias("features"),
    )


# --------------------------------------------------------------------------
# Scorers
# --------------------------------------------------------------------------

def income_points(income: Column, steps: Sequence[tuple[int, int]]) -> Column:
    return first_match([(income > bound, points) for bound, points in steps], 0)


def logistic_score(features: Column) -> Column:
    """Logistic curve on the mean of the first seven inputs; 0.5 when unusable."""
    head = F.slice(features, 1, 7)
    usable = (F.size(head) > 0) & ~F.exists(head, lambda x: x.isNull())
    total = F.aggregate(head, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(usable, squash(total / F.nullif(F.size(head), F.lit(0)), 0.1, 10.0)).otherwise(0.5)


def points_score(features: Column) -> Column:
    """Points for activity, engagement, income and priority, scaled to 0..1.

    Needs exactly 30 inputs, else 0.5.  A missing or zero age, income or
    priority counts as 35, 50 000 and 50; activity and engagement as 0.
    """
    def pick(index: int, default: float) -> Column:
        value = F.get(features, F.lit(index))
        return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)

    activity = pick(0, 0.0)
    points = (
        first_match([(activity > 20, 30), (activity > 10, 20), (activity > 5, 10)], 0)
        + at_most(pick(5, 0.0) / 4, 25.0)
        + income_points(pick(8, 50000.0), [(150000, 25), (100000, 20), (75000, 15), (50000, 10)])
        + pick(26, 50.0) * 0.2
    )
    return F.when(F.size(features) == 30, clamp(points / 100.0, 0.0, 1.0)).otherwise(0.5)


def likelihood_band(probability: Column) -> Column:
    return first_match([(probability > 0.7, "High"), (probability > 0.4, "Medium")], "Low")


def batch_rule(engagement: Column, income: Column, balance: Column, age: Column,
               tier: Column, days_inactive: Column) -> Column:
    """Daily scoring rule → struct(conversion_probability, confidence, next_action)."""
    wealthy = (engagement > 0.6) & (income > 100000)
    probability = first_match([
        (wealthy, 0.85),
        ((engagement > 0.4) & (balance > 75000), 0.70),
        ((tier >= 2) & (days_inactive < 30), 0.55),
        ((income > 75000) & age.between(35, 55), 0.40),
    ], 0.25)
    confidence = first_match([(engagement > 0.5, 0.90), (engagement > 0.3, 0.75)], 0.60)
    action = first_match([
        (wealthy, "Schedule_Wealth_Consultation"),
        (tier == 1, "Upgrade_Service_Tier"),
        (days_inactive > 60, "Re_engagement_Campaign"),
    ], "Educational_Content")
    return F.struct(
        probability.alias("conversion_probability"), confidence.alias("confidence"),
        action.alias("next_action"),
    )


def fallback_simple(engagement: Column, income: Column) -> Column:
    """Two-level stand-in for the online scorer; a missing input counts as 0."""
    likely = (F.coalesce(engagement, F.lit(0)) > 0.5) & (F.coalesce(income, F.lit(0)) > 75000)
    return F.struct(
        F.when(likely, 0.7).otherwise(0.3).alias("conversion_probability"), F.lit(0.8).alias("confidence"),
        F.when(likely, "Schedule_Consultation").otherwise("Educational_Content").alias("next_action"),
        F.lit(50.0).alias("response_time_ms"),
    )


def fallback_tiered(engagement: Column, income: Column, balance: Column) -> Column:
    """Three-level stand-in used when the online scorer does not answer."""
    high = (engagement > 0.6) & (income > 100000)
    middle = (engagement > 0.3) & (balance > 50000)
    return F.struct(
        first_match([(high, 0.75), (middle, 0.55)], 0.30).alias("conversion_probability"),
        F.lit(0.7).alias("confidence"),
        first_match([(high, "Schedule_Wealth_Consultation"), (middle, "Schedule_Planning_Session")],
                    "Educational_Content").alias("next_action"),
        F.lit("fallback").alias("source"),
    )


# --------------------------------------------------------------------------
# Score tables
# --------------------------------------------------------------------------

def rule_scores(store: DataFrame) -> DataFrame:
    """Additive rule score, its probability and likelihood band per client."""
    raw = (
        at_most(F.col("total_events_30d") * 2, 40)
        + at_most(F.col("engagement_score_30d") / 4, 25.0)
        + income_points(F.col("annual_income"), [(150000, 20), (100000, 15), (75000, 10), (50000, 5)])
        + F.col("business_priority_score") * 0.15
    )
    return store.select(
        "client_id", "lifecycle_stage", "age_segment", "tenure_segment", "total_events_30d",
        "engagement_score_30d", "business_priority_score", "annual_income", "years_to_retirement",
        raw.alias("raw_score"), F.col("conversion_target").alias("actual_conversion"),
    ).withColumn("conversion_probability", clamp(F.col("raw_score") / 100, 0.0, 1.0)).withColumn(
        "conversion_likelihood", likelihood_band(F.col("conversion_probability"))
    )


def predictions(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The prediction table every downstream report reads.

    ``prediction`` is 0/1, ``probability`` the score behind it.
    """
    p = F.col("conversion_probability")
    return scores.select(
        "client_id", "lifecycle_stage", "age_segment", "business_priority_score",
        F.when(p > threshold, 1.0).when(p.isNotNull(), 0.0).alias("prediction"),
        p.alias("probability"), "actual_conversion",
    )


def array_scores(store: DataFrame, scorer=points_score,
                 labels: Mapping[str, Sequence[str]] = EMITTED_LABELS) -> DataFrame:
    """Score view over the 30-input array with the given scorer."""
    return store.select(
        "client_id", "lifecycle_stage", "age_segment", "business_priority_score",
        scorer(feature_array(labels)).alias("conversion_probability"),
        F.col("conversion_target").alias("actual_conversion"),
    ).withColumn("conversion_likelihood", likelihood_band(F.col("conversion_probability")))


def _scored(store: DataFrame) -> DataFrame:
    score = batch_rule(*[F.col(c) for c in (
        "engagement_score_30d", "annual_income", "current_401k_balance", "age",
        "service_tier_numeric", "days_since_last_activity")])
    return store.withColumn("_score", score)


def _prediction_rows(scored: DataFrame, as_of: datetime, model: str, version: str, source: str) -> DataFrame:
    probability = F.col("_score.conversion_probability")
    rows = scored.select(
        "client_id", at(as_of).alias("prediction_timestamp"), F.lit(model).alias("model_name"),
        F.lit(version).alias("model_version"), probability.alias("conversion_probability"),
        F.col("_score.next_action").alias("recommended_action"),
        F.col("_score.confidence").alias("prediction_confidence"),
        "lifecycle_stage", "business_priority_score", F.lit(source).alias("inference_source"),
        likelihood_band(probability).alias("conversion_likelihood"),
    )
    return conform(rows, "model_predictions", at(as_of))


def daily_scores(store: DataFrame, as_of: datetime, model: str = MODEL_NAME) -> DataFrame:
    """Today's batch predictions for every client that is not dormant.

    A NULL stage compares as unknown and is left out.
    """
    active = store.filter(F.col("lifecycle_stage") != "Dormant")
    return _prediction_rows(_scored(active), as_of, model, "1.0", "batch")


def run_daily_scoring(store: DataFrame, table: str, as_of: datetime, model: str = MODEL_NAME,
                      location: str | None = None) -> int:
    """Score and replace the day's partition; safe to repeat.  Returns rows scored."""
    day = as_of.date()
    scored = daily_scores(store, as_of, model).withColumn("prediction_date", F.lit(day))
    replace_days(scored, table, "prediction_date", location, [day])
    return scored.sparkSession.table(table).filter(F.col("prediction_date") == F.lit(day)).count()


def score_unscored(store: DataFrame, scored_already: DataFrame, as_of: datetime, limit: int = 100,
                   model: str = MODEL_NAME) -> DataFrame:
    """Predictions for up to ``limit`` clients that have none (smallest ids first)."""
    fresh = not_in(store, scored_already, "client_id").orderBy("client_id").limit(limit)
    return _prediction_rows(_scored(fresh), as_of, model, "1.0", "Batch_Process")


def online_scores(store: DataFrame, as_of: datetime | None, model: str = MODEL_NAME) -> DataFrame:
    """Rows of the inference log for a batch answered by the tiered fallback."""
    answer = fallback_tiered(*[F.col(c) for c in (
        "engagement_score_30d", "annual_income", "current_401k_balance")])
    packed = F.struct(
        F.col("_a.conversion_probability"), F.col("_a.confidence"), F.col("_a.next_action"),
        F.lit(0.0).alias("response_time_ms"), F.col("_a.source"), F.lit(None).cast("string").alias("error"),
    )
    own_id = ["inference_id"] if "inference_id" in store.columns else []
    rows = store.withColumn("_a", answer).select(
        *own_id, "client_id", F.lit(model).alias("model_name"), packed.alias("prediction_result"),
    ).withColumns({
        "response_time_ms": F.col("prediction_result.response_time_ms"),
        "source": F.col("prediction_result.source"),
    })
    return conform(rows, "realtime_inference_log", None if as_of is None else at(as_of))


def score_and_log(store: DataFrame, log_path: str, as_of: datetime | None = None, model: str = MODEL_NAME,
                  batch_id: int | str | None = None) -> DataFrame:
    """Predict, log one row per request, and return the logged answers.

    ``batch_id`` names the requests: sent again under the same name, they are neither scored nor logged anew, and the
    answer is what the log has.  Without one each call is a batch of its own.  Requests that carry an
    ``inference_id`` keep it.
    """
    log = BatchLog(store.sparkSession, log_path)
    name = uuid.uuid4().hex if batch_id is None else batch_id
    log.append(online_scores(store, as_of, model), name)
    return log.read(name).select("client_id", "prediction_result")


def score_stream(requests: DataFrame, store: DataFrame, log_path: str, checkpoint: str, as_of: datetime | None = None,
                 model: str = MODEL_NAME, once: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Answer a stream of requests (client_id, and an inference_id where they have one) into the log.

    A replayed micro-batch has the id it had before, so its requests are logged once.
    """
    columns = ["client_id", *[c for c in requests.columns if c == "inference_id"]]

    def answer(batch: DataFrame, batch_id: int) -> None:
        score_and_log(batch.select(*columns).join(store, "client_id"), log_path, as_of, model, batch_id)

    writer = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(answer)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def inference_log(spark: SparkSession, log_path: str) -> DataFrame:
    """All logged answers, each request once."""
    return BatchLog(spark, log_path).read().drop("batch_id")


# --------------------------------------------------------------------------
# Lookups by request table
# --------------------------------------------------------------------------

def _requested(requests: DataFrame, preds: DataFrame, store: DataFrame) -> DataFrame:
    context = store.select(
        "client_id", "days_since_last_activity", "total_assets_under_management",
        "retirement_readiness_score", "years_to_retirement",
    )
    wanted = requests.select("client_id").distinct()
    return preds.join(wanted, "client_id", "left_semi").join(context, "client_id")


def _convert_text() -> Column:
    return F.when(F.col("prediction") == 1, "Will Convert").otherwise("Will Not Convert")


def _primary_action(high: float) -> Column:
    converts = F.col("prediction") == 1
    return first_match([
        (converts & (F.col("business_priority_score") >= high), "Schedule immediate advisor meeting"),
        (converts, "Include in conversion campaign"),
        (F.col("days_since_last_activity") > 30, "Re-engagement required"),
    ], "Standard communication")


def _inactivity_risk() -> Column:
    days = F.col("days_since_last_activity")
    return first_match([(days > 60, "High"), (days > 30, "Medium")], "Low")


def client_intelligence(requests: DataFrame, preds: DataFrame, store: DataFrame, as_of: datetime,
                        high: float = 0.8) -> DataFrame:
    """One record (struct) per requested client, for a whole request table."""
    record = F.struct(
        F.col("client_id"),
        F.col("prediction"),
        _convert_text().alias("prediction_text"),
        F.round("business_priority_score", 1).alias("priority_score"),
        F.col("lifecycle_stage"),
        F.col("age_segment"),
        F.col("days_since_last_activity").alias("days_inactive"),
        F.round("total_assets_under_management", 0).alias("total_assets"),
        # The score has four digits, so its percentage has two.
        F.round(F.round(F.col("retirement_readiness_score") * 100, 2), 1).alias("retirement_readiness"),
        F.col("years_to_retirement"),
        _primary_action(high).alias("primary_action"),
        _inactivity_risk().alias("churn_risk"),
        at(as_of).alias("timestamp"),
    )
    return _requested(requests, preds, store).select("client_id", record.alias("intelligence"))


def client_score_table(requests: DataFrame, preds: DataFrame, store: DataFrame,
                       high: float = 0.8, medium: float = 0.6) -> DataFrame:
    """Tabular form of the lookup: prediction text, priority tier, action, risk."""
    priority = F.col("business_priority_score")
    return _requested(requests, preds, store).select(
        "client_id",
        _convert_text().alias("prediction"),
        priority.alias("priority_score"),
        first_match([(priority >= high, "High Priority"), (priority >= medium, "Medium Priority")],
                    "Low Priority").alias("priority_tier"),
        _primary_action(high).alias("recommended_action"),
        _inactivity_risk().alias("churn_risk"),
        F.round("total_assets_under_management", 0).alias("total_assets"),
    )
