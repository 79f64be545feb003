"""Operational views: deployment status, latency, client 360, app figures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import days_back, exact_avg, percent, same_day
from tidemark.operators import exact_quantile, latest_row, latest_rows, one_row

# Names of the deployment kinds.
BATCH_ROW = ("Batch Inference", "Daily at 6 AM", "Low", "Primary approach for financial ML")
ONLINE_ROW = ("Real-time Inference", "On-demand", "High", "Use only when millisecond response required")


def deployment_status(preds: DataFrame, as_of: datetime, services: DataFrame | None = None) -> DataFrame:
    """Two status rows; the online one is active if a service name says so."""
    spark = preds.sparkSession
    today = preds.filter(same_day(F.col("prediction_timestamp"), as_of)).agg(F.count("*")).scalar()
    running = F.lit(0)
    if services is not None:
        running = services.filter(F.col("service_name").contains("realtime")).agg(F.count("*")).scalar()

    def row(texts, status, daily):
        kind, schedule, cost, description = (F.lit(t) for t in texts)
        return one_row(spark, deployment_type=kind, status=status, daily_predictions=daily,
                       schedule=schedule, cost=cost, description=description)

    online = F.when(running > 0, "ACTIVE").otherwise("INACTIVE")
    return row(BATCH_ROW, F.lit("ACTIVE"), today).unionByName(
        row(ONLINE_ROW, online, F.lit(0).cast("bigint")))


def recent_prediction_count(preds: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    return preds.filter(F.col("prediction_timestamp") >= days_back(as_of, hours=hours)).agg(
        F.count("*").alias("count"))


def latency_by_day(log: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Requests, mean and 95th percentile latency, source mix per day."""
    recent = log.filter(F.col("timestamp") >= days_back(as_of, days=days)).select(
        F.to_date("timestamp").alias("date"), "response_time_ms", "source")
    served = F.count_if(F.col("source") == "container_service")
    totals = recent.groupBy("date").agg(
        F.count("*").alias("total_requests"),
        F.round(exact_avg(F.col("response_time_ms")), 2).alias("avg_response_time_ms"),
        served.alias("service_requests"),
        F.count_if(F.col("source") == "fallback").alias("fallback_requests"),
        percent(served, F.count("*")).alias("service_success_rate_pct"),
    )
    p95 = exact_quantile(recent, "response_time_ms", 0.95, ["date"], "p95_response_time_ms")
    return totals.join(p95, "date", "left").select(
        "date", "total_requests", "avg_response_time_ms",
        F.round("p95_response_time_ms", 2).alias("p95_response_time_ms"),
        "service_requests", "fallback_requests", "service_success_rate_pct",
    ).orderBy(F.col("date").desc())


def client_360(clients: DataFrame, advisors: DataFrame, store: DataFrame, preds: DataFrame,
               events: DataFrame, as_of: datetime) -> DataFrame:
    """Every client with advisor, newest features and prediction, 30-day events.

    Grouping the joined rows by all columns merges equal rows and adds up
    their event counts.  The same result comes from counting copies on the
    small sides and events per client first, so the events never fan out.
    """
    def copies(df, *keys):
        return df.groupBy(*keys).agg(F.count("*").alias("_copies"))

    advisor = copies(advisors.select(
        F.col("advisor_id").alias("assigned_advisor_id"), "advisor_name",
        F.col("specialization").alias("advisor_specialization"),
    ), "assigned_advisor_id", "advisor_name", "advisor_specialization").withColumnRenamed("_copies", "_a")
    scores = copies(latest_rows(store, "client_id", "feature_timestamp").select(
        "client_id", F.col("engagement_score_30d").alias("engagement_score"),
        F.col("churn_probability").alias("churn_risk_score"),
        F.col("conversion_probability").alias("conversion_propensity_score"),
    ), "client_id", "engagement_score", "churn_risk_score", "conversion_propensity_score",
    ).withColumnRenamed("_copies", "_s")
    newest = copies(
        latest_rows(preds, "client_id", "prediction_timestamp"),
        "client_id", "recommended_action", "conversion_probability").withColumnRenamed("_copies", "_p")
    recent = events.filter(F.col("event_timestamp") >= days_back(as_of, days=30)).groupBy("client_id").agg(
        F.count("event_id").alias("_events"))

    joined = clients.join(recent, "client_id", "left").join(scores, "client_id", "left").join(
        newest, "client_id", "left").join(advisor, "assigned_advisor_id", "left")
    times = lambda c: F.coalesce(F.col(c), F.lit(1))
    total = F.coalesce("_events", F.lit(0)) * times("_a") * times("_s") * times("_p")
    return joined.select(
        *[F.col(c) for c in clients.columns], "advisor_name", "advisor_specialization",
        "engagement_score", "churn_risk_score", "conversion_propensity_score",
        "recommended_action", "conversion_probability", total.alias("total_events_30d"),
    )


# --------------------------------------------------------------------------
# App figures
# --------------------------------------------------------------------------

def table_counts(**tables: DataFrame) -> DataFrame:
    """Row counts of several tables in one row."""
    spark = next(iter(tables.values())).sparkSession
    return one_row(spark, **{name: df.agg(F.count("*")).scalar() for name, df in tables.items()})


def latest_accuracy(performance: DataFrame) -> DataFrame:
    rows = performance.filter(F.col("metric_name") == "ACCURACY")
    return latest_row(rows, "evaluation_timestamp", "model_version").select(
        F.col("metric_value").alias("accuracy"))


def open_severe_alerts(alerts: DataFrame) -> DataFrame:
    severe = F.lower("severity").isin("critical", "high")
    return alerts.filter((F.col("status") == "open") & severe).agg(F.count("*").alias("count"))


def latest_drift(drift: DataFrame) -> DataFrame:
    return latest_row(drift, "check_timestamp", "feature_name").select("drift_score")


def performance_series(metrics: DataFrame) -> DataFrame:
    return metrics.select("evaluation_timestamp", "accuracy", "f1_score").orderBy("evaluation_timestamp")


def store_statistics(store: DataFrame) -> DataFrame:
    return store.agg(
        F.count("*").alias("total_features"), F.count_distinct("client_id").alias("unique_clients"),
        F.max("feature_timestamp").alias("last_updated"))


def high_likelihood_count(preds: DataFrame) -> DataFrame:
    return preds.filter(F.col("conversion_likelihood") == "High").agg(F.count("*").alias("count"))


def likelihood_distribution(preds: DataFrame) -> DataFrame:
    return preds.groupBy("conversion_likelihood").agg(
        F.count("*").alias("client_count"),
        F.round(exact_avg(F.col("conversion_probability")), 3).alias("avg_probability"))


def predictions_today(preds: DataFrame, as_of: datetime) -> DataFrame:
    return preds.filter(same_day(F.col("prediction_timestamp"), as_of)).select(
        "client_id", "conversion_probability", "recommended_action",
    ).orderBy(F.col("conversion_probability").desc(), "client_id")


def high_value_prospects(preds: DataFrame, floor: float = 0.7) -> DataFrame:
    return preds.filter(F.col("conversion_probability") > floor)


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("status") == "open")
