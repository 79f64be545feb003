"""Model observability: snapshots, performance, drift, dashboards, alerts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import at, days_back, exact_avg, first_match, floor_day, floor_hour, ratio
from tidemark.operators import (
    attach_row, feature_moments, first_rows, hash_sample, latest_row, one_row, top_rows,
)
from tidemark.plans.scoring import MODEL_NAME
from tidemark.schemas import conform

VERSION = "V1"
MONITORED_FEATURES = (
    "total_events_30d", "engagement_score_30d", "days_since_last_activity", "annual_income",
    "current_401k_balance", "total_assets_under_management",
)
WINDOW_DRIFT_FEATURES = ("total_events_30d", "engagement_score_30d", "annual_income")
SAMPLE_DRIFT_FEATURES = ("engagement_score_30d", "total_events_30d", "days_since_last_activity")


def _hit() -> Column:
    return F.col("prediction") == F.col("actual_conversion")


def _share(condition: Column, of: Column | None = None) -> Column:
    """Mean of a 0/1 condition; with ``of``, over the rows where it holds."""
    value = F.when(condition, 1).otherwise(0)
    return F.avg(value if of is None else F.when(of, value))


# --------------------------------------------------------------------------
# Scheduled snapshots
# --------------------------------------------------------------------------

def prediction_snapshot(preds: DataFrame, as_of: datetime) -> DataFrame:
    """One monitoring row: volume, range, 3-bin distribution, actual rate."""
    p = F.col("probability")
    row = preds.agg(
        F.count("*").alias("total_predictions"),
        exact_avg(p).alias("avg_prediction_value"),
        F.min(p).alias("min_prediction_value"),
        F.max(p).alias("max_prediction_value"),
        F.struct(
            F.count_if(p > 0.7).alias("high_prob"),
            F.count_if(p.between(0.4, 0.7)).alias("medium_prob"),
            F.count_if(p < 0.4).alias("low_prob"),
        ).alias("prediction_distribution"),
        F.struct(
            F.sum("actual_conversion").alias("actual_conversions"),
            F.avg("actual_conversion").alias("conversion_rate"),
        ).alias("performance_metrics"),
    ).withColumns({
        "prediction_timestamp": at(as_of), "model_name": F.lit(MODEL_NAME), "model_version": F.lit(VERSION),
    })
    return conform(row, "prediction_monitoring", at(as_of))


def baseline_drift_check(store: DataFrame, as_of: datetime, feature: str = "total_events_30d",
                         baseline: float = 50.0, tolerance: float = 0.3) -> DataFrame:
    """Relative distance of a feature mean from a fixed baseline."""
    drift = F.abs(F.col("current_mean") - baseline) / baseline
    row = store.agg(F.avg(feature).alias("current_mean")).withColumns({
        "check_timestamp": at(as_of), "feature_name": F.lit(feature), "baseline_mean": F.lit(baseline),
        "drift_score": drift, "alert_triggered": F.coalesce(drift > tolerance, F.lit(False)),
    })
    return conform(row, "data_drift_monitoring", at(as_of))


def accuracy_row(preds: DataFrame, as_of: datetime) -> DataFrame:
    """The accuracy log row an INSERT of driver scalars would write."""
    row = preds.agg(ratio(F.count_if(_hit()), F.count("*")).alias("metric_value")).withColumns({
        "evaluation_timestamp": at(as_of), "model_name": F.lit(MODEL_NAME),
        "model_version": F.lit(VERSION), "metric_name": F.lit("ACCURACY"),
        "evaluation_set": F.lit("PRODUCTION"),
    })
    return conform(row, "model_performance_tracking", at(as_of))


# --------------------------------------------------------------------------
# Deployment dashboards
# --------------------------------------------------------------------------

def deployment_dashboard(deployments: DataFrame, snapshots: DataFrame, drift: DataFrame,
                         as_of: datetime) -> DataFrame:
    """Active deployments with the latest snapshot and the last day's alerts.

    Without a snapshot there is no row; without drift rows the count is 0.
    """
    active = deployments.filter(F.col("status") == "ACTIVE").select(
        "model_name", "model_version", "deployment_timestamp")
    snapshot = latest_row(snapshots, "prediction_timestamp", "monitoring_id").select(
        F.col("total_predictions").alias("predictions_last_batch"),
        F.col("avg_prediction_value").alias("avg_prediction_score"))
    recent = drift.filter(F.col("check_timestamp") > days_back(as_of, days=1))
    # The join on a true condition repeats each deployment per drift row, and
    # equal deployment rows fall into one group; both only scale the count.
    alerts = recent.agg(F.count_if("alert_triggered").alias("alerts"))
    keyed = active.groupBy(*active.columns).agg(F.count("*").alias("_copies"))
    joined = attach_row(attach_row(keyed, snapshot), alerts)
    return joined.select(
        "model_name", "model_version", "deployment_timestamp", "predictions_last_batch",
        "avg_prediction_score", (F.col("alerts") * F.col("_copies")).alias("drift_alerts"),
        at(as_of).alias("dashboard_updated"),
    )


def deployment_summary(deployments: DataFrame, preds: DataFrame) -> DataFrame:
    """Clients scored and mean score, repeated for each active deployment."""
    keys = ["model_name", "model_version", "status", "deployment_timestamp"]
    active = deployments.filter(F.col("status") == "ACTIVE").select(*keys).distinct()
    totals = preds.agg(
        F.count_distinct("client_id").alias("clients_scored"), exact_avg(F.col("probability")).alias("avg_score"))
    return attach_row(active, totals)


def check_model_performance(preds: DataFrame, baseline: float = 0.50, tolerance: float = 0.1) -> DataFrame:
    """Accuracy, relative drop below the baseline, and the verdict text."""
    accuracy = F.col("current_accuracy")
    drop = (F.lit(baseline) - accuracy) / baseline
    tenths = lambda x: F.round(x * 100, 1).cast("string")
    verdict = F.when(
        F.col("performance_drop") > tolerance,
        F.concat(F.lit("RETRAINING RECOMMENDED: Performance dropped by "), tenths(F.col("performance_drop")), F.lit("%")),
    ).otherwise(
        F.concat(F.lit("Model performing well. Current accuracy: "), tenths(accuracy), F.lit("%")))
    return (
        preds.agg(ratio(F.count_if(_hit()), F.count("*")).alias("current_accuracy"))
        .withColumn("performance_drop", drop).withColumn("result", verdict)
    )


def system_validation(preds: DataFrame, segments: DataFrame, deployments: DataFrame,
                      performance: DataFrame) -> DataFrame:
    """Row counts of four tables as scalar subqueries of one row."""
    size = lambda df: df.agg(F.count("*")).scalar()
    return one_row(
        preds.sparkSession,
        total_predictions=size(preds),
        segmented_clients=size(segments),
        active_models=size(deployments.filter(F.col("status") == "ACTIVE")),
        performance_records=size(performance),
    )


# --------------------------------------------------------------------------
# Monitored predictions and performance
# --------------------------------------------------------------------------

def monitored_predictions(preds: DataFrame, store: DataFrame, as_of: datetime) -> DataFrame:
    """Labelled predictions with the monitored feature values.

    The monitor time is the prediction's own time where it has one, else the
    clock.
    """
    moment = F.col("prediction_timestamp") if "prediction_timestamp" in preds.columns else at(as_of)
    labelled = preds.filter(F.col("actual_conversion").isNotNull()).select(
        "client_id", "probability", "actual_conversion", "prediction", moment.alias("monitor_timestamp"))
    return labelled.join(store.select("client_id", *MONITORED_FEATURES), "client_id", "left").select(
        "client_id", "probability", "actual_conversion", *MONITORED_FEATURES, "monitor_timestamp",
        floor_hour(F.col("monitor_timestamp")).alias("monitor_hour"), "prediction",
    )


def performance_by_hour(monitored: DataFrame) -> DataFrame:
    """Hourly accuracy, precision, recall, F1; NULL where undefined."""
    predicted, actual = F.col("prediction") == 1, F.col("actual_conversion") == 1
    return monitored.groupBy("monitor_hour").agg(
        F.count("*").alias("predictions_count"),
        _share(_hit()).alias("accuracy"),
        _share(actual, of=predicted).alias("precision"),
        _share(predicted, of=actual).alias("recall"),
    ).withColumn("f1_score", _f1()).orderBy(F.col("monitor_hour").desc())


def _f1() -> Column:
    precision, recall = F.col("precision"), F.col("recall")
    return 2 * (precision * recall) / F.nullif(precision + recall, F.lit(0.0))


def labelled_metrics(preds: DataFrame) -> DataFrame:
    return preds.filter(F.col("actual_conversion").isNotNull()).agg(
        F.count("*").alias("total_predictions"),
        _share(_hit()).alias("accuracy"),
        F.count_if(F.col("prediction") == 1).alias("positive_predictions"),
        F.count_if(F.col("actual_conversion") == 1).alias("actual_positives"),
    )


def _confusion() -> dict[str, Column]:
    cells = {"true_positives": (1, 1), "false_positives": (1, 0),
             "true_negatives": (0, 0), "false_negatives": (0, 1)}
    return {
        name: F.count_if((F.col("prediction") == p) & (F.col("actual_conversion") == a))
        for name, (p, a) in cells.items()
    }


def confusion_matrix(preds: DataFrame) -> DataFrame:
    short = {"true_positives": "tp", "false_positives": "fp", "true_negatives": "tn", "false_negatives": "fn"}
    return preds.filter(F.col("actual_conversion").isNotNull()).agg(
        *[cell.alias(short[name]) for name, cell in _confusion().items()])


def model_performance(preds: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and the four confusion cells in one row."""
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return preds.agg(
        F.count("*").alias("total_predictions"),
        F.count_if(F.col("prediction") == 1).alias("predicted_conversions"),
        F.count_if(F.col("actual_conversion") == 1).alias("actual_conversions"),
        ratio(F.count_if(_hit()), F.count("*")).alias("accuracy"),
        *[cell.alias(name) for name, cell in _confusion().items()],
    ).withColumns({
        "model_name": F.lit(MODEL_NAME), "model_version": F.lit(VERSION),
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
    }).withColumn("f1_score", _f1()).select(
        "model_name", "model_version", "total_predictions", "predicted_conversions",
        "actual_conversions", "accuracy", "precision", "recall", "f1_score",
        "true_positives", "false_positives", "true_negatives", "false_negatives",
    )


def data_quality_profile(store: DataFrame) -> DataFrame:
    days = F.col("days_since_last_activity")
    return store.agg(
        F.count("*").alias("total_clients"),
        F.count_distinct("client_id").alias("unique_clients"),
        F.avg(days).alias("avg_days_inactive"),
        F.count_if(F.col("total_events_30d").isNull()).alias("null_events"),
        F.count_if(F.col("annual_income").isNull()).alias("null_income"),
        F.min(days).alias("most_active_days_ago"),
        F.max(days).alias("least_active_days_ago"),
    )


# --------------------------------------------------------------------------
# Drift
# --------------------------------------------------------------------------

def _drift_score() -> Column:
    distance = F.abs(F.col("current_mean") - F.col("baseline_mean"))
    return distance / F.nullif(F.col("baseline_std"), F.lit(0.0))


def window_drift(monitored: DataFrame, n: int = 1000,
                 features: Sequence[str] = WINDOW_DRIFT_FEATURES) -> DataFrame:
    """First ``n`` against last ``n`` predictions, in baseline deviations."""
    ends = [first_rows(monitored.select("monitor_timestamp", "client_id", *features),
                       "monitor_timestamp", n, newest, "client_id") for newest in (False, True)]
    return _ends_drift(*ends, features)


def log_window_drift(preds: DataFrame, store: DataFrame, as_of: datetime, n: int = 1000,
                     features: Sequence[str] = WINDOW_DRIFT_FEATURES) -> DataFrame:
    """:func:`window_drift` of a stamped prediction log: the log's ends are taken
    first, so 2 n rows meet the store, not the whole log."""
    labelled = preds.filter(F.col("actual_conversion").isNotNull())
    ends = [monitored_predictions(first_rows(labelled, "prediction_timestamp", n, newest, "client_id"), store, as_of)
            for newest in (False, True)]
    return _ends_drift(*ends, features)


def _ends_drift(first: DataFrame, last: DataFrame, features: Sequence[str]) -> DataFrame:
    baseline = feature_moments(first, features, "baseline")
    current = feature_moments(last, features, "current")
    return baseline.join(current, "feature_name").select(
        "feature_name", "baseline_mean", "current_mean", _drift_score().alias("drift_score"))


def sampled_drift(store: DataFrame, fraction: float = 0.25, active_days: int = 30,
                  features: Sequence[str] = SAMPLE_DRIFT_FEATURES,
                  salt: str = "baseline_sample") -> DataFrame:
    """Recently active clients against a repeatable sample of all clients."""
    baseline = feature_moments(hash_sample(store, "client_id", fraction, salt), features, "baseline")
    active = store.filter(F.col("days_since_last_activity") <= active_days)
    current = feature_moments(active, features, "current")
    score = F.col("drift_score")
    return baseline.join(current, "feature_name").select(
        "feature_name", "baseline_mean", "current_mean", _drift_score().alias("drift_score"),
    ).withColumns({
        "drift_severity": first_match([(score > 2, "High"), (score > 1, "Medium")], "Low"),
        "alert_triggered": F.coalesce(score > 2, F.lit(False)),
    })


def drift_alert_rows(drift: DataFrame, as_of: datetime) -> DataFrame:
    """Log rows for the features that alerted; one append writes them all."""
    fired = drift.filter("alert_triggered").withColumn("check_timestamp", at(as_of))
    return conform(fired, "data_drift_monitoring", at(as_of))


def prediction_drift(segments: DataFrame, days: int = 7) -> DataFrame:
    """Positive rate of the newest days and its change from the day before."""
    rate = ratio(F.count_if(F.col("conversion_probability") == 1), F.count("*"))
    daily = segments.groupBy(floor_day(F.col("batch_timestamp")).alias("prediction_date")).agg(
        F.avg("conversion_probability").alias("avg_prediction"),
        rate.alias("positive_rate"),
        F.count("*").alias("daily_volume"),
    )
    recent = top_rows(daily, [F.col("prediction_date").desc()], days)
    # Global order over at most ``days`` rows.
    previous = F.lag("positive_rate").over(Window.orderBy("prediction_date"))
    return recent.withColumn("prev_positive_rate", previous).withColumn(
        "daily_change", F.abs(F.col("positive_rate") - F.col("prev_positive_rate"))
    ).orderBy(F.col("prediction_date").desc())


# --------------------------------------------------------------------------
# Observability dashboard, alerts
# --------------------------------------------------------------------------

def observability_dashboard(performance: DataFrame, drift: DataFrame, segments: DataFrame,
                            impact: DataFrame, as_of: datetime) -> DataFrame:
    """Per model: accuracy, drift, today's volume, 30-day value, health status."""
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    models = performance.filter(F.col("metric_name") == "ACCURACY").groupBy("model_name", "model_version").agg(
        F.max("evaluation_timestamp").alias("last_evaluated"),
        exact_avg(F.col("metric_value")).alias("avg_accuracy"),
    )
    drifted = drift.filter("alert_triggered").agg(
        F.count_distinct("feature_name").alias("drifted_features"),
        F.max("drift_score").alias("max_drift_score"))
    volume = segments.filter(F.col("batch_timestamp") >= at(midnight)).agg(
        F.count("*").alias("daily_predictions"),
        F.count_if(F.col("conversion_probability") == 1).alias("positive_predictions"),
        F.count_distinct("client_id").alias("unique_clients"))
    value = impact.filter(F.col("evaluation_date") >= days_back(midnight, days=30).cast("date")).agg(
        F.sum("total_business_value").alias("total_value"),
        F.avg("roi_percentage").alias("avg_roi"),
        F.sum("total_conversions").alias("total_conversions"),
        F.sum("churns_prevented").alias("total_churns_prevented"))
    joined = attach_row(attach_row(attach_row(models, drifted), volume), value)
    return joined.select(
        "model_name", "model_version", "avg_accuracy", "last_evaluated", "drifted_features",
        "max_drift_score", "daily_predictions", "positive_predictions", "unique_clients",
        "total_value", "avg_roi", "total_conversions", "total_churns_prevented",
        first_match([
            (F.col("avg_accuracy") < 0.6, "Critical"),
            (F.col("drifted_features") > 3, "Warning"),
            (F.col("max_drift_score") > 2, "Warning"),
        ], "Healthy").alias("model_health_status"),
        at(as_of).alias("dashboard_updated"),
    )


def alert_rows(metrics: DataFrame, drift: DataFrame, accuracy_floor: float = 0.65,
               drift_ceiling: float = 2.0) -> DataFrame:
    """Open alerts: low accuracy, and one per drifting feature."""
    accuracy, score = F.col("accuracy"), F.col("drift_score")
    low = metrics.filter(accuracy < accuracy_floor).select(
        F.lit("Performance").alias("type"), F.lit("High").alias("severity"),
        F.concat(F.lit("Model accuracy ("), F.round(accuracy * 100, 2).cast("string"),
                 F.lit(f"%) below threshold ({accuracy_floor * 100:.0f}%)")).alias("message"),
        F.lit("Consider model retraining").alias("action"),
    )
    drifting = drift.filter(score > drift_ceiling).select(
        F.lit("Drift").alias("type"), F.lit("Medium").alias("severity"),
        F.concat(F.lit("High drift detected in "), F.col("feature_name"), F.lit(" (score: "),
                 F.round(score, 2).cast("string"), F.lit(")")).alias("message"),
        F.lit("Investigate feature distribution changes").alias("action"),
    )
    return low.unionByName(drifting)


def check_alerts(performance: DataFrame, drift: DataFrame, as_of: datetime,
                 accuracy_floor: float = 0.65, drift_ceiling: float = 2.0) -> DataFrame:
    """First alert of the last 24 hours, or "All systems normal"."""
    since = days_back(as_of, hours=24)
    accuracy = performance.filter(
        (F.col("metric_name") == "ACCURACY") & (F.col("evaluation_timestamp") >= since)
    ).agg(exact_avg(F.col("metric_value")).alias("accuracy")).scalar()
    worst = drift.filter(F.col("check_timestamp") >= since).agg(F.max("drift_score").alias("worst")).scalar()
    facts = one_row(performance.sparkSession, accuracy=accuracy, worst=worst)
    shown = lambda c: F.round(c, 4).cast("string")
    return facts.select(first_match([
        (F.col("accuracy") < accuracy_floor,
         F.concat(F.lit("ALERT: Model accuracy below threshold - "), shown(F.col("accuracy")))),
        (F.col("worst") > drift_ceiling,
         F.concat(F.lit("ALERT: High feature drift detected - "), shown(F.col("worst")))),
    ], "All systems normal").alias("alert_status"))


def alert_history(drift: DataFrame, k: int = 10) -> DataFrame:
    fired = drift.filter("alert_triggered").select(
        "check_timestamp", "feature_name", "drift_score", "alert_triggered")
    return top_rows(fired, [F.col("check_timestamp").desc(), F.col("feature_name")], k)


def model_comparison(performance: DataFrame, model_a: str, model_b: str, as_of: datetime) -> DataFrame:
    """Latest accuracy of two versions side by side, with a recommendation."""
    def latest(version: str, side: str) -> DataFrame:
        rows = performance.filter((F.col("metric_name") == "ACCURACY") & (F.col("model_version") == version))
        return latest_row(rows, "evaluation_timestamp", "tracking_id").select(
            F.col("model_name").alias(f"model_{side}_name"), F.col("model_version").alias(f"model_{side}_version"),
            F.col("metric_value").alias(f"model_{side}_accuracy"))

    gap = F.col("model_a_accuracy") - F.col("model_b_accuracy")
    paired = attach_row(latest(model_a, "a"), latest(model_b, "b")).withColumns({
        "performance_difference": gap,
        "recommendation": first_match([
            (gap > 0, F.concat(F.lit("Keep "), F.col("model_a_version"))),
            (gap < 0, F.concat(F.lit("Promote "), F.col("model_b_version"))),
        ], "No difference"),
    })
    return conform(paired, "ml_model_comparison", at(as_of))
