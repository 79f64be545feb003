"""The domain tables the checked queries run on, derived from the star schema."""

from __future__ import annotations

import uuid
from datetime import timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import at, days_back, exact_avg, first_match, floor_day, ratio
from tidemark.operators import unpivot_doubles
from tidemark.plans import features, impact, monitoring, scoring, segments
from tidemark.session import scratch_path
from tidemark.sources import materialize, star, write_bucketed

DRIFTING = ("total_events_30d", "engagement_score_30d", "annual_income")


class Domain:
    """Lazy frames over one data folder; building one runs nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.now = spark, folder, star.STAR_AS_OF

    def settled(self, with_clients: bool = False) -> Domain:
        """The same domain with the feature store written once and read back.

        Queries that join the store with tables derived from it would rebuild
        it for each side; as a table it costs one pass over the events.
        """
        other = Domain(self.spark, self.folder)
        if with_clients:
            other.__dict__["clients"] = materialize(self.clients, scratch_path(self.spark, "clients"))
        other.__dict__["store"] = materialize(other.store, scratch_path(self.spark, "feature-store"))
        return other

    def bucketed(self, buckets: int | None = None) -> Domain:
        """The same domain with clients, events and the store's history in tables bucketed by client.

        As many buckets as shuffle partitions: what joins them by client is read where it lies.
        """
        other, count = Domain(self.spark, self.folder), buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def kept(label: str, frame: DataFrame) -> DataFrame:
            name = f"{label}_{uuid.uuid4().hex}"
            return write_bucketed(frame, name, "client_id", count, scratch_path(self.spark, name))

        other.__dict__["clients"] = kept("clients", self.clients)
        other.__dict__["events"] = kept("events", self.events)
        other.__dict__["store_history"] = kept("store", other.store_history)
        other.__dict__["store"] = other.store_history.filter(F.col("feature_timestamp") == at(self.now))
        return other

    def raw(self, table: str) -> DataFrame:
        return star.read_star(self.spark, self.folder, table)

    @cached_property
    def clients(self) -> DataFrame:
        return star.clients(self.spark, self.folder)

    @cached_property
    def advisors(self) -> DataFrame:
        return star.advisors(self.spark, self.folder)

    @cached_property
    def events(self) -> DataFrame:
        return star.marketing_events(self.spark, self.folder)

    @cached_property
    def inference_log(self) -> DataFrame:
        return star.inference_log(self.spark, self.folder)

    @cached_property
    def engagement(self) -> DataFrame:
        return features.engagement_features(self.events, self.now)

    @cached_property
    def financial(self) -> DataFrame:
        return features.financial_behavioral_features(self.clients, self.events, self.now)

    @cached_property
    def targets(self) -> DataFrame:
        return features.propensity_targets(
            features.lifecycle_segments(self.clients, self.engagement), self.now)

    @cached_property
    def store(self) -> DataFrame:
        return features.feature_store(self.events, self.clients, self.now)

    @cached_property
    def store_history(self) -> DataFrame:
        earlier = features.feature_store(self.events, self.clients, self.now - timedelta(days=30))
        return self.store.unionByName(earlier)

    @cached_property
    def scores(self) -> DataFrame:
        return scoring.rule_scores(self.store)

    @cached_property
    def preds(self) -> DataFrame:
        return scoring.predictions(self.scores)

    @cached_property
    def pred_log(self) -> DataFrame:
        """Every event as a scoring of its client at the event's time."""
        moments = self.events.select("client_id", "event_id", F.col("event_timestamp").alias("prediction_timestamp"))
        return moments.join(self.preds, "client_id")

    @cached_property
    def monitored(self) -> DataFrame:
        return monitoring.monitored_predictions(self.pred_log, self.store, self.now)

    @cached_property
    def segments(self) -> DataFrame:
        return segments.client_segments(self.preds, self.now)

    @cached_property
    def segment_log(self) -> DataFrame:
        log = self.pred_log
        stamped = segments.client_segments(
            log.withColumn("client_id", F.struct("client_id", "prediction_timestamp")), self.now)
        return stamped.withColumns({
            "batch_timestamp": F.col("client_id.prediction_timestamp"), "client_id": F.col("client_id.client_id"),
        })

    @cached_property
    def churn(self) -> DataFrame:
        return segments.churn_segments(self.store, self.segments, self.now)

    @cached_property
    def daily(self) -> DataFrame:
        return scoring.daily_scores(self.store, self.now)

    @cached_property
    def prediction_history(self) -> DataFrame:
        """A prediction per client and active day, once per event."""
        active = self.events.select("client_id", floor_day(F.col("event_timestamp")).alias("day"))
        return active.join(self.daily, "client_id").select(
            "client_id", F.col("day").alias("prediction_timestamp"), "model_name", "model_version",
            "conversion_probability", "recommended_action", "prediction_confidence", "conversion_likelihood")

    @cached_property
    def perf_history(self) -> DataFrame:
        hit = F.col("prediction") == F.col("actual_conversion")
        day = floor_day(F.col("prediction_timestamp")).alias("evaluation_timestamp")
        return self.pred_log.groupBy(day).agg(ratio(F.count_if(hit), F.count("*")).alias("metric_value")).select(
            F.concat(F.lit("acc_"), F.to_date("evaluation_timestamp").cast("string")).alias("tracking_id"),
            "evaluation_timestamp", F.lit("CONVERSION_PREDICTOR").alias("model_name"),
            F.lit("V1").alias("model_version"), F.lit("ACCURACY").alias("metric_name"), "metric_value",
            F.lit("PRODUCTION").alias("evaluation_set"))

    @cached_property
    def drift_history(self) -> DataFrame:
        """Daily feature means against the overall mean, in deviations."""
        long = unpivot_doubles(self.monitored, DRIFTING, ["monitor_timestamp"])
        mean = exact_avg(F.col("value"))
        daily = long.groupBy(floor_day(F.col("monitor_timestamp")).alias("check_timestamp"), "feature_name").agg(
            mean.alias("current_mean"))
        base = long.groupBy("feature_name").agg(
            mean.alias("baseline_mean"), F.stddev_samp("value").alias("baseline_std"))
        score = F.round(F.abs(F.col("current_mean") - F.col("baseline_mean"))
                        / F.nullif(F.col("baseline_std"), F.lit(0.0)), 6)
        key = F.concat(F.lit("drift_"), F.col("feature_name"), F.lit("_"),
                       F.to_date("check_timestamp").cast("string"))
        return daily.join(base, "feature_name").withColumn("drift_score", score).select(
            key.alias("drift_id"), "check_timestamp", "feature_name", "baseline_mean", "current_mean",
            "drift_score", F.coalesce(F.col("drift_score") > 0.5, F.lit(False)).alias("alert_triggered"))

    @cached_property
    def alerts(self) -> DataFrame:
        score = F.col("drift_score")
        return self.drift_history.filter("alert_triggered").select(
            F.col("drift_id").alias("alert_id"), "feature_name", "drift_score", "check_timestamp",
            first_match([(score > 1.5, "critical"), (score > 1.0, "high")], "medium").alias("severity"),
            F.when(F.col("check_timestamp") >= days_back(self.now, days=60), "open").otherwise("closed").alias("status"))

    @cached_property
    def deployments(self) -> DataFrame:
        """One deployment per channel, live since the channel's first event."""
        return self.events.groupBy("channel").agg(F.min("event_timestamp").alias("deployment_timestamp")).select(
            F.concat(F.lit("deploy_"), F.col("channel")).alias("deployment_id"),
            F.lit("CONVERSION_PREDICTOR").alias("model_name"), F.col("channel").alias("model_version"),
            "deployment_timestamp",
            F.when(F.col("channel").isin("Other", "Phone"), "RETIRED").otherwise("ACTIVE").alias("status"))

    @cached_property
    def snapshots(self) -> DataFrame:
        """Daily prediction snapshots from the prediction log."""
        day = floor_day(F.col("prediction_timestamp")).alias("prediction_timestamp")
        p = F.col("probability")
        return self.pred_log.groupBy(day).agg(
            F.count("*").alias("total_predictions"), exact_avg(p).alias("avg_prediction_value"),
        ).withColumn("monitoring_id", F.col("prediction_timestamp").cast("string"))

    @cached_property
    def impact(self) -> DataFrame:
        return impact.business_impact(
            impact.conversion_impact(self.segments, self.store, self.now),
            impact.churn_impact(self.churn, self.store), self.now)

    @cached_property
    def requests(self) -> DataFrame:
        """Request table: every client served by one of the first ten advisors."""
        return self.clients.filter(F.col("assigned_advisor_id") < "ADV_010").select("client_id")

    def clock(self):
        return at(self.now)
