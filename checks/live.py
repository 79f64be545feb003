"""Streaming and training queries, run to completion and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from checks.analytics import _TIERED
from checks.domain import Domain
from checks.primitives import _STAGED, spoilt_lines, stage_events, write_staged
from checks.sqltext import NOW, back, sql, uniform
from tidemark import streaming
from tidemark.functions import days_back, ratio
from tidemark.operators import append_numbered
from tidemark.plans import monitoring, scoring, training
from tidemark.session import cut_lineage, scratch_path
from tidemark.sources import BatchLog, materialize

QUERIES: dict[str, Callable[[Domain], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Replayed history arrives in no time order, so nothing may count as late.
ANY_AGE = "400 days"


def query(name: str, check: str | None = None):
    def add(build: Callable[[Domain], DataFrame]):
        QUERIES[name] = build
        if check is not None:
            ORACLE[name] = sql(check)
        return build
    return add


def _stream(d: Domain) -> DataFrame:
    return streaming.event_stream(d.spark, stage_events(d))


def _paths(d: Domain, label: str) -> tuple[str, str]:
    return scratch_path(d.spark, label), scratch_path(d.spark, f"{label}-progress")


@query("t01_stream_ingest", "SELECT * FROM staged")
def _ingest(d: Domain) -> DataFrame:
    target, progress = _paths(d, "ingest")
    streaming.ingest_events(_stream(d), target, progress).awaitTermination()
    return d.spark.read.parquet(target).select(*_STAGED)


@query("t01_stream_quarantine", """
SELECT CAST('accepted' AS VARCHAR) AS kind, event_id AS text, client_id FROM staged
UNION ALL SELECT 'accepted', NULL, client_id FROM staged WHERE event_id LIKE '%11'
UNION ALL SELECT 'rejected', '{"event_id": "' || event_id, NULL FROM staged WHERE event_id LIKE '%0'""")
def _stream_quarantine(d: Domain) -> DataFrame:
    path, (target, progress), (other, marks) = spoilt_lines(d), _paths(d, "ingest"), _paths(d, "rejected")
    streaming.ingest_events(streaming.event_stream(d.spark, path), target, progress).awaitTermination()
    streaming.ingest_events(streaming.rejected_stream(d.spark, path), other, marks).awaitTermination()
    good = d.spark.read.parquet(target).select(F.lit("accepted").alias("kind"), F.col("event_id").alias("text"), "client_id")
    bad = d.spark.read.parquet(other).select(F.lit("rejected").alias("kind"), F.col("line").alias("text"), F.lit(None).cast("string").alias("client_id"))
    return good.unionByName(bad)


@query("t02_stream_dedup", "SELECT * FROM staged")
def _dedup(d: Domain) -> DataFrame:
    """Every event staged twice; each id is kept once."""
    target, progress = _paths(d, "dedup")
    path = stage_events(d)
    write_staged(d.events, path)
    stream = streaming.event_stream(d.spark, path)
    streaming.ingest_events(streaming.deduplicated(stream, ANY_AGE), target, progress).awaitTermination()
    return d.spark.read.parquet(target).select(*_STAGED)


@query("t02_unique_whole_table", """
SELECT event_id, client_id, event_timestamp, event_type FROM marketing_events
UNION ALL SELECT NULL, client_id, event_timestamp, event_type FROM marketing_events WHERE event_id LIKE '%5'
UNION ALL SELECT NULL, client_id, event_timestamp, event_type FROM marketing_events WHERE event_id LIKE '%5'""")
def _unique(d: Domain) -> DataFrame:
    """Every event comes again when its day is long past, and some come twice at once; rows without an id all stay."""
    target, progress = _paths(d, "unique")
    path = stage_events(d)
    write_staged(d.events.withColumn("event_id", F.when(~F.col("event_id").like("%5"), F.col("event_id"))).filter("event_id IS NULL"), path)
    ingest = lambda: streaming.ingest_unique(streaming.event_stream(d.spark, path), target, progress, blocks=8).awaitTermination()
    ingest()
    for part in (d.events, d.events.filter("event_id LIKE '%3'"), d.events.withColumn("event_id", F.when(~F.col("event_id").like("%5"), F.col("event_id"))).filter("event_id IS NULL")):
        write_staged(part, path)
    ingest()
    return streaming.unique_events(d.spark, target).select("event_id", "client_id", "event_timestamp", "event_type")


@query("t03_live_counts", "SELECT event_type, count(*) AS events FROM marketing_events GROUP BY 1")
def _counts(d: Domain) -> DataFrame:
    target, progress = _paths(d, "counts")
    streaming.live_counts(_stream(d), target, progress).awaitTermination()
    return streaming.latest_versions(d.spark, target, ["event_type"])


@query("t04_live_windows", """
SELECT time_bucket(INTERVAL '10' MINUTE, event_timestamp) AS window_start, count(*) AS events FROM marketing_events GROUP BY 1""")
def _windows(d: Domain) -> DataFrame:
    target, progress = _paths(d, "windows")
    streaming.live_windows(_stream(d), target, progress, lateness=ANY_AGE).awaitTermination()
    return streaming.latest_versions(d.spark, target, ["window_start"])


query("t04_recent_events", f"SELECT event_id, event_type, event_timestamp FROM marketing_events WHERE event_timestamp >= {back(7)}"
      )(lambda d: streaming.recent_events(d.events, days_back(d.now, days=7)).select("event_id", "event_type", "event_timestamp"))


def _prediction_stream(d: Domain) -> DataFrame:
    path = scratch_path(d.spark, "prediction-log")
    d.pred_log.select("client_id", "prediction", "probability", "actual_conversion",
                      F.col("prediction_timestamp").alias("monitor_timestamp")).write.parquet(path)
    schema = d.spark.read.parquet(path).schema
    return d.spark.readStream.schema(schema).parquet(path)


@query("t05_self_refreshing_monitor", "SELECT * FROM monitored")
def _refresh(d: Domain) -> DataFrame:
    target, progress = _paths(d, "monitored")
    store = materialize(d.store, scratch_path(d.spark, "feature-store"))  # one pass over the events, not one a micro-batch
    enriched = streaming.monitored_stream(_prediction_stream(d), store, monitoring.MONITORED_FEATURES)
    streaming.refresh_monitored(enriched, target, progress).awaitTermination()
    return d.spark.read.parquet(target).select(*d.monitored.columns)


@query("t05_incremental_refresh", "SELECT * FROM monitored")
def _refresh_hours(d: Domain) -> DataFrame:
    """Labels of some clients come late, others' store rows change: only those days are written again."""
    target, features = scratch_path(d.spark, "monitored"), list(monitoring.MONITORED_FEATURES)
    store = materialize(d.store.select("client_id", *features), scratch_path(d.spark, "feature-store"))
    full = materialize(d.pred_log.select("client_id", "prediction", "probability", "actual_conversion",
                                         F.col("prediction_timestamp").alias("monitor_timestamp")), scratch_path(d.spark, "prediction-log"))
    late = F.col("client_id").like("%7") & (F.minute("monitor_timestamp") < 20)
    early = full.withColumn("actual_conversion", F.when(~late, F.col("actual_conversion")))
    older = store.withColumn(features[0], F.when(F.col("client_id").like("%11"), F.col(features[0]) + 1).otherwise(F.col(features[0])))
    for predictions, known in ((early, older), (early, older), (full, store)):
        streaming.refresh_hours(predictions, known, features, target, unit="day")  # a few events an hour here
    return streaming.monitored_table(d.spark, target).select(*d.monitored.columns)


@query("t06_live_hourly_performance", """
SELECT monitor_hour, predictions_count, accuracy, precision, recall FROM hourly""")
def _hourly(d: Domain) -> DataFrame:
    target, progress = _paths(d, "hourly")
    streaming.live_hourly_performance(_prediction_stream(d), target, progress, lateness=ANY_AGE).awaitTermination()
    counts = streaming.latest_versions(d.spark, target, ["monitor_hour"])
    of = lambda part, whole: ratio(F.col(part), F.col(whole))
    return counts.select(
        "monitor_hour", "predictions_count", of("hits", "predictions_count").alias("accuracy"),
        of("true_positives", "predicted").alias("precision"), of("true_positives", "actual").alias("recall"))


@query("t08_daily_rollup_counters", """
SELECT client_id, total_events_7d, total_events_30d, total_events_90d, web_visits_7d, web_visits_30d, web_visits_90d,
 email_opens_7d, email_opens_30d, email_clicks_7d, email_clicks_30d, personal_interactions_30d, active_days_30d, last_activity_timestamp
FROM engagement""")
def _rollup(d: Domain) -> DataFrame:
    target, progress = _paths(d, "rollup")
    streaming.stream_daily_rollup(_stream(d), target, progress).awaitTermination()
    return streaming.engagement_from_days(streaming.merge_days(d.spark, target), d.now)


@query("t08_folded_rollup", """
SELECT client_id, total_events_7d, total_events_30d, total_events_90d, web_visits_7d, web_visits_30d, web_visits_90d,
 email_opens_7d, email_opens_30d, email_clicks_7d, email_clicks_30d, personal_interactions_30d, active_days_30d, last_activity_timestamp
FROM engagement""")
def _folded(d: Domain) -> DataFrame:
    """Many micro-batches, some of them folded into one, more after that, and all folded again."""
    target, progress = _paths(d, "rollup")
    path = stage_events(d)
    for part in (None, "event_id LIKE '%4'"):
        if part:
            write_staged(d.events.filter(part), path)  # as new batches; taken out again below
        streaming.stream_daily_rollup(streaming.event_stream(d.spark, path, 2), target, progress).awaitTermination()
        streaming.fold_days(d.spark, target)
    twice = streaming.daily_rollup(d.events.filter("event_id LIKE '%4'"))
    BatchLog(d.spark, target).append(twice.withColumns({n: -F.col(n) for n in twice.columns if n not in ("client_id", "activity_date", "last_event")}), 999)
    streaming.fold_days(d.spark, target)
    BatchLog(d.spark, target).vacuum()
    return streaming.engagement_from_days(streaming.merge_days(d.spark, target), d.now)


@query("a10_distinct_from_partials", f"""
SELECT event_type, CAST(n AS INTEGER) AS window_days, count(DISTINCT client_id) AS clients FROM marketing_events, (VALUES (7), (30), (90)) w(n)
WHERE event_timestamp >= {NOW} - n * INTERVAL '1' DAY AND event_timestamp < {NOW} GROUP BY 1, 2""")
def _distinct(d: Domain) -> DataFrame:
    target, progress = _paths(d, "bitmaps")
    path = scratch_path(d.spark, "client-numbers")
    append_numbered(d.clients.select("client_id"), path, ["client_id"], "client_number")
    numbers = d.spark.read.parquet(path)
    streaming.stream_client_bitmaps(streaming.event_stream(d.spark, stage_events(d), 2), numbers, target, progress).awaitTermination()
    streaming.fold_client_bitmaps(d.spark, target)
    return streaming.distinct_clients(streaming.merge_client_bitmaps(d.spark, target), d.now)


@query("x08_logged_scores", f"""
SELECT client_id, 'CONVERSION_PREDICTOR' AS model_name, 'fallback' AS source, {NOW} AS timestamp, {_TIERED} FROM store""")
def _logged(d: Domain) -> DataFrame:
    """Requests of some advisors as a batch, sent twice under one id; the others' as a stream, replayed from the start."""
    path, staged = scratch_path(d.spark, "inference-log"), scratch_path(d.spark, "requests")
    store = materialize(d.store, scratch_path(d.spark, "feature-store"))
    first = store.join(d.requests, "client_id", "left_semi")
    for _ in range(2):
        scoring.score_and_log(first, path, d.now, batch_id="backfill")
    d.clients.select("client_id").join(d.requests, "client_id", "left_anti").write.parquet(staged)
    for progress in ("a", "b"):
        requests = d.spark.readStream.schema("client_id string").parquet(staged)
        scoring.score_stream(requests, store, path, scratch_path(d.spark, f"requests-{progress}"), d.now).awaitTermination()
    return scoring.inference_log(d.spark, path).select(
        "client_id", "model_name", "source", "timestamp", "prediction_result.conversion_probability",
        "prediction_result.confidence", "prediction_result.next_action")


# --------------------------------------------------------------------------
# Training (tree ensembles have no SQL form: what SQL can state is the rows, the labels and the scores' range and rule)
# --------------------------------------------------------------------------

query("m01_labelled_frame", """
SELECT client_id, total_events_30d, annual_income, lifecycle_stage, conversion_target, churn_target, next_best_action FROM store
WHERE conversion_target IS NOT NULL AND churn_target IS NOT NULL AND next_best_action IS NOT NULL"""
      )(lambda d: training.labelled_frame(d.store).select(
          "client_id", "total_events_30d", "annual_income", "lifecycle_stage", "conversion_target", "churn_target", "next_best_action"))
query("m02_complete_rows", """
SELECT client_id FROM store WHERE total_events_30d IS NOT NULL AND engagement_score_30d IS NOT NULL AND current_401k_balance IS NOT NULL
 AND conversion_target IS NOT NULL"""
      )(lambda d: training.complete_rows(training.labelled_frame(d.store)).select("client_id"))
query("m03_one_hot", """
SELECT client_id, CASE WHEN age_segment = 'Young' THEN 1 ELSE 0 END AS age_segment_young,
 CASE WHEN age_segment = 'Mid-Career' THEN 1 ELSE 0 END AS age_segment_mid_career,
 CASE WHEN age_segment = 'Pre-Retirement' THEN 1 ELSE 0 END AS age_segment_pre_retirement,
 CASE WHEN age_segment = 'Near-Retirement' THEN 1 ELSE 0 END AS age_segment_near_retirement FROM store"""
      )(lambda d: training.one_hot(d.store.select("client_id", "age_segment"), ["age_segment"]).drop("age_segment"))
query("m04_ordinal_encoding", """
SELECT client_id, CASE tenure_segment WHEN 'New' THEN 1 WHEN 'Growing' THEN 2 WHEN 'Established' THEN 3 WHEN 'Mature' THEN 4 ELSE 0 END AS tenure_segment_encoded FROM store"""
      )(lambda d: training.ordinal_encoded(d.store).select("client_id", "tenure_segment_encoded"))


def _train(d: Domain, classifier) -> DataFrame:
    train, test = training.split(cut_lineage(training.ordinal_encoded(training.labelled_frame(d.store))))
    return training.predict(training.fit(train, classifier), test)


def _stated(scored: DataFrame) -> DataFrame:
    """What SQL can state of scores: they are probabilities, and the prediction follows them."""
    p = F.col("probability")
    return scored.select("client_id", "actual_conversion", F.coalesce(p.between(0, 1), F.lit(False)).alias("in_range"),
                         F.coalesce(F.col("prediction") == (p > 0.5).cast("double"), F.lit(False)).alias("follows_score"))


_TEST_ROWS = f"""
SELECT client_id, conversion_target AS actual_conversion, TRUE AS in_range, TRUE AS follows_score FROM store
WHERE conversion_target IS NOT NULL AND churn_target IS NOT NULL AND next_best_action IS NOT NULL AND {uniform('client_id', '42')} < 0.2e0"""
# The scores themselves; a tree ensemble has no SQL, a test holds them against the base rate on rows not seen.
query("m06_boosted_trees")(lambda d: _train(d, training.boosted_trees("conversion_target")))
query("m07_random_forest")(lambda d: _train(d, training.random_forest("conversion_target")))
query("m06_score_rules", _TEST_ROWS)(lambda d: _stated(_train(d, training.boosted_trees("conversion_target"))))
query("m07_score_rules", _TEST_ROWS)(lambda d: _stated(_train(d, training.random_forest("conversion_target"))))
query("m09_classification_metrics", """
SELECT count(*) FILTER (WHERE prediction = actual_conversion) / nullif(count(*), 0) AS accuracy,
 coalesce(count(*) FILTER (WHERE prediction = 1 AND actual_conversion = 1) / nullif(count(*) FILTER (WHERE prediction = 1), 0), 0e0) AS precision,
 coalesce(count(*) FILTER (WHERE prediction = 1 AND actual_conversion = 1) / nullif(count(*) FILTER (WHERE actual_conversion = 1), 0), 0e0) AS recall,
 count(*) AS rows,
 coalesce(2 * (count(*) FILTER (WHERE prediction = 1 AND actual_conversion = 1) / nullif(count(*) FILTER (WHERE prediction = 1), 0))
  * (count(*) FILTER (WHERE prediction = 1 AND actual_conversion = 1) / nullif(count(*) FILTER (WHERE actual_conversion = 1), 0))
  / nullif(count(*) FILTER (WHERE prediction = 1 AND actual_conversion = 1) / nullif(count(*) FILTER (WHERE prediction = 1), 0)
   + count(*) FILTER (WHERE prediction = 1 AND actual_conversion = 1) / nullif(count(*) FILTER (WHERE actual_conversion = 1), 0), 0e0), 0e0) AS f1
FROM preds""")(lambda d: training.classification_metrics(d.preds))


@query("m11_registry_inference")
def _registry(d: Domain) -> DataFrame:
    root = scratch_path(d.spark, "registry")
    store = materialize(d.store, scratch_path(d.spark, "feature-store"))
    best = training.train_champion(store)
    training.register_model(best.model, root, "CONVERSION_PREDICTOR", "V1", best.name, best.metrics,
                            {"target": "conversion"}, d.now)
    return training.registry_predictions(d.spark, root, "CONVERSION_PREDICTOR", store)


query("m11_score_rules", """
SELECT client_id, conversion_target AS actual_conversion, TRUE AS in_range, TRUE AS follows_score FROM store""")(lambda d: _stated(_registry(d)))


@query("m13_model_comparison", """
SELECT 'V1' AS model_a_version, a AS model_a_accuracy, 'V2' AS model_b_version, b AS model_b_accuracy, a - b AS performance_difference,
 CASE WHEN a > b THEN 'Keep V1' WHEN a < b THEN 'Promote V2' ELSE 'No difference' END AS recommendation
FROM (SELECT count(*) FILTER (WHERE prediction = actual_conversion) / count(*) AS a, count(*) FILTER (WHERE (probability > 0.3e0) = (actual_conversion = 1)) / count(*) AS b FROM preds)""")
def _comparison(d: Domain) -> DataFrame:
    first = monitoring.accuracy_row(d.preds, d.now)
    second = monitoring.accuracy_row(scoring.predictions(d.scores, 0.3), d.now).withColumn("model_version", F.lit("V2"))
    return monitoring.model_comparison(first.unionByName(second), "V1", "V2", d.now).select(
        "model_a_version", "model_a_accuracy", "model_b_version", "model_b_accuracy", "performance_difference", "recommendation")
