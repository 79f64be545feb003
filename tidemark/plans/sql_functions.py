"""Scorers and job bodies for SQL users: functions and table functions of the session, and one SQL script.

All bodies are SQL, so a query that calls them is planned as one and runs no Python.  The rules are those of
``tidemark.plans.scoring`` and ``monitoring``; tests hold both against each other.  Rules, labels and thresholds below
are fixed values of the definitions.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.scoring import MODEL_NAME

ANSWER = "STRUCT<conversion_probability: DOUBLE, confidence: DOUBLE, next_action: STRING>"
ONLINE = "STRUCT<conversion_probability: DOUBLE, confidence: DOUBLE, next_action: STRING, source: STRING>"

SCORERS = (
    f"""predict_conversion(engagement DOUBLE, income DOUBLE, balance DOUBLE, age DOUBLE, tier DOUBLE, days_inactive DOUBLE)
    RETURNS {ANSWER} RETURN named_struct(
      'conversion_probability', CASE WHEN engagement > 0.6D AND income > 100000 THEN 0.85D WHEN engagement > 0.4D AND balance > 75000 THEN 0.7D
        WHEN tier >= 2 AND days_inactive < 30 THEN 0.55D WHEN income > 75000 AND age BETWEEN 35 AND 55 THEN 0.4D ELSE 0.25D END,
      'confidence', CASE WHEN engagement > 0.5D THEN 0.9D WHEN engagement > 0.3D THEN 0.75D ELSE 0.6D END,
      'next_action', CASE WHEN engagement > 0.6D AND income > 100000 THEN 'Schedule_Wealth_Consultation'
        WHEN tier = 1 THEN 'Upgrade_Service_Tier' WHEN days_inactive > 60 THEN 'Re_engagement_Campaign' ELSE 'Educational_Content' END)""",
    f"""predict_conversion_fallback(engagement DOUBLE, income DOUBLE, balance DOUBLE)
    RETURNS {ONLINE} RETURN named_struct(
      'conversion_probability', CASE WHEN engagement > 0.6D AND income > 100000 THEN 0.75D WHEN engagement > 0.3D AND balance > 50000 THEN 0.55D ELSE 0.3D END,
      'confidence', 0.7D,
      'next_action', CASE WHEN engagement > 0.6D AND income > 100000 THEN 'Schedule_Wealth_Consultation'
        WHEN engagement > 0.3D AND balance > 50000 THEN 'Schedule_Planning_Session' ELSE 'Educational_Content' END,
      'source', 'fallback')""",
    """conversion_likelihood(probability DOUBLE) RETURNS STRING
    RETURN CASE WHEN probability > 0.7D THEN 'High' WHEN probability > 0.4D THEN 'Medium' ELSE 'Low' END""",
    """logistic_score(features ARRAY<DOUBLE>) RETURNS DOUBLE
    RETURN CASE WHEN size(slice(features, 1, 7)) > 0 AND NOT exists(slice(features, 1, 7), x -> x IS NULL)
      THEN 1D / (1D + exp(-0.1D * (aggregate(slice(features, 1, 7), 0D, (total, x) -> total + x) / size(slice(features, 1, 7)) - 10D))) ELSE 0.5D END""",
    """points_score(features ARRAY<DOUBLE>) RETURNS DOUBLE
    RETURN CASE WHEN size(features) = 30 THEN least(1D, greatest(0D, (
      CASE WHEN coalesce(features[0], 0D) > 20 THEN 30 WHEN coalesce(features[0], 0D) > 10 THEN 20 WHEN coalesce(features[0], 0D) > 5 THEN 10 ELSE 0 END
      + least(coalesce(features[5], 0D) / 4, 25D)
      + CASE WHEN coalesce(nullif(features[8], 0D), 50000D) > 150000 THEN 25 WHEN coalesce(nullif(features[8], 0D), 50000D) > 100000 THEN 20
          WHEN coalesce(nullif(features[8], 0D), 50000D) > 75000 THEN 15 WHEN coalesce(nullif(features[8], 0D), 50000D) > 50000 THEN 10 ELSE 0 END
      + coalesce(nullif(features[26], 0D), 50D) * 0.2D) / 100D)) ELSE 0.5D END""",
)


def register_scorers(spark: SparkSession) -> None:
    """The scorers as SQL functions of the session."""
    for definition in SCORERS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")


def register_jobs(spark: SparkSession, store: str, predictions: str, performance: str, drift: str) -> None:
    """The job bodies as table functions over the named tables: ``daily_scoring(as_of)``,
    ``performance_check(baseline, tolerance)`` and ``alert_check(as_of, accuracy_floor, drift_ceiling)``."""
    register_scorers(spark)
    bodies = (
        f"""daily_scoring(as_of TIMESTAMP_NTZ)
        RETURNS TABLE (client_id STRING, prediction_timestamp TIMESTAMP_NTZ, model_name STRING, conversion_probability DOUBLE,
          recommended_action STRING, prediction_confidence DOUBLE, lifecycle_stage STRING, conversion_likelihood STRING)
        RETURN SELECT client_id, daily_scoring.as_of, '{MODEL_NAME}', s.conversion_probability, s.next_action, s.confidence, lifecycle_stage,
            conversion_likelihood(s.conversion_probability)
          FROM (SELECT client_id, lifecycle_stage, predict_conversion(engagement_score_30d, annual_income, current_401k_balance, age,
              service_tier_numeric, days_since_last_activity) AS s
            FROM {store} WHERE lifecycle_stage <> 'Dormant')""",
        f"""performance_check(baseline DOUBLE, tolerance DOUBLE)
        RETURNS TABLE (current_accuracy DOUBLE, performance_drop DOUBLE, result STRING)
        RETURN SELECT accuracy, fallen, CASE
            WHEN fallen > performance_check.tolerance THEN concat('RETRAINING RECOMMENDED: Performance dropped by ', CAST(round(fallen * 100, 1) AS STRING), '%')
            ELSE concat('Model performing well. Current accuracy: ', CAST(round(accuracy * 100, 1) AS STRING), '%') END
          FROM (SELECT accuracy, (performance_check.baseline - accuracy) / performance_check.baseline AS fallen
            FROM (SELECT CAST(count_if(prediction = actual_conversion) AS DOUBLE) / nullif(count(*), 0) AS accuracy FROM {predictions}))""",
        f"""alert_check(as_of TIMESTAMP_NTZ, accuracy_floor DOUBLE, drift_ceiling DOUBLE)
        RETURNS TABLE (alert_status STRING)
        RETURN SELECT CASE
            WHEN accuracy < alert_check.accuracy_floor THEN concat('ALERT: Model accuracy below threshold - ', CAST(round(accuracy, 4) AS STRING))
            WHEN worst > alert_check.drift_ceiling THEN concat('ALERT: High feature drift detected - ', CAST(round(worst, 4) AS STRING))
            ELSE 'All systems normal' END
          FROM (SELECT CAST(sum(CAST(metric_value AS DECIMAL(38,18))) AS DOUBLE) / nullif(count(metric_value), 0) AS accuracy FROM {performance}
              WHERE metric_name = 'ACCURACY' AND evaluation_timestamp >= alert_check.as_of - INTERVAL '24' HOUR),
            (SELECT max(drift_score) AS worst FROM {drift} WHERE check_timestamp >= alert_check.as_of - INTERVAL '24' HOUR)""",
    )
    for body in bodies:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")


def daily_scoring_script(table: str, day: date) -> str:
    """The daily job as a SQL script: replace the day's partition of ``table``, then tell how many rows it has.

    Running it again replaces the same partition; other days are not touched.
    """
    return f"""
    BEGIN
      DECLARE scored BIGINT DEFAULT 0;
      INSERT OVERWRITE TABLE {table} PARTITION (prediction_date = DATE '{day}')
        SELECT * FROM daily_scoring(TIMESTAMP_NTZ '{day} 00:00:00');
      SET scored = (SELECT count(*) FROM {table} WHERE prediction_date = DATE '{day}');
      SELECT scored;
    END"""


def run_daily_scoring_sql(spark: SparkSession, table: str, day: date, location: str | None = None) -> int:
    """Run the script, creating the table on first use, at ``location`` if given; returns the rows of the day."""
    if not spark.catalog.tableExists(table):
        place = f" LOCATION '{location}'" if location else ""
        spark.sql(f"""CREATE TABLE {table} (client_id STRING, prediction_timestamp TIMESTAMP_NTZ, model_name STRING, conversion_probability DOUBLE,
            recommended_action STRING, prediction_confidence DOUBLE, lifecycle_stage STRING, conversion_likelihood STRING, prediction_date DATE)
            USING parquet PARTITIONED BY (prediction_date){place}""")
    return _script(spark, daily_scoring_script(table, day)).first()[0]


def _script(spark: SparkSession, text: str) -> DataFrame:
    spark.conf.set("spark.sql.scripting.enabled", "true")
    return spark.sql(text)
