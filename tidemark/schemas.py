"""Table schemas and default-filling projections.

Column order follows the declared tables.  Times are zone-less timestamps.
The column names, their order and their types below are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

NTZ = T.TimestampNTZType()
STR = T.StringType()
INT = T.IntegerType()
LONG = T.LongType()
DBL = T.DoubleType()
BOOL = T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


CLIENTS = _struct(
    ("client_id", STR), ("created_date", NTZ), ("age", INT), ("gender", STR),
    ("marital_status", STR), ("education_level", STR), ("employment_status", STR),
    ("occupation", STR), ("annual_income", INT), ("state", STR), ("city", STR),
    ("zip_code", STR), ("current_401k_balance", T.DecimalType(12, 2)),
    ("years_to_retirement", INT), ("risk_tolerance", STR), ("investment_experience", STR),
    ("financial_goals", T.ArrayType(STR)), ("client_tenure_months", INT),
    ("assigned_advisor_id", STR), ("service_tier", STR),
    ("total_assets_under_management", T.DecimalType(12, 2)),
    ("preferred_contact_method", STR), ("last_contact_date", NTZ),
    ("communication_frequency_preference", STR),
)

ADVISORS = _struct(
    ("advisor_id", STR), ("advisor_name", STR), ("specialization", STR),
    ("years_experience", INT), ("client_count", INT),
    ("avg_client_satisfaction", T.DecimalType(3, 2)),
)

MARKETING_EVENTS = _struct(
    ("event_id", STR), ("client_id", STR), ("event_timestamp", NTZ), ("event_type", STR),
    ("event_category", STR), ("page_url", STR), ("session_id", STR), ("time_on_page", INT),
    ("referrer_source", STR), ("device_type", STR), ("campaign_id", STR),
    ("email_subject", STR), ("content_type", STR), ("meeting_type", STR),
    ("duration_minutes", INT), ("advisor_id", STR), ("meeting_outcome", STR),
    ("product_category", STR), ("product_specific", STR), ("action_taken", STR),
    ("channel", STR), ("touchpoint_value", T.DecimalType(10, 4)), ("conversion_flag", BOOL),
)

CLIENT_LIFECYCLE_EVENTS = _struct(
    ("event_id", STR), ("client_id", STR), ("event_date", NTZ), ("lifecycle_stage", STR),
    ("previous_stage", STR), ("trigger_event", STR), ("advisor_involved", BOOL),
)

PRODUCT_INTERACTIONS = _struct(
    ("interaction_id", STR), ("client_id", STR), ("interaction_date", NTZ),
    ("product_type", STR), ("interaction_type", STR),
    ("transaction_amount", T.DecimalType(12, 2)), ("status", STR),
)

MODEL_PREDICTIONS = _struct(
    ("client_id", STR), ("prediction_timestamp", NTZ), ("model_name", STR),
    ("model_version", STR), ("conversion_probability", DBL), ("churn_probability", DBL),
    ("recommended_action", STR), ("prediction_confidence", DBL), ("lifecycle_stage", STR),
    ("business_priority_score", DBL), ("inference_source", STR),
    ("inference_latency_ms", DBL), ("conversion_likelihood", STR),
)

MODEL_DEPLOYMENTS = _struct(
    ("deployment_id", STR), ("model_name", STR), ("model_version", STR),
    ("deployment_timestamp", NTZ), ("deployment_type", STR), ("status", STR),
    ("environment", STR), ("deployed_by", STR), ("notes", STR),
)

MODEL_DEPLOYMENT_METADATA = _struct(
    ("model_name", STR), ("model_version", STR), ("model_type", STR), ("f1_score", DBL),
    ("registered_timestamp", NTZ), ("deployment_ready", BOOL), ("deployment_stage", STR),
    ("deployed_timestamp", NTZ),
)

PREDICTION_MONITORING = _struct(
    ("monitoring_id", STR), ("prediction_timestamp", NTZ), ("model_name", STR),
    ("model_version", STR), ("total_predictions", LONG), ("avg_prediction_value", DBL),
    ("min_prediction_value", DBL), ("max_prediction_value", DBL),
    ("prediction_distribution", _struct(("high_prob", LONG), ("medium_prob", LONG), ("low_prob", LONG))),
    ("performance_metrics", _struct(("actual_conversions", LONG), ("conversion_rate", DBL))),
)

MODEL_PERFORMANCE_TRACKING = _struct(
    ("tracking_id", STR), ("evaluation_timestamp", NTZ), ("model_name", STR),
    ("model_version", STR), ("metric_name", STR), ("metric_value", DBL),
    ("evaluation_set", STR),
)

MODEL_PERFORMANCE_METRICS = _struct(
    ("model_name", STR), ("model_version", STR), ("evaluation_date", NTZ),
    ("metric_name", STR), ("metric_value", T.DecimalType(10, 6)), ("dataset_type", STR),
)

DATA_DRIFT_MONITORING = _struct(
    ("drift_id", STR), ("check_timestamp", NTZ), ("feature_name", STR),
    ("baseline_mean", DBL), ("current_mean", DBL), ("drift_score", DBL),
    ("alert_triggered", BOOL),
)

ML_BUSINESS_IMPACT = _struct(
    ("impact_id", STR), ("evaluation_date", T.DateType()), ("model_name", STR),
    ("model_version", STR), ("total_conversions", LONG), ("conversion_rate", DBL),
    ("revenue_generated", DBL), ("churns_prevented", LONG), ("retention_rate", DBL),
    ("revenue_retained", DBL), ("total_business_value", DBL), ("roi_percentage", DBL),
)

ML_MODEL_COMPARISON = _struct(
    ("comparison_id", STR), ("comparison_timestamp", NTZ), ("model_a_name", STR),
    ("model_a_version", STR), ("model_a_accuracy", DBL), ("model_b_name", STR),
    ("model_b_version", STR), ("model_b_accuracy", DBL), ("performance_difference", DBL),
    ("recommendation", STR),
)

REALTIME_INFERENCE_LOG = _struct(
    ("inference_id", STR), ("client_id", STR), ("model_name", STR),
    ("prediction_result", _struct(
        ("conversion_probability", DBL), ("confidence", DBL), ("next_action", STR),
        ("response_time_ms", DBL), ("source", STR), ("error", STR))),
    ("response_time_ms", DBL), ("source", STR), ("timestamp", NTZ),
)

ENTITIES = _struct(
    ("name", STR), ("join_keys", T.ArrayType(STR)), ("desc", STR), ("owner", STR),
    ("created_on", NTZ),
)

FEATURE_VIEWS = _struct(
    ("name", STR), ("version", STR), ("entities", T.ArrayType(STR)), ("timestamp_col", STR),
    ("desc", STR), ("query", STR), ("schema_version", STR), ("status", STR),
    ("created_on", NTZ),
)

FEATURE_STORES = _struct(
    ("name", STR), ("database_name", STR), ("schema_name", STR), ("created_on", NTZ),
    ("warehouse", STR), ("version", STR),
)

# Wire format of one streamed event; keys outside this list are ignored.
STREAM_EVENT = _struct(
    ("event_id", STR), ("client_id", STR), ("event_timestamp", NTZ), ("event_type", STR),
    ("event_category", STR), ("channel", STR), ("touchpoint_value", DBL),
    ("conversion_flag", BOOL), ("page_url", STR), ("session_id", STR), ("time_on_page", INT),
    ("referrer_source", STR), ("device_type", STR), ("campaign_id", STR),
    ("email_subject", STR), ("content_type", STR),
)

TABLES: dict[str, T.StructType] = {
    "clients": CLIENTS,
    "advisors": ADVISORS,
    "marketing_events": MARKETING_EVENTS,
    "client_lifecycle_events": CLIENT_LIFECYCLE_EVENTS,
    "product_interactions": PRODUCT_INTERACTIONS,
    "model_predictions": MODEL_PREDICTIONS,
    "model_deployments": MODEL_DEPLOYMENTS,
    "model_deployment_metadata": MODEL_DEPLOYMENT_METADATA,
    "prediction_monitoring": PREDICTION_MONITORING,
    "model_performance_tracking": MODEL_PERFORMANCE_TRACKING,
    "model_performance_metrics": MODEL_PERFORMANCE_METRICS,
    "data_drift_monitoring": DATA_DRIFT_MONITORING,
    "ml_business_impact": ML_BUSINESS_IMPACT,
    "ml_model_comparison": ML_MODEL_COMPARISON,
    "realtime_inference_log": REALTIME_INFERENCE_LOG,
    "entities": ENTITIES,
    "feature_views": FEATURE_VIEWS,
    "feature_stores": FEATURE_STORES,
}

# Columns that get a value when the writer leaves them out.  Ids default to a
# hash of the table, the row and the clock: a retried task and a second action
# on one frame give a row the same id, and rows that are equal share it.
_NOW_COLUMNS = {
    "created_date", "event_timestamp", "prediction_timestamp", "timestamp",
    "created_on", "comparison_timestamp",
}
_ID_COLUMNS = {
    "deployment_id", "monitoring_id", "tracking_id", "drift_id", "impact_id",
    "comparison_id", "inference_id",
}
_CONSTANTS = {"conversion_flag": False, "status": "ACTIVE", "schema_version": "1.0"}


def _default(table: str, field: T.StructField, now: Column, row: Column) -> Column:
    if field.name in _ID_COLUMNS:
        return F.md5(F.concat_ws("|", F.lit(f"{table}.{field.name}"), now.cast("string"), F.to_json(row)))
    if field.name in _NOW_COLUMNS:
        return now
    if field.name in ("deployed_by", "owner"):
        return F.current_user()
    if field.name == "version" and table == "feature_stores":
        return F.lit("1.0")
    if field.name == "status" and table != "feature_views":
        return F.lit(None)
    if field.name in _CONSTANTS:
        return F.lit(_CONSTANTS[field.name])
    return F.lit(None)


def conform(df: DataFrame, table: str, as_of: Column | None = None) -> DataFrame:
    """Project ``df`` to the declared columns, filling in declared defaults.

    An explicit NULL stays NULL, as with an INSERT that lists the column;
    columns ``df`` lacks take the default.  Extra columns are dropped.
    """
    schema = TABLES[table]
    now = as_of if as_of is not None else F.localtimestamp()
    present = {name.lower() for name in df.columns}
    row = F.struct("*")
    return df.select(*[
        (F.col(f.name) if f.name in present else _default(table, f, now, row)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def _default_text(table: str, name: str) -> str:
    """The declared default as DDL text; ids have none that a catalog can hold (see :func:`conform`)."""
    if name in _NOW_COLUMNS:
        return " DEFAULT localtimestamp()"
    if name in ("deployed_by", "owner"):
        return " DEFAULT current_user()"
    if name == "version" and table == "feature_stores":
        return " DEFAULT '1.0'"
    if name in _CONSTANTS and (name != "status" or table == "feature_views"):
        value = _CONSTANTS[name]
        return f" DEFAULT {str(value).lower()}" if isinstance(value, bool) else f" DEFAULT '{value}'"
    return ""


def create_table(spark: SparkSession, table: str, name: str | None = None, location: str | None = None) -> str:
    """Create a declared table in the catalog, with its column defaults, unless it is there; returns its name.

    An INSERT that leaves a column out gets its default from the catalog.
    """
    name = name or table
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{_default_text(table, f.name)}" for f in TABLES[table].fields)
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{place}")
    return name
