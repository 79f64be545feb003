"""Feature catalog and registries as plain tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import at, first_match, floor_day
from tidemark.operators import TimedView, as_of_join, as_of_views
from tidemark.operators.absence import not_exists
from tidemark.plans.features import STORE_COLUMNS
from tidemark.schemas import TABLES, conform
from tidemark.sources.readers import table_columns
from tidemark.sources.writers import append_rows

VIEW_NAME = "CLIENT_FINANCIAL_FEATURES_V1"
TARGETS = ("conversion_target", "churn_target", "next_best_action")
# Store columns the first published view leaves out.
NOT_PUBLISHED = (
    "conversions_30d", "premium_client_indicator", "investment_experience_numeric",
    "education_engagement", "phone_preference_ratio", "inperson_preference_ratio",
    "conversion_probability", "churn_probability", "business_priority_score", *TARGETS,
)
PUBLISHED_COLUMNS = tuple(c for c in STORE_COLUMNS if c not in NOT_PUBLISHED)


def feature_view(store: DataFrame) -> DataFrame:
    """Published feature view: key, timestamp and 43 features, no targets."""
    return store.select(*PUBLISHED_COLUMNS)


def describe_feature(name: Column) -> Column:
    """Description by name pattern; in LIKE, ``_`` is any one character."""
    return first_match([
        (name.like("%_7d"), "Engagement metrics over 7 days"),
        (name.like("%_30d"), "Engagement metrics over 30 days"),
        (name.like("%_90d"), "Engagement metrics over 90 days"),
        (name.isin("age", "annual_income", "current_401k_balance"), "Client demographic features"),
        (name.like("%ratio%"), "Behavioral ratio metrics"),
    ], "Client feature")


def feature_definitions(store: DataFrame) -> DataFrame:
    """One row per feature column of the store, from its schema."""
    hidden = ("client_id", "feature_timestamp", *TARGETS)
    name = F.col("column_name")
    return table_columns(store, "feature_store").filter(~name.isin(*hidden)).select(
        F.lit(VIEW_NAME).alias("feature_view_name"), name.alias("feature_name"),
        F.col("data_type").alias("feature_type"), describe_feature(name).alias("feature_description"),
    )


def definition_listing(definitions: DataFrame, k: int = 20) -> DataFrame:
    return definitions.select("feature_name", "feature_type", "feature_description").orderBy(
        "feature_name").limit(k)


def definitions_by_description(definitions: DataFrame) -> DataFrame:
    return definitions.groupBy("feature_description").agg(F.count("*").alias("num_features")).orderBy(
        F.col("num_features").desc(), "feature_description")


def feature_metadata(spark: SparkSession, as_of: datetime) -> DataFrame:
    return spark.range(1).select(
        F.lit(VIEW_NAME).alias("feature_view_name"), F.lit("CLIENT").alias("entity_name"),
        F.lit("CLIENT_ID").alias("join_key"),
        F.lit("Financial and behavioral features for client ML models").alias("description"),
        at(as_of).alias("created_at"), F.lit("1.0").alias("version"),
    )


# --------------------------------------------------------------------------
# Registries: insert only what is not there yet
# --------------------------------------------------------------------------

def new_entity(existing: DataFrame, name: str, join_keys: list[str], desc: str, as_of: datetime) -> DataFrame:
    """Rows to append to ``entities``; empty when the name is taken."""
    row = existing.sparkSession.range(1).select(
        F.lit(name).alias("name"), F.array(*[F.lit(k) for k in join_keys]).alias("join_keys"),
        F.lit(desc).alias("desc"))
    return conform(not_exists(row, existing, ["name"]), "entities", at(as_of))


def new_feature_view(existing: DataFrame, name: str, version: str, entities: list[str],
                     timestamp_col: str | None, desc: str, query: str, as_of: datetime) -> DataFrame:
    """Rows to append to ``feature_views``; empty when (name, version) is taken."""
    row = existing.sparkSession.range(1).select(
        F.lit(name).alias("name"), F.lit(version).alias("version"),
        F.array(*[F.lit(e) for e in entities]).alias("entities"),
        F.lit(timestamp_col).alias("timestamp_col"), F.lit(desc).alias("desc"), F.lit(query).alias("query"))
    return conform(not_exists(row, existing, ["name", "version"]), "feature_views", at(as_of))


def new_deployment(existing: DataFrame, model: str, version: str, kind: str, notes: str,
                   as_of: datetime) -> DataFrame:
    """Row to append to ``model_deployments`` unless the model is active."""
    row = existing.sparkSession.range(1).select(
        F.lit(model).alias("model_name"), F.lit(version).alias("model_version"),
        at(as_of).alias("deployment_timestamp"), F.lit(kind).alias("deployment_type"),
        F.lit("ACTIVE").alias("status"), F.lit("Production").alias("environment"), F.lit(notes).alias("notes"))
    active = existing.filter(F.col("status") == "ACTIVE")
    return conform(not_exists(row, active, ["model_name"]), "model_deployments", at(as_of))


def training_dataset(spine: DataFrame, feature_rows: DataFrame, feature_names: list[str],
                     timestamp: str = "feature_timestamp", bucket=floor_day) -> DataFrame:
    """Spine rows with the feature values known at each row's time."""
    return as_of_join(spine, feature_rows, "client_id", timestamp, timestamp, feature_names, bucket)


class FeatureRegistry:
    """Entities and versioned feature views as two tables under ``root``; a view is a query over tables of the session.

    What is registered stays as it is: a name (and version) can be taken once.  Registry rows are the only ones that
    come to the driver; views stay plans.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        for table in ("entities", "feature_views"):
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
                append_rows(spark.createDataFrame([], TABLES[table]), f"{self.root}/{table}")

    def entities(self) -> DataFrame:
        return self.spark.read.schema(TABLES["entities"]).parquet(f"{self.root}/entities")

    def views(self) -> DataFrame:
        return self.spark.read.schema(TABLES["feature_views"]).parquet(f"{self.root}/feature_views")

    def register_entity(self, name: str, join_keys: Sequence[str], desc: str, as_of: datetime) -> None:
        append_rows(new_entity(self.entities(), name, list(join_keys), desc, as_of), f"{self.root}/entities")

    def register_view(self, name: str, version: str, entity: str, timestamp_col: str, query: str, desc: str,
                      as_of: datetime) -> None:
        """ValueError for an unknown entity, and for a query without the entity's keys or the timestamp."""
        needed = {*self._keys(entity), timestamp_col}
        missing = needed - set(self.spark.sql(query).columns)
        if missing:
            raise ValueError(f"view {name} {version} lacks {sorted(missing)}")
        row = new_feature_view(self.views(), name, version, [entity], timestamp_col, desc, query, as_of)
        append_rows(row, f"{self.root}/feature_views")

    def _keys(self, entity: str) -> list[str]:
        row = self.entities().filter(F.col("name") == entity).first()
        if row is None:
            raise ValueError(f"no entity {entity} under {self.root}")
        return list(row["join_keys"])

    def view(self, name: str, version: str) -> tuple[TimedView, list[str]]:
        """A registered view, ready to meet a spine, and the keys of its entity."""
        row = self.views().filter((F.col("name") == name) & (F.col("version") == version)).first()
        if row is None:
            raise LookupError(f"no feature view {name} {version} under {self.root}")
        keys, frame = self._keys(row["entities"][0]), self.spark.sql(row["query"])
        features = [c for c in frame.columns if c not in (*keys, row["timestamp_col"])]
        return TimedView(name, frame, row["timestamp_col"], features), keys

    def dataset(self, spine: DataFrame, views: Sequence[tuple[str, str]], timestamp: str, bucket=floor_day) -> DataFrame:
        """Spine rows with what every listed (name, version) knew of their keys at their time.

        Views of one entity meet the spine in one shuffle; views of a further entity in one more.
        """
        by_keys: dict[tuple[str, ...], list[TimedView]] = {}
        for name, version in views:
            found, keys = self.view(name, version)
            by_keys.setdefault(tuple(keys), []).append(found)
        for keys, group in by_keys.items():
            spine = as_of_views(spine, group, keys, timestamp, bucket)
        return spine
