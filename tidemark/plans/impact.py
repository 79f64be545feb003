"""Business value of the models: conversions, retention, ROI, KPI rows."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import at, days_back, exact_avg, first_match, money_sum, ratio
from tidemark.operators import attach_row
from tidemark.plans.scoring import MODEL_NAME
from tidemark.schemas import conform

# Value assumptions.
ASSET_FEE, ADVISORY_FEE = 0.02, 1500
MANAGEMENT_FEE = 0.01
REVENUE_PER_CONVERSION = 50000
RETENTION_COSTS = {"Priority Retention Call": 500, "Personal Advisory Meeting": 300, "Special Offer": 200}
OTHER_RETENTION_COST = 100


def conversion_impact(segments: DataFrame, store: DataFrame, as_of: datetime, days: int = 7,
                      high_value_segment: str = "High Value",
                      advisory_action: str = "Wealth_Advisory_Consultation") -> DataFrame:
    """Revenue expected from predicted conversions of the last week."""
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    recent = segments.filter(F.col("batch_timestamp") >= days_back(midnight, days=days))
    joined = recent.join(store.select("client_id", "total_assets_under_management"), "client_id")
    converts = F.col("conversion_probability") == 1
    revenue = F.when(converts, F.col("total_assets_under_management") * ASSET_FEE + ADVISORY_FEE).otherwise(0.0)
    priced = joined.withColumn("potential_revenue", revenue)
    total = money_sum(F.col("potential_revenue"))
    in_segment = F.col("action_segment") == high_value_segment
    return priced.agg(
        F.count_distinct("client_id").alias("clients_targeted"),
        F.count_if(converts).alias("predicted_conversions"),
        total.alias("total_potential_revenue"),
        (total / F.nullif(F.count("potential_revenue"), F.lit(0))).alias("avg_revenue_per_conversion"),
        money_sum(F.when(in_segment, F.col("potential_revenue")).otherwise(0.0)).alias("high_value_revenue"),
        F.count_if(F.col("recommended_action") == advisory_action).alias("wealth_advisory_leads"),
    )


def retention_cost(action: Column, costs: Mapping[str, int] = RETENTION_COSTS,
                   other: int = OTHER_RETENTION_COST) -> Column:
    return first_match([(action == name, cost) for name, cost in costs.items()], other)


def churn_impact(churn: DataFrame, store: DataFrame,
                 costs: Mapping[str, int] = RETENTION_COSTS) -> DataFrame:
    """Revenue at risk above 0.6, against the cost of keeping it."""
    joined = churn.filter(F.col("churn_risk_score") > 0.6).join(
        store.select("client_id", "total_assets_under_management"), "client_id")
    revenue = F.col("total_assets_under_management") * MANAGEMENT_FEE
    at_risk, spent = money_sum(revenue), F.sum(retention_cost(F.col("retention_action"), costs))
    return joined.agg(
        F.count("*").alias("at_risk_clients"),
        at_risk.alias("revenue_at_risk"),
        (at_risk / F.nullif(F.count(revenue), F.lit(0))).alias("avg_revenue_per_client"),
        spent.alias("total_retention_cost"),
        (at_risk - spent).alias("net_revenue_saved"),
        F.count_if(F.col("value_tier") == "High Value").alias("high_value_at_risk"),
    )


def business_impact(conversion: DataFrame, churn: DataFrame, as_of: datetime) -> DataFrame:
    """The impact log row, built from the two one-row summaries."""
    value = F.col("total_potential_revenue") + F.col("net_revenue_saved")
    targeted = F.col("clients_targeted")
    row = attach_row(conversion, churn.withColumnRenamed("high_value_at_risk", "churn_high_value")).select(
        F.lit(as_of.date()).alias("evaluation_date"),
        F.lit(MODEL_NAME).alias("model_name"), F.lit("V1").alias("model_version"),
        F.col("predicted_conversions").alias("total_conversions"),
        ratio(F.col("predicted_conversions"), targeted).alias("conversion_rate"),
        F.col("total_potential_revenue").alias("revenue_generated"),
        F.col("at_risk_clients").alias("churns_prevented"),
        (1 - ratio(F.col("at_risk_clients"), targeted)).alias("retention_rate"),
        F.col("net_revenue_saved").alias("revenue_retained"),
        value.alias("total_business_value"),
        ((ratio(value, F.col("total_retention_cost")) - 1) * 100).alias("roi_percentage"),
    )
    return conform(row, "ml_business_impact", at(as_of))


def conversion_kpis(segments: DataFrame, segment_column: str | None = None,
                    high_label: str = "High Value") -> DataFrame:
    """Campaign KPIs; without a tier column, predicted converters are the priority."""
    converts = F.col("conversion_probability") == 1
    priority = F.col(segment_column) == high_label if segment_column else converts
    return segments.agg(
        F.count_distinct("client_id").alias("total_clients"),
        F.count_if(converts).alias("predicted_conversions"),
        F.count_if(priority).alias("high_priority_clients"),
        F.avg(F.when(converts, 1).otherwise(0)).alias("conversion_rate"),
    )


def prediction_kpis(preds: DataFrame, high: float = 0.8) -> DataFrame:
    """The same KPIs from labelled predictions, by priority score."""
    converts = F.col("prediction") == 1
    return preds.filter(F.col("actual_conversion").isNotNull()).agg(
        F.count_distinct("client_id").alias("total_clients"),
        F.count_if(converts).alias("predicted_conversions"),
        F.count_if(F.col("business_priority_score") > high).alias("high_priority_clients"),
        F.avg(F.when(converts, 1).otherwise(0)).alias("conversion_rate"),
    )


def churn_kpis(churn: DataFrame) -> DataFrame:
    return churn.filter(F.col("churn_risk_score") > 0.6).agg(
        F.count("*").alias("at_risk_clients"),
        F.count_if(F.col("value_tier") == "High Value").alias("high_value_at_risk"),
        exact_avg(F.col("churn_risk_score")).alias("avg_churn_risk"),
    )


def revenue_by_segment(segments: DataFrame) -> DataFrame:
    revenue = F.when(F.col("conversion_probability") == 1, REVENUE_PER_CONVERSION).otherwise(0)
    return segments.groupBy("action_segment").agg(
        F.count("*").alias("client_count"), F.avg(revenue).alias("avg_revenue_per_group"),
    ).orderBy(F.col("avg_revenue_per_group").desc(), "action_segment")


def conversion_groups(preds: DataFrame) -> DataFrame:
    group = F.when(F.col("prediction") == 1, "High Conversion").otherwise("Low Conversion")
    return preds.filter(F.col("actual_conversion").isNotNull()).groupBy(group.alias("conversion_group")).agg(
        F.count("*").alias("client_count"),
        exact_avg(F.col("business_priority_score")).alias("avg_priority_score"),
    ).orderBy(F.col("avg_priority_score").desc())


def conversion_groups_by_rate(segments: DataFrame) -> DataFrame:
    group = F.when(F.col("conversion_probability") == 1, "High Conversion").otherwise("Low Conversion")
    return segments.groupBy(group.alias("conversion_group")).agg(
        F.count("*").alias("client_count"), F.avg("conversion_probability").alias("avg_conversion_rate"),
    ).orderBy(F.col("avg_conversion_rate").desc())
