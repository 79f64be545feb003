"""Client-domain tables as views over the star-schema Parquet folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import first_match

# Clock for the star-schema data, a few days after its newest event.
STAR_AS_OF = datetime(2024, 2, 5)

DIGITAL = ("web_visit", "page_view", "search", "login")
EMAIL = ("email_open", "email_click")


def read_star(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _client_key(number: Column) -> Column:
    return F.concat(F.lit("client_"), F.lpad(number.cast("string"), 8, "0"))


def _advisor_key(number: Column) -> Column:
    return F.concat(F.lit("ADV_"), F.lpad((number % 50).cast("string"), 3, "0"))


def clients(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_star(spark, folder, "customer")
    spend = read_star(spark, folder, "orders").groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend")
    )
    key, group = F.col("c_custkey"), F.col("c_nationkey") % 4
    age = (25 + key % 46).cast("int")
    return customer.join(spend, customer.c_custkey == spend.o_custkey, "left").select(
        _client_key(key).alias("client_id"),
        age.alias("age"),
        (25000 + (key * 7919) % 475001).cast("int").alias("annual_income"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 50).alias("current_401k_balance"),
        F.greatest(F.lit(0), 65 - age).cast("int").alias("years_to_retirement"),
        first_match([(group == 0, "Conservative"), (group == 1, "Moderate"), (group == 2, "Aggressive")],
                    "Unknown").alias("risk_tolerance"),
        first_match([(group == 0, "Beginner"), (group == 1, "Intermediate"), (group == 2, "Advanced")],
                    "Unknown").alias("investment_experience"),
        (1 + key % 60).cast("int").alias("client_tenure_months"),
        _advisor_key(key).alias("assigned_advisor_id"),
        first_match([(F.col("c_mktsegment") == "AUTOMOBILE", "Elite"),
                     (F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), "Premium")],
                    "Basic").alias("service_tier"),
        (F.coalesce("spend", F.lit(0.0)) / 10).alias("total_assets_under_management"),
    )


def advisors(spark: SparkSession, folder: str) -> DataFrame:
    """One advisor per id: the supplier with the smallest key."""
    keyed = read_star(spark, folder, "supplier").withColumn("advisor_id", _advisor_key(F.col("s_suppkey")))
    return keyed.groupBy("advisor_id").agg(
        F.min_by("s_name", "s_suppkey").alias("advisor_name"),
        F.concat(F.lit("Desk "), F.min_by("s_nationkey", "s_suppkey").cast("string")).alias("specialization"),
    )


def marketing_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events shifted back 0-210 days per client, so every recency rule occurs."""
    raw = read_star(spark, folder, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )
    even = F.col("k") % 2 == 0
    source = F.col("event_type")
    kind = first_match([
        ((source == "view") & even, "web_visit"), (source == "view", "page_view"),
        ((source == "click") & even, "email_open"), (source == "click", "email_click"),
        ((source == "signup") & even, "login"), (source == "signup", "search"),
        ((source == "purchase") & even, "advisor_meeting"), (source == "purchase", "document_download"),
    ], "other")
    t, event_id = F.col("t"), F.col("event_id")
    shift = F.make_dt_interval((14 * (F.col("user_id") % 16)).cast("int"))
    return raw.withColumn("t", kind).select(
        F.concat(F.lit("event_"), event_id.cast("string")).alias("event_id"),
        _client_key(F.col("user_id")).alias("client_id"),
        (F.col("ts") - shift).alias("event_timestamp"),
        t.alias("event_type"),
        first_match([(t.isin(*DIGITAL), "Digital"), (t.isin(*EMAIL), "Email"),
                     (t == "document_download", "Educational"), (t == "advisor_meeting", "Personal")],
                    "Other").alias("event_category"),
        first_match([(t.isin(*DIGITAL), "Website"), (t.isin(*EMAIL), "Email"),
                     (t == "document_download", "Portal"), (t == "advisor_meeting", "In-Person"),
                     (even, "Phone")], "Other").alias("channel"),
        first_match([(event_id % 20 < 11, "Desktop"), (event_id % 20 < 18, "Mobile")],
                    "Tablet").alias("device_type"),
        F.when(t.isin(*DIGITAL), (15 + event_id % 886).cast("int")).alias("time_on_page"),
        F.when(event_id % 17 != 0, (event_id % 1000).cast("double") / 1000).alias("touchpoint_value"),
        F.when(event_id % 11 != 0, (t == "advisor_meeting") & (event_id % 7 == 0)).alias("conversion_flag"),
    )


def inference_log(spark: SparkSession, folder: str) -> DataFrame:
    """Request log: latency is the event value, errors went to the fallback."""
    return read_star(spark, folder, "events").select(
        F.concat(F.lit("request_"), F.col("event_id").cast("string")).alias("inference_id"),
        _client_key(F.col("user_id")).alias("client_id"),
        F.col("value").alias("response_time_ms"),
        F.when(F.col("event_type") == "error", "fallback").otherwise("container_service").alias("source"),
        F.col("ts").alias("timestamp"),
    )
