"""Single operators on the raw tables and the domain tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from operator import and_
import uuid

from pyspark.sql import DataFrame, Window, functions as F

from checks.domain import Domain
from checks.sqltext import CTES, NOW, back, days, msum, rnd, sql, uniform, xavg, xsum
from tidemark import sources
from tidemark.functions import (
    at, bernoulli, code_map, days_back, days_between, exact_avg, exact_sum, first_match, flag,
    floor_day, floor_hour, greatest_strict, hash_uniform, least_strict, money_sum, percent, ratio,
    same_day, squash,
)
from tidemark.operators import (
    append_numbered, as_of_join, attach_row, exact_quantile, first_rows, hash_sample, latest_row, latest_rows,
    metric_rows, not_exists, not_in, numbered, one_row, top_rows,
    unpivot_doubles,
)
from tidemark.plans import catalog, scoring
from tidemark.schemas import create_table
from tidemark.session import scratch_path

QUERIES: dict[str, Callable[[Domain], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(build: Callable[[Domain], DataFrame]):
        QUERIES[name] = build
        if check is not None:
            ORACLE[name] = sql(check)
        return build
    return add


# --------------------------------------------------------------------------
# Scans, sinks, table mutation
# --------------------------------------------------------------------------

query("s01_table_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000"
      )(lambda d: sources.scan(d.spark, f"{d.folder}/orders.parquet")
        .filter("o_totalprice > 200000").select("o_orderkey", "o_totalprice"))

CTES["staged"] = """
SELECT event_id, client_id, event_timestamp, event_type, event_category, channel, touchpoint_value, conversion_flag,
 time_on_page, device_type FROM marketing_events"""
_STAGED = ("event_id", "client_id", "event_timestamp", "event_type", "event_category", "channel",
           "touchpoint_value", "conversion_flag", "time_on_page", "device_type")


def stage_events(d: Domain) -> str:
    """Marketing events as JSON-lines files in the shared folder."""
    path = scratch_path(d.spark, "staged-events")
    write_staged(d.events, path)
    return path


def write_staged(events: DataFrame, path: str) -> None:
    writer = events.select(*_STAGED).write.mode("append")
    writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


query("s02_json_scan", "SELECT * FROM staged"
      )(lambda d: sources.event_files(d.spark, stage_events(d)).select(*_STAGED))


@query("s03_csv_client_ids", "SELECT client_id FROM clients")
def _csv(d: Domain) -> DataFrame:
    path = scratch_path(d.spark, "client-ids")
    d.clients.select("client_id", "age").write.option("header", True).csv(path)
    return sources.csv_client_ids(d.spark, path)


@query("s04_json_batch_ingest", "SELECT * FROM staged")
def _ingest(d: Domain) -> DataFrame:
    target = scratch_path(d.spark, "event-table")
    sources.ingest_event_files(d.spark, stage_events(d), target)
    return d.spark.read.parquet(target).select(*_STAGED)


def spoilt_lines(d: Domain) -> str:
    """Staged events, an event without an id, and for each tenth event a line that does not parse."""
    path = stage_events(d)
    d.events.filter(F.substring("event_id", -1, 1) == "0").select(F.concat(F.lit('{"event_id": "'), "event_id").alias("value")).write.mode("append").text(path)
    write_staged(d.events.filter(F.substring("event_id", -2, 2) == "11").withColumn("event_id", F.lit(None).cast("string")), path)
    return path


@query("s02_json_quarantine", """
SELECT CAST('accepted' AS VARCHAR) AS kind, event_id AS text, client_id FROM staged
UNION ALL SELECT 'accepted', NULL, client_id FROM staged WHERE event_id LIKE '%11'
UNION ALL SELECT 'rejected', '{"event_id": "' || event_id, NULL FROM staged WHERE event_id LIKE '%0'""")
def _quarantine(d: Domain) -> DataFrame:
    target = scratch_path(d.spark, "event-table")
    sources.ingest_event_files(d.spark, spoilt_lines(d), target)
    good = d.spark.read.parquet(target).select(F.lit("accepted").alias("kind"), F.col("event_id").alias("text"), "client_id")
    bad = d.spark.read.parquet(f"{target}_rejected").select(F.lit("rejected").alias("kind"), F.col("line").alias("text"), F.lit(None).cast("string").alias("client_id"))
    return good.unionByName(bad)


@query("s05_literal_rows_join", """
SELECT c.client_id, v.service_tier, v.weight FROM clients c
JOIN (VALUES ('Basic', 1), ('Premium', 2), ('Elite', 3)) v(service_tier, weight) ON v.service_tier = c.service_tier""")
def _literals(d: Domain) -> DataFrame:
    weights = sources.literal_rows(d.spark, [("Basic", 1), ("Premium", 2), ("Elite", 3)],
                                   "service_tier string, weight int")
    return d.clients.join(weights, "service_tier").select("client_id", "service_tier", "weight")


query("s07_create_table_as", "SELECT client_id, lifecycle_stage, age_segment FROM lifecycle"
      )(lambda d: sources.materialize(
          d.targets.select("client_id", "lifecycle_stage", "age_segment"), scratch_path(d.spark, "ctas")))


@query("s09_temporary_view", "SELECT service_tier, count(*) AS n FROM clients GROUP BY 1")
def _view(d: Domain) -> DataFrame:
    name = f"clients_{uuid.uuid4().hex}"
    sources.as_view(d.clients, name)
    return d.spark.sql(f"SELECT service_tier, count(*) AS n FROM {name} GROUP BY ALL")


@query("s11_table_copy", "SELECT * FROM orders")
def _copy(d: Domain) -> DataFrame:
    return sources.copy_table(d.spark, f"{d.folder}/orders.parquet", scratch_path(d.spark, "copy"))


@query("s12_append_log", "SELECT client_id, conversion_probability FROM daily UNION ALL SELECT client_id, conversion_probability FROM daily")
def _append(d: Domain) -> DataFrame:
    path = scratch_path(d.spark, "log")
    rows = d.daily.select("client_id", "conversion_probability")
    sources.append_rows(rows, path)
    sources.append_rows(rows, path)
    return d.spark.read.parquet(path)


@query("s14_insert_if_absent", "SELECT client_id, service_tier FROM clients")
def _absent(d: Domain) -> DataFrame:
    path = scratch_path(d.spark, "absent")
    rows = d.clients.select("client_id", "service_tier")
    first = sources.materialize(rows.filter("service_tier = 'Basic'"), path)
    sources.append_absent(rows, first, ["client_id"], path)
    return d.spark.read.parquet(path)


@query("f22_autoincrement", """
SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate >= DATE '1995-06-17', l_orderkey, l_linenumber) AS log_id FROM lineitem""")
def _autoincrement(d: Domain) -> DataFrame:
    """Two appends; the second one's ids go on from the first one's last."""
    path, lines = scratch_path(d.spark, "autoincrement"), d.raw("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    late = F.col("l_shipdate") >= F.lit("1995-06-17").cast("date")
    for part in (~late, late):
        append_numbered(lines.filter(part), path, ["l_orderkey", "l_linenumber"], "log_id")
    return d.spark.read.parquet(path).drop("l_shipdate")


def _scratch_table(d: Domain) -> tuple[str, str]:
    name = f"tidemark_{uuid.uuid4().hex}"
    return name, scratch_path(d.spark, name)


@query("s15_replace_day", f"SELECT client_id, recommended_action, CAST({NOW} AS DATE) AS prediction_date FROM daily")
def _replace(d: Domain) -> DataFrame:
    table, location = _scratch_table(d)
    scoring.run_daily_scoring(d.store, table, d.now, location=location)
    scoring.run_daily_scoring(d.store, table, d.now)
    return d.spark.table(table).select("client_id", "recommended_action", "prediction_date")


def _history_table(d: Domain) -> str:
    table, location = _scratch_table(d)
    dated = d.events.select("event_id", "event_timestamp", "channel", F.to_date("event_timestamp").alias("day"))
    sources.replace_days(dated, table, "day", location)
    return table


@query("s16_retention_delete", f"SELECT event_id, event_timestamp, channel FROM marketing_events WHERE event_timestamp >= TIMESTAMP '2024-01-05 12:00:00'")
def _retention(d: Domain) -> DataFrame:
    table = _history_table(d)
    sources.drop_days_before(d.spark, table, "day", "event_timestamp", datetime(2024, 2, 4, 12))
    return d.spark.table(table).drop("day")


@query("s17_conditional_update", """
SELECT event_id, event_timestamp, CASE WHEN event_timestamp >= TIMESTAMP '2024-01-20 00:00:00' AND channel = 'Other' THEN 'Unknown' ELSE channel END AS channel
FROM marketing_events""")
def _update(d: Domain) -> DataFrame:
    table = _history_table(d)
    late = F.col("event_timestamp") >= at(datetime(2024, 1, 20))
    sources.update_days(d.spark, table, "day", late & (F.col("channel") == "Other"), {"channel": F.lit("Unknown")})
    return d.spark.table(table).drop("day")


@query("o07_sorted_table", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def _sorted(d: Domain) -> DataFrame:
    path = scratch_path(d.spark, "sorted")
    sources.write_sorted(d.raw("orders").select("o_orderkey", "o_orderdate", "o_totalprice"), path,
                         ["o_orderdate", "o_orderkey"])
    return d.spark.read.parquet(path)


@query("s18_default_columns", """
SELECT event_type, conversion_flag, count(*) AS events, count(event_category) AS categories, max(event_timestamp) AS newest
FROM (SELECT event_type, CASE WHEN channel = 'Email' THEN conversion_flag ELSE false END AS conversion_flag, CAST(NULL AS VARCHAR) AS event_category, event_timestamp FROM marketing_events)
GROUP BY 1, 2""")
def _defaults(d: Domain) -> DataFrame:
    """INSERTs that name all or some of the columns, read through a stored view."""
    table, location = _scratch_table(d)
    create_table(d.spark, "marketing_events", table, location)
    sources.as_view(d.events.select("event_id", "client_id", "event_type", "event_timestamp", "channel", "conversion_flag"), f"{table}_new")
    d.spark.sql(f"""INSERT INTO {table} (event_id, client_id, event_type, event_timestamp, conversion_flag)
        SELECT event_id, client_id, event_type, event_timestamp, conversion_flag FROM {table}_new WHERE channel = 'Email'""")
    d.spark.sql(f"INSERT INTO {table} (event_id, event_timestamp, event_type) SELECT event_id, event_timestamp, event_type FROM {table}_new WHERE channel <> 'Email' OR channel IS NULL")
    return sources.stored_view(d.spark, f"{table}_view", f"""SELECT event_type, conversion_flag, count(*) AS events, count(event_category) AS categories,
        max(event_timestamp) AS newest FROM {table} GROUP BY ALL""")


@query("s19_catalog_columns", """
SELECT 'clients' AS table_name, count(*) AS rows, (SELECT CAST(len(json_keys(to_json(c))) AS BIGINT) FROM clients c LIMIT 1) AS columns FROM clients""")
def _catalog(d: Domain) -> DataFrame:
    listing = sources.table_columns(d.clients, "clients")
    width = listing.groupBy("table_name").agg(F.count("*").alias("columns"))
    return attach_row(width, d.clients.agg(F.count("*").alias("rows")))


# --------------------------------------------------------------------------
# Projection, filter, predicates
# --------------------------------------------------------------------------

_P03 = ("total_events_30d", "web_visits_30d", "email_opens_30d")
query("p01_projection_rename", "SELECT o_orderkey AS order_id, o_totalprice AS amount FROM orders"
      )(lambda d: d.raw("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount")))
query("p03_generated_columns", f"SELECT client_id, {', '.join(_P03)} FROM store WHERE {' AND '.join(c + ' IS NOT NULL' for c in _P03)}"
      )(lambda d: d.store.select("client_id", *_P03).filter(reduce(and_, [F.col(c).isNotNull() for c in _P03])))
query("p04_predicates", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem
WHERE (l_quantity > 40 OR l_discount <= 0.02) AND l_returnflag <> 'N' AND l_linestatus IN ('O', 'F') AND l_tax BETWEEN 0.01 AND 0.05"""
      )(lambda d: d.raw("lineitem").filter(
          ((F.col("l_quantity") > 40) | (F.col("l_discount") <= 0.02)) & (F.col("l_returnflag") != "N")
          & F.col("l_linestatus").isin("O", "F") & F.col("l_tax").between(0.01, 0.05)
      ).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"))
query("p07_null_flags", """
SELECT channel, count(*) FILTER (WHERE touchpoint_value IS NULL OR conversion_flag IS NULL OR time_on_page IS NULL) AS any_missing,
 count(*) FILTER (WHERE conversion_flag IS NOT NULL) AS known FROM marketing_events GROUP BY 1"""
      )(lambda d: d.events.groupBy("channel").agg(
          F.count_if(F.greatest(*[F.col(c).isNull() for c in ("touchpoint_value", "conversion_flag", "time_on_page")])).alias("any_missing"),
          F.count_if(F.col("conversion_flag").isNotNull()).alias("known")))
query("p08_like_patterns", """
SELECT p_partkey, p_name FROM part WHERE p_type LIKE 'A%' OR p_name LIKE '%1_' OR p_brand LIKE '%3%'"""
      )(lambda d: d.raw("part").filter(
          F.col("p_type").like("A%") | F.col("p_name").like("%1_") | F.col("p_brand").like("%3%")).select("p_partkey", "p_name"))
query("p09_not_equal_drops_null", "SELECT event_id FROM marketing_events WHERE conversion_flag <> true"
      )(lambda d: d.events.filter(F.col("conversion_flag") != F.lit(True)).select("event_id"))
query("p10_relative_time", f"SELECT event_id, event_timestamp FROM marketing_events WHERE event_timestamp >= {back(20, 6)}"
      )(lambda d: d.events.filter(F.col("event_timestamp") >= days_back(d.now, days=20, hours=6)).select("event_id", "event_timestamp"))
query("p11_same_day", "SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'"
      )(lambda d: d.raw("events").filter(same_day(F.col("ts"), datetime(2024, 1, 15, 9))).select("event_id", "ts"))
query("p12_searched_case", """
SELECT CASE WHEN l_quantity >= 40 THEN 'large' WHEN l_quantity >= 20 THEN 'medium' ELSE 'small' END AS size, count(*) AS n FROM lineitem GROUP BY 1"""
      )(lambda d: d.raw("lineitem").groupBy(first_match([
          (F.col("l_quantity") >= 40, "large"), (F.col("l_quantity") >= 20, "medium")], "small").alias("size")).agg(F.count("*").alias("n")))
query("p13_code_mapping", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS code FROM orders"""
      )(lambda d: d.raw("orders").select("o_orderkey", code_map(F.col("o_orderstatus"), {"O": 1, "F": 2}).alias("code")))


@query("p14_lateral_alias", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem""")
def _alias(d: Domain) -> DataFrame:
    return d.spark.sql(
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, net * (1 + l_tax) AS gross FROM {lineitem}",
        lineitem=d.raw("lineitem"))


query("p15_with_column_drop", "SELECT * EXCLUDE (c_name), c_acctbal * 2 AS doubled FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"
      )(lambda d: d.raw("customer").withColumn("doubled", F.col("c_acctbal") * 2).drop("c_name").filter(
          F.col("c_mktsegment").isin("BUILDING", "MACHINERY")))
query("p16_bernoulli_sample", f"SELECT client_id FROM clients WHERE {uniform('client_id', 'sample')} < 0.25e0"
      )(lambda d: hash_sample(d.clients, "client_id", 0.25).select("client_id"))

# --------------------------------------------------------------------------
# Joins
# --------------------------------------------------------------------------

query("j01_left_join", """
SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000"""
      )(lambda d: d.raw("customer").join(
          d.raw("orders").filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left"
      ).select("c_custkey", "c_name", "o_orderkey", "o_totalprice"))
query("j02_inner_join", f"""
SELECT c.c_mktsegment, count(*) AS lines, {msum('l.l_extendedprice')} AS amount FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1"""
      )(lambda d: d.raw("lineitem").join(d.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(
          d.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(
          F.count("*").alias("lines"), money_sum(F.col("l_extendedprice")).alias("amount")))
query("j03_latest_per_key", """
SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)"""
      )(lambda d: latest_rows(d.raw("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate"))
query("j04_left_range_count", f"""
SELECT c.client_id, count(e.event_id) AS recent FROM clients c LEFT JOIN marketing_events e ON e.client_id = c.client_id
 AND e.event_timestamp >= {back(30)} GROUP BY 1"""
      )(lambda d: d.clients.select("client_id").join(
          d.events.filter(F.col("event_timestamp") >= days_back(d.now, days=30)).groupBy("client_id").agg(F.count("event_id").alias("recent")),
          "client_id", "left").select("client_id", F.coalesce("recent", F.lit(0)).alias("recent")))
query("j05_one_row_pairing", """
SELECT c_mktsegment, n, total, n / total AS share FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), (SELECT count(*) AS total FROM customer)"""
      )(lambda d: attach_row(
          d.raw("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), d.raw("customer").agg(F.count("*").alias("total"))
      ).withColumn("share", ratio(F.col("n"), F.col("total"))))
query("j06_left_on_true", """
SELECT c_mktsegment, count(*) AS n, CAST(NULL AS DOUBLE) AS biggest FROM customer GROUP BY 1"""
      )(lambda d: attach_row(
          d.raw("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")),
          top_rows(d.raw("orders").filter("o_totalprice < 0").select(F.col("o_totalprice").alias("biggest")), [F.col("biggest")], 1),
          required=False))
query("j07_lateral_struct", """
SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS saved, l_quantity > 25 AS bulk FROM lineitem"""
      )(lambda d: d.raw("lineitem").withColumn("pred", F.struct(
          (F.col("l_extendedprice") * F.col("l_discount")).alias("saved"), (F.col("l_quantity") > 25).alias("bulk"))
      ).select("l_orderkey", "l_linenumber", "pred.*"))
query("j08_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)"
      )(lambda d: not_in(d.raw("customer").select("c_custkey"), d.raw("orders").filter("o_totalprice > 150000").select(
          F.col("o_custkey").alias("c_custkey")), "c_custkey"))
query("j08_not_in_null_right", """
SELECT client_id FROM clients WHERE client_id NOT IN (SELECT CASE WHEN touchpoint_value IS NULL THEN NULL ELSE client_id END FROM marketing_events)"""
      )(lambda d: not_in(d.clients.select("client_id"), d.events.select(
          F.when(F.col("touchpoint_value").isNotNull(), F.col("client_id")).alias("client_id")), "client_id"))
query("j09_not_exists", """
SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')"""
      )(lambda d: not_exists(d.raw("customer").select("c_custkey"), d.raw("orders").filter("o_orderstatus = 'F'").select(
          F.col("o_custkey").alias("c_custkey")), ["c_custkey"]))
query("j10_scalar_subqueries", """
SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT max(o_totalprice) FROM orders) AS biggest"""
      )(lambda d: one_row(d.spark, customers=d.raw("customer").agg(F.count("*")).scalar(), orders=d.raw("orders").agg(F.count("*")).scalar(),
                          biggest=d.raw("orders").agg(F.max("o_totalprice")).scalar()))
query("j11_features_with_label_by_key", """
SELECT s.client_id, s.engagement_score_30d, t.conversion_target FROM store s JOIN targets t ON t.client_id = s.client_id"""
      )(lambda d: d.store.select("client_id", "engagement_score_30d").join(d.targets.select("client_id", "conversion_target"), "client_id"))

CTES["order_spine"] = """
SELECT o_orderkey AS spine_id, 'client_' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS client_id,
 TIMESTAMP '2023-06-01 00:00:00' + INTERVAL '10' MINUTE * (o_orderkey % 36000) AS moment FROM orders"""
CTES["touch_features"] = """
SELECT client_id, event_timestamp AS moment, max(event_id) AS last_event_id FROM marketing_events GROUP BY 1, 2"""


def _order_spine(d: Domain) -> DataFrame:
    key = F.col("o_orderkey")
    step = F.make_dt_interval(mins=(key % 36000 * 10).cast("int"))
    return d.raw("orders").select(
        key.alias("spine_id"),
        F.concat(F.lit("client_"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("client_id"),
        (at(datetime(2023, 6, 1)) + step).alias("moment"))


query("j12_as_of_join", """
SELECT s.spine_id, s.client_id, s.moment, f.moment AS matched_feature_timestamp, f.last_event_id
FROM order_spine s ASOF LEFT JOIN touch_features f ON f.client_id = s.client_id AND f.moment <= s.moment"""
      )(lambda d: as_of_join(_order_spine(d), d.events.select(
          "client_id", F.col("event_timestamp").alias("moment"), F.col("event_id").alias("last_event_id")),
          "client_id", "moment", "moment", ["last_event_id"]))
query("j12_training_dataset", """
SELECT s.client_id, s.feature_timestamp, s.conversion_target, f.feature_timestamp AS matched_feature_timestamp, f.engagement_score_30d, f.annual_income
FROM (SELECT client_id, feature_timestamp - INTERVAL '10' DAY AS feature_timestamp, conversion_target FROM store_history) s
ASOF LEFT JOIN store_history f ON f.client_id = s.client_id AND f.feature_timestamp <= s.feature_timestamp"""
      )(lambda d: _training_dataset(sources.materialize(d.store_history, scratch_path(d.spark, "store-history"))))


def _training_dataset(history: DataFrame) -> DataFrame:
    moment = F.col("feature_timestamp") - F.expr("INTERVAL '10' DAY")
    spine = history.select("client_id", moment.alias("feature_timestamp"), "conversion_target")
    return catalog.training_dataset(spine, history, ["engagement_score_30d", "annual_income"])


CTES["daily_activity"] = """
SELECT client_id, CAST(CAST(event_timestamp AS DATE) AS TIMESTAMP) + INTERVAL '1' DAY AS known_at, count(*) AS day_events, max(event_timestamp) AS last_seen
FROM marketing_events GROUP BY 1, 2"""
CTES["store_versions"] = "SELECT client_id, feature_timestamp - INTERVAL '20' DAY AS valid_from, engagement_score_30d, annual_income, total_events_30d AS day_events FROM store_history"


def _registry(d: Domain) -> catalog.FeatureRegistry:
    """Two views of one client entity: activity known the day after, and the store's monthly versions."""
    history = sources.materialize(d.store_history, scratch_path(d.spark, "store-history"))
    activity, versions = f"activity_{uuid.uuid4().hex}", f"versions_{uuid.uuid4().hex}"
    sources.as_view(d.events.select("client_id", "event_timestamp"), activity)
    sources.as_view(history, versions)
    found = catalog.FeatureRegistry(d.spark, scratch_path(d.spark, "feature-registry"))
    for _ in range(2):  # what is there already is not registered again
        found.register_entity("CLIENT", ["client_id"], "A client", d.now)
        found.register_view("DAILY_ACTIVITY", "1.0", "CLIENT", "known_at", f"""
            SELECT client_id, CAST(date_add(to_date(event_timestamp), 1) AS TIMESTAMP_NTZ) AS known_at, count(*) AS day_events, max(event_timestamp) AS last_seen
            FROM {activity} GROUP BY ALL""", "Events of a day", d.now)
        found.register_view("STORE_VERSIONS", "1.0", "CLIENT", "valid_from", f"""
            SELECT client_id, feature_timestamp - INTERVAL '20' DAY AS valid_from, engagement_score_30d, annual_income, total_events_30d AS day_events
            FROM {versions}""", "The store, month by month", d.now)
    return found


query("j12_registered_views", """
SELECT s.spine_id, s.client_id, s.moment, a.known_at AS "DAILY_ACTIVITY_timestamp", a.day_events AS "DAILY_ACTIVITY_day_events", a.last_seen,
 v.valid_from AS "STORE_VERSIONS_timestamp", v.engagement_score_30d, v.annual_income, v.day_events AS "STORE_VERSIONS_day_events"
FROM order_spine s ASOF LEFT JOIN daily_activity a ON a.client_id = s.client_id AND a.known_at <= s.moment
ASOF LEFT JOIN store_versions v ON v.client_id = s.client_id AND v.valid_from <= s.moment"""
      )(lambda d: _registry(d).dataset(_order_spine(d), [("DAILY_ACTIVITY", "1.0"), ("STORE_VERSIONS", "1.0")], "moment"))


@query("m12_feature_registry", f"""
SELECT 'DAILY_ACTIVITY' AS name, '1.0' AS version, 'CLIENT' AS entity, 'client_id' AS join_key, 'known_at' AS timestamp_col, 'ACTIVE' AS status, {NOW} AS created_on,
 count(*) AS rows, count(DISTINCT client_id) AS clients, min(known_at) AS earliest, max(known_at) AS latest FROM daily_activity
UNION ALL SELECT 'STORE_VERSIONS', '1.0', 'CLIENT', 'client_id', 'valid_from', 'ACTIVE', {NOW}, count(*), count(DISTINCT client_id), min(valid_from), max(valid_from) FROM store_versions""")
def _registered(d: Domain) -> DataFrame:
    """The registry's rows beside what each view's query gives."""
    registry, found = _registry(d), None
    for name in ("DAILY_ACTIVITY", "STORE_VERSIONS"):
        view, keys = registry.view(name, "1.0")
        at_ = F.col(view.timestamp)
        measured = view.frame.agg(F.count("*").alias("rows"), F.count_distinct(*keys).alias("clients"), F.min(at_).alias("earliest"), F.max(at_).alias("latest"))
        measured = measured.withColumn("name", F.lit(name))
        found = measured if found is None else found.unionByName(measured)
    views = registry.views().withColumn("entity", F.explode("entities"))
    keys = registry.entities().select(F.col("name").alias("entity"), F.explode("join_keys").alias("join_key"))
    return views.select("name", "version", "entity", "timestamp_col", "status", "created_on").join(keys, "entity").join(found, "name")


# --------------------------------------------------------------------------
# Aggregation
# --------------------------------------------------------------------------

query("a01_global_aggregate", f"""
SELECT count(*) AS n, {msum('l_extendedprice')} AS total, min(l_quantity) AS least, max(l_quantity) AS most, avg(l_quantity) AS mean FROM lineitem"""
      )(lambda d: d.raw("lineitem").agg(F.count("*").alias("n"), money_sum(F.col("l_extendedprice")).alias("total"),
                                        F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.avg("l_quantity").alias("mean")))
query("a03_group_by_keys", """
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2"""
      )(lambda d: d.raw("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")))
query("a04_group_by_expression", """
SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"""
      )(lambda d: d.raw("events").groupBy(floor_day(F.col("ts")).alias("day"), "event_type").agg(F.count("*").alias("n")))


@query("a05_group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def _group_all(d: Domain) -> DataFrame:
    return d.spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ALL", orders=d.raw("orders"))


query("a07_conditional_aggregates", f"""
SELECT client_id, count(*) AS n, count(touchpoint_value) AS known, count(CASE WHEN event_type = 'web_visit' THEN 1 END) AS visits,
 {xsum("CASE WHEN channel = 'Email' THEN touchpoint_value END")} AS email_value,
 avg(CASE WHEN time_on_page > 100 THEN time_on_page END) AS long_mean, count(DISTINCT CASE WHEN event_timestamp >= {back(90)} THEN CAST(event_timestamp AS DATE) END) AS active_days
FROM marketing_events GROUP BY 1"""
      )(lambda d: d.events.groupBy("client_id").agg(
          F.count("*").alias("n"), F.count("touchpoint_value").alias("known"), F.count_if(F.col("event_type") == "web_visit").alias("visits"),
          exact_sum(F.when(F.col("channel") == "Email", F.col("touchpoint_value"))).alias("email_value"), F.avg(F.when(F.col("time_on_page") > 100, F.col("time_on_page"))).alias("long_mean"),
          F.count_distinct(F.when(F.col("event_timestamp") >= days_back(d.now, days=90), F.to_date("event_timestamp"))).alias("active_days")))


query("a10_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1"
      )(lambda d: d.raw("orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers")))
query("a12_sample_deviation", f"SELECT event_type, {rnd('stddev_samp(value)', 6)} AS deviation FROM events GROUP BY 1"
      )(lambda d: d.raw("events").groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("deviation")))
query("a13_median", f"SELECT event_type, {rnd('median(value)', 6)} AS median FROM events GROUP BY 1"
      )(lambda d: exact_quantile(d.raw("events"), "value", 0.5, ["event_type"], "median").withColumn("median", F.round("median", 6)))
query("a14_percentile", f"SELECT l_returnflag, {rnd('quantile_cont(l_extendedprice, 0.95)', 6)} AS p95 FROM lineitem GROUP BY 1"
      )(lambda d: exact_quantile(d.raw("lineitem"), "l_extendedprice", 0.95, ["l_returnflag"], "p95", accuracy=1000).withColumn("p95", F.round("p95", 6)))
query("a15_percentage", f"""
SELECT o_orderpriority, {rnd("count(*) FILTER (WHERE o_orderstatus = 'F') * 100e0 / count(*)", 2)} AS finished_pct,
 count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*) FILTER (WHERE o_totalprice < 0), 0) AS undefined_ratio FROM orders GROUP BY 1"""
      )(lambda d: d.raw("orders").groupBy("o_orderpriority").agg(
          percent(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("finished_pct"),
          ratio(F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_totalprice") < 0)).alias("undefined_ratio")))
query("a16_aggregate_arithmetic", f"""
SELECT o_orderstatus, count(*) - count(DISTINCT o_custkey) AS repeats, {days('min(o_orderdate)', 'max(o_orderdate)')} AS span,
 {msum('o_totalprice')} - count(*) * 100 AS net FROM orders GROUP BY 1"""
      )(lambda d: d.raw("orders").groupBy("o_orderstatus").agg(
          (F.count("*") - F.count_distinct("o_custkey")).alias("repeats"), days_between(F.min("o_orderdate"), F.max("o_orderdate")).alias("span"),
          (money_sum(F.col("o_totalprice")) - F.count("*") * 100).alias("net")))
query("a17_packed_aggregates", """
SELECT event_type, '{"high":' || count(*) FILTER (WHERE value > 100) || ',"low":' || count(*) FILTER (WHERE value <= 100) || '}' AS distribution FROM events GROUP BY 1"""
      )(lambda d: d.raw("events").groupBy("event_type").agg(F.to_json(F.struct(
          F.count_if(F.col("value") > 100).alias("high"), F.count_if(F.col("value") <= 100).alias("low"))).alias("distribution")))
query("a18_first_last_rows", f"""
SELECT 'first' AS side, {xavg('value')} AS mean FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 500)
UNION ALL SELECT 'last', {xavg('value')} FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 500)"""
      )(lambda d: reduce(DataFrame.unionByName, [
          first_rows(d.raw("events"), "ts", 500, newest, "event_id").agg(exact_avg(F.col("value")).alias("mean")).select(
              F.lit("last" if newest else "first").alias("side"), "mean") for newest in (False, True)]))
query("a19_distinct", "SELECT DISTINCT channel, device_type FROM marketing_events"
      )(lambda d: d.events.select("channel", "device_type").distinct())
query("a20_recency", f"SELECT client_id, max(event_timestamp) AS last_seen, {days('max(event_timestamp)', NOW)} AS days_ago FROM marketing_events GROUP BY 1"
      )(lambda d: d.events.groupBy("client_id").agg(F.max("event_timestamp").alias("last_seen"), days_between(F.max("event_timestamp"), at(d.now)).alias("days_ago")))

# --------------------------------------------------------------------------
# Windows, sort, set operations
# --------------------------------------------------------------------------

CTES["per_day"] = "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1"


def _per_day(d: Domain) -> DataFrame:
    return d.raw("events").groupBy(floor_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


query("w01_row_number", "SELECT day, n, CAST(row_number() OVER (ORDER BY n DESC, day) AS INTEGER) AS place FROM per_day"
      )(lambda d: numbered(_per_day(d), [F.col("n").desc(), "day"], "place").withColumn("place", F.col("place").cast("int")))
query("w02_lag_change", """
SELECT day, n, lag(n) OVER (ORDER BY day) AS previous, abs(n - lag(n) OVER (ORDER BY day)) AS change FROM per_day"""
      )(lambda d: _per_day(d).withColumn("previous", F.lag("n").over(Window.orderBy("day"))).withColumn("change", F.abs(F.col("n") - F.col("previous"))))
query("o01_order_by_aggregate", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC"
      )(lambda d: d.raw("events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc()))
query("o02_multi_key_sort", "SELECT o_custkey, o_totalprice, o_orderkey FROM orders ORDER BY o_custkey DESC, o_totalprice"
      )(lambda d: d.raw("orders").select("o_custkey", "o_totalprice", "o_orderkey").orderBy(F.col("o_custkey").desc(), "o_totalprice"))
query("o03_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"
      )(lambda d: top_rows(d.raw("orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25))
query("o04_latest_row", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 1"
      )(lambda d: latest_row(d.raw("events").select("event_id", "ts"), "ts", "event_id"))
query("o06_limit_then_sort", "SELECT * FROM (SELECT day, n FROM per_day ORDER BY day DESC LIMIT 7) ORDER BY day"
      )(lambda d: top_rows(_per_day(d), [F.col("day").desc()], 7).orderBy("day"))
query("u01_union_metric_rows", """
SELECT 'orders' AS metric, count(*) AS value FROM orders UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'parts', count(*) FROM part"""
      )(lambda d: metric_rows(d.raw("orders"), {"orders": F.count("*"), "customers": F.count_distinct("o_custkey")}).unionByName(
          metric_rows(d.raw("part"), {"parts": F.count("*")})))
query("u02_unpivot_statistics", f"""
SELECT 'l_quantity' AS feature_name, avg(l_quantity) AS mean FROM lineitem UNION ALL SELECT 'l_linenumber', avg(l_linenumber) FROM lineitem"""
      )(lambda d: unpivot_doubles(d.raw("lineitem").agg(F.avg("l_quantity").alias("l_quantity"), F.avg("l_linenumber").alias("l_linenumber")),
                                  ["l_quantity", "l_linenumber"]).withColumnRenamed("value", "mean"))

# --------------------------------------------------------------------------
# Scalar functions
# --------------------------------------------------------------------------

query("f01_arithmetic_rounding", f"""
SELECT l_orderkey, l_linenumber, -l_quantity AS negated, {rnd('l_extendedprice / 7', 2)} AS weekly, abs(l_tax - l_discount) AS gap,
 least(l_tax, l_discount) AS lower, greatest(l_tax, l_discount) AS upper FROM lineitem"""
      )(lambda d: d.raw("lineitem").select(
          "l_orderkey", "l_linenumber", (-F.col("l_quantity")).alias("negated"), F.round(F.col("l_extendedprice") / 7, 2).alias("weekly"),
          F.abs(F.col("l_tax") - F.col("l_discount")).alias("gap"), least_strict("l_tax", "l_discount").alias("lower"), greatest_strict("l_tax", "l_discount").alias("upper")))
query("f03_strict_bounds", """
SELECT c.client_id, CASE WHEN e.total_events_30d IS NULL THEN NULL ELSE greatest(e.total_events_30d, 1) END AS at_least_one,
 CASE WHEN e.total_events_30d IS NULL THEN NULL ELSE least(e.total_events_30d, 40) END AS at_most_forty
FROM clients c LEFT JOIN engagement e ON e.client_id = c.client_id"""
      )(lambda d: d.clients.select("client_id").join(d.engagement.select("client_id", "total_events_30d"), "client_id", "left").select(
          "client_id", greatest_strict("total_events_30d", F.lit(1).cast("bigint")).alias("at_least_one"),
          least_strict("total_events_30d", F.lit(40).cast("bigint")).alias("at_most_forty")))
query("f05_logs_and_powers", f"""
SELECT p_partkey, {rnd('ln(p_retailprice)', 6)} AS logged, {rnd('exp(p_size / 10)', 6)} AS grown, {rnd('power(p_size, 2)', 6)} AS squared,
 {rnd('1 / (1 + exp(-0.1e0 * (p_size - 10)))', 6)} AS logistic FROM part"""
      )(lambda d: d.raw("part").select("p_partkey", F.round(F.ln("p_retailprice"), 6).alias("logged"), F.round(F.exp(F.col("p_size") / 10), 6).alias("grown"),
                                       F.round(F.pow("p_size", F.lit(2)), 6).alias("squared"), F.round(squash(F.col("p_size"), 0.1, 10.0), 6).alias("logistic")))
query("f07_null_functions", """
SELECT event_id, coalesce(touchpoint_value, 0.5e0) AS filled, nullif(channel, 'Other') AS known_channel, CAST(coalesce(conversion_flag, false) AS INTEGER) AS converted
FROM marketing_events""")(lambda d: d.events.select(
          "event_id", F.coalesce("touchpoint_value", F.lit(0.5)).alias("filled"), F.nullif(F.col("channel"), F.lit("Other")).alias("known_channel"),
          F.coalesce("conversion_flag", F.lit(False)).cast("int").alias("converted")))
query("f09_casts", """
SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, TRY_CAST(event_type AS INTEGER) AS not_a_number, CAST(value AS VARCHAR) IS NOT NULL AS has_text
FROM events""")(lambda d: d.raw("events").select(
          "event_id", F.col("props").try_cast("string").alias("p"), F.col("event_type").try_cast("int").alias("not_a_number"),
          F.col("value").cast("string").isNotNull().alias("has_text")).withColumn("k", F.get_json_object("p", "$.k").try_cast("int")).drop("p"))
query("f10_variant_access", """
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events"""
      )(lambda d: d.raw("events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k")))
query("f11_text_keys", """
SELECT c_custkey, 'client_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS client_id, c_name || ' / ' || c_mktsegment AS label FROM customer"""
      )(lambda d: d.raw("customer").select("c_custkey", F.concat(F.lit("client_"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("client_id"),
                                           F.concat_ws(" / ", "c_name", "c_mktsegment").alias("label")))
query("f14_date_arithmetic", f"""
SELECT event_id, event_timestamp - INTERVAL '90' MINUTE AS earlier, CAST(event_timestamp AS DATE) AS day, date_trunc('hour', event_timestamp) AS hour,
 {days('event_timestamp', NOW)} AS days_ago FROM marketing_events"""
      )(lambda d: d.events.select("event_id", (F.col("event_timestamp") - F.expr("INTERVAL '90' MINUTE")).alias("earlier"), F.to_date("event_timestamp").alias("day"),
                                  floor_hour(F.col("event_timestamp")).alias("hour"), days_between(F.col("event_timestamp"), at(d.now)).alias("days_ago")))
query("f18_one_hot", """
SELECT client_id, CASE WHEN service_tier = 'Elite' THEN 1 ELSE 0 END AS tier_elite, CASE WHEN service_tier = 'Basic' THEN 1 ELSE 0 END AS tier_basic FROM clients"""
      )(lambda d: d.clients.select("client_id", *[flag(F.col("service_tier") == t).alias(f"tier_{t.lower()}") for t in ("Elite", "Basic")]))
query("f19_arrays", """
SELECT client_id, 3 AS size, CAST(age AS DOUBLE) AS first, CAST(client_tenure_months AS DOUBLE) AS third FROM clients"""
      )(lambda d: d.clients.select("client_id", F.array(*[F.col(c).cast("double") for c in ("age", "annual_income", "client_tenure_months")]).alias("a")).select(
          "client_id", F.size("a").alias("size"), F.element_at("a", 1).alias("first"), F.get("a", F.lit(2)).alias("third")))
query("f20_object_and_path", """
SELECT client_id, '{"age":' || age || ',"tier":"' || service_tier || '"}' AS record, service_tier AS tier FROM clients"""
      )(lambda d: d.clients.select("client_id", F.to_json(F.struct("age", F.col("service_tier").alias("tier"))).alias("record")).withColumn(
          "tier", F.get_json_object("record", "$.tier")))
query("f23_hash_uniform", f"SELECT client_id, {uniform('client_id', 'draw')} AS u, CASE WHEN {uniform('client_id', 'coin')} < 0.3e0 THEN 1 ELSE 0 END AS coin FROM clients"
      )(lambda d: d.clients.select("client_id", hash_uniform(F.col("client_id"), "draw").alias("u"), bernoulli(F.col("client_id"), "coin", F.lit(0.3)).alias("coin")))
