"""Functions and jobs called from SQL, catalog tables with defaults, stored views, bucketed tables."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from frames import NOW
from tidemark import schemas, sources
from tidemark.plans import monitoring, scoring, sql_functions


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_sql_scorers_equal_the_column_scorers(spark):
    sql_functions.register_scorers(spark)
    rng = random.Random(4)
    pick = lambda values: rng.choice([None, *values])
    rows = [(pick([0.2, 0.35, 0.4, 0.5, 0.6, 0.61, 0.9]), pick([50_000, 75_000, 75_001, 100_000, 100_001, 150_001]), pick([0.0, 50_000.0, 50_001.0, 75_001.0]),
             pick([30, 35, 45, 55, 56]), pick([1, 2, 3]), pick([0, 29, 30, 61])) for _ in range(400)]
    frame = spark.createDataFrame(rows, "e double, i int, b double, a int, t int, d int").withColumn("n", F.monotonically_increasing_id())
    cols = [F.col(c) for c in "eibatd"]
    frame.createOrReplaceTempView("inputs")
    want = frame.select("n", scoring.batch_rule(*cols).alias("x"), scoring.fallback_tiered(*cols[:3]).alias("y"),
                        scoring.likelihood_band(F.col("e")).alias("z")).orderBy("n")
    got = spark.sql("SELECT n, predict_conversion(e, i, b, a, t, d) AS x, predict_conversion_fallback(e, i, b) AS y, conversion_likelihood(e) AS z FROM inputs ORDER BY n")
    assert got.collect() == want.collect()
    assert "Python" not in plan_of(got) and "Arrow" not in plan_of(got)


def test_sql_array_scores_equal_the_column_scores(spark):
    sql_functions.register_scorers(spark)
    rng = random.Random(5)
    arrays = [[rng.choice([None, 0.0, 6.0, 12.0, 30.0, 60_000.0, 80_000.0, 160_000.0]) for _ in range(30)] for _ in range(300)] + [[], [1.0] * 7, [1.0] * 31, None]
    frame = spark.createDataFrame([(n, a) for n, a in enumerate(arrays)], "n int, features array<double>")
    frame.createOrReplaceTempView("arrays")
    want = frame.select("n", scoring.logistic_score(F.col("features")).alias("l"), scoring.points_score(F.col("features")).alias("p")).orderBy("n")
    got = spark.sql("SELECT n, logistic_score(features) AS l, points_score(features) AS p FROM arrays ORDER BY n")
    for a, b in zip(got.collect(), want.collect()):
        assert (a.l, a.p) == (pytest.approx(b.l), pytest.approx(b.p)), a.n


def test_jobs_from_sql(spark):
    spark.createDataFrame([("a", 1, 1), ("b", 0, 1), ("c", 1, 1), ("d", 1, 0)], "client_id string, prediction int, actual_conversion int").createOrReplaceTempView("job_preds")
    performance = spark.createDataFrame([("ACCURACY", 0.6, NOW), ("ACCURACY", 0.1, NOW.replace(year=2020)), ("F1", 0.0, NOW)], "metric_name string, metric_value double, evaluation_timestamp timestamp_ntz")
    drift = spark.createDataFrame([(2.5, NOW), (9.0, NOW.replace(year=2020))], "drift_score double, check_timestamp timestamp_ntz")
    performance.createOrReplaceTempView("job_performance")
    drift.createOrReplaceTempView("job_drift")
    store = spark.createDataFrame([("a", "Active", 0.9, 200_000, 1e5, 40, 3, 1), ("b", "Dormant", 0.9, 200_000, 1e5, 40, 3, 1), ("c", None, 0.1, 1, 1.0, 40, 1, 90)],
                                  "client_id string, lifecycle_stage string, engagement_score_30d double, annual_income int, current_401k_balance double, age int, service_tier_numeric int, days_since_last_activity int")
    store.createOrReplaceTempView("job_store")
    sql_functions.register_jobs(spark, "job_store", "job_preds", "job_performance", "job_drift")
    assert spark.sql("SELECT * FROM performance_check(0.9D, 0.1D)").collect() == monitoring.check_model_performance(spark.table("job_preds"), 0.9).collect()
    for floor, ceiling in ((0.65, 2.0), (0.5, 2.0), (0.5, 3.0)):
        got = spark.sql(f"SELECT * FROM alert_check(TIMESTAMP_NTZ '{NOW}', {floor}D, {ceiling}D)").collect()
        assert got == monitoring.check_alerts(performance, drift, NOW, floor, ceiling).collect()
    days = [date(2024, 5, 1), date(2024, 5, 2), date(2024, 5, 2)]
    assert [sql_functions.run_daily_scoring_sql(spark, "job_daily", day) for day in days] == [1, 1, 1]
    stored = spark.table("job_daily").orderBy("prediction_date").collect()
    assert [(r.client_id, r.prediction_date, r.conversion_probability, r.conversion_likelihood) for r in stored] == [
        ("a", date(2024, 5, 1), 0.85, "High"), ("a", date(2024, 5, 2), 0.85, "High")]
    assert stored[0].prediction_timestamp == datetime(2024, 5, 1)


def test_catalog_fills_left_out_columns(spark, tmp_path):
    name = schemas.create_table(spark, "feature_views", "t_views", str(tmp_path / "views"))
    assert schemas.create_table(spark, "feature_views", "t_views") == name
    spark.sql("INSERT INTO t_views (name, version) VALUES ('a', '1')")
    spark.sql("INSERT INTO t_views (name, status) VALUES ('b', NULL)")
    view = sources.stored_view(spark, "v_views", "SELECT name, status, schema_version, created_on IS NOT NULL AS dated FROM t_views")
    assert sorted(map(tuple, view.collect())) == [("a", "ACTIVE", "1.0", True), ("b", None, "1.0", True)]
    spark.sql("INSERT INTO t_views (name) VALUES ('c')")
    assert spark.table("v_views").count() == 3
    assert [f.name for f in spark.table("t_views").schema] == [f.name for f in schemas.FEATURE_VIEWS]
    for table in schemas.TABLES:
        schemas.create_table(spark, table, f"t_all_{table}", str(tmp_path / table))
    assert spark.table("t_all_realtime_inference_log").columns == schemas.REALTIME_INFERENCE_LOG.names


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path):
    from checks.domain import Domain
    from checks.analytics import _store_from_buckets
    left = spark.range(1000).select((F.col("id") % 90).cast("string").alias("client_id"), "id")
    tables = [sources.write_bucketed(left, f"t_bucket_{i}", "client_id", 4, str(tmp_path / str(i))) for i in range(2)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = tables[0].join(tables[1].groupBy("client_id").agg(F.count("*").alias("n")), "client_id", "left")
        plan = plan_of(joined)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.agg(F.sum("n")).first()[0] == left.join(left.groupBy("client_id").count(), "client_id").agg(F.sum("count")).first()[0]
        plan = plan_of(_store_from_buckets(Domain(spark, "/root/testdata/sf0.001")))
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
