import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.functions import (
    bernoulli, clamp, exact_avg, exact_sum, first_match, floor_day, floor_hour, greatest_strict,
    hash_uniform, least_strict, money_sum, ratio,
)
from tidemark.operators import (
    as_of_join, attach_row, exact_quantile, feature_moments, first_rows, hash_sample, hash_split,
    latest_rows, metric_rows, not_exists, not_in, quantile,
)

START = datetime(2024, 1, 1)


def test_strict_bounds_propagate_null(spark):
    row = spark.range(1).select(
        greatest_strict(F.lit(None).cast("int"), F.lit(1)).alias("g"), least_strict(F.lit(3), F.lit(2)).alias("l"),
        clamp(F.lit(None).cast("double"), 0.0, 1.0).alias("c"), ratio(F.lit(1), F.lit(0)).alias("r")).first()
    assert (row.g, row.l, row.c, row.r) == (None, 2, None, None)


def test_first_match_skips_unknown_conditions(spark):
    row = spark.range(1).select(first_match([(F.lit(None).cast("boolean"), "a"), (F.lit(True), "b")], "c").alias("v")).first()
    assert row.v == "b"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-10 ** 8, 10 ** 8), min_size=1, max_size=40))
def test_sums_do_not_depend_on_partitioning(spark, values):
    frame = spark.createDataFrame([(v / 10 ** 4,) for v in values], "x double")
    shapes = [frame.coalesce(1), frame.repartition(5)]
    got = {tuple(s.agg(exact_sum(F.col("x"), 4), exact_avg(F.col("x"), 4), money_sum(F.col("x"))).first()) for s in shapes}
    assert len(got) == 1
    assert next(iter(got))[0] == pytest.approx(sum(values) / 10 ** 4, abs=1e-9)


def test_floor_keeps_wall_clock(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        frame = spark.createDataFrame([(datetime(2024, 3, 10, 2, 30),)], "t timestamp_ntz")
        row = frame.select(floor_hour(F.col("t")).alias("h"), floor_day(F.col("t")).alias("d")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.h == datetime(2024, 3, 10, 2) and row.d == datetime(2024, 3, 10)


def test_hash_draws_are_uniform_and_stable(spark):
    frame = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    stats = frame.select(hash_uniform(F.col("k"), "s").alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(stats[0] - 0.5) < 0.01 and 0 <= stats[1] and stats[2] < 1
    assert abs(frame.agg(F.avg(bernoulli(F.col("k"), "b", F.lit(0.3)))).first()[0] - 0.3) < 0.02
    train, test = hash_split(frame, "k")
    assert train.count() + test.count() == 20000 and train.join(test, "k").isEmpty()
    assert set(hash_sample(frame, "k", 0.1).collect()) <= set(hash_sample(frame, "k", 0.25).collect())


def test_latest_rows_keep_ties(spark):
    rows = [("a", START, 1), ("a", START + timedelta(1), 2), ("a", START + timedelta(1), 3), ("b", None, 4), ("c", START, 5), (None, START, 6)]
    frame = spark.createDataFrame(rows, "k string, t timestamp_ntz, v int")
    assert sorted(r.v for r in latest_rows(frame, "k", "t").collect()) == [2, 3, 5]
    assert len(latest_rows(frame, "k", "t", ties=False).collect()) == 2


def test_latest_rows_limit_before_the_shuffle(spark):
    frame = spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    plan = latest_rows(frame, "k", "t")._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("Partial")
    assert plan.index("Exchange hashpartitioning") < partial  # printed top-down: partial limit sits below


@pytest.mark.parametrize("left,right,expected", [
    ([1, 2, None], [1], [2]), ([1, None], [], [1, None]), ([1, 2], [1, None], []), ([None], [1], []),
])
def test_not_in_is_null_aware(spark, left, right, expected):
    a = spark.createDataFrame([(v,) for v in left], "k int")
    b = spark.createDataFrame([(v,) for v in right], "k int")
    assert sorted((r.k for r in not_in(a, b, "k").collect()), key=str) == sorted(expected, key=str)


def test_not_exists_keeps_null_keys(spark):
    a = spark.createDataFrame([(1,), (None,)], "k int")
    assert [r.k for r in not_exists(a, spark.createDataFrame([(1,), (None,)], "k int"), ["k"]).collect()] == [None]


def test_attach_row_required_and_optional(spark):
    frame, none = spark.range(3), spark.range(0).withColumnRenamed("id", "x")
    assert attach_row(frame, none).count() == 0
    assert [r.x for r in attach_row(frame, none, required=False).collect()] == [None] * 3
    assert attach_row(frame, spark.range(1).selectExpr("7 AS x", "8 AS y")).filter("x = 7 AND y = 8").count() == 3


def _brute_as_of(spine, features):
    out = []
    for key, moment, name in spine:
        past = [(t, v) for k, t, v in features if k == key and t <= moment]
        best = max(past) if past else (None, None)
        out.append((name, best[0], best[1]))
    return sorted(out)


@pytest.mark.parametrize("bucket", [floor_day, floor_hour])
def test_as_of_join_matches_brute_force(spark, bucket):
    rnd = random.Random(7)
    stamp = lambda: START + timedelta(minutes=rnd.randrange(0, 60 * 24 * 12))
    keys = ["hot"] * 6 + ["b", "c", "d"]
    spine = [(rnd.choice(keys), stamp(), n) for n in range(300)] + [("only_spine", stamp(), 900)]
    features = [(rnd.choice(keys), stamp(), n) for n in range(150)] + [("only_feature", stamp(), 901)]
    features += [(k, t, v + 1000) for k, t, v in features[:40]]  # same time, later version
    spine += [(k, t, v + 5000) for k, t, v in features[:30]]     # exactly at a feature's time
    s = spark.createDataFrame(spine, "k string, t timestamp_ntz, name int")
    f = spark.createDataFrame(features, "k string, t timestamp_ntz, v int")
    got = as_of_join(s, f, "k", "t", "t", ["v"], bucket)
    rows = sorted((r.name, r.matched_feature_timestamp, r.v) for r in got.collect())
    assert sorted(rows, key=str) == sorted(_brute_as_of(spine, features), key=str)


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_quantile_against_numpy(spark, q):
    rng = np.random.default_rng(3)
    groups = {"small": rng.normal(size=13), "one": rng.normal(size=1), "flat": np.full(5000, 2.5),
              "heavy": np.round(rng.lognormal(size=9000), 2), "mixed": np.concatenate([np.zeros(3000), rng.normal(size=3000)])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("small", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    # A coarse sketch sends the large groups through the bracket path.
    got = dict(exact_quantile(frame, "v", q, ["g"], "x", accuracy=100).collect())
    assert set(got) == set(groups)
    for name, values in groups.items():
        assert got[name] == pytest.approx(float(np.quantile(values, q)), abs=1e-12), name
    whole = exact_quantile(frame, "v", q, name="x", accuracy=100).first().x
    assert whole == pytest.approx(float(np.quantile(np.concatenate(list(groups.values())), q)), abs=1e-12)


def test_exact_quantile_of_a_heavy_tail_orders_few_values_at_last(spark):
    """Pareto values, a third of them equal, and a group of three: rounds narrow all to the limit."""
    rng = np.random.default_rng(5)
    values = {"tail": (rng.pareto(0.4, 20_000) + 1).tolist(), "ties": [7.0] * 700 + rng.pareto(1, 1300).tolist(), "few": [1.0, 2.0, 1e300]}
    frame = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    for q, limit in ((0.9999, 20), (0.5, 20), (0.999, 5), (0.0, 20), (1.0, 20)):
        left = quantile.candidates(frame, "v", q, ["g"], 100, limit)
        assert left.groupBy("g").count().agg(F.max("count")).first()[0] <= limit
        got = dict(exact_quantile(frame, "v", q, ["g"], "x", accuracy=100, limit=limit).collect())
        assert got == {g: pytest.approx(float(np.quantile(vs, q)), rel=1e-12) for g, vs in values.items()}


def test_exact_quantile_of_null_groups_and_a_wrong_bracket(spark, monkeypatch):
    values = [float(v) for v in range(1, 2001)]
    frame = spark.createDataFrame([(None if v % 2 else "even", v) for v in values] + [("none", None)], "g string, v double")
    got = dict(exact_quantile(frame, "v", 0.3, ["g"], "x").collect())
    assert got == {None: pytest.approx(float(np.quantile(values[0::2], 0.3))), "even": pytest.approx(float(np.quantile(values[1::2], 0.3)))}
    # The rank is found even where the sketch names a bracket without it.
    monkeypatch.setattr(F, "percentile_approx", lambda *_: F.array(F.min("_v") + 700.0, F.min("_v") + 710.0))
    assert exact_quantile(frame, "v", 0.3, name="x").first().x == pytest.approx(float(np.quantile(values, 0.3)))
    assert exact_quantile(frame, "v", 0.9, name="x").first().x == pytest.approx(float(np.quantile(values, 0.9)))


def test_sums_beyond_64_bits(spark):
    frame = spark.range(2000).select(F.lit(9e14).alias("x"))
    assert frame.agg(exact_sum(F.col("x"), 4), exact_avg(F.col("x"), 4)).first()[:] == (1.8e18, 9e14)


def test_small_shapes(spark):
    frame = spark.createDataFrame([(1, 2.0), (3, 4.0), (5, None)], "a int, b double")
    assert dict(metric_rows(frame, {"rows": F.count("*"), "known": F.count("b")}).collect()) == {"rows": 3, "known": 2}
    moments = {r.feature_name: (r.m_mean, r.m_std) for r in feature_moments(frame, ["a", "b"], "m").collect()}
    assert moments["a"] == (3.0, 2.0) and moments["b"] == (3.0, pytest.approx(2 ** 0.5))
    dated = spark.createDataFrame([(START + timedelta(n), n) for n in range(5)], "t timestamp_ntz, n int")
    assert [r.n for r in first_rows(dated, "t", 2, newest=True).collect()] == [4, 3]
