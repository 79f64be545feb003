"""Replay-safe logs, gapless numbers, many-view datasets, whole-table uniqueness, refresh by hours, bitmaps."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.frames import NOW
from tidemark import streaming
from tidemark.operators import TimedView, append_numbered, as_of_views, numbered
from tidemark.plans import catalog
from tidemark.sources import BatchLog, newest

START = datetime(2024, 1, 1)


def test_a_batch_counts_once(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"))
    assert log.empty() and not log.holds(0)
    assert log.append(spark.range(3), 0) and not log.append(spark.range(9), 0)
    assert log.append(spark.range(3, 5), "late") and log.append(spark.range(0).select("id"), 1)
    assert sorted((r.id, r.batch_id) for r in log.read().collect()) == [(0, "0"), (1, "0"), (2, "0"), (3, "late"), (4, "late")]
    assert log.read("late").count() == 2 and log.read(1).count() == 0 and log.read(before=1).count() == 3
    spark.range(50).write.parquet(str(tmp_path / "log/batch=b7/attempt=adead"))  # a writer that died before its commit
    assert log.read().count() == 5 and not log.holds(7)
    log._commit("0", "a~later", 0, [], 3)  # two writers at once: the attempt that sorts first counts
    spark.range(3).write.parquet(str(tmp_path / "log/batch=b0/attempt=a~later"))
    assert log.read(0).count() == 3


def test_folding_replaces_batches_and_vacuum_deletes_them(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"))
    combine = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    assert log.fold(combine) == 0
    for i in range(4):
        log.append(spark.createDataFrame([("a", 1), ("b", i)], "k string, n long"), i)
    reader = log.read()
    assert log.fold(combine) == 4 and sorted(map(tuple, log.read().drop("batch_id").collect())) == [("a", 4), ("b", 6)]
    assert reader.count() == 8  # a plan made before the fold still finds its files
    assert not log.append(spark.createDataFrame([("a", 1)], "k string, n long"), 2), "a folded batch is not added again"
    log.append(spark.createDataFrame([("b", 5)], "k string, n long"), 4)
    assert log.fold(combine) == 2 and sorted(map(tuple, log.read().drop("batch_id").collect())) == [("a", 4), ("b", 11)]
    assert log.vacuum() == 6 and log.vacuum() == 0
    assert sorted(map(tuple, log.read().drop("batch_id").collect())) == [("a", 4), ("b", 11)]
    assert [r.number for r in log.numbers().collect()] == [4]


def test_a_fold_that_dies_changes_nothing(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"))
    for i in range(2):
        log.append(spark.range(2), i)
    with pytest.raises(Exception, match="stop"):
        log.fold(lambda rows: rows.withColumn("id", F.raise_error(F.lit("stop")).cast("long")))
    assert log.read().count() == 4 and log.fold(lambda rows: rows) == 2 and log.read().count() == 4


def test_newest_batch_of_a_key(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([("a", 1), (None, 1), ("c", 1)], "k string, n int"), 9)
    log.append(spark.createDataFrame([("a", 2), (None, 2)], "k string, n int"), 10)
    assert {(r.k, r.n) for r in newest(log.read(), log, ["k"]).collect()} == {("a", 2), (None, 2), ("c", 1)}


def test_numbers_have_no_gaps_and_follow_the_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), i) for i in range(500)]  # a third of the rows and more share a key
    frame = spark.createDataFrame(rows, "k int, i int").repartition(7)
    got = numbered(frame, [F.col("k").desc(), "i"], start=5).orderBy("row_number").collect()
    assert [r.row_number for r in got] == list(range(5, 505))
    assert [(r.k, r.i) for r in got] == sorted(rows, key=lambda r: (-(r[0] or 0), r[1]))
    assert numbered(frame.limit(0), ["k"]).count() == 0
    plan = numbered(frame, ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    path = str(tmp_path / "t")
    assert append_numbered(frame, path, ["i"]) == 500 and append_numbered(frame.limit(3), path, ["i"]) == 503
    assert append_numbered(frame.limit(0), path, ["i"]) == 503
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(1, 504))


def timed(rng, n, extra):
    return [(rng.choice(["hot", "hot", "b", None]), START + timedelta(hours=rng.randrange(200)), *extra(i)) for i in range(n)]


def test_views_of_two_cadences_meet_the_spine(spark):
    rng = random.Random(3)
    spine = spark.createDataFrame([*timed(rng, 80, lambda i: (i,)), ("b", None, 999)], "k string, ts timestamp_ntz, x int")
    one = spark.createDataFrame([*timed(rng, 60, lambda i: (i, 0.5)), ("hot", None, 1, 0.1)], "k string, at timestamp_ntz, x int, s double")
    two = spark.createDataFrame(timed(rng, 9, lambda i: (str(i),)), "k string, day timestamp_ntz, tag string")
    views = [TimedView("one", one, "at", ["x", "s"]), TimedView("two", two, "day", ["tag"])]

    def best(row, rows, width):
        known = [tuple(r)[1:] for r in rows if r[0] is not None and r[0] == row[0] and r[1] is not None and row[1] is not None and r[1] <= row[1]]
        return max(known) if known else (None,) * width

    want = [(*r, *best(r, one.collect(), 3), *best(r, two.collect(), 2)) for r in map(tuple, spine.collect())]
    for bucket in (None, lambda c: F.date_trunc("hour", c).cast("timestamp_ntz")):
        got = as_of_views(spine, views, ["k"], "ts", **({"bucket": bucket} if bucket else {}))
        assert got.columns == ["k", "ts", "x", "one_timestamp", "one_x", "s", "two_timestamp", "tag"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_COL") == 2 and plan.count("ReusedExchange") == 1, "spine and views are shuffled once"
    assert as_of_views(spine.limit(0), views, ["k"], "ts").count() == 0
    assert as_of_views(spine, [TimedView("one", one.limit(0), "at", ["x"])], ["k"], "ts").filter("one_x IS NOT NULL").isEmpty()


def test_registry_keeps_what_is_registered(spark, tmp_path):
    registry = catalog.FeatureRegistry(spark, str(tmp_path / "registry"))
    with pytest.raises(ValueError, match="no entity"):
        registry.register_view("V", "1", "CLIENT", "t", "SELECT 1 AS client_id", "", NOW)
    registry.register_entity("CLIENT", ["client_id"], "first", NOW)
    registry.register_entity("CLIENT", ["other"], "second", NOW)
    registry.register_entity("PAIR", ["client_id", "branch"], "", NOW)
    assert {r.name: r.join_keys for r in registry.entities().collect()} == {"CLIENT": ["client_id"], "PAIR": ["client_id", "branch"]}
    with pytest.raises(ValueError, match="lacks"):
        registry.register_view("V", "1", "CLIENT", "t", "SELECT 'a' AS client_id", "", NOW)
    query = "SELECT 'a' AS client_id, {} AS branch, TIMESTAMP_NTZ '2024-01-0{} 00:00:00' AS t, {} AS v"
    registry.register_view("V", "1", "CLIENT", "t", query.format("'x'", 1, 1), "", NOW)
    registry.register_view("V", "2", "CLIENT", "t", query.format("'x'", 3, 2), "", NOW)
    registry.register_view("V", "2", "CLIENT", "t", query.format("'x'", 3, 7), "", NOW)
    registry.register_view("W", "1", "PAIR", "t", query.format("'y'", 1, 3), "", NOW)
    assert sorted((r.name, r.version) for r in registry.views().collect()) == [("V", "1"), ("V", "2"), ("W", "1")]
    spine = spark.createDataFrame([("a", "x", datetime(2024, 1, 2)), ("a", "y", datetime(2024, 1, 4))], "client_id string, branch string, at timestamp_ntz")
    rows = registry.dataset(spine, [("V", "2"), ("W", "1")], "at").orderBy("at").collect()
    assert [(r["V_branch"], r["v"] if "v" in r else None, r["W_timestamp"]) for r in rows][0][2] is None
    assert [r["V_timestamp"] for r in rows] == [None, datetime(2024, 1, 3)] and rows[1]["W_timestamp"] == datetime(2024, 1, 1)
    with pytest.raises(LookupError):
        registry.dataset(spine, [("V", "9")], "at")


EVENT = "event_id string, client_id string, event_timestamp timestamp_ntz, event_type string"


def event(n, day, kind="login"):
    return (None if n is None else f"e{n}", f"c{(n or 0) % 5}", START + timedelta(days=day, minutes=n or 0), kind)


def test_late_copies_are_not_stored_again(spark, tmp_path):
    target = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(list(rows), EVENT)
    first = [event(n, n % 9) for n in range(200)]
    assert streaming.append_unique(frame(*first, first[0], event(None, 1)), target, 0, blocks=2) == 0
    asked = streaming.append_unique(frame(*[event(n, 30) for n in range(150, 260)], event(None, 1)), target, 1, blocks=2)
    assert 50 <= asked < 70, "new ids are mostly ruled out by the filters alone"
    streaming.append_unique(frame(*[event(n, 40) for n in range(150, 260)]), target, 1, blocks=2)  # a replay, of whatever
    ids = [r.event_id for r in streaming.unique_events(spark, target).collect()]
    assert sorted(x for x in ids if x) == sorted(f"e{n}" for n in range(260)) and ids.count(None) == 2
    streaming.append_unique(frame(*first, event(None, 5)), target, 2, blocks=2)  # nothing new but the one without an id
    assert streaming.unique_events(spark, target).count() == 263
    kept = streaming.unique_events(spark, target).filter("event_id = 'e151'").first()
    assert kept.event_timestamp == event(151, 151 % 9)[2], "the stored row stays"


def test_a_batch_that_died_between_rows_and_filter_gets_its_filter(spark, tmp_path):
    target, rows = str(tmp_path / "t"), spark.createDataFrame([event(n, 0) for n in range(20)], EVENT)
    BatchLog(spark, target).append(rows.withColumn("day", F.to_date("event_timestamp")), 0, ["day"])
    streaming.append_unique(rows, target, 0)
    streaming.append_unique(rows, target, 1)
    assert streaming.unique_events(spark, target).count() == 20


def test_filters_never_miss(spark):
    from tidemark.streaming import unique
    rows = spark.createDataFrame([event(n, n % 3) for n in range(3000)], EVENT).withColumn("day", F.to_date("event_timestamp"))
    filters = unique.day_filters(rows, 1)
    found = unique.may_be_stored(rows, filters, 1).join(rows.select("event_id", "day"), ["event_id", "day"])
    assert found.count() == 3000 and filters.count() == rows.select("day").distinct().count()
    others = spark.createDataFrame([event(n, 0) for n in range(5000, 8000)], EVENT)
    assert unique.may_be_stored(others, filters, 1).count() < 300


def test_an_id_is_not_paired_with_every_day(spark):
    """Filters so full that no day can be ruled out: the lookup has a row an id, and no join of ids with days before it."""
    from tidemark.streaming import unique
    full = spark.range(60).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.explode(F.array(F.lit(0), F.lit(1))).alias("block"),
                                  F.expr("unhex(repeat('FF', 4096))").alias("bits"))
    ids = spark.range(500).select(F.concat(F.lit("e"), "id").alias("event_id"))
    assert "Join" not in unique.may_be_stored(ids, full, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert unique.may_be_stored(ids, full, 2).distinct().count() == 500 * 60
    found = unique._matches(ids, full.unionByName(full), 2, pairs=False)
    assert found.filter("day IS NULL").count() == found.select("event_id").dropna().distinct().count() == 500
    assert found.select("day").dropna().distinct().count() == 60 and found.count() <= 500 + 60 * 2 * 4
    none = full.withColumn("bits", F.expr("unhex(repeat('00', 4096))"))
    assert unique.may_be_stored(ids, none, 2).isEmpty() and unique.may_be_stored(ids, full.limit(0), 2).isEmpty()


def test_only_changed_hours_are_written(spark, tmp_path):
    target, features = str(tmp_path / "m"), ["f"]
    rows = [("a", START, 1, None), ("b", START + timedelta(hours=1), 1, 0), ("a", START + timedelta(hours=2), 0, 1), ("z", START + timedelta(hours=3), 0, 1)]
    frame = lambda rs: spark.createDataFrame(rs, "client_id string, monitor_timestamp timestamp_ntz, prediction int, actual_conversion int")
    store = lambda **f: spark.createDataFrame(list(f.items()), "client_id string, f double")
    hour = "2024-01-01-{:02d}".format
    assert streaming.refresh_hours(frame(rows), store(a=1.0, b=2.0), features, target) == [hour(1), hour(2), hour(3)]
    stamps = lambda: {h: max(os.stat(tmp_path / "m" / h / f).st_mtime_ns for f in os.listdir(tmp_path / "m" / h)) for h in os.listdir(tmp_path / "m") if "=" in h}
    before = stamps()
    assert streaming.refresh_hours(frame(rows), store(b=2.0, a=1.0), features, target) == [] and stamps() == before
    labelled = [("a", START, 1, 1), *rows[1:]]
    assert streaming.refresh_hours(frame(labelled), store(a=1.0, b=2.0), features, target) == [hour(0)]
    assert {h: s for h, s in stamps().items() if h in before} == before
    assert streaming.refresh_hours(frame(labelled), store(a=1.0, b=3.0, z=9.0), features, target) == [hour(1), hour(3)]
    got = {(r.client_id, r.monitor_hour, r.f) for r in streaming.monitored_table(spark, target).collect()}
    assert got == {("a", START, 1.0), ("b", START + timedelta(hours=1), 3.0), ("a", START + timedelta(hours=2), 1.0), ("z", START + timedelta(hours=3), 9.0)}
    assert streaming.refresh_hours(frame(labelled[1:]), store(a=1.0, b=3.0), features, target) == [hour(0), hour(3)]
    assert {(r.client_id, r.f) for r in streaming.monitored_table(spark, target).collect()} == {("b", 3.0), ("a", 1.0), ("z", None)}


def test_bitmaps_count_distinct_clients_over_borders(spark):
    """Numbers around the border of two bitmaps, days on the edges of windows."""
    numbers = spark.createDataFrame([(f"c{n}", n) for n in (1, 2, 32768, 32769, 70000)], "client_id string, client_number long")
    now = datetime(2024, 6, 10)
    rows = [("c1", now - timedelta(days=7)), ("c1", now - timedelta(days=2)), ("c2", now - timedelta(days=8)), ("c32768", now - timedelta(seconds=1)),
            ("c32769", now - timedelta(days=30)), ("c70000", now), ("nobody", now - timedelta(days=1))]
    events = spark.createDataFrame([(c, t, "login") for c, t in rows], "client_id string, event_timestamp timestamp_ntz, event_type string")
    maps = streaming.daily_client_bitmaps(events, numbers)
    got = {r.window_days: r.clients for r in streaming.distinct_clients(maps, now).collect()}
    assert got == {7: 2, 30: 4, 90: 4}
    assert streaming.distinct_clients(maps.unionByName(maps), now).collect() == streaming.distinct_clients(maps, now).collect()
    with pytest.raises(ValueError):
        streaming.distinct_clients(maps, now.replace(hour=3))
