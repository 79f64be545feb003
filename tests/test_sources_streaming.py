import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frames import NOW
from tidemark import schemas, sources, streaming
from tidemark.functions import at, wall_clock, wall_instant


def lines(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def staged(n, back=timedelta(), kind="web_visit", **extra):
    return {"event_id": f"e{n}", "client_id": f"c{n % 3}", "event_timestamp": (NOW - back).isoformat(timespec="microseconds"),
            "event_type": kind, "touchpoint_value": 0.5, "conversion_flag": False, **extra}


def test_json_files_ignore_unknown_keys_and_malformed_lines(spark, tmp_path):
    lines(tmp_path / "in", "a.json", [staged(1, search_term="x"), "{not json", staged(2, timedelta(microseconds=1))])
    good = sources.event_files(spark, str(tmp_path / "in"))
    assert {r.event_id for r in good.collect()} == {"e1", "e2"} and "search_term" not in good.columns
    assert {r.event_timestamp.microsecond for r in good.collect()} == {0, 999999}
    kept = sources.event_files(spark, str(tmp_path / "in"), quarantine=True)
    assert [r[sources.readers.CORRUPT] for r in kept.filter("event_id IS NULL").collect()] == ["{not json"]
    lines(tmp_path / "in", "b.json", ["", {"client_id": "no id"}, "[1]", "{}"])
    assert sources.ingest_event_files(spark, str(tmp_path / "in"), str(tmp_path / "table")) >= 1
    table, bad = (spark.read.parquet(str(tmp_path / x)) for x in ("table", "table_rejected"))
    assert {r.event_id for r in table.collect()} == {"e1", "e2", None} and not table.filter("client_id = 'no id'").isEmpty()
    assert "{not json" in {r.line for r in bad.collect()}
    streaming.ingest_events(streaming.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "live"), str(tmp_path / "p")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "live")).exceptAll(table).isEmpty() and spark.read.parquet(str(tmp_path / "live")).count() == table.count()


def test_conform_fills_defaults_but_keeps_nulls(spark):
    frame = spark.createDataFrame([("a", None)], "client_id string, conversion_flag boolean")
    row = schemas.conform(frame, "marketing_events", at(NOW)).first()
    assert row.event_timestamp == NOW and row.conversion_flag is None
    row = schemas.conform(frame.drop("conversion_flag"), "marketing_events", at(NOW)).first()
    assert row.conversion_flag is False
    log = schemas.conform(spark.range(3).select(F.concat(F.lit("f"), "id").alias("feature_name")), "data_drift_monitoring", at(NOW))
    assert sorted(r.drift_id for r in log.collect()) == sorted(r.drift_id for r in log.repartition(3).collect())
    assert log.select("drift_id").distinct().count() == 3 and log.first().check_timestamp is None
    assert log.schema == schemas.DATA_DRIFT_MONITORING or [f.name for f in log.schema] == [f.name for f in schemas.DATA_DRIFT_MONITORING]


def day_table(spark, tmp_path, name):
    rows = [(n, datetime(2024, 5, d, h), "open") for n, (d, h) in enumerate([(1, 9), (1, 15), (2, 9), (3, 9)])]
    frame = spark.createDataFrame(rows, "id int, ts timestamp_ntz, status string").withColumn("day", F.to_date("ts"))
    sources.replace_days(frame, name, "day", str(tmp_path / name))
    return frame


def test_replace_days_swaps_only_given_days(spark, tmp_path):
    frame = day_table(spark, tmp_path, "t_replace")
    sources.replace_days(frame.filter("id = 0").withColumn("status", F.lit("new")), "t_replace", "day")
    assert sorted((r.id, r.status) for r in spark.table("t_replace").collect()) == [(0, "new"), (2, "open"), (3, "open")]


def test_replace_days_empties_a_named_day(spark, tmp_path):
    frame = day_table(spark, tmp_path, "t_empty")
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    sources.replace_days(frame.filter("id = 3"), "t_empty", "day", days=[date(2024, 5, 1), date(2024, 5, 3)])
    assert sorted(r.id for r in spark.table("t_empty").collect()) == [2, 3]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def test_compacted_log_is_one_folder_with_the_same_rows(spark, tmp_path):
    stage, target, progress = tmp_path / "stage", str(tmp_path / "counts"), str(tmp_path / "progress")
    run = lambda: streaming.live_counts(streaming.event_stream(spark, str(stage)), target, progress).awaitTermination()
    read = lambda: {r.event_type: r.events for r in streaming.latest_versions(spark, target, ["event_type"]).collect()}
    for n in range(3):
        lines(stage, f"{n}.json", [staged(10 * n + k, kind=("login", "search")[k % 2]) for k in range(n + 2)])
        run()
    before = read()
    assert streaming.compact_updates(spark, target, ["event_type"]) >= 3 and read() == before
    assert len([p for p in (tmp_path / "counts").iterdir() if p.name.startswith("batch_id=")]) == 1
    lines(stage, "9.json", [staged(99, kind="login")])
    run()
    assert read() == before | {"login": before["login"] + 1}
    assert streaming.compact_updates(spark, target, ["event_type"]) == 2 and read() == before | {"login": before["login"] + 1}


def test_daily_rows_end_at_the_clock(spark):
    rows = [("a", datetime(2024, 6, 1, 23), "login"), ("a", datetime(2024, 6, 3, 1), "login"), ("b", datetime(2024, 6, 4), "login")]
    daily = streaming.daily_rollup(spark.createDataFrame(rows, "client_id string, event_timestamp timestamp_ntz, event_type string"))
    got = streaming.engagement_from_days(daily, datetime(2024, 6, 3)).collect()
    assert [(r.client_id, r.total_events_7d, r.last_activity_timestamp) for r in got] == [("a", 1, datetime(2024, 6, 1, 23))]
    with pytest.raises(ValueError):
        streaming.engagement_from_days(daily, datetime(2024, 6, 3, 12))


def test_retention_drops_days_and_trims_the_boundary(spark, tmp_path):
    day_table(spark, tmp_path, "t_keep")
    dropped = sources.drop_days_before(spark, "t_keep", "day", "ts", datetime(2024, 6, 1, 9), days=30)
    assert dropped == [date(2024, 5, 1)] and sorted(r.id for r in spark.table("t_keep").collect()) == [2, 3]
    sources.drop_days_before(spark, "t_keep", "day", "ts", datetime(2024, 6, 1, 10), days=30)
    assert [r.id for r in spark.table("t_keep").collect()] == [3]


def test_retention_keeps_rows_at_the_cutoff(spark):
    frame = spark.createDataFrame([(NOW - timedelta(30),), (NOW - timedelta(30, microseconds=1),), (None,)], "ts timestamp_ntz")
    assert sources.retained(frame, "ts", NOW).count() == 2


def test_update_rewrites_only_matching_days(spark, tmp_path):
    day_table(spark, tmp_path, "t_update")
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t_update").glob("day=2024-05-03/*.parquet")}
    sources.update_days(spark, "t_update", "day", F.col("id") == 1, {"status": F.lit("DEPLOYED")})
    assert sorted((r.id, r.status) for r in spark.table("t_update").collect()) == [(0, "open"), (1, "DEPLOYED"), (2, "open"), (3, "open")]
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t_update").glob("day=2024-05-03/*.parquet")}
    assert before == after


def test_append_absent_and_sorted_write(spark, tmp_path):
    path = str(tmp_path / "keys")
    first = sources.materialize(spark.range(3).select("id"), path)
    sources.append_absent(spark.range(5).select("id"), first, ["id"], path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]
    ordered = str(tmp_path / "ordered")
    sources.write_sorted(spark.range(100).select((F.col("id") * 37 % 100).alias("v")), ordered, ["v"], 4)
    parts = [[r.v for r in spark.read.parquet(str(p)).collect()] for p in sorted((tmp_path / "ordered").glob("part-*"))]
    assert [v for part in parts for v in part] == list(range(100))


def test_catalog_and_views(spark):
    frame = sources.as_view(spark.range(2), "numbers")
    assert spark.sql("SELECT count(*) FROM numbers").first()[0] == 2
    assert [tuple(r) for r in sources.table_columns(frame, "numbers").collect()] == [("numbers", "id", "bigint", 1)]
    assert sources.table_exists(spark, "numbers") and not sources.table_exists(spark, "nothing_here")


def test_ingest_restart_adds_nothing(spark, tmp_path):
    stage, table, progress = tmp_path / "stage", str(tmp_path / "table"), str(tmp_path / "progress")
    lines(stage, "1.json", [staged(1), staged(2), "{broken"])

    def run():
        streaming.ingest_events(streaming.event_stream(spark, str(stage)), table, progress).awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(table).collect())

    assert run() == ["e1", "e2"] and run() == ["e1", "e2"]
    lines(stage, "2.json", [staged(3)])
    assert run() == ["e1", "e2", "e3"]


def test_dedup_across_files_and_late_rows(spark, tmp_path):
    stage, table, progress = tmp_path / "stage", str(tmp_path / "table"), str(tmp_path / "progress")

    def run():
        stream = streaming.deduplicated(streaming.event_stream(spark, str(stage)))
        streaming.ingest_events(stream, table, progress).awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(table).collect())

    lines(stage, "1.json", [staged(1), staged(1), staged(2)])
    assert run() == ["e1", "e2"]
    lines(stage, "2.json", [staged(2), staged(3, timedelta(hours=20)), staged(4, timedelta(days=3))])
    assert run() == ["e1", "e2", "e3"]  # e2 repeated, e4 beyond the watermark


def test_live_counts_replay_is_idempotent(spark, tmp_path):
    stage, target, progress = tmp_path / "stage", str(tmp_path / "counts"), str(tmp_path / "progress")
    lines(stage, "1.json", [staged(1), staged(2, kind="login")])
    run = lambda: streaming.live_counts(streaming.event_stream(spark, str(stage)), target, progress).awaitTermination()
    run()
    lines(stage, "2.json", [staged(3)])
    run()
    run()
    assert dict(streaming.latest_versions(spark, target, ["event_type"]).collect()) == {"web_visit": 2, "login": 1}


def test_daily_rollup_equals_event_counters(spark):
    from checks.domain import Domain
    from tidemark.plans.features import engagement_features
    d = Domain(spark, "/root/testdata/sf0.001")
    merged = streaming.engagement_from_days(streaming.daily_rollup(d.events), d.now)
    direct = engagement_features(d.events, d.now).select(*merged.columns)
    assert merged.exceptAll(direct).isEmpty() and direct.exceptAll(merged).isEmpty()


def test_windows_keep_the_wall_clock_over_a_clock_change(spark, tmp_path):
    skipped = datetime(2024, 3, 10, 2, 31, 0, 1)
    row = {"event_id": "e1", "client_id": "c", "event_timestamp": skipped.isoformat(), "event_type": "login"}
    lines(tmp_path / "stage", "1.json", [row])
    target = str(tmp_path / "windows")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = streaming.event_stream(spark, str(tmp_path / "stage"))
        streaming.live_windows(stream, target, str(tmp_path / "progress")).awaitTermination()
        got = streaming.latest_versions(spark, target, ["window_start"]).collect()
        back = spark.createDataFrame([(skipped,)], "t timestamp_ntz").select(wall_clock(wall_instant(F.col("t"))).alias("t")).first().t
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [(r.window_start, r.events) for r in got] == [(datetime(2024, 3, 10, 2, 30), 1)]
    assert back == skipped
