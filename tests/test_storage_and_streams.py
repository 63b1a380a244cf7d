"""Stored tables, and streams fed in several micro-batches."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, SETTINGS, _traffic

from loglens.operators import alerts, live, paging, rollups, security
from loglens.sources import lines, sinks
from loglens.streaming import pipeline, rollup
from loglens.streaming import security as stream_rules
from loglens.timerange import TimeRange

START = datetime(2024, 1, 1)


def _batches(spark, folder, rows, parts):
    """Write rows as one file per part, in order."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(folder)


def _drain(stream, out, checkpoint):
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def test_stream_security_equals_batch(spark, tmp_path):
    rows = _traffic(seed=11, rows=600)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    _batches(spark, folder, rows, 4)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    _drain(stream_rules.stream_security(source, SETTINGS), out, str(tmp_path / "check"))
    columns = ["id", "ts", "event_type", "severity", "remote_ip", "host", "uri", "details"]
    got = spark.read.parquet(out).select(columns).collect()
    want = security.security_events(spark.createDataFrame(rows, SCHEMA), SETTINGS).select(columns).collect()
    assert set(map(tuple, got)) ^ set(map(tuple, want)) == set()
    assert len(got) == len(want)


def test_stream_rollup_equals_batch(spark, tmp_path):
    rows = _traffic(seed=3, rows=400)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    _batches(spark, folder, rows, 3)
    extra = [
        F.lit(None).cast("bigint").alias("response_bytes"), F.lit(5).cast("bigint").alias("request_bytes"),
        F.lit("2xx").alias("status_class"),
    ]
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    _drain(rollup.stream_rollup(source.select("*", *extra), "1 minute"), out, str(tmp_path / "check"))
    got = spark.read.parquet(out)
    closed = max(r[1] for r in rows) - timedelta(minutes=6)
    batch = spark.createDataFrame(rows, SCHEMA).select("*", *extra)
    want = rollups.rollup_minutely(batch, START, START + timedelta(days=60)).filter(F.col("ts") <= F.lit(closed))
    got = got.filter(F.col("ts") <= F.lit(closed)).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_correct_their_minute(spark, tmp_path):
    """Rows later than any watermark, replays and untouched hours."""
    rows = _traffic(seed=5, rows=300)
    stored, kept, check = (str(tmp_path / n) for n in ("requests", "rollup", "check"))
    extra = {
        "response_bytes": F.lit(2).cast("bigint"), "request_bytes": F.lit(None).cast("bigint"),
        "status_class": F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")),
    }

    def add(part):
        frame = spark.createDataFrame(part, SCHEMA).withColumns(extra)
        sinks.sink_requests(frame, stored)

    def run():
        source = spark.readStream.schema(spark.read.parquet(stored).schema).parquet(stored)
        rollup.keep_rollup(source, stored, kept, check).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(kept)
        want = rollups.rollup_minutely(spark.read.parquet(stored), START, START + timedelta(days=60))
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
        return {str(f.relative_to(tmp_path)): f.stat().st_mtime_ns for f in (tmp_path / "rollup").rglob("*.parquet")}

    add(rows[100:])
    first = run()
    add(rows[:3])  # hours older than all that was seen
    second = run()
    hours = {f.rsplit("/", 1)[0] for f in second}
    late = {f"date={r[1].date()}/hour={r[1].hour}" for r in rows[:3]}
    for hour in hours:
        same = {f: t for f, t in first.items() if f.startswith(hour + "/")} == {f: t for f, t in second.items() if f.startswith(hour + "/")}
        assert same == (not any(hour.endswith(h) for h in late))
    assert run() == second
    add(rows[:3])  # rows that came twice are rows of the table
    run()


def _log_line(second, **changes):
    entry = {"msg": "handled request", "ts": 1704067200 + second, "request": {"client_ip": "192.0.2.1", "host": "h", "uri": "/"}}
    return json.dumps(entry | changes)


def test_pipeline_stores_every_line_once(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join([_log_line(1), "", "broken", _log_line(2, msg="other")]) + "\n")
    stored, errors, check, events = (str(tmp_path / n) for n in ("requests", "errors", "check", "events"))

    def run():
        tail = lines.segment_stream(spark, str(folder), max_files_per_trigger=1)
        pipeline.stream_pipeline(tail, stored, errors, check, events_path=events).trigger(availableNow=True).start().awaitTermination()

    run()
    attack = {"client_ip": "192.0.2.1", "host": "h", "uri": "/?q=document.cookie"}
    (folder / "b.log").write_text(_log_line(3) + "\n" + _log_line(4, request=attack) + "\n")
    run()
    run()
    assert spark.read.parquet(stored).select(F.count("id"), F.count_distinct("id")).collect()[0] == (3, 3)
    assert [r.raw_line for r in spark.read.parquet(errors).collect()] == ["broken"]
    assert [r.event_type for r in spark.read.parquet(events).collect()] == ["xss_attempt"]


def test_writing_a_batch_again_replaces_it(spark, tmp_path):
    rows = spark.createDataFrame([(1, START), (2, START + timedelta(days=1))], "id int, ts timestamp")
    path = str(tmp_path / "t")
    for batch in (0, 1, 1):
        sinks.write_batch(rows, path, batch)
    assert spark.read.parquet(path).count() == 4


def test_compaction_keeps_every_row_once(spark, tmp_path):
    path = str(tmp_path / "t")

    def batch(n):
        return spark.createDataFrame([(n, START + timedelta(days=d, minutes=n)) for d in range(2)], "id int, ts timestamp").coalesce(1)

    def ids():
        return sorted(r.id for r in spark.read.parquet(path).collect())

    def folders():
        return sorted(str(f.relative_to(path)) for f in (tmp_path / "t").glob("date=*/batch_id=*"))

    for n in range(12):
        sinks.write_batch(batch(n), path, n)
    sinks.compact(spark, path, 9)
    want = sorted([*range(12)] * 2)
    assert ids() == want and len(folders()) == 6
    assert len(list((tmp_path / "t").glob("date=*/batch_id=-10/*.parquet"))) == 2
    for n in (3, 9, 10):  # replays, taken in or not
        sinks.write_batch(batch(n), path, n)
    assert ids() == want
    # A compaction that was broken off before it removed what it had taken in.
    left = tmp_path / "t" / "date=2024-01-01" / "batch_id=4"
    left.mkdir()
    batch(4).limit(1).write.mode("overwrite").parquet(str(left))
    sinks.compact(spark, path, 11)
    assert ids() == want and len(folders()) == 2
    sinks.compact(spark, path, 11)
    sinks.compact(spark, path, 5)
    sinks.write_batch(batch(12), path, 12)
    assert ids() == sorted([*range(13)] * 2)
    sinks.retention_purge(spark, path, START + timedelta(days=2), 1)
    assert ids() == list(range(13))
    sinks.compact(spark, str(tmp_path / "none"), 3)


def test_retention_removes_days_and_rewrites_the_boundary(spark, tmp_path):
    rows = [(i, START + timedelta(hours=6 * i)) for i in range(40)]
    table = spark.createDataFrame(rows, "id int, ts timestamp")
    path = str(tmp_path / "t")
    table.withColumn("date", F.to_date("ts")).write.partitionBy("date").parquet(path)
    now = START + timedelta(days=9, hours=12)
    sinks.retention_purge(spark, path, now, 5)
    kept = sorted(r.id for r in spark.read.parquet(path).collect())
    assert kept == [i for i, ts in rows if ts >= now - timedelta(days=5)]
    report = sinks.retention_report(table, "t", now, 5).collect()[0]
    assert (report.purged, report.kept) == (40 - len(kept), len(kept))
    with pytest.raises(ValueError):
        sinks.retention_purge(spark, path, now, 0)


@pytest.mark.parametrize("hours", [0, 12])
def test_retention_of_a_streams_table(spark, tmp_path, hours):
    rows = [(i, START + timedelta(hours=6 * i)) for i in range(40)]
    path = str(tmp_path / "t")
    for batch in range(2):
        sinks.write_batch(spark.createDataFrame(rows[batch::2], "id int, ts timestamp"), path, batch)
    now = START + timedelta(days=9, hours=hours)
    sinks.retention_purge(spark, path, now, 5)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [i for i, ts in rows if ts >= now - timedelta(days=5)]
    sinks.write_batch(spark.createDataFrame([(99, now)], "id int, ts timestamp"), path, 7)
    assert spark.read.parquet(path).filter("id = 99").count() == 1


def test_a_batch_repeated_on_another_day_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for day in range(2):
        rows = spark.createDataFrame([(1, START + timedelta(days=day))], "id int, ts timestamp")
        sinks.write_batch(rows, path, 7)
    assert [r.ts for r in spark.read.parquet(path).collect()] == [START + timedelta(days=1)]


def test_ranges_open_only_their_days(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.sink_requests(spark.createDataFrame(_traffic(seed=2, rows=50), SCHEMA), path)
    stored = spark.read.parquet(path)
    extra = stored.withColumns({"response_bytes": F.lit(1), "request_bytes": F.lit(1), "status_class": F.lit("2xx"),
                                "threat_score": F.lit(1), "country_code": F.lit("NA")})
    day = TimeRange(START, START + timedelta(days=1))
    for report in (
        paging.recent_requests(stored, day), security.top_threats(extra, day), live.live_metrics_at(extra, START),
        rollups.rollup_minutely(extra, day.start, day.end), rollups.rollup_hourly(extra, day.start, day.end),
        rollups.rollup_top_paths_hourly(extra, day.start, day.end), rollups.rollup_top_ips_hourly(extra, day.start, day.end),
    ):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(date" in plan, plan


def test_live_windows_stay_equal_to_the_stored_requests(spark, tmp_path):
    """Rows later than any watermark, windows over the edge of an hour, and replays; nothing of a micro-batch is left."""
    extra = {
        "response_bytes": F.lit(2).cast("bigint"), "request_bytes": F.lit(None).cast("bigint"),
        "status_class": F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")),
    }
    stored, kept, check, slots = (str(tmp_path / n) for n in ("requests", "live", "check", "scratch"))
    at = [0, 1, 1795, 3590, 3599, 3600, 3605, 7190, 9000, 90000]
    rows = [(i, START + timedelta(seconds=s), f"10.0.0.{i % 3}", "h", "/", "/", "GET", 200, "a", i) for i, s in enumerate(at)]

    def run(part):
        sinks.sink_requests(spark.createDataFrame(part, SCHEMA).withColumns(extra), stored)
        source = spark.readStream.schema(spark.read.parquet(stored).schema).parquet(stored)
        query = rollup.keep_live_metrics(source, stored, kept, check, slots, seconds=30, step=5)
        query.trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(kept)
        want = live.live_metrics(spark.read.parquet(stored), seconds=30, step=5)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "live").rglob("*.parquet")}

    first = run(rows[5:])
    second = run(rows[:5])  # older than all that was there
    later = {f: t for f, t in second.items() if "date=2024-01-02" in str(f) or "hour=2" in str(f)}
    assert later and all(first[f] == t for f, t in later.items())
    assert len(list((tmp_path / "scratch").iterdir())) == 1


def test_days_read_from_stored_hours(spark, tmp_path):
    """Sums exact; estimates within three standard errors of the exact rollup."""
    rows = spark.range(60_000).select(
        F.expr("TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, id % 48)").alias("ts"), F.lit("h").alias("host"),
        F.concat(F.lit("a"), F.col("id") * 7919 % 9001).alias("remote_ip"), F.lit(200).alias("status"),
        F.lit("2xx").alias("status_class"), (F.col("id") % 1000).cast("int").alias("duration_ms"),
        F.col("id").alias("response_bytes"), F.lit(None).cast("bigint").alias("request_bytes"),
    )
    rows = rows.unionByName(rows.limit(3).withColumns({"host": F.lit("quiet"), "duration_ms": F.lit(None).cast("int")}))
    path, end = str(tmp_path / "hours"), START + timedelta(days=3)
    rollups.rollup_sketches(rows, START, end).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.filter("host = 'h'").count() == 48
    days = {(r.ts, r.host): r for r in rollups.merged_rollup(stored).collect()}
    exact = rows.groupBy(F.date_trunc("day", "ts").alias("ts"), "host").agg(
        F.count(F.lit(1)).alias("n"), F.sum("response_bytes").alias("bytes_out"), F.countDistinct("remote_ip").alias("ips"),
    ).collect()
    assert len(days) == len(exact) == 3
    for r in exact:
        got = days[r.ts, r.host]
        assert (got.req_count, got.req_2xx, got.bytes_out) == (r.n, r.n, r.bytes_out)
        assert abs(got.unique_ips - r.ips) <= 0.05 * r.ips
        wanted = [None] * 3 if r.host == "quiet" else [500, 950, 990]
        for value, middle in zip((got.duration_p50, got.duration_p95, got.duration_p99), wanted):
            assert value is None if middle is None else abs(value - middle) <= 40


def test_rules_choose_what_is_added_up(spark):
    """Metrics of the hosts that rules watch, and of all together, equal those computed for every host."""
    rows = spark.createDataFrame(_traffic(seed=7, rows=300), SCHEMA).withColumn("response_bytes", F.lit(3).cast("bigint"))
    host = rows.first()["host"]
    conditions = [f'{{"metric":"request_rate","threshold":0,"host":"{host}"}}', '{"metric":"latency_p95","threshold":1}']
    rules = spark.createDataFrame(
        [(i, "r", True, "threshold", c, 7, None) for i, c in enumerate(conditions)],
        "id int, name string, enabled boolean, rule_type string, conditions string, cooldown_minutes int, last_triggered timestamp",
    )
    few, every = alerts.all_metrics(rows, rules=rules), alerts.all_metrics(rows)
    assert {r.scope for r in few.select("scope").distinct().collect()} == {host, alerts.ALL_HOSTS}
    fired = [sorted(map(tuple, alerts.alert_evaluate(x, rules).collect())) for x in (few, every)]
    assert fired[0] == fired[1] and fired[0]


class _Kept:
    """A state of one value, or of a map, in memory; counts its calls."""

    def __init__(self):
        self.value, self.keys, self.calls = None, set(), 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.keys

    def updateValue(self, key, _):
        self.calls += 1
        self.keys.add(key)

    def clear(self):
        self.keys.clear()


def test_paths_of_a_session_are_counted_with_few_calls():
    """Batches cut anywhere give what one row after the other gives; the state is asked for different paths only."""
    rng = random.Random(4)
    at = sorted(rng.choice([0, 5, 40, 200]) + 300 * (i // 40) for i in range(400))
    rows = [(s * 1_000_000, rng.choice([None, "/a", "/b", "/c", f"/{s % 11}"])) for s in at]
    rows[50], rows[51] = rows[51], (rows[20][0], "/late")  # one comes late
    want, seen, last = [], set(), None
    for moment, path in rows:
        if last is not None and moment - last > 60_000_000:
            seen = set()
        last = moment if last is None else max(last, moment)
        seen |= {path} - {None}
        want.append(len(seen) if path else 0)
    for cuts in ([0, 51, 400], [0, 51, 52, 90, 91, 300, 400]):
        rules = stream_rules.AddressRules({"session_gap_seconds": 60})
        rules.seen, rules.missing = _Kept(), _Kept()
        got = []
        for lo, hi in zip(cuts, cuts[1:]):
            batch = pd.DataFrame(rows[lo:hi], columns=["at_us", "missing_path"])
            got += rules._count_paths(batch.sort_values("at_us", kind="stable", ignore_index=True)).tolist()
        assert got == want
        assert rules.missing.calls < 200


def test_stream_counts_outlive_session_and_late_batches(spark, tmp_path):
    """Login spans longer than the session, and a late batch that must not shorten the session."""
    settings = security.RuleSettings(session_gap_seconds=1200, logins_over=2, login_seconds=7200, scan_paths_over=2)

    def row(i, minute, ip, path, method, status):
        return (i, START + timedelta(minutes=minute), ip, "h", path, path, method, status, "a", 1)

    rows = [
        row(1, 0, "10.0.0.1", "/login", "POST", 200), row(2, 0, "10.0.0.2", "/a", "GET", 404),
        row(3, 30, "10.0.0.1", "/login", "POST", 200), row(4, 30, "10.0.0.2", "/b", "GET", 404),
        row(5, 27, "10.0.0.2", "/c", "GET", 404), row(6, 31, "10.0.0.9", "/", "GET", 200),
        row(7, 60, "10.0.0.1", "/login", "POST", 200), row(8, 49, "10.0.0.2", "/d", "GET", 404),
    ]
    # The late request comes after a newer one of its address.
    batches = [rows[0:2], rows[2:4], rows[4:6], rows[7:8], rows[6:7]]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in batches:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    _drain(stream_rules.stream_past(source, settings), out, str(tmp_path / "check"))
    got = {(r.remote_ip, r.event_type) for r in spark.read.parquet(out).collect()}
    want = security.security_events(spark.createDataFrame(rows, SCHEMA), settings).collect()
    assert got == {(r.remote_ip, r.event_type) for r in want}
    assert got == {("10.0.0.1", "repeated_auth_fail"), ("10.0.0.2", "port_scan_attempt")}


def test_rollup_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    first = spark.createDataFrame([(1, START), (2, START + timedelta(days=1))], "n int, ts timestamp")
    again = spark.createDataFrame([(9, START)], "n int, ts timestamp")
    sinks.replace_days(first, path)
    sinks.replace_days(again, path)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [2, 9]


def test_backfill_skips_old_and_known_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(_log_line(s) for s in (0, 10, 20, 30)) + '\n{"time": 1}\nnoise\n')
    read = lines.read_log_lines(spark, str(tmp_path))
    assert read.count() == 6
    newest = read.select("log_source").distinct().withColumn("last_ts", F.lit(START + timedelta(seconds=20)))
    kept = lines.backfill(read, START + timedelta(seconds=10), newest)
    assert [json.loads(r.value)["ts"] for r in kept.collect()] == [1704067230]
    assert lines.backfill(read, START + timedelta(seconds=10)).count() == 3


@pytest.mark.parametrize(("last", "expected"), [(None, [1, 31, 61]), ("2024-01-01 00:00:00", [30, 60])])
def test_cooldown(spark, last, expected):
    metrics = spark.createDataFrame(
        [(START + timedelta(minutes=i), "*", "request_rate", 2.0, 2.0) for i in range(1, 70)],
        "tick timestamp, scope string, metric string, value double, shown double",
    )
    rules = spark.createDataFrame(
        [(1, "r", True, "threshold", '{"metric":"request_rate","threshold":1}', None, last)],
        "id int, name string, enabled boolean, rule_type string, conditions string, cooldown_minutes int, last_triggered string",
    )
    fired = alerts.alert_evaluate(metrics, rules).orderBy("triggered_at").collect()
    assert [int((r.triggered_at - START).total_seconds() // 60) for r in fired] == expected
    assert json.loads(fired[0].details) == {"metric": "request_rate", "value": 2.0, "threshold": 1.0}
