"""Operators against brute force on generated rows in which one address is very busy."""

from __future__ import annotations

import ipaddress
import json
import random
from collections import Counter
from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import functions as F

from loglens.operators import enrich, live, security, skew, summaries
from loglens.timerange import resolve_time_range

START = datetime(2024, 1, 1)
HOT = "198.51.100.1"


def _traffic(seed=7, rows=1500):
    """Rows (id, ts, remote_ip, host, uri, path, method, status, user_agent, duration_ms)."""
    rng = random.Random(seed)
    found, now = [], START
    for i in range(rows):
        # Bursts, equal instants and silences around one hour.
        now += rng.choice([timedelta(0), timedelta(microseconds=1), timedelta(seconds=1), timedelta(seconds=20)])
        if rng.random() < 0.01:
            now += timedelta(seconds=rng.choice([3599, 3600, 3601, 7200]))
        ip = HOT if rng.random() < 0.5 else f"198.51.100.{rng.randint(2, 5)}"
        path = rng.choice(["/login", "/a", "/b", f"/x{rng.randint(0, 30)}"])
        found.append(
            (
                i, now, ip, f"h{i % 2}", path, path, rng.choice(["GET", "POST", "OPTIONS", "TRACE"]),
                rng.choice([200, 404, 404, 500]), rng.choice([None, "curl/8", "Mozilla"]),
                rng.choice([None, rng.randint(0, 3000)]),
            )
        )
    return found


SCHEMA = (
    "id bigint, ts timestamp, remote_ip string, host string, uri string, path string, method string, "
    "status int, user_agent string, duration_ms int"
)
SETTINGS = security.RuleSettings(
    rate_threshold=30, empty_agent_over=10, options_over=8, scan_paths_over=6, logins_over=5
)


def brute_force_events(rows, s):
    """The rules applied one request after the other, as the log arrives."""
    arrivals, logins, missing, last = {}, {}, {}, {}
    events = Counter()
    for id_, ts, ip, _, _, path, method, status, agent, duration in sorted(rows, key=lambda r: (r[1], r[0])):
        if ip in last and ts - last[ip] > timedelta(seconds=s.session_gap_seconds):
            missing[ip] = set()
        last[ip] = ts
        recent = [t for t in arrivals.get(ip, []) if ts - t <= timedelta(seconds=s.rate_seconds)] + [ts]
        arrivals[ip] = recent
        n = len(recent)
        if n >= s.rate_threshold:
            events[id_, "rate_limit_trigger"] += 1
        if not agent and n > s.empty_agent_over:
            events[id_, "bad_bot"] += 1
        if status == 404:
            missing.setdefault(ip, set()).add(path)
            if len(missing[ip]) > s.scan_paths_over:
                events[id_, "port_scan_attempt"] += 1
        if method == "POST" and "/login" in path:
            tries = [t for t in logins.get(ip, []) if ts - t <= timedelta(seconds=s.login_seconds)] + [ts]
            logins[ip] = tries
            if len(tries) > s.logins_over:
                events[id_, "repeated_auth_fail"] += 1
        if method == "TRACE" or (method == "OPTIONS" and n > s.options_over):
            events[id_, "http_method_abuse"] += 1
        if (duration or 0) > s.slow_ms:
            events[id_, "slow_request_spike"] += 1
    return events


@pytest.fixture(scope="module")
def rows():
    return _traffic()


@pytest.fixture(scope="module")
def requests(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_security_events_equal_brute_force(spark, rows, requests):
    found = security.security_events(requests, SETTINGS).select(F.col("id").alias("event_id"))
    of_requests = [
        requests.select("id", F.lit(kind).alias("kind"), F.xxhash64("id", F.lit(kind), F.lit(severity)).alias("event_id"))
        for kind, severity in _KINDS
    ]
    pairs = reduce(lambda a, b: a.unionByName(b), of_requests)
    by_id = Counter((r.id, r.kind) for r in found.join(pairs, "event_id").collect())
    assert by_id == brute_force_events(rows, SETTINGS)


_KINDS = [
    ("rate_limit_trigger", "high"), ("bad_bot", "medium"), ("port_scan_attempt", "high"),
    ("repeated_auth_fail", "high"), ("http_method_abuse", "medium"), ("slow_request_spike", "info"),
]


def test_trailing_count_keeps_every_row(requests, rows):
    counted = security.sec_window(requests, SETTINGS).select("id", "in_window").collect()
    assert sorted(r.id for r in counted) == [r[0] for r in rows]


def _flood(rows, per_second=100):
    """One address that asks for the login page and never stops."""
    start = datetime(2024, 3, 1)
    return [
        (i, start + timedelta(microseconds=i * 1_000_000 // per_second), "198.51.100.9", "h", "/login", "/login", "POST", 200, "a", 1)
        for i in range(rows)
    ]


def test_a_flood_is_counted_to_its_end(spark):
    flood = spark.createDataFrame(_flood(2500), SCHEMA).repartition(3)
    settings = security.RuleSettings(rate_threshold=2400, logins_over=2450)
    kinds = Counter(r.event_type for r in security.security_events(flood, settings).collect())
    assert kinds == {"rate_limit_trigger": 101, "repeated_auth_fail": 50}
    assert security.sec_window(flood, settings).agg(F.max("in_window")).first()[0] == 2500


def test_details_hold_whole_texts(spark):
    uri = "/" + "x" * 6000 + "?q=<script>"
    row = (1, datetime(2024, 3, 1), "198.51.100.9", "h", uri, "/", "GET", 200, "nikto" + "y" * 900, 1)
    found = security.single_request_events(spark.createDataFrame([row], SCHEMA)).collect()
    details = {r.event_type: json.loads(r.details) for r in found}
    assert details["xss_attempt"]["uri"] == uri and len(details["known_scanner"]["ua"]) == 905


@pytest.mark.parametrize(
    "changes",
    [
        {"rate_seconds": 45, "login_seconds": 100, "session_gap_seconds": 7, "scan_paths_over": 1},
        {"rate_seconds": 7200, "rate_threshold": 200, "login_seconds": 10, "logins_over": 1, "session_gap_seconds": 30},
    ],
)
def test_bounds_lose_no_event(spark, rows, requests, changes):
    settings = replace(SETTINGS, **changes)
    found = security.security_events(requests, settings).groupBy("event_type").count().collect()
    want = Counter()
    for (_, kind), n in brute_force_events(rows, settings).items():
        want[kind] += n
    counted = {r["event_type"]: r["count"] for r in found if r["event_type"] in dict(_KINDS) and r["event_type"] not in ("bad_bot", "http_method_abuse")}
    assert counted == {k: n for k, n in want.items() if k not in ("bad_bot", "http_method_abuse")}


def test_calm_traffic_is_not_put_in_order(spark):
    calm = [
        (i, START + timedelta(seconds=30 * i), f"198.51.100.{i % 3}", "h", "/", "/", "GET", 404 if i % 200 == 0 else 200, None, 1)
        for i in range(3000)
    ]
    burst = [(9000 + i, START + timedelta(hours=30, milliseconds=i), HOT, "h", "/", "/", "GET", 200, None, 1) for i in range(400)]
    frame = spark.createDataFrame(calm + burst, SCHEMA)
    found = security.suspicious_slots(frame).collect()
    assert {r["remote_ip"] for r in found} == {HOT} and len(found) <= 2
    assert security.suspicious_slots(frame.limit(0)).count() == 0
    assert security.security_events(frame.limit(0)).count() == 0


def test_a_flood_is_many_tasks(spark):
    """200 000 requests of one address within ten minutes."""
    n = 200_000
    at = F.timestamp_micros(F.unix_micros(F.lit(datetime(2024, 3, 1)).cast("timestamp")) + F.col("id") * 3000)
    flood = spark.range(n).select(
        "id", at.alias("ts"), F.lit("198.51.100.9").alias("remote_ip"), F.lit("h").alias("host"), F.lit("/").alias("uri"),
        F.lit("/").alias("path"), F.lit("GET").alias("method"), F.lit(200).alias("status"), F.lit("a").alias("user_agent"),
        F.lit(1).alias("duration_ms"),
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = security.sec_window(flood).select("id", "in_window", F.spark_partition_id().alias("task"))
        found = counted.groupBy("task").agg(
            F.count("*").alias("rows"), F.sum(F.when(F.col("in_window") != F.least(F.col("id") + 1, F.lit(20_001)), 1).otherwise(0)).alias("wrong")
        ).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(r["rows"] for r in found) == n and sum(r["wrong"] for r in found) == 0
    assert len(found) >= 8 and max(r["rows"] for r in found) < n / 4


def test_summarize_equals_brute_force(requests, rows):
    got = summaries.summarize(
        requests, ["remote_ip"], {"n": F.count(F.lit(1))},
        distinct=("paths", "path"), values="duration_ms",
        positions={"p50": summaries.percentile(0.5), "p95": summaries.percentile(0.95), "upper": summaries.upper_median},
    ).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    assert len(got) == len(groups)

    def interpolated(values, share):
        at = share * (len(values) - 1)
        low = int(at)
        high = min(low + 1, len(values) - 1)
        return values[low] + (values[high] - values[low]) * (at - low)

    for line in got:
        mine = groups[line.remote_ip]
        durations = sorted(r[9] for r in mine if r[9] is not None)
        assert (line.n, line.paths) == (len(mine), len({r[5] for r in mine}))
        assert line.p50 == pytest.approx(interpolated(durations, 0.5))
        assert line.p95 == pytest.approx(interpolated(durations, 0.95))
        assert line.upper == durations[len(durations) // 2]


def test_summary_of_nothing(requests):
    none = requests.filter("false")
    got = summaries.summarize(
        none, [], {"n": F.count(F.lit(1))}, distinct=("ips", "remote_ip"), values="duration_ms",
        positions={"p50": summaries.percentile(0.5)},
    ).collect()
    assert [tuple(r) for r in got] == [(None, None, None)]


def test_geography_does_not_depend_on_hot_keys(spark, requests, rows):
    geo = spark.createDataFrame(
        [
            ("198.51.100.0", "198.51.100.1", "AA", "Aland"), ("198.51.100.3", "198.51.100.4", "BB", "Beland"),
            ("0.0.0.0", "126.255.255.255", "CC", "Celand"), ("2001:db8::", "2001:db8:ffff::", "DD", "Deland"),
        ],
        "first_ip string, last_ip string, country_code string, country_name string",
    )
    extra = spark.createDataFrame(
        [(9001, "2001:DB8::7"), (9002, "127.0.0.1"), (9003, "10.0.0.1"), (9004, "odd"), (9005, "2001:db9::"), (9006, None)],
        "id bigint, remote_ip string",
    )
    both = requests.select("id", "remote_ip").unionByName(extra)
    got = {r.id: r.country_code for r in enrich.enrich_geo(both, geo).collect()}
    want = {r[0]: {"1": "AA", "3": "BB", "4": "BB"}.get(r[2].rsplit(".", 1)[1]) for r in rows}
    want |= {9001: "DD", 9002: None, 9003: "CC", 9004: None, 9005: None, 9006: None}
    assert got == want


def test_attach_keeps_rows_and_replaces_columns(spark, requests):
    dimension = requests.groupBy("remote_ip").agg(F.count(F.lit(1)).alias("n"), F.lit("x").alias("host"))
    joined = skew.attach(requests, "remote_ip", dimension, "n")
    assert joined.count() == requests.count()
    assert joined.select("host").distinct().collect()[0][0] == "x"
    assert sorted(joined.columns) == sorted(requests.columns)


def test_live_metrics_at_one_instant(spark):
    rows = [
        (i, START + timedelta(seconds=s), ip, c, d, 10, None)
        for i, (s, ip, c, d) in enumerate(
            [(0, "a", "2xx", 5), (10, "a", "4xx", 7), (20, "b", "5xx", None), (30, "", "2xx", 9), (31, "c", "2xx", 1)]
        )
    ]
    df = spark.createDataFrame(
        rows,
        "id int, ts timestamp, remote_ip string, status_class string, duration_ms int, response_bytes bigint, request_bytes bigint",
    )
    got = live.live_metrics_at(df, START + timedelta(seconds=30)).collect()[0]
    assert (got.req_count, got.unique_ips, got.p50_ms, got.bytes_out, got.bytes_in) == (4, 2, 7, 40, 0)
    assert (got.rps, got.error_rate, got.req_4xx, got.req_5xx) == (0.13, 0.5, 1, 1)
    none = live.live_metrics_at(df, START - timedelta(days=1)).collect()[0]
    assert (none.req_count, none.rps, none.error_rate, none.p50_ms) == (0, 0.0, 0.0, 0)


@pytest.mark.parametrize(("seconds", "step"), [(30, 1), (30, 7), (5, 60), (20, 20)])
def test_live_metrics_equal_brute_force(spark, seconds, step):
    rng = random.Random(seconds * 100 + step)
    rows, now = [], 0.0
    for i in range(600):
        now += rng.choice([0, 0.25, 1, 3, 3, 90 if rng.random() < 0.1 else 2])
        rows.append((i, START + timedelta(seconds=now), rng.choice(["a", "a", "b", "c", "", None]), rng.choice(["2xx", "4xx", None]),
                     rng.choice([None, 1, 5, rng.randrange(50)]), rng.choice([None, 10]), 1))
    frame = spark.createDataFrame(
        rows, "id int, ts timestamp, remote_ip string, status_class string, duration_ms int, response_bytes bigint, request_bytes bigint"
    )
    got = {
        int((r.window_end - START).total_seconds()): (r.req_count, r.unique_ips, r.p50_ms, r.bytes_out, r.req_4xx, r.rps)
        for r in live.live_metrics(frame, seconds=seconds, step=step).collect()
    }
    epoch = int((START - datetime(1970, 1, 1)).total_seconds())
    want = {}
    for end in range(-(-epoch // step) * step - epoch, int(now) + seconds + step, step):
        held = [r for r in rows if end - seconds <= (r[1] - START).total_seconds() < end]
        if held:
            times = [(r[1] - START).total_seconds() for r in held]
            elapsed = max(max(times) - min(times), 0.5) if len(held) > 1 else seconds
            durations = sorted(r[4] for r in held if r[4] is not None)
            want[end] = (
                len(held), len({r[2] for r in held if r[2]}), durations[len(durations) // 2] if durations else 0,
                sum(r[5] or 0 for r in held), sum(r[3] == "4xx" for r in held), pytest.approx(len(held) / elapsed, abs=0.006),
            )
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] for k in want)
    assert live.live_metrics(frame.limit(0), seconds=seconds, step=step).count() == 0


def test_live_windows_are_not_copied(spark, requests):
    rows = live._measured(requests.withColumns({"status_class": F.lit("2xx"), "response_bytes": F.lit(1), "request_bytes": F.lit(1)}))
    rows = rows.withColumn("slot", F.floor(F.col("at_us") / 1_000_000))
    parts = [c.alias(n) for n, c in live._totals().items()] + [F.max(c).alias(n) for n, c in live._edges().items()]
    per_slot = summaries.lines(rows, ["slot"], parts, "visitor")
    slots = per_slot.select("slot").distinct().count()
    for width in (10, 1000):
        assert live._changes(per_slot, list(live._totals()), width).count() <= 2 * slots


def test_networks_equal_brute_force(spark):
    """Nested, equal and touching networks of both families."""
    rng = random.Random(12)
    networks = []
    for i in range(300):
        if rng.random() < 0.6:
            base, bits = ipaddress.IPv4Address(0xC0A80000 + rng.randrange(1 << 12)), rng.choice([8, 20, 22, 25, 27, 30, 31, 32])
        else:
            base, bits = ipaddress.IPv6Address(0x20010DB8 << 96 | rng.randrange(1 << 12)), rng.choice([0, 32, 117, 121, 126, 128])
        networks.append((i, rng.choice(["white", "block"]), f"{base}/{bits}", None))
    networks += [(400, "block", "no network", "x"), (401, "white", networks[0][2], "again")]
    addresses = [str(ipaddress.IPv4Address(0xC0A80000 + rng.randrange(1 << 12))) for _ in range(200)]
    addresses += [str(ipaddress.IPv6Address(0x20010DB8 << 96 | rng.randrange(1 << 12))) for _ in range(200)]
    addresses += ["9.9.9.9", "no address", "", None, addresses[0]]
    frame = spark.createDataFrame([(a,) for a in addresses], "ip string").repartition(7)
    lists = spark.createDataFrame(networks, "id int, list string, cidr string, note string")
    got = {r.ip: (r.whitelist_entry and r.whitelist_entry.id, r.block_entry and r.block_entry.id) for r in security.ip_list_match(frame, lists).collect()}
    parsed = [(i, kind, ipaddress.ip_network(c, strict=False)) for i, kind, c, _ in networks if "/" in c]

    def first(address, wanted):
        try:
            found = ipaddress.ip_address(address)
        except ValueError:
            return None
        return min((i for i, kind, n in parsed if kind == wanted and n.version == found.version and found in n), default=None)

    assert got == {a: (first(a, "white"), first(a, "block")) for a in set(addresses)}
    assert security.ip_list_match(frame, lists.limit(0)).filter("whitelisted OR blocked").count() == 0
    assert security.ip_list_match(frame.limit(0), lists).count() == 0


def test_time_ranges():
    now = datetime(2024, 1, 31, 12)
    assert resolve_time_range(now).start == datetime(2024, 1, 30, 12)
    assert resolve_time_range(now, "l7d").bucket == "8 hours"
    assert resolve_time_range(now, "nonsense").granularity == "hour"
    day = resolve_time_range(now, date="2024-01-13T00:00:00+02:00")
    assert (day.start, day.end) == (datetime(2024, 1, 12, 22), datetime(2024, 1, 13, 22))
    assert resolve_time_range(now, "l15m", "bad").granularity == "minute"


ATTACKS = {
    "is_sql_injection": (
        ["/shop?item=7%27/**/union all select card from orders", "/basket?n=3; drop table baskets", "/run?q=exec xp_cmdshell"],
        ["/unions/of/selectors", "/drops/tables-and-chairs"],
    ),
    "is_xss": (
        ["/guest?note=<script src=//cdn.test/p.js>", "/go?to=JavaScript:open()", "/card?b=<svg onload=run()>"],
        ["/scripts/evaluate?lesson=4"],
    ),
    "is_traversal": (
        ["/static/../../boot.ini", "/files/%2E%2e/keys", "/img/cat.png%00.txt"],
        ["/notes..old/v1.2.3"],
    ),
}


@pytest.mark.parametrize("rule", list(ATTACKS))
def test_attack_patterns(spark, rule):
    from loglens.functions import threats

    hits, misses = ATTACKS[rule]
    uris = spark.createDataFrame([(u,) for u in [*hits, *misses, None]], "uri string")
    found = [r.uri for r in uris.filter(getattr(threats, rule)()).collect()]
    assert sorted(found) == sorted(hits)


def test_agent_rules(spark):
    from loglens.functions import threats

    agents = ["probe nikto", "x SQLMAP y", "my-nuclei-run", "semrushbot crawl 12", "nmap and ahrefsbot",
              "Opera/9 plain reader", "googlebot-like", None]
    df = spark.createDataFrame([(a,) for a in agents], "user_agent string")
    assert [r[0] for r in df.filter(threats.is_scanner()).collect()] == [agents[i] for i in (0, 1, 2, 4)]
    assert [r[0] for r in df.filter(threats.is_bad_bot()).collect()] == ["semrushbot crawl 12"]
