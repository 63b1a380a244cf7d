"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.filters import RequestFilter, filter_requests, instant, stream_filter
from loglens.functions import text, tls
from loglens.operators import alerts, analytics, derived, enrich, live, paging, parse, profiles, rollups, security
from loglens.plans import fixtures as fx
from loglens.session import configure, stored
from loglens.sources import lines, sinks
from loglens.streaming import pipeline, rollup
from loglens.streaming import security as stream_rules
from loglens.timerange import resolve_time_range

Query = Callable[[SparkSession, str], DataFrame]

NOW = datetime(2024, 1, 31)
START, END = datetime(2024, 1, 1), NOW
MONTH = resolve_time_range(NOW, "l30d")
CUTOFF_DAYS = 20
# Traffic in the tables is sparse, so the rules look back further and fire earlier.
RULES = security.RuleSettings(
    rate_threshold=4, rate_seconds=6 * 3600, empty_agent_over=2, options_over=1, scan_paths_over=2,
    session_gap_seconds=24 * 3600, logins_over=2, login_seconds=24 * 3600,
)
LIVE_SECONDS, LIVE_STEP = 1800, 300


def _report(report: Callable[..., DataFrame], *, located: bool = False, **options) -> Query:
    """A report over the whole month."""
    return lambda spark, sf: report(fx.requests(spark, sf, located=located), MONTH, **options)


def _over(operator: Callable[..., DataFrame], *args, located: bool = False, **options) -> Query:
    return lambda spark, sf: operator(fx.requests(spark, sf, located=located), *args, **options)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return security.security_events(fx.requests(spark, sf), RULES)


# -- reading, storing ----------------------------------------------------------------

def _source_of(path: str) -> Column:
    return F.regexp_extract(path, "log_source=([^/]+)", 1)


def _per_source(read: DataFrame) -> DataFrame:
    return read.groupBy(_source_of("log_source").alias("log_source")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.max(lines.line_time(F.col("value"))).cast("timestamp_ntz").alias("newest"),
    )


def _read_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _per_source(lines.read_log_lines(spark, fx.stored_lines(spark, sf)))


def _tail_log_stream(spark: SparkSession, sf: str) -> DataFrame:
    stream = lines.tail_log_stream(spark, fx.stored_lines(spark, sf))
    return _per_source(_run_to_end(spark, stream, "tailed"))


def _backfill(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.raw_lines(spark, sf).select("value", "log_source")
    stored = fx.requests(spark, sf).filter(F.col("id") % 3 == 1).select(F.lit("source1").alias("log_source"), "ts")
    newest = lines.newest_per_source(stored.filter(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")))
    kept = lines.backfill(raw, datetime(2024, 1, 10), newest)
    return kept.groupBy("log_source").agg(F.count(F.lit(1)).alias("lines"))


def _sink_requests(spark: SparkSession, sf: str) -> DataFrame:
    path = fx.scratch(spark, "requests")
    sinks.sink_requests(fx.requests(spark, sf), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("response_bytes").alias("bytes_out"), F.max("ts").alias("last_ts")
    )


def _sink_parse_errors(spark: SparkSession, sf: str) -> DataFrame:
    path = fx.scratch(spark, "parse_errors")
    parsed = parse.parse_lines(fx.raw_lines(spark, sf))
    sinks.sink_parse_errors(parse.as_parse_errors(parsed, F.lit(NOW)), path)
    return spark.read.parquet(path).groupBy("log_source", "error_msg").agg(F.count(F.lit(1)).alias("lines"))


def _sink_security_events(spark: SparkSession, sf: str) -> DataFrame:
    path = fx.scratch(spark, "security_events")
    sinks.sink_security_events(_events(spark, sf), path)
    return spark.read.parquet(path).select("ts", "event_type", "severity", "remote_ip", "host", "uri", "details")


def _retention_purge(spark: SparkSession, sf: str) -> DataFrame:
    """All five tables as the pipeline stores them, purged with a cutoff at noon and read back.

    Each table is worked out once: what a purge removed is told from the stored rows before and after it.
    """
    raw, now = fx.requests(spark, sf), NOW + timedelta(hours=12)
    parsed = parse.parse_lines(fx.raw_lines(spark, sf))
    errors = stored(parse.as_parse_errors(parsed, F.lit(START)), "found_errors")
    tables = {
        "requests": [raw],
        "parse_errors": [errors.withColumn("ts", F.lit(at)) for at in (START, NOW)],
        "security_events": [_events(spark, sf)],
        "stats_minutely": [rollups.rollup_minutely(raw, START, END)],
        "stats_hourly": [rollups.rollup_hourly(raw, START, END)],
    }
    changes = []
    for name, batches in tables.items():
        path = fx.scratch(spark, name)
        for number, rows in enumerate(batches):
            sinks.write_batch(rows, path, number)
        written = spark.read.parquet(path).count()
        sinks.retention_purge(spark, path, now, CUTOFF_DAYS + 1)
        kept = spark.read.parquet(path).agg(F.lit(name).alias("table_name"), F.lit(written).alias("written"), F.count(F.lit(1)).alias("kept"))
        changes.append(kept.select("table_name", (F.col("written") - F.col("kept")).alias("purged"), "kept"))
    return reduce(DataFrame.unionByName, changes).filter(F.col("purged") + F.col("kept") > 0)


# -- parsing -----------------------------------------------------------------------------

def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse_lines(fx.raw_lines(spark, sf), fx.logger_hosts(spark), fx.source_labels(spark))


def _parse_lines(spark: SparkSession, sf: str) -> DataFrame:
    parsed = _parsed(spark, sf).filter(F.col("outcome") == parse.ROW)
    return parsed.drop("value", "outcome", "error_msg").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _parse_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("lines"))


def _parsed_columns(*columns: str) -> Query:
    return lambda spark, sf: _parse_lines(spark, sf).select("ts", *columns)


def _truncated(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("method", "uri", "path", "query", "http_proto", "logger_id", "logger_name")
    cut = parse.shortened(_parse_lines(spark, sf))
    return cut.select("ts", *columns, *(F.length(c).alias(f"{c}_length") for c in columns))


def _clean_host(spark: SparkSession, sf: str) -> DataFrame:
    urls = fx.table(spark, sf, "pages").select("page_id", text.authority(F.col("url")).alias("host"))
    n = F.col("page_id") % 4
    noisy = (
        F.when(n == 0, F.concat(F.upper("host"), F.lit(":8443")))
        .when(n == 1, F.concat(F.lit("  "), "host", F.lit("..")))
        .when(n == 2, F.concat(F.lit("[2001:DB8::"), F.hex("page_id"), F.lit("]:80")))
        .otherwise(F.concat(F.lit("2001:db8::"), F.hex("page_id")))
    )
    return urls.select("page_id", text.clean_host(noisy).alias("host"))


def _split_uri(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    given = F.when(F.col("page_id") % 3 == 0, url).when(
        F.col("page_id") % 3 == 1, F.concat(F.regexp_replace(url, "^https?://[^/]*", ""), F.lit(";v=1?a=b#x"))
    ).otherwise(F.regexp_replace(url, "^https?:", ""))
    return fx.table(spark, sf, "pages").select(
        "page_id", text.uri_path(given).alias("path"), text.uri_query(given).alias("query")
    )


def _referer_domain(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(
        F.regexp_replace("url", "://", "://user:pw@")
    )
    return fx.table(spark, sf, "pages").select("page_id", text.authority(given).alias("domain"))


def _status_class(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.col("event_id") % 13 > 0, 100 + (F.col("event_id") * 7) % 600)
    events = fx.table(spark, sf, "events").select(given.cast("int").alias("status"))
    return events.groupBy("status", text.status_class(F.col("status")).alias("status_class")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _tls_decode(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    version = F.when(n % 6 < 5, (F.lit(769) + n % 6).cast("string")).otherwise(F.lit('"TLS 1.3"'))
    suite = F.when(n % 3 == 0, 4865 + n % 4).when(n % 3 == 1, 49195 + n % 6).otherwise(52392 + n % 3)
    return fx.table(spark, sf, "events").select(
        "event_id",
        tls.tls_version(F.parse_json(version)).alias("tls_version"),
        tls.tls_cipher(F.parse_json(suite.cast("string"))).alias("tls_cipher"),
    )


# -- filters, pages ---------------------------------------------------------------------------

def _filter_requests(spark: SparkSession, sf: str) -> DataFrame:
    f = RequestFilter(method="post", status_class="2xx", path="purchase/_", country_code="ne")
    return filter_requests(fx.requests(spark, sf, located=True), MONTH, f).select("id", "ts", "path", "country_code")


def _time_range(spark: SparkSession, sf: str) -> DataFrame:
    """Requests in each named period before the newest request's month ends, in one scan."""
    rows = fx.requests(spark, sf)
    ranges = {p: resolve_time_range(NOW, p) for p in ("l15m", "l1h", "l6h", "l24h", "l7d", "l30d")}
    ranges["day"] = resolve_time_range(NOW, date="2024-01-13T00:00:00+02:00")
    ranges["bad date"] = resolve_time_range(NOW, "l7d", "yesterday")
    found = F.array(
        *[
            F.struct(F.lit(n).alias("period"), F.lit(tr.bucket).alias("bucket"), F.lit(tr.granularity).alias("hint"),
                     F.col("ts").between(F.lit(tr.start).cast("timestamp_ntz"), F.lit(tr.end).cast("timestamp_ntz")).alias("inside"))
            for n, tr in ranges.items()
        ]
    )
    return rows.select(F.inline(found)).groupBy("period", "bucket", "hint").agg(
        F.count_if("inside").alias("req_count")
    )


def _drop_country_filter(spark: SparkSession, sf: str) -> DataFrame:
    f = RequestFilter(country_code="NE", method="GET")
    return analytics.top_countries(fx.requests(spark, sf, located=True), MONTH, f, limit=None)


def _request_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """The slowest request looked up by its id."""
    rows = fx.requests(spark, sf)
    slowest = rows.agg(F.max(F.struct("duration_ms", "id"))["id"]).first()[0]
    return paging.request_by_id(rows, slowest)


def _requests_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The slowest requests of each site looked up by their id."""
    rows = fx.requests(spark, sf)
    slowest = rows.groupBy("host").agg(F.max(F.struct("duration_ms", "id"))["id"].alias("id"))
    return paging.requests_by_ids(rows, slowest)


def _stream_filter(spark: SparkSession, sf: str) -> DataFrame:
    f = RequestFilter(host="site1.example.com", status_class="4xx", path="error/1")
    return stream_filter(fx.requests(spark, sf), f).select("id", "path", "status")


def _requests_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.requests(spark, sf, located=True)
    return paging.requests_page(rows, MONTH, offset=100, limit=50, sort_by="duration_ms", sort_dir="desc")


def _recent(spark: SparkSession, sf: str) -> DataFrame:
    """The newest of the requests as they are stored by day."""
    path = fx.scratch(spark, "requests")
    sinks.sink_requests(fx.requests(spark, sf), path)
    return paging.recent_requests(spark.read.parquet(path), limit=100).select("id", "ts", "host", "uri")


# -- security, alerts ----------------------------------------------------------------------------

def _without_id(rule: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf: rule(fx.requests(spark, sf), *args).drop("id", "alert_sent")


def _sec_window(spark: SparkSession, sf: str) -> DataFrame:
    return security.sec_window(fx.requests(spark, sf), RULES).select("id", "remote_ip", "in_window")


def _security_events(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).drop("id", "alert_sent")


def _security_events_page(spark: SparkSession, sf: str) -> DataFrame:
    page = paging.security_events_page(_events(spark, sf), MONTH, severity="high", limit=25, offset=5)
    return page.select("ts", "event_type", "remote_ip", F.col("details")["uri"].alias("detail_uri"))


def _security_event_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """The newest event looked up by its id."""
    rows = _events(spark, sf)
    last = rows.agg(F.max(F.struct("ts", "event_type", "severity", "id"))["id"]).first()[0]
    return paging.security_event_by_id(rows, last).select("ts", "event_type", "remote_ip", "details")


def _security_events_total(spark: SparkSession, sf: str) -> DataFrame:
    return paging.security_events_total(_events(spark, sf), MONTH, severity="medium")


def _ip_list_match(spark: SparkSession, sf: str) -> DataFrame:
    addresses = fx.requests(spark, sf).select(F.col("remote_ip").alias("ip"))
    sixes = fx.table(spark, sf, "events").select(F.concat(F.lit("2001:db"), F.col("user_id") % 10, F.lit("::"), F.hex("user_id")).alias("ip"))
    found = security.ip_list_match(addresses.unionByName(sixes), fx.ip_lists(spark))
    return found.select(
        "ip", "whitelisted", F.col("whitelist_entry.id").alias("white_id"),
        F.col("whitelist_entry.is_individual").alias("white_individual"),
        "blocked", F.col("block_entry.id").alias("block_id"), F.col("block_entry.note").alias("block_note"),
        F.col("block_entry.is_individual").alias("block_individual"),
    )


def _alert_metric(metric: Callable[..., DataFrame], located: bool = False) -> Query:
    return lambda spark, sf: metric(fx.requests(spark, sf)).select("tick", "scope", "shown")


def _alert_security_event(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.alert_security_event(_events(spark, sf)).select("tick", "scope", "shown")


def _fired(spark: SparkSession, sf: str) -> DataFrame:
    rules = fx.alert_rules(spark)
    return alerts.alert_evaluate(alerts.all_metrics(fx.requests(spark, sf), rules=rules), rules)


def _alert_record(spark: SparkSession, sf: str) -> DataFrame:
    _, rules = alerts.alert_record(_fired(spark, sf), fx.alert_rules(spark))
    return rules.select("id", "name", "last_triggered")


def _alert_history(spark: SparkSession, sf: str) -> DataFrame:
    rules = fx.alert_rules(spark)
    history, _ = alerts.alert_record(_fired(spark, sf), rules)
    return alerts.alert_history(history, rules, limit=20, offset=3).select("rule_id", "rule_name", "triggered_at", "details")


# -- live, derived ---------------------------------------------------------------------------------

def _live(spark: SparkSession, sf: str) -> DataFrame:
    return live.live_metrics(fx.requests(spark, sf), seconds=LIVE_SECONDS, step=LIVE_STEP)


def _live_at(spark: SparkSession, sf: str) -> DataFrame:
    """The last day of the tables as one window with both ends."""
    return live.live_metrics_at(fx.requests(spark, sf), NOW - timedelta(days=1), seconds=24 * 3600)


def _live_uneven(spark: SparkSession, sf: str) -> DataFrame:
    """A step that does not divide the window."""
    return live.live_metrics(fx.requests(spark, sf), seconds=1800, step=420).select("window_end", "req_count", "unique_ips")


def _live_filtered(spark: SparkSession, sf: str) -> DataFrame:
    f = RequestFilter(host="site2.example.com", method="POST", path="/p")
    return live.live_metrics_filtered(fx.requests(spark, sf), f, seconds=LIVE_SECONDS, step=LIVE_STEP)


def _run_to_end(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a streaming query over all there is and return what it stored."""
    path = fx.scratch(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", fx.scratch(spark, f"{name}-checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    found = _run_to_end(spark, rollup.stream_rollup(fx.request_stream(spark, sf), "1 hour"), "rollup")
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _stream_live_metrics(spark: SparkSession, sf: str) -> DataFrame:
    stream = rollup.stream_live_metrics(fx.request_stream(spark, sf), seconds=LIVE_SECONDS, step=LIVE_STEP)
    found = _run_to_end(spark, stream, "live")
    return found.withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


def _kept(spark: SparkSession, sf: str, keep: Callable[..., object], **options) -> DataFrame:
    """What a query keeps of the stored requests, all of which are new to it."""
    requests, kept, checkpoint = (fx.scratch(spark, name) for name in ("requests", "kept", "checkpoint"))
    sinks.sink_requests(fx.requests(spark, sf), requests)
    added = spark.readStream.schema(spark.read.parquet(requests).schema).parquet(requests)
    keep(added, requests, kept, checkpoint, **options).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(kept).drop("date", "hour")


def _keep_rollup(spark: SparkSession, sf: str) -> DataFrame:
    kept = _kept(spark, sf, rollup.keep_rollup)
    return kept.filter((F.col("ts") >= instant(kept, START)) & (F.col("ts") < instant(kept, END)))


def _keep_live_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(
        spark, sf, rollup.keep_live_metrics, scratch=fx.scratch(spark, "live-slots"), seconds=LIVE_SECONDS, step=LIVE_STEP
    )


def _rollup_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Days read from stored hours; the sums, which are exact."""
    path = fx.scratch(spark, "hours")
    rollups.rollup_sketches(fx.requests(spark, sf), START, END).write.parquet(path)
    days = rollups.merged_rollup(spark.read.parquet(path))
    return days.drop("unique_ips", "duration_p50", "duration_p95", "duration_p99")


def _stream_security(spark: SparkSession, sf: str) -> DataFrame:
    stream = stream_rules.stream_security(fx.request_stream(spark, sf), RULES)
    found = _run_to_end(spark, stream, "security")
    return found.drop("id", "alert_sent").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _stream_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """All that the pipeline stores: requests, events of the rules about one request, and parse errors."""
    stored, errors, events = (fx.scratch(spark, name) for name in ("requests", "errors", "events"))
    dimensions = pipeline.Dimensions(fx.logger_hosts(spark), fx.source_labels(spark), fx.geo_ranges(spark, sf))
    tail = lines.tail_log_stream(spark, fx.stored_lines(spark, sf)).withColumn("log_source", _source_of("log_source"))
    query = pipeline.stream_pipeline(tail, stored, errors, fx.scratch(spark, "checkpoint"), dimensions, events_path=events)
    query.trigger(availableNow=True).start().awaitTermination()
    at = F.col("ts").cast("timestamp_ntz").alias("ts")
    requests = spark.read.parquet(stored).select(
        F.lit("requests").alias("stored"), at, "log_source", "host", "remote_ip", "path", "status",
        "user_agent", "ua_browser", "ua_device", "is_bot", "threat_score", "country_code", "city",
        *(F.lit(None).cast("string").alias(c) for c in ("what", "severity", "details")),
    )
    raised = spark.read.parquet(events).select(
        F.lit("events").alias("stored"), at, "host", "remote_ip", F.col("uri").alias("path"), F.col("event_type").alias("what"),
        "severity", "details",
    )
    failed = spark.read.parquet(errors).select(F.lit("errors").alias("stored"), "log_source", F.col("error_msg").alias("what"))
    return requests.unionByName(raised, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True)


def _from(report: Query, derive: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, sf: derive(report(spark, sf), **options)


QUERIES: dict[str, Query] = {
    # sources and sinks
    "read_log_lines": _read_log_lines,
    "tail_log_stream": _tail_log_stream,
    "backfill": _backfill,
    "sink_requests": _sink_requests,
    "sink_parse_errors": _sink_parse_errors,
    "sink_security_events": _sink_security_events,
    "recent_requests": _recent,
    "retention_purge": _retention_purge,
    # parsing
    "parse_lines": _parse_lines,
    "parse_outcomes": _parse_outcomes,
    "p_timestamp": _parsed_columns(),
    "p_client_ip": _parsed_columns("remote_ip"),
    "clean_host": _clean_host,
    "resolve_host": _parsed_columns("host", "logger_id"),
    "split_uri": _split_uri,
    "referer_domain": _referer_domain,
    "status_class": _status_class,
    "p_numeric": _parsed_columns("status", "response_bytes", "request_bytes", "duration_ms"),
    "p_headers": _parsed_columns("user_agent", "referer", "referer_domain"),
    "tls_decode": _tls_decode,
    "p_truncate": _truncated,
    # enrichment
    "enrich_geo": lambda spark, sf: fx.requests(spark, sf, located=True).select(
        "id", "remote_ip", "country_code", "country_name", "city", "latitude", "longitude"),
    "enrich_ua": lambda spark, sf: enrich.agent_dimension(fx.requests(spark, sf)).select(
        "user_agent", "ua_browser", "ua_os", "ua_device", "req_count"),
    "is_bot": lambda spark, sf: fx.requests(spark, sf).select("id", "is_bot"),
    "threat_score": lambda spark, sf: fx.requests(spark, sf).select("id", "threat_score"),
    # predicates and pages
    "filter_requests": _filter_requests,
    "time_range": _time_range,
    "drop_country_filter": _drop_country_filter,
    "requests_page": _requests_page,
    "requests_total": _report(paging.requests_total),
    "request_by_id": _request_by_id,
    "requests_by_ids": _requests_by_ids,
    "stream_filter": _stream_filter,
    # reports
    "overview": _report(analytics.overview),
    "timeseries": _report(analytics.timeseries),
    "timeseries_hourly": _report(analytics.timeseries, bucket="1 hour"),
    "timeseries_8_hours": _report(analytics.timeseries, bucket="8 hours"),
    "bandwidth": _report(analytics.bandwidth),
    "performance": _report(analytics.performance, bucket="1 hour"),
    "top_paths": _report(analytics.top_paths),
    "top_ips": _report(analytics.top_ips, located=True),
    "top_countries": _report(analytics.top_countries, located=True),
    "top_cities": _report(analytics.top_cities, located=True),
    "distinct_countries": _report(analytics.distinct_countries, located=True),
    "status_codes": _report(analytics.status_codes),
    "browsers": _report(analytics.browsers),
    "devices": _report(analytics.devices),
    "os": _report(analytics.operating_systems),
    "referers": _report(analytics.referers),
    "hosts_summary": _report(analytics.hosts_summary),
    "geo_map": _report(analytics.geo_map, located=True),
    "paths_by_status": _report(analytics.paths_by_status),
    "slowest_paths": _report(analytics.slowest_paths),
    "busy_hours": _report(analytics.busy_hours),
    "protocol_breakdown": _report(analytics.protocol_breakdown),
    "bot_share": _report(analytics.bot_share),
    "host_top_referers": _report(analytics.host_top_referers, f=RequestFilter(host="site1.example.com")),
    # address profiles
    "ip_profile": _report(profiles.ip_profile, located=True),
    "ip_profile_top_paths": _report(profiles.ip_profile_top_paths),
    "ip_hosts": _report(profiles.ip_hosts),
    "ip_timeline": _report(profiles.ip_timeline),
    "ip_methods": _report(profiles.ip_methods),
    "ip_status_codes": _report(profiles.ip_status_codes),
    "ip_busy_hours": _report(profiles.ip_busy_hours),
    "ip_modal_attrs": _report(profiles.ip_modal_attrs),
    "ip_misc": _report(profiles.ip_misc),
    "ip_latency": _report(profiles.ip_latency),
    "ip_sample_ua": _report(profiles.ip_sample_ua),
    # rollups
    "rollup_minutely": _over(rollups.rollup_minutely, START, END),
    "rollup_hourly": _over(rollups.rollup_hourly, START, END),
    "rollup_daily": _rollup_daily,
    "rollup_top_paths_hourly": _over(rollups.rollup_top_paths_hourly, START, END),
    "rollup_top_ips_hourly": _over(rollups.rollup_top_ips_hourly, START, END),
    # security
    "sec_window_60s": _sec_window,
    "sec_rate_limit": _without_id(security.sec_rate_limit, RULES),
    "sec_sqli": _without_id(security.sec_sqli),
    "sec_xss": _without_id(security.sec_xss),
    "sec_traversal": _without_id(security.sec_traversal),
    "sec_scanner": _without_id(security.sec_scanner),
    "sec_bad_bot": _without_id(security.sec_bad_bot),
    "sec_empty_ua": _without_id(security.sec_empty_ua, RULES),
    "sec_port_scan": _without_id(security.sec_port_scan, RULES),
    "sec_auth_fail": _without_id(security.sec_auth_fail, RULES),
    "sec_method_abuse": _without_id(security.sec_method_abuse, RULES),
    "sec_slow": _without_id(security.sec_slow),
    "security_events": _security_events,
    "security_events_page": _security_events_page,
    "security_event_by_id": _security_event_by_id,
    "security_events_total": _security_events_total,
    "top_threats": _report(security.top_threats, located=True),
    "ip_list_match": _ip_list_match,
    # alerts
    "alert_request_rate": _alert_metric(alerts.alert_request_rate),
    "alert_error_rate": _alert_metric(alerts.alert_error_rate),
    "alert_latency_p95": _alert_metric(alerts.alert_latency_p95),
    "alert_bandwidth": _alert_metric(alerts.alert_bandwidth),
    "alert_security_event": _alert_security_event,
    "alert_evaluate": _fired,
    "alert_record": _alert_record,
    "alert_history": _alert_history,
    # streams
    "stream_rollup": _stream_rollup,
    "keep_rollup": _keep_rollup,
    "keep_live_metrics": _keep_live_metrics,
    "stream_live_metrics": _stream_live_metrics,
    "stream_security": _stream_security,
    "stream_pipeline": _stream_pipeline,
    # live and derived
    "live_metrics": _live,
    "live_metrics_filtered": _live_filtered,
    "live_metrics_at": _live_at,
    "live_metrics_uneven": _live_uneven,
    "health_level": _from(_report(analytics.overview), derived.health_level),
    "status_distribution": _from(_report(analytics.overview), derived.status_distribution),
    "geo_share": _from(_report(analytics.top_countries, located=True, limit=None), derived.geo_share),
    "worst_country": _from(_report(analytics.top_countries, located=True, limit=None), derived.worst_country),
    "share_of_total": _from(_report(analytics.browsers, limit=None), derived.share_of_total),
    "heatmap_dense": _from(_report(analytics.busy_hours), derived.heatmap_dense),
    "ip_hours_dense": _from(_report(profiles.ip_busy_hours), derived.ip_hours_dense),
    "threat_level": _from(_report(profiles.ip_profile, located=True), derived.threat_level),
    "severity_counts": _from(_events, derived.severity_counts),
    "event_type_top": _from(_events, derived.event_type_top),
    "serious_events": _from(_events, derived.serious_events),
    "paths_filtered_by_class": _from(
        _report(analytics.paths_by_status, limit=None), derived.paths_filtered_by_class, status_class="4xx"),
    "path_class_totals": _from(_report(analytics.paths_by_status, limit=None), derived.path_class_totals),
    "peak_visitors": _from(_report(analytics.timeseries, bucket="1 hour"), derived.peak_visitors),
    "live_by_country": _over(derived.live_by_country, located=True),
    "live_by_host": _over(derived.live_by_host),
    "live_by_ip": _over(derived.live_by_ip, located=True),
    "live_breakdowns": _over(derived.live_distinct, located=True),
    "host_error_flag": _from(_report(analytics.hosts_summary), derived.host_error_flag),
}


def queries() -> dict[str, Query]:
    """Each query sets the session up first, so that it may be run on its own."""

    def ready(query: Query) -> Query:
        return lambda spark, sf: query(configure(spark), sf)

    return {name: ready(query) for name, query in QUERIES.items()}
