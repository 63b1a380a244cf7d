"""Traffic reports over the requests of a time range.

Each report is ``report(requests, tr, f, ...) -> DataFrame``. Reports ordered by count break
ties by the group's own columns, so that a limited report is reproducible.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.filters import RequestFilter, filter_requests
from loglens.functions import measures as m
from loglens.functions.text import none_if_empty
from loglens.functions.times import bucket_start, sunday_first_weekday
from loglens.operators.summaries import percentile, summarize, top
from loglens.timerange import TimeRange

_VISITORS = ("unique_ips", "remote_ip")
_MEDIAN = {"p50": percentile(0.5)}
_PERCENTILES = {
    "p50": percentile(0.5),
    "p75": percentile(0.75),
    "p90": percentile(0.9),
    "p95": percentile(0.95),
    "p99": percentile(0.99),
}


def _most_requested(*columns: str) -> list[Column]:
    return [F.desc("req_count"), *[F.asc_nulls_last(c) for c in columns]]


def _count_by(
    rows: DataFrame, column: str, name: str, limit: int | None = None, *, skip_empty: bool = False
) -> DataFrame:
    """Requests by one column, most frequent first."""
    present = F.col(column).isNotNull()
    if skip_empty:
        present = present & (F.col(column) != "")
    counted = rows.filter(present).groupBy(F.col(column).alias(name)).agg(m.requests().alias("req_count"))
    return top(counted, limit, *_most_requested(name))


def overview(requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None) -> DataFrame:
    """One row of totals; all zero when nothing matches."""
    totals = {
        "total_requests": m.requests(),
        "bytes_out": m.bytes_out(),
        "bytes_in": m.bytes_in(),
        "errors": m.errors(),
        **m.class_counts(),
    }
    summary = summarize(
        filter_requests(requests, tr, f), [], totals,
        distinct=_VISITORS, values="duration_ms", positions=_MEDIAN,
    )
    zero = F.lit(0).cast("bigint")

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), zero).alias(name)

    return summary.select(
        filled("total_requests"), filled("unique_ips"), filled("bytes_out"), filled("bytes_in"),
        F.coalesce(m.ratio(F.col("errors"), F.col("total_requests"), 4), F.lit(0.0)).alias("error_rate"),
        m.whole_ms(F.col("p50")).alias("p50_ms"),
        filled("req_2xx"), filled("req_3xx"), filled("req_4xx"), filled("req_5xx"),
    )


def timeseries(
    requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None, *, bucket: str | None = None
) -> DataFrame:
    """Traffic by time bucket; empty buckets are not listed."""
    rows = filter_requests(requests, tr, f).withColumn("ts", bucket_start(F.col("ts"), bucket or tr.bucket))
    totals = {
        "req_count": m.requests(),
        **m.class_counts(),
        "bytes_out": m.bytes_out(),
        "bytes_in": m.bytes_in(),
    }
    return summarize(
        rows, ["ts"], totals, distinct=_VISITORS, values="duration_ms", positions=_MEDIAN
    ).select("ts", *totals, m.whole_ms(F.col("p50")).alias("p50_ms"), "unique_ips").orderBy("ts")


def bandwidth(
    requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None, *, bucket: str | None = None
) -> DataFrame:
    """Bytes sent and received by time bucket."""
    rows = filter_requests(requests, tr, f)
    start = bucket_start(F.col("ts"), bucket or tr.bucket).alias("ts")
    return (
        rows.groupBy(start)
        .agg(m.bytes_out().alias("bytes_out"), m.bytes_in().alias("bytes_in"))
        .orderBy("ts")
    )


def performance(
    requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None, *, bucket: str | None = None
) -> DataFrame:
    """Latency percentiles by time bucket, in whole milliseconds."""
    rows = filter_requests(requests, tr, f).filter(F.col("duration_ms").isNotNull())
    rows = rows.withColumn("ts", bucket_start(F.col("ts"), bucket or tr.bucket))
    found = summarize(rows, ["ts"], {}, values="duration_ms", positions=_PERCENTILES)
    return found.select("ts", *[m.whole_ms(F.col(p)).alias(p) for p in _PERCENTILES]).orderBy("ts")


def top_paths(
    requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None, *, limit: int = 20
) -> DataFrame:
    grouped = filter_requests(requests, tr, f).filter(F.col("path").isNotNull()).groupBy("path").agg(
        m.requests().alias("req_count"),
        F.coalesce(F.bround(F.avg("duration_ms"), 0), F.lit(0)).cast("int").alias("avg_ms"),
        m.bytes_out().alias("bytes_out"),
    )
    return top(grouped, limit, *_most_requested("path"))


def top_ips(
    requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None, *, limit: int = 20
) -> DataFrame:
    grouped = filter_requests(requests, tr, f).groupBy("remote_ip").agg(
        m.requests().alias("req_count"),
        m.error_rate(3).alias("error_rate"),
        F.coalesce(F.max("threat_score"), F.lit(0)).cast("int").alias("threat_score"),
        F.max("country_code").alias("country_code"),
        F.max("country_name").alias("country_name"),
        F.max("ts").alias("last_seen"),
    )
    return top(grouped, limit, *_most_requested("remote_ip"))


def drop_country_filter(f: RequestFilter | None) -> RequestFilter | None:
    """Country reports are the country selector themselves and ignore that condition."""
    return replace(f, country_code=None) if f else None


def top_countries(
    requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None, *, limit: int | None = 20
) -> DataFrame:
    grouped = (
        filter_requests(requests, tr, drop_country_filter(f))
        .filter(F.col("country_code").isNotNull())
        .groupBy("country_code", "country_name")
        .agg(
            m.requests().alias("req_count"),
            F.count_distinct("remote_ip").alias("unique_ips"),
            m.error_rate(3).alias("error_rate"),
            m.bytes_out().alias("bytes_out"),
        )
    )
    return top(grouped, limit, *_most_requested("country_code", "country_name"))


def top_cities(
    requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None, *, limit: int = 30
) -> DataFrame:
    """Cities by requests. Grouping uses the stored columns and only the result is labelled,
    so two lines may carry the same label."""
    grouped = (
        filter_requests(requests, tr, f)
        .filter(F.col("city").isNotNull() & (F.col("city") != ""))
        .groupBy("city", "country_name", "country_code")
        .agg(m.requests().alias("req_count"), F.count_distinct("remote_ip").alias("unique_ips"))
    )
    return top(grouped, limit, *_most_requested("city", "country_name", "country_code")).select(
        "city",
        F.coalesce("country_name", "country_code", F.lit("Unknown")).alias("country_name"),
        F.coalesce("country_code", F.lit("")).alias("country_code"),
        "req_count",
        "unique_ips",
    )


def distinct_countries(requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None) -> DataFrame:
    return (
        filter_requests(requests, tr, drop_country_filter(f))
        .filter(F.col("country_code").isNotNull() & (F.col("country_code") != ""))
        .select(F.col("country_code").alias("code"), F.coalesce("country_name", "country_code").alias("name"))
        .distinct()
        .orderBy("name", "code")
    )


def status_codes(requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None) -> DataFrame:
    return _count_by(filter_requests(requests, tr, f), "status", "status")


def browsers(requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None, *, limit: int | None = 20) -> DataFrame:
    return _count_by(filter_requests(requests, tr, f), "ua_browser", "browser", limit)


def devices(requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None) -> DataFrame:
    return _count_by(filter_requests(requests, tr, f), "ua_device", "device")


def operating_systems(
    requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None, *, limit: int = 20
) -> DataFrame:
    return _count_by(filter_requests(requests, tr, f), "ua_os", "os", limit, skip_empty=True)


def referers(requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None, *, limit: int = 20) -> DataFrame:
    return _count_by(filter_requests(requests, tr, f), "referer_domain", "domain", limit, skip_empty=True)


def hosts_summary(requests: DataFrame, tr: TimeRange) -> DataFrame:
    summary = summarize(
        filter_requests(requests, tr), ["host"],
        {"req_count": m.requests(), "errors": m.errors(), "bytes_out": m.bytes_out()},
        greatest={"last_seen": F.col("ts")},
        distinct=_VISITORS, values="duration_ms", positions=_MEDIAN,
    )
    return summary.select(
        "host", "req_count", "unique_ips",
        m.ratio(F.col("errors"), F.col("req_count"), 3).alias("error_rate"),
        m.whole_ms(F.col("p50")).alias("p50_ms"),
        "bytes_out", "last_seen",
    ).orderBy(*_most_requested("host"))


def geo_map(requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None) -> DataFrame:
    return (
        filter_requests(requests, tr, f)
        .filter(F.col("country_code").isNotNull() & F.col("latitude").isNotNull())
        .groupBy("country_code", "country_name", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
        .agg(m.requests().alias("req_count"), F.count_distinct("remote_ip").alias("unique_ips"))
    )


def paths_by_status(
    requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None, *, limit: int | None = 30
) -> DataFrame:
    grouped = filter_requests(requests, tr, f).filter(F.col("path").isNotNull()).groupBy("path").agg(
        m.requests().alias("total"),
        *m.named(m.class_counts(top=599)),
        F.coalesce(F.bround(F.avg("duration_ms"), 0), F.lit(0)).cast("int").alias("avg_ms"),
        m.bytes_out().alias("bytes_out"),
    )
    return top(grouped, limit, F.desc("total"), F.asc("path"))


def slowest_paths(
    requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None, *, limit: int = 20, least_requests: int = 3
) -> DataFrame:
    """Paths by their 95th percentile, among those requested often enough to judge."""
    rows = filter_requests(requests, tr, f).filter(F.col("path").isNotNull() & F.col("duration_ms").isNotNull())
    summary = summarize(
        rows, ["path"],
        {"req_count": m.requests(), "total_ms": F.sum(F.col("duration_ms").cast("bigint"))},
        values="duration_ms", positions={"p50": percentile(0.5), "p95": percentile(0.95)},
    ).filter(F.col("req_count") >= least_requests)
    judged = summary.select(
        "path", "req_count",
        m.nearest_ms(F.col("p50")).alias("p50_ms"),
        m.nearest_ms(F.col("p95")).alias("p95_ms"),
        F.rint(F.col("total_ms") / F.col("req_count")).cast("int").alias("avg_ms"),
    )
    return top(judged, limit, F.desc_nulls_last("p95_ms"), F.asc("path"))


def busy_hours(requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None) -> DataFrame:
    """Requests by weekday (0 is Sunday) and hour of day."""
    return (
        filter_requests(requests, tr, f)
        .groupBy(F.hour("ts").alias("hour"), sunday_first_weekday(F.col("ts")).alias("dow"))
        .agg(m.requests().alias("req_count"))
        .orderBy("dow", "hour")
    )


def protocol_breakdown(requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None) -> DataFrame:
    protocol = F.coalesce(none_if_empty(F.col("http_proto")), F.lit("Unknown"))
    return (
        filter_requests(requests, tr, f)
        .groupBy(protocol.alias("protocol"))
        .agg(m.requests().alias("req_count"))
        .orderBy(*_most_requested("protocol"))
    )


def bot_share(requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None) -> DataFrame:
    bots = m.count_if(F.col("is_bot"))
    return filter_requests(requests, tr, f).agg(
        m.percent(bots, m.requests()).alias("bot_pct"), bots.alias("bot_count")
    )


def host_top_referers(
    requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None, *, limit: int = 15
) -> DataFrame:
    return referers(requests, tr, f, limit=limit)
