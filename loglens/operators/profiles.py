"""Reports about client addresses, for one address or for all of them at once.

Each takes ``ip``: with an address only its rows are read, without one the report has a
line (or a ranked list) for every address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.filters import RequestFilter, filter_requests
from loglens.functions import measures as m
from loglens.functions.text import none_if_empty
from loglens.operators.summaries import percentile, summarize
from loglens.timerange import TimeRange


def _rows(requests: DataFrame, tr: TimeRange, ip: str | None) -> DataFrame:
    return filter_requests(requests, tr, RequestFilter(remote_ip=ip))


def _first_per_address(counted: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first lines of every address; Spark cuts each partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("remote_ip").orderBy(*order))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")


def ip_profile(requests: DataFrame, tr: TimeRange, ip: str | None = None) -> DataFrame:
    """Totals, widest attributes and first/last sighting."""
    rows = _rows(requests, tr, ip)
    # Address owners are only known where the geography table carries them.
    owner = [
        (F.max(c) if c in rows.columns else F.lit(None).cast(kind)).alias(c)
        for c, kind in (("org", "string"), ("asn", "int"))
    ]
    return rows.groupBy("remote_ip").agg(
        m.requests().alias("req_count"),
        F.count_distinct("host").alias("hosts_count"),
        m.error_rate(3).alias("error_rate"),
        F.coalesce(F.max("threat_score"), F.lit(0)).cast("int").alias("max_threat"),
        F.max("country_code").alias("country_code"),
        F.max("country_name").alias("country_name"),
        *owner,
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.max("ua_browser").alias("browser"),
        F.max("ua_os").alias("os"),
    )


def ip_profile_top_paths(
    requests: DataFrame, tr: TimeRange, ip: str | None = None, *, limit: int = 10
) -> DataFrame:
    counted = (
        _rows(requests, tr, ip)
        .filter(F.col("path").isNotNull())
        .groupBy("remote_ip", "path")
        .agg(m.requests().alias("count"))
    )
    return _first_per_address(counted, limit, F.desc("count"), F.asc("path"))


def ip_hosts(requests: DataFrame, tr: TimeRange, ip: str | None = None, *, limit: int = 20) -> DataFrame:
    counted = (
        _rows(requests, tr, ip)
        .filter(F.col("host").isNotNull())
        .groupBy("remote_ip", "host")
        .agg(m.requests().alias("req_count"), m.error_rate(3).alias("error_rate"))
    )
    return _first_per_address(counted, limit, F.desc("req_count"), F.asc("host"))


def ip_timeline(requests: DataFrame, tr: TimeRange, ip: str | None = None) -> DataFrame:
    rows = _rows(requests, tr, ip).withColumn("ts", F.date_trunc("hour", "ts").cast(requests.schema["ts"].dataType))
    totals = {
        "req_count": m.requests(),
        **m.class_counts(top=599),
        "bytes_out": m.bytes_out(),
        "bytes_in": m.bytes_in(),
    }
    found = summarize(
        rows, ["remote_ip", "ts"], totals, values="duration_ms", positions={"p50": percentile(0.5)}
    )
    return found.select(
        "remote_ip", "ts", *totals, F.coalesce(m.nearest_ms(F.col("p50")), F.lit(0)).alias("p50_ms")
    )


def _counts(requests: DataFrame, tr: TimeRange, ip: str | None, column: str, name: str) -> DataFrame:
    rows = _rows(requests, tr, ip).filter(F.col(column).isNotNull())
    return rows.groupBy("remote_ip", column).agg(m.requests().alias(name))


def ip_methods(requests: DataFrame, tr: TimeRange, ip: str | None = None) -> DataFrame:
    return _counts(requests, tr, ip, "method", "count")


def ip_status_codes(requests: DataFrame, tr: TimeRange, ip: str | None = None) -> DataFrame:
    return _counts(requests, tr, ip, "status", "req_count")


def ip_busy_hours(requests: DataFrame, tr: TimeRange, ip: str | None = None) -> DataFrame:
    return (
        _rows(requests, tr, ip)
        .groupBy("remote_ip", F.hour("ts").alias("hour"))
        .agg(m.requests().alias("req_count"), m.errors().alias("err_count"))
    )


def ip_modal_attrs(requests: DataFrame, tr: TimeRange, ip: str | None = None) -> DataFrame:
    """Most frequent browser, system, TLS version and protocol; the lowest value wins a tie.

    Values are counted before one line per value meets its group, so that no group is
    ever held in memory.
    """
    source = {
        "browser": F.col("ua_browser"),
        "os": F.col("ua_os"),
        "tls_version": F.col("tls_version"),
        "http_proto": none_if_empty(F.col("http_proto")),
    }
    names = list(source)
    rows = _rows(requests, tr, ip).select("remote_ip", *[c.alias(n) for n, c in source.items()])
    counted = rows.groupingSets([["remote_ip", n] for n in names], "remote_ip", *names).agg(
        m.requests().alias("n")
    )
    lead = [
        F.min(F.when(F.col(n).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(n).alias("value"))))["value"].alias(n)
        for n in names
    ]
    return counted.groupBy("remote_ip").agg(*lead)


def ip_misc(requests: DataFrame, tr: TimeRange, ip: str | None = None) -> DataFrame:
    """Bot and TLS-resumption percentages and byte totals.

    A connection counts as not resumed when TLS was used, and not at all otherwise.
    """
    resumed = m.count_if(F.coalesce(F.col("tls_resumed"), F.lit(False)))
    fresh = m.count_if(~F.coalesce(F.col("tls_resumed"), F.lit(False)) & F.col("tls_version").isNotNull())
    encrypted = resumed + fresh
    return _rows(requests, tr, ip).groupBy("remote_ip").agg(
        m.percent(m.count_if(F.col("is_bot")), m.requests()).alias("is_bot_pct"),
        F.when(encrypted > 0, m.percent(resumed, encrypted)).alias("tls_resumed_pct"),
        m.bytes_in().alias("total_bytes_in"),
        m.bytes_out().alias("total_bytes_out"),
    )


def ip_latency(requests: DataFrame, tr: TimeRange, ip: str | None = None) -> DataFrame:
    rows = _rows(requests, tr, ip).filter(F.col("duration_ms").isNotNull())
    found = summarize(
        rows, ["remote_ip"],
        {"rows": m.requests(), "total_ms": F.sum(F.col("duration_ms").cast("bigint"))},
        values="duration_ms", positions={"p95": percentile(0.95)},
    )
    return found.select(
        "remote_ip",
        F.rint(F.col("total_ms") / F.col("rows")).cast("int").alias("avg_ms"),
        m.nearest_ms(F.col("p95")).alias("p95_ms"),
    )


def ip_sample_ua(requests: DataFrame, tr: TimeRange, ip: str | None = None) -> DataFrame:
    """One user agent of the address, always the same: the lowest."""
    rows = _rows(requests, tr, ip).filter(F.col("user_agent") != "")
    return rows.groupBy("remote_ip").agg(F.min("user_agent").alias("sample_ua"))
