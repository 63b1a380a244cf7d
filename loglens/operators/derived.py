"""Small metrics that dashboards derive from the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.functions import measures as m
from loglens.functions.fixed_values import HEAT_STEPS, SEVERITIES
from loglens.operators.summaries import top

_CLASSES = ("2xx", "3xx", "4xx", "5xx")


def _percent_of(part: Column, whole: Column) -> Column:
    """Percent with one decimal, as shown; NULL when there is nothing to divide by."""
    return F.when(whole > 0, F.round(part / whole * 100, 1))


def health_level(overview: DataFrame) -> DataFrame:
    """How well the sites do, by error rate; no line without traffic."""
    rate = F.col("error_rate")
    level = F.when(rate > 0.1, "critical").when(rate > 0.05, "degraded").otherwise("healthy")
    return overview.filter(F.col("total_requests") > 0).select("total_requests", "error_rate", level.alias("level"))


def status_distribution(overview: DataFrame) -> DataFrame:
    """Requests and percentage per status class; no lines without traffic."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("status_class"), F.col(f"req_{c}").alias("req_count")) for c in _CLASSES]
    )
    return (
        overview.filter(F.col("total_requests") > 0)
        .select("total_requests", F.inline(pairs))
        .select("status_class", "req_count", _percent_of(F.col("req_count"), F.col("total_requests")).alias("pct"))
    )


def share_of_total(report: DataFrame) -> DataFrame:
    """A report with each line's share of all its requests; give it an unlimited report, limit its result.

    The whole is one line that partial sums lead to, whatever the length of the report.
    """
    whole = report.agg(F.sum("req_count").alias("__whole"))
    return report.join(F.broadcast(whole)).withColumn("share_pct", _percent_of(F.col("req_count"), F.col("__whole"))).drop("__whole")


def geo_share(countries: DataFrame) -> DataFrame:
    """Countries with their share of requests and their number of errors."""
    errors = F.floor(F.col("error_rate") * F.col("req_count") + 0.5).alias("errors")
    return share_of_total(countries).select("country_code", "country_name", "req_count", errors, "share_pct")


def worst_country(countries: DataFrame) -> DataFrame:
    """The country with the highest error rate; the busier one when equal."""
    worst = countries.orderBy(F.desc("error_rate"), F.desc("req_count"), F.asc("country_code")).limit(1)
    return worst.select("country_code", F.round(F.col("error_rate") * 100, 1).alias("error_pct"))


def heatmap_dense(busy_hours: DataFrame) -> DataFrame:
    """All 168 hours of the week, Monday first, with a heat level from 0 (none) to 6."""
    grid = busy_hours.sparkSession.range(7 * 24).select(
        (F.floor(F.col("id") / 24)).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour")
    )
    counted = busy_hours.select(((F.col("dow") + 6) % 7).alias("day"), "hour", "req_count")
    dense = grid.join(counted, ["day", "hour"], "left").fillna(0, ["req_count"])
    most = F.greatest(F.max("req_count").over(Window.partitionBy()), F.lit(1))
    heat = F.col("req_count") / most
    passed = sum((F.when(heat >= step, 1).otherwise(0) for step in HEAT_STEPS), F.lit(1))
    level = F.when(F.col("req_count") == 0, 0).otherwise(passed).cast("int")
    return dense.select("day", "hour", "req_count", level.alias("level"))


def ip_hours_dense(busy_hours: DataFrame) -> DataFrame:
    """Per address all 24 hours with good and failed requests, and whether none is quiet."""
    by_hour = F.map_from_entries(F.collect_list(F.struct("hour", F.struct("req_count", "err_count").alias("n"))))
    per_ip = busy_hours.groupBy("remote_ip").agg(
        by_hour.alias("hours"), (F.count_if(F.col("req_count") > 0) == 24).alias("active_every_hour")
    )
    listed = per_ip.select(
        "remote_ip", "active_every_hour", "hours", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    ).withColumn("n", F.try_element_at("hours", F.col("hour")))
    zero = F.lit(0).cast("bigint")
    errors = F.coalesce("n.err_count", zero)
    return listed.select(
        "remote_ip", "hour", (F.coalesce("n.req_count", zero) - errors).alias("ok"), errors.alias("err"),
        "active_every_hour",
    )


def threat_level(profiles: DataFrame) -> DataFrame:
    worst = F.col("max_threat")
    level = F.when(worst > 70, "HIGH").when(worst > 40, "MEDIUM").otherwise("LOW")
    return profiles.select("remote_ip", "max_threat", level.alias("threat_level"))


def severity_counts(events: DataFrame) -> DataFrame:
    """Events per severity, all severities listed."""
    counted = events.agg(
        *[m.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(s).alias("severity"), F.col(s).alias("count"))
            for i, s in enumerate(SEVERITIES)
        ]
    )
    return counted.select(F.inline(pairs))


def event_type_top(events: DataFrame, *, limit: int = 8) -> DataFrame:
    kind = F.replace("event_type", F.lit("_"), F.lit(" ")).alias("type")
    return top(events.groupBy(kind).agg(m.requests().alias("count")), limit, F.desc("count"), F.asc("type"))


def serious_events(events: DataFrame) -> DataFrame:
    return events.agg(m.count_if(F.col("severity").isin("critical", "high")).alias("critical_count"))


def paths_filtered_by_class(paths: DataFrame, status_class: str = "all") -> DataFrame:
    """Paths that had answers of the class, most of them first."""
    if status_class == "all":
        return paths.orderBy(F.desc("total"), F.asc("path"))
    column = f"req_{status_class}"
    return paths.filter(F.col(column) > 0).orderBy(F.desc(column), F.asc("path"))


def path_class_totals(paths: DataFrame) -> DataFrame:
    names = ["total", *[f"req_{c}" for c in _CLASSES]]
    return paths.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def peak_visitors(timeseries: DataFrame) -> DataFrame:
    return timeseries.agg(F.coalesce(F.max("unique_ips"), F.lit(0)).alias("peak"))


def host_error_flag(hosts: DataFrame) -> DataFrame:
    return hosts.select("host", "error_rate", (F.col("error_rate") > 0.05).alias("error_high"))


def live_by_country(rows: DataFrame) -> DataFrame:
    return (
        rows.filter(F.coalesce("country_code", F.lit("")) != "")
        .groupBy(F.col("country_code").alias("code"))
        .agg(F.min_by("country_name", F.struct("ts", "id")).alias("name"), m.requests().alias("count"))
        .orderBy(F.coalesce("name", "code"), "code")
    )


def live_by_host(rows: DataFrame) -> DataFrame:
    return rows.groupBy("host").agg(m.requests().alias("count")).orderBy("host")


def live_by_ip(rows: DataFrame, *, limit: int = 10) -> DataFrame:
    """The first addresses in text order, with the threat score and country first seen."""
    first = F.struct("ts", "id")
    grouped = rows.groupBy("remote_ip").agg(
        m.requests().alias("count"),
        F.coalesce(F.min_by("threat_score", first), F.lit(0)).cast("int").alias("threat"),
        F.min_by("country_code", first).alias("country"),
    )
    return top(grouped, limit, F.asc("remote_ip"))


def live_distinct(rows: DataFrame) -> DataFrame:
    """How many addresses, countries and hosts are active."""
    return rows.agg(
        F.count_distinct("remote_ip").alias("unique_ips"),
        F.count_distinct(F.nullif("country_code", F.lit(""))).alias("unique_countries"),
        F.count_distinct("host").alias("active_hosts"),
    )
