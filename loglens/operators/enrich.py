"""Enrichment of parsed requests: geography, user-agent classes and the threat score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions import agents
from loglens.functions import fixed_values as fixed
from loglens.functions import measures as m
from loglens.functions.net import with_ip_keys
from loglens.operators.ranges import sweep
from loglens.operators.skew import attach

_LOOPBACK = ("127.0.0.1", "::1")


def locate_addresses(requests: DataFrame, geo: DataFrame) -> DataFrame:
    """One line per distinct address with its number of requests and its place, if any.

    ``geo`` has ``first_ip``, ``last_ip`` and the place columns; its ranges do not overlap.
    """
    places = [c for c in geo.columns if c not in ("first_ip", "last_ip")]
    addresses = requests.groupBy("remote_ip").agg(m.requests().alias("requests"))
    sought = F.when(~F.col("remote_ip").isin(*_LOOPBACK), F.col("remote_ip"))
    keyed = with_ip_keys(addresses.withColumn("__sought", sought), ip="__sought")
    ranges = with_ip_keys(geo, low="first_ip", high="last_ip").groupBy("low", "high").agg(F.max(F.struct(*places)).alias("place"))
    found = sweep(keyed, "ip", ranges, "low", "high")
    return found.select("remote_ip", "requests", F.get("found", F.lit(0))["place"].alias("place")).select("remote_ip", "requests", "place.*")


def enrich_geo(requests: DataFrame, geo: DataFrame) -> DataFrame:
    """Requests with the place columns of ``geo``; NULL where no range holds the address.

    Ranges are swept over distinct addresses only, then attached without shuffling hot ones.
    """
    return attach(requests, "remote_ip", locate_addresses(requests, geo), "requests")


def classify_agents(requests: DataFrame) -> DataFrame:
    """Browser, system, device class and bot flag of every request.

    The rules are expressions inside the scan stage: no join, no shuffle.
    """
    flagged = requests.withColumn("is_bot", agents.is_bot())
    return flagged.withColumns(
        {"ua_browser": agents.browser(), "ua_os": agents.system(), "ua_device": agents.device()}
    )


def agent_dimension(requests: DataFrame) -> DataFrame:
    """Distinct user agents with their classes and number of requests."""
    return classify_agents(requests.groupBy("user_agent").agg(m.requests().alias("req_count")))


def threat_score() -> Column:
    """Points for a bot's or a missing user agent and for answers that probing provokes."""
    missing = F.coalesce("user_agent", F.lit("")) == ""
    score = (
        F.when(F.col("is_bot") & ~missing, fixed.BOT_SCORE).otherwise(0)
        + F.when(missing, fixed.EMPTY_AGENT_SCORE).otherwise(0)
        + F.when(F.col("status").isin(*fixed.PROBE_STATUSES), fixed.PROBE_STATUS_SCORE).otherwise(0)
    )
    return F.least(score, F.lit(fixed.MAX_SCORE)).cast("smallint")


def score_threats(classified: DataFrame) -> DataFrame:
    """Requests, already classified by user agent, with their threat score."""
    return classified.withColumn("threat_score", threat_score())
