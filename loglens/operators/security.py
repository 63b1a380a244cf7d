"""Security events: eleven rules over the requests, in event time.

Rules about one request alone run inside the scan stage. Rules about an address's recent past first add up requests by
address and short slot of time: the slots that a trailing window can touch bound what it can hold, and a session's
missing pages bound its different ones. Only requests in slots where a rule can fire by these bounds, and in those its
windows reach back to, are then put in order, by running sums that split busy addresses over time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.filters import within
from loglens.functions import measures as m
from loglens.functions import threats
from loglens.functions.net import with_cidr_bounds, with_ip_keys
from loglens.functions.times import micros
from loglens.operators.ranges import network_layer, sweep
from loglens.operators.running import running_distinct, trailing_count
from loglens.operators.summaries import top
from loglens.session import stored
from loglens.timerange import TimeRange

_SECOND = 1_000_000
_AT = "at_us"


@dataclass(frozen=True)
class RuleSettings:
    """Thresholds and spans (in seconds) of the rules."""

    rate_threshold: int = 300
    rate_seconds: int = 60
    empty_agent_over: int = 50
    options_over: int = 20
    scan_paths_over: int = 50
    session_gap_seconds: int = 3600
    logins_over: int = 10
    login_seconds: int = 3600
    slow_ms: int = 2000


DEFAULTS = RuleSettings()


def event(event_type: str, severity: str, **details: Column) -> Column:
    """One event of a request as a struct; ``details`` become its JSON text."""
    return F.struct(
        F.lit(event_type).alias("event_type"),
        F.lit(severity).alias("severity"),
        F.to_json(F.struct(*[c.alias(n) for n, c in details.items()])).alias("details"),
    )


def _emit(rows: DataFrame, *rules: tuple[Column, Column]) -> DataFrame:
    """The events of every (condition, event) rule that holds."""
    raised = F.filter(F.array(*[F.when(c, e) for c, e in rules]), lambda e: e.isNotNull())
    found = rows.withColumn("event", F.explode(raised))
    return found.select(
        F.xxhash64("id", "event.event_type", "event.severity").alias("id"),
        "ts", "event.event_type", "event.severity", "remote_ip", "host",
        F.coalesce("uri", F.lit("")).alias("uri"),
        "event.details",
        F.lit(False).alias("alert_sent"),
    )


def _rules_of_one_request(s: RuleSettings) -> dict[str, tuple[Column, Column]]:
    uri, agent = threats.lower_uri(), threats.lower_agent()
    duration = F.col("duration_ms")
    return {
        "sqli": (
            threats.is_sql_injection(),
            event("sql_injection_attempt", "high", pattern=F.lit("sqli"), uri=uri),
        ),
        "xss": (threats.is_xss(), event("xss_attempt", "medium", uri=uri)),
        "traversal": (threats.is_traversal(), event("path_traversal", "high", uri=uri)),
        "scanner": (threats.is_scanner(), event("known_scanner", "critical", ua=agent)),
        "bad_bot": (threats.is_bad_bot(), event("bad_bot", "low", ua=agent)),
        "method": (
            threats.is_abused_method(),
            event("http_method_abuse", "medium", method=threats.upper_method()),
        ),
        "slow": (
            duration > s.slow_ms,
            event("slow_request_spike", "info", duration_ms=duration, threshold=F.lit(s.slow_ms)),
        ),
    }


def _single(requests: DataFrame, rule: str, s: RuleSettings) -> DataFrame:
    return _emit(requests, _rules_of_one_request(s)[rule])


def sec_sqli(requests: DataFrame) -> DataFrame:
    return _single(requests, "sqli", DEFAULTS)


def sec_xss(requests: DataFrame) -> DataFrame:
    return _single(requests, "xss", DEFAULTS)


def sec_traversal(requests: DataFrame) -> DataFrame:
    return _single(requests, "traversal", DEFAULTS)


def sec_scanner(requests: DataFrame) -> DataFrame:
    return _single(requests, "scanner", DEFAULTS)


def sec_bad_bot(requests: DataFrame) -> DataFrame:
    return _single(requests, "bad_bot", DEFAULTS)


def sec_slow(requests: DataFrame, s: RuleSettings = DEFAULTS) -> DataFrame:
    return _single(requests, "slow", s)


def _timed(requests: DataFrame) -> DataFrame:
    """The columns the rules about the past need, with the time in microseconds."""
    return requests.select(
        "id", "ts", "remote_ip", "host", "uri",
        micros(F.col("ts")).alias(_AT),
        threats.has_no_agent().alias("no_agent"),
        threats.upper_method().alias("method"),
        threats.is_login_attempt().alias("login"),
        F.when(F.col("status") == 404, F.lower(F.coalesce("path", F.lit("")))).alias("missing_path"),
    )


def sec_window(requests: DataFrame, s: RuleSettings = DEFAULTS) -> DataFrame:
    """Requests of the same address in the trailing span at every request."""
    rows = requests.select(
        "id", "ts", "remote_ip", "host", "uri", micros(F.col("ts")).alias(_AT),
        threats.has_no_agent().alias("no_agent"), threats.upper_method().alias("method"),
    )
    return trailing_count(rows, "remote_ip", _AT, "id", s.rate_seconds * _SECOND, "in_window")


def _slot_seconds(s: RuleSettings) -> int:
    return gcd(s.rate_seconds, s.login_seconds, s.session_gap_seconds)


def _slot(s: RuleSettings) -> Column:
    return F.floor(F.col(_AT) / (_slot_seconds(s) * _SECOND)).alias("slot")


def suspicious_slots(requests: DataFrame, s: RuleSettings = DEFAULTS) -> DataFrame:
    """The slots of an address where a rule about its past can fire (``*_fires``) or whose requests such a slot's windows
    hold (``*_feeds``), and the number of the session; one scan, combined before the shuffle.

    A window that ends in a slot lies within it and the slots one span back, so their sum bounds its count. A session has at
    most as many different missing paths as missing pages.
    """
    def number(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    slots = (
        _timed(requests).groupBy("remote_ip", _slot(s))
        .agg(
            F.count(F.lit(1)).alias("n"), number(F.col("no_agent")).alias("agentless"),
            number(F.col("method") == "OPTIONS").alias("options"), number(F.col("login")).alias("logins"),
            number(F.col("missing_path").isNotNull()).alias("missing"), F.min(_AT).alias("first"), F.max(_AT).alias("last"),
        )
    )
    in_order = Window.partitionBy("remote_ip").orderBy("slot")
    rate, login = s.rate_seconds // _slot_seconds(s), s.login_seconds // _slot_seconds(s)

    def back(count: str, span: int) -> Column:
        return F.sum(count).over(in_order.rangeBetween(-span, 0))

    def ahead(fires: str, span: int) -> Column:
        return F.max(fires).over(in_order.rangeBetween(0, span))

    silence = F.col("first") - F.lag("last").over(in_order)
    begins = F.when(silence > s.session_gap_seconds * _SECOND, 1).otherwise(0)
    bounded = slots.withColumns(
        {"in_rate": back("n", rate), "in_login": back("logins", login), "begins": begins}
    ).withColumns(
        {
            "rate_fires": (F.col("in_rate") >= s.rate_threshold)
            | ((F.col("agentless") > 0) & (F.col("in_rate") > s.empty_agent_over))
            | ((F.col("options") > 0) & (F.col("in_rate") > s.options_over)),
            "login_fires": (F.col("logins") > 0) & (F.col("in_login") > s.logins_over),
            "session": F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    )
    session = Window.partitionBy("remote_ip", "session")
    flagged = bounded.withColumns(
        {
            "rate_feeds": ahead("rate_fires", rate),
            "login_feeds": ahead("login_fires", login),
            "scan_fires": (F.col("missing") > 0) & (F.sum("missing").over(session) > s.scan_paths_over),
        }
    )
    return flagged.filter(F.col("rate_feeds") | F.col("login_feeds") | F.col("scan_fires")).select(
        "remote_ip", "slot", "session", "rate_fires", "rate_feeds", "login_fires", "login_feeds", "scan_fires"
    )


def _suspicious(requests: DataFrame, s: RuleSettings, *rules: str) -> DataFrame:
    """The requests that the rules about the past need to look at, stored: a second scan, the last."""
    slots = suspicious_slots(requests, s)
    rows = _timed(requests).withColumn("slot", _slot(s)).alias("r")
    joined = rows.join(
        slots.alias("f"), F.col("r.remote_ip").eqNullSafe(F.col("f.remote_ip")) & (F.col("r.slot") == F.col("f.slot"))
    ).select("r.*", "session", "rate_fires", "rate_feeds", "login_fires", "login_feeds", "scan_fires")
    needs = {
        "rate": F.col("rate_feeds"), "login": F.col("login_feeds") & F.col("login"),
        "scan": F.col("scan_fires") & F.col("missing_path").isNotNull(),
    }
    return stored(joined.filter(reduce(Column.__or__, [needs[r] for r in rules])), "suspicious")


def _in_rate(suspects: DataFrame, s: RuleSettings) -> DataFrame:
    rows = suspects.filter("rate_feeds").select("id", "ts", "remote_ip", "host", "uri", _AT, "no_agent", "method", "rate_fires")
    counted = trailing_count(rows, "remote_ip", _AT, "id", s.rate_seconds * _SECOND, "in_window")
    return counted.filter("rate_fires")


def _in_login(suspects: DataFrame, s: RuleSettings) -> DataFrame:
    rows = suspects.filter("login_feeds AND login").select("id", "ts", "remote_ip", "host", "uri", _AT, "login_fires")
    counted = trailing_count(rows, "remote_ip", _AT, "id", s.login_seconds * _SECOND, "attempts")
    return counted.filter("login_fires")


def _in_scan(suspects: DataFrame) -> DataFrame:
    rows = suspects.filter("scan_fires AND missing_path IS NOT NULL").select(
        "id", "ts", "remote_ip", "host", "uri", _AT, "session", "missing_path"
    )
    return running_distinct(rows, ["remote_ip", "session"], "missing_path", _AT, "id", "paths")


def _rate_rule(s: RuleSettings) -> tuple[Column, Column]:
    return (
        F.col("in_window") >= s.rate_threshold,
        event("rate_limit_trigger", "high", req_per_min=F.col("in_window"), threshold=F.lit(s.rate_threshold)),
    )


def _empty_agent_rule(s: RuleSettings) -> tuple[Column, Column]:
    return (
        F.col("no_agent") & (F.col("in_window") > s.empty_agent_over),
        event("bad_bot", "medium", ua=F.lit("empty"), req_per_min=F.col("in_window")),
    )


def _options_rule(s: RuleSettings) -> tuple[Column, Column]:
    return (
        (F.col("method") == "OPTIONS") & (F.col("in_window") > s.options_over),
        event("http_method_abuse", "medium", method=F.col("method")),
    )


def sec_rate_limit(requests: DataFrame, s: RuleSettings = DEFAULTS) -> DataFrame:
    return _emit(_in_rate(_suspicious(requests, s, "rate"), s), _rate_rule(s))


def sec_empty_ua(requests: DataFrame, s: RuleSettings = DEFAULTS) -> DataFrame:
    return _emit(_in_rate(_suspicious(requests, s, "rate"), s), _empty_agent_rule(s))


def sec_method_abuse(requests: DataFrame, s: RuleSettings = DEFAULTS) -> DataFrame:
    always = _single(requests, "method", s)
    return always.unionByName(_emit(_in_rate(_suspicious(requests, s, "rate"), s), _options_rule(s)))


def sec_port_scan(requests: DataFrame, s: RuleSettings = DEFAULTS) -> DataFrame:
    """Addresses that ask for many different missing paths within one session.

    All requests of the address keep its session alive; only those answered 404 count.
    """
    return _emit(_in_scan(_suspicious(requests, s, "scan")), _scan_rule(s))


def sec_auth_fail(requests: DataFrame, s: RuleSettings = DEFAULTS) -> DataFrame:
    """Addresses that post to login pages again and again, whatever the answer."""
    return _emit(_in_login(_suspicious(requests, s, "login"), s), _login_rule(s))


def _scan_rule(s: RuleSettings) -> tuple[Column, Column]:
    return (
        F.col("paths") > s.scan_paths_over,
        event("port_scan_attempt", "high", unique_404_paths=F.col("paths")),
    )


def _login_rule(s: RuleSettings) -> tuple[Column, Column]:
    return (
        F.col("attempts") > s.logins_over,
        event("repeated_auth_fail", "high", login_attempts=F.col("attempts")),
    )


def single_request_events(requests: DataFrame, s: RuleSettings = DEFAULTS) -> DataFrame:
    """The events of the rules about one request alone."""
    return _emit(requests, *_rules_of_one_request(s).values())


def counted_events(counted: DataFrame, s: RuleSettings = DEFAULTS) -> DataFrame:
    """The events of the rules about the past, from rows that carry all counts."""
    return _emit(
        counted, _rate_rule(s), _empty_agent_rule(s), _options_rule(s), _scan_rule(s), _login_rule(s)
    )


def security_events(requests: DataFrame, s: RuleSettings = DEFAULTS) -> DataFrame:
    """All events of all rules, from three scans: for rules about one request, for bounds, and for what exceeds them.

    The requests of suspicious slots are stored in the shared folder when this is called.
    """
    suspects = _suspicious(requests, s, "rate", "login", "scan")
    parts = [
        single_request_events(requests, s),
        _emit(_in_rate(suspects, s), _rate_rule(s), _empty_agent_rule(s), _options_rule(s)),
        _emit(_in_scan(suspects), _scan_rule(s)),
        _emit(_in_login(suspects, s), _login_rule(s)),
    ]
    return reduce(DataFrame.unionByName, parts)


def top_threats(requests: DataFrame, tr: TimeRange, *, limit: int = 20) -> DataFrame:
    grouped = (
        within(requests, tr).filter(F.col("threat_score") > 0)
        .groupBy("remote_ip")
        .agg(
            m.requests().alias("event_count"),
            F.max("threat_score").cast("int").alias("max_score"),
            F.max("country_code").alias("country_code"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
    )
    return top(grouped, limit, F.desc("max_score"), F.desc("event_count"), F.asc("remote_ip"))


def ip_list_match(addresses: DataFrame, lists: DataFrame) -> DataFrame:
    """For every address the first whitelist and blocklist entry (lowest id) that holds it.

    ``addresses`` has ``ip``; ``lists`` has id, list ('white' or 'block'), cidr and note.
    Entries that are no network are skipped.
    """
    networks = with_cidr_bounds(lists, "cidr", "low", "high").select(
        "list", "low", "high",
        F.struct(
            "id", "cidr", F.coalesce("note", F.lit("")).alias("note"),
            (F.col("low") == F.col("high")).alias("is_individual"),
        ).alias("entry"),
    )
    distinct = addresses.select("ip").distinct()
    unscoped = distinct.withColumn("__address", F.regexp_replace("ip", "%.*$", ""))
    keyed = with_ip_keys(unscoped, key="__address").select("ip", "key")

    def first(name: str) -> Column:
        return F.min(F.when(F.col("list") == name, F.col("entry"))).alias(f"{name}list_entry")

    # One line for each network: its first entry of either list.
    lines = networks.groupBy("low", "high").agg(first("white"), first("block")).withColumn("layer", network_layer("low", "high"))
    found = sweep(keyed, "key", lines, "low", "high", "layer")
    joined = found.select(
        "ip", *[F.array_min(F.col(f"found.{n}")).alias(n) for n in ("whitelist_entry", "blocklist_entry")]
    )
    return joined.select(
        "ip",
        F.col("whitelist_entry").isNotNull().alias("whitelisted"),
        "whitelist_entry",
        F.col("blocklist_entry").isNotNull().alias("blocked"),
        F.col("blocklist_entry").alias("block_entry"),
    )
