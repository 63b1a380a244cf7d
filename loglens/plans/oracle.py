"""The same results in DuckDB SQL, written independently of the Spark operators."""

from __future__ import annotations

from loglens.functions import fixed_values as fixed
from loglens.plans.oracle_base import over_requests

MONTH = "ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'"

_ERROR_RATE = "AVG(CASE WHEN status >= 400 THEN 1.0 ELSE 0.0 END)"
_CLASSES = """
  CAST(SUM(CASE WHEN status BETWEEN 200 AND 299 THEN 1 ELSE 0 END) AS BIGINT) AS req_2xx,
  CAST(SUM(CASE WHEN status BETWEEN 300 AND 399 THEN 1 ELSE 0 END) AS BIGINT) AS req_3xx,
  CAST(SUM(CASE WHEN status BETWEEN 400 AND 499 THEN 1 ELSE 0 END) AS BIGINT) AS req_4xx,
  CAST(SUM(CASE WHEN status >= 500 THEN 1 ELSE 0 END) AS BIGINT) AS req_5xx"""
_BYTES = """
  CAST(SUM(COALESCE(response_bytes, 0)) AS BIGINT) AS bytes_out,
  CAST(SUM(COALESCE(request_bytes, 0)) AS BIGINT) AS bytes_in"""


def _pct(share: float, column: str = "duration_ms") -> str:
    return f"round(quantile_cont({column}, {share}), 6)"


def _cut(share: float) -> str:
    return f"CAST(trunc(COALESCE({_pct(share)}, 0)) AS INTEGER)"


def _near(share: float) -> str:
    return f"CAST(round_even({_pct(share)}, 0) AS INTEGER)"


def _timeseries(width: str) -> str:
    return f"""SELECT time_bucket(INTERVAL '{width}', ts) AS ts, COUNT(*) AS req_count, {_CLASSES}, {_BYTES},
  {_cut(0.5)} AS p50_ms, COUNT(DISTINCT remote_ip) AS unique_ips
FROM requests WHERE {MONTH} GROUP BY 1"""


def _counts(column: str, name: str, extra: str = "", limit: str = "") -> str:
    return f"""SELECT {column} AS {name}, COUNT(*) AS req_count FROM requests
WHERE {MONTH} AND {column} IS NOT NULL {extra} GROUP BY {column} ORDER BY req_count DESC, {name} {limit}"""


_OVERVIEW = f"""SELECT COUNT(*) AS total_requests, COUNT(DISTINCT remote_ip) AS unique_ips, {_BYTES},
  round_even({_ERROR_RATE}, 4) AS error_rate, {_cut(0.5)} AS p50_ms, {_CLASSES}
FROM requests WHERE {MONTH}"""

_HOSTS = f"""SELECT host, COUNT(*) AS req_count, COUNT(DISTINCT remote_ip) AS unique_ips,
  round_even({_ERROR_RATE}, 3) AS error_rate, {_cut(0.5)} AS p50_ms,
  CAST(SUM(COALESCE(response_bytes, 0)) AS BIGINT) AS bytes_out, MAX(ts) AS last_seen
FROM requests WHERE {MONTH} GROUP BY host"""

_COUNTRIES = f"""SELECT country_code, country_name, COUNT(*) AS req_count, COUNT(DISTINCT remote_ip) AS unique_ips,
  round_even({_ERROR_RATE}, 3) AS error_rate, CAST(SUM(COALESCE(response_bytes, 0)) AS BIGINT) AS bytes_out
FROM requests WHERE {MONTH} AND country_code IS NOT NULL {{where}} GROUP BY country_code, country_name"""

_PATHS = f"""SELECT path, COUNT(*) AS total, {_CLASSES},
  CAST(round_even(COALESCE(AVG(duration_ms), 0), 0) AS INTEGER) AS avg_ms,
  CAST(SUM(COALESCE(response_bytes, 0)) AS BIGINT) AS bytes_out
FROM requests WHERE {MONTH} AND path IS NOT NULL GROUP BY path"""

_PROFILE = f"""SELECT remote_ip, COUNT(*) AS req_count, COUNT(DISTINCT host) AS hosts_count,
  round_even({_ERROR_RATE}, 3) AS error_rate, CAST(MAX(threat_score) AS INTEGER) AS max_threat,
  MAX(country_code) AS country_code, MAX(country_name) AS country_name,
  CAST(NULL AS VARCHAR) AS org, CAST(NULL AS INTEGER) AS asn, MIN(ts) AS first_seen, MAX(ts) AS last_seen,
  MAX(ua_browser) AS browser, MAX(ua_os) AS os
FROM requests WHERE {MONTH} GROUP BY remote_ip"""

_IP_HOURS = f"""SELECT remote_ip, CAST(EXTRACT(hour FROM ts) AS INTEGER) AS hour, COUNT(*) AS req_count,
  CAST(SUM(CASE WHEN status >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS err_count
FROM requests WHERE {MONTH} GROUP BY ALL"""

_BUSY = f"""SELECT CAST(EXTRACT(hour FROM ts) AS INTEGER) AS hour, CAST(EXTRACT(dow FROM ts) AS INTEGER) AS dow,
  COUNT(*) AS req_count FROM requests WHERE {MONTH} GROUP BY ALL"""


def _rollup(unit: str) -> str:
    return f"""SELECT date_trunc('{unit}', ts) AS ts, host, COUNT(*) AS req_count, {_CLASSES}, {_BYTES},
  {_near(0.5)} AS duration_p50, {_near(0.95)} AS duration_p95, {_near(0.99)} AS duration_p99,
  COUNT(DISTINCT remote_ip) AS unique_ips
FROM requests WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY ALL"""


def _hourly(column: str) -> str:
    return f"""SELECT date_trunc('hour', ts) AS ts, host, {column}, COUNT(*) AS req_count
FROM requests WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY ALL"""


# -- security ---------------------------------------------------------------------------------

def _quoted(pattern: str) -> str:
    """A fixed pattern as it stands inside an SQL text."""
    return pattern.replace("'", "''")


_SQLI, _XSS, _TRAVERSAL = map(_quoted, (fixed.SQL_INJECTION_PATTERN, fixed.XSS_PATTERN, fixed.TRAVERSAL_PATTERN))
_SCANNERS, _BAD_BOTS = "|".join(fixed.SCANNER_WORDS), "|".join(fixed.BAD_BOT_WORDS)
_UA = "lower(COALESCE(user_agent, ''))"
_URI = "lower(COALESCE(uri, ''))"

_WINDOWED = """windowed AS (
  SELECT *, COUNT(*) OVER (PARTITION BY remote_ip ORDER BY ts
      RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS in_window
  FROM requests)"""
_LOGINS = """logins AS (
  SELECT *, COUNT(*) OVER (PARTITION BY remote_ip ORDER BY ts
      RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS attempts
  FROM requests WHERE method = 'POST' AND regexp_matches(lower(path), '/login|/auth|/signin|/wp-login'))"""
_SCANS = """gaps AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY remote_ip ORDER BY ts) > INTERVAL 24 HOURS THEN 1 ELSE 0 END AS b
  FROM requests),
sess AS (
  SELECT *, SUM(b) OVER (PARTITION BY remote_ip ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM gaps),
missing AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY remote_ip, s, lower(path) ORDER BY ts) = 1 THEN 1 ELSE 0 END AS fresh
  FROM sess WHERE status = 404),
scans AS (
  SELECT *, CAST(SUM(fresh) OVER (PARTITION BY remote_ip, s ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paths
  FROM missing)"""


def _event(kind: str, severity: str, details: str, source: str, where: str) -> str:
    return f"""SELECT ts, '{kind}' AS event_type, '{severity}' AS severity, remote_ip, host, COALESCE(uri, '') AS uri,
  CAST(json_object({details}) AS VARCHAR) AS details FROM {source} WHERE {where}"""


_RULES = {
    "sec_rate_limit": _event("rate_limit_trigger", "high", "'req_per_min', in_window, 'threshold', 4", "windowed", "in_window >= 4"),
    "sec_sqli": _event("sql_injection_attempt", "high", f"'pattern', 'sqli', 'uri', {_URI}", "requests", f"regexp_matches({_URI}, '{_SQLI}')"),
    "sec_xss": _event("xss_attempt", "medium", f"'uri', {_URI}", "requests", f"regexp_matches({_URI}, '{_XSS}')"),
    "sec_traversal": _event("path_traversal", "high", f"'uri', {_URI}", "requests", f"regexp_matches({_URI}, '{_TRAVERSAL}')"),
    "sec_scanner": _event("known_scanner", "critical", f"'ua', {_UA}", "requests", f"regexp_matches({_UA}, '{_SCANNERS}')"),
    "sec_bad_bot": _event("bad_bot", "low", f"'ua', {_UA}", "requests", f"regexp_matches({_UA}, '{_BAD_BOTS}') AND NOT regexp_matches({_UA}, '{_SCANNERS}')"),
    "sec_empty_ua": _event("bad_bot", "medium", "'ua', 'empty', 'req_per_min', in_window", "windowed", f"{_UA} = '' AND in_window > 2"),
    "sec_port_scan": _event("port_scan_attempt", "high", "'unique_404_paths', paths", "scans", "paths > 2"),
    "sec_auth_fail": _event("repeated_auth_fail", "high", "'login_attempts', attempts", "logins", "attempts > 2"),
    "sec_method_abuse": _event("http_method_abuse", "medium", "'method', method", "windowed",
                               "method IN ('TRACE', 'CONNECT') OR (method = 'OPTIONS' AND in_window > 1)"),
    "sec_slow": _event("slow_request_spike", "info", "'duration_ms', duration_ms, 'threshold', 2000", "requests", "duration_ms > 2000"),
}
_STATES = f"WITH {_WINDOWED},\n{_LOGINS},\n{_SCANS}"
_EVENTS = f"{_STATES},\nevents_found AS (" + "\nUNION ALL ".join(_RULES.values()) + ")\n"


# -- alerts --------------------------------------------------------------------------------------

_TICKS = """scoped AS (
  SELECT date_trunc('minute', ts) AS minute, scope, status, response_bytes, duration_ms
  FROM requests, unnest(['*', host]) AS s(scope)),
minutes AS (
  SELECT minute, scope, COUNT(*) AS n, SUM(CASE WHEN status >= 400 THEN 1 ELSE 0 END) AS errors,
    SUM(response_bytes) AS bytes_out, trunc(COALESCE(round(quantile_cont(duration_ms, 0.95), 6), 0)) AS p95
  FROM scoped GROUP BY ALL),
ticks AS (
  SELECT minute + INTERVAL (i) MINUTE AS tick, scope, SUM(n) AS n, SUM(errors) AS errors, SUM(bytes_out) AS bytes_out,
    MAX(p95) AS p95
  FROM minutes, range(1, 6) AS r(i) GROUP BY ALL),
metrics AS (
  SELECT tick, scope, 'request_rate' AS metric, n / 5.0 AS value, 1 AS digits FROM ticks
  UNION ALL SELECT tick, scope, 'error_rate', round_even(errors / n, 4), 4 FROM ticks
  UNION ALL SELECT tick, scope, 'latency_p95', p95, 0 FROM ticks
  UNION ALL SELECT tick, scope, 'bandwidth', bytes_out, 0 FROM ticks)"""


def _metric(name: str, digits: int) -> str:
    return f"""WITH {_TICKS}
SELECT tick, scope, round_even(CAST(value AS DOUBLE), {digits}) AS shown FROM metrics WHERE metric = '{name}'"""


_FIRED = f"""{_TICKS},
rules(rule_id, name, metric, threshold, scope, pause, since) AS (VALUES
  (1, 'errors', 'error_rate', 0.2, '*', 30, TIMESTAMP '2024-01-01 02:00:00'),
  (2, 'rate', 'request_rate', 0.3, '*', 60, NULL),
  (3, 'slow site1', 'latency_p95', 1000, 'site1.example.com', 240, NULL),
  (5, 'bytes', 'bandwidth', 200000, '*', 600, NULL)),
breaches AS MATERIALIZED (
  SELECT rule_id, tick, m.metric, round_even(CAST(value AS DOUBLE), digits) AS shown,
    CAST(threshold AS DOUBLE) AS threshold, pause, since
  FROM metrics m JOIN rules r ON m.metric = r.metric AND m.scope = r.scope AND m.value > r.threshold),
following AS MATERIALIZED (
  SELECT b.rule_id, b.tick, n.tick AS next FROM breaches b
  ASOF JOIN breaches n ON b.rule_id = n.rule_id AND b.tick + to_minutes(b.pause) <= n.tick),
chain AS (
  SELECT rule_id, MIN(tick) AS tick FROM breaches
  WHERE since IS NULL OR tick - since >= to_minutes(pause) GROUP BY rule_id
  UNION ALL
  SELECT c.rule_id, f.next FROM chain c JOIN following f ON f.rule_id = c.rule_id AND f.tick = c.tick),
fired AS MATERIALIZED (
  SELECT b.rule_id, b.tick AS triggered_at,
    concat('{{"metric":"', b.metric, '","value":', CASE WHEN b.shown < 1e7 THEN CAST(b.shown AS VARCHAR) ELSE '?' END,
           ',"threshold":', CAST(b.threshold AS VARCHAR), '}}') AS details
  FROM chain c JOIN breaches b ON b.rule_id = c.rule_id AND b.tick = c.tick)"""


# -- live ------------------------------------------------------------------------------------------

def _live(where: str, key: str = "slot + i AS slot", span: float = 1800.0, copies: str = ", range(1, 7) AS r(i)") -> str:
    end = "make_timestamp(slot * 300000000) AS window_end, " if copies else ""
    classes = ", ".join(f"COUNT(*) FILTER (status_class = '{c}xx') AS req_{c}xx" for c in "2345")
    rates = ", ".join(f"round_even(req_{c}xx / elapsed, 2) AS rps_{c}xx" for c in "2345")
    return f"""WITH slots AS (
  SELECT *, epoch_us(ts) // 300000000 AS slot FROM requests WHERE {where}),
wins AS (
  SELECT {key}, COUNT(*) AS req_count, {classes},
    COUNT(DISTINCT remote_ip) AS unique_ips,
    COALESCE(list_sort(list(duration_ms) FILTER (duration_ms IS NOT NULL))[COUNT(duration_ms) // 2 + 1], 0) AS p50_ms,
    CAST(SUM(COALESCE(response_bytes, 0)) AS BIGINT) AS bytes_out,
    CAST(SUM(COALESCE(request_bytes, 0)) AS BIGINT) AS bytes_in,
    CASE WHEN COUNT(*) >= 2 THEN greatest((epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1e6, 0.5) ELSE {span} END AS elapsed
  FROM slots{copies} GROUP BY ALL)
SELECT {end}req_count, round_even(req_count / elapsed, 2) AS rps, {rates},
  round_even((req_4xx + req_5xx) / req_count, 4) AS error_rate, unique_ips, p50_ms, bytes_out, bytes_in,
  req_2xx, req_3xx, req_4xx, req_5xx FROM wins"""


# -- raw lines -------------------------------------------------------------------------------------

_READABLE = "id % 83 <> 0 AND id % 97 <> 0 AND id % 89 <> 0"
_MAPPED = "CASE WHEN id % 5 < 4 THEN concat('site', id % 5, '.example.com') WHEN id % 3 = 0 THEN 'fallback.example.com' ELSE 'unknown' END"
_PARSED = f"""WITH parsed AS (
  SELECT ts, concat('source', id % 3) AS log_source, remote_ip, method, uri, path, query,
    NULLIF(http_proto, '') AS protocol, CAST(status AS INTEGER) AS status, status_class,
    NULLIF(response_bytes, 0) AS response_bytes, NULLIF(request_bytes, 0) AS request_bytes,
    CAST(trunc((duration_ms / 1000.0)::DOUBLE * 1000) AS INTEGER) AS duration_ms,
    user_agent, referer, referer_domain, tls_version,
    CASE WHEN tls_version IS NOT NULL THEN CASE id % 4 WHEN 0 THEN 'TLS_AES_128_GCM_SHA256' WHEN 1 THEN 'TLS_AES_256_GCM_SHA384'
      WHEN 2 THEN 'TLS_CHACHA20_POLY1305_SHA256' ELSE 'UNKNOWN(4868)' END END AS tls_cipher,
    CASE WHEN tls_version IS NOT NULL THEN 'h2' END AS tls_alpn, tls_resumed,
    CASE WHEN tls_version IS NOT NULL AND id % 2 = 0 THEN FALSE END AS tls_ech,
    NULLIF(http_proto, '') AS http_proto, concat('log', id % 5 + 1) AS logger_id,
    concat('http.log.access.log', id % 5 + 1) AS logger_name,
    CASE WHEN id % 6 > 2 OR id % 6 = 1 OR (id % 6 = 0 AND tls_version IS NOT NULL) THEN host ELSE {_MAPPED} END AS host
  FROM requests WHERE {_READABLE})
"""


_LINES = """SELECT concat('source', id % 3) AS log_source, COUNT(*) AS lines,
  MAX(CASE WHEN id % 5 > 0 THEN ts END) AS newest FROM requests WHERE id % 83 <> 0 GROUP BY ALL"""


_OF_ONE_REQUEST = {
    "sec_sqli": None, "sec_xss": None, "sec_traversal": None, "sec_scanner": None, "sec_bad_bot": None, "sec_slow": None,
    "sec_method_abuse": _event("http_method_abuse", "medium", "'method', method", "parsed", "method IN ('TRACE', 'CONNECT')"),
}
_PIPELINE_EVENTS = " UNION ALL ".join(
    rule or _RULES[name].replace(" FROM requests WHERE ", " FROM parsed WHERE ") for name, rule in _OF_ONE_REQUEST.items()
)


def _parsed(columns: str) -> str:
    return f"{_PARSED} SELECT {columns} FROM parsed"


_OVER_REQUESTS = {
    # sources and sinks
    "backfill": """WITH known AS (
  SELECT MAX(ts) AS last_ts FROM requests WHERE id % 3 = 1 AND ts < TIMESTAMP '2024-01-20')
SELECT concat('source', id % 3) AS log_source, COUNT(*) AS lines FROM requests, known
WHERE id % 83 <> 0 AND id % 5 > 0 AND ts >= TIMESTAMP '2024-01-10' AND (id % 3 <> 1 OR ts > last_ts) GROUP BY ALL""",
    "read_log_lines": _LINES,
    "tail_log_stream": _LINES,
    "sink_requests": """SELECT CAST(ts AS DATE) AS date, COUNT(*) AS rows, CAST(SUM(response_bytes) AS BIGINT) AS bytes_out,
  MAX(ts) AS last_ts FROM requests GROUP BY ALL""",
    "sink_parse_errors": """SELECT concat('source', id % 3) AS log_source, 'line is not valid JSON' AS error_msg,
  COUNT(*) AS lines FROM requests WHERE id % 97 = 0 AND id % 83 <> 0 GROUP BY ALL""",
    "sink_security_events": _EVENTS + "SELECT * FROM events_found",
    "recent_requests": "SELECT id, ts, host, uri FROM requests ORDER BY ts DESC, id DESC LIMIT 100",
    "retention_purge": f"""{_EVENTS}, stored AS (
  SELECT 'requests' AS table_name, ts FROM requests
  UNION ALL SELECT 'parse_errors', unnest([TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31']) FROM requests WHERE id % 97 = 0 AND id % 83 <> 0
  UNION ALL SELECT 'security_events', ts FROM events_found
  UNION ALL SELECT 'stats_minutely', ts FROM (SELECT DISTINCT date_trunc('minute', ts) AS ts, host FROM requests)
  UNION ALL SELECT 'stats_hourly', ts FROM (SELECT DISTINCT date_trunc('hour', ts) AS ts, host FROM requests))
SELECT table_name, COUNT(*) FILTER (ts < TIMESTAMP '2024-01-10 12:00:00') AS purged,
  COUNT(*) FILTER (ts >= TIMESTAMP '2024-01-10 12:00:00') AS kept FROM stored GROUP BY table_name""",
    # parsing
    "parse_lines": _parsed("*"),
    "parse_outcomes": """SELECT CASE WHEN id % 83 = 0 THEN 'skip' WHEN id % 97 = 0 THEN 'error' WHEN id % 89 = 0 THEN 'skip'
  ELSE 'row' END AS outcome, COUNT(*) AS lines FROM requests GROUP BY ALL""",
    "p_timestamp": _parsed("ts"),
    "p_client_ip": _parsed("ts, remote_ip"),
    "resolve_host": _parsed("ts, host, logger_id"),
    "p_numeric": _parsed("ts, status, response_bytes, request_bytes, duration_ms"),
    "p_headers": _parsed("ts, user_agent, referer, referer_domain"),
    "p_truncate": _parsed("ts, " + ", ".join(
        f"substr({c}, 1, {fixed.FIELD_LENGTHS[c]}) AS {c}, length(substr({c}, 1, {fixed.FIELD_LENGTHS[c]})) AS {c}_length"
        for c in ("method", "uri", "path", "query", "http_proto", "logger_id", "logger_name"))),
    # enrichment
    "enrich_geo": "SELECT id, remote_ip, country_code, country_name, city, latitude, longitude FROM requests",
    "enrich_ua": "SELECT user_agent, ua_browser, ua_os, ua_device, COUNT(*) AS req_count FROM requests GROUP BY ALL",
    "is_bot": "SELECT id, is_bot FROM requests",
    "threat_score": "SELECT id, threat_score FROM requests",
    # predicates and pages
    "filter_requests": f"""SELECT id, ts, path, country_code FROM requests WHERE {MONTH} AND method = 'POST'
  AND status_class = '2xx' AND path LIKE '%purchase/_%' AND country_code = 'NE'""",
    "time_range": """WITH ranges(period, bucket, hint, a, b) AS (VALUES
  ('l15m', '1 minute', 'minute', TIMESTAMP '2024-01-30 23:45:00', TIMESTAMP '2024-01-31'),
  ('l1h', '1 minute', 'minute', TIMESTAMP '2024-01-30 23:00:00', TIMESTAMP '2024-01-31'),
  ('l6h', '15 minutes', '15min', TIMESTAMP '2024-01-30 18:00:00', TIMESTAMP '2024-01-31'),
  ('l24h', '1 hour', 'hour', TIMESTAMP '2024-01-30', TIMESTAMP '2024-01-31'),
  ('l7d', '8 hours', '8hour', TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-31'),
  ('l30d', '1 day', 'day', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31'),
  ('day', '1 hour', 'hour', TIMESTAMP '2024-01-12 22:00:00', TIMESTAMP '2024-01-13 22:00:00'),
  ('bad date', '8 hours', '8hour', TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-31'))
SELECT period, bucket, hint, COUNT(ts) AS req_count FROM ranges LEFT JOIN requests ON ts BETWEEN a AND b GROUP BY ALL""",
    "drop_country_filter": _COUNTRIES.format(where="AND method = 'GET'"),
    "requests_page": f"""SELECT id, ts, host, remote_ip, method, uri, path, status, duration_ms, response_bytes, request_bytes,
  user_agent, ua_browser, ua_os, ua_device, country_code, country_name, city, referer, tls_version, http_proto, is_bot,
  threat_score FROM requests WHERE {MONTH} ORDER BY duration_ms DESC NULLS LAST, id LIMIT 50 OFFSET 100""",
    "requests_total": f"SELECT COUNT(*) AS total FROM requests WHERE {MONTH}",
    "request_by_id": """SELECT * EXCLUDE (country_code, country_name, city, latitude, longitude) FROM requests
ORDER BY duration_ms DESC NULLS LAST, id DESC LIMIT 1""",
    "requests_by_ids": """SELECT * EXCLUDE (country_code, country_name, city, latitude, longitude) FROM requests
QUALIFY row_number() OVER (PARTITION BY host ORDER BY duration_ms DESC NULLS LAST, id DESC) = 1""",
    "stream_filter": """SELECT id, path, status FROM requests
WHERE host = 'site1.example.com' AND status_class = '4xx' AND contains(path, 'error/1')""",
    # reports
    "overview": _OVERVIEW,
    "timeseries": _timeseries("1 day"),
    "timeseries_hourly": _timeseries("1 hour"),
    "timeseries_8_hours": _timeseries("8 hours"),
    "bandwidth": f"SELECT time_bucket(INTERVAL '1 day', ts) AS ts, {_BYTES} FROM requests WHERE {MONTH} GROUP BY 1",
    "performance": f"""SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, {_cut(0.5)} AS p50, {_cut(0.75)} AS p75,
  {_cut(0.9)} AS p90, {_cut(0.95)} AS p95, {_cut(0.99)} AS p99
FROM requests WHERE {MONTH} AND duration_ms IS NOT NULL GROUP BY 1""",
    "top_paths": f"""SELECT path, COUNT(*) AS req_count, CAST(round_even(COALESCE(AVG(duration_ms), 0), 0) AS INTEGER) AS avg_ms,
  CAST(SUM(COALESCE(response_bytes, 0)) AS BIGINT) AS bytes_out
FROM requests WHERE {MONTH} AND path IS NOT NULL GROUP BY path ORDER BY req_count DESC, path LIMIT 20""",
    "top_ips": f"""SELECT remote_ip, COUNT(*) AS req_count, round_even({_ERROR_RATE}, 3) AS error_rate,
  CAST(MAX(threat_score) AS INTEGER) AS threat_score, MAX(country_code) AS country_code, MAX(country_name) AS country_name,
  MAX(ts) AS last_seen FROM requests WHERE {MONTH} GROUP BY remote_ip ORDER BY req_count DESC, remote_ip LIMIT 20""",
    "top_countries": _COUNTRIES.format(where="") + " ORDER BY req_count DESC, country_code, country_name LIMIT 20",
    "top_cities": f"""SELECT city, COALESCE(country_name, country_code, 'Unknown') AS country_name,
  COALESCE(country_code, '') AS country_code, req_count, unique_ips FROM (
  SELECT city, country_name, country_code, COUNT(*) AS req_count, COUNT(DISTINCT remote_ip) AS unique_ips
  FROM requests WHERE {MONTH} AND city IS NOT NULL AND city <> '' GROUP BY ALL
  ORDER BY req_count DESC, city, country_name, country_code LIMIT 30)""",
    "distinct_countries": f"""SELECT DISTINCT country_code AS code, COALESCE(country_name, country_code) AS name
FROM requests WHERE {MONTH} AND country_code IS NOT NULL AND country_code <> ''""",
    "status_codes": _counts("status", "status"),
    "browsers": _counts("ua_browser", "browser", limit="LIMIT 20"),
    "devices": _counts("ua_device", "device"),
    "os": _counts("ua_os", "os", "AND ua_os <> ''", "LIMIT 20"),
    "referers": _counts("referer_domain", "domain", "AND referer_domain <> ''", "LIMIT 20"),
    "hosts_summary": _HOSTS,
    "geo_map": f"""SELECT country_code, country_name, latitude AS lat, longitude AS lon, COUNT(*) AS req_count,
  COUNT(DISTINCT remote_ip) AS unique_ips FROM requests
WHERE {MONTH} AND country_code IS NOT NULL AND latitude IS NOT NULL GROUP BY ALL""",
    "paths_by_status": _PATHS + " ORDER BY total DESC, path LIMIT 30",
    "slowest_paths": f"""SELECT path, COUNT(*) AS req_count, {_near(0.5)} AS p50_ms, {_near(0.95)} AS p95_ms,
  CAST(round_even(AVG(duration_ms), 0) AS INTEGER) AS avg_ms
FROM requests WHERE {MONTH} AND path IS NOT NULL AND duration_ms IS NOT NULL GROUP BY path HAVING COUNT(*) >= 3
ORDER BY p95_ms DESC NULLS LAST, path LIMIT 20""",
    "busy_hours": _BUSY,
    "protocol_breakdown": f"""SELECT COALESCE(NULLIF(http_proto, ''), 'Unknown') AS protocol, COUNT(*) AS req_count
FROM requests WHERE {MONTH} GROUP BY 1""",
    "bot_share": f"""SELECT round_even(AVG(CASE WHEN is_bot THEN 1.0 ELSE 0.0 END) * 100, 1) AS bot_pct,
  COUNT(*) FILTER (is_bot) AS bot_count FROM requests WHERE {MONTH}""",
    "host_top_referers": f"""SELECT referer_domain AS domain, COUNT(*) AS req_count FROM requests
WHERE {MONTH} AND host = 'site1.example.com' AND referer_domain <> '' GROUP BY 1 ORDER BY req_count DESC, domain LIMIT 15""",
    # address profiles
    "ip_profile": _PROFILE,
    "ip_profile_top_paths": f"""SELECT remote_ip, path, COUNT(*) AS count FROM requests WHERE {MONTH} AND path IS NOT NULL
GROUP BY remote_ip, path QUALIFY row_number() OVER (PARTITION BY remote_ip ORDER BY COUNT(*) DESC, path) <= 10""",
    "ip_hosts": f"""SELECT remote_ip, host, COUNT(*) AS req_count, round_even({_ERROR_RATE}, 3) AS error_rate
FROM requests WHERE {MONTH} GROUP BY remote_ip, host
QUALIFY row_number() OVER (PARTITION BY remote_ip ORDER BY COUNT(*) DESC, host) <= 20""",
    "ip_timeline": f"""SELECT remote_ip, date_trunc('hour', ts) AS ts, COUNT(*) AS req_count, {_CLASSES}, {_BYTES},
  COALESCE({_near(0.5)}, 0) AS p50_ms FROM requests WHERE {MONTH} GROUP BY ALL""",
    "ip_methods": f"SELECT remote_ip, method, COUNT(*) AS count FROM requests WHERE {MONTH} AND method IS NOT NULL GROUP BY ALL",
    "ip_status_codes": f"SELECT remote_ip, status, COUNT(*) AS req_count FROM requests WHERE {MONTH} AND status IS NOT NULL GROUP BY ALL",
    "ip_busy_hours": _IP_HOURS,
    "ip_modal_attrs": "WITH " + ",\n".join(
        f"""m_{name} AS (SELECT remote_ip, {column} AS v FROM requests WHERE {MONTH} AND {column} IS NOT NULL AND {column} <> ''
  GROUP BY remote_ip, {column} QUALIFY row_number() OVER (PARTITION BY remote_ip ORDER BY COUNT(*) DESC, {column}) = 1)"""
        for name, column in (("b", "ua_browser"), ("o", "ua_os"), ("t", "tls_version"), ("p", "http_proto"))
    ) + """
SELECT i.remote_ip, m_b.v AS browser, m_o.v AS os, m_t.v AS tls_version, m_p.v AS http_proto
FROM (SELECT DISTINCT remote_ip FROM requests) i LEFT JOIN m_b USING (remote_ip) LEFT JOIN m_o USING (remote_ip)
LEFT JOIN m_t USING (remote_ip) LEFT JOIN m_p USING (remote_ip)""",
    "ip_misc": f"""SELECT remote_ip, round_even(AVG(CASE WHEN is_bot THEN 1.0 ELSE 0.0 END) * 100, 1) AS is_bot_pct,
  round_even(AVG(CASE WHEN tls_resumed IS TRUE THEN 1.0 WHEN tls_version IS NOT NULL THEN 0.0 END) * 100, 1) AS tls_resumed_pct,
  CAST(SUM(COALESCE(request_bytes, 0)) AS BIGINT) AS total_bytes_in,
  CAST(SUM(COALESCE(response_bytes, 0)) AS BIGINT) AS total_bytes_out FROM requests WHERE {MONTH} GROUP BY remote_ip""",
    "ip_latency": f"""SELECT remote_ip, CAST(round_even(AVG(duration_ms), 0) AS INTEGER) AS avg_ms, {_near(0.95)} AS p95_ms
FROM requests WHERE {MONTH} AND duration_ms IS NOT NULL GROUP BY remote_ip""",
    "ip_sample_ua": f"""SELECT remote_ip, MIN(user_agent) AS sample_ua FROM requests
WHERE {MONTH} AND user_agent IS NOT NULL AND user_agent <> '' GROUP BY remote_ip""",
    # rollups
    "rollup_minutely": _rollup("minute"),
    "rollup_hourly": _rollup("hour"),
    "rollup_daily": f"SELECT * EXCLUDE (duration_p50, duration_p95, duration_p99, unique_ips) FROM ({_rollup('day')})",
    "rollup_top_paths_hourly": _hourly("path"),
    "rollup_top_ips_hourly": _hourly("remote_ip"),
    # security
    "sec_window_60s": f"WITH {_WINDOWED} SELECT id, remote_ip, in_window FROM windowed",
    **{name: f"{_STATES}\n{sql}" for name, sql in _RULES.items()},
    "security_events": _EVENTS + "SELECT * FROM events_found",
    "security_events_page": f"""{_EVENTS} SELECT ts, event_type, remote_ip, json_extract_string(details, '$.uri') AS detail_uri
FROM events_found WHERE {MONTH} AND severity = 'high' ORDER BY ts DESC, event_type LIMIT 25 OFFSET 5""",
    "security_events_total": f"""{_EVENTS} SELECT COUNT(*) AS total FROM events_found
WHERE {MONTH} AND severity = 'medium'""",
    "security_event_by_id": f"""{_EVENTS} SELECT ts, event_type, remote_ip, details FROM events_found
ORDER BY ts DESC, event_type DESC, severity DESC LIMIT 1""",
    "top_threats": f"""SELECT remote_ip, COUNT(*) AS event_count, CAST(MAX(threat_score) AS INTEGER) AS max_score,
  MAX(country_code) AS country_code, MIN(ts) AS first_seen, MAX(ts) AS last_seen
FROM requests WHERE {MONTH} AND threat_score > 0 GROUP BY remote_ip
ORDER BY max_score DESC, event_count DESC, remote_ip LIMIT 20""",
    # alerts
    "alert_request_rate": _metric("request_rate", 1),
    "alert_error_rate": _metric("error_rate", 4),
    "alert_latency_p95": _metric("latency_p95", 0),
    "alert_bandwidth": _metric("bandwidth", 0),
    "alert_security_event": f"""{_EVENTS}, found AS (
  SELECT date_trunc('minute', ts) AS minute, scope FROM events_found, unnest(['*', host]) AS s(scope))
SELECT minute + INTERVAL (i) MINUTE AS tick, scope, CAST(COUNT(*) AS DOUBLE) AS shown
FROM found, range(1, 6) AS r(i) GROUP BY ALL""",
    "alert_evaluate": f"WITH RECURSIVE {_FIRED} SELECT * FROM fired",
    "alert_record": f"""WITH RECURSIVE {_FIRED}
SELECT id, name, COALESCE((SELECT MAX(triggered_at) FROM fired WHERE rule_id = id), since) AS last_triggered
FROM (VALUES (1, 'errors', TIMESTAMP '2024-01-01 02:00:00'), (2, 'rate', NULL), (3, 'slow site1', NULL), (4, 'disabled', NULL),
  (5, 'bytes', NULL), (6, 'other kind', NULL)) AS t(id, name, since)""",
    "alert_history": f"""WITH RECURSIVE {_FIRED}
SELECT f.rule_id, name AS rule_name, triggered_at, details FROM fired f LEFT JOIN rules USING (rule_id)
ORDER BY triggered_at DESC, f.rule_id LIMIT 20 OFFSET 3""",
    # streams give out what the watermark (five minutes behind the newest request) has closed
    "stream_rollup": f"""SELECT * FROM ({_rollup('hour')})
WHERE ts + INTERVAL 1 HOUR <= (SELECT MAX(ts) - INTERVAL 5 MINUTE FROM requests)""",
    "stream_live_metrics": f"""SELECT * FROM ({_live('TRUE')})
WHERE window_end <= (SELECT MAX(ts) - INTERVAL 5 MINUTE FROM base)""",
    "stream_security": _EVENTS + "SELECT * FROM events_found",
    "stream_pipeline": f"""{_PARSED}, found AS ({_PIPELINE_EVENTS})
SELECT 'requests' AS stored, p.ts, p.host, p.remote_ip, p.log_source, p.path, p.status, p.user_agent, r.ua_browser, r.ua_device,
  r.is_bot, r.threat_score, r.country_code, r.city, NULL AS what, NULL AS severity, NULL AS details
FROM parsed p JOIN requests r USING (ts)
UNION ALL SELECT 'events', ts, host, remote_ip, NULL, uri, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, event_type, severity, details FROM found
UNION ALL SELECT 'errors', NULL, NULL, NULL, concat('source', id % 3), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  'line is not valid JSON', NULL, NULL FROM requests WHERE id % 97 = 0 AND id % 83 <> 0""",
    # live and derived
    "live_metrics": _live("TRUE"),
    "keep_live_metrics": _live("TRUE"),
    "keep_rollup": _rollup("minute"),
    "live_metrics_at": _live(
        "ts BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-30'", "1 AS one", 86400.0, ""),
    "live_metrics_uneven": """SELECT make_timestamp(e * 420000000) AS window_end, COUNT(*) AS req_count,
  COUNT(DISTINCT remote_ip) AS unique_ips
FROM (SELECT remote_ip, unnest(range(epoch_us(ts) // 420000000 + 1, (epoch_us(ts) + 1800000000) // 420000000 + 1)) AS e
  FROM requests) GROUP BY ALL""",
    "live_metrics_filtered": _live("host = 'site2.example.com' AND method = 'POST' AND contains(path, '/p')"),
    "health_level": f"""SELECT total_requests, error_rate, CASE WHEN error_rate > 0.1 THEN 'critical'
  WHEN error_rate > 0.05 THEN 'degraded' ELSE 'healthy' END AS level FROM ({_OVERVIEW}) WHERE total_requests > 0""",
    "status_distribution": f"""SELECT status_class, COUNT(*) AS req_count,
  round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 1) AS pct FROM requests WHERE {MONTH} GROUP BY status_class""",
    "geo_share": f"""SELECT country_code, country_name, req_count, CAST(floor(error_rate * req_count + 0.5) AS BIGINT) AS errors,
  round(req_count * 100.0 / SUM(req_count) OVER (), 1) AS share_pct FROM (
  {_COUNTRIES.format(where='')})""",
    "worst_country": f"""SELECT country_code, round(error_rate * 100, 1) AS error_pct FROM ({_COUNTRIES.format(where='')})
ORDER BY error_rate DESC, req_count DESC, country_code LIMIT 1""",
    "share_of_total": f"""SELECT browser, req_count, round(req_count * 100.0 / SUM(req_count) OVER (), 1) AS share_pct
FROM ({_counts('ua_browser', 'browser', limit='')})""",
    "heatmap_dense": f"""WITH busy AS ({_BUSY}),
grid AS (SELECT CAST(i // 24 AS INTEGER) AS day, CAST(i % 24 AS INTEGER) AS hour FROM range(168) AS r(i)),
dense AS (
  SELECT day, g.hour, COALESCE(req_count, 0) AS req_count FROM grid g LEFT JOIN busy b ON b.hour = g.hour AND (b.dow + 6) % 7 = g.day)
SELECT day, hour, req_count, CASE WHEN req_count = 0 THEN 0 ELSE CASE WHEN r < 0.12 THEN 1 WHEN r < 0.25 THEN 2 WHEN r < 0.45 THEN 3
  WHEN r < 0.65 THEN 4 WHEN r < 0.82 THEN 5 ELSE 6 END END AS level
FROM (SELECT *, req_count / greatest(MAX(req_count) OVER (), 1) AS r FROM dense)""",
    "ip_hours_dense": f"""WITH busy AS ({_IP_HOURS}),
grid AS (SELECT remote_ip, CAST(i AS INTEGER) AS hour FROM (SELECT DISTINCT remote_ip FROM busy), range(24) AS r(i))
SELECT g.remote_ip, g.hour, COALESCE(req_count - err_count, 0) AS ok, COALESCE(err_count, 0) AS err,
  bool_and(req_count IS NOT NULL) OVER (PARTITION BY g.remote_ip) AS active_every_hour
FROM grid g LEFT JOIN busy b ON b.remote_ip = g.remote_ip AND b.hour = g.hour""",
    "threat_level": f"""SELECT remote_ip, max_threat, CASE WHEN max_threat > 70 THEN 'HIGH' WHEN max_threat > 40 THEN 'MEDIUM'
  ELSE 'LOW' END AS threat_level FROM ({_PROFILE})""",
    "severity_counts": _EVENTS + """SELECT position, severity, (SELECT COUNT(*) FROM events_found e WHERE e.severity = s.severity) AS count
FROM (VALUES (0, 'critical'), (1, 'high'), (2, 'medium'), (3, 'low'), (4, 'info')) AS s(position, severity)""",
    "event_type_top": _EVENTS + """SELECT replace(event_type, '_', ' ') AS type, COUNT(*) AS count FROM events_found
GROUP BY event_type ORDER BY count DESC, type LIMIT 8""",
    "serious_events": _EVENTS + "SELECT COUNT(*) AS critical_count FROM events_found WHERE severity IN ('critical', 'high')",
    "paths_filtered_by_class": f"SELECT * FROM ({_PATHS}) WHERE req_4xx > 0",
    "path_class_totals": f"""SELECT CAST(SUM(total) AS BIGINT) AS total, CAST(SUM(req_2xx) AS BIGINT) AS req_2xx,
  CAST(SUM(req_3xx) AS BIGINT) AS req_3xx, CAST(SUM(req_4xx) AS BIGINT) AS req_4xx, CAST(SUM(req_5xx) AS BIGINT) AS req_5xx
FROM ({_PATHS})""",
    "peak_visitors": f"SELECT MAX(unique_ips) AS peak FROM ({_timeseries('1 hour')})",
    "live_by_country": """SELECT country_code AS code, MIN(country_name) AS name, COUNT(*) AS count FROM requests
WHERE country_code <> '' GROUP BY country_code""",
    "live_by_host": "SELECT host, COUNT(*) AS count FROM requests GROUP BY host",
    "live_by_ip": """SELECT remote_ip, COUNT(*) AS count, CAST(arg_min(threat_score, ts) AS INTEGER) AS threat,
  MIN(country_code) AS country FROM requests GROUP BY remote_ip ORDER BY remote_ip LIMIT 10""",
    "live_breakdowns": """SELECT COUNT(DISTINCT remote_ip) AS unique_ips, COUNT(DISTINCT country_code) AS unique_countries,
  COUNT(DISTINCT host) AS active_hosts FROM requests""",
    "host_error_flag": f"SELECT host, error_rate, error_rate > 0.05 AS error_high FROM ({_HOSTS})",
    "ip_list_match": """WITH ips AS (
  SELECT DISTINCT remote_ip AS ip, CAST(split_part(remote_ip, '.', 3) AS INT) * 256 + CAST(split_part(remote_ip, '.', 4) AS INT) AS n,
    4 AS family FROM requests
  UNION SELECT DISTINCT concat('2001:db', user_id % 10, '::', hex(user_id)), user_id % 10, 6 FROM events)
SELECT ip, family = 4 AND (n BETWEEN 64 AND 79 OR n = 3) AS whitelisted,
  CASE WHEN family = 4 AND n BETWEEN 64 AND 79 THEN 3 WHEN family = 4 AND n = 3 THEN 6 END AS white_id,
  CASE WHEN family = 4 AND n BETWEEN 64 AND 79 THEN FALSE WHEN family = 4 AND n = 3 THEN TRUE END AS white_individual,
  (family = 4 AND n < 64) OR (family = 6 AND n = 8) AS blocked,
  CASE WHEN family = 4 AND n < 64 THEN 1 WHEN family = 6 AND n = 8 THEN 5 END AS block_id,
  CASE WHEN family = 4 AND n < 64 THEN 'block range' WHEN family = 6 AND n = 8 THEN '' END AS block_note,
  CASE WHEN (family = 4 AND n < 64) OR (family = 6 AND n = 8) THEN FALSE END AS block_individual FROM ips""",
}

_NETLOC = "regexp_extract(url, '^https?://([^/?#]*)', 1)"

_OVER_TABLES = {
    "clean_host": f"""SELECT page_id, CASE page_id % 4 WHEN 2 THEN concat('2001:db8::', lower(hex(page_id)))
  WHEN 3 THEN concat('2001:db8::', lower(hex(page_id))) ELSE lower({_NETLOC}) END AS host FROM pages""",
    "split_uri": """SELECT page_id,
  CASE WHEN page_id % 3 = 1 AND contains(rest, '?') THEN split_part(rest, '?', 1)
       WHEN page_id % 3 = 1 AND contains(rest, '#') THEN split_part(rest, '#', 1)
       WHEN page_id % 3 = 1 THEN rest
       ELSE split_part(split_part(rest, '#', 1), '?', 1) END AS path,
  CASE WHEN page_id % 3 = 1 AND contains(rest, '#') AND contains(rest, '?') THEN split_part(split_part(rest, '?', 2), '#', 1)
       WHEN page_id % 3 = 1 AND contains(rest, '#') THEN ''
       WHEN page_id % 3 = 1 AND contains(rest, '?') THEN concat(split_part(rest, '?', 2), ';v=1?a=b')
       WHEN page_id % 3 = 1 THEN 'a=b'
       ELSE split_part(split_part(rest, '#', 1), '?', 2) END AS query
FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS rest FROM pages)""",
    "referer_domain": f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {_NETLOC} ELSE concat('user:pw@', {_NETLOC}) END AS domain
FROM pages""",
    "status_class": """SELECT status, CASE WHEN status >= 200 AND status < 300 THEN '2xx' WHEN status >= 300 AND status < 400 THEN '3xx'
  WHEN status >= 400 AND status < 500 THEN '4xx' WHEN status >= 500 AND status < 600 THEN '5xx' END AS status_class, COUNT(*) AS n
FROM (SELECT CASE WHEN event_id % 13 > 0 THEN CAST(100 + (event_id * 7) % 600 AS INTEGER) END AS status FROM events) GROUP BY ALL""",
    "tls_decode": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'TLS 1.0' WHEN 1 THEN 'TLS 1.1' WHEN 2 THEN 'TLS 1.2'
  WHEN 4 THEN 'UNKNOWN(773)' ELSE 'TLS 1.3' END AS tls_version,
  CASE event_id % 3
    WHEN 0 THEN ['TLS_AES_128_GCM_SHA256', 'TLS_AES_256_GCM_SHA384', 'TLS_CHACHA20_POLY1305_SHA256', 'UNKNOWN(4868)'][event_id % 4 + 1]
    WHEN 1 THEN ['TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256', 'TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384', 'UNKNOWN(49197)', 'UNKNOWN(49198)',
                 'TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256', 'TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384'][event_id % 6 + 1]
    ELSE ['TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305', 'TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305', 'UNKNOWN(52394)'][event_id % 3 + 1] END AS tls_cipher
FROM events""",
}


def oracle_sql() -> dict[str, str]:
    return {**{name: over_requests(sql) for name, sql in _OVER_REQUESTS.items()}, **_OVER_TABLES}
