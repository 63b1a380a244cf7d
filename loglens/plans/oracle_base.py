"""The projection of the given tables to an access log, in DuckDB SQL."""

REQUESTS = """
WITH base AS (
  SELECT e.event_id AS id, e.ts, e.k,
    concat('site', e.user_id % 4, '.example.com') AS host,
    concat('203.', (e.user_id // 65536) % 256, '.', (e.user_id // 256) % 256, '.', e.user_id % 256) AS remote_ip,
    CASE WHEN k = 99 THEN 'TRACE' WHEN k = 98 THEN 'OPTIONS'
         WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN event_type = 'signup' THEN '/login' ELSE concat('/', event_type, '/', k % 25) END AS path,
    CASE WHEN k = 97 THEN 'id=1 union select x' WHEN k = 96 THEN 'q=<script>'
         WHEN k = 95 THEN 'f=../../etc/passwd' WHEN k % 10 = 0 THEN concat('page=', k) END AS query,
    CAST(CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 500 ELSE 503 END
              WHEN k % 20 = 0 THEN 304 ELSE 200 END AS SMALLINT) AS status,
    CAST(floor(value * 1000) AS BIGINT) AS response_bytes,
    CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(k * 16 AS BIGINT) END AS request_bytes,
    CASE WHEN k % 50 = 7 THEN NULL ELSE CAST(floor(value * 10) AS INT) END AS duration_ms,
    CASE k % 8 WHEN 0 THEN 'sqlmap/1.8.4' WHEN 1 THEN 'AhrefsBot/7.0' WHEN 2 THEN NULL
         WHEN 3 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/131.0.0.0 Safari/537.36'
         WHEN 4 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:133.0) Gecko/20100101 Firefox/133.0'
         WHEN 5 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) Version/17.2 Mobile/15E148 Safari/604.1'
         WHEN 6 THEN 'Googlebot/2.1' ELSE 'curl/8.5.0' END AS user_agent,
    CASE k % 5 WHEN 0 THEN 'https://www.google.com/' WHEN 1 THEN 'https://t.co/abc123'
         WHEN 2 THEN 'https://github.com/x?y=1' END AS referer,
    CASE k % 5 WHEN 0 THEN 'www.google.com' WHEN 1 THEN 't.co' WHEN 2 THEN 'github.com' END AS referer_domain,
    CASE WHEN k % 7 = 0 THEN NULL WHEN k % 4 = 0 THEN 'TLS 1.2' ELSE 'TLS 1.3' END AS tls_version,
    CASE WHEN k % 7 = 0 THEN NULL ELSE k % 3 = 0 END AS tls_resumed,
    CASE WHEN k % 11 = 0 THEN '' WHEN k % 4 = 0 THEN 'HTTP/1.1' ELSE 'HTTP/2.0' END AS http_proto,
    CAST(203 AS BIGINT) * 16777216 + e.user_id AS ip_num
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e
),
geo AS (
  SELECT CAST(203 AS BIGINT) * 16777216 + n_nationkey * 6 AS lo,
    CAST(203 AS BIGINT) * 16777216 + n_nationkey * 6 + 4 AS hi,
    concat('N', chr(CAST(65 + n_nationkey AS INT))) AS country_code, n_name AS country_name,
    CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat('CITY_', n_nationkey) END AS city,
    CAST(n_nationkey * 5 - 60 AS DOUBLE) AS latitude, CAST(n_nationkey * 10 - 120 AS DOUBLE) AS longitude
  FROM nation
),
requests AS (
  SELECT b.* EXCLUDE (k, ip_num), concat_ws('?', path, query) AS uri,
    CASE WHEN status BETWEEN 200 AND 299 THEN '2xx' WHEN status BETWEEN 300 AND 399 THEN '3xx'
         WHEN status BETWEEN 400 AND 499 THEN '4xx' WHEN status BETWEEN 500 AND 599 THEN '5xx' END AS status_class,
    http_proto AS protocol,
    CASE k % 8 WHEN 0 THEN 'Other' WHEN 1 THEN 'AhrefsBot 7' WHEN 2 THEN NULL WHEN 3 THEN 'Chrome 131'
         WHEN 4 THEN 'Firefox 133' WHEN 5 THEN 'Mobile Safari 17' WHEN 6 THEN 'Googlebot 2' ELSE 'curl 8' END AS ua_browser,
    CASE k % 8 WHEN 2 THEN NULL WHEN 3 THEN 'Windows 10' WHEN 4 THEN 'Linux' WHEN 5 THEN 'iOS 17' ELSE 'Other' END AS ua_os,
    CASE k % 8 WHEN 3 THEN 'desktop' WHEN 4 THEN 'desktop' WHEN 5 THEN 'mobile' ELSE 'bot' END AS ua_device,
    k % 8 IN (0, 1, 2, 7) AS is_bot,
    CAST(CASE WHEN k % 8 IN (0, 1, 7) THEN 40 WHEN k % 8 = 2 THEN 15 ELSE 0 END
      + CASE WHEN status IN (400, 401, 403, 404, 405, 429) THEN 5 ELSE 0 END AS SMALLINT) AS threat_score,
    g.country_code, g.country_name, g.city, g.latitude, g.longitude
  FROM base b LEFT JOIN geo g ON b.ip_num BETWEEN g.lo AND g.hi
)
"""


def over_requests(sql: str) -> str:
    """``sql`` over the CTE ``requests`` (and ``geo``)."""
    lead = sql.lstrip()
    if lead.upper().startswith("WITH RECURSIVE "):
        return REQUESTS.strip().replace("WITH base", "WITH RECURSIVE base", 1) + ",\n" + lead[len("WITH RECURSIVE "):]
    if lead.upper().startswith("WITH "):
        return REQUESTS.strip() + ",\n" + lead[len("WITH "):]
    return REQUESTS.strip() + "\n" + lead
