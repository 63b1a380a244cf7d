"""The given tables read as an access log.

The tables hold no access log, so ``events`` is projected to one: every event is one
request, ``nation`` gives the address ranges of countries, ``pages`` gives URLs. Only the
(lazy) plans are remembered, no data.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.functions.text import authority, none_if_empty, status_class
from loglens.operators.enrich import classify_agents, enrich_geo, score_threats
from loglens.session import scratch_path

_REQUESTS = """
SELECT event_id AS id, ts,
  concat('site', user_id % 4, '.example.com') AS host,
  concat_ws('.', '203', (user_id div 65536) % 256, (user_id div 256) % 256, user_id % 256) AS remote_ip,
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
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 4 = 0 THEN 'TLS 1.2' ELSE 'TLS 1.3' END AS tls_version,
  CASE WHEN k % 7 = 0 THEN NULL ELSE k % 3 = 0 END AS tls_resumed,
  CASE WHEN k % 11 = 0 THEN '' WHEN k % 4 = 0 THEN 'HTTP/1.1' ELSE 'HTTP/2.0' END AS http_proto
FROM (SELECT *, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events})
"""

_GEO = """
SELECT CAST(203 AS BIGINT) * 16777216 + n_nationkey * 6 AS first,
  CAST(203 AS BIGINT) * 16777216 + n_nationkey * 6 + 4 AS last,
  concat('N', chr(65 + n_nationkey)) AS country_code, n_name AS country_name,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat('CITY_', n_nationkey) END AS city,
  CAST(n_nationkey * 5 - 60 AS DOUBLE) AS latitude, CAST(n_nationkey * 10 - 120 AS DOUBLE) AS longitude
FROM {nation}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_requests(events: DataFrame) -> DataFrame:
    """Events (batch or streaming) as bare requests, before enrichment."""
    rows = events.sparkSession.sql(_REQUESTS, events=events)
    return rows.withColumns(
        {
            "uri": F.concat_ws("?", "path", "query"),
            "status_class": status_class(F.col("status")),
            "protocol": F.col("http_proto"),
            "referer_domain": none_if_empty(authority(F.col("referer"))),
        }
    )


@lru_cache(maxsize=8)
def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country ranges in dotted form; the last address of each block of six is in none."""
    ranges = spark.sql(_GEO, nation=table(spark, sf_dir, "nation"))

    def dotted(number: str):
        n = F.col(number)
        return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])

    return ranges.select(
        dotted("first").alias("first_ip"), dotted("last").alias("last_ip"),
        "country_code", "country_name", "city", "latitude", "longitude",
    )


@lru_cache(maxsize=8)
def requests(spark: SparkSession, sf_dir: str, *, located: bool = False) -> DataFrame:
    """The stored requests; geography is joined only where a report reads it."""
    rows = score_threats(classify_agents(as_requests(table(spark, sf_dir, "events"))))
    return enrich_geo(rows, geo_ranges(spark, sf_dir)) if located else rows


@lru_cache(maxsize=8)
def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests written as JSON log lines, in the variants a parser has to cope with.

    By id: blank lines (83), cut lines (97), lines of another kind (89); addresses with
    port or only in the second field, hosts named in four different places or not at all,
    numbers written as text.
    """
    # A table of small rows is few splits; a line takes long to write and to parse, so its rows are dealt to all cores first.
    r = as_requests(table(spark, sf_dir, "events").repartition("event_id", "ts", "user_id"))
    n = F.col("id")
    bare_headers = {
        "User-Agent": F.col("user_agent"),
        "Referer": F.col("referer"),
        "Host": F.when(n % 6 == 1, F.col("host")),
    }
    headers = F.map_filter(
        F.create_map(*[part for name, value in bare_headers.items() for part in (F.lit(name), F.array(value))]),
        lambda _, values: F.get(values, 0).isNotNull(),
    )
    quoted = F.concat(F.lit('"'), F.col("tls_version"), F.lit('"'))
    version = F.when(n % 10 == 9, quoted).when(F.col("tls_version") == "TLS 1.3", "772").otherwise("771")
    secured = F.when(
        F.col("tls_version").isNotNull(),
        F.struct(
            F.col("tls_resumed").alias("resumed"),
            F.parse_json(version).alias("version"),
            (F.lit(4865) + n % 4).alias("cipher_suite"),
            F.lit("h2").alias("proto"),
            F.when(n % 6 == 0, F.col("host")).otherwise("").alias("server_name"),
            F.when(n % 2 == 0, False).alias("ech"),
        ),
    )
    request = F.struct(
        F.when(n % 3 == 0, F.concat("remote_ip", F.lit(":4321"))).otherwise(F.col("remote_ip")).alias("remote_ip"),
        F.when(n % 4 == 1, "").when(n % 4 > 1, F.concat(F.lit("["), "remote_ip", F.lit("]:99"))).alias("client_ip"),
        F.col("http_proto").alias("proto"),
        F.lower("method").alias("method"),
        F.when(n % 6 > 2, F.concat(F.lit(" "), F.upper("host"), F.lit(":443"))).alias("host"),
        "uri",
        headers.alias("headers"),
        secured.alias("tls"),
    )
    status = F.when(n % 7 == 0, F.concat(F.lit('"'), "status", F.lit('"'))).otherwise(F.col("status").cast("string"))
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    entry = F.to_json(
        F.struct(
            F.lit("info").alias("level"),
            F.when(n % 5 > 0, seconds).alias("ts"),
            F.when(n % 5 == 0, seconds).alias("time"),
            F.concat(F.lit("http.log.access.log"), (n % 5 + 1).cast("string")).alias("logger"),
            F.when(n % 89 == 0, "starting").otherwise("handled request").alias("msg"),
            request.alias("request"),
            F.col("request_bytes").alias("bytes_read"),
            (F.col("duration_ms") / F.lit(1000.0)).alias("duration"),
            F.col("response_bytes").alias("size"),
            F.parse_json(status).alias("status"),
        )
    )
    half = F.substring("entry", F.lit(1), (F.length("entry") / 2).cast("int"))
    line = F.when(n % 83 == 0, "   ").when(n % 97 == 0, half)
    written = r.select(F.explode(F.array(entry)).alias("entry"), F.concat(F.lit("source"), n % 3).alias("log_source"), "id")
    return written.select(line.otherwise(F.col("entry")).alias("value"), "log_source", "id")


def logger_hosts(spark: SparkSession) -> DataFrame:
    rows = [(f"log{i}", [f"site{i - 1}.example.com"]) for i in range(1, 5)]
    return spark.createDataFrame(rows, "logger_id string, hosts array<string>")


def source_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("source0", "fallback.example.com"), ("source1", "")], "log_source string, label string")


def ip_lists(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "block", "203.0.0.0/26", "block range"),
        (2, "block", "203.0.0.7/32", None),
        (3, "white", "203.0.0.64/28", "office"),
        (4, "white", "bad/99", None),
        (5, "block", "2001:db8::/32", None),
        (6, "white", "203.0.0.3", "probe"),
    ]
    return spark.createDataFrame(rows, "id int, list string, cidr string, note string")


def alert_rules(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "errors", True, "threshold", '{"metric":"error_rate","threshold":0.2}', 30, "2024-01-01 02:00:00"),
        (2, "rate", True, "threshold", '{"metric":"request_rate","threshold":0.3}', 60, None),
        (3, "slow site1", True, "threshold",
         '{"metric":"latency_p95","threshold":1000,"host":"site1.example.com"}', 240, None),
        (4, "disabled", False, "threshold", '{"metric":"request_rate","threshold":0.1}', 5, None),
        (5, "bytes", True, "threshold", '{"metric":"bandwidth","threshold":200000}', 600, None),
        (6, "other kind", True, "anomaly", '{"metric":"request_rate","threshold":0.1}', 5, None),
    ]
    schema = (
        "id int, name string, enabled boolean, rule_type string, conditions string, "
        "cooldown_minutes int, last_triggered string"
    )
    return spark.createDataFrame(rows, schema).withColumn(
        "last_triggered", F.col("last_triggered").cast("timestamp_ntz")
    )


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def stored_lines(spark: SparkSession, sf_dir: str) -> str:
    """The raw lines as text files, one folder per log source; returns the folder."""
    path = scratch(spark, "lines")
    raw_lines(spark, sf_dir).select("value", "log_source").write.partitionBy("log_source").text(path)
    return path


def request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bare requests as a stream."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return as_requests(events)
