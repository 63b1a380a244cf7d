"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

REQUESTS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("host", T.StringType(), False),
        T.StructField("remote_ip", T.StringType(), False),
        T.StructField("method", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("status", T.ShortType()),
        T.StructField("status_class", T.StringType()),
        T.StructField("response_bytes", T.LongType()),
        T.StructField("request_bytes", T.LongType()),
        T.StructField("duration_ms", T.IntegerType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("ua_browser", T.StringType()),
        T.StructField("ua_os", T.StringType()),
        T.StructField("ua_device", T.StringType()),
        T.StructField("referer", T.StringType()),
        T.StructField("referer_domain", T.StringType()),
        T.StructField("tls_version", T.StringType()),
        T.StructField("tls_cipher", T.StringType()),
        T.StructField("tls_alpn", T.StringType()),
        T.StructField("tls_resumed", T.BooleanType()),
        T.StructField("tls_ech", T.BooleanType()),
        T.StructField("http_proto", T.StringType()),
        T.StructField("logger_id", T.StringType()),
        T.StructField("country_code", T.StringType()),
        T.StructField("country_name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("asn", T.IntegerType()),
        T.StructField("org", T.StringType()),
        T.StructField("is_bot", T.BooleanType()),
        T.StructField("threat_score", T.ShortType()),
        T.StructField("log_source", T.StringType()),
        T.StructField("logger_name", T.StringType()),
    ]
)

REQUEST_COLUMNS = REQUESTS_SCHEMA.fieldNames()

SECURITY_EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("severity", T.StringType()),
        T.StructField("remote_ip", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("alert_sent", T.BooleanType()),
    ]
)

ALERT_CONDITIONS_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("host", T.StringType()),
    ]
)
