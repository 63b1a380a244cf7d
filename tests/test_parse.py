"""Whole lines."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loglens.operators import parse
from loglens.schema import REQUEST_COLUMNS

ENTRY = {
    "level": "info",
    "ts": 1709210096.25,
    "logger": "http.log.access.edge-a",
    "msg": "handled request",
    "request": {
        "remote_ip": "198.51.100.7",
        "client_ip": "198.51.100.23",
        "proto": "HTTP/3.0",
        "method": "put",
        "host": "Depot.Example.org:8443",
        "uri": "/parcels/17?weight=heavy&fragile",
        "headers": {"User-Agent": ["parcel-robot/3 (depot)"], "Referer": ["https://desk.example.org/queue"]},
        "tls": {"resumed": False, "version": 771, "cipher_suite": 52392, "proto": "h3", "server_name": "sni.example.org", "ech": True},
    },
    "bytes_read": 4321,
    "duration": 0.25,
    "size": 1048576,
    "status": 201,
}


def _line(**changes):
    entry = json.loads(json.dumps(ENTRY))
    for path, value in changes.items():
        *parents, last = path.split("__")
        target = entry
        for parent in parents:
            target = target[parent]
        if value is None:
            del target[last]
        else:
            target[last] = value
    return json.dumps(entry)


def _parse(spark, *lines, source="s", **dimensions):
    rows = spark.createDataFrame([(line, source) for line in lines], "value string, log_source string")
    return parse.parse_lines(rows.coalesce(1), **dimensions).collect()


def test_whole_entry(spark):
    row = _parse(spark, _line())[0]
    assert row.outcome == "row" and row.error_msg is None
    assert row.ts == datetime(2024, 2, 29, 12, 34, 56, 250000)
    assert (row.remote_ip, row.host, row.method) == ("198.51.100.23", "depot.example.org", "PUT")
    assert (row.uri, row.path, row.query) == ("/parcels/17?weight=heavy&fragile", "/parcels/17", "weight=heavy&fragile")
    assert (row.status, row.status_class, row.response_bytes, row.request_bytes) == (201, "2xx", 1048576, 4321)
    assert row.duration_ms == 250
    assert (row.user_agent, row.referer) == ("parcel-robot/3 (depot)", "https://desk.example.org/queue")
    assert row.referer_domain == "desk.example.org"
    assert (row.tls_version, row.tls_cipher, row.tls_alpn) == ("TLS 1.2", "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305", "h3")
    assert (row.tls_resumed, row.tls_ech, row.http_proto, row.protocol) == (False, True, "HTTP/3.0", "HTTP/3.0")
    assert (row.logger_id, row.logger_name, row.log_source) == ("edge-a", "http.log.access.edge-a", "s")


@pytest.mark.parametrize(
    ("line", "outcome"),
    [
        ("", "skip"), ("   ", "skip"), ("not json", "error"), ('{"a": 1', "error"), ("[1]", "error"), ("5", "error"),
        (_line() + " trailing", "error"), (_line() + _line(), "error"), (_line() + " {}", "error"),
        (_line() + ",", "error"), (_line() + ",}", "error"), (_line() + "," + _line(), "error"), (_line() + " junk }", "error"),
        (_line() + "],[" + _line(), "error"), (_line() + "}, {\"x\": {}", "error"), (_line() + "  ", "row"), (_line(msg="starting"), "skip"), (_line(msg=None), "skip"),
        (_line(ts=None), "skip"), (_line(ts="abc"), "error"), (_line(ts="1700000000.5"), "row"),
        (_line(ts=None, time=1700000000), "row"), (_line(status="abc"), "error"), (_line(status="404"), "row"),
        (_line(size="many"), "error"), (_line(duration="slow"), "error"), (_line(request="odd"), "row"),
        (_line(request__tls=None), "row"),
    ],
)
def test_outcomes(spark, line, outcome):
    assert _parse(spark, line)[0].outcome == outcome


def test_fallback_fields(spark):
    rows = _parse(
        spark,
        _line(request__client_ip=""), _line(request__client_ip="[2001:db8::1%eth0]:99"),
        _line(request__host=" "), _line(request__host=None, request__tls=None),
        _line(size=0, response={"size": 7}), _line(size=0), _line(status=0, response={"status": 302}),
        _line(request__headers={"User-Agent": "plain", "Referrer": ["//h/x"], "Referer": []}),
        _line(request__tls__version="TLS 1.1", request__tls__cipher_suite=1, request__tls__ech=None),
        _line(request__proto=""),
    )
    assert [r.remote_ip for r in rows[:2]] == ["198.51.100.7", "2001:db8::1"]
    assert [r.host for r in rows[2:4]] == ["sni.example.org", "unknown"]
    assert [r.response_bytes for r in rows[4:6]] == [7, None]
    assert (rows[6].status, rows[6].status_class) == (302, "3xx")
    assert (rows[7].user_agent, rows[7].referer_domain) == ("plain", "h")
    assert (rows[8].tls_version, rows[8].tls_cipher, rows[8].tls_ech) == ("TLS 1.1", "UNKNOWN(1)", None)
    assert rows[9].http_proto is None


def test_the_kind_of_a_zero_decides(spark):
    """A number zero, false and what is empty count as missing; the same written as a text does not."""
    missing = [0, 0.0, -0.0, False, "", [], {}, 0.00]
    rows = _parse(spark, *(_line(size=v, bytes_written=5) for v in missing))
    assert [r.response_bytes for r in rows] == [5] * len(missing)
    rows = _parse(spark, *(_line(size=v, bytes_written=5) for v in ("0", "0.0", "00")))
    assert [r.response_bytes for r in rows] == [0, 0, 0]
    assert [r.outcome for r in _parse(spark, _line(size="false", bytes_written=5), _line(size=True))] == ["error", "error"]
    assert _parse(spark, _line(ts=0, time=1700000000))[0].ts == datetime(2023, 11, 14, 22, 13, 20)
    assert _parse(spark, _line(ts="0", time=1700000000))[0].ts == datetime(1970, 1, 1)
    assert _parse(spark, _line(status="0", response={"status": 302}))[0].status == 0


def test_host_from_logger_and_label(spark):
    nameless = _line(request__host=None, request__tls=None)
    other_logger = _line(request__host=None, request__tls=None, logger="plain")
    by_header = _line(request__host=None, request__tls=None, request__headers={"Host": ["H.example.com:8"]})
    hosts = spark.createDataFrame([("edge-a", ["mapped.example.com", "second"])], "logger_id string, hosts array<string>")
    labels = spark.createDataFrame([("s", "label.example.com")], "log_source string, label string")
    rows = _parse(spark, nameless, other_logger, by_header, logger_hosts=hosts, source_labels=labels)
    assert sorted(r.host for r in rows) == ["h.example.com", "label.example.com", "mapped.example.com"]
    assert _parse(spark, nameless)[0].host == "unknown"


def test_stored_form_is_whole(spark):
    long = _line(request__uri="/" + "a" * 5000, request__method="m" * 20)
    rows = spark.createDataFrame([(long, "s"), ("x" * 5000, "s")], "value string, log_source string")
    parsed = parse.parse_lines(rows)
    request = parse.as_requests(parsed).collect()[0]
    assert parse.as_requests(parsed).columns == REQUEST_COLUMNS
    assert (len(request.uri), len(request.path), len(request.method)) == (5001, 5001, 20)
    cut = parse.shortened(parse.as_requests(parsed)).collect()[0]
    assert (len(cut.uri), len(cut.path), len(cut.method)) == (4096, 2048, 10)
    assert request.id is not None and request.is_bot is False and request.threat_score == 0
    error = parse.as_parse_errors(parsed, F.lit(datetime(2024, 1, 1))).collect()[0]
    assert len(error.raw_line) == 5000 and error.error_msg == "line is not valid JSON"
