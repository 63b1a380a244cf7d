"""Column expressions on single values."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from loglens.functions import agents, net, text, tls


def _map(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_clean_host(spark):
    names = ["depot.example.org", "x", "a-b.c-d.example", "10.20.30.40", "xn--bcher-kva.example"]
    forms = {"{}": 0, "{}:80": 0, "{}:65535": 0, "{}.": 0, "  {} ": 0}
    cases = {form.format(case(n)): n for form in forms for n in names for case in (str.lower, str.upper)}
    for n in range(1, 12, 3):  # bracketed IPv6, with and without a port
        address = ipaddress.IPv6Address(0x20010DB8 << 96 | n * 0x1234567)
        cases |= {f"[{address}]": str(address), f"[{address}]:{4000 + n}": str(address), str(address).upper(): str(address)}
    cases |= {"": "", "....": "", "[unclosed": "[unclosed"}
    assert _map(spark, cases, text.clean_host) == list(cases.values())


def test_clean_ip(spark):
    cases = {"": ""}
    for n in range(3, 300, 97):
        four, six = ipaddress.IPv4Address(0xC6336400 + n), ipaddress.IPv6Address(0x20010DB8 << 96 | n << 40 | n)
        cases |= {f"{four}": f"{four}", f"{four}:{n}": f"{four}", f"\t{four} ": f"{four}"}
        cases |= {f"[{six}]:{n}": f"{six}", f"{six}%wlan{n}": f"{six}", f"[{six}%7]": f"{six}"}
    assert _map(spark, cases, text.clean_ip) == list(cases.values())


def test_split_uri(spark):
    paths = ["", "/", "/depot/17", "/a b", "/p;v=1", "/p;v=1/q;w", "/~x/%2F", "*"]
    tails = ["", "?", "?k=v", "?k=v&l=", "?a?b", "#part", "?k#part", "#part?no"]
    cases = [p + t for p in paths for t in tails]
    cases += ["//depot.example.org/x" + t for t in tails] + ["https://depot.example.org:9/x/y" + t for t in tails]
    want = [urlparse(c) for c in cases]
    found = list(zip(_map(spark, cases, text.uri_path), _map(spark, cases, text.uri_query)))
    for case, got, parsed in zip(cases, found, want):
        assert got[1] == parsed.query, case
        # Parameters belong to the path they follow, save those of the last segment.
        assert got[0] == parsed.path, case


def test_referer_domain(spark):
    cases = [
        f"{scheme}{user}{host}{port}{rest}"
        for scheme in ("https://", "http://", "//", "app-link://") for user in ("", "ann@", "ann:pw@")
        for host in ("desk.example.org", "10.9.8.7") for port in ("", ":81") for rest in ("", "/", "/q?x#y", "?x", "#y")
    ] + ["", "desk", "/only/a/path"]
    assert _map(spark, cases, text.authority) == [urlparse(c).netloc for c in cases]


def test_status_class(spark):
    cases = {str(n): f"{n // 100}xx" if 200 <= n < 600 else None for n in range(90, 700, 7)}
    assert _map(spark, cases, lambda c: text.status_class(c.cast("int"))) == list(cases.values())


def test_tls_names(spark):
    # Numbers of the protocol: 0x0300 + minor version, suites from its registry.
    versions = {str(0x0301 + n): f"TLS 1.{n}" for n in range(4)}
    versions |= {"31000": "UNKNOWN(31000)", "null": None, '"TLS 1.2"': "TLS 1.2", '"0x0303"': "0x0303"}
    assert _map(spark, versions, lambda c: tls.tls_version(F.parse_json(c))) == list(versions.values())
    suites = {str(0x1302): "TLS_AES_256_GCM_SHA384", str(0x1303): "TLS_CHACHA20_POLY1305_SHA256", "77": "UNKNOWN(77)", "null": None}
    assert _map(spark, suites, lambda c: tls.tls_cipher(F.parse_json(c))) == list(suites.values())


NETWORKS = [
    "203.0.0.0/26", "203.0.0.7/32", "bad/99", "2001:db8::/32", "::/0", "1.2.3.4", "::ffff:1.2.3.4/128",
    "2001:db8:0:0:1:2:3:4/61", "10.0.0.0/33", "01.2.3.4", "1:2:3:4:5:6:7::8", "1:2:3:4:5:6:7::", "::1", "1::",
    "1:::2", "1:2", "12345::1", "1:2:3:4:5:6:7:8", ":1::2", "::1.2.3.4", "0.0.0.0/0", "10.1.2.3/1x", "1::/129",
    ":", "::2:", "255.255.255.255/31", "256.0.0.1", "2001:DB8::A/127", "",
]


@pytest.mark.parametrize("host_bits", ["", "/9"])
def test_network_bounds(spark, host_bits):
    given = [n if "/" in n or not host_bits else n + host_bits for n in NETWORKS]
    rows = spark.createDataFrame([(n,) for n in given], "cidr string")
    for row in net.with_cidr_bounds(rows, "cidr", "low", "high").collect():
        try:
            network = ipaddress.ip_network(row.cidr, strict=False)
        except ValueError:
            assert (row.low, row.high) == (None, None), row.cidr
            continue
        width = 8 if network.version == 4 else 32
        bounds = (network.network_address, network.broadcast_address)
        assert (row.low, row.high) == tuple(f"{network.version}{int(b):0{width}x}" for b in bounds), row.cidr


def test_agent_classes(spark):
    cases = {
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.0.0 Safari/537.36":
            ("Chrome 131", "Windows 10", "desktop", False),
        "Mozilla/5.0 (iPad; CPU OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Mobile/15E148 Safari/604.1":
            ("Mobile Safari 17", "iOS 17", "tablet", False),
        "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 Chrome/130.0 Mobile Safari/537.36":
            ("Chrome 130", "Android 14", "mobile", False),
        "Googlebot/2.1 (+http://www.google.com/bot.html)": ("Googlebot 2", "Other", "bot", False),
        "Nikto/2.1.6": ("Other", "Other", "bot", True),
        "": (None, None, "bot", True),
    }
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, user_agent string")
    found = rows.withColumn("is_bot", agents.is_bot()).select(
        "i", agents.browser(), agents.system(), agents.device(), "is_bot"
    )
    assert [tuple(r)[1:] for r in found.orderBy("i").collect()] == list(cases.values())
