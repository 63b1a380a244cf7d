"""Raw JSON access-log lines to requests, as one projection without Python functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions import fixed_values as fixed
from loglens.functions import measures as m
from loglens.functions import tls
from loglens.functions.columns import generated
from loglens.functions.text import (
    authority,
    clean_host,
    clean_ip,
    none_if_empty,
    status_class,
    strip,
    uri_path,
    uri_query,
)
from loglens.functions.times import from_unix_seconds
from loglens.schema import REQUESTS_SCHEMA

ROW, SKIP, ERROR = "row", "skip", "error"

# Where a field is found.
_TEXTS = {
    "msg": "msg", "logger": "logger", "duration": "duration",
    "client_ip": "request.client_ip", "remote_ip": "request.remote_ip", "remote_addr": "request.remote_addr",
    "host_field": "request.host", "method": "request.method", "uri": "request.uri", "url": "request.url",
    "protocol": "request.proto", "server_name": "request.tls.server_name", "alpn": "request.tls.proto",
}
# Texts of which the kind decides what they mean.
_NUMBERS = {
    "ts": "ts", "time": "time", "timestamp": "timestamp", "status": "status", "response_status": "response.status",
    "size": "size", "response_size": "response.size", "bytes_written": "bytes_written", "bytes_read": "bytes_read",
    "request_bytes_read": "request.bytes_read",
}
_VALUES = {"version": "request.tls.version", "cipher": "request.tls.cipher_suite"}
_FLAGS = {"resumed": "request.tls.resumed", "ech": "request.tls.ech"}
_HEADERS = {"host_header": "Host", "user_agent": "User-Agent", "referer": "Referer", "referrer": "Referrer"}


def _kinds() -> dict[str, str]:
    """The kind in which every path is read; a VARIANT where the value's own kind still matters."""
    headers = {f"request.headers.{header}": "variant" for header in _HEADERS.values()}
    texts, numbers = dict.fromkeys(_TEXTS.values(), "string"), dict.fromkeys(_NUMBERS.values(), "variant")
    return texts | numbers | dict.fromkeys(_VALUES.values(), "variant") | dict.fromkeys(_FLAGS.values(), "boolean") | headers


def _entry_type() -> str:
    """The type of the parts of an entry that are read."""
    tree: dict = {}
    for path, kind in _kinds().items():
        *above, leaf = path.split(".")
        inner = tree
        for name in above:
            inner = inner.setdefault(name, {})
        inner[leaf] = kind

    def written(node: dict | str) -> str:
        if isinstance(node, str):
            return node
        return f"struct<{', '.join(f'`{name}`: {written(inner)}' for name, inner in node.items())}>"

    return written(tree)


def _entry() -> Column:
    """The parts of a line's entry that are read, by one walk through it; the entry stands alone in the array ``__all``."""
    return F.expr(f"try_variant_get(__all, '$[0]', '{_entry_type()}')")


def _inside(path: str) -> str:
    return "__entry." + ".".join(f"`{name}`" for name in path.split("."))


def _as(path: str, kind: str) -> str:
    return f"try_variant_get({_inside(path)}, '$', '{kind}')"


def _written_fields() -> dict[str, Column]:
    """Every field of the entry as it is written. A header is a list of values or, by itself, a
    text."""
    found = {name: F.expr(_inside(path)) for name, path in (_TEXTS | _VALUES | _FLAGS).items()}
    found |= {name: F.expr(_as(path, "string")) for name, path in _NUMBERS.items()}
    for name, header in _HEADERS.items():
        path = f"request.headers.{header}"
        found[f"{name}_list"] = F.expr(_as(path, "array<string>"))
        found[f"{name}_text"] = F.expr(_as(path, "string"))
    return found


def _is_json() -> Column:
    """Whether a line is one JSON value; a field of an unexpected kind only leaves that field out.

    The parser stops behind the first value and takes no offence at what follows. Inside an array
    only a comma or the closing bracket may follow it; the rare line with such a bracket is parsed
    inside an object, too, where that bracket is an error.
    """
    line = F.col("line")
    one_value = F.expr("__all IS NOT NULL AND try_variant_get(__all, '$[1]', 'variant') IS NULL")
    closed = F.try_parse_json(F.concat(F.lit('{"value":'), line, F.lit("}"))).isNotNull()
    return one_value & F.when(line.rlike(r"\}\s*\]"), closed).otherwise(True)


def _first_truthy(*fields: str) -> Column:
    """The text of the first field that is neither missing, empty, false nor the number zero; else that of the last.

    Zero written as a text is a text like any other: the kind of the value decides.
    """
    def present(field: str) -> str:
        nothing = f"coalesce(try_cast({field} AS DOUBLE) = 0, {field} IN ('false', '[]', '{{}}'))"
        is_text = f"schema_of_variant({_inside(_NUMBERS[field])}) = 'STRING'"
        return f"CASE WHEN {field} <> '' AND (NOT {nothing} OR {is_text}) THEN {field} END"

    *leading, last = fields
    return F.expr(f"coalesce({', '.join([*map(present, leading), last])})")


def _first_text(*fields: str) -> Column:
    """The first field that is not empty, else the empty text."""
    present = [f"nullif({field}, '')" for field in fields]
    return F.expr(f"coalesce({', '.join(present)}, '')")


def _header(name: str) -> str:
    return f"CASE WHEN {name}_list IS NOT NULL THEN get({name}_list, 0) ELSE {name}_text END"


def _chosen_fields() -> dict[str, Column]:
    """One value for each thing an entry may say in several places."""
    return {
        **{
            name: F.col(name)
            for name in (
                "msg", "host_field", "server_name", "method", "protocol", "duration",
                "alpn", "version", "cipher", "resumed", "ech",
            )
        },
        "seconds": _first_truthy("ts", "time", "timestamp"),
        "logger": F.coalesce("logger", F.lit("")),
        "address": _first_text("client_ip", "remote_ip", "remote_addr"),
        "host_header": F.expr(_header("host_header")),
        "uri": _first_text("uri", "url"),
        "status": _first_truthy("status", "response_status"),
        "response_size": _first_truthy("size", "response_size", "bytes_written"),
        "request_size": _first_truthy("bytes_read", "request_bytes_read"),
        "user_agent": F.expr(_header("user_agent")),
        "referer": _first_text(_header("referer"), _header("referrer")),
    }


def _whole_number(text: str) -> Column:
    """Text of a number, cut to a whole one."""
    return F.coalesce(F.col(text).try_cast("bigint"), F.col(text).try_cast("double").try_cast("bigint"))


def _fields() -> dict[str, Column]:
    status = _whole_number("status")
    return {
        "ts": from_unix_seconds(F.col("seconds").try_cast("double")),
        "remote_ip": clean_ip(F.col("address")),
        "method": F.upper("method"),
        "uri": F.col("uri"),
        "path": uri_path(F.col("uri")),
        "query": uri_query(F.col("uri")),
        "protocol": F.col("protocol"),
        "status": status.cast("int"),
        "status_class": status_class(status),
        "response_bytes": _whole_number("response_size"),
        "request_bytes": _whole_number("request_size"),
        "duration_ms": (F.col("duration").try_cast("double") * 1000).try_cast("int"),
        "user_agent": F.col("user_agent"),
        "referer": F.col("referer"),
        "referer_domain": authority(F.col("referer")),
        "tls_version": tls.tls_version(F.col("version")),
        "tls_cipher": tls.tls_cipher(F.col("cipher")),
        "tls_alpn": F.col("alpn"),
        "tls_resumed": F.col("resumed"),
        "tls_ech": F.col("ech"),
        "http_proto": F.col("protocol"),
        "logger_id": F.substring_index("logger", ".", -1),
        "logger_name": F.col("logger"),
    }


def shortened(requests: DataFrame) -> DataFrame:
    """Requests with their texts cut to the lengths that tables for display use.

    Rules and reports read whole texts.
    """
    cut = {n: F.substring(n, 1, length) for n, length in fixed.FIELD_LENGTHS.items() if n in requests.columns}
    return requests.withColumns(cut)


def _outcome() -> tuple[Column, Column]:
    """What becomes of a line, and why when it is an error."""
    numbers = {
        "seconds": "timestamp",
        "status": "status",
        "response_size": "response size",
        "request_size": "request size",
        "duration": "duration",
    }
    broken = F.lit(None).cast("string")
    for field, label in reversed(numbers.items()):
        is_broken = F.col(field).isNotNull() & F.col(field).try_cast("double").isNull()
        broken = F.when(is_broken, F.lit(f"{label} is not a number")).otherwise(broken)
    blank = F.col("line") == ""
    other = (F.coalesce("msg", F.lit("")) != fixed.ACCESS_MESSAGE) | F.col("seconds").isNull()
    error = (
        F.when(blank, F.lit(None))
        .when(~F.col("is_json"), F.lit("line is not valid JSON"))
        .when(~F.col("line").startswith("{"), F.lit("line is not a JSON object"))
        .when(~other, broken)
    )
    return F.when(error.isNotNull(), ERROR).when(blank | other, SKIP).otherwise(ROW), error


def named_host() -> Column:
    """The host the request itself names: host field, TLS server name or Host header."""
    candidates = [F.col(c) for c in ("host_field", "server_name", "host_header")]
    return F.coalesce(*[F.when(strip(c) != "", clean_host(c)) for c in candidates])


def parse_lines(
    lines: DataFrame, logger_hosts: DataFrame | None = None, source_labels: DataFrame | None = None
) -> DataFrame:
    """Every line with its ``outcome`` ('row', 'skip' or 'error'), ``error_msg`` and fields.

    ``lines`` has ``value`` and ``log_source``; ``logger_hosts`` (logger_id, hosts) and
    ``source_labels`` (log_source, label) name the host of requests that do not.
    """
    # Each line is parsed once, into a VARIANT that the verdict and all fields are read from: generated columns are not
    # rewritten into the expressions that use them.
    line = strip(F.col("value"))
    stripped = lines.select("value", "log_source", line.alias("line"))
    read = generated(stripped, __all=F.try_parse_json(F.concat(F.lit("["), "line", F.lit("]"))))
    walked = generated(read, __entry=_entry())
    written = walked.select(
        "value", "log_source", "line", "__entry", _is_json().alias("is_json"), *m.named(_written_fields())
    )
    chosen = written.select("value", "log_source", "line", "is_json", *m.named(_chosen_fields()))
    outcome, error = _outcome()
    judged = generated(chosen, outcome=outcome, error_msg=error)
    texts = fixed.FIELD_LENGTHS
    fields = {name: none_if_empty(value) if name in texts else value for name, value in _fields().items()}
    rows = judged.select(
        "value", "log_source", "outcome", "error_msg",
        *m.named(fields),
        named_host().alias("__named"),
        F.substring_index("logger", ".", -1).alias("__logger"),
    )
    mapped, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    if logger_hosts is not None:
        names = logger_hosts.select(F.col("logger_id").alias("__logger"), F.get("hosts", F.lit(0)).alias("__mapped"))
        # A repeated key takes its least value and never multiplies lines.
        names = names.groupBy("__logger").agg(F.min("__mapped").alias("__mapped"))
        rows = rows.join(names, "__logger", "left")
        mapped = F.col("__mapped")
    if source_labels is not None:
        labels = source_labels.select("log_source", F.col("label").alias("__label"))
        labels = labels.groupBy("log_source").agg(F.min("__label").alias("__label"))
        rows = rows.join(labels, "log_source", "left")
        label = none_if_empty(F.col("__label"))
    host = F.coalesce("__named", mapped, label, F.lit("unknown"))
    return rows.withColumn("host", host).drop("__named", "__logger", "__mapped", "__label")


def as_requests(parsed: DataFrame) -> DataFrame:
    """The parsed rows in the stored form; enrichment columns are still empty.

    The id depends on the line only, so a replay gives the same ids.
    """
    defaults = {"is_bot": F.lit(False), "threat_score": F.lit(0)}
    rows = parsed.filter(F.col("outcome") == ROW).withColumn("id", F.xxhash64("log_source", "value", "ts"))
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None)))
            .cast(f.dataType)
            .alias(f.name)
            for f in REQUESTS_SCHEMA.fields
        ]
    )


def as_parse_errors(parsed: DataFrame, now: Column) -> DataFrame:
    """Lines that could not be read, whole, so that they can be parsed again."""
    return parsed.filter(F.col("outcome") == ERROR).select(
        F.xxhash64("log_source", "value").alias("id"),
        now.alias("ts"),
        F.col("value").alias("raw_line"),
        "error_msg",
        "log_source",
    )
