"""Column expressions that clean hosts, addresses, URIs and referrers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\n\r\x0b\x0c"
_ONE_COLON = "^[^:]*:[^:]*$"
# scheme, authority, then the path up to "?" or "#", then the query up to "#"
_URI = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)(?:\?([^#]*))?"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _without_port(text: Column) -> Column:
    return F.when(text.rlike(_ONE_COLON), F.substring_index(text, ":", 1)).otherwise(text)


def clean_host(host: Column) -> Column:
    """Host name without port, brackets or trailing dots, in lower case."""
    bare = F.rtrim(strip(host), F.lit("."))
    bracketed = F.when(
        bare.contains("]"), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)
    ).otherwise(bare)
    return F.lower(F.when(bare.startswith("["), bracketed).otherwise(_without_port(bare)))


def clean_ip(address: Column) -> Column:
    """Address without brackets, zone id or the port of an IPv4 pair."""
    bare = F.regexp_replace(strip(address), r"^\[", "")
    bare = F.substring_index(F.substring_index(bare, "]", 1), "%", 1)
    return _without_port(bare)


def uri_path(uri: Column) -> Column:
    """Path of a URI: no authority, query, fragment or parameters of the last segment."""
    return F.regexp_replace(F.regexp_extract(uri, _URI, 1), ";[^/]*$", "")


def uri_query(uri: Column) -> Column:
    return F.regexp_extract(uri, _URI, 2)


def authority(uri: Column) -> Column:
    """Network location of a URL, with user info and port; empty when there is none."""
    return F.regexp_extract(uri, _AUTHORITY, 1)


def status_class(status: Column) -> Column:
    """'2xx' to '5xx'; no class below 200 or from 600 on."""
    return F.when(
        status.between(200, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))
    )


def names_any(text: str, words: tuple[str, ...]) -> str:
    """SQL text of whether a lower-case text contains any of the words.

    Plain searches, several times faster than one pattern with as many alternatives.
    """
    return "(" + " OR ".join(f"contains({text}, '{word}')" for word in words) + ")"
