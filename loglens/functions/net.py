"""IP addresses as fixed-width keys whose text order is the address order.

A key is the family digit followed by the address in lower-case hexadecimal: '4' and 8
digits, or '6' and 32 digits. Text that is no address has no key (NULL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions.columns import generated

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
# Groups of up to four digits, "::" at most once and no other colon at either end.
_IPV6 = r"^(?!.*::.*::)(?!.*:::)(?!:[^:])(?!.*[^:]:$)(?=.*:.*:)[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,8}$"
_IPV4_TAIL = rf":({_OCTET}(?:\.{_OCTET}){{3}})$"


def _hex(number: Column, width: int) -> Column:
    return F.lower(F.lpad(F.hex(number.cast("bigint")), width, "0"))


def _octets(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\."), lambda octet: _hex(octet, 2)), "")


def _written_groups(text: Column) -> Column:
    return F.filter(F.split(text, ":"), lambda group: group != "")


def _ipv4_key(text: Column) -> Column:
    return F.when(text.rlike(_IPV4), F.concat(F.lit("4"), _octets(text)))


def _ipv6_key(text: Column) -> Column:
    """``text`` has hexadecimal groups only; "::" is filled up with zero groups."""
    missing = F.lit(8) - F.size(_written_groups(text))
    zeros = F.concat(F.lit(":"), F.repeat(F.lit("0:"), missing))
    groups = F.transform(
        _written_groups(F.replace(text, F.lit("::"), zeros)), lambda group: F.lpad(F.lower(group), 4, "0")
    )
    fits = F.when(text.contains("::"), missing > 0).otherwise(missing == 0)
    return F.when(text.rlike(_IPV6) & fits, F.concat(F.lit("6"), F.array_join(groups, "")))


def _hexadecimal_tail(text: Column) -> Column:
    """An IPv6 address with its last 32 bits in dotted form, in groups only."""
    tail = _octets(F.regexp_extract(text, _IPV4_TAIL, 1))
    groups = F.concat(F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))
    plain = F.regexp_replace(text, r"[^:]*\.[^:]*$", "")
    return F.when(text.rlike(_IPV4_TAIL), F.concat(plain, groups)).otherwise(text)


def with_ip_keys(df: DataFrame, **addresses: str) -> DataFrame:
    """``df`` with the key of each named address column."""
    grouped = {f"__{name}": _hexadecimal_tail(F.col(column)) for name, column in addresses.items()}
    keys = {
        name: F.coalesce(_ipv4_key(F.col(column)), _ipv6_key(F.col(f"__{name}")))
        for name, column in addresses.items()
    }
    return generated(generated(df, **grouped), **keys).drop(*grouped)


def with_cidr_bounds(df: DataFrame, cidr: str, low: str, high: str) -> DataFrame:
    """``df`` with the first and last key of a network, both NULL for text that is none.

    Host bits are ignored; an address without prefix length is a network of its own.
    """
    text = F.col(cidr)
    keyed = with_ip_keys(df.withColumn("__base", F.substring_index(text, "/", 1)), __key="__base")
    width = (F.length("__key") - 1) * 4
    given = F.regexp_extract(text, r"/(\d{1,3})$", 1).try_cast("int")
    bits = F.when(text.contains("/"), given).otherwise(width)
    sized = generated(keyed, __bits=F.when(bits <= width, bits))

    whole = F.floor(F.col("__bits") / 4).cast("int")
    rest = F.col("__bits") % 4
    digit = F.conv(F.substring("__key", whole + 2, F.lit(1)), 16, 10).cast("int")
    step = F.when(rest == 1, 8).when(rest == 2, 4).when(rest == 3, 2)
    first_digit = digit - digit % step

    def bound(last_digit: Column, fill: str) -> Column:
        kept = F.substring("__key", F.lit(1), whole + 1)
        head = F.when(rest == 0, kept).otherwise(F.concat(kept, F.lower(F.hex(last_digit.cast("bigint")))))
        return F.rpad(head, F.length("__key"), F.lit(fill))

    bounds = {low: bound(first_digit, "0"), high: bound(first_digit + step - 1, "f")}
    return generated(sized, **bounds).drop("__base", "__key", "__bits")
