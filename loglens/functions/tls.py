"""TLS numbers to names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglens.functions.fixed_values import TLS_CIPHERS, TLS_VERSIONS


def _decode(value: Column, names: dict[int, str]) -> Column:
    """``value`` is a VARIANT: a whole number is looked up, any other scalar is kept as text."""
    number = F.try_variant_get(value, "$", "bigint")
    text = F.try_variant_get(value, "$", "string")
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    named = F.coalesce(
        F.try_element_at(table, number.cast("int")),
        F.concat(F.lit("UNKNOWN("), number.cast("string"), F.lit(")")),
    )
    return F.when(F.schema_of_variant(value) == "BIGINT", named).otherwise(text)


def tls_version(value: Column) -> Column:
    return _decode(value, TLS_VERSIONS)


def tls_cipher(value: Column) -> Column:
    return _decode(value, TLS_CIPHERS)
