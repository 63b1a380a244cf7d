"""Threat rules that look at one request alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglens.functions import fixed_values as fixed
from loglens.functions.text import names_any

# "U" makes \w and \s cover all scripts, "d" makes only \n a line end.
_ATTACK_FLAGS = "(?iUd)"


def _lower(column: Column) -> Column:
    return F.lower(F.coalesce(column, F.lit("")))


def lower_uri() -> Column:
    return _lower(F.col("uri"))


def lower_agent() -> Column:
    return _lower(F.col("user_agent"))


def is_sql_injection() -> Column:
    return lower_uri().rlike(_ATTACK_FLAGS + fixed.SQL_INJECTION_PATTERN)


def is_xss() -> Column:
    return lower_uri().rlike(_ATTACK_FLAGS + fixed.XSS_PATTERN)


def is_traversal() -> Column:
    return lower_uri().rlike(_ATTACK_FLAGS + fixed.TRAVERSAL_PATTERN)


_AGENT = "lower(coalesce(user_agent, ''))"


def is_scanner() -> Column:
    return F.expr(names_any(_AGENT, fixed.SCANNER_WORDS))


def is_bad_bot() -> Column:
    return F.expr(names_any(_AGENT, fixed.BAD_BOT_WORDS)) & ~is_scanner()


def has_no_agent() -> Column:
    return lower_agent() == ""


def is_login_attempt() -> Column:
    path = _lower(F.col("path"))
    to_login = reduce(lambda a, b: a | b, [path.contains(p) for p in fixed.LOGIN_PATHS])
    return (upper_method() == "POST") & to_login


def upper_method() -> Column:
    return F.upper(F.coalesce(F.col("method"), F.lit("")))


def is_abused_method() -> Column:
    return upper_method().isin(*fixed.ABUSED_METHODS)
