"""User-agent classes, decided by ordered rules: the first rule that matches names the class."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglens.functions.fixed_values import BOT_WORDS
from loglens.functions.text import names_any


@dataclass(frozen=True)
class AgentRule:
    """``pattern`` is searched in the user agent; its first group, if any, is the major version."""

    label: str
    pattern: str


BROWSER_RULES = (
    AgentRule("Googlebot", r"Googlebot(?:/(\d+))?"),
    AgentRule("bingbot", r"bingbot(?:/(\d+))?"),
    AgentRule("AhrefsBot", r"AhrefsBot(?:/(\d+))?"),
    AgentRule("SemrushBot", r"SemrushBot(?:/(\d+))?"),
    AgentRule("YandexBot", r"YandexBot(?:/(\d+))?"),
    AgentRule("curl", r"^curl/(\d+)"),
    AgentRule("Wget", r"^Wget/(\d+)"),
    AgentRule("Python Requests", r"python-requests/(\d+)"),
    AgentRule("Go-http-client", r"Go-http-client/(\d+)"),
    AgentRule("Edge", r"Edg(?:e|A|iOS)?/(\d+)"),
    AgentRule("Opera", r"OPR/(\d+)"),
    AgentRule("Samsung Internet", r"SamsungBrowser/(\d+)"),
    AgentRule("Firefox", r"(?:Firefox|FxiOS)/(\d+)"),
    AgentRule("Chrome", r"(?:Chrome|CriOS)/(\d+)"),
    AgentRule("Mobile Safari", r"Version/(\d+).* Mobile/.*Safari/"),
    AgentRule("Safari", r"Version/(\d+).* Safari/"),
    AgentRule("IE", r"(?:MSIE |Trident/.*rv:)(\d+)"),
)
SYSTEM_RULES = (
    AgentRule("Windows", r"Windows NT (\d+)"),
    AgentRule("iOS", r"(?:iPhone|iPad|iPod).* OS (\d+)"),
    AgentRule("Android", r"Android(?: (\d+))?"),
    AgentRule("Mac OS X", r"Mac OS X (\d+)"),
    AgentRule("Chrome OS", r"CrOS "),
    AgentRule("Linux", r"Linux"),
)
DEVICE_RULES = (
    AgentRule("bot", r"(?i)bot|spider|crawl"),
    AgentRule("tablet", r"iPad|Tablet|Android(?!.* Mobile)"),
    AgentRule("mobile", r"iPhone|iPod|Mobile|Phone"),
)
UNKNOWN = "Other"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _first_label(agent: str, rules: tuple[AgentRule, ...], other: str) -> str:
    """SQL text of the rules as one CASE; a version found is written behind the label."""

    def label(rule: AgentRule) -> str:
        if "(\\d+)" not in rule.pattern:
            return _text(rule.label)
        version = f"nullif(regexp_extract({agent}, {_text(rule.pattern)}, 1), '')"
        return f"concat_ws(' ', {_text(rule.label)}, {version})"

    cases = " ".join(f"WHEN {agent} RLIKE {_text(rule.pattern)} THEN {label(rule)}" for rule in rules)
    return f"CASE {cases} ELSE {_text(other)} END"


def is_bot(agent: str = "user_agent") -> Column:
    """Whether the user agent is missing or names a known bot, scanner or tool."""
    return F.expr(f"coalesce({agent}, '') = '' OR coalesce({names_any(f'lower({agent})', BOT_WORDS)}, false)")


def browser(agent: str = "user_agent") -> Column:
    return F.expr(f"CASE WHEN {agent} <> '' THEN {_first_label(agent, BROWSER_RULES, UNKNOWN)} END")


def system(agent: str = "user_agent") -> Column:
    return F.expr(f"CASE WHEN {agent} <> '' THEN {_first_label(agent, SYSTEM_RULES, UNKNOWN)} END")


def device(agent: str = "user_agent", bot: str = "is_bot") -> Column:
    return F.expr(f"CASE WHEN {bot} THEN 'bot' ELSE {_first_label(agent, DEVICE_RULES, 'desktop')} END")
