"""Work that must not meet in one task or be done twice."""

from __future__ import annotations

import random
from datetime import datetime, timedelta


from loglens.operators import alerts
from loglens.plans import catalog

START = datetime(2024, 1, 1)
_RULES = "id int, name string, enabled boolean, rule_type string, conditions string, cooldown_minutes int, last_triggered timestamp"
_METRICS = "tick timestamp, scope string, metric string, value double, shown double"


def _rule(number, cooldown, last=None, metric="request_rate"):
    return number, "r", True, "threshold", f'{{"metric":"{metric}","threshold":1}}', cooldown, last


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def _one_after_the_other(minutes, cooldown, last):
    fired = []
    for tick in sorted(minutes):
        if last is None or tick - last >= cooldown:
            fired.append(tick)
            last = tick
    return fired


def test_cooldowns_over_many_blocks(spark, monkeypatch):
    """Rules of several cooldowns fire as one after the other would, whichever block of time a breach is in."""
    monkeypatch.setattr(alerts, "_BLOCK_MICROS", 25 * 60_000_000)
    rng = random.Random(5)
    minutes = sorted(rng.sample(range(3000), 1200)) + list(range(3000, 3400)) + [9000, 9000, 9001]
    rows = [(START + timedelta(minutes=i), "*", "request_rate", 2.0, float(i)) for i in minutes]
    settings = {1: (0, None), 2: (1, None), 3: (7, 40), 4: (30, -10), 5: (60, 3100), 6: (2000, None), None: (11, None), 7: (-3, None)}
    since = {i: None if last is None else START + timedelta(minutes=last) for i, (_, last) in settings.items()}
    rules = spark.createDataFrame([_rule(i, pause, since[i]) for i, (pause, _) in settings.items()], _RULES)
    fired = alerts.alert_evaluate(spark.createDataFrame(rows, _METRICS), rules).collect()
    for number, (pause, last) in settings.items():
        got = sorted(int((r.triggered_at - START).total_seconds() // 60) for r in fired if r.rule_id == number)
        assert got == _one_after_the_other(minutes, pause, last), number


def test_a_rule_that_stands_twice_has_the_settings_of_its_earliest_breach(spark):
    rows = [(START + timedelta(minutes=i), "*", "error_rate" if i % 3 else "request_rate", 2.0, 2.0) for i in range(1, 200)]
    rules = spark.createDataFrame([_rule(1, 5), _rule(1, 20, metric="error_rate")], _RULES)
    fired = alerts.alert_evaluate(spark.createDataFrame(rows, _METRICS), rules).collect()
    got = sorted(int((r.triggered_at - START).total_seconds() // 60) for r in fired)
    assert got == _one_after_the_other(range(1, 200), 20, None)


def test_no_scope_and_no_rule_is_one_task(spark):
    """Lines are not dealt by scope, of which there are few, nor breaches by rule alone."""
    rows = spark.createDataFrame(
        [(START, "a", 3, 200, 5)], "ts timestamp, host string, duration_ms int, status int, response_bytes long"
    )
    rules = spark.createDataFrame([_rule(1, 5)], _RULES)
    metrics = alerts.all_metrics(rows, rules=rules)
    fired = alerts.alert_evaluate(metrics, rules)
    assert "hashpartitioning(scope" not in _plan(metrics)
    cogrouped = next(line for line in _plan(fired).splitlines() if "FlatMapCoGroupsInPandas" in line)
    assert "rule_id" in cogrouped and "block" in cogrouped


def test_lines_are_dealt_to_all_cores(spark, sf_dir):
    """A table of one split still gives lines for many tasks to parse, and each line is walked through once."""
    parsed = catalog.queries()["parse_lines"](spark, sf_dir)
    plan = _plan(parsed)
    optimised = plan[plan.index("== Optimized"):plan.index("== Physical")]
    assert "RepartitionByExpression [event_id" in optimised
    assert optimised.count("variant_get(__all") <= 2


def test_a_purge_works_out_its_tables_once(spark, sf_dir):
    """What is counted after a purge comes from the stored tables, not from parsing or finding events again."""
    plan = _plan(catalog.queries()["retention_purge"](spark, sf_dir))
    assert "user_id" not in plan and "parse_json" not in plan
