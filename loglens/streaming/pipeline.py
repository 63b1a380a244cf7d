"""From raw log lines to stored requests and parse errors, as one streaming query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loglens.operators import enrich, parse, security
from loglens.sources.sinks import write_batch


@dataclass(frozen=True)
class Dimensions:
    """The small tables that parsing and enrichment look things up in."""

    logger_hosts: DataFrame | None = None
    source_labels: DataFrame | None = None
    geo: DataFrame | None = None


def enriched(parsed: DataFrame, geo: DataFrame | None = None) -> DataFrame:
    """Parsed rows in the stored form with user-agent classes, score and place."""
    rows = enrich.score_threats(enrich.classify_agents(parse.as_requests(parsed)))
    if geo is None:
        return rows
    located = enrich.enrich_geo(rows, geo)
    return located.select(*rows.columns)


def stream_pipeline(
    lines: DataFrame,
    requests_path: str,
    errors_path: str,
    checkpoint: str,
    dimensions: Dimensions = Dimensions(),
    *,
    events_path: str | None = None,
    rules: security.RuleSettings = security.DEFAULTS,
) -> DataStreamWriter:
    """The query that stores what ``lines`` (value, log_source) say; start it with a trigger.

    With ``events_path`` the events of the rules about one request are stored as well; those about an
    address's past need state and run as ``streaming.security.stream_past`` over the stored requests.
    A repeated micro-batch replaces its own files, so every line is stored once.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        parsed = parse.parse_lines(batch, dimensions.logger_hosts, dimensions.source_labels).persist()
        try:
            rows = enriched(parsed, dimensions.geo)
            write_batch(rows, requests_path, batch_id)
            if events_path:
                write_batch(security.single_request_events(rows, rules), events_path, batch_id)
            write_batch(parse.as_parse_errors(parsed, F.current_timestamp()), errors_path, batch_id)
        finally:
            parsed.unpersist()

    return lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
