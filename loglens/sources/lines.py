"""Reading raw log lines from files, at once or as a stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.filters import instant
from loglens.functions.fixed_values import LINE_TIME
from loglens.functions.text import strip
from loglens.functions.times import from_unix_seconds
from loglens.sources import growing


def _lines(text: DataFrame) -> DataFrame:
    """Lines with text and the file they come from; broken UTF-8 is replaced."""
    lines = text.select(
        strip(F.make_valid_utf8("value")).alias("value"), F.col("_metadata.file_path").alias("log_source")
    )
    return lines.filter(F.col("value") != "")


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _lines(spark.read.text(paths))


def tail_log_stream(
    spark: SparkSession, directory: str, *, pattern: str = "*", range_bytes: int = growing.RANGE
) -> DataFrame:
    """Whole lines of all files in ``directory``, as they are written: each line once.

    Files may grow, be renamed, be copied and cut, or begin anew; a file is known by its content (see ``sources.growing``).
    A line is read once its end is written. ``pattern`` must match rotated names too, or what was added between the last
    look and the rotation is lost; packed files (.gz and the like) are left out. Two files with the same content count as
    one. The directory is a path, or a URI of a file system that pyarrow knows. A batch holds all that was
    added, in tasks of ``range_bytes``; offsets are kept in the query's checkpoint.
    """
    spark.dataSource.register(growing.GrowingLines)
    added = (
        spark.readStream.format(growing.NAME).option("pattern", pattern).option("rangeBytes", range_bytes).load(directory)
    )
    lines = added.select(strip(F.make_valid_utf8(F.col("value").cast("string"))).alias("value"), "log_source")
    return lines.filter(F.col("value") != "")


def segment_stream(
    spark: SparkSession, directory: str, *, max_files_per_trigger: int | None = None, latest_first: bool = False
) -> DataFrame:
    """Lines of finished files that appear in ``directory``, each file read once and whole, by any file system of Spark.

    A file must be complete when it appears: lines added to it later are not read. For files that are still written
    to use ``tail_log_stream``.
    """
    reader = spark.readStream.format("text").option("latestFirst", str(latest_first).lower())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _lines(reader.load(directory))


def line_time(line: Column) -> Column:
    """The time written in a line, found without parsing it; NULL when there is none."""
    return from_unix_seconds(F.regexp_extract(line, LINE_TIME, 1).try_cast("double"))


def newest_per_source(requests: DataFrame) -> DataFrame:
    """The newest stored time of every log source."""
    return requests.groupBy("log_source").agg(F.max("ts").cast("timestamp").alias("last_ts"))


def backfill(lines: DataFrame, cutoff: datetime, newest: DataFrame | None = None) -> DataFrame:
    """Lines not older than ``cutoff`` and newer than what their source has stored.

    Lines without a numeric time are dropped.
    """
    at = line_time(F.col("value"))
    timed = lines.withColumn("__at", at)
    kept = timed.filter(F.col("__at") >= instant(timed, cutoff, "__at"))
    if newest is not None:
        known = newest.groupBy("log_source").agg(F.max(F.col("last_ts").cast("timestamp")).alias("__last"))
        kept = kept.join(known, "log_source", "left").filter(
            F.col("__last").isNull() | (F.col("__at") > F.col("__last"))
        )
    return kept.select(*lines.columns)
