"""Storing tables as Parquet partitioned by day, and removing old days."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.filters import instant
from loglens.functions import measures as m
from loglens.timerange import naive_utc


def _by_day(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date("ts"))


def sink_requests(requests: DataFrame, path: str, *, cluster: bool = True) -> None:
    """Append requests. Clustering keeps a day's hosts and addresses together, so that a
    report on one of them skips most of the files; the time in the key splits busy ones."""
    rows = _by_day(requests)
    if cluster:
        layout = ["date", "host", "remote_ip", "ts"]
        rows = rows.repartitionByRange(*layout).sortWithinPartitions(*layout)
    rows.write.mode("append").partitionBy("date").parquet(path)


def sink_parse_errors(parse_errors: DataFrame, path: str) -> None:
    _by_day(parse_errors).write.mode("append").partitionBy("date").parquet(path)


def sink_security_events(events: DataFrame, path: str) -> None:
    _by_day(events).write.mode("append").partitionBy("date").parquet(path)


def replace_days(table: DataFrame, path: str) -> None:
    """Store a rollup, replacing the days it covers and no others; a day must be whole."""
    (
        _by_day(table)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path's constructor."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def write_batch(table: DataFrame, path: str, batch_id: int) -> None:
    """Store one micro-batch of a stream; writing it again replaces it, also where its rows
    now fall on other days (rows stamped with the time of writing do). A batch that a compaction has taken in stays as it is."""
    files, at = _files(table.sparkSession, path)
    if batch_id <= compacted_upto(table.sparkSession, path):
        return
    for found in files.globStatus(at(f"{path}/date=*/batch_id={batch_id}")) or []:
        files.delete(found.getPath(), True)
    (
        # A small batch is one file for each day; a large one as many as its size asks for.
        _by_day(table)
        .hint("rebalance", "date")
        .withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "batch_id")
        .parquet(path)
    )


_COMPACTED = "_compacted"
COMPACT_BYTES = 256 << 20


def compacted_upto(spark: SparkSession, path: str) -> int:
    """The last micro-batch that a compaction has taken in; -1 before the first one."""
    files, at = _files(spark, path)
    found = files.globStatus(at(f"{path}/{_COMPACTED}/upto=*")) or []
    return max((int(f.getPath().getName().split("=")[1]) for f in found), default=-1)


def compact(spark: SparkSession, path: str, upto: int, *, file_bytes: int = COMPACT_BYTES) -> None:
    """Put each day's micro-batches up to ``upto`` together into files of about ``file_bytes``.

    All of these batches must be committed: a mark is set first, and ``write_batch`` leaves batches at or below it alone, so
    a replay stores nothing twice. A day's batches become one folder, ``batch_id`` -1 - ``upto``, written aside and
    renamed into place; then the folders it stands for go. In between a reader sees rows twice; a compaction that was broken off
    is finished by the next one, which removes what a later folder already holds. Days are compacted one after the other.
    """
    files, at = _files(spark, path)
    if not files.exists(at(path)):
        return
    upto = max(upto, compacted_upto(spark, path))
    files.mkdirs(at(f"{path}/{_COMPACTED}/upto={upto}"))
    for day in sorted(d.getPath().getName() for d in files.globStatus(at(f"{path}/date=*")) or []):
        folders = {
            int(f.getPath().getName().split("=")[1]): f.getPath() for f in files.globStatus(at(f"{path}/{day}/batch_id=*")) or []
        }
        newest = max((-1 - n for n in folders if n < 0), default=-1)
        for n in [n for n in folders if (-1 - n if n < 0 else n) < newest or 0 <= n <= newest]:
            files.delete(folders.pop(n), True)
        taken = [n for n in folders if n <= upto]
        if len(taken) < 2:
            continue
        size = sum(files.getContentSummary(folders[n]).getLength() for n in taken)
        aside, name = f"{path}/{_COMPACTED}/{day}", f"batch_id={-1 - upto}"
        rows = spark.read.parquet(*(folders[n].toString() for n in taken))
        rows.repartitionByRange(max(1, -(-size // file_bytes)), "ts").write.mode("overwrite").parquet(aside)
        if not files.rename(at(aside), at(f"{path}/{day}/{name}")):
            raise OSError(f"could not put {day} in place")
        for n in taken:
            files.delete(folders[n], True)


def retention_cutoff(now: datetime, days: int) -> datetime:
    if days < 1:
        raise ValueError("a retention is at least one day")
    return naive_utc(now) - timedelta(days=days)


def _is_kept(table: DataFrame, cutoff: datetime) -> Column:
    return F.col("ts") >= instant(table, cutoff)


def retained(table: DataFrame, now: datetime, days: int) -> DataFrame:
    """The rows that are still within the retention."""
    return table.filter(_is_kept(table, retention_cutoff(now, days)))


def retention_report(table: DataFrame, name: str, now: datetime, days: int) -> DataFrame:
    """How many rows a purge removes and keeps."""
    kept = _is_kept(table, retention_cutoff(now, days))
    return table.agg(
        F.lit(name).alias("table_name"), m.count_if(~kept).alias("purged"), m.count_if(kept).alias("kept")
    )


def retention_purge(spark: SparkSession, path: str, now: datetime, days: int) -> None:
    """Remove rows older than the retention from a table stored by day.

    Whole days are deleted as folders; only the day the cutoff falls into is rewritten, in the
    table's own layout (by day, or by day and micro-batch). A cutoff at midnight rewrites nothing.
    """
    cutoff = retention_cutoff(now, days)
    files, at = _files(spark, path)
    boundary = f"date={cutoff.date().isoformat()}"
    table = spark.read.parquet(path)
    layout = [c for c in ("date", "batch_id") if c in table.columns]
    day = table.filter(F.col("date") == F.lit(cutoff.date()))
    if cutoff.time() != datetime.min.time():
        # Parts of the day that keep no row are not rewritten, so they go as folders.
        parts = day.groupBy(*layout).agg(F.max(_is_kept(table, cutoff)).alias("stays"))
        emptied = parts.filter(~F.col("stays")).select(*layout).collect()
        day.filter(_is_kept(table, cutoff)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(*layout).parquet(path)
        for part in emptied:
            files.delete(at(path + "".join(f"/{name}={part[name]}" for name in layout)), True)
    for status in files.listStatus(at(path)):
        name = status.getPath().getName()
        if name.startswith("date=") and name < boundary:
            files.delete(status.getPath(), True)
