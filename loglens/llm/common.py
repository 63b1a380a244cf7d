"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frozen(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored in the cluster's shared folder and read again.

    Cuts the lineage, so that a lost executor costs the tasks it ran and no more, and fixes values
    that are made anew in each run of a plan, such as row numbers.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark's cleaner drop the shuffle files of finished steps now, not when the driver's heap is next collected."""
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes as well as by rows, so that long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def returning_memory(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``step`` for ``mapInArrow``, after which its Python worker gives freed memory back to the system.

    Workers wait for the next task beside the executor's JVM, where other steps need the room.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"{wish}_{uuid.uuid4().hex[:6]}"
    return wish


def refuse_name(df: DataFrame, name: str) -> None:
    """Raises where ``df`` has a column of that name already, whatever the case of its letters."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"{name} is a column already; choose another name")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Every row with all its columns and a number of its own, stored; and the number's column."""
    row = free_name(docs, "row_number")
    return frozen(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_TYPES = {"long": T.LongType, "double": T.DoubleType, "binary": T.BinaryType}


def with_columns(df: DataFrame, **types: str) -> T.StructType:
    """The schema of ``df`` with further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, _TYPES[t]()) for n, t in types.items())])


def folds(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def without_rows(docs: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows listed in ``dropped``, a stored table with the one column ``row``."""
    return docs.join(dropped, row, "left_anti").drop(row)
