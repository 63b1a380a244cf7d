"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_SETTINGS = {
    # Timestamps are UTC by convention throughout.
    "spark.sql.session.timeZone": "UTC",
    # Skewed joins and oversized shuffles are re-planned at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Generated methods beyond this size are not compiled by the JVM and run slowly; wide
    # projections then use smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A JSON object may repeat a key; the last one wins, as in common parsers.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # State of streaming queries lives outside the JVM heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode alone a temporary one will do where none is named."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loglens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again, for steps that are used more than once.

    Where a ``folder`` is named, what it held of the step before is replaced.
    """
    path = f"{folder.rstrip('/')}/{name}" if folder else scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
