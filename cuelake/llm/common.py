"""Small helpers shared by the operators: shared folder, written tables, per-worker state."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Arrow batches carry whole texts: bounded by rows and by bytes.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches of this session, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a new folder only in local mode, where it may be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and go on from the files: each row is made once,
    and a lost executor costs a re-read, not a re-run."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_state(key, make: Callable):
    """One value per Python worker process, kept between its tasks until another operator asks for its own."""
    m = sys.modules.get("_llm_worker_state")
    if m is None:
        m = sys.modules["_llm_worker_state"] = types.ModuleType("_llm_worker_state")
        m.values = {}
    if key not in m.values:
        m.values.clear()
        m.values[key] = make()
    return m.values[key]


def give_back() -> None:
    """Hand memory that is free inside this worker back to the system: workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A batch function that gives its memory back when its task ends."""

    def leaned(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return leaned


def nonnull_text(col: Column | str = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def tables(spark: SparkSession, d: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{d}/{name}.parquet")
