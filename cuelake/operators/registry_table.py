"""A registry table as snapshot and log: merge on read, compaction, and columns added over time.

Under a root folder lie ``log/batch=<n>`` with the writes of one batch each and ``snapshot/upto=<n>`` with the state
after batch n. Reading merges the newest snapshot with the batches behind it; both are partition folders, so older
batches are not read. Nothing is ever rewritten in place: a job that dies leaves an unfinished folder of a number
that its repetition overwrites. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Added:
    """A column that came with a schema version: rows written before it read as ``default``."""

    version: int
    name: str
    type: str
    default: object = None


def with_defaults(rows: DataFrame, added: Sequence[Added], version: str = "schema_version") -> DataFrame:
    """Rows of any schema version with all columns.

    A row older than a column reads its default; a null that a newer row holds stays null. Rows without a version, and
    tables without that column, are older than all.
    """
    of = F.coalesce(F.col(version), F.lit(0)) if version in rows.columns else F.lit(0)
    made: dict[str, Column] = {}
    for a in added:
        default = F.lit(a.default).cast(a.type)
        made[a.name] = F.when(of < a.version, default).otherwise(F.col(a.name).cast(a.type)) if a.name in rows.columns else default
    return rows.withColumns(made) if made else rows


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the partition folders that are complete; none where the folder is missing."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root)]
    return sorted(int(p.getName().split("=")[1]) for p in found
                  if p.getName().startswith(f"{name}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def append(rows: DataFrame, root: str, version: int) -> int:
    """Write rows as the next batch of the log; its number."""
    n = max([0, *_numbers(rows.sparkSession, f"{root}/log", "batch")]) + 1
    rows.withColumn("schema_version", F.lit(version)).write.mode("overwrite").parquet(f"{root}/log/batch={n}")
    return n


def _merged(states: DataFrame, key: str) -> DataFrame:
    """States (key, row, last, first) of a key as one: the row of the last write, the time of the first."""
    return states.groupBy(key).agg(F.max_by("row", "last").alias("row"), F.max("last").alias("last"), F.min("first").alias("first"))


def _log(spark: SparkSession, root: str, batches: Sequence[int], key: str, ts: str, order: str, added: Sequence[Added], columns: Sequence[str]) -> DataFrame:
    """States of the writes of some batches, each read with its own columns."""
    parts = [spark.read.parquet(f"{root}/log/batch={n}") for n in batches]
    out = None
    for p in parts:
        p = with_defaults(p, added)
        row = F.struct(*[F.col(c) if c in p.columns else F.lit(None).cast("string").alias(c) for c in columns])
        states = p.select(key, row.alias("row"), F.struct(F.col(ts).alias("ts"), F.col(order).alias("ord")).alias("last"), F.col(ts).alias("first"))
        out = states if out is None else out.unionByName(states)
    return out


def _state(spark: SparkSession, root: str, key: str, ts: str, order: str, added: Sequence[Added], columns: Sequence[str]) -> tuple[DataFrame | None, int]:
    """Merged state, and the last batch in it."""
    batches, snapshots = _numbers(spark, f"{root}/log", "batch"), _numbers(spark, f"{root}/snapshot", "upto")
    upto = max([0, *snapshots])
    fresh = [n for n in batches if n > upto]
    parts = []
    if upto:
        s = with_defaults(spark.read.parquet(f"{root}/snapshot/upto={upto}").select("*", "row.*"), added)
        parts.append(s.select(key, F.struct(*columns).alias("row"), "last", "first"))
    if fresh:
        parts.append(_log(spark, root, fresh, key, ts, order, added, columns))
    if not parts:
        return None, 0
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _merged(both, key), max([upto, *batches])


def current(spark: SparkSession, root: str, columns: Sequence[str], key: str = "media_hash", ts: str = "ts", order: str = "ord",
            added: Sequence[Added] = ()) -> DataFrame:
    """Current rows: values of the last write of a key, ``created_at`` of the first, ``updated_at`` of the last (L1).

    The same before and after any compaction. Raises ValueError where nothing was ever written.
    """
    state, _ = _state(spark, root, key, ts, order, added, columns)
    if state is None:
        raise ValueError(f"no batch in {root}")
    return state.select(key, "row.*", F.col("first").alias("created_at"), F.col("last.ts").alias("updated_at"))


def compact(spark: SparkSession, root: str, columns: Sequence[str], version: int, key: str = "media_hash", ts: str = "ts", order: str = "ord",
            added: Sequence[Added] = ()) -> int:
    """Write the state after all batches as a snapshot; the number of its last batch. Nothing new, nothing written."""
    state, upto = _state(spark, root, key, ts, order, added, columns)
    if state is not None and upto not in _numbers(spark, f"{root}/snapshot", "upto"):
        state.withColumn("schema_version", F.lit(version)).write.mode("overwrite").parquet(f"{root}/snapshot/upto={upto}")
    return upto


def stale(spark: SparkSession, root: str) -> list[str]:
    """Folders that no reader needs any more: batches in the newest snapshot, and older snapshots."""
    snapshots = _numbers(spark, f"{root}/snapshot", "upto")
    upto = max([0, *snapshots])
    return ([f"{root}/log/batch={n}" for n in _numbers(spark, f"{root}/log", "batch") if n <= upto]
            + [f"{root}/snapshot/upto={n}" for n in snapshots if n < upto])
