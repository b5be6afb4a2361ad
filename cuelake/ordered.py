"""Ordered work inside a key without ever gathering the key in one task.

A track may hold a large share of all rows, so ``Window.partitionBy(track)`` is not
safe. Each function here cuts a track into chunks of its position, runs the window per
chunk, and carries what crosses a chunk border either as copied border rows (lag, lead,
context) or through a table with one row per chunk (running values, numbering). That
table is ``CHUNK`` times smaller than the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536


def chunk_of(pos: Column, chunk: int = CHUNK) -> Column:
    return F.floor(pos / F.lit(chunk)).cast("bigint")


def with_halo(df: DataFrame, keys: Sequence[str], pos: str, before: int = 1, after: int = 0,
              chunk: int = CHUNK) -> DataFrame:
    """Add ``_chunk`` and ``_halo``; border rows are copied into the neighbour chunk.

    ``pos`` must count 0, 1, 2, ... within ``keys`` (see :func:`dense_index`).
    """
    if before >= chunk or after >= chunk:
        raise ValueError("halo must be smaller than a chunk")
    p, c = F.col(pos), chunk_of(F.col(pos), chunk)
    own = F.struct(c.alias("_chunk"), F.lit(False).alias("_halo"))
    copies = [own]
    if before:
        copies.append(F.when(p % chunk >= chunk - before,
                             F.struct((c + 1).alias("_chunk"), F.lit(True).alias("_halo"))))
    if after:
        copies.append(F.when((p % chunk < after) & (c > 0),
                             F.struct((c - 1).alias("_chunk"), F.lit(True).alias("_halo"))))
    return df.select("*", F.inline(F.array_compact(F.array(*copies))))


def chunk_window(keys: Sequence[str], pos: str):
    return Window.partitionBy(*keys, "_chunk").orderBy(pos)


def neighbours(df: DataFrame, keys: Sequence[str], pos: str, exprs: dict, before: int = 1,
               after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Add columns ``exprs[name](window)`` computed over rows next to each row."""
    w = chunk_window(keys, pos)
    out = with_halo(df, keys, pos, before, after, chunk)
    for name, fn in exprs.items():
        out = out.withColumn(name, fn(w))
    return out.filter(~F.col("_halo")).drop("_chunk", "_halo")


def dense_index(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (),
                name: str = "idx", width: int = CHUNK, start: int = 0) -> DataFrame:
    """Number rows ``start, start+1, ...`` per key by ``(order, *ties)``.

    ``order`` is an integer column. Rows are counted per slice of ``width`` order values,
    the counts are summed along the key, and each row gets its place within its slice.
    """
    keys = list(keys)
    rows = df.withColumn("_chunk", chunk_of(F.col(order), width))
    along = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = (rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_off", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(order, *ties)
    return (rows.withColumn("_rn", F.row_number().over(w))
            .join(offs, [*keys, "_chunk"])
            .withColumn(name, (F.col("_off") + F.col("_rn") - 1 + start).cast("bigint"))
            .drop("_chunk", "_rn", "_off"))


def carry_before(df: DataFrame, keys: Sequence[str], pos: str, value: Column, name: str,
                 how: str = "last", chunk: int = CHUNK) -> DataFrame:
    """Value of the rows strictly before each row: their ``last`` non-null or their ``max``."""
    keys = list(keys)
    rows = df.withColumn("_chunk", chunk_of(F.col(pos), chunk)).withColumn("_v", value)
    inside = (Window.partitionBy(*keys, "_chunk").orderBy(pos)
              .rowsBetween(Window.unboundedPreceding, -1))
    along = (Window.partitionBy(*keys).orderBy("_chunk")
             .rowsBetween(Window.unboundedPreceding, -1))
    if how == "last":
        per_chunk = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(pos)))
        local, carried = F.last("_v", True).over(inside), F.last("_s", True).over(along)
        merge = F.coalesce("_local", "_carry")
    elif how == "max":
        per_chunk = F.max("_v")
        local, carried = F.max("_v").over(inside), F.max("_s").over(along)
        merge = F.greatest("_local", "_carry")
    else:
        raise ValueError(how)
    sums = (rows.groupBy(*keys, "_chunk").agg(per_chunk.alias("_s"))
            .withColumn("_carry", carried).drop("_s"))
    return (rows.withColumn("_local", local).join(sums, [*keys, "_chunk"])
            .withColumn(name, merge).drop("_chunk", "_v", "_local", "_carry"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. The limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).filter(F.col(rank) <= k)
