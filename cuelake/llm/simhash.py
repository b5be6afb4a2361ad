"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 64 bits. Two fingerprints that differ in few bits agree in most blocks of
bits, so they meet in at least one bucket keyed by some of the blocks. Inside a bucket each
fingerprint carries its Hamming distances to many reference fingerprints. By the triangle
inequality two fingerprints within the limit differ by no more than it in every one of these
coordinates: rows are swept in the order of the first coordinate and a pair is dropped at
its largest coordinate difference; only survivors are compared bit by bit.

Equal fingerprints are one row before any of this. A bucket larger than ``TILE`` is cut into
tiles that meet each other in separate tasks. A tile gives links that connect what it has
found connected, not all pairs, so output grows with rows even where thousands are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import bounded_batches, nonnull_text, partitions, written
from cuelake.llm.components import components

BITS, SEED = 4, 42
WORDS = 4
PIVOTS = 16
TILE = 4096
BLOCKS = 6


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, from their numbers alone."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(n)], np.uint64)


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of word shingles, A-Z lowered, words between ASCII white space."""
    w = text.encode("utf-8", "replace").lower().split()  # of bytes: ASCII letters and white space only
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    dig, n = xxhash.xxh64_intdigest, len(w) - words + 1
    ones = np.zeros(64, np.int64)
    s, e = starts[:n].tolist(), ends[words - 1:].tolist()
    for k in range(0, n, 1 << 14):  # bounds what a very long text holds at once
        h = np.fromiter((dig(line[i:j], SEED) for i, j in zip(s[k:k + (1 << 14)], e[k:k + (1 << 14)])), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), fp (long) of every row; null text counts as empty, an empty text has fingerprint zero."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["doc_id", "h", "fp"])

    text = nonnull_text(text_col)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("t"))
            .mapInArrow(run, "doc_id long, h long, fp long"))


def bucket_masks(blocks: int = BLOCKS, limit: int = BITS) -> list[int]:
    """Masks of all choices of blocks - limit of the blocks: two fingerprints within the limit agree in one at least."""
    edge = [round(i * 64 / blocks) for i in range(blocks + 1)]
    one = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [sum(one[i] for i in c) for c in combinations(range(blocks), blocks - limit)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links_in(bucket: np.ndarray, side: np.ndarray, fp: np.ndarray, piv: np.ndarray, limit: int) -> np.ndarray:
    """Positions (i, j) that connect all rows of a bucket whose distance is within the limit.

    ``bucket`` numbers runs of rows; where ``side`` is 0/1 in one bucket, only pairs across are compared.
    """
    table = np.bitwise_count(fp[:, None] ^ piv[None, :]).astype(np.int16)
    order = np.lexsort((table[:, 0], bucket))
    bucket, side, fp, table = bucket[order], side[order], fp[order], table[order]
    n, label, found, step = len(fp), np.arange(len(fp)), [], 1
    at = np.arange(n - 1)
    while len(at):
        j = at + step
        # The sweep along the first coordinate ends where it has grown beyond the limit.
        near = (bucket[at] == bucket[j]) & (table[j, 0] - table[at, 0] <= limit)
        at = at[near]
        i, j = at, at + step
        todo = (label[i] != label[j]) & ((side[i] < 0) | (side[i] != side[j]))
        i, j = i[todo], j[todo]
        if len(i):
            alive = np.abs(table[i] - table[j]).max(axis=1) <= limit
            i, j = i[alive], j[alive]
            close = np.bitwise_count(fp[i] ^ fp[j]) <= limit
            i, j = i[close], j[close]
            if len(i):
                found.append(np.stack([order[i], order[j]], axis=1))
                while True:
                    a, b = label[i], label[j]
                    if (a == b).all():
                        break
                    np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                    while (label != label[label]).any():
                        label = label[label]
        step += 1
        at = at[at + step < n]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def links(distinct: DataFrame, limit: int = BITS, blocks: int = BLOCKS, n_pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect all pairs within ``limit`` bits."""
    spark = bounded_batches(distinct.sparkSession)
    masks = [_signed(m) for m in bucket_masks(blocks, limit)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "k"))
    # Most buckets hold one fingerprint; their rows go no further.
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    cut = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    rows = keyed.join(sizes, ["t", "k"]).withColumn("cut", cut)
    own = F.pmod(F.xxhash64("fp"), F.col("cut")).cast("int")
    rows = rows.withColumn("own", own)
    # Tile i meets itself as (i, i) and every other tile j as (min, max).
    meet = F.explode(F.sequence(F.lit(0), F.col("cut") - 1))
    rows = (rows.withColumn("other", meet)
            .select("t", "k", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "fp"))
    rows = rows.repartition(partitions(spark), "t", "k", "x", "y").sortWithinPartitions("t", "k", "x", "y")
    piv = pivots(n_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def solve(c: list[np.ndarray]) -> pa.RecordBatch:
            t, k, x, y, own, fp = c
            new = np.r_[True, (np.diff(t) != 0) | (np.diff(k) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)]
            side = np.where(x == y, -1, (own == y).astype(np.int64))
            ij = links_in(np.cumsum(new), side, fp.view(np.uint64), piv, limit)
            return pa.RecordBatch.from_arrays([pa.array(fp[ij[:, 0]]), pa.array(fp[ij[:, 1]])], names=["a", "b"])

        for b in batches:
            c = [col.to_numpy(zero_copy_only=False).astype(np.int64) for col in b.columns]
            held = c if held is None else [np.concatenate(z) for z in zip(held, c)]
            if len(held[0]) < 1 << 15:
                continue
            # The last bucket may go on in the next batch.
            same = np.ones(len(held[0]), bool)
            for z in held[:4]:
                same &= z == z[-1]
            last = int(np.argmax(same))
            if last:
                yield solve([z[:last] for z in held])
                held = [z[last:] for z in held]
        if held is not None and len(held[0]):
            yield solve(held)

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, limit: int = BITS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, h, fp, component_id (smallest doc_id that links reach, its own included).

    Fingerprints within ``limit`` bits link. Null texts count as empty, empty ones share
    fingerprint zero. Repeated rows come out as often as they went in. A null doc_id is never
    a component_id unless its component has no other. Other columns are not read.
    """
    fps = written(fingerprints(docs, words, id_col, text_col), "simhash")
    first = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    joined = components(links(first.select("fp"), limit), "a", "b", "simhash-links")
    named = first.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(smallest, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "h", "fp", "component_id")


def keep_one(docs: DataFrame, limit: int = BITS, words: int = WORDS) -> DataFrame:
    """The documents that are the first (smallest doc_id) of their component; all their columns.

    Rows of that doc_id in the component all stay, as one document, however often it occurs;
    so do all rows of a component in which no row has a doc_id.
    """
    found = near_duplicates(docs, limit, words)
    gone = (found.filter(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_hash")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(nonnull_text(docs["text"])) == gone["gone_hash"]),
                     "left_anti")
