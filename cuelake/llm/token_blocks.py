"""Token-id files in patched frame-of-reference blocks.

Ids are cut into blocks of 128. A block stores its minimum, the differences to it packed at a
width that holds a chosen share of them (a percentile of their bit lengths), and the rest, the
exceptions, in a list of places and values. An index gives the start of each block, so that a
block can be decoded alone. Documents lie in ascending doc_id order; a segment holds whole
documents, about ``SEGMENT_TOKENS`` ids, and is one row of a Parquet file (the envelope gives
atomic commits on any store that Spark writes).

Segment, little-endian: ``PFR1``, u32 documents, u32 ids, u32 blocks, u32 exceptions;
i64 doc_id[documents], u8 has_id[documents], u32 length[documents]; u32 minimum[blocks],
u8 width[blocks], u32 start[blocks] (byte in the packed part), u32 first exception[blocks];
u8 place[exceptions], u32 value[exceptions]; packed part: 16 * width bytes a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.llm.byte_bpe import WordEncoder
from cuelake.llm.common import bounded_batches, nonnull_text, partitions, scratch, worker_state

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_TOKENS = 1 << 18
SEGMENTS = "part int, segment int, n_docs long, n_tokens long, data binary"


def _bits(v: np.ndarray) -> np.ndarray:
    """Bit length of unsigned values below 2^32."""
    return np.frexp(v.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> dict[str, np.ndarray]:
    """Blocks of any number of unsigned 32-bit ids."""
    n = len(ids)
    nb = -(-n // BLOCK)
    full = np.empty(nb * BLOCK, np.uint32)
    full[:n] = ids
    if nb:
        full[n:] = ids[-1]
    full = full.reshape(nb, BLOCK)
    low = full.min(axis=1) if nb else np.zeros(0, np.uint32)
    diff = full - low[:, None]
    bits = _bits(diff)
    at = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.partition(bits, at, axis=1)[:, at] if nb else np.zeros(0, np.uint8)
    row, place = np.nonzero(bits > width[:, None]) if nb else (np.zeros(0, np.int64),) * 2
    value = diff[row, place]
    first = np.searchsorted(row, np.arange(nb)).astype(np.uint32)
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.concatenate([[0], np.cumsum(size)])
    packed = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width):
        w = int(w)
        if not w:
            continue
        rows = np.nonzero(width == w)[0]
        v = np.ascontiguousarray(diff[rows].T.astype(np.uint64) & np.uint64((1 << w) - 1))
        words = np.zeros((2 * w, len(rows)), np.uint64)
        for j in range(BLOCK):
            k, sh = divmod(j * w, 64)
            words[k] |= v[j] << np.uint64(sh)
            if sh + w > 64:
                words[k + 1] |= v[j] >> np.uint64(64 - sh)
        packed[(start[rows][:, None] + np.arange(16 * w)[None, :]).ravel()] = np.ascontiguousarray(words.T).view(np.uint8).ravel()
    return {"low": low, "width": width, "start": start[:-1].astype(np.uint32), "first": first,
            "place": place.astype(np.uint8), "value": value.astype(np.uint32), "packed": packed}


def unpack(b: dict[str, np.ndarray], n: int, only: np.ndarray | None = None) -> np.ndarray:
    """The ids of all blocks, or of the given block numbers alone (whole blocks)."""
    blocks = np.arange(len(b["low"])) if only is None else np.asarray(only)
    out = np.zeros((len(blocks), BLOCK), np.uint32)
    width, start = b["width"][blocks], b["start"][blocks].astype(np.int64)
    for w in np.unique(width):
        w = int(w)
        if not w:
            continue
        rows = np.nonzero(width == w)[0]
        raw = b["packed"][(start[rows][:, None] + np.arange(16 * w)[None, :]).ravel()]
        words = np.ascontiguousarray(raw.view(np.uint64).reshape(len(rows), 2 * w).T)
        v, mask = np.empty((BLOCK, len(rows)), np.uint32), np.uint64((1 << w) - 1)
        for j in range(BLOCK):
            k, sh = divmod(j * w, 64)
            x = words[k] >> np.uint64(sh)
            if sh + w > 64:
                x = x | (words[k + 1] << np.uint64(64 - sh))
            v[j] = x & mask
        out[rows] = v.T
    first = np.append(b["first"], len(b["place"])).astype(np.int64)
    count = first[blocks + 1] - first[blocks]
    if count.sum():
        row = np.repeat(np.arange(len(blocks)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[blocks], count)
        out[row, b["place"][at]] = b["value"][at]
    out += b["low"][blocks][:, None]
    return out.ravel()[:n] if only is None else out


def to_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    b = pack(ids, percentile)
    head = np.array([len(doc_ids), len(ids), len(b["low"]), len(b["place"])], np.uint32)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join([b"PFR1", head.tobytes(), np.array([x or 0 for x in doc_ids], np.int64).tobytes(), known.tobytes(),
                     np.array(lengths, np.uint32).tobytes(), b["low"].tobytes(), b["width"].tobytes(), b["start"].tobytes(),
                     b["first"].tobytes(), b["place"].tobytes(), b["value"].tobytes(), b["packed"].tobytes()])


def from_bytes(data: bytes) -> tuple[list, np.ndarray, dict[str, np.ndarray], int]:
    """doc_ids, lengths, blocks for :func:`unpack`, number of ids."""
    if data[:4] != b"PFR1":
        raise ValueError("not a segment of token ids")
    nd, n, nb, ne = (int(x) for x in np.frombuffer(data, np.uint32, 4, 4))
    at, got = 20, []
    for kind, count in (("<i8", nd), ("u1", nd), ("<u4", nd), ("<u4", nb), ("u1", nb), ("<u4", nb), ("<u4", nb), ("u1", ne),
                        ("<u4", ne)):
        got.append(np.frombuffer(data, kind, count, at))
        at += got[-1].nbytes
    doc, known, length, low, width, start, first, place, value = got
    return ([int(d) if k else None for d, k in zip(doc, known)], length,
            {"low": low, "width": width, "start": start, "first": first, "place": place, "value": value,
             "packed": np.frombuffer(data, np.uint8, -1, at)}, n)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                 percentile: float = PERCENTILE, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode whole texts, add ``end_id`` to each, and write segments in ascending id order.

    A null text counts as empty (one id, the end); null ids come first; rows of one id are
    ordered by text; repeated rows are all written. Only the two named columns are read. An
    empty table writes no segment.
    """
    from pyspark import TaskContext

    spark = bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("d"), nonnull_text(text_col).alias("t"))
    key = F.xxhash64("t")
    # Range partitions in id order; one id with very many rows is split by its texts.
    dealt = (rows.repartitionByRange(partitions(spark), F.col("d").asc_nulls_first(), key)
             .sortWithinPartitions(F.col("d").asc_nulls_first(), key, "t"))
    end = int(end_id).to_bytes(4, "little")
    types = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                       ("data", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_state(("byte_bpe", tokenizer), lambda: WordEncoder(tokenizer))
        part, seg = TaskContext.get().partitionId(), 0
        doc, length, parts, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            data = to_bytes(doc, length, np.frombuffer(b"".join(parts), np.uint32), percentile)
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((part, seg, len(doc), held, data), types)],
                                              schema=types)

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.ids(t.as_py()) + end
                doc.append(d)
                length.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
                if held >= segment_tokens:
                    yield out()
                    seg, doc, length, parts, held = seg + 1, [], [], [], 0
        if doc:
            yield out()

    dealt.mapInArrow(encode, SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, **columns: Column) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids (binary, unsigned 32-bit little-endian).

    ``columns`` made from ``ids`` may take its place; they are made before any shuffle.
    ``start`` counts the ids of all documents before it: sums of partitions, then of segments,
    then of documents inside a segment, so no task sees more than one partition's segments.
    """
    segs = spark.read.schema(SEGMENTS).parquet(path)
    per_part = segs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per output partition, not per document.
    before = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    starts = (segs.select("part", "segment", "n_tokens")
              .withColumn("seg_start", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens"))
              .join(before, "part").select("part", "segment", (F.col("seg_start") + F.col("part_start")).alias("base")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seg, data in zip(b.column(0), b.column(1), b.column(2)):
                doc, length, blocks, n = from_bytes(data.as_py())
                ids = unpack(blocks, n)
                ends = np.cumsum(length.astype(np.int64))
                for i in range(0, len(doc), 1024):
                    j = min(len(doc), i + 1024)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.as_py()] * (j - i), pa.int32()), pa.array([seg.as_py()] * (j - i), pa.int32()),
                         pa.array(doc[i:j], pa.int64()), pa.array((ends - length)[i:j], pa.int64()),
                         pa.array(length[i:j], pa.int64()),
                         pa.array([ids[e - k:e].tobytes() for e, k in zip(ends[i:j], length[i:j].astype(np.int64))], pa.binary())],
                        names=["part", "segment", "doc_id", "at", "n_tokens", "ids"])

    docs = segs.select("part", "segment", "data").mapInArrow(
        decode, "part int, segment int, doc_id long, at long, n_tokens long, ids binary")
    values = columns or {"ids": F.col("ids")}
    docs = docs.select("part", "segment", "doc_id", "at", "n_tokens", *(c.alias(n) for n, c in values.items()))
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", *values)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files to the shared folder and read them back, with the checksum of each document's ids."""
    spark = docs.sparkSession
    path = scratch(spark, "token-blocks")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path, ids_crc32=F.crc32("ids"))
