"""Exact duplicates by skew-safe combining.

Copies meet in three steps: inside their partition (the partial aggregate), in one of
``salts`` groups of their digest, and at last the winners of the salts meet globally. Every
step groups by the full normalised text beside the digest, so equal digests alone never make
a copy. What a hot text sends on is one row per task, then one per salt.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import bounded_batches, lean, nonnull_text, partitions, written

SALTS = 16


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = sha256,
               with_text: bool = True) -> DataFrame:
    """doc_id, h (hash of the text as it is), digest and (if asked for) the text with A-Z lowered; null counts as empty."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "h", "digest", *(["norm"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norm = pc.ascii_lower(b.column(2))
            d = pa.array([digest(x) for x in norm.cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), d, norm][:len(names)], names=names)

    text = nonnull_text(text_col)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("t"))
            .mapInArrow(lean(run), "doc_id long, h long, digest binary" + ", norm string" * with_text))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = sha256,
            salts: int = SALTS) -> DataFrame:
    """digest, norm, keep_id, group_size: one row per distinct normalised text."""
    n = partitions(docs.sparkSession)
    rows = normalised(docs, id_col, text_col, digest)
    local = rows.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return local.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     digest: Callable[[bytes], bytes] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest; h and copies: a hash of
    the text, and how many rows share id and normalised text.

    Texts are equal when they are identical after lowering A-Z; null counts as empty. The
    largest doc_id of a group stays. Of repeated rows (same id, same text) exactly one is
    kept; a group without any id keeps one row. Other columns are not read.
    """
    # Written once: digests that more than one text shares are sought in it, and the join reads it.
    won = written(winners(docs, id_col, text_col, digest, salts)
                  .select("digest", F.sha2("norm", 256).alias("norm_sha"), F.md5("norm").alias("norm_md5"), "keep_id", "group_size"),
                  "exact-winners")
    shared = won.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    if shared.isEmpty():
        # The content was compared above: a digest with one text names that text.
        rows = normalised(docs, id_col, text_col, digest, with_text=False).groupBy("digest", "doc_id").agg(
            F.count("*").alias("copies"), F.min("h").alias("h"))
        found = rows.join(won.select("digest", "keep_id", "group_size"), "digest")
    else:
        rows = (normalised(docs, id_col, text_col, digest)
                .groupBy("digest", F.sha2("norm", 256).alias("norm_sha"), F.md5("norm").alias("norm_md5"), "doc_id")
                .agg(F.count("*").alias("copies"), F.min("h").alias("h")))
        found = rows.join(won, ["digest", "norm_sha", "norm_md5"])
    return (found.select("doc_id", "keep_id", "group_size", "digest", "h", "copies",
                         F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest", "h", "copies"))


def keep_exact(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The kept documents with all their columns. Of rows that share id and text, one stays."""
    kept = written(exact_duplicates(docs, salts=salts).filter("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_hash"), F.col("digest").alias("kept_digest"), F.col("copies").alias("kept_copies")),
        "exact-kept")
    text = nonnull_text(docs["text"])
    one = kept.filter("kept_copies = 1")
    single = docs.join(one, docs["doc_id"].eqNullSafe(one["kept_id"]) & (F.xxhash64(text) == one["kept_hash"]), "left_semi")
    many = kept.filter("kept_copies > 1")
    if many.isEmpty():
        return single
    norm = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    repeated = docs.join(many, docs["doc_id"].eqNullSafe(many["kept_id"]) & (F.unhex(F.sha2(norm, 256)) == many["kept_digest"]), "left_semi")
    key = F.struct(F.col("doc_id"), F.unhex(F.sha2(F.translate(nonnull_text("text"), string.ascii_uppercase, string.ascii_lowercase), 256)))
    packed = repeated.select(key.alias("k"), F.struct("*").alias("r")).groupBy("k").agg(F.min("r").alias("r"))
    return single.unionByName(packed.select("r.*"))
