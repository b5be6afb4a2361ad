"""Token counts through a digest cache.

A cache table holds counts by (tokenizer digest, content digest). Texts are joined to it by
their digest; only distinct texts that it lacks are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.byte_bpe import WordEncoder
from cuelake.llm.common import bounded_batches, nonnull_text, scratch, worker_state, written

CACHE = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Names the version of a tokenizer: the hash of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class _Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> bytes:
        return bytes(4 * len(self.sp.encode(text)))


def count_batches(path: str):
    """digest, text, known count (or null) -> digest, n_tokens, fresh; only rows without a count are encoded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_state(("count", path), lambda: (_Pieces if path.endswith(".model") else WordEncoder)(path))
        for b in batches:
            known = b.column(2).to_pylist()
            n = [len(enc.ids(t.as_py())) // 4 if k is None else k for t, k in zip(b.column(1), known)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([k is None for k in known], pa.bool_())],
                                             names=["digest", "n_tokens", "fresh"])
    return run


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Counts of one tokenizer version; a digest that two runs have both added counts once."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    The content is the text with null as empty; nothing else is normalised, as any other
    change could change the count. Rows are never merged: repeated rows come out as often as
    they went in, null ids stay null. Other columns are not read. ``cache`` is a folder of
    Parquet files that grows by the misses of this call.
    """
    spark = bounded_batches(docs.sparkSession)
    version = tokenizer_digest(tokenizer)
    text = nonnull_text(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    # Copies meet first in their own partition (partial aggregate), so a hot text is shuffled
    # once per partition; the cache joins the distinct texts on the same key.
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    looked = distinct.join(read_cache(spark, cache, version), "digest", "left").select(
        "digest", F.when(F.col("n_tokens").isNull(), F.col("text")).alias("text"), "n_tokens")
    # Written once: misses are encoded once, and the join below can split a hot digest.
    known = written(looked.mapInArrow(count_batches(tokenizer), "digest binary, n_tokens long, fresh boolean"), "token-counts-found")
    (known.filter("fresh").select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache))
    return (keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
            .join(known.drop("fresh"), "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def fresh_cache(spark: SparkSession) -> str:
    return scratch(spark, "token-counts")
