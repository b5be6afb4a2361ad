"""Near copies by exact Jaccard similarity of word shingles.

64-bit SimHash cannot carry a similarity of 0.8: such texts differ in about 10 bits, some in 18,
and no block table of 64 bits parts rows at that limit. Candidates are therefore texts that agree
in one of ``BANDS`` tables of ``ROWS`` minimum hashes each: a pair at 0.8 is missed with
probability (1 - 0.8^4)^24 = 3e-6, a pair above it less often. Every candidate is then compared by
its whole shingle set, so no pair below the limit links.

Equal sets are one row before any of this. Tables' buckets with the same members are one bucket,
and a bucket larger than a tile is cut into tiles that meet each other in separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import bounded_batches, lean, nonnull_text, partitions, written
from cuelake.llm.components import components

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS, SEED = 4, 24, 42
TILE_ROWS, TILE_SHINGLES = 1024, 1 << 21
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles, A-Z lowered, words between ASCII white space.

    A text with fewer words is one shingle, a text without any has none.
    """
    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    code = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in w), np.uint64, len(w))
    size = min(words, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ code[k:k + n]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _digest(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63)


def bands(s: np.ndarray) -> list[int]:
    """One key per table of ``ROWS`` minimum hashes of a set; none for an empty set."""
    if not len(s):
        return []
    number = np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)
    salt = number * MULTIPLIER
    salt = (salt ^ (salt >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    least = np.full(len(salt), 2**64 - 1, np.uint64)
    for k in range(0, len(s), 1 << 12):
        h = (s[k:k + (1 << 12), None] ^ salt[None, :]) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        h *= MULTIPLIER
        least = np.minimum(least, h.min(axis=0))
    return [xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63) for x in least.reshape(BANDS, ROWS)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = nonnull_text(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("t"))


def sets(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (hash of the text), s (hash of its shingle set), n (its size) and band keys of every row."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "h", "s", "n", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, n, keys = [], [], []
            for t in b.column(2):
                x = shingles(t.as_py(), words)
                s.append(_digest(x))
                n.append(len(x))
                keys.append(bands(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.int64()), pa.array(n, pa.int32()),
                                              pa.array(keys, pa.list_(pa.int64()))], names=names)

    return _keyed(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, h long, s long, n int, keys array<long>")


def whole_sets(keyed: DataFrame, words: int) -> DataFrame:
    """s, hashes: the shingle set of every row (doc_id, h, t) itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), words) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                                             names=["s", "hashes"])

    return keyed.mapInArrow(lean(run), "s long, hashes binary")


def links_in(found: list[np.ndarray], side: np.ndarray, similarity: float) -> np.ndarray:
    """Positions (i, j) that connect all sets with the similarity or more; with sides 0/1 only pairs across are compared."""
    n = len(found)
    size = np.array([len(x) for x in found], np.int64)
    flat = np.concatenate(found)
    row = np.repeat(np.arange(n), size)
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    # Shingles of a single set meet nothing.
    shared = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    row, at = row[keep], shared[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both, step = np.zeros((n, n), np.float32), max(64, (1 << 22) // n)
    for k in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        a, b = np.searchsorted(at, [k, k + step])
        x = np.zeros((n, step), np.float32)
        x[row[a:b], at[a:b] - k] = 1
        both += x @ x.T
    # J >= s where (1 + s) * both >= s * (sum of sizes); a hair less, so that a similarity of just s counts.
    near = both * (1 + similarity) >= (similarity - 1e-9) * (size[:, None] + size[None, :])
    near &= (side[:, None] < 0) | (side[:, None] != side[None, :])
    i, j = np.nonzero(np.triu(near, 1))
    label, out = list(range(n)), []

    def root(x):
        while label[x] != x:
            label[x] = x = label[label[x]]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        p, q = root(a), root(b)
        if p != q:
            label[max(p, q)] = min(p, q)
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def buckets(keys: DataFrame, tile_rows: int = TILE_ROWS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """t, k, s, cut (number of tiles) of the buckets with more than one of the distinct sets (s, n, keys)."""
    keyed = keys.select("s", "n", F.posexplode("keys").alias("t", "k"))
    # Most buckets hold one set; of buckets with the same members one is enough.
    member = F.sum(F.xxhash64("s").cast("decimal(38,0)"))
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("rows"), F.sum("n").alias("total"), member.alias("members")).filter("rows > 1")
    sizes = sizes.groupBy("rows", "total", "members").agg(F.min(F.struct("t", "k")).alias("b")).select("rows", "total", "b.t", "b.k")
    cut = F.greatest(F.ceil(F.col("rows") / F.lit(tile_rows)), F.ceil(F.col("total") / F.lit(tile_shingles))).cast("int")
    return keyed.select("s", "t", "k").join(sizes.select("t", "k", cut.alias("cut")), ["t", "k"])


def links(rows: DataFrame, hashes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links a, b that connect all sets of one bucket with the similarity or more; ``hashes`` has s, hashes of each."""
    spark = bounded_batches(rows.sparkSession)
    own = F.pmod(F.xxhash64("s"), F.col("cut")).cast("int")
    # Tile i meets itself as (i, i) and every other tile j as (min, max).
    rows = (rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
            .select("t", "k", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "s"))
    rows = rows.join(hashes, "s").repartition(partitions(spark), "t", "k", "x", "y").sortWithinPartitions("t", "k", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def solve() -> pa.RecordBatch:
            key = [r[1] for r in held]
            side = np.array([-1 if now[2] == now[3] else int(r[0] == now[3]) for r in held])
            ij = links_in([np.frombuffer(r[2], np.uint64) for r in held], side, similarity)
            return pa.RecordBatch.from_arrays([pa.array([key[i] for i in ij[:, 0]], pa.int64()), pa.array([key[i] for i in ij[:, 1]], pa.int64())],
                                              names=["a", "b"])

        for b in batches:
            for *bucket, own, s, hashes in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now:
                    if len(held) > 1:
                        yield solve()
                    held, now = [], bucket
                held.append((own, s, hashes))
        if len(held) > 1:
            yield solve()

    return rows.select("t", "k", "x", "y", "own", "s", "hashes").mapInArrow(lean(run), "a long, b long")


def _links_of(rows: DataFrame, also: DataFrame) -> DataFrame:
    """Links a, b from the first set to each other set of the components in ``also``; rows has doc_id, h, s."""
    found = also.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "component_id").filter("component_id IS NOT NULL").distinct()
    of_set = (rows.join(found, rows["doc_id"].eqNullSafe(found["d"]) & (rows["h"] == found["g"])).select("s", "component_id").distinct())
    of_set = written(of_set, "near-also")
    first = of_set.groupBy("component_id").agg(F.min("s").alias("a"), F.max("s").alias("z")).filter("a < z").select("component_id", "a")
    return of_set.join(first, "component_id").filter("s != a").select("a", F.col("s").alias("b"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
             also: DataFrame | None = None) -> DataFrame:
    """The documents that are the first (smallest doc_id) of their component of near texts; all their columns.

    Texts link when their shingle sets have the Jaccard similarity or more; texts without a word
    are one. Rows of the first doc_id in a component all stay, as one document, however often it
    occurs; so do all rows of a component in which no row has a doc_id. ``also`` (doc_id, h, component_id of every row, as
    ``simhash.near_duplicates`` gives them) links texts besides: components are those of both kinds of links.
    """
    rows = written(sets(docs, words, id_col, text_col), "near-sets")
    any_row = F.min(F.struct("doc_id", "h", "n", "keys"))
    first = written(rows.groupBy("s").agg(F.min("doc_id").alias("least"), any_row.alias("r")).select("s", "least", "r.*"), "near-distinct")
    met = written(buckets(first.filter("n > 0").select("s", "n", "keys")), "near-buckets")
    # Only sets that meet another are made again, whole.
    one = first.join(met.select("s").distinct(), "s", "left_semi").select(F.col("doc_id").alias("one_id"), F.col("h").alias("one_hash"))
    keyed = _keyed(docs, id_col, text_col)
    again = keyed.join(one, keyed["doc_id"].eqNullSafe(one["one_id"]) & (keyed["h"] == one["one_hash"]), "left_semi")
    hashes = written(whole_sets(again, words).dropDuplicates(["s"]), "near-whole")
    pairs = links(met, hashes, similarity)
    if also is not None:
        pairs = pairs.unionByName(_links_of(rows, also))
    joined = components(pairs, "a", "b", "near-links")
    named = first.join(joined.withColumnRenamed("node", "s"), "s", "left").select("s", "least", F.coalesce("component", "s").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = named.join(smallest, "component").select("s", "component_id").filter(F.col("component_id").isNotNull())
    gone = (rows.select("doc_id", "h", "s").join(of_set, "s").filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_hash")).distinct())
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(nonnull_text(docs[text_col])) == gone["gone_hash"]),
                     "left_anti")
