"""Prefix trie of conversations by collapsing whole sequences.

Conversations become sequences of turns. Identical sequences are one weighted sequence with the
list of conversations that end there; sequences that are proper prefixes of others are found by an
anti-join, the rest are leaves; nodes are the weighted prefixes of the distinct sequences, added up.

A turn is known by its place and the SHA-256 of role and text, a sequence by the exclusive-or of four
64-bit hashes of its turns' places and digests. So a sequence needs no list of its turns, its prefixes
are running values, and a node's parent is the node's key without its last turn. Running values are
cut into chunks of places, so neither a long conversation nor a beginning that many share is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import partitions, written
from cuelake.ordered import CHUNK, chunk_of, dense_index

KEY = ["x1", "x2", "x3", "x4"]
END_RANGE = 4096


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn, null first; equal turns by role and text), digest, n_bytes.

    Null role or text is empty. Rows without conv_id belong to no conversation. Extra columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = rows.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), F.col("turn").isNotNull().alias("known"),
        role.alias("role"), text.alias("text"))
    placed = dense_index(t, ["conv_id"], "turn", ["known", "role", "text"], "pos", start=1)
    # The role's length parts role and text.
    named = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return placed.select("conv_id", "pos", F.unhex(F.sha2(named, 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


def rebuilt(turns: DataFrame, block: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and their turns (conv_id, pos, digest, n_bytes) with a borrowed beginning.

    Conversation c begins with the first h turns of conversation c - c % block, h = crc32(decimal c) % longest,
    or as many as that has, and goes on with its own turns after its first h.
    """
    turns = written(turns, "trie-own")
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("m"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(longest))
    convs = own.select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), h.alias("h"))
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("m").alias("base_m")), "base", "left")
    convs = convs.select("conv_id", "base", "h", F.least("h", F.coalesce("base_m", F.lit(0))).alias("k"))
    first = turns.filter(F.col("pos") < longest).withColumnRenamed("conv_id", "base")
    begin = convs.join(first, "base").filter(F.col("pos") <= F.col("h")).select("conv_id", "pos", "digest", "n_bytes")
    rest = turns.join(convs, "conv_id").filter(F.col("pos") > F.col("h"))
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "n_bytes")
    return convs.select("conv_id"), begin.unionByName(rest)


def _running(rows: DataFrame, keys: list[str], pos: str, values: dict[str, tuple], back: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Running values along ``pos`` within keys: name -> (aggregate, merge of two, column).

    Inside chunks of ``pos`` by window; what lies before a chunk comes from a table with one row per chunk.
    """
    r = rows.withColumn("_c", chunk_of(F.col(pos), chunk))
    order = lambda c: F.desc(c) if back else F.asc(c)
    inside = Window.partitionBy(*keys, "_c").orderBy(order(pos)).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*keys).orderBy(order("_c")).rowsBetween(Window.unboundedPreceding, -1)
    sums = r.groupBy(*keys, "_c").agg(*[agg(c).alias(f"_s_{n}") for n, (agg, _, c) in values.items()])
    sums = sums.select(*keys, "_c", *[agg(f"_s_{n}").over(along).alias(f"_b_{n}") for n, (agg, _, _) in values.items()])
    for n, (agg, _, c) in values.items():
        r = r.withColumn(f"_v_{n}", agg(c).over(inside))
    out = r.join(sums, [*keys, "_c"])
    merged = [F.coalesce(merge(F.col(f"_v_{n}"), F.col(f"_b_{n}")), F.col(f"_v_{n}")).alias(n) for n, (_, merge, _) in values.items()]
    return out.select(*[c for c in rows.columns if c not in values], *merged)


def _hashes() -> list[Column]:
    return [F.xxhash64(F.lit(i), "pos", "digest").alias(f"h{i}") for i in range(1, 5)]


def _xor(name: str):
    return F.bit_xor, lambda a, b: a.bitwiseXOR(b), F.col(name)


def _ends(members: DataFrame) -> DataFrame:
    """q, ends_sha256: digest of the sorted conversation ids of each sequence.

    Ids are joined in ranges first; ranges of a sequence stream in order through one hash, held for one sequence at a time.
    """
    ids = members.groupBy("q", chunk_of(F.col("conv_id"), END_RANGE).alias("range")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def stream(batches):
        import hashlib

        import pyarrow as pa

        q = h = None
        out = lambda qs, hs: pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(hs, pa.string())], ["q", "ends_sha256"])
        for b in batches:
            qs, hs = [], []
            for key, text in zip(b.column("q").to_pylist(), b.column("ids").to_pylist()):
                if key == q:
                    h.update(b"," + text.encode())
                else:
                    if h is not None:
                        qs.append(q)
                        hs.append(h.hexdigest())
                    q, h = key, hashlib.sha256(text.encode())
            yield out(qs, hs)
        if h is not None:
            yield out([q], [h.hexdigest()])

    dealt = ids.repartition(partitions(members.sparkSession), "q").sortWithinPartitions("q", "range")
    return dealt.select("q", "ids").mapInArrow(stream, "q long, ends_sha256 string")


def sequences(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (q: smallest conversation, depth, x1..x4, weight) and members (q, conv_id).

    ``turns`` has h1..h4 per turn. A conversation without turns is the empty sequence.
    """
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), *[F.bit_xor(f"h{i}").alias(f"x{i}") for i in range(1, 5)])
    per_conv = convs.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["depth", *KEY]])
    per_conv = written(per_conv, "trie-sequences")
    seqs = per_conv.groupBy("depth", *KEY).agg(F.min("conv_id").alias("q"), F.count(F.lit(1)).alias("weight"))
    return seqs, per_conv.join(seqs, ["depth", *KEY]).select("q", "conv_id")


def prefix_trie(convs: DataFrame, turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row per distinct beginning of the conversations: the first d turns, from d = 0.

    ``convs``: conv_id, each once; ``turns``: conv_id, pos (1, 2, ... without gaps), digest, n_bytes. Columns: conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No
    conversation gives no row. Extra columns are not read.
    """
    t = written(turns.select("conv_id", "pos", "n_bytes", *_hashes()), "trie-turns")
    seqs, members = sequences(convs, t)
    seqs = written(seqs, "trie-distinct")
    steps = t.join(seqs.select(F.col("q").alias("conv_id"), "weight"), "conv_id").withColumnRenamed("conv_id", "q")
    values = {f"x{i}": _xor(f"h{i}") for i in range(1, 5)}
    steps = _running(steps, ["q"], "pos", values, chunk=chunk).withColumnRenamed("pos", "depth")
    # The key without its last turn is the parent's.
    parent = [F.col(f"x{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"p{i}") for i in range(1, 5)]
    steps = written(steps.select("q", "depth", "weight", "n_bytes", *KEY, *parent), "trie-prefixes")
    # Sequences that some longer sequence begins with are no leaves: the parents of all steps tell them.
    inner = steps.select((F.col("depth") - 1).alias("depth"), *[F.col(f"p{i}").alias(f"x{i}") for i in range(1, 5)]).distinct()
    leaves = seqs.join(inner, ["depth", *KEY], "left_anti").select("q", F.lit(1).alias("leaf"))
    nodes = steps.join(leaves, "q", "left").groupBy("depth", *KEY).agg(
        F.min("q").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"), F.first("n_bytes").alias("n_bytes"),
        *[F.first(f"p{i}").alias(f"p{i}") for i in range(1, 5)])
    nodes = written(nodes, "trie-nodes")
    # What a node saves is booked on its smallest conversation's sequence; a subtree's sum is then the rest of each sequence from the node on.
    booked = steps.join(nodes.select("depth", *KEY, "conv_id", "n_convs"), ["depth", *KEY]).select(
        "q", "depth", *KEY, F.when(F.col("q") == F.col("conv_id"), (F.col("n_convs") - 1) * F.col("n_bytes")).otherwise(0).cast("long").alias("own"))
    total = {"saved": (F.sum, lambda a, b: a + b, F.col("own"))}
    saved = _running(booked, ["q"], "depth", total, back=True, chunk=chunk).groupBy("depth", *KEY).agg(F.sum("saved").alias("saved_tokens"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), *[F.col(f"p{i}").alias(f"x{i}") for i in range(1, 5)]).agg(
        F.count(F.lit(1)).alias("n_children"))
    zero = [F.lit(0).cast("long").alias(c) for c in KEY]
    # The root: every sequence; its own text is empty.
    root = seqs.agg(F.min("q").alias("conv_id"), F.sum("weight").alias("n_convs")).filter("n_convs > 0")
    grown = nodes.agg(F.sum((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    n_leaf = leaves.agg(F.count(F.lit(1)).alias("n_leaves"))
    root = root.join(F.broadcast(grown)).join(F.broadcast(n_leaf)).select(
        F.lit(0).cast("long").alias("depth"), *zero, "conv_id", "n_convs", "n_leaves", F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.lit(None).cast("long").alias("parent_conv_id"))
    up = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(f"x{i}").alias(f"p{i}") for i in range(1, 5)], F.col("conv_id").alias("parent_conv_id"))
    up = up.unionByName(root.select(F.lit(1).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(f"p{i}") for i in range(1, 5)],
                                    F.col("conv_id").alias("parent_conv_id")))
    inside = nodes.join(up, ["depth", "p1", "p2", "p3", "p4"]).join(saved, ["depth", *KEY])
    columns = ["depth", *KEY, "conv_id", "n_convs", "n_leaves", "saved_tokens", "parent_conv_id"]
    every = inside.select(*columns).unionByName(root.select(*columns))
    ends = seqs.join(_ends(members), "q").select("depth", *KEY, "ends_sha256")
    out = every.join(children, ["depth", *KEY], "left").join(ends, ["depth", *KEY], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                      F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
