"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A shard owns ``vnodes`` arcs of the ring; a row lies where the hash of its text puts it, so
equal texts lie together. No shard takes more than ``(1 + slack)`` of the mean load. What
overflows a full shard goes on clockwise to the next shard with room. Rows are not walked
one by one: rows too large to cut an arc finely (a number bounded by the parameters, not by
the data) are placed singly, then each arc is placed as a whole, cut where a shard is full.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import nonnull_text, written

SLOTS = 1 << 16
VNODES = 128
HEAVY_PARTS = 200
CHUNK_ROWS = 1 << 16


def ring(spark, shards: int, vnodes: int) -> DataFrame:
    """arc, from slot, shards clockwise from the arc's owner; a fixed number of rows."""
    v = (spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
         .select("shard", F.pmod(F.xxhash64(F.lit("vnode"), "shard", "v"), F.lit(SLOTS)).cast("int").alias("slot")))
    v = v.groupBy("slot").agg(F.min("shard").alias("shard"))  # two nodes of one slot: the lower shard has it
    all_v = v.agg(F.sort_array(F.collect_list(F.struct("slot", "shard"))).alias("nodes"))
    return all_v.select(F.posexplode("nodes").alias("arc", "node"), "nodes").select(
        "arc", F.col("node.slot").alias("slot"),
        F.array_distinct(F.concat(F.expr("transform(slice(nodes, arc + 1, size(nodes)), x -> x.shard)"),
                                  F.expr("transform(slice(nodes, 1, arc + 1), x -> x.shard)"))).alias("way"))


def _arc_of_slot(nodes: DataFrame) -> DataFrame:
    """slot -> arc: the first node at or behind a slot, clockwise, round the end."""
    at = nodes.select(F.col("slot").alias("node_slot"), "arc")
    bound = at.agg(F.max("arc").alias("last"))
    w = Window.orderBy("node_slot")
    spans = at.select("arc", (F.coalesce(F.lag("node_slot").over(w), F.lit(-1)) + 1).alias("a"), F.col("node_slot").alias("b"))
    tail = at.agg(F.max("node_slot").alias("m")).crossJoin(bound).filter(F.col("m") < SLOTS - 1).select(
        F.lit(0).alias("arc"), (F.col("m") + 1).alias("a"), F.lit(SLOTS - 1).alias("b"))
    return spans.unionByName(tail).select(F.explode(F.sequence("a", "b")).alias("slot"), "arc")


def _place_heavy(shards: int, cap: Column) -> Column:
    """Fold: each large row, largest first, to the first shard clockwise with room, else to the emptiest."""
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    start = F.struct(zero.alias("load"), F.array().cast("array<int>").alias("to"))

    def step(s: Column, x: Column) -> Column:
        room = F.filter(x["way"], lambda k: F.element_at(s["load"], k + 1) + x["size"] <= cap)
        emptiest = (F.array_position(s["load"], F.array_min(s["load"])) - 1).cast("int")
        to = F.coalesce(F.get(room, F.lit(0)), emptiest)
        load = F.transform(s["load"], lambda v, i: F.when(i == to, v + x["size"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(s["to"], F.array(to)).alias("to"))

    return F.aggregate("rows", start, step)


def _place_arcs(load: Column, cap: Column) -> Column:
    """Fold: the bytes of each arc to its shards clockwise, as much to each as it has room for."""
    start = F.struct(load.alias("load"), F.array().cast("array<array<struct<shard:int,take:bigint>>>").alias("cuts"))

    def step(s: Column, x: Column) -> Column:
        one = F.struct(x["size"].alias("rest"), F.array().cast("array<struct<shard:int,take:bigint>>").alias("got"))

        def walk(g: Column, k: Column) -> Column:
            room = F.greatest(cap - F.element_at(s["load"], k + 1), F.lit(0).cast("long"))
            take = F.least(g["rest"], room)
            more = F.concat(g["got"], F.array(F.struct(k.alias("shard"), take.alias("take"))))
            return F.struct((g["rest"] - take).alias("rest"), F.when(take > 0, more).otherwise(g["got"]).alias("got"))

        got = F.aggregate(x["way"], one, walk)["got"]
        new = F.transform(s["load"], lambda v, i: v + F.aggregate(
            F.filter(got, lambda g: g["shard"] == i), F.lit(0).cast("long"), lambda a, g: a + g["take"]))
        return F.struct(new.alias("load"), F.concat(s["cuts"], F.array(got)).alias("cuts"))

    return F.aggregate("arcs", start, step)


def shard_rows(docs: DataFrame, shards: int = 40, vnodes: int = VNODES, slack: float = 0.0, heavy_parts: int = HEAVY_PARTS,
               chunk_rows: int = CHUNK_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot (gapless in its shard), moved.

    ``size``: UTF-8 bytes of the text (null: none) plus 16. Rows larger than a shard's capacity
    over ``heavy_parts`` are placed singly (at most heavy_parts * shards of them), so loads come
    as near to the mean as that. ``moved`` tells that the row is not in the shard that owns its
    arc. Null ids are placed like others; repeated rows each get a slot of their own; an empty
    table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = nonnull_text(text_col)
    h = F.xxhash64(text)
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                               F.crc32(text).alias("text_crc32"), h.alias("h"), F.pmod(h, F.lit(SLOTS)).cast("int").alias("slot")), "ring-rows")
    nodes = written(ring(spark, shards, vnodes), "ring-nodes")
    arcs = F.broadcast(_arc_of_slot(nodes))  # SLOTS rows, whatever the data
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    cap_value = F.ceil(F.col("total") * F.lit(1.0 + slack) / F.lit(shards))
    cap = int(total.select(cap_value.cast("long")).first()[0])
    least = max(1, cap // heavy_parts)
    cap_col = F.lit(cap).cast("long")
    placed = rows.join(arcs, "slot")
    # Heavy rows: fewer than shards * heavy_parts, as their sum is below the total.
    heavy = placed.filter(F.col("size") > least)
    same = Window.partitionBy("doc_id", "h").orderBy("size")
    heavy = heavy.withColumn("copy", F.row_number().over(same))
    ways = F.broadcast(nodes.select("arc", "way"))  # shards * vnodes rows
    order = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("minus"), "slot", "h", "doc_id", "copy", "size", "way", "arc", "text_crc32")))
    folded = written(heavy.join(ways, "arc").agg(order.alias("rows")).select("rows", _place_heavy(shards, cap_col).alias("f"))
                     .select(F.col("f.load").alias("load"), F.arrays_zip("rows", F.col("f.to").alias("to")).alias("z")), "ring-heavy")
    big = folded.select(F.inline("z")).select("rows.*", "to").select(
        "doc_id", "size", "text_crc32", "h", F.col("to").alias("shard"), (F.col("to") != F.get("way", F.lit(0))).alias("moved"),
        F.lit(-1).alias("arc"), F.lit(0).cast("long").alias("chunk"), "copy")
    # Light rows: arcs are folded as wholes, then cut by running bytes inside an arc.
    light = placed.filter(F.col("size") <= least)
    per_arc = light.groupBy("arc").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    cuts = (per_arc.join(nodes.select("arc", "way"), "arc")
            .agg(F.array_sort(F.collect_list(F.struct("arc", "size", "way"))).alias("arcs")).crossJoin(folded.select("load"))
            .select("arcs", _place_arcs(F.col("load"), cap_col).alias("f"))
            .select(F.explode(F.arrays_zip("arcs", F.col("f.cuts").alias("cut"))).alias("z"))
            .select(F.col("z.arcs.arc").alias("arc"), F.col("z.cut").alias("cut"), F.get("z.arcs.way", F.lit(0)).alias("home")))
    # An arc with many rows (a hot text) is numbered in chunks, dealt by the hash of the id.
    sizes = F.broadcast(per_arc.select("arc", F.ceil(F.col("n") / F.lit(chunk_rows)).cast("long").alias("chunks")))
    chunked = light.join(sizes, "arc").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).drop("chunks")
    per_chunk = chunked.groupBy("arc", "chunk").agg(F.sum("size").alias("bytes"))
    base = per_chunk.select("arc", "chunk", (F.sum("bytes").over(Window.partitionBy("arc").orderBy("chunk")) - F.col("bytes")).alias("base"))
    inside = Window.partitionBy("arc", "chunk").orderBy("slot", "h", "size", "doc_id", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    at = (chunked.join(base, ["arc", "chunk"])
          .withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("base"))
    # The row goes to the shard in whose share of the arc its first byte lies.
    share = F.aggregate("cut", F.struct(F.col("at").alias("left"), F.lit(None).cast("int").alias("shard")),
                        lambda s, c: F.when(s["shard"].isNotNull(), s).otherwise(
                            F.struct((s["left"] - c["take"]).alias("left"), F.when(s["left"] < c["take"], c["shard"]).alias("shard"))))
    small = (at.join(F.broadcast(cuts), "arc").withColumn("to", share["shard"])
             .select("doc_id", "size", "text_crc32", "h", F.coalesce("to", F.element_at("cut", -1)["shard"]).alias("shard"), "home", "arc", "chunk", "at")
             .withColumn("moved", F.col("shard") != F.col("home"))
             .select("doc_id", "size", "text_crc32", "h", "shard", "moved", "arc", "chunk", F.col("at").alias("copy")))
    done = written(big.unionByName(small), "ring-placed")
    # Slots: rows of earlier groups of the shard, then the place in the own group.
    groups = done.groupBy("shard", "arc", "chunk").agg(F.count("*").alias("n"))
    first = groups.select("shard", "arc", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("arc", "chunk")) - F.col("n")).alias("first"))
    own = Window.partitionBy("shard", "arc", "chunk").orderBy("copy", "h", "doc_id", "text_crc32", "size")
    return (done.join(first, ["shard", "arc", "chunk"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.row_number().over(own) - 1).cast("long").alias("slot"), "moved"))
