"""Candidate lineage over parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.session import cut_lineage


def _links(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """n, a: each node with a parent that exists."""
    ids = nodes.select(F.col(node).alias("a"))
    return nodes.select(F.col(node).alias("n"), F.col(parent).alias("a")).join(ids, "a", "left_semi").select("n", "a")


def _hops(jump: DataFrame) -> DataFrame:
    """Twice as far along the parents: one row per node that has not reached a root."""
    end = jump.select(F.col("n").alias("a"), F.col("a").alias("a2"))
    return cut_lineage(jump.join(end, "a").select("n", F.col("a2").alias("a")))


def endless(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Nodes in or behind a cycle: still walking after as many steps as there are nodes.

    One row per node and round, however long the cycles are.
    """
    jump, total, width = cut_lineage(_links(nodes, node, parent)), nodes.count(), 1
    while width <= total and not jump.isEmpty():
        jump, width = _hops(jump), width * 2
    return jump.select(F.col("n").alias(node)).distinct()


def ancestors(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> tuple[DataFrame, DataFrame]:
    """(node, ancestor, distance) for the whole forest, and the nodes whose walk never ends.

    Nodes in or behind a cycle are found first and left out. Then pointer doubling: each round
    joins the known paths with themselves, so a chain of n links takes log2(n) rounds. Each
    round is written to the shared checkpoint folder, so a lost executor costs one round.
    """
    cyclic = endless(nodes, node, parent)
    jump = cut_lineage(_links(nodes, node, parent).join(cyclic.select(F.col(node).alias("n")), "n", "left_anti"))
    reach, width = jump.withColumn("d", F.lit(1).cast("bigint")), 1
    while not jump.isEmpty():
        # every known path, put behind the jump of ``width`` links that leads to its start
        hop = jump.select(F.col("n").alias("s"), F.col("a").alias("via"))
        more = reach.select(F.col("n").alias("via"), "a", "d").join(hop, "via").select(
            F.col("s").alias("n"), "a", (F.col("d") + width).alias("d"))
        reach = cut_lineage(reach.unionByName(more))
        jump, width = _hops(jump), width * 2
    return reach.select(F.col("n").alias(node), F.col("a").alias("ancestor"), F.col("d").alias("distance")), cyclic


def candidate_chain(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Every candidate with its ancestors and itself, numbered from the root."""
    up, cyclic = ancestors(nodes, node, parent)
    ok = nodes.select(node).join(cyclic, node, "left_anti")
    rows = up.unionByName(ok.select(node, F.col(node).alias("ancestor"), F.lit(0).cast("bigint").alias("distance")))
    depth = rows.groupBy(node).agg(F.max("distance").alias("_depth"))
    return rows.join(depth, node).select(node, "ancestor", (F.col("_depth") - F.col("distance")).alias("pos"))


def propagate_meta(nodes: DataFrame, columns, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Fill missing values from the nearest ancestor that has one.

    Each node carries the nearest values found so far and how far it has looked: one row per
    node and round. Nodes in or behind a cycle keep what they have.
    """
    own = nodes.select(F.col(node).alias("a"), *[F.col(c).alias(f"_{c}") for c in columns])
    state = cut_lineage(_links(nodes, node, parent).join(own, "a"))
    total, width = nodes.count(), 1
    while width <= total:
        live = state.filter("a IS NOT NULL")
        if live.isEmpty():
            break
        # What the node at the end of the jump knows is further away; a root ends the walk.
        far = state.select(F.col("n").alias("a"), F.col("a").alias("_to"), *[F.col(f"_{c}").alias(f"_far_{c}") for c in columns])
        step = live.join(far, "a", "left").select(
            "n", F.col("_to").alias("a"), *[F.coalesce(f"_{c}", f"_far_{c}").alias(f"_{c}") for c in columns])
        state, width = cut_lineage(step.unionByName(state.filter("a IS NULL").select(*step.columns))), width * 2
    found = state.filter("a IS NULL").drop("a")
    out = nodes.join(found.withColumnRenamed("n", node), node, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    return out
