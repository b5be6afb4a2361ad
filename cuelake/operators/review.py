"""Review decisions applied to the state of their tasks, in order, without a task as one group.

What a run of decisions does depends on the state before it only by whether the task is open there. So a chunk of a
task's decisions is a map of two entries, one for an open and one for a closed task: the status that it leaves and the
decisions that it takes. Chunks of all tasks are folded at once, and a task is its maps applied in order, a row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators.lifecycle import REVIEW_STATUS
from cuelake.ordered import CHUNK, chunk_of, dense_index

STATE = "task_id bigint, status string, events bigint, rejected bigint, late bigint, last_ts timestamp, last_id bigint"
OPEN = [REVIEW_STATUS.index(s) for s in ("pending", "reprocess")]
REPROCESS = REVIEW_STATUS.index("reprocess")
# No decision was taken yet: the status is the one before.
SAME = -1


def _take(now: Column, taken: Column, decision: Column, opened: bool) -> tuple[Column, Column]:
    """Status and number of decisions taken after one more, for a task that was open or closed at the start."""
    is_open = now.isin(OPEN + [SAME]) if opened else now.isin(OPEN)
    takes = (decision >= 0) & (is_open | (decision == REPROCESS))
    return F.when(takes, decision).otherwise(now), taken + takes.cast("bigint")


def _maps(decisions: Column) -> Column:
    """The two entries of a run of decisions (codes in order; -1 is no known status)."""
    none, zero = F.lit(SAME).cast("int"), F.lit(0).cast("bigint")
    start = F.struct(none.alias("if_open"), zero.alias("n_open"), none.alias("if_closed"), zero.alias("n_closed"))

    def step(m, x):
        a, n = _take(m["if_open"], m["n_open"], x, True)
        b, k = _take(m["if_closed"], m["n_closed"], x, False)
        return F.struct(a.alias("if_open"), n.alias("n_open"), b.alias("if_closed"), k.alias("n_closed"))

    return F.aggregate(decisions, start, step)


def _applied(maps: Column, status: Column) -> Column:
    """Status code and decisions taken when the maps are applied in order."""
    def step(s, m):
        is_open = s["code"].isin(OPEN)
        to = F.when(is_open, m["if_open"]).otherwise(m["if_closed"])
        n = F.when(is_open, m["n_open"]).otherwise(m["n_closed"])
        return F.struct(F.when(to == SAME, s["code"]).otherwise(to).alias("code"), (s["taken"] + n).alias("taken"))

    return F.aggregate(maps, F.struct(status.alias("code"), F.lit(0).cast("bigint").alias("taken")), step)


def _code(status: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, REVIEW_STATUS)), status), F.lit(0)).cast("int") - 1


def apply_decisions(state: DataFrame, decisions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """New state of the tasks that have decisions, with the columns of ``STATE``.

    ``decisions``: task_id, event_id, ts, status; applied by time and id. One older than the last that the task's state
    has seen is ``late`` and changes nothing. A closed task (approved, rejected) takes only ``reprocess``; other
    decisions on it, and unknown or null statuses, are counted as rejected. A task without state is pending. Decisions
    without task, time or id are left out.
    """
    before = state.select("task_id", F.struct("status", "events", "rejected", "late", "last_ts", "last_id").alias("was"))
    seen = (decisions.select("task_id", "event_id", "ts", _code(F.col("status")).alias("code")).dropna(subset=["task_id", "event_id", "ts"])
            .join(before, "task_id", "left"))
    late = F.coalesce(F.struct("ts", "event_id") < F.struct("was.last_ts", "was.last_id"), F.lit(False)) & F.col("was").isNotNull()
    # Late ones keep a place in the order, so that tasks with nothing else have a row too; no map holds them.
    slim = seen.select("task_id", "event_id", "ts", F.unix_millis("ts").alias("ms"), F.when(~late, F.col("code")).alias("code"))
    placed = dense_index(slim, ["task_id"], "ms", ["ts", "event_id", "code"], "pos")
    kept = F.when(F.col("code").isNotNull(), F.struct("pos", "code"))
    chunks = placed.groupBy("task_id", chunk_of(F.col("pos"), chunk).alias("part")).agg(
        _maps(F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["code"])).alias("map"),
        F.count("code").alias("n"), F.count(F.when(F.col("code").isNull(), 1)).alias("n_late"),
        F.max(F.when(F.col("code").isNotNull(), F.struct("ts", "event_id"))).alias("last"))
    # One row per chunk of a task.
    tasks = chunks.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("part", "map"))).alias("maps"), F.sum("n").alias("n"),
                                          F.sum("n_late").alias("n_late"), F.max("last").alias("last"))
    j = tasks.join(before, "task_id", "left")
    end = _applied(F.transform("maps", lambda m: m["map"]), _code(F.coalesce("was.status", F.lit("pending"))))
    old = {c: F.coalesce(f"was.{c}", F.lit(0)) for c in ("events", "rejected", "late")}
    return j.withColumn("end", end).select(
        "task_id", F.element_at(F.array(*map(F.lit, REVIEW_STATUS)), F.col("end.code") + 1).alias("status"),
        (old["events"] + F.col("end.taken")).alias("events"), (old["rejected"] + F.col("n") - F.col("end.taken")).alias("rejected"),
        (old["late"] + F.col("n_late")).alias("late"), F.coalesce("last.ts", "was.last_ts").alias("last_ts"),
        F.coalesce("last.event_id", "was.last_id").alias("last_id"))
