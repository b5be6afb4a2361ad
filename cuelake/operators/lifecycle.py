"""Registry semantics on append-only tables.

Tables only grow; the current state is an aggregate over the events of an id. All "latest"
and "first" picks are min_by / max_by aggregates, combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.text import strip
from cuelake.operators.prompts import prev_next
from cuelake.ordered import dense_index

# The status domains.
CANDIDATE_STATUS = ("pending", "accepted", "failed", "review_required")
REVIEW_STATUS = ("pending", "approved", "rejected", "reprocess")


def latest(events: DataFrame, keys, by) -> DataFrame:
    """The newest row per key by the columns ``by`` (end with an id for a total order)."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r")).select(*keys, "_r.*")


def first(events: DataFrame, keys, by) -> DataFrame:
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*by)).alias("_r")).select(*keys, "_r.*")


def upsert_media(writes: DataFrame, key: str = "media_hash", ts: str = "ts", order: str = "ord") -> DataFrame:
    """Current media rows: values of the last write, creation time of the first (L1)."""
    rest = [c for c in writes.columns if c not in (key, ts, order)]
    return writes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, order)).alias("_r"), F.min(ts).alias("created_at"),
                                   F.max(ts).alias("updated_at")).select(key, "_r.*", "created_at", "updated_at")


def check_domain(rows: DataFrame, column: str, domain) -> tuple[DataFrame, DataFrame]:
    """(rows in the domain, rejects with a reason) (L2)."""
    ok = F.coalesce(F.col(column).isin(*domain), F.lit(False))
    return rows.filter(ok), rows.filter(~ok).withColumn("reason", F.concat(F.lit(f"invalid {column}: "), F.coalesce(column, F.lit("NULL"))))


def unique_append(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(new rows, rejected rows): an id must be new, and the first of a batch wins."""
    lead = incoming.groupBy(key).agg(F.min(order).alias("_first"))
    lead = lead.join(existing.select(key).distinct(), key, "left_anti")
    j = incoming.join(lead, key, "left")
    new = F.col(order) == F.col("_first")
    return j.filter(new).drop("_first"), j.filter(~F.coalesce(new, F.lit(False))).drop("_first")


def apply_status(entities: DataFrame, events: DataFrame, key: str, domain, by) -> tuple[DataFrame, DataFrame]:
    """(current status per id, rejected events): unknown ids and statuses are errors (L4)."""
    good, bad = check_domain(events, "status", domain)
    known = good.join(entities.select(key), key, "left_semi")
    unknown = good.join(entities.select(key), key, "left_anti").withColumn("reason", F.lit("unknown id"))
    last = latest(known, [key], by).select(key, F.col("status").alias("new_status"))
    state = entities.join(last, key, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
    return state, bad.unionByName(unknown)


def review_history(events: DataFrame, key: str, ts_us: str, order: str) -> DataFrame:
    """Events of each task numbered in time order (L5). Rows instead of one growing list."""
    return dense_index(events, [key], ts_us, [order], name="seq", width=86_400_000_000)


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest runs; a top-k over all tasks, not a full sort (T4)."""
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def review_queue(tasks: DataFrame, status: str = "pending") -> DataFrame:
    return tasks.filter(F.col("status") == status).orderBy("created_at", "id")


def skip_processed(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Status per input: skipped when its output is newer, else to do."""
    o = outputs.groupBy(key).agg(F.max("mtime").alias("out_mtime"))
    j = inputs.join(o, key, "left")
    return j.withColumn("status", F.when(F.col("out_mtime") > F.col("mtime"), "skipped").otherwise("todo"))


def run_status_counts(runs: DataFrame, keys=()) -> DataFrame:
    """Counts per status and the exit code: failed 1, else no_change 2, else 0."""
    c = lambda s: F.count_if(F.col("status") == s)
    return runs.groupBy(*keys).agg(c("ok").alias("ok"), c("skipped").alias("skipped"), c("no_change").alias("no_change"), c("failed").alias("failed"),
                                   F.when(c("failed") > 0, 1).when(c("no_change") > 0, 2).otherwise(0).alias("exit_code"))


def reprocess_candidates(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of the tasks marked for another run; one row per task."""
    return tasks.filter("status = 'reprocess'").select("task_id", "candidate_id").join(candidates, "candidate_id")


def create_tasks(routed: DataFrame, pending: DataFrame) -> DataFrame:
    """New pending tasks for routed candidates without an open one.

    ``routed``: media, candidate_id, ord, reason_codes.
    """
    key = ["media", "candidate_id"]
    fresh = routed.join(pending.filter("status = 'pending'").select(*key).distinct(), key, "left_anti")
    one = first(fresh, key, ["ord"])
    return one.withColumn("status", F.lit("pending")).withColumn("action", F.lit("task_created"))


def resolve_candidate(preferred: DataFrame, candidates: DataFrame) -> DataFrame:
    """The stored candidate named first in the preference list, else the title's last one.

    ``preferred``: media, prio, source_id (weak comparisons before reference before scorecards).
    ``candidates``: media, id, source_id.
    """
    by_name = candidates.groupBy("media", "source_id").agg(F.max("id").alias("id"))
    hit = preferred.join(by_name, ["media", "source_id"]).groupBy("media").agg(F.min_by("id", "prio").alias("hit"))
    last = candidates.groupBy("media").agg(F.max("id").alias("last"))
    return last.join(hit, "media", "left").select("media", F.coalesce("hit", "last").alias("candidate_id"), F.col("hit").isNotNull().alias("by_preference"))


def choose_compare(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Track to show next to a task's candidate: the named one, the parent, the latest sibling.

    ``tasks``: task_id, media, candidate_id, compare_id. ``candidates``: media, id, parent_id.
    """
    c = candidates.select(F.col("id").alias("candidate_id"), "parent_id")
    known = candidates.select(F.col("id").alias("_k"))
    t = tasks.join(c, "candidate_id", "left")
    t = t.join(known.withColumnRenamed("_k", "named"), F.col("compare_id") == F.col("named"), "left")
    t = t.join(known.withColumnRenamed("_k", "parent"), F.col("parent_id") == F.col("parent"), "left")
    # the two highest ids of a title are enough to find the latest one that is not the candidate
    tops = candidates.groupBy("media").agg(F.max("id").alias("_m1"))
    second = (candidates.join(tops, "media").filter("id < _m1").groupBy("media").agg(F.max("id").alias("_m2")))
    t = t.join(tops, "media", "left").join(second, "media", "left")
    sibling = F.when(F.col("_m1") != F.col("candidate_id"), F.col("_m1")).otherwise(F.col("_m2"))
    return t.select("task_id", "media", "candidate_id", F.coalesce("named", "parent", sibling).alias("compare_candidate_id"))


def apply_edits(cues: DataFrame, edits: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """(edited track, edits out of range) (J18). ``edits``: keys, idx, new_text."""
    keys = list(keys)
    out = cues.join(edits.select(*keys, "idx", "new_text"), [*keys, "idx"], "left")
    bad = edits.join(cues.select(*keys, "idx"), [*keys, "idx"], "left_anti")
    return out.withColumn("before", F.col("text")).withColumn("text", F.coalesce("new_text", "text")).withColumn(
        "edited", F.col("new_text").isNotNull()).drop("new_text"), bad


def approve_tasks(tasks: DataFrame, edits: DataFrame) -> DataFrame:
    """Accepted child candidates of approved tasks, with their edit counts.

    ``tasks``: task_id, media, candidate_id, source_id.
    """
    n = edits.groupBy("media").agg(F.count(F.lit(1)).alias("edit_count"))
    t = tasks.join(n, "media", "left").withColumn("edit_count", F.coalesce("edit_count", F.lit(0)))
    return t.select("task_id", "media", F.col("candidate_id").alias("parent_candidate_id"),
                    F.concat("source_id", F.lit(".review_t"), F.col("task_id").cast("string")).alias("source_id"),
                    F.lit("accepted").alias("candidate_status"), F.lit("approved").alias("task_status"),
                    F.lit("task_approved").alias("action"), "edit_count")


def reject_tasks(tasks: DataFrame, notes: Column) -> DataFrame:
    return tasks.select("task_id", F.lit("rejected").alias("task_status"), F.lit("task_rejected").alias("action"), notes.alias("reviewer_notes"))


def corrections_from_edits(edited: DataFrame, keys, source: str = "source_text") -> DataFrame:
    """Correction rows of the cues whose text really changed, with neighbour context."""
    ctx = F.when(strip(F.coalesce(F.col(source), F.lit(""))) != "", strip(F.col(source))).otherwise(strip(F.col("text")))
    c = prev_next(edited.withColumn("_src", ctx), keys, "_src")
    before, after = strip(F.col("before")), strip(F.col("text"))
    return c.filter(F.col("edited") & (before != "") & (after != "") & (before != after) & (F.col("_src") != "")).select(
        *keys, "idx", F.col("_src").alias("source_text"), before.alias("bad_translation"), after.alias("approved_translation"),
        "previous_context", "next_context", F.array(F.lit("review_approved_edit")).alias("tags"))


def dataset_summary(pairs: DataFrame, title: str = "source_video") -> DataFrame:
    """Pairs, titles and pairs per title."""
    per = pairs.groupBy(title).agg(F.count(F.lit(1)).alias("n"))
    n, t = F.sum("n"), F.count(F.lit(1))
    return per.agg(F.coalesce(n, F.lit(0)).alias("total_pairs"), t.alias("total_videos"),
                   F.when(t > 0, n / t).otherwise(0.0).alias("avg_pairs_per_video"))


# --- filtered reads and records ---------------------------------------------------------

def read_registry(spark: SparkSession, path: str, order: Sequence[Column] = (), limit: int | None = None, **filters) -> DataFrame:
    """Rows of a registry table with the given equality filters, in the given order.

    A filter that is None is not applied; the others reach the scan. ``limit`` keeps the first
    rows of the order, as a listing of recent rows asks for.
    """
    rows = spark.read.parquet(path)
    for name, value in filters.items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    rows = rows.orderBy(*order) if order else rows
    return rows.limit(limit) if limit is not None else rows


def with_metric_defaults(runs: DataFrame, metrics: str = "metrics", names: Sequence[str] = ("wer", "bleu", "chrf")) -> DataFrame:
    """Metrics that a run leaves out are read from its metrics document (L3)."""
    doc = F.try_parse_json(F.col(metrics))
    return runs.withColumns({n: F.coalesce(F.col(n), F.try_variant_get(doc, f"$.{n}", "double")) for n in names})


def record_runs(existing: DataFrame, incoming: DataFrame, key: str = "run_id", order: str = "ord",
                metrics: str = "metrics") -> tuple[DataFrame, DataFrame]:
    """(new runs with metric defaults, rejects with a reason) (L3)."""
    new, old = unique_append(existing, incoming, key, order)
    return with_metric_defaults(new, metrics), old.withColumn("reason", F.concat(F.lit("run exists: "), F.col(key).cast("string")))


def skip_existing(inputs: DataFrame, outputs: DataFrame, key) -> DataFrame:
    """Inputs with ``status``: ``skipped`` where an output of their key exists, else ``todo``."""
    keys = [key] if isinstance(key, str) else list(key)
    known = outputs.select(*keys).distinct().withColumn("_there", F.lit(True))
    return inputs.join(known, keys, "left").withColumn("status", F.when(F.col("_there"), "skipped").otherwise("todo")).drop("_there")


def union_tracks(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name; what a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def with_output(inputs: DataFrame, outputs: DataFrame, key) -> DataFrame:
    """Inputs that have an output of their key."""
    keys = [key] if isinstance(key, str) else list(key)
    return inputs.join(outputs.select(*keys), keys, "left_semi")


def approved_children(tasks: DataFrame, cues: DataFrame, edits: DataFrame, keys=("media", "cand")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cues of the child candidates, history events, edits out of range) of approved tasks.

    ``tasks``: task_id, source_id and the keys of the track they review. A child has all cues of
    its parent, with the edits put in; ``idx``, ``start_ms`` and ``end_ms`` stay. Its SRT text is
    ``timing.render_srt`` over these cues. A task whose edits are out of range is still approved.
    """
    keys = list(keys)
    track = tasks.select("task_id", F.concat("source_id", F.lit(".review_t"), F.col("task_id").cast("string")).alias("child_id"), *keys)
    mine = track.select(*keys).distinct()
    edited, bad = apply_edits(cues.join(mine, keys, "left_semi"), edits.join(mine, keys, "left_semi"), keys)
    child = edited.join(track, keys).select("task_id", "child_id", *keys, "idx", "start_ms", "end_ms", "text", "edited")
    n = edited.groupBy(*keys).agg(F.count_if("edited").alias("edit_count"), F.count(F.lit(1)).alias("cue_count"))
    event = track.join(n, keys, "left").select("task_id", "child_id", F.lit("task_approved").alias("action"),
                                               F.coalesce("edit_count", F.lit(0)).alias("edit_count"), F.coalesce("cue_count", F.lit(0)).alias("cue_count"))
    return child, event, bad
