"""Quality floors, run-to-run progress and benchmark documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.ordered import chunk_of, dense_index, neighbours

# A step counts as progress from these gains on, and with a WER that does not rise.
CHRF_GAIN, BLEU_GAIN = 2.0, 1.0
EXPECTED = "fixture string, engines map<string, struct<wer_max: double, bleu_min: double, chrf_min: double>>"


def read_expected(spark: SparkSession, paths) -> DataFrame:
    """Floors (fixture, engine, wer_max, bleu_min, chrf_min) from JSON documents, one per fixture."""
    return expected_floors(spark.read.text(paths, wholetext=True))


def expected_floors(docs: DataFrame, column: str = "value") -> DataFrame:
    doc = docs.select(F.from_json(F.col(column), EXPECTED).alias("d"))
    return doc.select("d.fixture", F.explode("d.engines").alias("engine", "f")).select("fixture", "engine", "f.*")


def quality_gate(runs: DataFrame, floors: DataFrame) -> DataFrame:
    """Runs with ``failed`` (the floors missed, in order) and ``gate``: pass, fail or no_floor.

    A metric that is missing misses its floor. Runs without a floor for their fixture and
    engine stay, as ``no_floor``.
    """
    on = ["fixture", "engine"]
    j = runs.join(floors.withColumn("_known", F.lit(True)), on, "left")
    miss = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), F.lit(name))
    failed = F.array_compact(F.array(miss(F.col("wer") > F.col("wer_max"), "wer"), miss(F.col("bleu") < F.col("bleu_min"), "bleu"),
                                     miss(F.col("chrf") < F.col("chrf_min"), "chrf")))
    known = F.col("_known").isNotNull()
    return (j.withColumn("failed", F.when(known, failed).otherwise(F.array().cast("array<string>")))
            .withColumn("gate", F.when(~known, "no_floor").when(F.size("failed") == 0, "pass").otherwise("fail"))
            .drop("_known", "wer_max", "bleu_min", "chrf_min"))


def run_progress(runs: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), chrf_gain: float = CHRF_GAIN,
                 bleu_gain: float = BLEU_GAIN) -> DataFrame:
    """Runs with ``chrf_delta``, ``bleu_delta``, ``wer_delta`` to the run before and ``improved``.

    All three conditions must hold at once. The first run of a key has null deltas and is no
    improvement. ``order`` is a whole number.
    """
    keys = list(keys)
    before = {f"_{c}": (lambda w, c=c: F.lag(c).over(w)) for c in ("wer", "bleu", "chrf")}
    r = neighbours(dense_index(runs, keys, order, ties, name="run_no"), keys, "run_no", before)
    # Deltas to ten places: the difference of two decimals is not exact in binary.
    for c in ("wer", "bleu", "chrf"):
        r = r.withColumn(f"{c}_delta", F.round(F.col(c) - F.col(f"_{c}"), 10)).drop(f"_{c}")
    better = (F.col("chrf_delta") >= chrf_gain) & (F.col("bleu_delta") >= bleu_gain) & (F.col("wer_delta") <= 0)
    return r.withColumn("improved", F.coalesce(better, F.lit(False)))


CANDIDATE = ("candidate_id", "source")
COMPARISON = ("ref_id", "cand_id", "wer", "bleu", "chrf")
CARD = ("candidate_id", "is_reference", "wer", "bleu", "chrf", "composite_score", "rank")


def benchmark_documents(cands: DataFrame, comparisons: DataFrame, cards: DataFrame, refs: DataFrame, routes: DataFrame,
                        title: str = "media", part_rows: int = 4096) -> DataFrame:
    """One JSON document per title: its candidates, comparisons, scorecards and review routing.

    ``cands`` has ``ord``; ``routes`` has status and reason_codes. A title with more than
    ``part_rows`` candidates comes in several documents (``part`` 0, 1, ...; numbered by ``ord``),
    each with the rows of its candidates, so that no title has to fit into one group.
    """
    numbered = dense_index(cands, [title], "ord", ["candidate_id"], name="_pos").withColumn("part", chunk_of(F.col("_pos"), part_rows))
    place = numbered.select(title, F.col("candidate_id").alias("_id"), "part", "_pos")

    def listed(rows: DataFrame, by: str, fields, name: str) -> DataFrame:
        r = rows.withColumnRenamed(by, "_id").join(place, [title, "_id"]).withColumnRenamed("_id", by)
        g = r.groupBy(title, "part").agg(F.array_sort(F.collect_list(F.struct("_pos", F.struct(*fields).alias("r")))).alias("_l"))
        return g.select(title, "part", F.transform("_l", lambda x: x["r"]).alias(name))

    out = listed(cands, "candidate_id", CANDIDATE, "candidates")
    out = out.join(listed(comparisons, "cand_id", COMPARISON, "comparisons"), [title, "part"], "left")
    out = out.join(listed(cards, "candidate_id", CARD, "scorecards"), [title, "part"], "left")
    out = out.join(refs.select(title, "reference_id"), title, "left").join(
        routes.select(title, F.struct("status", "reason_codes").alias("review_task_routing")), title, "left")
    n = cands.groupBy(title).agg(F.count(F.lit(1)).alias("_n"))
    body = F.struct(F.col(title).alias("video"), "reference_id", F.when(F.col("_n") == 1, "single_candidate_only").otherwise("ok").alias("status"),
                    "candidates", F.coalesce("comparisons", F.array()).alias("comparisons"), F.coalesce("scorecards", F.array()).alias("scorecards"),
                    "review_task_routing")
    return out.join(n, title).select(title, "part", F.to_json(body, {"ignoreNullFields": "false"}).alias("doc"))


def write_benchmark_results(docs: DataFrame, out: str) -> None:
    """The documents as JSON lines; readers see all of them or none, as the committer decides."""
    docs.select(F.col("doc").alias("value")).write.mode("overwrite").text(out)
