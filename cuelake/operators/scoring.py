"""Reference choice, pairs of tracks, scorecards and candidate scores
(T7, J9, J10, R18, H28, H29, W8, R8, A16, A26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.operators.qc import rules
from cuelake.ordered import dense_index

# Base score and confidence tier per source strategy.
STRATEGY_BASE = {
    "sidecar_en": 70, "embedded_en": 70, "bitmap_en_ocr": 48, "en_audio_asr": 55, "sidecar_jp_mt": 40,
    "embedded_jp_mt": 40, "bitmap_jp_ocr_mt": 32, "ja_audio_asr_mt": 30, "untagged_audio_asr_mt": 15}
STRATEGY_TIER = {
    "sidecar_en": "high", "embedded_en": "high", "bitmap_en_ocr": "medium", "en_audio_asr": "medium",
    "sidecar_jp_mt": "low", "embedded_jp_mt": "low", "bitmap_jp_ocr_mt": "low", "ja_audio_asr_mt": "low",
    "untagged_audio_asr_mt": "very_low"}
REVIEW_STRATEGIES = ("sidecar_jp_mt", "embedded_jp_mt", "bitmap_jp_ocr_mt", "ja_audio_asr_mt", "untagged_audio_asr_mt")
GRADES = ((80, "A"), (60, "B"), (40, "C"), (20, "D"))


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table for ``key``."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def select_reference(cands: DataFrame, priority: list[str], title: str = "media") -> DataFrame:
    """First candidate whose id contains the earliest listed part; else the first one.

    A min over (priority, order), combined map-side.
    """
    prio = F.lit(len(priority))
    for i in range(len(priority) - 1, -1, -1):
        prio = F.when(F.col("candidate_id").contains(priority[i]), i).otherwise(prio)
    return cands.groupBy(title).agg(F.min(F.struct(prio.alias("p"), F.col("ord").alias("o"),
                                                   F.col("candidate_id").alias("id"))).alias("b")).select(
        title, F.col("b.id").alias("reference_id"))


def ref_vs_all(cands: DataFrame, refs: DataFrame, title: str = "media") -> DataFrame:
    """Reference against every other candidate of its title."""
    return cands.join(refs, title).filter(F.col("candidate_id") != F.col("reference_id")).select(
        title, F.col("reference_id").alias("ref_id"), F.col("candidate_id").alias("cand_id"))


def all_pairs(cands: DataFrame, title: str = "media") -> DataFrame:
    """Every unordered pair of a title's tracks, when it has more than two.

    All pairs are the result here; track ids only, no cues. The pairs of a title are spread
    over tasks by the left track.
    """
    many = cands.groupBy(title).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 2").select(title)
    c = cands.join(many, title, "left_semi")
    a = c.select(title, F.col("ord").alias("_a"), F.col("candidate_id").alias("ref_id"))
    b = c.select(title, F.col("ord").alias("_b"), F.col("candidate_id").alias("cand_id"))
    return a.join(b, title).filter("_a < _b").select(title, "ref_id", "cand_id")


def single_candidate(cands: DataFrame, title: str = "media") -> DataFrame:
    n = cands.groupBy(title).agg(F.count(F.lit(1)).alias("candidates"))
    one = F.col("candidates") == 1
    return n.withColumn("status", F.when(one, "single_candidate_only").otherwise("ok")).withColumn(
        "warning", F.when(one, "Only one candidate was generated — no benchmark comparison is possible. "
                          "Add more audio/subtitle tracks or enable additional translation engines."))


def composite(wer: Column, bleu: Column, chrf: Column, is_ref: Column) -> Column:
    score = 0.5 * (1.0 - wer) + 0.25 * (bleu / 100.0) + 0.25 * (chrf / 100.0)
    return F.coalesce(score, F.when(is_ref, 1.0))


def metric_bands() -> dict[str, Column]:
    """good, bad or neutral per metric, and the class of a source label."""
    w, b, c, s = F.col("wer") * 100, F.col("bleu"), F.col("chrf"), F.lower("source")
    band = lambda good, bad: F.when(good, "good").when(bad, "bad").otherwise("neutral")
    asr, emb, mt = s.contains("asr"), s.contains("embedded"), s.contains("mt") | s.contains("llm")
    return {"wer_band": band(w <= 20, w >= 60), "bleu_band": band(b >= 60, b < 25), "chrf_band": band(c >= 70, c < 35),
            "source_class": F.when(asr & mt, "mt").when(emb & ~mt, "embedded").when(asr, "asr").when(mt, "mt")
            .otherwise("other")}


def scorecards(cands: DataFrame, comparisons: DataFrame, refs: DataFrame, title: str = "media") -> DataFrame:
    """Metrics and composite per candidate, ranked: reference apart, rest best first.

    Ranks are dense numbers over a fixed-point score, made by counting per score slice, so a
    title with very many candidates is not ordered in one task.
    """
    against_ref = comparisons.join(refs, title).withColumn("_o", F.struct(
        F.when(F.col("ref_id") == F.col("reference_id"), 0).otherwise(1), F.col("ord")))
    best = against_ref.groupBy(title, F.col("cand_id").alias("candidate_id")).agg(
        F.min_by(F.struct("wer", "bleu", "chrf"), "_o").alias("m"))
    s = cands.join(refs, title).join(best, [title, "candidate_id"], "left")
    is_ref = F.col("candidate_id") == F.col("reference_id")
    s = s.select(*cands.columns, is_ref.alias("is_reference"), F.col("m.wer").alias("wer"), F.col("m.bleu").alias("bleu"),
                 F.col("m.chrf").alias("chrf"))
    s = s.withColumn("composite_score", composite(F.col("wer"), F.col("bleu"), F.col("chrf"), F.col("is_reference")))
    # composites have at most 6 decimals (wer 4, bleu and chrf 2 of a percentage), nulls go last
    key = F.coalesce(F.round((2 - F.col("composite_score")) * 10_000_000).cast("bigint"), F.lit(1 << 40))
    ranked = dense_index(s.filter(~F.col("is_reference")).withColumn("_key", key), [title], "_key", ["ord"],
                         name="rank", width=10_000, start=1).drop("_key")
    return ranked.unionByName(s.filter("is_reference").withColumn("rank", F.lit(None).cast("bigint")))


def benchmark_summary(runs: DataFrame, title: str = "media") -> DataFrame:
    return runs.groupBy(title).agg(F.count(F.lit(1)).alias("run_count"), F.min("wer").alias("best_wer"),
                                   F.max("bleu").alias("best_bleu"), F.max("chrf").alias("best_chrf"))


def config_leaderboard(runs: DataFrame) -> DataFrame:
    """Best successful run per configuration, most similar first, the best one recommended.

    Configurations are names of job settings: one row each after the aggregation.
    """
    best = (runs.filter("success").groupBy("config").agg(F.max("similarity").alias("similarity"),
                                                         F.count(F.lit(1)).alias("runs")))
    top = best.agg(F.max(F.struct(F.col("similarity"), F.col("config"))).alias("_t"))
    first = best.join(F.broadcast(top.select(F.col("_t.similarity").alias("_s"))))
    ties = first.filter(F.col("similarity") == F.col("_s")).agg(F.min("config").alias("_best"))
    return (best.join(F.broadcast(ties)).withColumn("recommended", F.col("config") == F.col("_best"))
            .drop("_best").orderBy(F.desc("similarity"), "config"))


def score_candidate(c: DataFrame, keys) -> DataFrame:
    """Score 0..100 with grade and factors.

    Needs: strategy, segment_count, has_qc, cue_count, error_count, asr_warning_count,
    ocr_warning_count, qc_status, tqc_warning_count, tqc_fail_count.
    """
    cues, err = F.col("cue_count"), F.col("error_count")
    rate = F.when(~F.col("has_qc"), 0.5).when(cues > 0, 1.0 - F.least(err / cues, F.lit(1.0))).otherwise(0.0)
    density = lambda n: F.when(F.col("has_qc") & (cues > 0), F.col(n) / cues).otherwise(0.0)
    asr_d, ocr_d = density("asr_warning_count"), density("ocr_warning_count")
    penalty = lambda d: F.bround(-F.least(d / 0.25, F.lit(1.0)) * 25, 2)
    base = lookup(F.col("strategy"), STRATEGY_BASE, 0)
    qc_part = F.bround(rate * 20, 2)
    yield_part = F.bround(F.least(F.col("segment_count") / 5, F.lit(1.0)) * 10, 2)
    bad = (F.col("qc_status") == "fail") | (F.col("tqc_fail_count") > 0)
    meh = (F.col("qc_status") == "warn") | (F.col("tqc_warning_count") > 0)
    trans = F.when(bad, -20.0).when(meh, -8.0).otherwise(0.0)
    asr_p = F.when(F.col("has_qc") & (F.col("asr_warning_count") > 0), penalty(asr_d)).otherwise(0.0)
    ocr_p = F.when(F.col("has_qc") & (F.col("ocr_warning_count") > 0), penalty(ocr_d)).otherwise(0.0)
    out = (c.withColumn("strategy_base", base).withColumn("qc_pass_rate", qc_part).withColumn("segment_yield", yield_part)
           .withColumn("asr_penalty", asr_p).withColumn("ocr_penalty", ocr_p).withColumn("translation_penalty", trans))
    total = F.col("strategy_base")
    for p in ("qc_pass_rate", "segment_yield", "asr_penalty", "ocr_penalty", "translation_penalty"):
        total = total + F.col(p)
    total = F.least(F.greatest(F.bround(total, 2), F.lit(0.0)), F.lit(100.0))
    grade = F.lit("F")
    for limit, letter in reversed(GRADES):
        grade = F.when(F.col("total_score") >= limit, letter).otherwise(grade)
    factor = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("double").alias("contribution"))
    return (out.withColumn("total_score", total).withColumn("grade", grade)
            .withColumn("asr_warning_density", F.bround(asr_d, 4)).withColumn("ocr_warning_density", F.bround(ocr_d, 4))
            .withColumn("factors", rules(
                (F.lit(True), factor("strategy_base", F.col("strategy_base"))),
                (F.lit(True), factor("qc_pass_rate", F.col("qc_pass_rate"))),
                (F.lit(True), factor("segment_yield", F.col("segment_yield"))),
                (F.col("asr_penalty") != 0, factor("asr_warning_density", F.col("asr_penalty"))),
                (F.col("ocr_penalty") != 0, factor("ocr_warning_density", F.col("ocr_penalty"))),
                (F.col("translation_penalty") != 0, factor("translation_qc_status", F.col("translation_penalty"))))))
