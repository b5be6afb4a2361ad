"""Routing decisions from counts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS = ("ok", "warning", "review_required", "failed")


def listed(*conditional: tuple[Column, str]) -> Column:
    """Codes whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(s)) for c, s in conditional]))


def worst(*conditional: tuple[Column, int]) -> Column:
    rank = F.greatest(F.lit(0), *[F.when(c, r).otherwise(0) for c, r in conditional])
    return F.element_at(F.array(*[F.lit(s) for s in STATUS]), rank + 1)


def route_policy(c: DataFrame, review_below: float = 60, reject_below: float = 20, asr_density: float = 0.10,
                 ocr_density: float = 0.30, warn_min: int = 1, fail_min: int = 1) -> DataFrame:
    """pass, review or reject with the triggers that led there.

    Needs: total_score, asr_warning_density, ocr_warning_density, qc_status,
    tqc_warning_count, tqc_fail_count, review_recommended.
    """
    low, mid = F.col("total_score") < reject_below, F.col("total_score") < review_below
    t_fail = (F.col("qc_status") == "fail") & (F.col("tqc_fail_count") >= fail_min)
    t_warn = (F.col("qc_status") == "warn") & (F.col("tqc_warning_count") >= warn_min)
    asr, ocr = F.col("asr_warning_density") >= asr_density, F.col("ocr_warning_density") >= ocr_density
    reject = low | t_fail
    review = mid | F.col("review_recommended") | asr | ocr | t_warn
    r = lambda cond: ~reject & cond
    triggers = listed(
        (low, "score_below_reject_threshold"), (t_fail, "translation_qc_fail"), (r(mid), "score_below_review_threshold"),
        (r(asr), "asr_warning_density"), (r(ocr), "ocr_warning_density"), (r(F.col("review_recommended")), "review_recommended"),
        (r(t_warn), "translation_qc_warn"))
    return (c.withColumn("decision", F.when(reject, "reject").when(review, "review").otherwise("pass"))
            .withColumn("triggered_by", triggers))


def route_generate(c: DataFrame, cps_min: int = 3, duration_min: int = 2, readability_min: int = 3,
                   change_rate_min: float = 0.35) -> DataFrame:
    """ok, warning, review_required or failed for a generated track, with reason codes.

    Needs the columns of ``violation_counts`` and: parsed_ok, cue_count, decision,
    review_recommended, polish_change_rate, finding_codes (ordered array), has_fail.
    """
    n = lambda name: F.coalesce(F.col(f"n_{name}"), F.lit(0))
    dur = n("duration_too_short") + n("duration_too_long")
    read = n("line_too_long") + n("too_many_lines")
    cps, fe, fw = n("high_cps"), n("formatting_error"), n("formatting_warning")
    codes = F.coalesce("finding_codes", F.array().cast("array<string>"))
    rules = [
        (~F.col("parsed_ok") | (F.col("cue_count") <= 0), 3, "generate.invalid_or_zero_cues"),
        (F.col("decision") == "reject", 3, "generate.policy_reject"),
        (F.col("decision") == "review", 2, "generate.policy_review"),
        (F.col("review_recommended"), 2, "generate.low_confidence_strategy"),
        (n("overlap") > 0, 2, "generate.timing_overlap"),
        (n("out_of_order") > 0, 2, "generate.timing_out_of_order"),
        (dur >= duration_min, 2, "generate.duration_violations_repeated"),
        ((dur > 0) & (dur < duration_min), 1, "generate.duration_violations_minor"),
        (cps >= cps_min, 2, "generate.high_cps_repeated"),
        ((cps > 0) & (cps < cps_min), 1, "generate.high_cps_minor"),
        (read >= readability_min, 2, "generate.readability_violations_repeated"),
        ((read > 0) & (read < readability_min), 1, "generate.readability_violations_minor"),
        (fe > 0, 2, "generate.formatting_artifact_unresolved"),
        ((fe == 0) & (fw > 0), 1, "generate.formatting_artifact_warning"),
        (F.coalesce(F.col("polish_change_rate") >= change_rate_min, F.lit(False)), 2, "generate.high_polish_change_rate")]
    status = worst(*[(c_, r_) for c_, r_, _ in rules], (F.col("has_fail"), 3), (~F.col("has_fail") & (F.size(codes) > 0), 2))
    reasons = F.array_distinct(F.concat(listed(*[(c_, s_) for c_, _, s_ in rules]), codes))
    return (c.withColumn("status", status).withColumn("reason_codes", reasons)
            .withColumn("needs_task", F.col("status").isin("review_required", "failed")))


def weak_comparisons(comparisons: DataFrame, wer_max: float = 0.45, bleu_min: float = 25.0,
                     chrf_min: float = 45.0) -> DataFrame:
    """Comparisons below any floor; those without metrics are skipped."""
    return comparisons.filter(F.col("wer").isNotNull() & F.col("bleu").isNotNull() & F.col("chrf").isNotNull()).filter(
        (F.col("wer") > wer_max) | (F.col("bleu") < bleu_min) | (F.col("chrf") < chrf_min))


def route_benchmark(titles: DataFrame, comparisons: DataFrame, taxonomy: DataFrame, title: str = "media",
                    min_weak: int = 1) -> DataFrame:
    """Status and reasons per benchmarked title.

    ``titles``: title, candidates. ``taxonomy``: title, code, count. There are only as many
    codes as the taxonomy has, so collecting them per title is bounded.
    """
    weak = weak_comparisons(comparisons).groupBy(title).agg(F.count(F.lit(1)).alias("weak_count"))
    n = comparisons.groupBy(title).agg(F.count(F.lit(1)).alias("comparison_count"))
    tax = (taxonomy.filter("count > 0").groupBy(title, "code").agg(F.lit(1))
           .groupBy(title).agg(F.array_sort(F.collect_list("code")).alias("codes")))
    j = titles.join(n, title, "left").join(weak, title, "left").join(tax, title, "left").fillna(
        0, ["comparison_count", "weak_count"])
    codes = F.coalesce("codes", F.array().cast("array<string>"))
    w = F.col("weak_count")
    rules = [(F.col("candidates") == 1, 1, "benchmark.single_candidate_only"),
             (F.col("comparison_count") == 0, 1, "benchmark.no_comparisons"),
             (w >= min_weak, 2, "benchmark.quality_below_threshold"),
             ((w > 0) & (w < min_weak), 1, "benchmark.quality_borderline")]
    return j.select(
        title, "comparison_count", "weak_count",
        worst(*[(c, r) for c, r, _ in rules], (F.size(codes) > 0, 2)).alias("status"),
        F.concat(listed(*[(c, s) for c, _, s in rules]), codes).alias("reason_codes"))


def codes_in_order(findings: DataFrame, keys, order: str = "ord", code: str = "code") -> DataFrame:
    """Distinct codes per key in order of first sight (A25); bounded by the code list."""
    first = findings.groupBy(*keys, code).agg(F.min(order).alias("_o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", code))),
                                                lambda x: x[code]).alias("codes"))
