"""Translation quality findings, their summary and taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.functions.taxonomy import normalize_code, normalize_severity
from cuelake.functions.timecode import fixed
from cuelake.operators.qc import rules
from cuelake.operators.terms import term_drift

# Register markers.
STRONG_SOURCE = ("セックス", "チン", "まんこ", "乳首", "フェラ", "中出し", "挿入", "勃起", "射精", "犯す")
STRONG_TARGET = ("sex", "fuck", "fucking", "cock", "dick", "pussy", "cum", "blowjob", "masturbat", "penetrat", "rape")
SOFT_TARGET = ("do that", "be together", "hook up", "get close", "intimate")


def finding(code: str, severity: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"))


def translation_findings(cues: DataFrame, keys, glossary: DataFrame | None = None) -> DataFrame:
    """Findings per cue from ``source_text``, ``literal_text`` and ``text``.

    Ratios are tested on integers, so the tier borders are exact.
    """
    keys = list(keys)
    blank = lambda c: tx.strip(F.coalesce(c, F.lit("")))
    c = (cues.select(*keys, "idx", blank("source_text").alias("source_text"), blank("literal_text").alias("literal_text"),
                     blank("text").alias("text")))
    c = c.withColumn("_base", F.when(F.col("literal_text") != "", F.col("literal_text")).otherwise(F.col("source_text")))
    c = c.withColumn("_miss", F.when((F.col("literal_text") != "") & (F.col("text") != ""),
                                     tx.missing_terms(F.col("literal_text"), F.col("text")))
                     .otherwise(F.array().cast("array<string>")))
    out, src, lit = F.col("text"), F.col("source_text"), F.col("literal_text")
    no, nb = F.length(out).cast("bigint"), F.length("_base").cast("bigint")
    has = (nb > 0) & (no > 0)
    r = fixed(no, F.greatest(nb, F.lit(1)), 2)
    fail_lo, warn_lo = no * 100 <= nb * 25, no * 100 <= nb * 45
    fail_hi, warn_hi = no * 100 >= nb * 280, no * 100 >= nb * 180
    strong = tx.contains_any(F.concat_ws("\n", src, lit), STRONG_SOURCE + STRONG_TARGET)
    # Few texts hold a soft marker, so the other lists are seldom looked through.
    soft = (no > 0) & tx.contains_any(out, SOFT_TARGET) & ~tx.contains_any(out, STRONG_TARGET) & strong
    miss = F.size("_miss")
    named = F.array_join(F.slice("_miss", 1, 3), ", ")
    msg = lambda a, z: F.concat(F.lit(a), r, F.lit(z))
    found = rules(
        (no == 0, finding("possible_omission", "fail", F.lit("Final subtitle line is empty"))),
        ((no > 0) & tx.has_cjk(out), finding("cjk_leakage", "warning", F.lit("Final subtitle contains CJK characters"))),
        (has & fail_lo, finding("possible_omission", "fail", msg("Final subtitle is much shorter than baseline (ratio=", ")"))),
        (has & ~fail_lo & warn_lo, finding("possible_omission", "warning", msg("Final subtitle may omit baseline meaning (ratio=", ")"))),
        (has & ~warn_lo & fail_hi, finding("added_meaning", "fail", msg("Final subtitle is much longer than baseline (ratio=", ")"))),
        (has & ~warn_lo & ~fail_hi & warn_hi, finding("added_meaning", "warning", msg("Final subtitle may add unsupported meaning (ratio=", ")"))),
        (miss >= 2, finding("wrong_meaning", "fail", F.concat(F.lit("Final subtitle dropped key terms: "), named))),
        (miss == 1, finding("wrong_meaning", "warning", F.concat(F.lit("Final subtitle may drift from literal terms: "), named))),
        (soft, finding("register_softened", "warning", F.lit("Final subtitle appears softer than source/literal register"))))
    rows = c.select(*keys, "idx", F.posexplode(found).alias("ord", "_f")).select(*keys, "idx", "ord", "_f.*")
    if glossary is not None:
        drift = term_drift(c, glossary, keys)
        rows = rows.unionByName(drift.select(*keys, "idx", F.lit(100).alias("ord"), "code", "severity", "message"))
    return rows


def merge_findings(findings: DataFrame, external: DataFrame, keys) -> DataFrame:
    """Add findings of an outside judge, with codes and severities made canonical."""
    code = normalize_code(F.coalesce("code", F.lit("llm_judge_review")))
    ext = external.select(*keys, "idx", F.lit(200).alias("ord"), code.alias("code"),
                          normalize_severity(code, F.coalesce("severity", F.lit("warning"))).alias("severity"),
                          F.coalesce("message", F.lit("LLM judge requested review")).alias("message"))
    return findings.unionByName(ext)


def cue_status(cues: DataFrame, findings: DataFrame, keys) -> DataFrame:
    """pass, warn or fail per cue, with the number of findings."""
    keys = list(keys)
    f = findings.groupBy(*keys, "idx").agg(F.count(F.lit(1)).alias("finding_count"),
                                           F.max(F.col("severity") == "fail").alias("_fail"))
    j = cues.select(*keys, "idx").join(f, [*keys, "idx"], "left")
    return j.select(*keys, "idx", F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
                    F.when(F.col("_fail"), "fail").when(F.col("finding_count") > 0, "warn").otherwise("pass").alias("status"))


def translation_qc_summary(tracks: DataFrame, findings: DataFrame, keys) -> DataFrame:
    """Score and status per track."""
    keys = list(keys)
    n = findings.groupBy(*keys).agg(F.count_if(F.col("severity") == "warning").alias("warning_count"),
                                    F.count_if(F.col("severity") == "fail").alias("fail_count"))
    j = tracks.select(*keys).distinct().join(n, keys, "left").fillna(0, ["warning_count", "fail_count"])
    cents = F.greatest(F.lit(0), F.lit(100) - F.col("warning_count") * 8 - F.col("fail_count") * 20)
    j = j.withColumn("score", (cents / 100).cast("double"))
    return j.withColumn("qc_status", F.when((F.col("fail_count") > 0) | (cents < 55), "fail")
                        .when((F.col("warning_count") > 0) | (cents < 80), "warn").otherwise("pass"))


def failure_taxonomy(findings: DataFrame, keys=()) -> DataFrame:
    """Counts by code, by severity and in total, in one pass over the findings."""
    keys = list(keys)
    f = findings.select(*keys, normalize_code(F.col("code")).alias("code"),
                        normalize_severity(F.col("code"), F.col("severity")).alias("severity"))
    per = f.groupBy(*keys, "code", "severity").agg(F.count(F.lit(1)).alias("n"))
    sets = [[*keys, "code"], [*keys, "severity"], list(keys)]
    return per.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, "code", "severity"]]).agg(
        F.sum("n").alias("count"))
