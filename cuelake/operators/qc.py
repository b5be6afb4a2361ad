"""Subtitle quality rules and their summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.functions.timecode import fixed, sec
from cuelake.ordered import chunk_of, neighbours

VIOLATION = "struct<type:string,severity:string,detail:string>"


@dataclass(frozen=True)
class QcLimits:
    min_duration_ms: int = 500
    max_duration_ms: int = 7000
    max_cps: int = 20
    max_line_chars: int = 42
    max_lines: int = 2
    min_cues: int = 1
    ocr_warn_below: float = 0.70


def violation(kind: str, severity: str, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), detail.alias("detail"))


def rules(*conditional: tuple[Column, Column]) -> Column:
    """Array of the findings whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, s) for c, s in conditional]))


def preview(line: Column, n: int = 30) -> Column:
    """The start of an over-long line in quotes, as shown in the finding."""
    head = F.concat(F.left(line, F.lit(n)), F.when(F.length(line) > n, "...").otherwise(""))
    head = F.replace(head, F.lit("\\"), F.lit("\\\\"))
    single, double = head.contains("'"), head.contains('"')
    quote = F.when(single & ~double, '"').otherwise("'")
    body = F.when(single & double, F.replace(head, F.lit("'"), F.lit("\\'"))).otherwise(head)
    return F.concat(quote, body, quote)


def _seconds(ms: int) -> str:
    return f"{ms / 1000:.1f}"


def cue_violations(cues: DataFrame, keys, limits: QcLimits = QcLimits()) -> DataFrame:
    """One row per violation of a cue: keys, cue_index, type, severity, detail.

    ``cues`` has a dense file position ``idx`` and the sequence number ``seq`` of the file.
    """
    keys = list(keys)
    L = limits
    c = neighbours(cues.select(*keys, "idx", "seq", "start_ms", "end_ms", "text"), keys, "idx", {
        "_ps": lambda w: F.lag("start_ms").over(w), "_pe": lambda w: F.lag("end_ms").over(w)})
    s, e, t = F.col("start_ms"), F.col("end_ms"), F.col("text")
    dur = e - s
    c = (c.withColumn("_plain", tx.strip_formatting(t))
         .withColumn("_lines", tx.display_lines(F.col("_plain")))
         .withColumn("_chars", F.length(F.replace("_plain", F.lit("\n"), F.lit("")))))
    chars = F.col("_chars")
    n_lines = F.size("_lines")
    main = rules(
        (s < F.col("_ps"), violation("out_of_order", "error", F.concat(
            F.lit("Cue starts at "), sec(s), F.lit("s, before previous cue start "), sec(F.col("_ps")), F.lit("s")))),
        (F.col("_pe") > s, violation("overlap", "error", F.concat(
            F.lit("Cue starts at "), sec(s), F.lit("s but previous cue ends at "), sec(F.col("_pe")),
            F.lit("s (overlap: "), sec(F.col("_pe") - s), F.lit("s)")))),
        (dur < L.min_duration_ms, violation("duration_too_short", "error", F.concat(
            F.lit("Duration "), sec(dur), F.lit(f"s < minimum {_seconds(L.min_duration_ms)}s")))),
        (dur > L.max_duration_ms, violation("duration_too_long", "error", F.concat(
            F.lit("Duration "), sec(dur), F.lit(f"s > maximum {_seconds(L.max_duration_ms)}s")))),
        ((dur > 0) & (chars > 0) & (chars * 1000 > dur * L.max_cps), violation("high_cps", "warning", F.concat(
            F.lit("Reading speed "), fixed(chars.cast("bigint") * 1000, dur, 1),
            F.lit(f" CPS > maximum {float(L.max_cps)} CPS")))),
        (t.rlike(tx.OVERRIDE_TAG), violation("formatting_artifact", "error", F.lit(
            "ASS/SSA override tag found in cue text"))),
        (t.rlike(tx.LITERAL_ESCAPE), violation("formatting_artifact", "error", F.lit(
            r"Literal ASS inline newline escape (\N, \n, \h) found in cue text"))),
        (t.rlike(tx.HTML_TAG), violation("formatting_artifact", "warning", F.lit("HTML tag found in cue text"))),
        (n_lines > L.max_lines, violation("too_many_lines", "warning", F.concat(
            F.lit("Cue has "), n_lines.cast("string"), F.lit(f" display lines (maximum: {L.max_lines})")))))
    long_lines = F.transform(
        F.filter("_lines", lambda x: F.length(x) > L.max_line_chars),
        lambda x: violation("line_too_long", "warning", F.concat(
            F.lit("Line has "), F.length(x).cast("string"),
            F.lit(f" characters (maximum: {L.max_line_chars}): "), preview(x))))
    return c.select(*keys, F.col("idx").alias("pos"), F.col("seq").alias("cue_index"),
                    F.inline(F.concat(main, long_lines)))


def file_violations(tracks: DataFrame, cues: DataFrame, keys, limits: QcLimits = QcLimits()) -> DataFrame:
    """Track-level findings: nothing parsed, or too few cues.

    Where ``tracks`` have ``error`` (see ``sources.listed``), a file that could not be read is told as such.
    """
    keys = list(keys)
    error = F.col("error") if "error" in tracks.columns else F.lit(None).cast("string")
    n = cues.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    t = tracks.groupBy(*keys).agg(F.max(error).alias("_error")).join(n, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    unread = F.concat(F.lit("Cannot read SRT file: "), F.col("_error"))
    found = rules(
        (F.col("_n") == 0, violation("parse_failed", "error", F.coalesce(
            unread, F.lit("SRT file contains no parseable cue blocks")))),
        ((F.col("_n") > 0) & (F.col("_n") < limits.min_cues), violation("too_few_cues", "error", F.concat(
            F.lit("Found "), F.col("_n").cast("string"), F.lit(f" cue(s); expected at least {limits.min_cues}")))))
    none = F.lit(-1).cast("bigint")
    return t.select(*keys, none.alias("pos"), none.alias("cue_index"), F.inline(found))


def subtitle_qc(tracks: DataFrame, cues: DataFrame, keys, limits: QcLimits = QcLimits()) -> DataFrame:
    return file_violations(tracks, cues, keys, limits).unionByName(cue_violations(cues, keys, limits))


def qc_summary(tracks: DataFrame, cues: DataFrame, violations: DataFrame, keys) -> DataFrame:
    """Counts per track; a clean track keeps its row (A10)."""
    keys = list(keys)
    n = cues.groupBy(*keys).agg(F.count(F.lit(1)).alias("cue_count"))
    v = violations.groupBy(*keys).agg(F.count_if(F.col("severity") == "error").alias("error_count"),
                                      F.count_if(F.col("severity") == "warning").alias("warning_count"))
    out = tracks.select(*keys).distinct().join(n, keys, "left").join(v, keys, "left")
    out = out.fillna(0, ["cue_count", "error_count", "warning_count"])
    ok = F.col("cue_count") > 0
    return out.withColumn("parsed_ok", ok).withColumn("pass_qc", ok & (F.col("error_count") == 0))


VIOLATION_TYPES = ("parse_failed", "too_few_cues", "out_of_order", "overlap", "duration_too_short",
                   "duration_too_long", "high_cps", "formatting_artifact", "too_many_lines", "line_too_long")


def violation_counts(violations: DataFrame, keys, types=VIOLATION_TYPES) -> DataFrame:
    """Counts per type as columns, and formatting marks by severity."""
    aggs = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types]
    fmt = F.col("type") == "formatting_artifact"
    aggs += [F.count_if(fmt & (F.col("severity") == "error")).alias("n_formatting_error"),
             F.count_if(fmt & (F.col("severity") == "warning")).alias("n_formatting_warning")]
    return violations.groupBy(*keys).agg(*aggs)


# Marker lists of the translation heuristics.
ADULT_SOURCE_MARKERS = (
    "セックス", "チン", "まんこ", "乳首", "フェラ", "中出し", "挿入", "勃起", "射精", "オナニー",
    "エロ", "犯す", "やる")
ADULT_TARGET_MARKERS = (
    "fuck", "fucking", "sex", "cock", "dick", "pussy", "cum", "blowjob", "masturbat", "penis",
    "vagina", "horny", "nipple")
LOW_CONFIDENCE_MARKERS = (
    "[low_confidence]", "[uncertain]", "[inaudible]", "not sure", "unclear", "can't hear",
    "couldn't hear", "???")
HIGH_RISK_MARKERS = (
    "未成年", "児童", "子供", "少女", "少年", "同意なし", "無理やり", "強姦", "レイプ", "minor",
    "underage", "child", "without consent", "non-consensual", "coerc", "forced", "rape")


def translation_heuristics(cues: DataFrame, keys, profile: str = "default",
                           flag_low_confidence: bool | None = None,
                           flag_high_risk: bool | None = None) -> DataFrame:
    """Signs of a failed translation in ``text`` against ``source_text`` (R2)."""
    adult = profile == "live_action_adult"
    low = adult if flag_low_confidence is None else flag_low_confidence
    risk = adult if flag_high_risk is None else flag_high_risk
    # Columns of their own, as each rule reads them: a text is stripped once, not once a marker.
    c = cues.select(*keys, "idx", tx.strip(F.coalesce("source_text", F.lit(""))).alias("_src"), tx.strip(F.col("text")).alias("_out"))
    src, out = F.col("_src"), F.col("_out")
    both = (src != "") & (out != "")
    ns, no = F.length(src).cast("bigint"), F.length(out).cast("bigint")
    ratio = fixed(no, F.greatest(ns, F.lit(1)), 2)
    found = [
        ((out != "") & tx.has_cjk(out), violation("translation_possible_untranslated", "warning", F.lit(
            "Output still contains CJK characters; translation may have failed"))),
        (both & (ns >= 10) & (no * 10 < ns * 3), violation("translation_possible_omission", "warning", F.concat(
            F.lit("Translated cue is much shorter than source (ratio="), ratio, F.lit("); possible omission")))),
        (both & (ns <= 8) & (no >= 40) & (no * 10 > ns * 35), violation(
            "translation_possible_added_meaning", "warning", F.concat(
                F.lit("Translated cue is much longer than source (ratio="), ratio, F.lit("); possible added meaning"))))]
    if adult:
        explicit = F.lit(False)
        for m in ADULT_SOURCE_MARKERS:
            explicit = explicit | src.contains(m)
        found.append((both & explicit & ~tx.contains_any(out, ADULT_TARGET_MARKERS), violation(
            "translation_possible_softened_adult_dialogue", "warning", F.lit(
                "Live-action/adult profile source appears explicit, but translation may be softened or euphemized"))))
    if low:
        found.append((both & tx.contains_any(out, LOW_CONFIDENCE_MARKERS), violation(
            "translation_low_confidence_flagged", "warning", F.lit(
                "Translation line is flagged as uncertain and should be reviewed"))))
    if risk:
        found.append((both & tx.contains_any(F.concat_ws("\n", src, out), HIGH_RISK_MARKERS), violation(
            "translation_high_risk_content_review", "warning", F.lit(
                "Potential minor/coercion/illegal-content indicator detected; manual safety review required"))))
    return c.select(*keys, (F.col("idx") + 1).alias("cue_index"), F.inline(rules(*found)))


def asr_ocr_passthrough(cues: DataFrame, keys, limits: QcLimits = QcLimits(),
                        source_warnings: DataFrame | None = None) -> DataFrame:
    """Upstream warnings as violations.

    ``asr_warnings`` is an array of (type, severity, detail); ``has_ocr`` says whether the
    cue carries an OCR confidence at all (one that is not a number counts as 0).
    """
    keys = list(keys)
    asr = F.transform(F.coalesce("asr_warnings", F.array().cast(f"array<{VIOLATION}>")), lambda x: violation(
        "asr_low_confidence", "warning", F.concat(
            F.lit("ASR warning "), F.coalesce(x["type"], F.lit("unknown")), F.lit(": "),
            F.coalesce(x["detail"], F.lit("low confidence source segment")))))
    conf = F.coalesce(F.col("ocr_confidence").try_cast("double"), F.lit(0.0))
    pct = F.round(conf * 100).cast("bigint")
    ocr = rules((F.col("has_ocr") & (conf < limits.ocr_warn_below), violation(
        "ocr_low_confidence", "warning", F.concat(
            F.lit("OCR confidence "), fixed(pct, F.lit(100), 2),
            F.lit(f" is below threshold {limits.ocr_warn_below:.2f}")))))
    out = cues.select(*keys, (F.col("idx") + 1).alias("cue_index"), F.inline(F.concat(asr, ocr)))
    if source_warnings is not None:
        out = out.unionByName(source_warnings.select(
            *keys, F.lit(-1).cast("bigint").alias("cue_index"), F.lit("asr_source_warning").alias("type"),
            F.lit("warning").alias("severity"),
            F.coalesce("detail", F.lit("ASR source selection warning")).alias("detail")))
    return out


def subtitle_status() -> Column:
    """pass, warn or fail from the columns of :func:`qc_summary`."""
    return (F.when(~F.col("parsed_ok") | (F.col("error_count") > 0), "fail")
            .when(F.col("warning_count") > 0, "warn").otherwise("pass"))


def status_rank(c: Column) -> Column:
    return F.when(c == "pass", 0).when(c == "warn", 1).otherwise(2)


def worst_status(*statuses: Column) -> Column:
    """The worst of several statuses."""
    rank = F.greatest(*[status_rank(s) for s in statuses])
    return F.when(rank == 0, "pass").when(rank == 1, "warn").otherwise("fail")


def qc_sidecar(summary: DataFrame, violations: DataFrame, keys, translation: DataFrame | None = None,
               part_cues: int = 65_536) -> DataFrame:
    """JSON documents per track with its findings and worst status.

    A track's findings are split into parts of ``part_cues`` cue positions, so a huge track
    becomes several documents instead of one group that must fit in memory. Part 0 always
    exists.
    """
    keys = list(keys)
    s = summary.withColumn("subtitle_status", subtitle_status())
    if translation is not None:
        s = s.join(translation.select(*keys, "qc_status"), keys, "left")
    else:
        s = s.withColumn("qc_status", F.lit(None).cast("string"))
    s = s.withColumn("overall_qc_status", worst_status(F.col("subtitle_status"), F.coalesce("qc_status", F.lit("pass"))))
    parts = (violations.withColumn("part", F.greatest(F.lit(0), chunk_of(F.col("pos"), part_cues)))
             .groupBy(*keys, "part").agg(F.array_sort(F.collect_list(
                 F.struct("cue_index", "type", "severity", "detail"))).alias("violations")))
    first = s.select(*keys, F.lit(0).cast("bigint").alias("part"))
    grid = first.unionByName(parts.select(*keys, "part")).distinct()
    j = grid.join(parts, [*keys, "part"], "left").join(s, keys)
    return j.select(*keys, "part", "overall_qc_status", F.to_json(F.struct(
        F.lit(2).alias("schema_version"),
        F.struct("parsed_ok", "cue_count", "error_count", "warning_count", "pass_qc",
                 F.coalesce("violations", F.array()).alias("violations")).alias("subtitle_qc"),
        F.col("qc_status").alias("translation_qc_status"), F.col("overall_qc_status"))).alias("doc"))
