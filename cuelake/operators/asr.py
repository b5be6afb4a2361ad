"""Speech and OCR confidence rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.operators.qc import rules, violation
from cuelake.ordered import neighbours


@dataclass(frozen=True)
class AsrLimits:
    no_speech_above: float = 0.60
    logprob_below: float = -1.00
    compression_above: float = 2.40
    min_ms: int = 250
    max_ms: int = 12_000
    gap_ms: int = 6_000
    repeats: int = 3
    japanese_below: float = 0.20
    fail_ratio: float = 0.50


def with_repeats(cues: DataFrame, keys, name: str = "repeats") -> DataFrame:
    """How often the cue's normalised text occurs in its track.

    Counted by a grouped sum and joined back; adaptive execution splits the join where one
    text makes up a large part of the rows.
    """
    keys = list(keys)
    c = cues.withColumn("_norm", tx.collapse_ws(F.lower("text")))
    n = c.filter("_norm <> ''").groupBy(*keys, "_norm").agg(F.count(F.lit(1)).alias(name))
    return c.join(n, [*keys, "_norm"], "left").withColumn(name, F.coalesce(name, F.lit(0))).drop("_norm")


def asr_cue_warnings(cues: DataFrame, keys, language: str = "ja", limits: AsrLimits = AsrLimits()) -> DataFrame:
    """Add ``warnings`` (array of type, severity, detail) to each speech cue."""
    L, keys = limits, list(keys)
    c = with_repeats(cues, keys)
    c = neighbours(c, keys, "idx", {"_pe": lambda w: F.lag("end_ms").over(w)})
    dur, gap = F.col("end_ms") - F.col("start_ms"), F.col("start_ms") - F.col("_pe")
    ja, dense = tx.japanese_share(tx.strip(F.col("text")))
    w = lambda kind: violation(kind, "warning", F.lit(kind.replace("_", " ")))
    found = [
        (F.col("no_speech_prob") > L.no_speech_above, w("high_no_speech_probability")),
        (F.col("avg_logprob") < L.logprob_below, w("low_average_log_probability")),
        (F.col("compression_ratio") > L.compression_above, w("high_compression_ratio")),
        (dur < L.min_ms, w("very_short_segment")), (dur > L.max_ms, w("very_long_segment")),
        (gap > L.gap_ms, w("long_gap_before_segment")), (F.col("repeats") >= L.repeats, w("repeated_text"))]
    if language.startswith("ja"):
        found.append(((F.length(tx.strip(F.col("text"))) >= 3) & (F.when(dense > 0, ja / dense).otherwise(0.0) < L.japanese_below),
                      w("low_japanese_character_ratio")))
    return c.withColumn("warnings", rules(*found)).drop("_pe")


def asr_quality(tracks: DataFrame, warned: DataFrame, keys, limits: AsrLimits = AsrLimits()) -> DataFrame:
    """Share of low-confidence cues and status per track; a track without cues fails."""
    keys = list(keys)
    a = warned.groupBy(*keys).agg(F.count(F.lit(1)).alias("segment_count"),
                                  F.count_if(F.size("warnings") > 0).alias("low_confidence_segment_count"),
                                  F.sum(F.size("warnings")).alias("warning_count"))
    j = tracks.select(*keys).distinct().join(a, keys, "left").fillna(
        0, ["segment_count", "low_confidence_segment_count", "warning_count"])
    n, low = F.col("segment_count"), F.col("low_confidence_segment_count")
    return j.select(*keys, "segment_count", "low_confidence_segment_count",
                    F.when(n > 0, F.bround(low / n, 4)).otherwise(1.0).alias("low_confidence_ratio"),
                    F.when(n > 0, F.col("warning_count")).otherwise(1).alias("warning_count"),
                    F.when((n == 0) | (low >= n * limits.fail_ratio), "fail").when(low > 0, "warn").otherwise("clean").alias("status"))


def ocr_quality(cues: DataFrame, keys, threshold: float = 0.70) -> DataFrame:
    """Mean OCR confidence and share below the threshold; anything unreadable counts as 0."""
    conf = F.coalesce(F.col("ocr_confidence").try_cast("double"), F.lit(0.0))
    n, low = F.count(F.lit(1)), F.count_if(conf < threshold)
    return cues.groupBy(*keys).agg(n.alias("segment_count"), F.bround(F.sum(F.round(conf * 10_000).cast("bigint")) / 10_000 / n, 4)
                                   .alias("average_confidence"), low.alias("low_confidence_segment_count"),
                                   F.bround(low / n, 4).alias("low_confidence_ratio"))
