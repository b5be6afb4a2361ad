"""Choosing a source per title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators.scoring import REVIEW_STRATEGIES, STRATEGY_TIER, lookup
from cuelake.sources.catalog import lang_matches

# Title words that hint at Japanese audio, and the probe confidence needed.
JAPANESE_TITLE = ("japanese", "japan", "jpn", "ja", "日本語")
PROBE_CONFIDENCE = 0.85
REVIEW_REASON = "MT pipeline output (machine translation); manual review recommended for accuracy"


def _first(items: Column, cond) -> Column:
    """Position of the first element that fits, from 0; NULL when none does."""
    at = F.array_position(F.transform(items, cond), True)
    return F.when(at > 0, at - 1)


def detect_sources(media: DataFrame, sidecars: DataFrame | None = None, source: str = "ja", target: str = "en") -> DataFrame:
    """First fitting stream per kind and language, and the fallback audio track.

    Streams of a title are one array, so this is row-local. ``sidecars``: media, ord, name,
    language.
    """
    lang = lambda s: F.coalesce(s["language"], s["raw_language"])
    subs = F.filter("streams", lambda s: s["kind"] == "subtitle")
    audio = F.filter("streams", lambda s: s["kind"] == "audio")
    m = media.withColumn("_subs", subs).withColumn("_audio", audio)

    def sub(target_lang, bitmap):
        at = _first(F.col("_subs"), lambda s: (s["is_bitmap"] == bitmap) & lang_matches(lang(s), target_lang))
        return F.get(F.col("_subs"), at.cast("int"))["index"]

    def spoken(code):
        return _first(F.col("_audio"), lambda s: lang_matches(lang(s), code))

    for who, code in (("en", target), ("ja", source)):
        m = (m.withColumn(f"{who}_sub", sub(code, False)).withColumn(f"{who}_bitmap", sub(code, True))
             .withColumn(f"{who}_audio", spoken(code)))
    title = lambda s: F.lower(F.trim(F.coalesce(s["title"], F.lit(""))))
    word = lambda s: F.exists(F.array(*[F.lit(w) for w in JAPANESE_TITLE]), lambda w: title(s).contains(w))
    by_title, stereo = _first(F.col("_audio"), word), _first(F.col("_audio"), lambda s: s["channels"] == 2)
    m = (m.withColumn("n_audio", F.size("_audio").cast("bigint"))
         .withColumn("untagged_audio", F.when(F.col("n_audio") > 0, F.coalesce(by_title, stereo, F.lit(0).cast("bigint"))))
         .withColumn("untagged_reason", F.when(F.col("n_audio") > 0, F.when(by_title.isNotNull(), "title").when(
             stereo.isNotNull(), "stereo").otherwise("default"))).drop("_subs", "_audio"))
    if sidecars is None:
        return m.withColumn("en_sidecar", F.lit(None).cast("string")).withColumn("ja_sidecar", F.lit(None).cast("string"))
    pick = lambda code: F.min_by(F.when(lang_matches(F.col("language"), code), F.col("name")),
                                 F.when(lang_matches(F.col("language"), code), F.col("ord")))
    s = sidecars.groupBy("media").agg(pick(target).alias("en_sidecar"), pick(source).alias("ja_sidecar"))
    return m.join(s, "media", "left")


def reroute_by_probe(sources: DataFrame, probes: DataFrame) -> DataFrame:
    """Let a confident language probe override the tags.

    ``probes``: media, probe_language, probe_confidence, probe_failed. A probe matters where
    no Japanese track is tagged; a failed one keeps the tag and leaves a warning.
    """
    j = sources.join(probes, "media", "left")
    applies = F.col("ja_audio").isNull() & (F.col("n_audio") > 0)
    tagged = F.col("en_audio").isNotNull()
    sure = applies & ~F.coalesce("probe_failed", F.lit(False)) & (F.col("probe_confidence") >= PROBE_CONFIDENCE)
    seen = F.when(sure, F.col("probe_language"))
    ja = F.coalesce(seen == "ja", F.lit(False))
    en = F.coalesce(seen == "en", F.lit(False))
    return (j.withColumn("probed", F.when(ja | en, seen))
            .withColumn("_ja", F.when(ja & tagged, F.col("en_audio")).when(ja, F.col("untagged_audio")).otherwise(F.col("ja_audio")))
            .withColumn("_en", F.when(ja & tagged, None).when(en & ~tagged, F.col("untagged_audio")).otherwise(F.col("en_audio")))
            .withColumn("source_warning", F.when(applies & tagged & F.coalesce("probe_failed", F.lit(False)), "language_probe_failed"))
            .withColumn("ja_audio", F.col("_ja")).withColumn("en_audio", F.col("_en"))
            .drop("_ja", "_en", "probe_language", "probe_confidence", "probe_failed"))


def select_strategy(sources: DataFrame, prefer_subtitles: bool = True, prefer_audio: str = "auto", ocr: bool = True,
                    skip_embedded_en: bool = False) -> DataFrame:
    """The first usable source in order of preference; ``error`` where there is none."""
    has = lambda c: F.col(c).isNotNull()
    direct = F.lit(prefer_subtitles and not skip_embedded_en)
    strategy = (F.when(direct & has("en_sidecar"), "sidecar_en").when(direct & has("en_sub"), "embedded_en")
                .when(F.lit(prefer_subtitles and ocr) & has("en_bitmap"), "bitmap_en_ocr")
                .when(F.lit(prefer_audio == "en") & has("en_audio"), "en_audio_asr")
                .when(has("ja_sidecar"), "sidecar_jp_mt").when(has("ja_sub"), "embedded_jp_mt")
                .when(F.lit(ocr) & has("ja_bitmap"), "bitmap_jp_ocr_mt")
                .when(F.lit(prefer_audio in ("ja", "auto")) & has("ja_audio"), "ja_audio_asr_mt")
                .when(has("en_audio"), "en_audio_asr").when(F.col("n_audio") > 0, "untagged_audio_asr_mt"))
    return sources.withColumn("strategy", strategy).withColumn("error", F.when(strategy.isNull(), F.lit(
        "No usable source found for EN subtitle generation (file has no audio or subtitle streams)")))


SOURCE_COLUMNS = (("sidecar_en", "en_sidecar", "sidecar"), ("embedded_en", "en_sub", "sub"), ("bitmap_en_ocr", "en_bitmap", "sub"),
                  ("en_audio_asr", "en_audio", "audio"), ("sidecar_jp_mt", "ja_sidecar", "sidecar"), ("embedded_jp_mt", "ja_sub", "sub"),
                  ("bitmap_jp_ocr_mt", "ja_bitmap", "sub"), ("ja_audio_asr_mt", "ja_audio", "audio"),
                  ("untagged_audio_asr_mt", "untagged_audio", "audio"))


def selection_report(chosen: DataFrame, prefer_subtitles: bool = True, prefer_audio: str = "auto", ocr: bool = True,
                     skip_embedded_en: bool = False) -> DataFrame:
    """One row per title and source: detected, status and reason, tier and review flag."""
    entries = []
    for name, col, label in SOURCE_COLUMNS:
        det = F.col(col).isNotNull()
        won = F.col("strategy") == name
        lower = F.concat(F.lit("Lower priority than selected source ("), "strategy", F.lit(")"))
        reason = F.when(~det, "not detected").when(won, "selected").otherwise(lower)
        if name in ("sidecar_en", "embedded_en"):
            reason = (F.when(~det, "not detected").when(F.lit(skip_embedded_en), "skip_embedded_en override active")
                      .when(F.lit(not prefer_subtitles), "prefer_subtitles=False in config").when(won, "selected").otherwise(lower))
        elif name.startswith("bitmap"):
            reason = F.when(~det, "not detected").when(F.lit(not ocr), "OCR backend not configured").when(won, "selected").otherwise(lower)
        elif name == "ja_audio_asr_mt":
            reason = F.when(~det, "not detected").when(won, "selected").when(
                F.lit(prefer_audio == "en"), "prefer_audio_language='en' in config").otherwise(lower)
        status = F.when(~det, "not_available").when(won, "selected").otherwise("skipped")
        e = F.struct(F.lit(name).alias("source"), F.when(det, F.concat(F.lit(f"{label}:"), F.col(col).cast("string"))).alias("stream"),
                     det.alias("detected"), status.alias("status"), reason.alias("reason"))
        entries.append(F.when(won, e) if name == "untagged_audio_asr_mt" else e)
    review = F.col("strategy").isin(*REVIEW_STRATEGIES)
    return chosen.filter("strategy IS NOT NULL").select(
        "media", F.col("strategy").alias("selected_source"), lookup(F.col("strategy"), STRATEGY_TIER, "unknown").alias("confidence_tier"),
        review.alias("review_recommended"), F.when(review, REVIEW_REASON).alias("review_reason"),
        F.inline(F.array_compact(F.array(*entries))))
