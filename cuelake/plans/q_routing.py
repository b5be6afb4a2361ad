"""Queries on catalogues, source choice, scores, scorecards and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import qc, routing, scoring, selection
from cuelake.plans import views as v
from cuelake.plans.q_qc import Q_QC, qc_tables
from cuelake.plans.registry import REG
from cuelake.sources import catalog

K = v.TRACK


def media(spark, d):
    return catalog.parse_catalog(v.media_json(spark, d))


@REG.query(f"""WITH {v.Q_MEDIA} SELECT s.media, s.ord, s.idx AS index, s.kind, s.codec, s.channels, s.language, s.raw_language, s.is_bitmap,
  CASE WHEN s.media % 9 <> 0 THEN CAST(s.media % 5000 AS DOUBLE) END AS duration FROM v_str s""")
def read_media_catalog(spark, d):
    return catalog.explode_streams(media(spark, d)).select("media", "ord", "index", "kind", "codec", "channels", "language",
                                                           "raw_language", "is_bitmap", "duration")


@REG.query(f"""WITH {v.Q_MEDIA} SELECT media, ord, idx AS index, coalesce(language, raw_language, 'und') AS detected_language FROM v_str
  WHERE kind = 'subtitle' AND coalesce(language, raw_language, 'und') IN ('en', 'ja', 'spa') AND NOT is_bitmap""")
def filter_tracks(spark, d):
    s = catalog.explode_streams(media(spark, d))
    return catalog.filter_tracks(s, "subtitle", ["en", "ja", "SPA"]).select("media", "ord", "index", "detected_language")


@REG.query(f"""WITH {v.Q_MEDIA} SELECT media, idx AS index, CASE WHEN lower(raw_language) IN ('jpn', 'ja-jp') THEN 'ja'
  WHEN lower(raw_language) IN ('eng', 'en-au') THEN 'en' WHEN lower(raw_language) = 'spa' THEN 'es' ELSE raw_language END AS language FROM v_str""")
def normalize_language(spark, d):
    s = catalog.explode_streams(media(spark, d))
    return s.select("media", "index", catalog.normalize_language(F.col("raw_language")).alias("language"))


_L = "coalesce(language, raw_language)"
_EN, _JA = f"{_L} IN ('en', 'en-au')", f"{_L} IN ('ja', 'ja-jp')"
Q_SRC = v.Q_MEDIA + f""",
s_wide AS (SELECT o.o_orderkey AS media,
    min(idx) FILTER (kind = 'subtitle' AND NOT is_bitmap AND {_EN}) AS en_sub, min(idx) FILTER (kind = 'subtitle' AND NOT is_bitmap AND {_JA}) AS ja_sub,
    min(idx) FILTER (kind = 'subtitle' AND is_bitmap AND {_EN}) AS en_bitmap, min(idx) FILTER (kind = 'subtitle' AND is_bitmap AND {_JA}) AS ja_bitmap,
    min(ord) FILTER (kind = 'audio' AND {_EN}) AS en_audio, min(ord) FILTER (kind = 'audio' AND {_JA}) AS ja_audio,
    count(*) FILTER (kind = 'audio') AS n_audio,
    min(ord) FILTER (kind = 'audio' AND title IS NOT NULL) AS by_title, min(ord) FILTER (kind = 'audio' AND channels = 2) AS stereo,
    CASE WHEN o.o_orderkey % 10 = 3 THEN 'm' || o.o_orderkey || '.en.srt' END AS en_sidecar,
    CASE WHEN o.o_orderkey % 15 = 4 THEN 'm' || o.o_orderkey || '.ja.ass' END AS ja_sidecar
  FROM orders o LEFT JOIN v_str s ON s.media = o.o_orderkey GROUP BY o.o_orderkey),
s_all AS (SELECT *, CASE WHEN n_audio > 0 THEN coalesce(by_title, stereo, 0) END AS untagged_audio,
    CASE WHEN n_audio > 0 THEN CASE WHEN by_title IS NOT NULL THEN 'title' WHEN stereo IS NOT NULL THEN 'stereo' ELSE 'default' END END AS untagged_reason
  FROM s_wide),
s_probe AS (SELECT *, ja_audio IS NULL AND n_audio > 0 AND media % 4 <> 3 AND (media % 20) / 20.0 + 0.5 >= 0.85 AS sure,
    CASE WHEN media % 3 = 0 THEN 'ja' WHEN media % 3 = 1 THEN 'en' ELSE 'fr' END AS pl FROM s_all),
s_re AS (SELECT * EXCLUDE (ja_audio, en_audio), CASE WHEN sure AND pl IN ('ja', 'en') THEN pl END AS probed,
    CASE WHEN sure AND pl = 'ja' THEN coalesce(en_audio, untagged_audio) ELSE ja_audio END AS ja_audio,
    CASE WHEN sure AND pl = 'ja' AND en_audio IS NOT NULL THEN NULL WHEN sure AND pl = 'en' AND en_audio IS NULL THEN untagged_audio ELSE en_audio END AS en_audio,
    CASE WHEN ja_audio IS NULL AND en_audio IS NOT NULL AND media % 4 = 3 THEN 'language_probe_failed' END AS source_warning FROM s_probe),
s_strat AS (SELECT *, CASE WHEN en_sidecar IS NOT NULL THEN 'sidecar_en' WHEN en_sub IS NOT NULL THEN 'embedded_en' WHEN en_bitmap IS NOT NULL THEN 'bitmap_en_ocr'
    WHEN ja_sidecar IS NOT NULL THEN 'sidecar_jp_mt' WHEN ja_sub IS NOT NULL THEN 'embedded_jp_mt' WHEN ja_bitmap IS NOT NULL THEN 'bitmap_jp_ocr_mt'
    WHEN ja_audio IS NOT NULL THEN 'ja_audio_asr_mt' WHEN en_audio IS NOT NULL THEN 'en_audio_asr' WHEN n_audio > 0 THEN 'untagged_audio_asr_mt' END AS strategy FROM s_re)"""


def sidecars(spark, d):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("m"), k.cast("string"), F.when(k % 10 == 3, ".en.srt"))
    name2 = F.concat(F.lit("m"), k.cast("string"), F.when(k % 15 == 4, ".ja.ass"))
    row = lambda n, lang: F.when(n.isNotNull(), F.struct(n.alias("name"), F.lit(lang).alias("language")))
    return v.table(spark, d, "orders").select(k.alias("media"), F.inline(F.array_compact(F.array(row(name, "en"), row(name2, "ja"))))).withColumn(
        "ord", F.lit(0))


def sources(spark, d):
    return selection.detect_sources(media(spark, d), sidecars(spark, d))


def chosen(spark, d):
    o = F.col("o_orderkey")
    probes = v.table(spark, d, "orders").select(
        o.alias("media"), F.when(o % 3 == 0, "ja").when(o % 3 == 1, "en").otherwise("fr").alias("probe_language"),
        (o % 20 / 20.0 + 0.5).alias("probe_confidence"), (o % 4 == 3).alias("probe_failed"))
    return selection.select_strategy(selection.reroute_by_probe(sources(spark, d), probes))


_SRC = "media, en_sub, ja_sub, en_bitmap, ja_bitmap, en_audio, ja_audio, untagged_audio, untagged_reason, en_sidecar, ja_sidecar"


@REG.query(f"WITH {Q_SRC} SELECT {_SRC} FROM s_all")
def first_matching_stream(spark, d):
    return sources(spark, d).select(*_SRC.split(", "))


@REG.query(f"WITH {Q_SRC} SELECT media, en_audio, ja_audio, probed, source_warning FROM s_re")
def reroute_by_probe(spark, d):
    return chosen(spark, d).select("media", "en_audio", "ja_audio", "probed", "source_warning")


@REG.query(f"WITH {Q_SRC} SELECT media, strategy, strategy IS NULL AS failed FROM s_strat")
def select_strategy(spark, d):
    return chosen(spark, d).select("media", "strategy", F.col("error").isNotNull().alias("failed"))


_TIER = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in scoring.STRATEGY_TIER.items())
Q_REP = Q_SRC + ", s_rep AS (" + " UNION ALL ".join(
    f"SELECT media, strategy AS selected_source, '{n}' AS source, {c} IS NOT NULL AS detected, CASE WHEN {c} IS NULL THEN 'not_available' "
    f"WHEN strategy = '{n}' THEN 'selected' ELSE 'skipped' END AS status, '{label}:' || {c} AS stream, CASE WHEN {c} IS NULL THEN 'not detected' "
    f"WHEN strategy = '{n}' THEN 'selected' ELSE 'Lower priority than selected source (' || strategy || ')' END AS reason FROM s_strat WHERE strategy IS NOT NULL"
    + (f" AND strategy = '{n}'" if n.startswith("untagged") else "") for n, c, label in selection.SOURCE_COLUMNS) + ")"


_REVIEW = ", ".join(f"'{x}'" for x in scoring.REVIEW_STRATEGIES)


@REG.query(f"""WITH {Q_REP} SELECT *, CASE selected_source {_TIER} END AS confidence_tier, selected_source IN ({_REVIEW}) AS review_recommended,
  CASE WHEN selected_source IN ({_REVIEW}) THEN '{selection.REVIEW_REASON}' END AS review_reason FROM s_rep""")
def selection_report(spark, d):
    return selection.selection_report(chosen(spark, d)).select("media", "selected_source", "source", "detected", "status", "stream", "reason", "confidence_tier",
                                                               "review_recommended", "review_reason")


def _override(spark, d, **settings):
    s = selection.select_strategy(sources(spark, d), **settings)
    return selection.selection_report(s, **settings).select("media", "selected_source", "source", "status", "reason")


_PICK = ("CASE WHEN en_audio IS NOT NULL THEN 'en_audio_asr' WHEN ja_sidecar IS NOT NULL THEN 'sidecar_jp_mt' WHEN ja_sub IS NOT NULL THEN 'embedded_jp_mt' "
         "WHEN n_audio > 0 THEN 'untagged_audio_asr_mt' END")


def _why(n: str) -> str:
    if n in ("sidecar_en", "embedded_en"):
        return "'prefer_subtitles=False in config'"
    if n.startswith("bitmap"):
        return "'OCR backend not configured'"
    other = "'prefer_audio_language=''en'' in config'" if n == "ja_audio_asr_mt" else "'Lower priority than selected source (' || strategy || ')'"
    return f"CASE WHEN strategy = '{n}' THEN 'selected' ELSE {other} END"


Q_OVER = Q_SRC + f""",
o_pick AS (SELECT *, {_PICK} AS strategy FROM s_all), o_rep AS (""" + " UNION ALL ".join(
    f"SELECT media, strategy AS selected_source, '{n}' AS source, CASE WHEN {c} IS NULL THEN 'not_available' WHEN strategy = '{n}' THEN 'selected' ELSE 'skipped' END AS status, "
    f"CASE WHEN {c} IS NULL THEN 'not detected' ELSE {_why(n)} END AS reason FROM o_pick WHERE strategy IS NOT NULL"
    + (f" AND strategy = '{n}'" if n.startswith("untagged") else "") for n, c, _ in selection.SOURCE_COLUMNS) + ")"


@REG.query(f"WITH {Q_OVER} SELECT * FROM o_rep")
def selection_overrides(spark, d):
    """The report where settings turn subtitles and OCR off and ask for English speech."""
    return _override(spark, d, prefer_subtitles=False, prefer_audio="en", ocr=False)


# --- candidate tables made of orders: title = customer ----------------------------------

Q_CANDS = """
k_cand AS (SELECT o_custkey AS media, o_orderkey AS ord, o_orderstatus || '_' || o_orderkey AS candidate_id, o_orderpriority AS source FROM orders),
k_ref AS (SELECT media, arg_min(candidate_id, struct_pack(p := CASE WHEN contains(candidate_id, 'F_') THEN 0 WHEN contains(candidate_id, 'O_') THEN 1 ELSE 2 END, o := ord)) AS reference_id
  FROM k_cand GROUP BY media),
k_comp AS (SELECT c.media, r.reference_id AS ref_id, c.candidate_id AS cand_id, c.ord,
    CASE WHEN c.ord % 13 <> 0 THEN (c.ord * 37 % 10000) / 10000.0 END AS wer, (c.ord * 91 % 10000) / 100.0 AS bleu, (c.ord * 53 % 10000) / 100.0 AS chrf
  FROM k_cand c JOIN k_ref r USING (media) WHERE c.candidate_id <> r.reference_id)"""


def cands(spark, d):
    return v.table(spark, d, "orders").select(F.col("o_custkey").alias("media"), F.col("o_orderkey").alias("ord"),
                                              F.concat_ws("_", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("candidate_id"),
                                              F.col("o_orderpriority").alias("source"))


def refs(spark, d):
    return scoring.select_reference(cands(spark, d), ["F_", "O_"])


def comparisons(spark, d):
    c = cands(spark, d)
    p = scoring.ref_vs_all(c, refs(spark, d)).join(c.select("media", F.col("candidate_id").alias("cand_id"), "ord"), ["media", "cand_id"])
    o = F.col("ord")
    return (p.withColumn("wer", F.when(o % 13 != 0, (o * 37 % 10000) / 10000.0)).withColumn("bleu", (o * 91 % 10000) / 100.0)
            .withColumn("chrf", (o * 53 % 10000) / 100.0))


@REG.query(f"WITH {Q_CANDS} SELECT * FROM k_ref")
def first_by_priority(spark, d):
    return refs(spark, d)


@REG.query(f"WITH {Q_CANDS} SELECT media, ref_id, cand_id FROM k_comp")
def ref_vs_all(spark, d):
    return scoring.ref_vs_all(cands(spark, d), refs(spark, d))


@REG.query(f"""WITH {Q_CANDS} SELECT a.media, a.candidate_id AS ref_id, b.candidate_id AS cand_id FROM k_cand a JOIN k_cand b ON a.media = b.media AND a.ord < b.ord
  WHERE a.media IN (SELECT media FROM k_cand GROUP BY media HAVING count(*) > 2)""")
def all_pairs(spark, d):
    return scoring.all_pairs(cands(spark, d))


@REG.query(f"WITH {Q_CANDS} SELECT media, count(*) AS candidates, CASE WHEN count(*) = 1 THEN 'single_candidate_only' ELSE 'ok' END AS status FROM k_cand GROUP BY ALL")
def single_candidate_flag(spark, d):
    return scoring.single_candidate(cands(spark, d)).drop("warning")


Q_CARD = Q_CANDS + """,
k_card AS (SELECT c.media, c.ord, c.candidate_id, c.source, c.candidate_id = r.reference_id AS is_reference, p.wer, CASE WHEN p.ord IS NOT NULL THEN p.bleu END AS bleu, p.chrf,
    coalesce(0.5 * (1 - p.wer) + 0.25 * p.bleu / 100 + 0.25 * p.chrf / 100, CASE WHEN c.candidate_id = r.reference_id THEN 1.0 END) AS composite
  FROM k_cand c JOIN k_ref r USING (media) LEFT JOIN k_comp p ON p.media = c.media AND p.cand_id = c.candidate_id),
k_rank AS (SELECT *, CASE WHEN NOT is_reference THEN row_number() OVER (PARTITION BY media, is_reference
    ORDER BY round(composite * 10000000) DESC NULLS LAST, ord) END AS rank FROM k_card)"""


@REG.query(f"WITH {Q_CARD} SELECT media, candidate_id, is_reference, wer, bleu, chrf, round(composite, 6) AS composite_score, rank FROM k_rank")
def rank_scorecards(spark, d):
    s = scoring.scorecards(cands(spark, d), comparisons(spark, d), refs(spark, d))
    return s.select("media", "candidate_id", "is_reference", "wer", "bleu", "chrf", F.round("composite_score", 6).alias("composite_score"), "rank")


@REG.query(f"""WITH {Q_CANDS} SELECT media, cand_id, CASE WHEN wer * 100 <= 20 THEN 'good' WHEN wer * 100 >= 60 THEN 'bad' ELSE 'neutral' END AS wer_band,
  CASE WHEN bleu >= 60 THEN 'good' WHEN bleu < 25 THEN 'bad' ELSE 'neutral' END AS bleu_band,
  CASE WHEN chrf >= 70 THEN 'good' WHEN chrf < 35 THEN 'bad' ELSE 'neutral' END AS chrf_band FROM k_comp""")
def metric_band(spark, d):
    b = scoring.metric_bands()
    return comparisons(spark, d).withColumn("source", F.lit("x")).select("media", "cand_id", *[b[n].alias(n) for n in ("wer_band", "bleu_band", "chrf_band")])


@REG.query(f"WITH {Q_CANDS} SELECT media, count(*) AS run_count, min(wer) AS best_wer, max(bleu) AS best_bleu, max(chrf) AS best_chrf FROM k_comp GROUP BY ALL")
def benchmark_summary(spark, d):
    return scoring.benchmark_summary(comparisons(spark, d))


@REG.query(f"WITH {Q_CANDS} SELECT media, ref_id, cand_id FROM k_comp WHERE wer IS NOT NULL AND (wer > 0.45 OR bleu < 25 OR chrf < 45)")
def weak_comparisons(spark, d):
    return routing.weak_comparisons(comparisons(spark, d)).select("media", "ref_id", "cand_id")


Q_BR = Q_CANDS + """,
b_tax AS (SELECT DISTINCT o_custkey AS media, CASE o_orderkey % 40 WHEN 0 THEN 'wrong_meaning' ELSE 'bad_name' END AS code FROM orders WHERE o_orderkey % 20 = 0),
b_t AS (SELECT t.media, t.n, coalesce(c.n, 0) AS comparison_count, coalesce(c.w, 0) AS weak_count, coalesce(x.codes, []) AS codes
  FROM (SELECT media, count(*) AS n FROM k_cand GROUP BY media) t
  LEFT JOIN (SELECT media, count(*) AS n, count(*) FILTER (wer IS NOT NULL AND (wer > 0.45 OR bleu < 25 OR chrf < 45)) AS w FROM k_comp GROUP BY media) c USING (media)
  LEFT JOIN (SELECT media, list_sort(list(code)) AS codes FROM b_tax GROUP BY media) x USING (media))"""


@REG.query(f"""WITH {Q_BR} SELECT media, comparison_count, weak_count, CASE WHEN weak_count >= 2 OR len(codes) > 0 THEN 'review_required'
    WHEN n = 1 OR comparison_count = 0 OR weak_count > 0 THEN 'warning' ELSE 'ok' END AS status,
  concat_ws(',', CASE WHEN n = 1 THEN 'benchmark.single_candidate_only' END, CASE WHEN comparison_count = 0 THEN 'benchmark.no_comparisons' END,
    CASE WHEN weak_count >= 2 THEN 'benchmark.quality_below_threshold' WHEN weak_count > 0 THEN 'benchmark.quality_borderline' END,
    CASE WHEN len(codes) > 0 THEN array_to_string(codes, ',') END) AS reason_codes FROM b_t""")
def route_benchmark(spark, d):
    o = v.table(spark, d, "orders")
    tax = o.filter(F.col("o_orderkey") % 20 == 0).select(F.col("o_custkey").alias("media"), F.when(
        F.col("o_orderkey") % 40 == 0, "wrong_meaning").otherwise("bad_name").alias("code"), F.lit(1).alias("count"))
    titles = cands(spark, d).groupBy("media").agg(F.count(F.lit(1)).alias("candidates"))
    out = routing.route_benchmark(titles, comparisons(spark, d), tax, min_weak=2)
    return out.withColumn("reason_codes", F.array_join("reason_codes", ","))


@REG.query("""WITH r AS (SELECT event_type AS config, value AS similarity FROM events WHERE event_id % 3 <> 0),
  b AS (SELECT config, max(similarity) AS similarity, count(*) AS runs FROM r GROUP BY ALL)
  SELECT *, config = (SELECT min(config) FROM b WHERE similarity = (SELECT max(similarity) FROM b)) AS recommended FROM b""")
def config_leaderboard(spark, d):
    return scoring.config_leaderboard(v.table(spark, d, "events").select(
        F.col("event_type").alias("config"), F.col("value").alias("similarity"), (F.col("event_id") % 3 != 0).alias("success")))


# --- scores and routes over the quality results -----------------------------------------

_STR = list(scoring.STRATEGY_BASE)
_BASE = " ".join(f"WHEN {i} THEN {scoring.STRATEGY_BASE[s]}" for i, s in enumerate(_STR))
Q_SCORE = Q_QC + f""",
r_in AS (SELECT s.*, media % 9 AS strat, CASE media % 9 {_BASE} END AS base, media % 4 AS asr_n, media % 5 AS ocr_n,
    CASE media % 7 WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS qc_status FROM q_summary s),
r_parts AS (SELECT *, round_even((1.0 - least(error_count / cue_count, 1.0)) * 20, 2) AS qp, round_even(least(cue_count / 5, 1.0) * 10, 2) AS yp,
    CASE WHEN asr_n > 0 THEN round_even(-least(asr_n / cue_count / 0.25, 1.0) * 25, 2) ELSE 0 END AS ap,
    CASE WHEN ocr_n > 0 THEN round_even(-least(ocr_n / cue_count / 0.25, 1.0) * 25, 2) ELSE 0 END AS op,
    CASE qc_status WHEN 'fail' THEN -20 WHEN 'warn' THEN -8 ELSE 0 END AS tp FROM r_in),
r_score AS (SELECT *, least(greatest(round_even(base + qp + yp + ap + op + tp, 2), 0), 100) AS total_score FROM r_parts),
r_grade AS (SELECT *, CASE WHEN total_score >= 80 THEN 'A' WHEN total_score >= 60 THEN 'B' WHEN total_score >= 40 THEN 'C' WHEN total_score >= 20 THEN 'D' ELSE 'F' END AS grade,
    round_even(asr_n / cue_count, 4) AS ad, round_even(ocr_n / cue_count, 4) AS od, strat IN (4, 5, 6, 7, 8) AS rev FROM r_score),
r_route AS (SELECT *, total_score < 20 OR qc_status = 'fail' AS rej,
    total_score < 60 OR rev OR ad >= 0.1 OR od >= 0.3 OR qc_status = 'warn' AS rvw FROM r_grade)"""


def scored(spark, d):
    t, c, viol = qc_tables(spark, d)
    s = qc.qc_summary(t, c, viol, K)
    m = F.col("media")
    strat = F.get(F.array(*[F.lit(x) for x in _STR]), (m % 9).cast("int"))
    s = (s.withColumn("strategy", strat).withColumn("segment_count", F.col("cue_count")).withColumn("has_qc", F.lit(True))
         .withColumn("asr_warning_count", m % 4).withColumn("ocr_warning_count", m % 5)
         .withColumn("qc_status", F.when(m % 7 == 0, "fail").when(m % 7 == 1, "warn").otherwise("pass"))
         .withColumn("tqc_fail_count", F.when(m % 7 == 0, 1).otherwise(0)).withColumn("tqc_warning_count", F.when(m % 7 == 1, 1).otherwise(0)))
    out = scoring.score_candidate(s, K)
    return viol, out.withColumn("review_recommended", F.col("strategy").isin(*scoring.REVIEW_STRATEGIES))


@REG.query(f"WITH {Q_SCORE} SELECT media, cand, total_score, grade, ad AS asr_warning_density, od AS ocr_warning_density FROM r_grade")
def score_candidate(spark, d):
    return scored(spark, d)[1].select(*K, "total_score", "grade", "asr_warning_density", "ocr_warning_density")


@REG.query(f"""WITH {Q_SCORE} SELECT * FROM (SELECT media, cand, unnest(['strategy_base', 'qc_pass_rate', 'segment_yield', 'asr_warning_density', 'ocr_warning_density', 'translation_qc_status']) AS name,
  unnest([CAST(base AS DOUBLE), qp, yp, CASE WHEN ap <> 0 THEN ap END, CASE WHEN op <> 0 THEN op END, CASE WHEN tp <> 0 THEN tp END]) AS contribution FROM r_score) WHERE contribution IS NOT NULL""")
def score_factors(spark, d):
    return scored(spark, d)[1].select(*K, F.inline("factors"))


@REG.query(f"""WITH {Q_SCORE} SELECT media, cand, CASE WHEN rej THEN 'reject' WHEN rvw THEN 'review' ELSE 'pass' END AS decision,
  concat_ws(',', CASE WHEN total_score < 20 THEN 'score_below_reject_threshold' END, CASE WHEN qc_status = 'fail' THEN 'translation_qc_fail' END,
    CASE WHEN NOT rej AND total_score < 60 THEN 'score_below_review_threshold' END, CASE WHEN NOT rej AND ad >= 0.1 THEN 'asr_warning_density' END,
    CASE WHEN NOT rej AND od >= 0.3 THEN 'ocr_warning_density' END, CASE WHEN NOT rej AND rev THEN 'review_recommended' END,
    CASE WHEN NOT rej AND qc_status = 'warn' THEN 'translation_qc_warn' END) AS triggered_by FROM r_route""")
def route_policy(spark, d):
    return routing.route_policy(scored(spark, d)[1]).select(*K, "decision", F.array_join("triggered_by", ",").alias("triggered_by"))


Q_GEN = Q_SCORE + """,
g_n AS (SELECT media, cand, count(*) FILTER (type = 'overlap') AS ov, count(*) FILTER (type = 'out_of_order') AS oo,
    count(*) FILTER (type LIKE 'duration%') AS du, count(*) FILTER (type = 'high_cps') AS cps,
    count(*) FILTER (type IN ('line_too_long', 'too_many_lines')) AS rd,
    count(*) FILTER (type = 'formatting_artifact' AND severity = 'error') AS fe, count(*) FILTER (type = 'formatting_artifact' AND severity = 'warning') AS fw
  FROM q_viol GROUP BY ALL),
g_all AS (SELECT r.*, coalesce(ov, 0) AS ov, coalesce(oo, 0) AS oo, coalesce(du, 0) AS du, coalesce(cps, 0) AS cps, coalesce(rd, 0) AS rd, coalesce(fe, 0) AS fe,
    coalesce(fw, 0) AS fw, (media % 10) / 10.0 AS rate, media % 7 = 0 AS hf, CASE WHEN media % 6 = 0 THEN 'bad_name' END AS code
  FROM r_route r LEFT JOIN g_n USING (media, cand))"""


@REG.query(f"""WITH {Q_GEN} SELECT media, cand, CASE WHEN rej OR hf THEN 'failed' WHEN rvw OR rev OR ov > 0 OR oo > 0 OR du >= 2 OR cps >= 3 OR rd >= 3 OR fe > 0 OR rate >= 0.35 OR code IS NOT NULL
    THEN 'review_required' WHEN du > 0 OR cps > 0 OR rd > 0 OR fw > 0 THEN 'warning' ELSE 'ok' END AS status,
  concat_ws(',', CASE WHEN rej THEN 'generate.policy_reject' WHEN rvw THEN 'generate.policy_review' END, CASE WHEN rev THEN 'generate.low_confidence_strategy' END,
    CASE WHEN ov > 0 THEN 'generate.timing_overlap' END, CASE WHEN oo > 0 THEN 'generate.timing_out_of_order' END,
    CASE WHEN du >= 2 THEN 'generate.duration_violations_repeated' WHEN du > 0 THEN 'generate.duration_violations_minor' END,
    CASE WHEN cps >= 3 THEN 'generate.high_cps_repeated' WHEN cps > 0 THEN 'generate.high_cps_minor' END,
    CASE WHEN rd >= 3 THEN 'generate.readability_violations_repeated' WHEN rd > 0 THEN 'generate.readability_violations_minor' END,
    CASE WHEN fe > 0 THEN 'generate.formatting_artifact_unresolved' WHEN fw > 0 THEN 'generate.formatting_artifact_warning' END,
    CASE WHEN rate >= 0.35 THEN 'generate.high_polish_change_rate' END, code) AS reason_codes FROM g_all""")
def route_generate(spark, d):
    viol, s = scored(spark, d)
    r = routing.route_policy(s).join(qc.violation_counts(viol, K), K, "left")
    m = F.col("media")
    r = (r.withColumn("polish_change_rate", m % 10 / 10.0).withColumn("has_fail", m % 7 == 0)
         .withColumn("finding_codes", F.when(m % 6 == 0, F.array(F.lit("bad_name"))).otherwise(F.array().cast("array<string>"))))
    return routing.route_generate(r).select(*K, "status", F.array_join("reason_codes", ",").alias("reason_codes"))


@REG.query("""SELECT conv_id AS media, string_agg(role, ',' ORDER BY o) AS codes FROM (SELECT conv_id, role, min(turn) AS o FROM conversations GROUP BY ALL) GROUP BY ALL""")
def distinct_codes_in_order(spark, d):
    c = v.table(spark, d, "conversations").select(F.col("conv_id").alias("media"), F.col("turn").alias("ord"), F.col("role").alias("code"))
    return routing.codes_in_order(c, ["media"]).withColumn("codes", F.array_join("codes", ","))


@REG.query(f"""WITH {Q_SCORE} SELECT media, cand, CASE WHEN qc_status = 'fail' OR error_count > 0 THEN 'fail' WHEN qc_status = 'warn' OR warning_count > 0 THEN 'warn' ELSE 'pass' END AS overall FROM r_in""")
def overall_status(spark, d):
    return scored(spark, d)[1].select(*K, qc.worst_status(qc.subtitle_status(), F.col("qc_status")).alias("overall"))
