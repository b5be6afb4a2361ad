"""Queries on scalar functions, speech rules, translation findings and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.functions import timecode as tc
from cuelake.functions.taxonomy import normalize_code, normalize_severity
from cuelake.operators import align as al
from cuelake.operators import asr, guards, terms, transqc
from cuelake.ordered import dense_index
from cuelake.plans import views as v
from cuelake.plans.q_align import Q_FULL, zipped
from cuelake.plans.registry import REG

K = v.TRACK


@REG.query(f"""WITH {v.Q_LINES} SELECT media, idx, trim(regexp_replace(trim(regexp_replace(lower(line), '\\s+', ' ', 'g')),
  '[^\\p{{L}}\\p{{N}}_ ]', '', 'g')) AS norm FROM v_lines""")
def normalize_for_compare(spark, d):
    return v.lines(spark, d).select("media", "idx", tx.normalize_for_compare(F.col("line")).alias("norm"))


@REG.query(f"""WITH {v.Q_CUES} SELECT media, idx, lpad(CAST(start_ms // 3600000 AS VARCHAR), 2, '0') || ':' ||
  lpad(CAST(start_ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0')
  || ',' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') AS stamp, start_ms AS ms FROM v_cues""")
def srt_timecodes(spark, d):
    c = v.cues(spark, d).select("media", "idx", tc.ms_to_srt(F.col("start_ms")).alias("stamp"))
    return c.withColumn("ms", tc.srt_to_ms(F.col("stamp")))


@REG.query(f"""WITH {v.Q_CUES}, p AS (SELECT media, idx, {v.sql_strip(r"regexp_replace(regexp_replace(regexp_replace(text, '\{[^}]*\}', '', 'g'), '\\[nNh]', ' ', 'g'), '<[^>]+>', '', 'g')")} AS plain,
  end_ms - start_ms AS dur FROM v_cues)
  SELECT media, idx, plain, CASE WHEN dur > 0 AND length(replace(plain, chr(10), '')) > 0
    THEN length(replace(plain, chr(10), '')) * 1000.0 / dur END AS cps FROM p""")
def chars_per_second(spark, d):
    c = v.cues(spark, d).withColumn("plain", tx.strip_formatting(F.col("text")))
    n, dur = F.length(F.replace("plain", F.lit("\n"), F.lit(""))), F.col("end_ms") - F.col("start_ms")
    return c.select("media", "idx", "plain", F.when((dur > 0) & (n > 0), n * F.lit(1000.0).cast("double") / dur).alias("cps"))


_CJKX = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
_POLX = r"[\x{2e80}-\x{2eff}\x{3000}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}\x{ff00}-\x{ffef}]"
_PACX = r"[\x{3000}-\x{303f}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}]+"


@REG.query(f"""WITH {v.Q_CUES}, m AS (SELECT media, idx, text, regexp_matches(text, '{_POLX}') AS has,
    length(regexp_extract(text, '(?s)^(.*?){_POLX}', 1)) AS pos,
    {v.sql_strip(f"regexp_extract(text, '(?s)^(.*?){_POLX}', 1)")} AS lead FROM v_cues)
  SELECT media, idx, has AS has_cjk,
    CASE WHEN {v.sql_strip(f"regexp_replace(text, '{_PACX}', '', 'g')")} = '' THEN text
      ELSE {v.sql_strip(f"regexp_replace(text, '{_PACX}', '', 'g')")} END AS stripped,
    CASE WHEN has AND lead <> '' AND pos >= length(text) * 0.4 AND len(regexp_split_to_array(lead, '\\s+')) >= 2
      AND (regexp_matches(lead, '[.!?…]$') OR len(regexp_split_to_array(lead, '\\s+')) >= 4) THEN lead END AS prefix
  FROM m""")
def cjk_cleanup(spark, d):
    t = F.col("text")
    return v.cues(spark, d).select("media", "idx", tx.has_cjk(t, "polish").alias("has_cjk"), tx.strip_cjk(t).alias("stripped"),
                                   tx.recover_prefix(t).alias("prefix"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_TOK = "[A-Za-z][A-Za-z''\\-]{2,}"
_KEY = (f"list_transform(list_filter(regexp_extract_all(literal_text, '{_TOK}'), lambda w: NOT list_contains([{_STOP}], lower(w)) "
        "AND (regexp_matches(w, '^[A-Z]') OR length(w) >= 5)), lambda w: lower(w))")


@REG.query(f"""WITH {v.Q_TRANS} SELECT media, idx, array_to_string({_KEY}, ' ') AS keywords,
  array_to_string(list_filter({_KEY}, lambda k: NOT list_contains(list_transform(regexp_extract_all(text, '{_TOK}'),
    lambda w: lower(w)), k)), ' ') AS missing FROM v_trans""")
def keywords_and_missing_terms(spark, d):
    c = v.translation_cues(spark, d).withColumn("_m", tx.missing_terms(F.col("literal_text"), F.col("text")))
    return c.select("media", "idx", F.array_join(tx.keywords(F.col("literal_text")), " ").alias("keywords"),
                    F.array_join("_m", " ").alias("missing"))


_WRAP = """list_reduce(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> ''), lambda a, w: CASE
    WHEN a.used > 0 AND a.used + 1 + length(w) <= 42 THEN {'out': a.out || ' ' || w, 'used': a.used + 1 + length(w)}
    ELSE {'out': a.out || CASE WHEN a.used = 0 THEN '' ELSE chr(10) END || w, 'used': length(w)} END, {'out': '', 'used': 0::BIGINT}).out"""


@REG.query(f"""WITH {v.Q_LINES} SELECT media, idx, CASE WHEN length(line) <= 42 THEN line ELSE {_WRAP} END AS wrapped,
  array_to_string({v.sql_pieces('line')}, '|') AS pieces FROM v_lines""")
def wrap_and_split(spark, d):
    c = v.lines(spark, d)
    return c.select("media", "idx", tx.wrap_lines(F.col("line")).alias("wrapped"),
                    F.array_join(tx.split_by_punctuation(F.col("line")), "|").alias("pieces"))


# --- speech ----------------------------------------------------------------------------

def asr_cues(spark, d):
    return dense_index(v.asr_segments(spark, d), K, "start_ms", ["ord"], width=86_400_000)


Q_ASR = v.Q_ASR + """,
a_win AS (
  SELECT *, row_number() OVER w - 1 AS idx, lag(end_ms) OVER w AS pe,
    count(*) OVER (PARTITION BY media, cand, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS repeats
  FROM v_asr WINDOW w AS (PARTITION BY media, cand ORDER BY start_ms, ord)),
a_warn AS (
  SELECT media, cand, idx, repeats, concat_ws(',',
    CASE WHEN no_speech_prob > 0.6 THEN 'high_no_speech_probability' END,
    CASE WHEN avg_logprob < -1 THEN 'low_average_log_probability' END,
    CASE WHEN compression_ratio > 2.4 THEN 'high_compression_ratio' END,
    CASE WHEN end_ms - start_ms < 250 THEN 'very_short_segment' WHEN end_ms - start_ms > 12000 THEN 'very_long_segment' END,
    CASE WHEN start_ms - pe > 6000 THEN 'long_gap_before_segment' END,
    CASE WHEN repeats >= 3 THEN 'repeated_text' END) AS warnings FROM a_win)"""


@REG.query(f"WITH {Q_ASR} SELECT * FROM a_warn")
def asr_cue_warnings(spark, d):
    w = asr.asr_cue_warnings(asr_cues(spark, d), K, language="en")
    return w.select(*K, "idx", "repeats", F.array_join(F.transform("warnings", lambda x: x["type"]), ",").alias("warnings"))


@REG.query(f"""WITH {Q_ASR}, n AS (SELECT *, CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, ',')) END AS k FROM a_warn)
  SELECT media, cand, count(*) AS segment_count, count(*) FILTER (k > 0) AS low_confidence_segment_count,
    round_even(count(*) FILTER (k > 0) / count(*), 4) AS low_confidence_ratio, CAST(sum(k) AS BIGINT) AS warning_count,
    CASE WHEN count(*) FILTER (k > 0) >= count(*) * 0.5 THEN 'fail' WHEN count(*) FILTER (k > 0) > 0 THEN 'warn' ELSE 'clean' END AS status
  FROM n GROUP BY ALL""")
def asr_quality(spark, d):
    c = asr_cues(spark, d)
    return asr.asr_quality(c.select(*K), asr.asr_cue_warnings(c, K, language="en"), K)


@REG.query(f"""WITH {v.Q_ASR}, c AS (SELECT media, cand, coalesce(ocr_confidence, 0) AS x FROM v_asr)
  SELECT media, cand, count(*) AS segment_count,
    round_even(CAST(sum(CAST(round(x * 10000) AS BIGINT)) AS BIGINT) / 10000 / count(*), 4) AS average_confidence,
    count(*) FILTER (x < 0.7) AS low_confidence_segment_count, round_even(count(*) FILTER (x < 0.7) / count(*), 4) AS low_confidence_ratio
  FROM c GROUP BY ALL""")
def ocr_quality(spark, d):
    return asr.ocr_quality(v.asr_segments(spark, d), K)


# --- glossary and translation findings -------------------------------------------------

GLOSSARY = [
    (1, 0, "term", "language", "先輩", "senior", "false"), (1, 1, "term", "language", "学園祭", "school festival", None),
    (1, 2, "name", "language", "太郎", "Taro", "true"), (1, 3, "honorific", "language", "先輩", "senpai", "true"),
    (2, 0, "term", "domain", "先輩", "senpai", "true"), (2, 1, "term", "domain", "tion", "TION", "yes"),
    (2, 2, "term", "domain", "and", "et", None), (2, 3, "name", "domain", "The", "the", "true"),
    (2, 4, "term", "domain", "ing", "-ing", "on"),
    # Ties of kind, need and length, first seen against their spelling, more than a cue may show.
    (2, 5, "term", "domain", "th", "TH", "on"), (2, 6, "term", "domain", "re", "RE", "on"), (2, 7, "term", "domain", "ti", "TI", "on"),
    (2, 8, "term", "domain", "on", "ON", "on"), (2, 9, "term", "domain", "ha", "HA", "on"), (2, 10, "term", "domain", "en", "EN", "on"),
    (3, 0, "term", "domain", "th", "Th", "on")]
_GROWS = ", ".join("(" + ", ".join("NULL" if x is None else (str(x) if isinstance(x, int) else f"'{x}'") for x in r) + ")" for r in GLOSSARY)
Q_GLOSS = f"""
g_raw(layer, ord, kind, scope, source, target, required) AS (VALUES {_GROWS}),
g_all AS (SELECT *, CASE lower(required) WHEN 'true' THEN true WHEN 'yes' THEN true WHEN 'on' THEN true
  WHEN 'false' THEN false ELSE kind <> 'term' END AS req FROM g_raw),
g_terms AS (SELECT kind, scope, source, target, req AS required, pos FROM (SELECT *, row_number() OVER (
  PARTITION BY kind, lower(source) ORDER BY layer DESC, ord DESC) AS rn, min(layer * 1000 + ord) OVER (PARTITION BY kind, lower(source)) AS pos
  FROM g_all) WHERE rn = 1)"""


def glossary(spark):
    return terms.glossary_entries(spark.createDataFrame(
        GLOSSARY, "layer int, ord int, kind string, scope string, source string, target string, required string"))


Q_MATCH = v.Q_TRANS + "," + Q_GLOSS + """,
g_hit AS (SELECT t.media, t.cand, t.idx, g.*, row_number() OVER (PARTITION BY t.media, t.idx ORDER BY required DESC,
    CASE kind WHEN 'name' THEN 0 WHEN 'honorific' THEN 1 ELSE 2 END, length(source) DESC, pos) AS rank
  FROM v_trans t JOIN g_terms g ON contains(t.source_text, g.source)),
g_drift AS (SELECT h.media, h.cand, h.idx, CASE h.kind WHEN 'name' THEN 'bad_name' WHEN 'honorific' THEN 'bad_honorific'
    ELSE 'wrong_meaning' END AS code, 'Required ' || h.kind || ' missing/changed: expected ''' || h.target ||
    ''' for source ''' || h.source || '''' AS message
  FROM g_hit h JOIN v_trans t USING (media, idx) WHERE h.required AND t.text <> '' AND NOT
    CASE WHEN regexp_matches(lower(h.target), '^[a-z0-9][a-z0-9 ''\\-]*$')
      THEN regexp_matches(lower(t.text), '(^|[^\\p{L}\\p{N}_])' || lower(h.target) || '($|[^\\p{L}\\p{N}_])')
      ELSE contains(lower(t.text), lower(h.target)) END)"""


@REG.query(f"WITH {Q_MATCH} SELECT media, cand, idx, kind, scope, source, target, required, rank FROM g_hit WHERE rank <= 6")
def glossary_match(spark, d):
    return terms.glossary_match(v.translation_cues(spark, d), glossary(spark), K, "source_text")


@REG.query(f"WITH {Q_MATCH} SELECT * FROM g_drift")
def term_drift(spark, d):
    return terms.term_drift(v.translation_cues(spark, d), glossary(spark), K).select(*K, "idx", "code", "message")


@REG.query(f"""WITH {v.Q_LINES},{Q_GLOSS} SELECT g.kind, g.scope, g.source, g.target, g.required, count(*) AS cues
  FROM g_terms g JOIN v_lines l ON contains(l.line, g.source) GROUP BY ALL""")
def glossary_precedence(spark, d):
    hits = terms.glossary_match(v.lines(spark, d), glossary(spark), ["media"], "line", max_terms=None)
    return hits.groupBy("kind", "scope", "source", "target", "required").agg(F.count(F.lit(1)).alias("cues"))


_LIKE = lambda col, ms: "(" + " OR ".join(f"contains({col}, '{m}')" for m in ms) + ")"
Q_FIND = Q_MATCH + f""",
f_b AS (SELECT *, CASE WHEN trim(literal_text) <> '' THEN trim(literal_text) ELSE trim(source_text) END AS base FROM v_trans),
f_c AS (SELECT *, trim(text) AS o, length(trim(text)) AS no, length(base) AS nb, list_filter({_KEY},
    lambda k: NOT list_contains(list_transform(regexp_extract_all(text, '{_TOK}'), lambda w: lower(w)), k)) AS lost, len(lost) AS miss,
    (no * 200 + greatest(nb, 1)) // (greatest(nb, 1) * 2) AS pct, '(ratio=' || (pct // 100) || '.' || lpad(CAST(pct % 100 AS VARCHAR), 2, '0') || ')' AS ratio,
    lower(source_text || chr(10) || literal_text) AS reg FROM f_b),
f_all AS (
  SELECT media, cand, idx, 'possible_omission' AS code, 'fail' AS severity, 'Final subtitle line is empty' AS message FROM f_c WHERE no = 0
  UNION ALL SELECT media, cand, idx, 'cjk_leakage', 'warning', 'Final subtitle contains CJK characters' FROM f_c WHERE regexp_matches(o, '{_CJKX}')
  UNION ALL SELECT media, cand, idx, CASE WHEN no <= nb * 0.45 THEN 'possible_omission' ELSE 'added_meaning' END,
    CASE WHEN no * 100 <= nb * 25 OR no * 100 >= nb * 280 THEN 'fail' ELSE 'warning' END,
    CASE WHEN no * 100 <= nb * 25 THEN 'Final subtitle is much shorter than baseline ' WHEN no * 100 <= nb * 45 THEN 'Final subtitle may omit baseline meaning '
      WHEN no * 100 >= nb * 280 THEN 'Final subtitle is much longer than baseline ' ELSE 'Final subtitle may add unsupported meaning ' END || ratio
  FROM f_c WHERE no > 0 AND nb > 0 AND (no * 100 <= nb * 45 OR no * 100 >= nb * 180)
  UNION ALL SELECT media, cand, idx, 'wrong_meaning', CASE WHEN miss >= 2 THEN 'fail' ELSE 'warning' END,
    CASE WHEN miss >= 2 THEN 'Final subtitle dropped key terms: ' ELSE 'Final subtitle may drift from literal terms: ' END || array_to_string(lost[1:3], ', ')
  FROM f_c WHERE no > 0 AND literal_text <> '' AND miss >= 1
  UNION ALL SELECT media, cand, idx, 'register_softened', 'warning', 'Final subtitle appears softer than source/literal register' FROM f_c
  WHERE no > 0 AND ({_LIKE('reg', transqc.STRONG_SOURCE)} OR {_LIKE('reg', transqc.STRONG_TARGET)})
    AND NOT {_LIKE('lower(o)', transqc.STRONG_TARGET)} AND {_LIKE('lower(o)', transqc.SOFT_TARGET)}
  UNION ALL SELECT media, cand, idx, code, 'warning', message FROM g_drift),
f_sum AS (SELECT t.media, t.cand, count(f.code) FILTER (f.severity = 'warning') AS warning_count,
    count(f.code) FILTER (f.severity = 'fail') AS fail_count
  FROM (SELECT DISTINCT media, cand FROM v_trans) t LEFT JOIN f_all f USING (media, cand) GROUP BY ALL)"""


def findings(spark, d):
    t = v.translation_cues(spark, d)
    return t, transqc.translation_findings(t, K, glossary(spark))


@REG.query(f"WITH {Q_FIND} SELECT * FROM f_all")
def translation_findings(spark, d):
    return findings(spark, d)[1].select(*K, "idx", "code", "severity", "message")


@REG.query(f"""WITH {Q_FIND} SELECT t.media, t.cand, t.idx, count(f.code) AS finding_count,
  CASE WHEN count(f.code) FILTER (f.severity = 'fail') > 0 THEN 'fail' WHEN count(f.code) > 0 THEN 'warn' ELSE 'pass' END AS status
  FROM v_trans t LEFT JOIN f_all f USING (media, cand, idx) GROUP BY ALL""")
def translation_cue_status(spark, d):
    return transqc.cue_status(*findings(spark, d), K)


@REG.query(f"""WITH {Q_FIND} SELECT media, cand, warning_count, fail_count,
  greatest(0, 100 - warning_count * 8 - fail_count * 20) / 100 AS score,
  CASE WHEN fail_count > 0 OR 100 - warning_count * 8 - fail_count * 20 < 55 THEN 'fail' WHEN warning_count > 0 THEN 'warn' ELSE 'pass' END AS qc_status
  FROM f_sum""")
def translation_qc_summary(spark, d):
    return transqc.translation_qc_summary(*findings(spark, d), K)


@REG.query(f"""WITH {Q_FIND} SELECT code, severity, count(*) AS count FROM f_all GROUP BY GROUPING SETS ((code), (severity), ())""")
def failure_taxonomy(spark, d):
    return transqc.failure_taxonomy(findings(spark, d)[1])


@REG.query("""WITH e AS (SELECT event_id AS media, CASE event_type WHEN 'click' THEN ' Missing_Final_Line' WHEN 'view' THEN 'hallucination'
    WHEN 'error' THEN 'llm_judge_review' WHEN 'purchase' THEN 'TOO_WORDY' ELSE event_type END AS code,
    CASE event_type WHEN 'click' THEN ' FAIL ' WHEN 'view' THEN 'bad' ELSE '' END AS severity FROM events)
  SELECT media, CASE lower(trim(code)) WHEN 'missing_final_line' THEN 'possible_omission' WHEN 'hallucination' THEN 'hallucination'
    WHEN 'too_wordy' THEN 'too_wordy' ELSE 'needs_human_review' END AS code,
    CASE WHEN lower(trim(severity)) = 'fail' OR code = 'hallucination' THEN 'fail' ELSE 'warning' END AS severity FROM e""")
def normalize_failure_code(spark, d):
    e = F.col("event_type")
    code = F.when(e == "click", " Missing_Final_Line").when(e == "view", "hallucination").when(
        e == "error", "llm_judge_review").when(e == "purchase", "TOO_WORDY").otherwise(e)
    sev = F.when(e == "click", " FAIL ").when(e == "view", "bad").otherwise("")
    return v.table(spark, d, "events").select(F.col("event_id").alias("media"), normalize_code(code).alias("code"),
                                              normalize_severity(code, sev).alias("severity"))


@REG.query(f"""WITH {Q_FIND}, x AS (SELECT * EXCLUDE (message) FROM f_all UNION ALL SELECT media, cand, idx, 'needs_human_review', 'warning'
    FROM v_trans WHERE (media + idx) % 8 = 0)
  SELECT t.media, t.cand, t.idx, count(f.code) AS finding_count, CASE WHEN count(f.code) FILTER (f.severity = 'fail') > 0 THEN 'fail'
    WHEN count(f.code) > 0 THEN 'warn' ELSE 'pass' END AS status FROM v_trans t LEFT JOIN x f USING (media, cand, idx) GROUP BY ALL""")
def merge_external_findings(spark, d):
    t, f = findings(spark, d)
    judge = t.filter((F.col("media") + F.col("idx")) % 8 == 0).select(
        *K, "idx", F.lit("LLM_judge_review").alias("code"), F.lit(None).cast("string").alias("severity"),
        F.lit(None).cast("string").alias("message"))
    return transqc.cue_status(t, transqc.merge_findings(f, judge, K), K)


# --- guards ----------------------------------------------------------------------------

_W = lambda c: f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> ''))"
Q_GUARD = v.Q_TRANS + f""",
d_n AS (SELECT media, cand, idx, line_raw AS r, text AS n, list_distinct(list_concat(
    list_filter(regexp_extract_all(line_raw, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-zA-Z]*$') AND w NOT IN ('A', 'I')),
    regexp_extract_all(line_raw, '["'']([^"'']+)["'']', 1))) AS nouns
  FROM (SELECT *, CASE WHEN literal_text = '' THEN source_text ELSE literal_text END AS line_raw FROM v_trans)),
d_l AS (SELECT *, list_min(list_filter(nouns, lambda x: NOT contains(lower(n), lower(x)))) AS lost,
    {_W('r')} AS wr, {_W('n')} AS wn FROM d_n),
d_all AS (SELECT media, cand, idx, CASE WHEN r = n THEN 'unchanged' WHEN lost IS NOT NULL OR (wr > 0 AND (wn * 10 > wr * 14 OR wn * 10 < wr * 6))
    THEN 'reverted' ELSE 'polished' END AS outcome,
  CASE WHEN r = n THEN NULL WHEN lost IS NOT NULL THEN 'noun_change' WHEN wr > 0 AND (wn * 10 > wr * 14 OR wn * 10 < wr * 6) THEN 'length_ratio' END AS drift_reason
  FROM d_l)"""


def guarded(spark, d):
    t = v.translation_cues(spark, d)
    raw = F.when(F.col("literal_text") == "", F.col("source_text")).otherwise(F.col("literal_text"))
    return guards.guard(t.select(*K, "idx", raw.alias("raw_text"), F.col("text").alias("new_text")), K)


@REG.query(f"WITH {Q_GUARD} SELECT * FROM d_all")
def check_drift(spark, d):
    return guarded(spark, d).select(*K, "idx", "outcome", "drift_reason")


@REG.query(f"""WITH {v.Q_DIALOGUE}, s AS (SELECT media, cand, idx, text AS raw, CASE WHEN media % 4 = 0 THEN ' Got it. ' ELSE text END AS new FROM v_dialogue)
  SELECT media, cand, count(*) >= 2 AND count(DISTINCT lower(trim(new))) = 1 AND min(lower(trim(new))) IN ({", ".join(f"'{p}'" for p in guards.STOCK_PHRASES)})
    AND count(DISTINCT lower(trim(raw))) > 1 AS collapsed FROM s GROUP BY ALL""")
def stock_phrase_collapse(spark, d):
    c = v.dialogue(spark, d).withColumn("new", F.when(F.col("media") % 4 == 0, " Got it. ").otherwise(F.col("text")))
    return guards.stock_phrase_collapse(c, K, "text", "new")


@REG.query(f"""WITH {Q_FULL} SELECT media, count(*) FILTER (changed) AS segments_changed, count(*) FILTER (NOT changed) AS segments_unchanged,
  CASE WHEN count(*) FILTER (changed) = 0 THEN 'no_change' ELSE 'changed' END AS polish_status,
  count(*) FILTER (changed) / count(*) AS polish_change_rate FROM o_full GROUP BY ALL""")
def change_stats(spark, d):
    return guards.change_stats(zipped(spark, d), ["media"])


@REG.query(f"""WITH {v.Q_DIALOGUE} SELECT media, cand, idx, idx // 3 AS batch_no, idx % 3 + 1 AS pos,
  CASE WHEN (media + idx) % 4 = 0 THEN text ELSE 'fix ' || role END AS new_text FROM v_dialogue""")
def apply_corrections(spark, d):
    c = v.dialogue(spark, d)
    line = F.when((F.col("media") + F.col("idx")) % 4 == 0, F.concat((F.col("idx") % 3 + 1).cast("string"), F.lit(".  "))).otherwise(
        F.concat(F.lit(" "), (F.col("idx") % 3 + 1).cast("string"), F.lit(") fix "), "role"))
    replies = c.groupBy(*K, F.floor(F.col("idx") / 3).cast("bigint").alias("batch_no")).agg(
        F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("reply"))
    return guards.apply_replies(c, replies, K, 3).select(*K, "idx", "batch_no", "pos", "new_text")


@REG.query(f"""WITH {Q_GUARD} SELECT media, cand, count(*) AS total, count(*) FILTER (outcome = 'polished') AS polished,
  count(*) FILTER (outcome = 'reverted') AS reverted, count(*) FILTER (outcome = 'unchanged') AS unchanged FROM d_all GROUP BY ALL""")
def polish_stats(spark, d):
    return guards.guard_stats(guarded(spark, d), K)
