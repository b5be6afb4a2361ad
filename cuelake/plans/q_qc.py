"""Queries on quality rules and corpus metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import metrics as me
from cuelake.operators import qc
from cuelake.plans import views as v
from cuelake.plans.q_align import Q_TEXTS, aligned_texts, tolerant_texts
from cuelake.operators import align as al
from cuelake.plans.registry import REG
from cuelake.session import cut_lineage, tune

K = v.TRACK


def _sec(x: str) -> str:
    return (f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST(abs({x}) // 1000 AS VARCHAR) || '.' || "
            f"lpad(CAST(abs({x}) % 1000 AS VARCHAR), 3, '0')")


def _fixed(n: str, d: str, p: int) -> str:
    q = f"(({n}) * {2 * 10 ** p} + ({d})) // (({d}) * 2)"
    return f"CAST({q} // {10 ** p} AS VARCHAR) || '.' || lpad(CAST({q} % {10 ** p} AS VARCHAR), {p}, '0')"


_PLAIN = v.sql_strip(r"regexp_replace(regexp_replace(regexp_replace(text, '\{[^}]*\}', '', 'g'), "
                     r"'\\[nNh]', ' ', 'g'), '<[^>]+>', '', 'g')")
_PREV = "replace(left(ln, 30) || CASE WHEN length(ln) > 30 THEN '...' ELSE '' END, '\\', '\\\\')"

Q_QC = v.Q_CUES + f""",
q_win AS (
  SELECT *, lag(start_ms) OVER w AS ps, lag(end_ms) OVER w AS pe, {_PLAIN} AS plain
  FROM v_cues WINDOW w AS (PARTITION BY media, cand ORDER BY idx)),
q_c AS (
  SELECT *, CASE WHEN plain = '' THEN [] ELSE string_split(regexp_replace(plain, '\\n$', ''), chr(10)) END AS ls,
    length(replace(plain, chr(10), '')) AS chars, end_ms - start_ms AS dur FROM q_win),
q_viol AS (
  SELECT media, cand, idx + 1 AS cue_index, 'out_of_order' AS type, 'error' AS severity,
    'Cue starts at ' || {_sec('start_ms')} || 's, before previous cue start ' || {_sec('ps')} || 's' AS detail
  FROM q_c WHERE start_ms < ps
  UNION ALL SELECT media, cand, idx + 1, 'overlap', 'error', 'Cue starts at ' || {_sec('start_ms')} ||
    's but previous cue ends at ' || {_sec('pe')} || 's (overlap: ' || {_sec('(pe - start_ms)')} || 's)'
  FROM q_c WHERE pe > start_ms
  UNION ALL SELECT media, cand, idx + 1, 'duration_too_short', 'error',
    'Duration ' || {_sec('dur')} || 's < minimum 0.5s' FROM q_c WHERE dur < 500
  UNION ALL SELECT media, cand, idx + 1, 'duration_too_long', 'error',
    'Duration ' || {_sec('dur')} || 's > maximum 7.0s' FROM q_c WHERE dur > 7000
  UNION ALL SELECT media, cand, idx + 1, 'high_cps', 'warning',
    'Reading speed ' || {_fixed('chars * 1000', 'dur', 1)} || ' CPS > maximum 20.0 CPS'
  FROM q_c WHERE dur > 0 AND chars > 0 AND chars * 1000 > dur * 20
  UNION ALL SELECT media, cand, idx + 1, 'formatting_artifact', 'error', 'ASS/SSA override tag found in cue text'
  FROM q_c WHERE regexp_matches(text, '\\{{[^}}]*\\}}')
  UNION ALL SELECT media, cand, idx + 1, 'formatting_artifact', 'error',
    'Literal ASS inline newline escape (\\N, \\n, \\h) found in cue text'
  FROM q_c WHERE regexp_matches(text, '\\\\[nNh]')
  UNION ALL SELECT media, cand, idx + 1, 'formatting_artifact', 'warning', 'HTML tag found in cue text'
  FROM q_c WHERE regexp_matches(text, '<[^>]+>')
  UNION ALL SELECT media, cand, idx + 1, 'too_many_lines', 'warning',
    'Cue has ' || len(ls) || ' display lines (maximum: 2)' FROM q_c WHERE len(ls) > 2
  UNION ALL SELECT media, cand, cue_index, 'line_too_long', 'warning', 'Line has ' || length(ln) ||
    ' characters (maximum: 42): ' ||
    CASE WHEN contains(pv, '''') AND NOT contains(pv, '"') THEN '"' || pv || '"'
         WHEN contains(pv, '''') THEN '''' || replace(pv, '''', '\\''') || '''' ELSE '''' || pv || '''' END
  FROM (SELECT *, {_PREV} AS pv FROM (SELECT media, cand, idx + 1 AS cue_index, unnest(ls) AS ln FROM q_c))
  WHERE length(ln) > 42),
q_summary AS (
  SELECT t.media, t.cand, t.cue_count, coalesce(q.error_count, 0) AS error_count,
    coalesce(q.warning_count, 0) AS warning_count
  FROM (SELECT media, cand, count(*) AS cue_count FROM v_cues GROUP BY ALL) t
  LEFT JOIN (SELECT media, cand, count(*) FILTER (severity = 'error') AS error_count,
    count(*) FILTER (severity = 'warning') AS warning_count FROM q_viol GROUP BY ALL) q USING (media, cand))"""


def qc_cues(spark, d):
    return v.cues(spark, d).withColumn("seq", F.col("idx") + 1)


def qc_tables(spark, d):
    c = qc_cues(spark, d)
    return c.select(*K).distinct(), c, qc.subtitle_qc(c.select(*K).distinct(), c, K)


@REG.query(f"WITH {Q_QC} SELECT * FROM q_viol")
def subtitle_qc(spark, d):
    return qc_tables(spark, d)[2].drop("pos")


@REG.query(f"WITH {Q_QC} SELECT *, true AS parsed_ok, error_count = 0 AS pass_qc FROM q_summary")
def qc_summary(spark, d):
    return qc.qc_summary(*qc_tables(spark, d), K)


@REG.query(f"WITH {Q_QC} SELECT media, cand, cue_index, type FROM q_viol WHERE type IN ('out_of_order', 'overlap')")
def qc_order_and_overlap(spark, d):
    c = qc_cues(spark, d)
    return qc.cue_violations(c, K).filter(F.col("type").isin("out_of_order", "overlap")).select(*K, "cue_index", "type")


@REG.query(f"WITH {Q_QC} SELECT media, cand, " + ", ".join(
    f"count(*) FILTER (type = '{t}') AS n_{t}" for t in qc.VIOLATION_TYPES) +
    ", count(*) FILTER (type = 'formatting_artifact' AND severity = 'error') AS n_formatting_error"
    ", count(*) FILTER (type = 'formatting_artifact' AND severity = 'warning') AS n_formatting_warning"
    " FROM q_viol GROUP BY ALL")
def violation_counts(spark, d):
    return qc.violation_counts(qc_tables(spark, d)[2], K)


@REG.query(f"""WITH {Q_QC}, w_v AS (SELECT media, cand, list(struct_pack(cue_index := cue_index, type := type, severity := severity, detail := detail)
    ORDER BY cue_index, type, severity, detail) AS l FROM q_viol GROUP BY ALL),
  w_s AS (SELECT *, CASE WHEN error_count > 0 THEN 'fail' WHEN warning_count > 0 THEN 'warn' ELSE 'pass' END AS overall_qc_status FROM q_summary)
  SELECT media, cand, CAST(0 AS BIGINT) AS part, overall_qc_status, CAST(to_json(struct_pack(schema_version := 2, subtitle_qc := struct_pack(parsed_ok := true,
    cue_count := cue_count, error_count := error_count, warning_count := warning_count, pass_qc := error_count = 0, violations := coalesce(l, []))))
    AS VARCHAR)[:-2] || ',"overall_qc_status":"' || overall_qc_status || '"}}' AS doc
  FROM w_s LEFT JOIN w_v USING (media, cand)""")
def write_qc_sidecar(spark, d):
    t, c, viol = qc_tables(spark, d)
    return qc.qc_sidecar(qc.qc_summary(t, c, viol, K), viol, K)


_S, _O = v.sql_strip("source_text"), v.sql_strip("text")
_LIKE = lambda col, ms: "(" + " OR ".join(f"contains({col}, '{m.lower()}')".replace("can't", "can''t").replace(
    "couldn't", "couldn''t") for m in ms) + ")"

Q_HEUR = v.Q_TRANS + f""",
h AS (SELECT media, cand, idx + 1 AS cue_index, {_S} AS s, {_O} AS o, length({_S}) AS ns, length({_O}) AS no
  FROM v_trans),
h_all AS (
  SELECT media, cand, cue_index, 'translation_possible_untranslated' AS type FROM h
  WHERE regexp_matches(o, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]')
  UNION ALL SELECT media, cand, cue_index, 'translation_possible_omission' FROM h
  WHERE s <> '' AND o <> '' AND ns >= 10 AND no / ns < 0.3
  UNION ALL SELECT media, cand, cue_index, 'translation_possible_added_meaning' FROM h
  WHERE s <> '' AND o <> '' AND ns <= 8 AND no >= 40 AND no / ns > 3.5
  UNION ALL SELECT media, cand, cue_index, 'translation_possible_softened_adult_dialogue' FROM h
  WHERE s <> '' AND o <> '' AND {_LIKE('s', qc.ADULT_SOURCE_MARKERS)} AND NOT {_LIKE('lower(o)', qc.ADULT_TARGET_MARKERS)}
  UNION ALL SELECT media, cand, cue_index, 'translation_low_confidence_flagged' FROM h
  WHERE s <> '' AND o <> '' AND {_LIKE('lower(o)', qc.LOW_CONFIDENCE_MARKERS)}
  UNION ALL SELECT media, cand, cue_index, 'translation_high_risk_content_review' FROM h
  WHERE s <> '' AND o <> '' AND {_LIKE("lower(s || chr(10) || o)", qc.HIGH_RISK_MARKERS)})"""


_RATIO = _fixed("no", "greatest(ns, 1)", 2)


@REG.query(f"""WITH {Q_HEUR} SELECT media, cand, cue_index, type, 'warning' AS severity, CASE type
    WHEN 'translation_possible_untranslated' THEN 'Output still contains CJK characters; translation may have failed'
    WHEN 'translation_possible_omission' THEN 'Translated cue is much shorter than source (ratio=' || {_RATIO} || '); possible omission'
    WHEN 'translation_possible_added_meaning' THEN 'Translated cue is much longer than source (ratio=' || {_RATIO} || '); possible added meaning'
    WHEN 'translation_possible_softened_adult_dialogue' THEN 'Live-action/adult profile source appears explicit, but translation may be softened or euphemized'
    WHEN 'translation_low_confidence_flagged' THEN 'Translation line is flagged as uncertain and should be reviewed'
    ELSE 'Potential minor/coercion/illegal-content indicator detected; manual safety review required' END AS detail
  FROM h_all JOIN h USING (media, cand, cue_index)""")
def translation_heuristics(spark, d):
    t = v.translation_cues(spark, d)
    return qc.translation_heuristics(t, K, profile="live_action_adult").select(*K, "cue_index", "type", "severity", "detail")


# --- metrics ---------------------------------------------------------------------------

def _wer_words(c: str) -> str:
    return f"list_filter(string_split({v.sql_strip(f"regexp_replace({c}, '\\s\\s+', ' ', 'g')")}, ' '), lambda w: w <> '')"


# Word edits: words are numbered by the distinct words of the pair. Words of one side only match
# nothing, so they are one symbol per side. Up to 120 shared words are letters for the built-in
# distance of bytes; above that the table is folded by diagonals (D(i, d - i) needs the two before).
Q_WER = Q_TEXTS + f""",
w_words AS (SELECT DISTINCT ref_text, cand_text, {_wer_words('ref_text')} AS r, {_wer_words('cand_text')} AS h FROM o_texts),
w_shared AS (SELECT *, list_sort(list_distinct(list_filter(r, lambda w: list_contains(h, w)))) AS common FROM w_words),
w_codes AS (SELECT ref_text, cand_text, len(common) AS n_both,
    list_transform(r, lambda w: coalesce(nullif(list_position(common, w), 0), -1)) AS r,
    list_transform(h, lambda w: coalesce(nullif(list_position(common, w), 0), -2)) AS h FROM w_shared),
w_byte AS (SELECT ref_text, cand_text, levenshtein(
    array_to_string(list_transform(r, lambda x: chr(CAST(CASE x WHEN -1 THEN 1 ELSE x + 2 END AS INTEGER))), ''),
    array_to_string(list_transform(h, lambda x: chr(CAST(CASE x WHEN -2 THEN 2 ELSE x + 2 END AS INTEGER))), '')) AS edits
  FROM w_codes WHERE n_both <= 120 AND ref_text <> cand_text),
w_fold AS (SELECT ref_text, cand_text, list_reduce(range(2, len(r) + len(h) + 1), lambda a, d: {{'p2': a.p1, 'p1': list_transform(range(len(r) + 1), lambda i: CASE
    WHEN i > d OR d - i > len(h) THEN CAST(1000000000 AS BIGINT) WHEN i = 0 OR i = d THEN CAST(d AS BIGINT)
    ELSE CAST(least(a.p1[i + 1] + 1, a.p1[i] + 1, a.p2[i] + CASE WHEN r[i] = h[d - i] THEN 0 ELSE 1 END) AS BIGINT) END)}},
    {{'p2': list_transform(range(len(r) + 1), lambda i: CAST(CASE WHEN i = 0 THEN 0 ELSE 1000000000 END AS BIGINT)),
      'p1': list_transform(range(len(r) + 1), lambda i: CAST(CASE WHEN i <= 1 THEN 1 ELSE 1000000000 END AS BIGINT))}}).p1[len(r) + 1] AS edits
  FROM w_codes WHERE n_both > 120 AND ref_text <> cand_text),
w_edits AS (SELECT * FROM w_byte UNION ALL SELECT * FROM w_fold),
w_wer AS (SELECT media, cand, CAST(sum(coalesce(edits, 0)) AS BIGINT) AS word_edits, CAST(sum(len(r)) AS BIGINT) AS ref_words,
    CASE WHEN bool_or(ref_text = '') OR sum(len(r)) = 0 THEN 1.0 ELSE round_even(sum(coalesce(edits, 0)) / sum(len(r)), 4) END AS wer
  FROM o_texts JOIN w_words USING (ref_text, cand_text) LEFT JOIN w_edits USING (ref_text, cand_text) GROUP BY ALL)"""


@REG.query(f"WITH {Q_WER} SELECT * FROM w_wer")
def corpus_wer(spark, d):
    return me.corpus_wer(aligned_texts(spark, d), K)


_13A = ("regexp_replace(rtrim({c}, ' ' || chr(10) || chr(9) || chr(13)), '<skipped>', '', 'g')")


def _tok(c: str) -> str:
    t = f"rtrim({c}, ' ' || chr(9) || chr(10) || chr(13))"
    t = f"replace(replace(replace({t}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    t = f"replace(replace(replace(replace({t}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    t = f"(' ' || {t} || ' ')"
    t = rf"regexp_replace({t}, '([\{{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g')"
    t = rf"regexp_replace({t}, '([^0-9])([\.,])', '\1 \2 ', 'g')"
    t = rf"regexp_replace({t}, '([\.,])([^0-9])', ' \1 \2', 'g')"
    t = rf"regexp_replace({t}, '([0-9])(-)', '\1 \2 ', 'g')"
    return f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> '')"


Q_BLEU = Q_TEXTS + f""",
b_tok AS (SELECT media, cand, idx, {_tok('ref_text')} AS r, {_tok('cand_text')} AS h FROM o_texts),
b_gram AS (
  SELECT media, cand, idx, n, 0 AS side, array_to_string(r[i:i+n-1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(r) - n + 2)) AS i FROM b_tok, (SELECT unnest([1,2,3,4]) AS n))
  UNION ALL
  SELECT media, cand, idx, n, 1, array_to_string(h[i:i+n-1], ' ')
  FROM (SELECT *, unnest(range(1, len(h) - n + 2)) AS i FROM b_tok, (SELECT unnest([1,2,3,4]) AS n))),
b_cnt AS (
  SELECT media, cand, idx, n, g, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS h
  FROM b_gram GROUP BY ALL),
b_sum AS (
  SELECT media, cand, n, sum(least(r, h)) AS m, sum(h) AS h, sum(r) AS r FROM b_cnt GROUP BY ALL),
b_wide AS (
  SELECT media, cand, """ + ", ".join(
    f"coalesce(sum({x}) FILTER (n = {i}), 0) AS {x}{i}" for i in (1, 2, 3, 4) for x in "mhr") + """
  FROM b_sum GROUP BY ALL)"""
_SMOOTH = {1: "1", 2: "", 3: "", 4: ""}


def _prec(i: int) -> str:
    k = " * ".join(["1.0"] + [f"(CASE WHEN m{j} = 0 AND h{j} > 0 THEN 2 ELSE 1 END)" for j in range(1, i + 1)])
    return f"(CASE WHEN h{i} = 0 THEN 0.0 WHEN m{i} = 0 THEN 100.0 / ({k} * h{i}) ELSE 100.0 * m{i} / h{i} END)"


Q_BLEU += f""",
b_prec AS (
  SELECT *, {_prec(1)} AS p1, {_prec(2)} AS p2, {_prec(3)} AS p3, {_prec(4)} AS p4,
    CASE WHEN h1 >= r1 THEN 1.0 WHEN h1 > 0 THEN exp(1 - r1 / h1) ELSE 0.0 END AS bp,
    m1 + m2 + m3 + m4 > 0 AS hit FROM b_wide),
b_bleu AS (
  SELECT media, cand, CAST(h1 AS BIGINT) AS sys_len, CAST(r1 AS BIGINT) AS ref_len, bp,
    CASE WHEN hit THEN p1 ELSE 0 END AS p1, CASE WHEN hit THEN p2 ELSE 0 END AS p2,
    CASE WHEN hit THEN p3 ELSE 0 END AS p3, CASE WHEN hit THEN p4 ELSE 0 END AS p4,
    round_even(CASE WHEN NOT hit OR p1 = 0 OR p2 = 0 OR p3 = 0 OR p4 = 0 THEN 0.0
      ELSE bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) END, 2) AS bleu FROM b_prec)"""


@REG.query(f"WITH {Q_BLEU} SELECT media, cand, bleu FROM b_bleu")
def corpus_bleu(spark, d):
    return me.corpus_bleu(aligned_texts(spark, d), K)


@REG.query(f"WITH {Q_BLEU} SELECT media, cand, bleu, round(bp, 6) AS bp, sys_len, ref_len, round(p1, 6) AS p1, "
           "round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4 FROM b_bleu")
def bleu_detail(spark, d):
    out = me.corpus_bleu(aligned_texts(spark, d), K, detail=True)
    return out.select(*K, "bleu", "sys_len", "ref_len", *[F.round(c, 6).alias(c) for c in ("bp", "p1", "p2", "p3", "p4")])


_N6 = ["m", "h", "r"]
Q_CHRF = Q_TEXTS + r""",
c_ch AS (SELECT media, cand, idx, regexp_replace(ref_text, '\s', '', 'g') AS r, regexp_replace(cand_text, '\s', '', 'g') AS h FROM o_texts),
c_gram AS (
  SELECT media, cand, idx, n, 0 AS side, hash(substr(r, i, n)) AS g
  FROM (SELECT *, unnest(range(1, length(r) - n + 2)) AS i FROM c_ch, (SELECT unnest([1,2,3,4,5,6]) AS n))
  UNION ALL
  SELECT media, cand, idx, n, 1, hash(substr(h, i, n))
  FROM (SELECT *, unnest(range(1, length(h) - n + 2)) AS i FROM c_ch, (SELECT unnest([1,2,3,4,5,6]) AS n) WHERE length(r) >= n)),
c_cnt AS (SELECT media, cand, idx, n, g, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS h
  FROM c_gram GROUP BY ALL),
c_sum AS (SELECT media, cand, n, sum(least(r, h)) AS m, sum(h) AS h, sum(r) AS r FROM c_cnt GROUP BY ALL),
c_avg AS (SELECT media, cand, avg(m / h) AS p, avg(m / r) AS q FROM c_sum WHERE h > 0 AND r > 0 GROUP BY ALL),
c_chrf AS (SELECT t.media, t.cand, round_even(CASE WHEN coalesce(p + q, 0) = 0 THEN 0.0
    ELSE 100 * 5 * p * q / (4 * p + q) END, 2) AS chrf
  FROM (SELECT DISTINCT media, cand FROM o_texts) t LEFT JOIN c_avg USING (media, cand))"""


@REG.query(f"WITH {Q_CHRF} SELECT * FROM c_chrf")
def corpus_chrf(spark, d):
    return me.corpus_chrf(aligned_texts(spark, d), K)


def tracks(spark, d):
    return v.cand_cues(spark, d, v.documents_in_place(spark, d)).select(*K).distinct()


def _added(*parts: str) -> str:
    """The first chain of common tables with what each of the others adds to Q_TEXTS."""
    return parts[0] + "".join(p.removeprefix(Q_TEXTS) for p in parts[1:])


def _seconds(ms: str) -> str:
    """Milliseconds as seconds with two digits, halves to the even digit, in whole numbers."""
    return f"(({ms} // 10 + CASE WHEN {ms} % 10 > 5 OR ({ms} % 10 = 5 AND {ms} // 10 % 2 = 1) THEN 1 ELSE 0 END) / 100)"


@REG.query(f"""WITH {_added(Q_WER, Q_BLEU, Q_CHRF)},
  d_rank AS (SELECT *, row_number() OVER (PARTITION BY media, cand ORDER BY idx) AS rank FROM o_diffs WHERE is_diff),
  d_list AS (SELECT media, cand, CAST(to_json(list({{'rank': rank, 'start': {_seconds('ref_start')}, 'end': {_seconds('ref_end')},
    'ref': ref_text, 'cand': cand_text}} ORDER BY rank)) AS VARCHAR) AS diffs FROM d_rank WHERE rank <= 20 GROUP BY ALL),
  d_n AS (SELECT media, cand, count(*) AS num_segments, count(*) FILTER (is_diff) AS num_diffs FROM o_diffs GROUP BY ALL)
  SELECT media, cand, coalesce(wer, 1.0) AS wer, coalesce(bleu, 0.0) AS bleu, coalesce(chrf, 0.0) AS chrf, coalesce(num_segments, 0) AS num_segments,
    coalesce(num_diffs, 0) AS num_diffs, diffs
  FROM (SELECT DISTINCT media, cand FROM v_cand) LEFT JOIN d_n USING (media, cand) LEFT JOIN w_wer USING (media, cand)
    LEFT JOIN b_bleu USING (media, cand) LEFT JOIN c_chrf USING (media, cand) LEFT JOIN d_list USING (media, cand)""")
def compare_report(spark, d):
    pairs = cut_lineage(aligned_texts(spark, d))
    # The texts are in place; a track's differences are dealt by all its keys and stay there.
    tune(spark)
    out = me.compare_report(pairs, tracks(spark, d), K)
    return out.withColumn("diffs", F.to_json("diffs"))


@REG.query()
def corpus_ter(spark, d):
    return me.corpus_ter(aligned_texts(spark, d), K)


def similarities(spark, d):
    return me.seq_ratio(tolerant_texts(spark, d), "ref_text", "cand_text")


@REG.query()
def avg_similarity(spark, d):
    return similarities(spark, d).groupBy(*K).agg(F.avg("similarity").alias("average_similarity"))


@REG.query()
def similarity_histogram(spark, d):
    return me.similarity_histogram(similarities(spark, d), K)
