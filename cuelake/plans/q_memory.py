"""Queries on the translation memory, contexts and prompt tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions.text import strip
from cuelake.operators import memory as tm
from cuelake.operators import prompts
from cuelake.plans import views as v
from cuelake.plans.q_text import Q_GLOSS, glossary
from cuelake.plans.registry import REG
from cuelake.sources import corrections as co_module

K = v.TRACK

Q_SIM = v.Q_LINES + """,
s_m AS (SELECT item_id AS ord, trim(text, ' ' || chr(10)) AS m FROM benchmark),
s_q AS (SELECT DISTINCT trim(line) AS q FROM v_lines),
s_mg AS (SELECT ord, m, list_distinct(CASE WHEN length(m) <= 2 THEN [m] ELSE list_transform(range(1, length(m)), lambda i: m[i:i+1]) END) AS g FROM s_m),
s_qg AS (SELECT q, list_distinct(CASE WHEN length(q) <= 2 THEN [q] ELSE list_transform(range(1, length(q)), lambda i: q[i:i+1]) END) AS g FROM s_q),
s_sc AS (SELECT q, ord, m = q AS exact, CASE WHEN m = q THEN 1.0
    WHEN contains(q, m) OR contains(m, q) THEN least(length(q), length(m)) / greatest(length(q), length(m))
    ELSE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) END AS score
  FROM s_qg a, s_mg b),
s_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, exact DESC, ord) AS rank
  FROM s_sc WHERE score > 0) WHERE rank <= 3)"""


def memory_table(spark, d):
    return v.table(spark, d, "benchmark").select(
        F.col("item_id").alias("ord"), F.col("text").alias("source_text"), F.lit("en").alias("source_lang"),
        F.lit("xx").alias("target_lang"))


def line_queries(spark, d):
    return v.lines(spark, d).select("media", "idx", F.col("line").alias("query_text"), F.lit("en").alias("source_lang"),
                                    F.lit("xx").alias("target_lang"))


@REG.query(f"""WITH {Q_SIM} SELECT l.media, l.idx, t.ord, round(t.score, 9) AS score, t.exact, t.rank
  FROM v_lines l JOIN s_top t ON t.q = trim(l.line)""")
def memory_lookup(spark, d):
    out = tm.memory_lookup(line_queries(spark, d), memory_table(spark, d), k=3)
    return out.select("media", "idx", "ord", F.round("score", 9).alias("score"), "exact", "rank")


@REG.query("""WITH p AS (SELECT conv_id, turn, trim(text) AS q, trim(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS m FROM conversations),
  g AS (SELECT *, list_distinct(CASE WHEN length(m) <= 2 THEN [m] ELSE list_transform(range(1, length(m)), lambda i: m[i:i+1]) END) AS a,
    list_distinct(CASE WHEN length(q) <= 2 THEN [q] ELSE list_transform(range(1, length(q)), lambda i: q[i:i+1]) END) AS b FROM p WHERE m IS NOT NULL)
  SELECT conv_id, turn, round(CASE WHEN q = '' OR m = '' THEN 0 WHEN q = m THEN 1 WHEN contains(q, m) OR contains(m, q)
    THEN least(length(q), length(m)) / greatest(length(q), length(m))
    ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 9) AS score FROM g""")
def tm_similarity(spark, d):
    c = v.table(spark, d, "conversations").select("conv_id", "turn", "text")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("m"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tm.tm_similarity(F.col("text"), F.col("m")), 9).alias("score"))


@REG.query(f"""WITH {v.Q_DIALOGUE} SELECT media, idx, concat_ws(chr(10),
    CASE WHEN lag(text, 2) OVER w IS NOT NULL THEN '   ' || (idx - 1) || ': ' || lag(text, 2) OVER w END,
    CASE WHEN lag(text, 1) OVER w IS NOT NULL THEN '   ' || idx || ': ' || lag(text, 1) OVER w END,
    '>> ' || (idx + 1) || ': ' || text,
    CASE WHEN lead(text, 1) OVER w IS NOT NULL THEN '   ' || (idx + 2) || ': ' || lead(text, 1) OVER w END,
    CASE WHEN lead(text, 2) OVER w IS NOT NULL THEN '   ' || (idx + 3) || ': ' || lead(text, 2) OVER w END) AS context
  FROM v_dialogue WINDOW w AS (PARTITION BY media ORDER BY idx)""")
def context_window(spark, d):
    return prompts.context_window(v.dialogue(spark, d), K, 2).select("media", "idx", "context")


@REG.query(f"""WITH {v.Q_DIALOGUE} SELECT media, idx, coalesce(lag(text) OVER w, '') AS previous_context, coalesce(lead(text) OVER w, '') AS next_context
  FROM v_dialogue WINDOW w AS (PARTITION BY media ORDER BY idx)""")
def prev_next_context(spark, d):
    return prompts.prev_next(v.dialogue(spark, d), K, "text").select("media", "idx", "previous_context", "next_context")


@REG.query(f"""WITH {v.Q_DIALOGUE}, s AS (SELECT *, CASE WHEN (media + idx) % 3 = 0 THEN NULL ELSE trim(text) END AS o FROM v_dialogue)
  SELECT media, idx, last_value(o IGNORE NULLS) OVER (PARTITION BY media ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_output FROM s""")
def previous_output(spark, d):
    c = v.dialogue(spark, d).withColumn("out", F.when((F.col("media") + F.col("idx")) % 3 == 0, F.lit("  ")).otherwise(F.col("text")))
    return prompts.previous_output(c, K, "out").select("media", "idx", "previous_output")


@REG.query(f"WITH {v.Q_LINES} SELECT media, idx, idx // 20 AS batch_no, idx % 20 + 1 AS pos FROM v_lines")
def batch_number(spark, d):
    return prompts.batch_number(v.lines(spark, d), 20).select("media", "idx", "batch_no", "pos")


Q_PROMPT = f"""WITH {v.Q_DIALOGUE},{Q_GLOSS}, h AS (SELECT d.media, d.idx, g.*, row_number() OVER (PARTITION BY d.media, d.idx ORDER BY g.required DESC,
    CASE g.kind WHEN 'name' THEN 0 WHEN 'honorific' THEN 1 ELSE 2 END, length(g.source) DESC, g.pos) AS rank
  FROM v_dialogue d JOIN g_terms g ON contains(d.text, g.source)),
  b AS (SELECT media, idx, string_agg('- ' || source || ' -> ' || target || ' (' || kind || ', ' ||
    CASE WHEN required THEN 'required' ELSE 'preferred' END || ')', chr(10) ORDER BY rank) AS body FROM h WHERE rank <= 6 GROUP BY ALL)
  SELECT media, idx, glossary_block, coalesce(prev, '') AS previous_output, text AS source_text, concat_ws(chr(10) || chr(10), 'Translate only the line marked with >>.',
    context, 'Previous accepted output:' || chr(10) || prev, nullif(glossary_block, ''), 'Cue:' || chr(10) || text) AS prompt
  FROM (SELECT d.*, coalesce('Glossary enforcement (must follow for this cue):' || chr(10) || b.body, '') AS glossary_block, lag(trim(d.text)) OVER w AS prev, concat_ws(chr(10),
      '   ' || (d.idx - 1) || ': ' || lag(d.text, 2) OVER w, '   ' || d.idx || ': ' || lag(d.text, 1) OVER w, '>> ' || (d.idx + 1) || ': ' || d.text,
      '   ' || (d.idx + 2) || ': ' || lead(d.text, 1) OVER w, '   ' || (d.idx + 3) || ': ' || lead(d.text, 2) OVER w) AS context
    FROM v_dialogue d LEFT JOIN b USING (media, idx) WINDOW w AS (PARTITION BY d.media ORDER BY d.idx))"""


@REG.query(Q_PROMPT)
def prompt_table(spark, d):
    c = v.dialogue(spark, d).withColumn("out", F.col("text"))
    p = prompts.prompt_table(c, K, glossary=glossary(spark), output="out")
    return p.select("media", "idx", "glossary_block", F.coalesce("previous_output", F.lit("")).alias("previous_output"),
                    F.col("text").alias("source_text"), "prompt")


_HEAD = prompts.instruction("natural_subtitle", True).replace("'", "''")


@REG.query(f"""SELECT media, idx, 'Mode: natural_subtitle' || chr(10) || 'Dialogue profile: anime' || chr(10) || 'Instruction: {_HEAD}' || chr(10) || chr(10) ||
    left(prompt, length(prompt) - length(source_text) - 5) || 'Return only the translation of this one cue.' || chr(10) || chr(10) || 'Cue:' || chr(10) || source_text AS prompt
  FROM ({Q_PROMPT})""")
def prompt_with_mode(spark, d):
    """Whole prompts with mode, profile and instruction."""
    c = v.dialogue(spark, d).withColumn("out", F.col("text"))
    p = prompts.prompt_table(c, K, glossary=glossary(spark), output="out", mode="natural_subtitle", profile="anime", flag_low_confidence=True)
    return p.select("media", "idx", "prompt")


@REG.query(f"""WITH {v.Q_LINES} SELECT media, idx // 20 AS batch_no, string_agg((idx % 20 + 1) || '. ' || line, chr(10) ORDER BY idx) AS message
  FROM v_lines GROUP BY ALL""")
def numbered_message(spark, d):
    return prompts.numbered_messages(v.lines(spark, d).withColumn("text", F.col("line")), ["media"], 20)


@REG.query(f"""WITH {v.Q_DIALOGUE}, r AS (SELECT media, idx, CASE (media + idx) % 3 WHEN 0 THEN ' ' || chr(10) || 'Translation: ' || text
    WHEN 1 THEN text ELSE '  ' || chr(10) END AS reply FROM v_dialogue),
  l AS (SELECT media, idx, list_filter(list_transform(string_split(reply, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS a FROM r)
  SELECT media, idx, CASE WHEN a LIKE 'Translation:%' THEN trim(substr(a, 13)) ELSE a END AS reply FROM l""")
def clean_model_reply(spark, d):
    from cuelake.functions.text import first_reply_line
    k = (F.col("media") + F.col("idx")) % 3
    c = v.dialogue(spark, d).withColumn("r", F.when(k == 0, F.concat(F.lit(" \nTranslation: "), "text")).when(
        k == 1, F.col("text")).otherwise(F.lit("  \n")))
    return c.select("media", "idx", first_reply_line(F.col("r")).alias("reply"))


# --- corrections -----------------------------------------------------------------------

_N = {"sl": "lower(trim(coalesce(nullif(source_lang, ''), 'ja')))", "tl": "lower(trim(coalesce(nullif(target_lang, ''), 'en')))"}
Q_VALID = v.Q_CORR + f""",
n_all AS (SELECT ord, {_N['sl']} AS source_lang, {_N['tl']} AS target_lang, trim(domain) AS domain,
    {v.sql_strip("coalesce(source_text, '')")} AS source_text, {v.sql_strip("coalesce(bad_translation, '')")} AS bad_translation,
    {v.sql_strip("coalesce(approved_translation, '')")} AS approved_translation, previous_context, trim(next_context) AS next_context,
    list_sort(list_distinct(list_filter(list_transform(tags, lambda t: trim(t)), lambda t: t <> ''))) AS tags, language_pack
  FROM v_corr),
n_bad AS (SELECT *, concat_ws(',', CASE WHEN source_text = '' THEN 'source_text' END,
    CASE WHEN approved_translation = '' THEN 'approved_translation' END) AS missing FROM n_all),
n_ok AS (SELECT * FROM n_bad WHERE missing = '')"""


def _corr(spark, d):
    from cuelake.sources import corrections as co
    return co, co.normalize(v.corrections(spark, d))


@REG.query(f"""WITH {Q_VALID} SELECT ord, source_lang, target_lang, domain, source_text, bad_translation, approved_translation,
  array_to_string(tags, ',') AS tags FROM n_ok""")
def export_corrections(spark, d):
    co, n = _corr(spark, d)
    return co.split_valid(n)[0].select("ord", "source_lang", "target_lang", "domain", "source_text", "bad_translation",
                                       "approved_translation", F.array_join("tags", ",").alias("tags"))


@REG.query(f"WITH {Q_VALID} SELECT ord, 'missing_required_fields:' || missing AS reason FROM n_bad WHERE missing <> ''")
def validate_records(spark, d):
    co, n = _corr(spark, d)
    return co.split_valid(n)[1]


@REG.query(f"""WITH {Q_VALID} SELECT ord, source_text, approved_translation AS reference_translation, previous_context, next_context,
  source_lang, target_lang, domain, array_to_string(tags, ',') AS tags FROM n_ok""")
def export_reference_rows(spark, d):
    co, n = _corr(spark, d)
    return co.reference_rows(co.split_valid(n)[0]).withColumn("tags", F.array_join("tags", ","))


@REG.query(f"""WITH {Q_VALID} SELECT ord, 'Context before: ' || previous_context || chr(10) || 'Source: ' || source_text || chr(10) ||
  'Context after: ' || next_context AS user_content, approved_translation AS assistant_content, language_pack, '{co_module.SFT_SYSTEM}' AS system_content,
  'system,user,assistant' AS roles, source_lang, target_lang, domain, array_to_string(tags, ',') AS tags FROM n_ok""")
def export_sft_messages(spark, d):
    co, n = _corr(spark, d)
    m = co.sft_messages(co.split_valid(n)[0])
    return m.select("ord", F.col("messages")[1]["content"].alias("user_content"),
                    F.col("messages")[2]["content"].alias("assistant_content"), F.col("metadata.language_pack").alias("language_pack"),
                    F.col("messages")[0]["content"].alias("system_content"), F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
                    "metadata.source_lang", "metadata.target_lang", "metadata.domain", F.array_join("metadata.tags", ",").alias("tags"))


@REG.query(f"""WITH {Q_VALID} SELECT ord, source_text, bad_translation AS rejected_translation, approved_translation AS chosen_translation,
  'approved human correction preserves meaning better' AS reason, source_lang, target_lang, domain, array_to_string(tags, ',') AS tags
  FROM n_ok WHERE bad_translation <> ''""")
def export_preference_pairs(spark, d):
    co, n = _corr(spark, d)
    return co.preference_pairs(co.split_valid(n)[0])[0].withColumn("tags", F.array_join("tags", ","))


@REG.query(f"""WITH {Q_VALID} SELECT ord, 'missing_required_fields:bad_translation' AS reason FROM n_ok WHERE bad_translation = ''""")
def preference_rejects(spark, d):
    co, n = _corr(spark, d)
    return co.preference_pairs(co.split_valid(n)[0])[1]


@REG.query(f"""WITH {Q_VALID}, t AS (SELECT count(*) FILTER (missing = '') AS ok, count(*) FILTER (missing <> '') AS bad,
    count(*) FILTER (missing = '' AND bad_translation <> '') AS pref FROM n_bad WHERE source_lang = 'ja')
  SELECT 'approved_corrections' AS dataset, ok AS written, bad AS skipped FROM t UNION ALL SELECT 'benchmark', ok, bad FROM t
  UNION ALL SELECT 'sft', ok, bad FROM t UNION ALL SELECT 'preference_pairs', pref, bad + ok - pref FROM t""")
def export_summary(spark, d):
    co, _ = _corr(spark, d)
    return co.export_summary(v.corrections(spark, d), source_lang="ja")


@REG.query(f"""SELECT lower(trim(role)) AS source_lang, 'en' AS target_lang, {v.sql_strip('text')} AS source_text, 'conv ' || conv_id AS notes FROM conversations""")
def read_corrections(spark, d):
    """Records as JSON lines, each beside a broken line that is left out."""
    from cuelake.sources import corrections as co
    c = v.table(spark, d, "conversations")
    rec = F.struct(F.concat(F.lit(" "), F.upper("role")).alias("source_lang"), F.col("text").alias("source_text"),
                   F.concat(F.lit("conv "), F.col("conv_id").cast("string"), F.lit(" ")).alias("notes"))
    js = c.select(F.explode(F.array(F.to_json(rec), F.lit("{broken"))).alias("value"))
    return co.parse_corrections(js).select("source_lang", "target_lang", "source_text", "notes")
