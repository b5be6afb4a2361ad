"""Queries on quality floors, benchmark documents, registry records, packs, metadata and written datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuelake.functions import meta
from cuelake.functions import text as tx
from cuelake.operators import asr, benchmarks, packs, qc, registry_table, routing, scoring, terms, training
from cuelake.operators import lifecycle as lc
from cuelake.plans import q_routing as r
from cuelake.plans import views as v
from cuelake.plans.q_export import logs
from cuelake.plans.q_text import Q_ASR, asr_cues
from cuelake.plans.registry import REG
from cuelake.session import checkpoint_root
from cuelake.sources import catalog
from cuelake.sources import corrections as co


def folder(spark, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


# --- benchmark runs: fixture = return flag, engine = line number ------------------------

Q_RUNS = """
g_runs AS (SELECT l_orderkey * 10 + l_linenumber AS run_id, l_returnflag AS fixture, 'e' || (l_partkey % 5) AS engine,
  CASE WHEN l_orderkey % 17 <> 0 THEN round(l_discount * 8, 4) END AS wer, round(l_quantity, 4) AS bleu, round(l_tax * 1000, 4) AS chrf FROM lineitem)"""

FLOORS = [{"fixture": f, "engines": {f"e{i}": {"wer_max": round(0.3 + i / 10 + k / 20, 2), "bleu_min": 10.0 + 5 * i, "chrf_min": 20.0 + 5 * k} for i in range(4)}}
          for k, f in enumerate(("A", "N"))]


def runs(spark, d):
    x = v.table(spark, d, "lineitem")
    k = F.col("l_orderkey")
    return x.select((k * 10 + F.col("l_linenumber")).alias("run_id"), F.col("l_returnflag").alias("fixture"),
                    F.concat(F.lit("e"), (F.col("l_partkey") % 5).cast("string")).alias("engine"),
                    F.when(k % 17 != 0, F.round(F.col("l_discount") * 8, 4)).alias("wer"), F.round("l_quantity", 4).alias("bleu"),
                    F.round(F.col("l_tax") * 1000, 4).alias("chrf"))


def _floor_rows() -> str:
    return ", ".join(f"('{x['fixture']}', '{e}', {f['wer_max']}, {f['bleu_min']}, {f['chrf_min']})" for x in FLOORS for e, f in x["engines"].items())


@REG.query(f"""WITH {Q_RUNS}, f(fixture, engine, w, b, c) AS (VALUES {_floor_rows()}),
  j AS (SELECT g.*, f.w IS NOT NULL AS known, concat_ws(',', CASE WHEN g.wer IS NULL OR g.wer > f.w THEN 'wer' END, CASE WHEN g.bleu < f.b THEN 'bleu' END,
    CASE WHEN g.chrf < f.c THEN 'chrf' END) AS failed FROM g_runs g LEFT JOIN f USING (fixture, engine))
  SELECT run_id, fixture, engine, wer, bleu, chrf, CASE WHEN known THEN failed ELSE '' END AS failed,
    CASE WHEN NOT known THEN 'no_floor' WHEN failed = '' THEN 'pass' ELSE 'fail' END AS gate FROM j""")
def quality_gate(spark, d):
    import json
    docs = spark.createDataFrame([(json.dumps(x),) for x in FLOORS], "value string")
    out = benchmarks.quality_gate(runs(spark, d), benchmarks.expected_floors(docs))
    return out.withColumn("failed", F.array_join("failed", ","))


@REG.query(f"""WITH {Q_RUNS}, w AS (SELECT run_id, fixture, engine, row_number() OVER o - 1 AS run_no, round(wer - lag(wer) OVER o, 10) AS wer_delta,
    round(bleu - lag(bleu) OVER o, 10) AS bleu_delta, round(chrf - lag(chrf) OVER o, 10) AS chrf_delta
  FROM g_runs WINDOW o AS (PARTITION BY fixture, engine ORDER BY run_id, bleu, chrf, wer))
  SELECT *, coalesce(chrf_delta >= 2 AND bleu_delta >= 1 AND wer_delta <= 0, false) AS improved FROM w""")
def run_progress(spark, d):
    out = benchmarks.run_progress(runs(spark, d), ["fixture", "engine"], "run_id", ["bleu", "chrf", "wer"])
    return out.select("run_id", "fixture", "engine", "run_no", "wer_delta", "bleu_delta", "chrf_delta", "improved")


def _docs(spark, d):
    c, m = r.cands(spark, d), r.comparisons(spark, d)
    cards = scoring.scorecards(c, m, r.refs(spark, d)).withColumn("composite_score", F.round("composite_score", 6))
    titles = c.groupBy("media").agg(F.count(F.lit(1)).alias("candidates"))
    o = v.table(spark, d, "orders")
    tax = o.filter(F.col("o_orderkey") % 20 == 0).select(F.col("o_custkey").alias("media"), F.when(
        F.col("o_orderkey") % 40 == 0, "wrong_meaning").otherwise("bad_name").alias("code"), F.lit(1).alias("count"))
    return benchmarks.benchmark_documents(c, m, cards, r.refs(spark, d), routing.route_benchmark(titles, m, tax, min_weak=2))


Q_DOC = r.Q_CARD + """,
w_tax AS (SELECT DISTINCT o_custkey AS media, CASE o_orderkey % 40 WHEN 0 THEN 'wrong_meaning' ELSE 'bad_name' END AS code FROM orders WHERE o_orderkey % 20 = 0),
w_t AS (SELECT t.media, t.n, coalesce(c.n, 0) AS m, coalesce(c.w, 0) AS w, coalesce(x.codes, []) AS codes FROM (SELECT media, count(*) AS n FROM k_cand GROUP BY media) t
  LEFT JOIN (SELECT media, count(*) AS n, count(*) FILTER (wer IS NOT NULL AND (wer > 0.45 OR bleu < 25 OR chrf < 45)) AS w FROM k_comp GROUP BY media) c USING (media)
  LEFT JOIN (SELECT media, list_sort(list(code)) AS codes FROM w_tax GROUP BY media) x USING (media)),
w_route AS (SELECT media, n, CASE WHEN w >= 2 OR len(codes) > 0 THEN 'review_required' WHEN n = 1 OR m = 0 OR w > 0 THEN 'warning' ELSE 'ok' END AS status,
  list_concat(list_filter([CASE WHEN n = 1 THEN 'benchmark.single_candidate_only' END, CASE WHEN m = 0 THEN 'benchmark.no_comparisons' END,
    CASE WHEN w >= 2 THEN 'benchmark.quality_below_threshold' WHEN w > 0 THEN 'benchmark.quality_borderline' END], lambda z: z IS NOT NULL), codes) AS reason_codes FROM w_t),
w_docs AS (SELECT media, n, struct_pack(status := status, reason_codes := reason_codes) AS routing FROM w_route),
w_c AS (SELECT media, list(struct_pack(candidate_id := candidate_id, source := source) ORDER BY ord) AS l FROM k_cand GROUP BY media),
w_m AS (SELECT media, list(struct_pack(ref_id := ref_id, cand_id := cand_id, wer := wer, bleu := bleu, chrf := chrf) ORDER BY ord) AS l FROM k_comp GROUP BY media),
w_s AS (SELECT media, list(struct_pack(candidate_id := candidate_id, is_reference := is_reference, wer := wer, bleu := bleu, chrf := chrf,
  composite_score := round(composite, 6), rank := rank) ORDER BY ord) AS l FROM k_rank GROUP BY media)"""


@REG.query(rf"""WITH {Q_DOC} SELECT d.media, 0 AS part, regexp_replace(CAST(to_json(struct_pack(video := d.media, reference_id := f.reference_id,
    status := CASE WHEN d.n = 1 THEN 'single_candidate_only' ELSE 'ok' END, candidates := w_c.l, comparisons := coalesce(w_m.l, []), scorecards := w_s.l,
    review_task_routing := d.routing)) AS VARCHAR), ':0\.000([1-9])([,}}])', ':\1.0E-4\2', 'g') AS doc
  FROM w_docs d JOIN k_ref f USING (media) JOIN w_c USING (media) LEFT JOIN w_m USING (media) JOIN w_s USING (media)""")
def benchmark_documents(spark, d):
    """Written as JSON lines and read back."""
    out = folder(spark, "benchmark-results")
    benchmarks.write_benchmark_results(_docs(spark, d), out)
    lines = spark.read.text(out)
    return lines.select(F.get_json_object("value", "$.video").cast("bigint").alias("media"), F.lit(0).cast("bigint").alias("part"), F.col("value").alias("doc"))


# --- registry ---------------------------------------------------------------------------

@REG.query("""SELECT o_orderkey AS id, o_custkey AS media, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'""")
def read_tables(spark, d):
    t = lc.read_registry(spark, f"{d}/orders.parquet", order=(F.desc("o_orderdate"), F.desc("o_orderkey")), o_orderstatus="F", o_custkey=None)
    return t.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("media"), F.col("o_totalprice").alias("price"))


@REG.query("""WITH i AS (SELECT event_id AS ord, event_id % 5000 AS run_id, CASE WHEN event_id % 3 = 0 THEN value END AS wer,
    CASE WHEN event_id % 4 <> 0 THEN round(value * 2, 4) END AS m_wer, round(value + 1, 4) AS m_bleu FROM events),
  e AS (SELECT DISTINCT event_id % 300 AS run_id FROM events WHERE event_id % 2 = 0)
  SELECT ord, run_id, coalesce(wer, m_wer) AS wer, m_bleu AS bleu, CAST(NULL AS DOUBLE) AS chrf FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS rn FROM i)
  WHERE rn = 1 AND run_id NOT IN (SELECT run_id FROM e)""")
def record_runs(spark, d):
    e = v.table(spark, d, "events")
    i, x = F.col("event_id"), F.col("value")
    js = F.to_json(F.struct(F.when(i % 4 != 0, F.round(x * 2, 4)).alias("wer"), F.round(x + 1, 4).alias("bleu"), F.lit("n/a").alias("note")))
    inc = e.select(i.alias("ord"), (i % 5000).alias("run_id"), F.when(i % 3 == 0, x).alias("wer"), F.lit(None).cast("double").alias("bleu"),
                   F.lit(None).cast("double").alias("chrf"), js.alias("metrics"))
    old = e.filter("event_id % 2 = 0").select((i % 300).alias("run_id"))
    return lc.record_runs(old, inc)[0].select("ord", "run_id", "wer", "bleu", "chrf")


@REG.query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3) THEN 'skipped' ELSE 'todo' END AS status FROM orders""")
def skip_existing(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    done = v.table(spark, d, "lineitem").filter("l_linenumber = 3").select(F.col("l_orderkey").alias("id"))
    return lc.skip_existing(o, done, "id")


_ADD = ("lower(trim(coalesce(nullif(source_lang, ''), 'ja'))) AS source_lang, lower(trim(coalesce(nullif(target_lang, ''), 'en'))) AS target_lang, "
        "trim(domain) AS domain, " + ", ".join(f"{v.sql_strip(f'coalesce({c}, {chr(39)}{chr(39)})')} AS {c}" for c in (
            "source_text", "bad_translation", "approved_translation", "previous_context", "next_context")))


@REG.query(f"""WITH {v.Q_CORR} SELECT {_ADD}, array_to_string(list_sort(list_distinct(list_filter(list_transform(tags, lambda t: trim(t)), lambda t: t <> ''))), ',') AS tags,
  language_pack FROM v_corr WHERE {v.sql_strip("coalesce(source_text, '')")} <> '' AND {v.sql_strip("coalesce(approved_translation, '')")} <> ''""")
def add_corrections(spark, d):
    """The store after the append, read back."""
    store = folder(spark, "corrections")
    co.add_corrections(v.corrections(spark, d), store)
    return co.read_corrections(spark, store).select("source_lang", "target_lang", "domain", "source_text", "bad_translation", "approved_translation",
                                                    "previous_context", "next_context", F.array_join("tags", ",").alias("tags"), "language_pack")


Q_CHILD = v.Q_CUES + """,
c_ed AS (SELECT media, CASE WHEN (media + idx) % 7 = 0 THEN idx + 100000 ELSE idx END AS idx, 'fixed ' || line AS new_text FROM v_cues WHERE (media + idx) % 3 = 0),
c_all AS (SELECT c.media AS task_id, 'sub.review_t' || c.media AS child_id, c.media, c.cand, c.idx, c.start_ms, c.end_ms, coalesce(e.new_text, c.text) AS text, e.new_text IS NOT NULL AS edited
  FROM v_cues c LEFT JOIN c_ed e USING (media, idx) WHERE c.media % 2 = 0)"""


def _children(spark, d):
    c = v.cues(spark, d).select("media", "cand", "idx", "start_ms", "end_ms", "text", "line")
    k = F.col("media") + F.col("idx")
    e = c.filter(k % 3 == 0).select("media", "cand", F.when(k % 7 == 0, F.col("idx") + 100_000).otherwise(F.col("idx")).alias("idx"),
                                    F.concat(F.lit("fixed "), "line").alias("new_text"))
    tasks = c.filter("media % 2 = 0").select("media", "cand").distinct().select(F.col("media").alias("task_id"), F.lit("sub").alias("source_id"), "media", "cand")
    return lc.approved_children(tasks, c.drop("line"), e)


@REG.query(f"WITH {Q_CHILD} SELECT * FROM c_all")
def approved_children(spark, d):
    return _children(spark, d)[0]


@REG.query(f"WITH {Q_CHILD} SELECT task_id, child_id, 'task_approved' AS action, count(*) FILTER (edited) AS edit_count, count(*) AS cue_count FROM c_all GROUP BY ALL")
def approval_events(spark, d):
    return _children(spark, d)[1]


# --- packs and metadata -----------------------------------------------------------------

@REG.query(f"""WITH {v.Q_MEDIA}, c AS (SELECT *, lower(trim(coalesce(raw_language, ''))) AS code FROM v_str WHERE kind = 'audio'),
  p AS (SELECT *, CASE WHEN code = '' THEN 'ja' WHEN code IN ('jpn', 'ja-jp') THEN 'ja' WHEN code = 'spa' THEN 'es' WHEN code IN ('eng', 'en-au') THEN 'en' END AS l FROM c)
  SELECT media, ord, l || '_en' AS pack_id, CASE WHEN l = 'en' THEN 'transcription_only' WHEN l IS NOT NULL THEN 'translate' END AS workflow FROM p""")
def pack_of_track(spark, d):
    s = catalog.explode_streams(r.media(spark, d)).filter("kind = 'audio'")
    out = packs.pack_of_track(s, "en", packs.pack_table(spark), packs.alias_table(spark), tag="raw_language", untagged="ja")
    return out.select("media", "ord", "pack_id", "workflow")


@REG.query("""SELECT 'term' AS kind, CASE WHEN n_nationkey % 4 = 0 THEN 'domain' ELSE 'language' END AS scope, lower(n_name) AS source,
    CASE WHEN n_nationkey % 8 = 0 THEN 'Y ' WHEN n_nationkey % 4 = 0 THEN 'X ' ELSE '' END || n_name AS target, n_nationkey % 4 = 0 AS required FROM nation
  UNION ALL SELECT 'name', 'domain', lower(r_name), r_name, true FROM region""")
def pack_glossary(spark, d):
    """Glossaries of a language pack and two domain packs, written as pack files and read with the higher layers on top."""
    n, g = v.table(spark, d, "nation"), v.table(spark, d, "region")
    key, name = F.col("n_nationkey"), F.col("n_name")

    def entry(kind, source, target, required):
        return F.struct(F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"), F.lit(required).cast("string").alias("required"))

    def pack(rows, entries, **fields):
        # A pack is one document, as long as its word list.
        return rows.agg(F.sort_array(F.collect_list(entries)).alias("glossary")).select(*[F.lit(x).alias(k) for k, x in fields.items()], "glossary")

    ja = pack(n, entry("term", F.lower(name), name, None), pack_id="ja_en", kind="language", source_language="ja", target_language="en")
    trade = pack(n.filter(key % 4 == 0).select(entry("term", F.lower(name), F.concat(F.lit("X "), name), "true").alias("e")).unionByName(
        g.select(entry("name", F.lower("r_name"), F.col("r_name"), None).alias("e"))), F.col("e"), pack_id="trade", kind="domain")
    own = pack(n.filter(key % 8 == 0), entry("term", F.lower(name), F.concat(F.lit("Y "), name), "yes"), pack_id="own", kind="domain", layer=5)
    out = folder(spark, "packs")
    for p in (ja, trade, own):
        p.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(out)
    files = packs.read_packs(spark, out)
    return terms.glossary_entries(packs.glossary_rows(files, ["ja_en", "trade", "own"])).select("kind", "scope", "source", "target", "required")


@REG.query("""WITH w AS (SELECT o_custkey AS media_hash, o_orderstatus AS file_path, o_orderkey AS ord, CAST(o_orderdate AS DATE) AS ts, o_orderkey % 3 AS b,
    CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE o_orderpriority END AS priority FROM orders)
  SELECT media_hash, arg_max(file_path, struct_pack(a := ts, b := ord)) AS file_path, arg_max(priority, struct_pack(a := ts, b := ord)) AS priority,
    strftime(min(ts), '%Y-%m-%d') AS created_at, strftime(max(ts), '%Y-%m-%d') AS updated_at FROM w GROUP BY media_hash""")
def registry_compaction(spark, d):
    """All orders as registry writes in three batches, the first of an older schema, compacted behind the second; read by merging."""
    o = v.table(spark, d, "orders")
    key = F.col("o_orderkey")
    w = o.select(F.col("o_custkey").alias("media_hash"), F.col("o_orderstatus").alias("file_path"), F.col("o_orderdate").cast("date").alias("ts"),
                 key.alias("ord"), F.col("o_orderpriority").alias("priority"))
    root, columns, added = folder(spark, "registry"), ["file_path", "priority"], [registry_table.Added(2, "priority", "string", "unknown")]
    registry_table.append(w.filter(F.col("ord") % 3 == 0).drop("priority"), root, 1)
    registry_table.append(w.filter(F.col("ord") % 3 == 1), root, 2)
    registry_table.compact(spark, root, columns, 2, added=added)
    registry_table.append(w.filter(F.col("ord") % 3 == 2), root, 2)
    out = registry_table.current(spark, root, columns, added=added)
    return out.select("media_hash", "file_path", "priority", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("created_at", "updated_at")])


@REG.query("""SELECT source || '-' || doc_id || '_transcription_only' AS candidate_id, 'en' AS language, 'transcription_only' AS translation_workflow,
  CASE WHEN doc_id % 3 = 0 THEN 'kept' ELSE 'none' END AS translation_engine, true AS translation_skipped FROM documents WHERE lang = 'en'""")
def passthrough(spark, d):
    c = v.table(spark, d, "documents").filter("lang = 'en'").select(
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("candidate_id"), F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 3 == 0, "kept").alias("translation_engine"))
    return packs.passthrough(c, "en")


@REG.query(f"""WITH {v.Q_MEDIA}, a AS (SELECT media, min(struct_pack(p := CASE language WHEN 'en' THEN 0 WHEN 'ja' THEN 1 END, o := ord)) AS b FROM v_str
    WHERE kind = 'audio' AND language IN ('en', 'ja') GROUP BY media)
  SELECT m.media, coalesce(a.b.o, 0) AS audio_ord FROM (SELECT DISTINCT media FROM v_str) m LEFT JOIN a USING (media)""")
def choose_audio(spark, d):
    return catalog.choose_audio(catalog.explode_streams(r.media(spark, d)), preferred=("eng", "ja"))


Q_META = """
j_meta AS (SELECT conv_id, turn, trim(text) AS t, conv_id + turn AS k, role FROM conversations)"""


def metas(spark, d):
    """Cue metadata as JSON text; some of it incomplete, odd or no JSON at all."""
    c = v.table(spark, d, "conversations")
    k = F.col("conv_id") + F.col("turn")
    warning = F.struct(F.col("role").alias("type"), F.when(k % 2 == 0, F.concat(F.lit("seen in "), "role")).alias("detail"))
    js = F.to_json(F.struct(F.when(k % 3 == 0, F.col("text")).when(k % 3 == 1, "").alias("source_text_ja"),
                            F.when(k % 5 != 0, F.replace(F.col("text"), F.lit("e"), F.lit("E"))).alias("source_text"),
                            F.when(k % 4 == 0, F.round(k % 100 / 100, 2).cast("string")).when(k % 4 == 1, "bad").alias("ocr_confidence"),
                            F.when(k % 6 == 0, F.struct(F.array(warning, warning).alias("warnings"))).alias("asr")))
    return c.select("conv_id", "turn", F.when(k % 11 == 0, "{broken").otherwise(js).alias("meta"))


@REG.query(f"""WITH {Q_META} SELECT conv_id, turn, CASE WHEN k % 11 = 0 THEN '' WHEN k % 3 = 0 AND t <> '' THEN t WHEN k % 5 <> 0 THEN replace(t, 'e', 'E') ELSE '' END AS source_text,
  k % 11 <> 0 AND k % 4 IN (0, 1) AS has_ocr, CASE WHEN k % 11 <> 0 AND k % 4 = 0 THEN round(k % 100 / 100, 2) ELSE 0 END AS ocr_confidence,
  CASE WHEN k % 11 <> 0 AND k % 6 = 0 THEN 2 ELSE 0 END AS n_warnings FROM j_meta""")
def meta_get(spark, d):
    has, conf = meta.ocr_confidence(F.col("meta"))
    return metas(spark, d).select("conv_id", "turn", meta.source_text(F.col("meta")).alias("source_text"), has.alias("has_ocr"),
                                  conf.alias("ocr_confidence"), F.size(meta.asr_warnings(F.col("meta"))).cast("bigint").alias("n_warnings"))


@REG.query(f"""WITH {Q_META}, m AS (SELECT *, CASE WHEN k % 4 = 0 THEN round(k % 100 / 100, 2) ELSE 0 END AS conf FROM j_meta WHERE k % 11 <> 0)
  SELECT conv_id AS media, 'dialogue' AS cand, turn + 1 AS cue_index, 'asr_low_confidence' AS type, 'warning' AS severity,
    'ASR warning ' || role || ': ' || CASE WHEN k % 2 = 0 THEN 'seen in ' || role ELSE 'low confidence source segment' END AS detail
  FROM m, (SELECT unnest([1, 2])) WHERE k % 6 = 0
  UNION ALL SELECT conv_id, 'dialogue', turn + 1, 'ocr_low_confidence', 'warning', printf('OCR confidence %.2f is below threshold 0.70', conf) FROM m WHERE k % 4 IN (0, 1) AND conf < 0.7
  UNION ALL SELECT DISTINCT conv_id, 'dialogue', -1, 'asr_source_warning', 'warning', CASE WHEN conv_id % 2 = 0 THEN 'track ' || conv_id ELSE 'ASR source selection warning' END
    FROM conversations WHERE turn = 1""")
def asr_ocr_passthrough(spark, d):
    has, conf = meta.ocr_confidence(F.col("meta"))
    c = metas(spark, d).select(F.col("conv_id").alias("media"), F.lit("dialogue").alias("cand"), F.col("turn").alias("idx"),
                               meta.asr_warnings(F.col("meta")).alias("asr_warnings"), has.alias("has_ocr"), conf.alias("ocr_confidence"))
    first = v.table(spark, d, "conversations").filter("turn = 1").select(F.col("conv_id").alias("media")).distinct()
    source = first.select("media", F.lit("dialogue").alias("cand"), F.when(F.col("media") % 2 == 0, F.concat(F.lit("track "), F.col("media").cast("string"))).alias("detail"))
    return qc.asr_ocr_passthrough(c, v.TRACK, source_warnings=source)


@REG.query(f"""WITH {Q_ASR.replace("event_type || ' '", "CASE WHEN event_id % 3 = 0 THEN '先輩と学園祭' ELSE event_type END || ' '")},
  s AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS dense FROM a_win),
  j AS (SELECT *, length(dense) - length(regexp_replace(dense, '[぀-ヿ㐀-䶿一-鿿]', '', 'g')) AS ja FROM s)
  SELECT media, cand, idx, length(trim(text)) >= 3 AND CASE WHEN length(dense) > 0 THEN ja / length(dense) ELSE 0 END < 0.2 AS low_japanese FROM j""")
def asr_warnings_japanese(spark, d):
    c = asr_cues(spark, d).withColumn("text", F.when(F.col("ord") % 3 == 0, F.regexp_replace("text", "^[^ ]*", "先輩と学園祭")).otherwise(F.col("text")))
    w = asr.asr_cue_warnings(c, v.TRACK, language="ja")
    return w.select(*v.TRACK, "idx", F.exists("warnings", lambda x: x["type"] == "low_japanese_character_ratio").alias("low_japanese"))


@REG.query("""WITH t AS (SELECT conv_id, turn, text || chr(13) || chr(10) || '  x' || chr(9) || role AS t FROM conversations)
  SELECT conv_id, turn, trim(regexp_replace(replace(t, chr(13), ''), '\\s+', ' ', 'g')) AS line FROM t""")
def one_line(spark, d):
    t = F.concat("text", F.lit("\r\n  x\t"), "role")
    return v.table(spark, d, "conversations").select("conv_id", "turn", tx.one_line(t).alias("line"))


@REG.query("""SELECT conv_id, turn, '先輩' || chr(124) || role || chr(124) || trim(text) AS parts FROM conversations""")
def strip_cjk_all(spark, d):
    parts = F.array(F.lit("先輩"), F.concat(F.lit("学園祭 "), "role"), F.trim("text"))
    return v.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(tx.strip_cjk_all(parts), "|").alias("parts"))


# --- written datasets, read back --------------------------------------------------------

Q_PAIR = v.Q_LINES + """,
p_pair AS (SELECT media, idx + 1 AS index, (media * 7 + idx * 13) % 100 / 100.0 AS similarity, line AS japanese_text, replace(line, 'e', 'E') AS generated_translation,
  lower(line) AS reference_translation, source FROM v_lines)"""


def pairs(spark, d, doc=None):
    x = v.lines(spark, d, doc)
    return x.select("media", (F.col("idx") + 1).alias("index"), ((F.col("media") * 7 + F.col("idx") * 13) % 100 / 100.0).alias("similarity"),
                    F.col("line").alias("japanese_text"), F.replace(F.col("line"), F.lit("e"), F.lit("E")).alias("generated_translation"), F.lower("line").alias("reference_translation"), "source")


PAIR = "media bigint, index bigint, similarity double, japanese_text string, generated_translation string, reference_translation string"
_PAIR = "media, index, similarity, japanese_text, generated_translation, reference_translation"


@REG.query(f"WITH {Q_PAIR} SELECT {_PAIR}, 'jsonl' AS fmt FROM p_pair UNION ALL SELECT {_PAIR}, 'csv' FROM p_pair")
def write_training_pairs(spark, d):
    p, out = pairs(spark, d).select(*_PAIR.split(", ")), folder(spark, "pairs")
    for fmt in ("jsonl", "csv"):
        training.write_training_pairs(p, f"{out}/{fmt}", fmt, compression="gzip")
    js = spark.read.schema(PAIR).json(f"{out}/jsonl").withColumn("fmt", F.lit("jsonl"))
    cs = (spark.read.schema(PAIR).option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false")
          .option("ignoreTrailingWhiteSpace", "false").option("multiLine", "true").csv(f"{out}/csv").withColumn("fmt", F.lit("csv")))
    return js.unionByName(cs)


@REG.query(f"""WITH {Q_PAIR}, t AS (SELECT unnest(['Japanese: ' || japanese_text, 'Generated: ' || generated_translation, 'Reference: ' || reference_translation, '']) AS line FROM p_pair)
  SELECT line, count(*) AS n FROM t GROUP BY ALL""")
def write_pair_texts(spark, d):
    out = folder(spark, "pair-texts")
    training.write_training_pairs(pairs(spark, d), out, "txt")
    return spark.read.option("lineSep", "\n").text(out).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@REG.query(f"WITH {Q_PAIR} SELECT media, index, similarity, 't' || (media % 5) AS source_video FROM p_pair")
def merge_datasets(spark, d):
    """One folder per title, read as one table with the title from the path."""
    p, out = pairs(spark, d, v.documents_in_place(spark, d)).select(*_PAIR.split(", ")), folder(spark, "titles")
    # A title's documents are picked before their texts are cut, so no pair is written but in its title's folder.
    for i in range(5):
        training.write_training_pairs(p.filter(F.col("media") % 5 == i), f"{out}/t{i}/pairs", compression="gzip")
    return training.read_merged(spark, [f"{out}/t{i}/pairs" for i in range(5)], PAIR).select("media", "index", "similarity", "source_video")


@REG.query(f"""WITH {Q_PAIR}, s AS (SELECT index - 1 AS generated_index, index AS reference_index, similarity, CAST(media % 7 AS DOUBLE) AS time_diff,
    generated_translation AS generated_text, reference_translation AS reference_text FROM p_pair)
  SELECT *, 'csv' AS fmt FROM s UNION ALL SELECT *, 'json' FROM s""")
def write_per_segment(spark, d):
    s = pairs(spark, d).select((F.col("index") - 1).alias("generated_index"), F.col("index").alias("reference_index"), "similarity",
                               (F.col("media") % 7).cast("double").alias("time_diff"), F.col("generated_translation").alias("generated_text"),
                               F.col("reference_translation").alias("reference_text"))
    out = folder(spark, "per-segment")
    training.write_per_segment(s, f"{out}/csv", as_csv=True)
    training.write_per_segment(s, f"{out}/json")
    schema = s.schema
    cs = (spark.read.schema(schema).option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false")
          .option("ignoreTrailingWhiteSpace", "false").option("multiLine", "true").csv(f"{out}/csv").withColumn("fmt", F.lit("csv")))
    return cs.unionByName(spark.read.schema(schema).json(f"{out}/json").withColumn("fmt", F.lit("json")))


@REG.query("""SELECT event_id AS file, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, value AS drift FROM events""")
def append_run_log(spark, d):
    """Two appends to one log, read back."""
    e = v.table(spark, d, "events").select(F.col("event_id").alias("file"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
                                           F.col("value").alias("drift"))
    out = folder(spark, "run-log")
    training.append_log(e.filter("status = 'failed'"), out)
    training.append_log(e.filter("status <> 'failed'"), out)
    return spark.read.schema(e.schema).json(out)
