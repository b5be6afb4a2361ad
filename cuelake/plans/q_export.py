"""Queries on timing repair, rendering, training pairs and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import timecode as tc
from cuelake.operators import lifecycle as lc
from cuelake.operators import timing, training
from cuelake.plans import views as v
from cuelake.plans.q_align import Q_TOL, tolerant_texts
from cuelake.operators import align as al
from cuelake.plans.registry import REG

K = v.TRACK


def timed(spark, d):
    return v.cues(spark, d).select(*K, "idx", "start_ms", "end_ms", "text")


def _repaired(rows: str, order: str) -> str:
    """A fold over a track in order: the earlier cue shrinks, else the later one moves (gap 50 ms, least length 500 ms)."""
    return f"""r_lists AS (SELECT media, cand, list(r ORDER BY {order}) AS rows FROM (SELECT media, cand,
    {{'idx': idx, 'part': part, 's': CAST(start_ms AS BIGINT), 'e': CAST(end_ms AS BIGINT), 'text': text}} AS r FROM {rows}) GROUP BY ALL),
r_fold AS (SELECT media, cand, rows, list_reduce(rows, lambda a, x: CASE
    WHEN len(a.s) = 0 OR x.s >= a.e[-1] + 50 THEN {{'s': list_append(a.s, x.s), 'e': list_append(a.e, x.e)}}
    WHEN x.s - 50 >= a.s[-1] + 500 THEN {{'s': list_append(a.s, x.s), 'e': list_append(list_append(list_slice(a.e, 1, len(a.e) - 1), x.s - 50), x.e)}}
    ELSE {{'s': list_append(a.s, a.e[-1] + 50), 'e': list_append(a.e, greatest(x.e, a.e[-1] + 550))}} END,
    {{'s': CAST([] AS BIGINT[]), 'e': CAST([] AS BIGINT[])}}) AS f FROM r_lists),
r_rows AS (SELECT media, cand, unnest(rows) AS x, unnest(f.s) AS start_ms, unnest(f.e) AS end_ms FROM r_fold)"""


@REG.query(f"""WITH {v.Q_CUES}, t AS (SELECT media, cand, idx, 0 AS part, start_ms, greatest(end_ms, start_ms + 500) AS end_ms, text FROM v_cues),
{_repaired('t', 'r.s, r.e, r.idx')} SELECT media, cand, x.idx AS idx, start_ms, end_ms FROM r_rows""")
def repair_overlaps(spark, d):
    c = timed(spark, d).withColumn("end_ms", F.greatest("end_ms", F.col("start_ms") + 500))
    return timing.repair_overlaps(c, K).drop("_pos", "text")


@REG.query(f"""WITH {v.Q_CUES}, l AS (SELECT media, cand, idx, start_ms, greatest(end_ms, start_ms + 500) - start_ms AS dur, text FROM v_cues
    WHERE {v.sql_strip('text')} <> ''),
  p AS (SELECT *, CASE WHEN dur > 7000 OR length(text) > 80 THEN {v.sql_pieces('text')} ELSE [text] END AS pieces FROM l),
  u AS (SELECT *, len(pieces) AS n, unnest(pieces) AS piece, unnest(range(len(pieces))) AS part FROM p),
  t AS (SELECT media, cand, idx, part, start_ms + CAST(floor(part * dur / n) AS BIGINT) AS start_ms,
    start_ms + CAST(floor(part * dur / n) AS BIGINT) + least(CAST(floor(dur / n) AS BIGINT), 7000) AS end_ms,
    CASE WHEN n > 1 THEN {v.sql_strip('piece')} ELSE text END AS text FROM u),
{_repaired('t', 'r.s, r.e, r.idx, r.part')}
  SELECT media, cand, x.idx AS idx, x.part AS part, start_ms, end_ms, x.text AS text FROM r_rows WHERE end_ms - start_ms >= 500""")
def prepare_cues(spark, d):
    return timing.prepare_cues(timed(spark, d), K).drop("_pos")


def _ts(c: str) -> str:
    return (f"lpad(CAST({c} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({c} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || "
            f"lpad(CAST({c} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST({c} % 1000 AS VARCHAR), 3, '0')")


@REG.query(f"""WITH {v.Q_CUES}, n AS (SELECT *, row_number() OVER (PARTITION BY media, cand ORDER BY idx) AS number FROM v_cues)
  SELECT media, cand, (number - 1) // 10000 AS part, string_agg(number || chr(10) || {_ts('start_ms')} || ' --> ' || {_ts('end_ms')} || chr(10) ||
    {v.sql_strip('text')} || chr(10), chr(10) ORDER BY number) AS srt FROM n GROUP BY ALL""")
def render_srt(spark, d):
    return timing.render_srt(timing.srt_blocks(timed(spark, d), K, order="idx", simple=True), K)


@REG.query(f"WITH {v.Q_CUES} SELECT media, cand, idx, row_number() OVER (PARTITION BY media, cand ORDER BY start_ms, end_ms, idx) - 1 AS pos FROM v_cues")
def sort_cues(spark, d):
    from cuelake.ordered import dense_index
    return dense_index(timed(spark, d), K, "start_ms", ["end_ms", "idx"], name="pos").select(*K, "idx", "pos")


@REG.query(f"""WITH {v.Q_CAND} SELECT media, cand, idx, start_ms, end_ms, text, 'embedded' AS source, CAST(NULL AS VARCHAR) AS translation_engine FROM v_cues UNION ALL
  SELECT media, cand, idx, start_ms, end_ms, text, cand, CASE cand WHEN 'mt' THEN 'baseline' END FROM v_cand""")
def union_candidates(spark, d):
    ref = timed(spark, d).withColumn("source", F.lit("embedded"))
    cand = v.cand_cues(spark, d).withColumn("source", F.col("cand")).withColumn("translation_engine", F.when(F.col("cand") == "mt", "baseline"))
    return lc.union_tracks(ref, cand)


# --- training pairs --------------------------------------------------------------------

def logs(spark, d):
    doc = v.table(spark, d, "documents")
    keep = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")

    def seg(x, i):
        return F.struct((i * 4.5).cast("double").alias("start"), (i * 4.5 + 2).cast("double").alias("end"),
                        F.when(i % 4 != 0, x).alias("text"), F.when(i % 3 == 0, F.concat(F.lit("ja "), x)).alias("text_ja"))

    s = F.transform(keep, seg)
    body = F.when(F.col("doc_id") % 2 == 0, F.to_json(s)).otherwise(F.to_json(F.struct(s.alias("segments"))))
    return doc.select(F.col("doc_id").alias("media"), body.alias("value"))


Q_LOG = """
x_log AS (SELECT media, idx + 1 AS index, CASE WHEN idx % 3 = 0 THEN 'ja ' || line WHEN idx % 4 <> 0 THEN line ELSE '' END AS japanese_text,
  CAST(idx * 4.5 AS DOUBLE) AS start_time, CAST(idx * 4.5 + 2 AS DOUBLE) AS end_time FROM v_lines)"""


@REG.query(f"WITH {v.Q_LINES},{Q_LOG} SELECT * FROM x_log")
def read_segment_log(spark, d):
    return training.parse_segment_log(logs(spark, d)).drop("duration")


@REG.query(f"""WITH {Q_TOL},{Q_LOG}, m AS (SELECT o.media, o.cand, o.idx + 1 AS index, (o.media * 7 + o.idx * 13) % 100 / 100.0 AS similarity, c.text AS g, r.text AS t
    FROM o_tol o JOIN v_cand c USING (media, cand, idx) JOIN v_cues r ON r.media = o.media AND r.idx = o.right_idx)
  SELECT m.media, m.cand, m.index, m.similarity, x.japanese_text, {v.sql_strip('m.g')} AS generated_translation, {v.sql_strip('m.t')} AS reference_translation
  FROM m JOIN x_log x USING (media, index) WHERE similarity >= 0.3 AND similarity < 0.9""")
def training_pairs(spark, d):
    t = tolerant_texts(spark, d)
    matches = t.select(*K, (F.col("idx") + 1).alias("index"), ((F.col("media") * 7 + F.col("idx") * 13) % 100 / 100.0).alias("similarity"),
                       F.col("ref_text").alias("generated_text"), F.col("cand_text").alias("reference_text"))
    return training.training_pairs(matches, training.parse_segment_log(logs(spark, d)), ["media"], 0.3, 0.9, also=["cand"]).select(
        *K, "index", "similarity", "japanese_text", "generated_translation", "reference_translation").distinct()


@REG.query("SELECT count(*) AS total_pairs, count(DISTINCT source) AS total_videos, count(*) / count(DISTINCT source) AS avg_pairs_per_video FROM documents")
def dataset_summary(spark, d):
    return lc.dataset_summary(v.table(spark, d, "documents"), "source")


@REG.query("""SELECT page_id, '{"page_id":' || page_id || ',"file_path":"<redacted>","meta":{"origin_stream":"<redacted>","stream":"sidecar:<redacted>"}}' AS js FROM pages""")
def redact_metadata(spark, d):
    p = v.table(spark, d, "pages")
    js = F.to_json(F.struct("page_id", F.col("url").alias("file_path"), F.struct(
        F.col("html").alias("origin_stream"), F.concat(F.lit("sidecar:"), "url").alias("stream")).alias("meta")))
    return p.select("page_id", training.redact(js, report=True).alias("js"))


@REG.query("""WITH n AS (SELECT doc_id, doc_id % 5 AS k, lpad(CAST(doc_id % 100000 AS VARCHAR), 6, '1') AS six, lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS four FROM documents)
  SELECT doc_id, CASE k WHEN 0 THEN 'FC2-PPV-' || six WHEN 1 THEN 'CARIBBEANCOM-' || six || '-123' WHEN 2 THEN 'HEYZO-' || four
      WHEN 3 THEN 'ABC-' || CASE WHEN doc_id % 10000 < 10 THEN lpad(CAST(doc_id % 10000 AS VARCHAR), 2, '0') ELSE CAST(doc_id % 10000 AS VARCHAR) END END AS canonical_id,
    CASE k WHEN 0 THEN 'fc2_ppv' WHEN 1 THEN 'caribbean' WHEN 2 THEN 'heyzo' WHEN 3 THEN 'studio_serial' END AS id_family FROM n""")
def catalog_id(spark, d):
    """The four shipped pattern families, and names that hold only a generic word."""
    from cuelake.functions.names import catalog_id as cid
    i = F.col("doc_id")
    six, four = F.lpad((i % 100000).cast("string"), 6, "1"), F.lpad((i % 10000).cast("string"), 4, "0")
    name = (F.when(i % 5 == 0, F.concat(F.lit("in/fc2 ppv_"), six, F.lit(".mkv"))).when(i % 5 == 1, F.concat(F.lit("[Caribbeancom] "), six, F.lit("-123.mp4")))
            .when(i % 5 == 2, F.concat(F.lit("a/b/heyzo-"), four, F.lit(".avi"))).when(i % 5 == 3, F.concat(F.lit("(x) abc-"), four, F.lit(".mkv")))
            .otherwise(F.lit("movie.x264-720.mkv")))
    got = cid(name)
    return v.table(spark, d, "documents").select("doc_id", got["canonical_id"].alias("canonical_id"), got["id_family"].alias("id_family"))


@REG.query("SELECT event_id, CASE event_type WHEN 'click' THEN 'llama3' WHEN 'view' THEN 'qwen2.5:7b' WHEN 'error' THEN 'llama3.1' ELSE 'llama3' END AS retry_with FROM events")
def retry_model(spark, d):
    from cuelake.functions.names import retry_model as rm
    t = F.col("event_type")
    m = F.when(t == "click", "mistral").when(t == "view", "llama3").when(t == "error", "qwen2.5:7b").otherwise(t)
    return v.table(spark, d, "events").select("event_id", rm(m).alias("retry_with"))
