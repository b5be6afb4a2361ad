"""Timed-text tables derived from the driver tables, in Spark and in SQL.

Every rule is row-local or uses built-in expressions that both engines evaluate alike.
Whole texts are used; nothing is cut or sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.session import made_once, spread, spread_few

TRACK = ["media", "cand"]


SPREAD = {"documents": "doc_id", "orders": "o_orderkey"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df, SPREAD[name]) if name in SPREAD else df


def _expr(s: str) -> Column:
    return F.expr(s)


# --- rules shared by both engines (plain SQL expressions) -------------------------------

START = ("greatest(0, idx * 4500 + (media * 37 + idx * 101) % 900"
         " - CASE WHEN (media + idx) % 23 = 0 THEN 6000 ELSE 0 END)")
DUR = "(300 + (length(text) * 37 + media * 7 + idx * 13) % 8600)"


def lines(spark: SparkSession, d: str, doc: DataFrame | None = None) -> DataFrame:
    """Non-blank lines of each document, numbered from 0."""
    return (table(spark, d, "documents") if doc is None else doc).select(F.col("doc_id").alias("media"), "lang", "source",
                      F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
                      .alias("idx", "line")).withColumn("idx", F.col("idx").cast("bigint"))


def _decorated(line: Column, media: Column, idx: Column) -> Column:
    k = media + idx
    return (F.when(k % 17 == 0, F.concat(F.lit("{\\an8}"), line))
            .when(k % 19 == 0, F.concat(F.lit("<i>"), line, F.lit("</i>")))
            .when(k % 29 == 0, F.replace(line, F.lit(" "), F.lit("\\N")))
            .when(k % 31 == 0, F.concat(line, F.lit(" 先輩と学園祭")))
            .otherwise(F.replace(line, F.lit(". "), F.lit(".\n"))))


def cues(spark: SparkSession, d: str, doc: DataFrame | None = None) -> DataFrame:
    """Reference cues: one per document line, with times derived from its place."""
    base = lines(spark, d, doc).withColumn("text", _decorated(F.col("line"), F.col("media"), F.col("idx")))
    return base.select("media", F.lit("ref").alias("cand"), "idx", _expr(START).alias("start_ms"),
                       _expr(f"{START} + {DUR}").alias("end_ms"), "text", "line", "lang")


def _track(ref: DataFrame, name: str, drop: int, scale: int, *text: Column) -> DataFrame:
    """Cues of a competing track: some dropped, the rest shifted in time."""
    shift = _expr(f"(media * 13 + idx * 29) % {scale} - {scale // 2}")
    return (ref.filter((F.col("media") + F.col("idx")) % drop != 0)
            .select("media", F.lit(name).alias("cand"), "idx",
                    F.greatest(F.lit(0), F.col("start_ms") + shift).alias("start_ms"),
                    F.greatest(F.lit(0), F.col("end_ms") + shift).alias("end_ms"), *text))


def cand_cues(spark: SparkSession, d: str, doc: DataFrame | None = None) -> DataFrame:
    """Two competing tracks per title: cues dropped, shifted in time, words changed."""
    ref = cues(spark, d, doc)
    w = F.split("line", " ")
    fewer = F.array_join(F.filter(w, lambda x, i: i % 5 != 4), " ")
    asr = F.when(F.col("media") % 3 == 0, F.lower("line")).otherwise(fewer)
    mt = F.when(F.col("idx") % 3 == 0, F.col("line")).otherwise(fewer)
    return _track(ref, "asr", 7, 1200, asr.alias("text")).unionByName(_track(ref, "mt", 4, 5000, mt.alias("text")))


def documents_in_place(spark: SparkSession, d: str) -> DataFrame:
    """The documents in the splits they are read in, if these are enough."""
    return spread_few(spark.read.parquet(f"{d}/documents.parquet"), SPREAD["documents"])


def cue_times(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reference and candidate cues without their texts; the documents are read once for both, and stay in their splits."""
    doc = documents_in_place(spark, d)
    ref = made_once(cues(spark, d, doc).select("media", "cand", "idx", "start_ms", "end_ms"), "times")
    return ref, _track(ref, "asr", 7, 1200).unionByName(_track(ref, "mt", 4, 5000))


def translation_cues(spark: SparkSession, d: str) -> DataFrame:
    """Source, literal and final text per cue."""
    c = cues(spark, d)
    k = F.col("media") + F.col("idx")
    fewer = F.array_join(F.filter(F.split("line", " "), lambda x, i: i % 3 != 1), " ")
    final = (F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.concat_ws(" ", "line", "line", "line"))
             .when(k % 5 == 0, fewer).when(k % 7 == 0, F.concat(F.lit("ok "), F.lower("line")))
             .otherwise(F.col("line")))
    source = (F.when(k % 6 == 0, F.concat("line", F.lit(" 先輩 太郎")))
              .when(k % 14 == 0, F.lit("short"))
              .when(k % 10 == 0, F.concat(F.lit("セックス "), F.col("line"))).otherwise(F.col("line")))
    return c.select("media", F.lit("final").alias("cand"), "idx", "start_ms", "end_ms",
                    source.alias("source_text"), F.when(k % 9 == 0, F.lit("")).otherwise(F.col("line"))
                    .alias("literal_text"), final.alias("text"))


def dialogue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("media"), F.lit("dialogue").alias("cand"),
        F.col("turn").alias("idx"), "role", "text")


def srt_files(spark: SparkSession, d: str, doc: DataFrame | None = None) -> DataFrame:
    """One SRT text per document, with the faults real files have."""
    doc = table(spark, d, "documents") if doc is None else doc
    keep = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")

    def block(line, i):
        k = F.col("doc_id") + i
        start = i * 4500 + k % 700
        end = start + 900 + k % 3000
        seq = F.when(k % 37 == 0, F.lit("x")).otherwise((i + 1).cast("string"))
        sep = F.when(k % 41 == 0, F.lit(".")).otherwise(F.lit(","))

        def ts(ms):
            def p(v, n):
                return F.lpad(v.cast("string"), n, "0")
            return F.concat(p(F.floor(ms / 3_600_000), 2), F.lit(":"), p(F.floor(ms / 60_000) % 60, 2),
                            F.lit(":"), p(F.floor(ms / 1000) % 60, 2), sep, p(ms % 1000, 3))
        return F.concat(seq, F.lit("\n"), ts(start), F.lit(" --> "), ts(end), F.lit("\n"), line)

    text = F.array_join(F.transform(keep, block), "\n\n")
    text = F.when(F.col("doc_id") % 3 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    return doc.select(F.concat(F.lit("srt/"), F.col("doc_id").cast("string"), F.lit(".srt")).alias("path"),
                      F.col("doc_id").alias("media"), F.concat(text, F.lit("\n")).alias("content"))


def asr_segments(spark: SparkSession, d: str) -> DataFrame:
    """Speech segments per user: confidences from the event value, time from its stamp."""
    e = table(spark, d, "events")
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    v = F.col("value")
    return e.select(
        F.col("user_id").alias("media"), F.lit("asr").alias("cand"), F.col("event_id").alias("ord"),
        ms.alias("start_ms"), (ms + F.col("event_id") * 37 % 15000).alias("end_ms"),
        F.concat("event_type", F.lit(" "), F.floor(v / 50).cast("bigint").cast("string")).alias("text"),
        F.round(F.col("event_id") % 100 / 100, 4).alias("no_speech_prob"),
        F.round(-v / 200, 4).alias("avg_logprob"),
        F.round(1 + F.col("event_id") % 17 / 10, 4).alias("compression_ratio"),
        F.when(F.col("event_id") % 11 != 0, F.round(F.col("event_id") % 97 / 97, 4)).alias("ocr_confidence"))


def corrections(spark: SparkSession, d: str) -> DataFrame:
    """Raw correction records made of conversation turns (some incomplete)."""
    c = table(spark, d, "conversations")
    k = F.col("conv_id") + F.col("turn")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("ord"),
        F.when(k % 3 == 0, F.lit(" JA ")).when(k % 3 == 1, F.lit("")).otherwise(F.lit("es")).alias("source_lang"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.lit("EN")).alias("target_lang"),
        F.when(k % 2 == 0, F.lit("anime")).otherwise(F.lit("")).alias("domain"),
        F.when(k % 13 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("text"))).alias("source_text"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.lower("text")).alias("bad_translation"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("fine: "), "text")).alias("approved_translation"),
        F.lit("").alias("previous_context"), F.col("role").alias("next_context"),
        F.lit(None).cast("string").alias("speaker"),
        F.array(F.lit("b"), F.concat(F.lit(" "), F.col("role")), F.lit(""), F.lit("b")).alias("tags"),
        F.lit("").alias("notes"), F.lit("ja_en").alias("language_pack"),
        F.lit(None).cast("string").alias("created_at"))


LANGS = ["jpn", "eng", "EN-AU", "fre", "und", "ja-JP", None, "spa"]


def media_json(spark: SparkSession, d: str) -> DataFrame:
    """Probe output as JSON text, one per order."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    langs = F.array(*[F.lit(x) for x in LANGS])

    def stream(i):
        kind = (k * 7 + i * 3) % 5
        codecs = F.array(*[F.lit(x) for x in ("subrip", "pgssub", "ass", "dvd_subtitle")])
        tags = F.struct(F.get(langs, ((k * 3 + i * 5) % 8).cast("int")).alias("language"),
                        F.when((k + i) % 6 == 0, "Japanese Audio").alias("title"))
        return F.struct(i.alias("index"), F.when(kind < 2, "audio").when(kind < 4, "subtitle").otherwise("video").alias("codec_type"),
                        F.get(codecs, ((k + i) % 4).cast("int")).alias("codec_name"), (1 + (k + i) % 3).alias("channels"),
                        F.lit("48000").alias("sample_rate"), tags.alias("tags"))

    n = (k % 7).cast("int")
    streams = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), stream))
    fmt = F.struct(F.lit("matroska").alias("format_name"), F.when(k % 9 == 0, "N/A").otherwise(
        (k % 5000).cast("string")).alias("duration"))
    return o.select(k.alias("media"), F.to_json(F.struct(F.coalesce(streams, F.array()).alias("streams"), fmt.alias("format"))).alias("value"))


# --- the same views as SQL -------------------------------------------------------------

Q_LINES = """
v_lines AS (
  SELECT doc_id AS media, lang, source, unnest(range(len(l))) AS idx, unnest(l) AS line FROM (
    SELECT doc_id, lang, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l
    FROM documents))"""

Q_CUES = Q_LINES + f""",
v_text AS (
  SELECT *, CASE WHEN (media + idx) % 17 = 0 THEN '{{\\an8}}' || line
    WHEN (media + idx) % 19 = 0 THEN '<i>' || line || '</i>'
    WHEN (media + idx) % 29 = 0 THEN replace(line, ' ', '\\N')
    WHEN (media + idx) % 31 = 0 THEN line || ' 先輩と学園祭'
    ELSE replace(line, '. ', '.' || chr(10)) END AS text FROM v_lines),
v_cues AS (
  SELECT media, 'ref' AS cand, idx, {START} AS start_ms, {START} + {DUR} AS end_ms, text, line, lang
  FROM v_text)"""

Q_CAND = Q_CUES + """,
v_fewer AS (
  SELECT *, array_to_string(list_filter(string_split(line, ' '), lambda x, i: (i - 1) % 5 <> 4), ' ') AS fewer
  FROM v_cues),
v_cand AS (
  SELECT media, 'asr' AS cand, idx, greatest(0, start_ms + (media * 13 + idx * 29) % 1200 - 600) AS start_ms,
    greatest(0, end_ms + (media * 13 + idx * 29) % 1200 - 600) AS end_ms,
    CASE WHEN media % 3 = 0 THEN lower(line) ELSE fewer END AS text
  FROM v_fewer WHERE (media + idx) % 7 <> 0
  UNION ALL
  SELECT media, 'mt', idx, greatest(0, start_ms + (media * 13 + idx * 29) % 5000 - 2500),
    greatest(0, end_ms + (media * 13 + idx * 29) % 5000 - 2500),
    CASE WHEN idx % 3 = 0 THEN line ELSE fewer END
  FROM v_fewer WHERE (media + idx) % 4 <> 0)"""

Q_TRANS = Q_CUES + """,
v_trans AS (
  SELECT media, 'final' AS cand, idx, start_ms, end_ms,
    CASE WHEN (media + idx) % 6 = 0 THEN line || ' 先輩 太郎' WHEN (media + idx) % 14 = 0 THEN 'short'
      WHEN (media + idx) % 10 = 0 THEN 'セックス ' || line ELSE line END AS source_text,
    CASE WHEN (media + idx) % 9 = 0 THEN '' ELSE line END AS literal_text,
    CASE WHEN (media + idx) % 11 = 0 THEN '' WHEN (media + idx) % 13 = 0 THEN line || ' ' || line || ' ' || line
      WHEN (media + idx) % 5 = 0
        THEN array_to_string(list_filter(string_split(line, ' '), lambda x, i: (i - 1) % 3 <> 1), ' ')
      WHEN (media + idx) % 7 = 0 THEN 'ok ' || lower(line) ELSE line END AS text
  FROM v_cues)"""

Q_DIALOGUE = """
v_dialogue AS (
  SELECT conv_id AS media, 'dialogue' AS cand, turn AS idx, role, text FROM conversations)"""

Q_SRT = """
v_srt_lines AS (
  SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (
    SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)),
v_srt_blocks AS (
  SELECT doc_id, i, line, (doc_id + i) AS k, i * 4500 + (doc_id + i) % 700 AS s,
    i * 4500 + (doc_id + i) % 700 + 900 + (doc_id + i) % 3000 AS e FROM v_srt_lines)"""

Q_ASR = """
v_asr AS (
  SELECT user_id AS media, 'asr' AS cand, event_id AS ord, epoch_us(ts) // 1000 AS start_ms,
    epoch_us(ts) // 1000 + event_id * 37 % 15000 AS end_ms,
    event_type || ' ' || CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS text,
    round(event_id % 100 / 100.0, 4) AS no_speech_prob, round(-value / 200, 4) AS avg_logprob,
    round(1 + event_id % 17 / 10.0, 4) AS compression_ratio,
    CASE WHEN event_id % 11 <> 0 THEN round(event_id % 97 / 97.0, 4) END AS ocr_confidence
  FROM events)"""

Q_CORR = """
v_corr AS (
  SELECT conv_id * 100 + turn AS ord,
    CASE WHEN (conv_id + turn) % 3 = 0 THEN ' JA ' WHEN (conv_id + turn) % 3 = 1 THEN '' ELSE 'es' END AS source_lang,
    CASE WHEN (conv_id + turn) % 5 = 0 THEN NULL ELSE 'EN' END AS target_lang,
    CASE WHEN (conv_id + turn) % 2 = 0 THEN 'anime' ELSE '' END AS domain,
    CASE WHEN (conv_id + turn) % 13 = 0 THEN '  ' ELSE ' ' || text END AS source_text,
    CASE WHEN (conv_id + turn) % 4 = 0 THEN '' ELSE lower(text) END AS bad_translation,
    CASE WHEN (conv_id + turn) % 17 = 0 THEN NULL ELSE 'fine: ' || text END AS approved_translation,
    '' AS previous_context, role AS next_context, ['b', ' ' || role, '', 'b'] AS tags,
    '' AS notes, 'ja_en' AS language_pack
  FROM conversations)"""


Q_MEDIA = """
v_streams AS (
  SELECT media, i AS idx, CASE WHEN (media * 7 + i * 3) % 5 < 2 THEN 'audio' WHEN (media * 7 + i * 3) % 5 < 4 THEN 'subtitle' ELSE 'video' END AS kind,
    (['subrip', 'pgssub', 'ass', 'dvd_subtitle'])[(media + i) % 4 + 1] AS codec, 1 + (media + i) % 3 AS channels,
    (['jpn', 'eng', 'EN-AU', 'fre', 'und', 'ja-JP', NULL, 'spa'])[(media * 3 + i * 5) % 8 + 1] AS raw_language,
    CASE WHEN (media + i) % 6 = 0 THEN 'Japanese Audio' END AS title
  FROM (SELECT o_orderkey AS media, unnest(range(o_orderkey % 7)) AS i FROM orders)),
v_str AS (
  SELECT *, CASE lower(raw_language) WHEN 'jpn' THEN 'ja' WHEN 'eng' THEN 'en' WHEN 'fre' THEN 'fr' ELSE lower(raw_language) END AS language,
    codec IN ('dvd_subtitle', 'pgssub', 'xsub') AS is_bitmap,
    row_number() OVER (PARTITION BY media, kind ORDER BY idx) - 1 AS ord FROM v_streams)"""


def sql_strip(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def sql_pieces(c: str, target: int = 80) -> str:
    """Pieces of at most ``target`` characters, cut in front of and behind sentence marks, as a fold over the parts."""
    cut = f"string_split(regexp_replace({c}, '([.!?;]\\s+)', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    fold = (f"list_reduce({cut}, lambda a, p: CASE WHEN a.cur <> '' AND length(a.cur) + length(p) > {target} "
            f"THEN {{'done': list_append(a.done, {sql_strip('a.cur')}), 'cur': p}} ELSE {{'done': a.done, 'cur': a.cur || p}} END, "
            "{'done': CAST([] AS VARCHAR[]), 'cur': ''})")
    whole = f"list_transform([{fold}], lambda a: CASE WHEN {sql_strip('a.cur')} <> '' THEN list_append(a.done, {sql_strip('a.cur')}) ELSE a.done END)[1]"
    return f"list_transform([{whole}], lambda x: CASE WHEN length({c}) <= {target} OR len(x) = 0 THEN [{c}] ELSE x END)[1]"
