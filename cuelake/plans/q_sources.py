"""Queries on cue files, hashes and sidecars."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import align
from cuelake.operators import qc
from cuelake.plans import views as v
from cuelake.plans.q_records import folder
from cuelake.plans.registry import REG
from cuelake.sources import listed, srt


def _sql(where: str, text: str = "rtrim(line)", seq: str = "i + 1") -> str:
    return (f"WITH {v.Q_SRT} SELECT doc_id AS media, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, "
            f"CAST({seq} AS BIGINT) AS seq, s AS start_ms, e AS end_ms, {text} AS text FROM v_srt_blocks WHERE {where}")


def _read(spark, d, dialect):
    return srt.parse_srt(v.srt_files(spark, d).drop("path"), dialect)


@REG.query(_sql("k % 37 <> 0"))
def read_srt_qc(spark, d):
    return _read(spark, d, "qc")


@REG.query(_sql("k % 37 <> 0 AND k % 41 <> 0"))
def read_srt_corrector(spark, d):
    return _read(spark, d, "corrector")


@REG.query(_sql("k % 37 <> 0 AND k % 41 <> 0"))
def read_srt_compare(spark, d):
    return _read(spark, d, "compare")


@REG.query(_sql("true", "trim(line)", "NULL"))
def read_srt_tolerant(spark, d):
    return _read(spark, d, "tolerant")


@REG.query(_sql("k % 41 <> 0", seq="NULL"))
def read_srt_writer(spark, d):
    return _read(spark, d, "writer")


@REG.query(f"WITH {v.Q_SRT} SELECT doc_id AS media, count(*) AS segment_count, CAST(sum(e - s) AS BIGINT) AS total_ms FROM v_srt_blocks WHERE k % 37 <> 0 GROUP BY ALL")
def track_totals(spark, d):
    return align.track_totals(_read(spark, d, "qc"), ["media"])


def mixed_files(spark, d):
    """Each document as one of three cue formats."""
    doc = v.table(spark, d, "documents")
    keep = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")

    def vtt(x, i):
        return F.concat(F.lit("00:"), two(i % 60), F.lit(":01.500 --> 00:"), two(i % 60), F.lit(":03.250 line:0\n"), x)

    def ass(x, i):
        return F.concat(F.lit("Dialogue: 0,0:"), two(i % 60), F.lit(":01.50,0:"), two(i % 60), F.lit(":03.25,Default,,0,0,0,,"), x, F.lit("\\Nend"))

    kind = F.col("doc_id") % 3
    body = (F.when(kind == 0, F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(keep, vtt), "\n\n")))
            .otherwise(F.concat(F.lit("[Events]\nFormat: a\n"), F.array_join(F.transform(keep, ass), "\n"))))
    ext = F.when(kind == 0, "vtt").when(kind == 1, "ass").otherwise("ssa")
    return doc.select(F.col("doc_id").alias("media"), F.concat(F.lit("f/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), body.alias("content"))


@REG.query(f"""WITH {v.Q_LINES} SELECT media, idx, (idx % 60) * 60000 + 1500 AS start_ms, (idx % 60) * 60000 + 3250 AS end_ms,
  CASE WHEN media % 3 = 0 THEN {v.sql_strip('line')} ELSE {v.sql_strip('line')} || chr(10) || 'end' END AS text FROM v_lines""".replace(
    "|| chr(10) ||", "|| repeat(' ', length(line) - length(rtrim(line))) || chr(10) ||"))
def read_subtitles(spark, d):
    return srt.parse_subtitles(mixed_files(spark, d)).select("media", "idx", "start_ms", "end_ms", "text")


@REG.query("""WITH h AS (SELECT doc_id AS media, sha256(text) AS media_hash FROM documents)
  SELECT media, media_hash, count(*) OVER (PARTITION BY media_hash) AS copies FROM h""")
def content_hash(spark, d):
    return srt.content_hash(v.table(spark, d, "documents").select(F.col("doc_id").alias("media"), F.col("text").alias("content")))


@REG.query("""WITH m AS (SELECT o_custkey AS dir, o_orderkey AS media, 'ep' || (o_orderkey % 50) AS stem FROM orders),
  f AS (SELECT o_custkey AS dir, 'ep' || (o_orderkey % 50) || (['.en.srt', '_jpn.ass', '.txt', '.final-ENG.vtt'])[o_orderkey % 4 + 1] AS name, o_orderkey % 4 AS k FROM orders)
  SELECT m.media, m.dir, f.name, (['en', 'ja', 'x', 'en'])[f.k + 1] AS language FROM m JOIN (SELECT DISTINCT * FROM f) f ON f.dir = m.dir AND starts_with(f.name, m.stem) WHERE f.k <> 2""")
def discover_sidecars(spark, d):
    o = v.table(spark, d, "orders")
    k = F.col("o_orderkey")
    stem = F.concat(F.lit("ep"), (k % 50).cast("string"))
    end = F.get(F.array(*[F.lit(x) for x in (".en.srt", "_jpn.ass", ".txt", ".final-ENG.vtt")]), (k % 4).cast("int"))
    m = o.select(F.col("o_custkey").alias("dir"), k.alias("media"), stem.alias("stem"))
    f = o.select(F.col("o_custkey").alias("dir"), F.concat(stem, end).alias("name")).distinct()
    return srt.discover_sidecars(m, f).select("media", "dir", "name", "language")


def _files_of(spark, d, ending: str) -> str:
    """A folder with one file per document, under the document's number."""
    out = folder(spark, "listed")
    texts = v.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"))
    listed.write_files(texts, f"{out}/{ending}", "doc_id", "value")
    return out


def _doc_id(path: str = "path"):
    return F.regexp_extract(path, r"doc_id=(\d+)", 1).cast("bigint").alias("doc_id")


@REG.query("""SELECT doc_id, strlen(coalesce(text, '')) + 1 AS length, sha256(coalesce(text, '') || chr(10)) AS content_sha256,
  CAST(NULL AS VARCHAR) AS error FROM documents""")
def listed_files(spark, d):
    """Each document as a file, found by listing and read whole."""
    files = listed.listed_files(spark, _files_of(spark, d, "txt"), ["txt"])
    return files.select(_doc_id(), "length", F.sha2("content", 256).alias("content_sha256"), "error")


@REG.query("SELECT doc_id, strlen(coalesce(text, '')) + 1 AS length FROM documents")
def listed_media(spark, d):
    """Media files of a folder tree by ending, none of them opened."""
    return listed.listed_media(spark, _files_of(spark, d, "mov"), recursive=True, endings=["txt"]).select(_doc_id(), "length")


@REG.query(f"""WITH {v.Q_SRT}, n AS (SELECT doc_id, count(*) AS cues FROM v_srt_blocks WHERE k % 37 <> 0 GROUP BY ALL)
  SELECT doc_id, 'parse_failed' AS type, 'SRT file contains no parseable cue blocks' AS detail
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n)""")
def listed_parse_failed(spark, d):
    """Tracks in a listing that hold no cue, beside those that do."""
    out = folder(spark, "listed-cues")
    all_files = v.table(spark, d, "documents").select("doc_id").join(
        v.srt_files(spark, d).select(F.col("media").alias("doc_id"), F.col("content").alias("value")), "doc_id", "left")
    listed.write_files(all_files.select("doc_id", F.coalesce("value", F.lit("")).alias("value")), out, "doc_id", "value")
    files = listed.listed_files(spark, out, ["txt"])
    found = qc.file_violations(files.select("path", "error"), srt.parse_srt(files.select("path", "content"), "qc"), ["path"])
    return found.select(_doc_id(), "type", "detail")
