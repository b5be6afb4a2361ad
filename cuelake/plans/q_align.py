"""Queries on cue alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import align as al
from cuelake.plans import views as v
from cuelake.plans.registry import REG
from cuelake.session import dealt_by_track, made_once

K = v.TRACK

# brute force: every reference cue against every candidate cue of its title
Q_OVER = v.Q_CAND + """,
o_pairs AS (
  SELECT c.media, c.cand, r.idx, c.idx AS right_idx,
    least(r.end_ms, c.end_ms) - greatest(r.start_ms, c.start_ms) AS overlap,
    abs((r.start_ms + r.end_ms) - (c.start_ms + c.end_ms)) AS dist
  FROM v_cues r JOIN v_cand c ON r.media = c.media),
o_best AS (
  SELECT media, cand, idx, max(overlap) AS overlap, min(dist) AS dist FROM o_pairs GROUP BY ALL),
o_align AS (
  SELECT b.media, b.cand, b.idx, CASE WHEN b.overlap > 0 THEN 'overlap' ELSE 'midpoint' END AS method,
    greatest(b.overlap, 0) AS overlap,
    min(CASE WHEN b.overlap > 0 AND p.overlap = b.overlap THEN p.right_idx
             WHEN b.overlap <= 0 AND p.dist = b.dist THEN p.right_idx END) AS right_idx
  FROM o_best b JOIN o_pairs p USING (media, cand, idx) GROUP BY ALL)"""


def ref_for_each(ref, cand):
    """Reference cues once per candidate track of the title."""
    tracks = cand.select("media", "cand").distinct()
    return ref.drop("cand").join(tracks, "media")


def aligned(spark, d):
    ref, cand = v.cue_times(spark, d)
    return al.align(ref_for_each(ref, cand), cand, K)


@REG.query(f"WITH {Q_OVER} SELECT media, cand, idx, right_idx, overlap FROM o_align WHERE method = 'overlap'")
def align_max_overlap(spark, d):
    ref, cand = v.cue_times(spark, d)
    return al.best_overlap(ref_for_each(ref, cand), cand, K)


@REG.query(f"WITH {Q_OVER} SELECT media, cand, idx, right_idx, method FROM o_align")
def align_overlap_then_midpoint(spark, d):
    return aligned(spark, d).select(*K, "idx", "right_idx", "method")


@REG.query(f"WITH {Q_OVER} SELECT o.media, o.cand, o.idx, min(p.right_idx) AS right_idx FROM o_best o "
           "JOIN o_pairs p USING (media, cand, idx) WHERE p.dist = o.dist GROUP BY ALL")
def nearest_midpoint(spark, d):
    ref, cand = v.cue_times(spark, d)
    return al.nearest(ref_for_each(ref, cand), cand, K, F.col("start_ms") + F.col("end_ms")).drop("distance")


Q_TOL = v.Q_CAND + """,
o_pairs AS (
  SELECT c.media, c.cand, c.idx, r.idx AS right_idx,
    least(r.end_ms, c.end_ms) - greatest(r.start_ms, c.start_ms) AS overlap,
    abs(r.start_ms - c.start_ms) AS dist
  FROM v_cand c JOIN v_cues r ON r.media = c.media),
o_best AS (
  SELECT media, cand, idx, max(overlap) AS overlap, min(dist) AS dist FROM o_pairs GROUP BY ALL),
o_tol AS (
  SELECT b.media, b.cand, b.idx,
    min(CASE WHEN b.overlap > 0 AND p.overlap = b.overlap THEN p.right_idx
             WHEN b.overlap <= 0 AND p.dist = b.dist AND p.dist <= 2000 THEN p.right_idx END) AS right_idx
  FROM o_best b JOIN o_pairs p USING (media, cand, idx) GROUP BY ALL)"""


def tolerant(spark, d):
    """Matches, and the times of the candidate's and the reference's cues."""
    ref, cand = v.cue_times(spark, d)
    return al.align_with_tolerance(cand, ref_for_each(ref, cand), K), cand, ref.drop("cand")


def tolerant_texts(spark, d):
    """Matched cues of the candidates with their texts and those of the reference."""
    pairs = made_once(tolerant(spark, d)[0].filter("right_idx IS NOT NULL"), "pairs")
    dealt_by_track(spark)
    return al.with_texts(pairs, v.cand_cues(spark, d), v.cues(spark, d).drop("cand"), K)


@REG.query(f"WITH {Q_TOL} SELECT media, cand, idx, right_idx FROM o_tol")
def align_with_tolerance(spark, d):
    return tolerant(spark, d)[0]


@REG.query(f"WITH {Q_TOL} SELECT media, cand, count(*) AS generated_count, count(right_idx) AS matched_count, "
           "count(right_idx) / count(*) AS match_rate FROM o_tol GROUP BY ALL")
def match_rate(spark, d):
    return al.match_rate(tolerant(spark, d)[0], K)


@REG.query(f"""WITH {Q_TOL} SELECT o.media, o.cand, sum(abs(c.start_ms - r.start_ms)) / (count(*) * 1000.0) AS avg_time_diff
  FROM o_tol o JOIN v_cand c USING (media, cand, idx) JOIN v_cues r ON r.media = o.media AND r.idx = o.right_idx
  GROUP BY ALL""")
def avg_time_diff(spark, d):
    m, cand, ref = tolerant(spark, d)
    bare = lambda t: t.withColumn("text", F.lit(""))
    return al.avg_time_diff(al.with_texts(m.filter("right_idx IS NOT NULL"), bare(cand), bare(ref), K), K)


Q_TEXTS = Q_OVER + f""",
o_texts AS (
  SELECT a.media, a.cand, a.idx, a.right_idx, r.start_ms AS ref_start, r.end_ms AS ref_end,
    {v.sql_strip('r.text')} AS ref_text, {v.sql_strip('c.text')} AS cand_text
  FROM o_align a JOIN v_cues r ON r.media = a.media AND r.idx = a.idx
  JOIN v_cand c ON c.media = a.media AND c.cand = a.cand AND c.idx = a.right_idx),
o_diffs AS (
  SELECT *, ref_text <> cand_text AND (abs(length(ref_text) - length(cand_text)) > 5
    OR lower(ref_text) <> lower(cand_text)) AS is_diff FROM o_texts)"""


def aligned_texts(spark, d):
    pairs = made_once(aligned(spark, d), "pairs")
    dealt_by_track(spark)
    return al.with_texts(pairs, v.cues(spark, d).drop("cand"), v.cand_cues(spark, d), K)


@REG.query(f"WITH {Q_TEXTS} SELECT media, cand, idx, ref_text, cand_text FROM o_diffs WHERE is_diff")
def select_diffs(spark, d):
    t = aligned_texts(spark, d)
    return t.filter(al.is_diff(F.col("ref_text"), F.col("cand_text"))).select(*K, "idx", "ref_text", "cand_text")


@REG.query(f"""WITH {v.Q_TRANS}, o AS (SELECT t.media, t.idx, t.text AS final_text,
    coalesce(c.text, '') AS other_text FROM v_trans t LEFT JOIN v_fc c USING (media, idx)) SELECT * FROM o""".replace(
    "o AS (", "v_fc AS (SELECT media, idx, line AS text FROM v_cues WHERE (media + idx) % 7 <> 0), o AS (", 1))
def zip_positional(spark, d):
    t = v.translation_cues(spark, d).drop("cand")
    c = v.cues(spark, d).filter((F.col("media") + F.col("idx")) % 7 != 0)
    return al.zip_positional(t, (c, "line", "other_text"), keys=["media"]).select(
        "media", "idx", F.col("text").alias("final_text"), "other_text")


Q_FULL = v.Q_CAND + f""",
o_a AS (SELECT * FROM v_cand WHERE cand = 'asr'), o_b AS (SELECT * FROM v_cand WHERE cand = 'mt'),
o_full AS (
  SELECT coalesce(a.media, b.media) AS media, coalesce(a.idx, b.idx) AS idx,
    coalesce(a.start_ms, b.start_ms) AS start_ms, coalesce(a.end_ms, b.end_ms) AS end_ms,
    a.text AS a_text, b.text AS b_text,
    NOT coalesce({v.sql_strip('a.text')} = {v.sql_strip('b.text')}, false) AS changed
  FROM o_a a FULL JOIN o_b b ON a.media = b.media AND a.idx = b.idx)"""


def zipped(spark, d):
    c = v.cand_cues(spark, d)
    return al.zip_full(c.filter("cand = 'asr'"), c.filter("cand = 'mt'"), ["media"])


@REG.query(f"WITH {Q_FULL} SELECT * FROM o_full")
def zip_full(spark, d):
    return zipped(spark, d).drop("in_a", "in_b")
