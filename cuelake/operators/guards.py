"""Guards on model output: drift, stock phrases, replies, change counts
(H15, H16, H25, J17, P3, P4, A17-A19, A22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.functions.timecode import fixed

# Filler replies that unrelated lines collapse into.
STOCK_PHRASES = (
    "sure thing.", "sure thing", "got it.", "got it", "here you go.", "here you go", "oh my god!",
    "oh my god", "okay.", "okay", "alright.", "alright")


def with_drift(cues: DataFrame, raw: str, new: str) -> DataFrame:
    """Add ``drift_reason`` and ``drift_detail``; NULL when the new text may stand.

    A lost noun outranks a changed length; of several lost nouns the smallest is named.
    """
    r, n = F.col(raw), F.col(new)
    lost = tx.let(F.lower(n), lambda low: F.array_min(F.filter(tx.proper_nouns(r), lambda x: ~low.contains(F.lower(x)))))
    c = cues.withColumn("_lost", lost)
    nr, nn = F.size(tx.words(r)).cast("bigint"), F.size(tx.words(n)).cast("bigint")
    off = (nr > 0) & ((nn * 10 > nr * 14) | (nn * 10 < nr * 6))
    reason = F.when(r == n, None).when(F.col("_lost").isNotNull(), "noun_change").when(off, "length_ratio")
    detail = F.when(r == n, None).when(F.col("_lost").isNotNull(), F.col("_lost")).when(off, fixed(nn, F.greatest(nr, F.lit(1)), 2))
    return c.withColumn("drift_reason", reason).withColumn("drift_detail", detail).drop("_lost")


def stock_phrase_collapse(cues: DataFrame, keys, raw: str, new: str) -> DataFrame:
    """Tracks whose differing lines all became one filler phrase."""
    norm = lambda c: F.lower(tx.strip(F.col(c)))
    g = cues.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(norm(new)).alias("lo"), F.max(norm(new)).alias("hi"),
                                F.min(norm(raw)).alias("rlo"), F.max(norm(raw)).alias("rhi"))
    return g.select(*keys, ((F.col("n") >= 2) & (F.col("lo") == F.col("hi")) & F.col("lo").isin(*STOCK_PHRASES)
                            & (F.col("rlo") != F.col("rhi"))).alias("collapsed"))


def guard(cues: DataFrame, keys, raw: str = "raw_text", new: str = "new_text", check_collapse: bool = True) -> DataFrame:
    """Accept or revert each new text; add ``text``, ``outcome`` and ``warning``."""
    c = with_drift(cues, raw, new)
    if check_collapse:
        c = c.join(stock_phrase_collapse(cues, keys, raw, new), list(keys))
    else:
        c = c.withColumn("collapsed", F.lit(False))
    bad = F.col("collapsed") | F.col("drift_reason").isNotNull()
    outcome = F.when(bad, "reverted").when(F.col(raw) == F.col(new), "unchanged").otherwise("polished")
    warn = F.when(F.col("collapsed"), "stock_phrase_collapse_reverted_to_literal").when(
        F.col("drift_reason").isNotNull(), F.concat(F.lit("drift_reverted_to_literal:"), "drift_reason"))
    return c.withColumn("text", F.when(bad, F.col(raw)).otherwise(F.col(new))).withColumn("outcome", outcome).withColumn("warning", warn)


def guard_stats(guarded: DataFrame, keys) -> DataFrame:
    """total, polished, reverted, unchanged per track."""
    o = F.col("outcome")
    return guarded.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(o == "polished").alias("polished"),
                                      F.count_if(o == "reverted").alias("reverted"), F.count_if(o == "unchanged").alias("unchanged"))


def change_stats(zipped: DataFrame, keys, fallback: DataFrame | None = None) -> DataFrame:
    """Changed and unchanged cues per track with status and change rate.

    ``zipped`` comes from ``zip_full``; tracks in ``fallback`` passed their input through.
    """
    keys = list(keys)
    s = zipped.groupBy(*keys).agg(F.count_if("changed").alias("_c"), F.count_if(~F.col("changed")).alias("_u"),
                                  F.count_if("in_a").alias("_raw"))
    if fallback is not None:
        s = s.join(fallback.select(*keys).distinct().withColumn("_fb", F.lit(True)), keys, "left")
    else:
        s = s.withColumn("_fb", F.lit(None).cast("boolean"))
    fb = F.coalesce("_fb", F.lit(False))
    s = s.select(*keys, F.when(fb, 0).otherwise(F.col("_c")).alias("segments_changed"),
                 F.when(fb, F.col("_raw")).otherwise(F.col("_u")).alias("segments_unchanged"),
                 F.when(fb, "fallback").when(F.col("_c") == 0, "no_change").otherwise("changed").alias("polish_status"))
    n = F.col("segments_changed") + F.col("segments_unchanged")
    return s.withColumn("polish_change_rate", F.when(n > 0, F.col("segments_changed") / n))


def numbered_reply(reply: Column) -> Column:
    """(pos, text) entries of ``N. text`` or ``N) text`` lines; blank texts are left out."""
    lines = F.filter(F.split(reply, "\n"), lambda x: x.rlike(r"^\s*\d+[.)]"))
    pairs = F.transform(lines, lambda x: F.struct(
        F.regexp_extract(x, r"^\s*(\d+)[.)]", 1).cast("bigint").alias("pos"),
        tx.strip(F.regexp_extract(x, r"^\s*\d+[.)]\s*(.*)", 1)).alias("text")))
    return F.filter(pairs, lambda p: p["text"] != "")


def apply_replies(cues: DataFrame, replies: DataFrame, keys, batch: int) -> DataFrame:
    """Put numbered batch replies back on their cues; a missing line keeps the text.

    ``replies``: keys, batch_no, reply. A number given twice: the last one counts.
    """
    keys = list(keys)
    r = replies.select(*keys, "batch_no", F.posexplode(numbered_reply(F.col("reply"))).alias("_at", "_e"))
    r = r.groupBy(*keys, "batch_no", F.col("_e.pos").alias("pos")).agg(F.max_by("_e.text", "_at").alias("reply_text"))
    c = cues.withColumn("batch_no", F.floor(F.col("idx") / batch).cast("bigint")).withColumn("pos", F.col("idx") % batch + 1)
    return c.join(r, [*keys, "batch_no", "pos"], "left").withColumn("new_text", F.coalesce("reply_text", "text"))
