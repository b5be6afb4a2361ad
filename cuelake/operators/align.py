"""Pairing cues of two tracks by time or by position.

The time joins are equi-joins on (track, level, time bin); the level follows a cue's length. Copies of the same interval are
reduced to their first cue beforehand, since a later copy can never win, so a bin holds
at most as many partners as there are different intervals in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import strip
from cuelake.functions.timecode import overlap_ms
from cuelake.session import made_once

BIN_MS = 10_000
# Bins of the levels: 10 s, 80 s, 11 min, 85 min, 11 h, ... to 340 years.
SHIFT, LEVELS = 3, 11
GROWTH = 1 << SHIFT


def _bin(c: Column, width: int | Column) -> Column:
    return F.floor(c / width).cast("bigint")


def _first_of_interval(right: DataFrame, keys) -> DataFrame:
    return right.groupBy(*keys, "start_ms", "end_ms").agg(F.min("idx").alias("idx"))


def _level(length: Column, bin_ms: int) -> Column:
    """The first level whose bins are as long as the cue: bins of a level are ``GROWTH`` times those of the level below."""
    return sum(((length > bin_ms * GROWTH ** i).cast("int") for i in range(LEVELS - 1)), F.lit(0))


# Bins of the tag ``above`` have their levels counted from here.
ABOVE = 32


def _bins(first: Column, last: Column, level: Column, tag: int = 0) -> Column:
    """(level, bin) from the first to the last bin."""
    return F.transform(F.sequence(first, last), lambda b: F.struct((level + tag).alias("_lv"), b.alias("_bin")))


def _higher(s: Column, e: Column, level: Column, top: Column, bin_ms: int, tag: int = 0) -> Column:
    """The bins that [s, e) touches on all levels above one, up to the top; often there are none."""
    none = F.array().cast("array<struct<_lv:int,_bin:bigint>>")

    def own(v: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(bin_ms).cast("bigint"), v * SHIFT)
        return _bins(_bin(s, width), _bin(e - 1, width), v, tag)

    return F.when(top > level, F.flatten(F.transform(F.sequence(level + 1, F.greatest(top, level + 1)), own))).otherwise(none)


def _with_own(rows: DataFrame, s: Column, e: Column, bin_ms: int) -> DataFrame:
    """Rows with _own (level of the cue's length), _from and _to (the bins that [s, e) touches there), once a row and before any lambda."""
    width = F.call_function("shiftleft", F.lit(bin_ms).cast("bigint"), F.col("_own") * SHIFT)
    return (rows.withColumn("_own", _level(e - s, bin_ms)).withColumn("_width", width)
            .withColumn("_from", _bin(s, F.col("_width"))).withColumn("_to", _bin(e - 1, F.col("_width"))).drop("_width"))


def left_places(rows: DataFrame, s: Column, e: Column, other_top: Column, bin_ms: int = BIN_MS) -> DataFrame:
    """Rows with _lv, _bin: at the level of the cue's length, and (from ABOVE) on those above it as far as the other side goes."""
    own = F.col("_own")
    bins = F.concat(_bins(F.col("_from"), F.col("_to"), own), _higher(s, e, own, other_top, bin_ms, ABOVE))
    return _with_own(rows, s, e, bin_ms).select("*", F.inline_outer(F.when(e > s, bins))).drop("_own", "_from", "_to")


def right_places(rows: DataFrame, s: Column, e: Column, other_top: Column, bin_ms: int = BIN_MS) -> DataFrame:
    """The counterpart: the left's own level meets the right on all levels from its own on, its levels above meet the right's own."""
    own = F.col("_own")
    first, last = F.col("_from"), F.col("_to")
    bins = F.concat(_bins(first, last, own), _higher(s, e, own, other_top, bin_ms), _bins(first, last, own, ABOVE))
    return _with_own(rows, s, e, bin_ms).select("*", F.inline(bins)).drop("_own", "_from", "_to")


def _overlaps(left: DataFrame, right: DataFrame, keys, bin_ms: int) -> DataFrame:
    """Every left cue with its times and ``b`` = (overlap, -right idx) of its best partner, written once.

    Two cues meet on the level of the longer one, where that lies in one or two bins; so a cue of any length is
    at most two rows a level, and there are no more levels than the longest cue has. Nothing above a side's longest cue is emitted.
    """
    lk = left.select(*keys, "idx", F.col("start_ms").alias("ls"), F.col("end_ms").alias("le"))
    rk = (_first_of_interval(right, keys)
          .select(*keys, F.col("idx").alias("r_idx"), F.col("start_ms").alias("rs"),
                  F.col("end_ms").alias("re")).filter("re > rs"))
    ls, le, rs, re = F.col("ls"), F.col("le"), F.col("rs"), F.col("re")
    top = lambda df, name: df.agg(F.max(F.col("end_ms") - F.col("start_ms")).alias("_x")).select(_level(F.coalesce("_x", F.lit(0)), bin_ms).alias(name))
    # One row each.
    lb = left_places(lk.join(F.broadcast(top(right, "_top"))), ls, le, F.col("_top"), bin_ms).drop("_top")
    rb = right_places(rk.join(F.broadcast(top(left, "_top"))), rs, re, F.col("_top"), bin_ms).drop("_top")
    j = lb.join(rb, [*keys, "_lv", "_bin"], "left")
    ov = overlap_ms(ls, le, rs, re)
    # a pair seen in two bins gives the same value each time, so max needs no de-duplication
    best = F.max(F.when(rs.isNotNull() & (ov > 0), F.struct(ov.alias("ov"), (-F.col("r_idx")).alias("neg"))))
    # The nearest search reads those without a partner several times; the join is not to run again for it.
    return made_once(j.groupBy(*keys, "idx", "ls", "le").agg(best.alias("b")), "cue-best")


def _found(rows: DataFrame, keys) -> DataFrame:
    return rows.filter("b IS NOT NULL").select(*keys, "idx", (-F.col("b.neg")).alias("right_idx"),
                                               F.col("b.ov").alias("overlap"))


def _unmatched(rows: DataFrame, keys) -> DataFrame:
    return rows.filter("b IS NULL").select(*keys, "idx", F.col("ls").alias("start_ms"), F.col("le").alias("end_ms"))


def _times(cues: DataFrame, keys) -> DataFrame:
    """Keys, idx and times only, written once: the joins below read them several times, whatever it took to make the cues."""
    return made_once(cues.select(*keys, "idx", "start_ms", "end_ms"), "cue-times")


def best_overlap(left: DataFrame, right: DataFrame, keys, bin_ms: int = BIN_MS) -> DataFrame:
    """Arg-max overlap per left cue: keys, idx, right_idx, overlap. Ties: lowest right idx."""
    left, right = _times(left, keys), _times(right, keys)
    return _found(_overlaps(left, right, list(keys), bin_ms), keys)


def nearest(left: DataFrame, right: DataFrame, keys, point: Column, name: str = "right_idx",
            bin_width: int = 1 << 20) -> DataFrame:
    """Nearest right cue by ``point`` for each left cue; ties go to the lowest right idx.

    An as-of search in both directions. Points are put in slices; inside a slice a window
    finds the neighbours, and a table with one row per slice supplies the last point before
    and the first point after it.
    """
    keys = list(keys)
    r = (right.withColumn("_p", point).groupBy(*keys, "_p").agg(F.min("idx").alias("_ri"))
         .withColumn("_b", _bin(F.col("_p"), bin_width)))
    rows = left.select(*keys, "idx", point.alias("_p"))
    l = rows.select(*keys, "_p").distinct().withColumn("_b", _bin(F.col("_p"), bin_width))
    pt = F.struct(F.col("_p").alias("p"), F.col("_ri").alias("i"))
    nothing = F.lit(None).cast("struct<p:bigint,i:bigint>")
    both = (l.select(*keys, "_b", "_p", F.lit(1).alias("_side"), nothing.alias("_pt"))
            .unionByName(r.select(*keys, "_b", "_p", F.lit(0).alias("_side"),
                                  F.struct(F.col("_p").cast("bigint").alias("p"),
                                           F.col("_ri").cast("bigint").alias("i")).alias("_pt"))))
    fwd = Window.partitionBy(*keys, "_b").orderBy("_p", "_side")
    back = Window.partitionBy(*keys, "_b").orderBy(F.col("_p").desc(), F.col("_side"))
    near = (both.withColumn("_lo", F.last("_pt", True).over(fwd.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_hi", F.last("_pt", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
            .filter("_side = 1"))
    ends = (r.groupBy(*keys, "_b").agg(F.max(pt).alias("_mx"), F.min(pt).alias("_mn"))
            .unionByName(l.select(*keys, "_b").distinct()
                         .withColumn("_mx", nothing).withColumn("_mn", nothing))
            .groupBy(*keys, "_b").agg(F.max("_mx").alias("_mx"), F.min("_mn").alias("_mn")))
    along = Window.partitionBy(*keys).orderBy("_b")
    ends = (ends.withColumn("_before", F.last("_mx", True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("_after", F.first("_mn", True).over(along.rowsBetween(1, Window.unboundedFollowing)))
            .drop("_mx", "_mn"))
    got = (near.join(ends, [*keys, "_b"])
           .withColumn("_lo", F.coalesce("_lo", "_before")).withColumn("_hi", F.coalesce("_hi", "_after")))
    def choice(side: str) -> Column:
        return F.when(F.col(side).isNotNull(), F.struct(
            F.abs(F.col("_p") - F.col(f"{side}.p")).alias("d"), F.col(f"{side}.i").alias("i")))

    pick = F.least(choice("_lo"), choice("_hi"))
    best = got.withColumn("_best", pick).select(*keys, "_p", F.col("_best.i").alias(name),
                                                F.col("_best.d").alias("distance"))
    return rows.join(best, [*keys, "_p"]).drop("_p")


def align(ref: DataFrame, cand: DataFrame, keys, bin_ms: int = BIN_MS,
          max_distance_ms: int | None = None) -> DataFrame:
    """Pair each reference cue with its best candidate cue (J1 then J2).

    Greatest overlap first; a cue without any overlap takes the candidate cue with the
    nearest midpoint. Tracks without a partner track give no pairs.
    """
    keys = list(keys)
    ref, cand = _times(ref, keys), _times(cand, keys)
    rows = _overlaps(ref, cand, keys, bin_ms)
    over = _found(rows, keys).withColumn("method", F.lit("overlap")).withColumn(
        "distance", F.lit(None).cast("bigint"))
    rest = _unmatched(rows, keys)
    mid = F.col("start_ms") + F.col("end_ms")
    near = (nearest(rest, cand, keys, mid).filter("right_idx IS NOT NULL")
            .withColumn("method", F.lit("midpoint")).withColumn("overlap", F.lit(0).cast("bigint")))
    if max_distance_ms is not None:
        near = near.filter(F.col("distance") <= 2 * max_distance_ms)
    return over.unionByName(near)


def align_with_tolerance(gen: DataFrame, ref: DataFrame, keys, tolerance_ms: int = 2000,
                         bin_ms: int = BIN_MS) -> DataFrame:
    """Generated cue to reference cue: best overlap, else nearest start within tolerance.

    All generated cues are kept; ``right_idx`` is NULL for the unmatched ones.
    """
    keys = list(keys)
    gen, ref = _times(gen, keys), _times(ref, keys)
    rows = _overlaps(gen, ref, keys, bin_ms)
    over = _found(rows, keys).select(*keys, "idx", "right_idx")
    rest = _unmatched(rows, keys)
    near = (nearest(rest, ref, keys, F.col("start_ms"))
            .select(*keys, "idx", F.when(F.col("distance") <= tolerance_ms, F.col("right_idx")).alias("right_idx")))
    return over.unionByName(near)


def with_texts(pairs: DataFrame, ref: DataFrame, cand: DataFrame, keys) -> DataFrame:
    """Bring both cues' times and stripped texts to the index pairs.

    A side that stands for all tracks of the other comes without their key and is joined by the other keys, not multiplied.
    """
    keys = list(keys)
    ref_keys, cand_keys = ([k for k in keys if k in side.columns] for side in (ref, cand))
    l = ref.select(*ref_keys, "idx", F.col("start_ms").alias("ref_start"), F.col("end_ms").alias("ref_end"),
                   strip(F.col("text")).alias("ref_text"))
    r = cand.select(*cand_keys, F.col("idx").alias("right_idx"), F.col("start_ms").alias("cand_start"),
                    F.col("end_ms").alias("cand_end"), strip(F.col("text")).alias("cand_text"))
    return pairs.join(l, [*ref_keys, "idx"]).join(r, [*cand_keys, "right_idx"], "left")


def is_diff(ref_text: Column, cand_text: Column, threshold: int = 5) -> Column:
    """Texts differ, and by more than letter case or by a visible length."""
    gap = F.abs(F.length(ref_text) - F.length(cand_text))
    return (ref_text != cand_text) & ((gap > threshold) | (F.lower(ref_text) != F.lower(cand_text)))


def zip_positional(base: DataFrame, *others: tuple[DataFrame, str, str], keys) -> DataFrame:
    """Add ``other.text`` by position; a missing cue gives an empty text."""
    out = base
    for df, col, name in others:
        out = out.join(df.select(*keys, "idx", F.col(col).alias(name)), [*keys, "idx"], "left") \
                 .withColumn(name, F.coalesce(F.col(name), F.lit("")))
    return out


def zip_full(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Both tracks side by side; times come from the side that has the cue."""
    l = a.select(*keys, "idx", F.col("start_ms").alias("a_s"), F.col("end_ms").alias("a_e"),
                 F.col("text").alias("a_text"), F.lit(True).alias("in_a"))
    r = b.select(*keys, "idx", F.col("start_ms").alias("b_s"), F.col("end_ms").alias("b_e"),
                 F.col("text").alias("b_text"), F.lit(True).alias("in_b"))
    j = l.join(r, [*keys, "idx"], "full_outer")
    same = F.coalesce(strip(F.col("a_text")) == strip(F.col("b_text")), F.lit(False))
    return j.select(*keys, "idx", F.coalesce("a_s", "b_s").alias("start_ms"),
                    F.coalesce("a_e", "b_e").alias("end_ms"), "a_text", "b_text",
                    F.coalesce("in_a", F.lit(False)).alias("in_a"),
                    F.coalesce("in_b", F.lit(False)).alias("in_b"), (~same).alias("changed"))


def match_rate(matches: DataFrame, keys) -> DataFrame:
    """Counts of generated and matched cues and their ratio."""
    m = F.count_if(F.col("right_idx").isNotNull())
    return matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("generated_count"), m.alias("matched_count"),
                                      (m / F.count(F.lit(1))).alias("match_rate"))


def avg_time_diff(texts: DataFrame, keys) -> DataFrame:
    """Mean absolute difference of the starts of matched cues in seconds, as made by :func:`with_texts`."""
    gap = F.sum(F.abs(F.col("ref_start") - F.col("cand_start")))
    return texts.groupBy(*keys).agg((gap / (F.count(F.lit(1)) * 1000.0)).alias("avg_time_diff"))


def track_totals(cues: DataFrame, keys) -> DataFrame:
    """Cues of each track and the sum of their lengths."""
    return cues.groupBy(*keys).agg(F.count(F.lit(1)).alias("segment_count"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))
