"""Timing repair and SRT rendering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import is_blank, split_by_punctuation, strip, wrap_lines
from cuelake.functions.timecode import ms_to_srt
from cuelake.ordered import CHUNK, chunk_of, dense_index
from cuelake.session import made_once


@dataclass(frozen=True)
class TimingLimits:
    min_ms: int = 500
    max_ms: int = 7000
    gap_ms: int = 50
    split_chars: int = 80
    marks: str = ".!?;"
    line_chars: int = 42


def split_long(cues: DataFrame, keys, limits: TimingLimits = TimingLimits()) -> DataFrame:
    """Drop blank cues, extend short ones, split long ones at sentence marks, cap the rest.

    Row-local. ``part`` numbers the pieces of a cue.
    """
    L = limits
    c = cues.filter(~is_blank(F.col("text"))).withColumn("end_ms", F.greatest("end_ms", F.col("start_ms") + L.min_ms))
    dur = F.col("end_ms") - F.col("start_ms")
    long = (dur > L.max_ms) | (F.length("text") > L.split_chars)
    pieces = F.when(long, split_by_punctuation(F.col("text"), L.split_chars, L.marks)).otherwise(F.array("text"))
    c = c.withColumn("_d", dur).withColumn("_p", pieces).withColumn("_n", F.size("_p"))
    # A cue always has a piece; the plain explode would first ask so by cutting the text once more.
    c = c.select(*keys, "idx", "start_ms", "_d", "_n", "text", F.posexplode_outer("_p").alias("part", "_t"))
    start = F.col("start_ms") + F.floor(F.col("part") * F.col("_d") / F.col("_n")).cast("bigint")
    length = F.least(F.floor(F.col("_d") / F.col("_n")).cast("bigint"), F.lit(L.max_ms))
    return c.select(*keys, "idx", F.col("part").cast("bigint").alias("part"), start.alias("start_ms"),
                    (start + length).alias("end_ms"), F.when(F.col("_n") > 1, strip(F.col("_t"))).otherwise(F.col("text")).alias("text"))


def _repair(key_cols, gap, min_ms):
    """Repair in order within a key; a key may go on from a state before (_bs, _be) and be followed by a start (_next)."""

    def run(batches):
        import pandas as pd

        held, key, real = None, None, False
        extra = ["_bs", "_be", "_next"]

        def closed(row, after):
            """The last cue of a part gives way to the first of the next part, if it can."""
            if after == after and after is not None and after < row[ei] + gap and after - gap >= row[si] + min_ms:
                row[ei] = int(after) - gap
            return row

        for pdf in batches:
            cols = list(pdf.columns)
            out = []
            si, ei, bs, be, ni = (cols.index(c) for c in ("start_ms", "end_ms", "_bs", "_be", "_next"))
            ki = [cols.index(c) for c in key_cols]
            for row in pdf.itertuples(index=False, name=None):
                row = list(row)
                k = tuple(row[i] for i in ki)
                if k != key:
                    if real:
                        out.append(closed(held, held[ni]))
                    held, real = None, False
                    if row[be] == row[be] and row[be] is not None:
                        # What stands before belongs to another part, which shortens its last cue itself.
                        held = list(row)
                        held[si], held[ei] = int(row[bs]), int(row[be])
                if held is not None and row[si] < held[ei] + gap:
                    want = row[si] - gap
                    if want >= held[si] + min_ms:
                        held[ei] = want
                    else:
                        row[si] = held[ei] + gap
                        row[ei] = max(row[ei], row[si] + min_ms)
                if real:
                    out.append(held)
                held, key, real = row, k, True
            yield pd.DataFrame(out, columns=cols).drop(columns=extra)
        if real:
            yield pd.DataFrame([closed(held, held[ni])], columns=cols).drop(columns=extra)
    return run


def _fresh(s, e, at: int, gap: int, step: int, known: dict) -> tuple[int, int]:
    """Start and end of the last cue when cue ``at`` stays as it is. ``known`` has the answers for cues met as such before."""
    path, n = [], len(s)
    first, end, i = int(s[at]), int(e[at]), at
    answer = known.get(at)
    if answer is None:
        path.append(at)
        while True:
            i += 1
            if i == n:
                answer = first, end
                break
            if s[i] >= min(end + gap, first + step):
                answer = known.get(i)
                if answer is not None:
                    break
                path.append(i)
                first, end = int(s[i]), int(e[i])
            else:
                first, end = end + gap, max(int(e[i]), end + step)
        for p in path:
            known[p] = answer
    return answer


def part_map(s, e, gap: int, min_ms: int) -> dict:
    """Repair of a part of a chain as a function of the last cue (S, E) before it.

    Cues are pushed one behind the other, so ends are running maxima of ``end + steps``, until a cue starts late enough
    to stay as it is. From there on nothing of what came before is left. Which cue that is depends on E alone and
    grows with it: ``upto[i]`` is the largest E for which the part ends in state ``ends[i]``. Beyond the last,
    all cues are pushed.
    """
    import numpy as np

    s, e = np.asarray(s, dtype=np.int64), np.asarray(e, dtype=np.int64)
    n, step, known = len(s), gap + min_ms, {}
    k = np.arange(1, n + 1, dtype=np.int64)
    most = np.maximum.accumulate(e - k * step) + k * step
    # Cue r (from 1) stays where s_r >= (end of cue r - 2, E before the first) + gap + step.
    late = s[1:] - gap - step
    stays = np.ones(n - 1, bool)
    stays[1:] = late[1:] >= most[:-2] if n > 2 else True
    upto = late - (k[1:] - 2) * step
    best, cuts = None, []
    for i in np.nonzero(stays)[0].tolist():
        if best is None or upto[i] > best:
            best = int(upto[i])
            cuts.append((best, _fresh(s, e, i + 1, gap, step, known)))
    # Neighbours with one outcome are one.
    cuts = [c for i, c in enumerate(cuts) if i + 1 == len(cuts) or cuts[i + 1][1] != c[1]]
    kept = _fresh(s, e, 0, gap, step, known)
    return {"n": n, "first": int(s[0]), "kept_s": kept[0], "kept_e": kept[1], "most": int(most[-1]), "most_before": int(most[-2]) if n > 1 else None,
            "upto": [c[0] for c in cuts], "ends_s": [c[1][0] for c in cuts], "ends_e": [c[1][1] for c in cuts]}


def after_part(m, state: tuple[int, int] | None, gap: int, min_ms: int) -> tuple[int, int]:
    """The last cue of a part, given the last cue before it."""
    from bisect import bisect_left

    step = gap + min_ms
    if state is None or m["first"] >= min(state[1] + gap, state[0] + step):
        return int(m["kept_s"]), int(m["kept_e"])
    n, end = int(m["n"]), state[1]
    i = bisect_left(m["upto"], end)
    if i < len(m["upto"]):
        return int(m["ends_s"][i]), int(m["ends_e"][i])
    before = end if n == 1 else max(int(m["most_before"]), end + (n - 1) * step)
    return before + gap, max(int(m["most"]), end + n * step)


MAP = "n long, first long, kept_s long, kept_e long, most long, most_before long, upto array<long>, ends_s array<long>, ends_e array<long>"


def _maps(key_cols, gap, min_ms):
    """One row per part: its map. Rows come in order; a part is held, and no more."""

    def run(batches):
        import pandas as pd

        key, s, e = None, [], []
        names = [*key_cols, *(c.split()[0] for c in MAP.split(", "))]
        row = lambda: pd.DataFrame([{**dict(zip(key_cols, key)), **part_map(s, e, gap, min_ms)}], columns=names).astype(
            {"most_before": "Int64"})
        for pdf in batches:
            for *k, a, z in pdf[[*key_cols, "start_ms", "end_ms"]].itertuples(index=False, name=None):
                k = tuple(k)
                if k != key:
                    if s:
                        yield row()
                    key, s, e = k, [], []
                s.append(a)
                e.append(z)
        if s:
            yield row()
    return run


def _states(key_cols, gap, min_ms):
    """Per part: the last cue before it and the first start behind it. Parts of a chain come in order."""

    def run(batches):
        import pandas as pd

        out_cols = [*key_cols, "_part", "_bs", "_be", "_next"]
        chain, state, held = None, None, None
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                k = tuple(r[c] for c in key_cols)
                if held is not None:
                    out.append([*held, r["first"] if k == chain else None])
                if k != chain:
                    chain, state = k, None
                held = [*k, r["_part"], *(state or (None, None))]
                state = after_part(r, state, gap, min_ms)
            yield pd.DataFrame(out, columns=out_cols).astype({"_bs": "Int64", "_be": "Int64", "_next": "Int64"})
        if held is not None:
            yield pd.DataFrame([[*held, None]], columns=out_cols).astype({"_bs": "Int64", "_be": "Int64", "_next": "Int64"})
    return run


def repair_overlaps(cues: DataFrame, keys, ties=("idx",), limits: TimingLimits = TimingLimits(), part_cues: int = CHUNK) -> DataFrame:
    """Make cues of a track disjoint: shrink the earlier cue, else push the later one.

    Each step needs the repaired cue before it, but only inside a chain of touching cues. A
    repaired end is at most ``max(end, previous repaired end + gap + min)``, a running maximum
    over positions, so a cue that starts after that bound opens a new chain whatever happened
    before. Chains of one cue stay in the JVM; longer ones are streamed in order through one
    pass that holds a single cue. A chain of more than ``part_cues`` cues is cut into parts: each part is first
    reduced to a map from the cue before it to its last cue, the maps of a chain are applied in order (one row per
    part), and then all parts are repaired at once.
    """
    L, keys = limits, list(keys)
    step = L.gap_ms + L.min_ms
    # One layout for all of it: slices of start time. What crosses a slice border goes through
    # two tables with one row per slice.
    place = [*keys, "_slice"]
    inside = Window.partitionBy(*place).orderBy("start_ms", "end_ms", *ties)
    along = Window.partitionBy(*keys).orderBy("_slice")
    before = (Window.unboundedPreceding, -1)
    c = cues.withColumn("_slice", chunk_of(F.col("start_ms"))).withColumn("_rn", F.row_number().over(inside))
    c = c.withColumn("_v", F.col("end_ms") - F.col("_rn") * step)
    sums = (c.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"), F.max("_v").alias("_m"))
            .withColumn("_off", F.coalesce(F.sum("_n").over(along.rowsBetween(*before)), F.lit(0)))
            .withColumn("_carry", F.max(F.col("_m") - F.col("_off") * step).over(along.rowsBetween(*before))).drop("_n", "_m"))
    c = c.withColumn("_local", F.max("_v").over(inside.rowsBetween(*before))).join(sums, place)
    c = c.withColumn("_pos", (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
    bound = F.greatest(F.col("_local") - F.col("_off") * step, F.col("_carry"))
    opens = bound.isNull() | (F.col("start_ms") >= bound + F.col("_pos") * step + L.gap_ms)
    c = c.withColumn("_open", F.when(opens, F.col("_pos"))).select(*cues.columns, "_slice", "_pos", "_open")
    is_open = F.col("_open").isNotNull()
    ends = (c.groupBy(*place).agg(F.max("_open").alias("_o"), F.min_by(is_open, "_pos").alias("_f"))
            .withColumn("_last", F.max("_o").over(along.rowsBetween(*before))).withColumn("_after", F.lead("_f").over(along)).drop("_o", "_f"))
    by_pos = Window.partitionBy(*place).orderBy("_pos")
    run = F.coalesce(F.max("_open").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)), F.col("_last"))
    alone = is_open & F.coalesce(F.lead(is_open).over(by_pos), F.col("_after"), F.lit(True))
    c = c.join(ends, place).select(*cues.columns, "_pos", run.alias("_run"), alone.alias("_alone"))
    # Read by all that follows: single cues, parts of long chains, and the repair.
    c = made_once(c.withColumn("_part", F.when(~F.col("_alone"), chunk_of(F.col("_pos") - F.col("_run"), part_cues))), "timing-chains")
    chained = c.filter(~F.col("_alone"))
    chain, part = [*keys, "_run"], [*keys, "_run", "_part"]
    types = ", ".join(f"`{k}` {c.schema[k].dataType.simpleString()}" for k in chain)
    long = chained.join(chained.filter("_part > 0").select(*chain).distinct(), chain, "left_semi").select(*part, "_pos", "start_ms", "end_ms")
    maps = (long.repartition(*part).sortWithinPartitions(*part, "_pos")
            .mapInPandas(_maps(part, L.gap_ms, L.min_ms), f"{types}, _part long, {MAP}"))
    states = (maps.repartition(*chain).sortWithinPartitions(*part)
              .mapInPandas(_states(chain, L.gap_ms, L.min_ms), f"{types}, _part long, _bs long, _be long, _next long"))
    rows = chained.join(states, part, "left").select(*c.columns, "_bs", "_be", "_next").repartition(*part).sortWithinPartitions(*part, "_pos")
    fixed = rows.mapInPandas(_repair(part, L.gap_ms, L.min_ms), c.schema)
    return c.filter("_alone").unionByName(fixed).drop("_run", "_alone", "_part")


def prepare_cues(cues: DataFrame, keys, limits: TimingLimits = TimingLimits()) -> DataFrame:
    """All timing rules, then drop what is still too short."""
    # The repair reads the pieces three times; cutting a text costs more than reading it again.
    pieces = made_once(split_long(cues, keys, limits), "split-cues")
    fixed = repair_overlaps(pieces, keys, ("idx", "part"), limits)
    return fixed.filter(F.col("end_ms") - F.col("start_ms") >= limits.min_ms)


def srt_blocks(cues: DataFrame, keys, order: str = "_pos", width: int | None = 42, simple: bool = False) -> DataFrame:
    """Numbered SRT blocks of each track, counted from 1 after any filtering."""
    c = dense_index(cues, keys, order, name="number", start=1)
    text = strip(F.col("text")) if simple else (wrap_lines(F.col("text"), width) if width else F.col("text"))
    stamp = F.concat(ms_to_srt(F.col("start_ms"), clamp=simple), F.lit(" --> "), ms_to_srt(F.col("end_ms"), clamp=simple))
    return c.select(*keys, "number", F.concat(F.col("number").cast("string"), F.lit("\n"), stamp, F.lit("\n"), text, F.lit("\n")).alias("block"))


def render_srt(blocks: DataFrame, keys, part_cues: int = 10_000) -> DataFrame:
    """SRT text per track, in parts of at most ``part_cues`` cues; parts in order make the file (K1)."""
    b = blocks.withColumn("part", chunk_of(F.col("number") - 1, part_cues))
    return b.groupBy(*keys, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "block"))),
                                                                 lambda x: x["block"]), "\n").alias("srt"))


def write_srt(blocks: DataFrame, keys, path: str) -> None:
    """One folder per track with ordered text files; a huge track is written by many tasks."""
    keys = list(keys)
    (blocks.repartitionByRange(*[F.col(k) for k in keys], F.col("number")).sortWithinPartitions(*keys, "number")
     .select(*keys, F.col("block").alias("value")).write.mode("overwrite").partitionBy(*keys).text(path))
