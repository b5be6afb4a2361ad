"""Timecodes on integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pad(c: Column, n: int) -> Column:
    s = c.cast("string")
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, "0"))


def ms_to_srt(ms: Column, clamp: bool = False) -> Column:
    """``HH:MM:SS,mmm``. A negative time is an error, or 0 with ``clamp``."""
    ms = F.greatest(ms, F.lit(0)) if clamp else ms
    text = F.concat(
        _pad(F.floor(ms / 3_600_000), 2), F.lit(":"),
        _pad(F.floor(ms / 60_000) % 60, 2), F.lit(":"),
        _pad(F.floor(ms / 1000) % 60, 2), F.lit(","), _pad(ms % 1000, 3))
    if clamp:
        return text
    return F.when(ms < 0, F.raise_error(F.concat(F.lit("negative timestamp: "), ms.cast("string")))
                  .cast("string")).otherwise(text)


def hms_to_ms(h: Column, m: Column, s: Column, ms: Column) -> Column:
    return (h.cast("bigint") * 3_600_000 + m.cast("bigint") * 60_000
            + s.cast("bigint") * 1000 + ms.cast("bigint"))


def srt_to_ms(ts: Column) -> Column:
    """Parse ``H:M:S,mmm``; NULL when the text is not a timecode."""
    t = F.trim(ts)
    pat = r"^(\d+):(\d+):(\d+),(\d+)$"
    g = [F.regexp_extract(t, pat, i) for i in range(1, 5)]
    return F.when(t.rlike(pat), hms_to_ms(*g))


def overlap_ms(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def fixed(num: Column, den: Column, places: int) -> Column:
    """``num/den`` as text with ``places`` digits, rounded half up on exact integers."""
    p = 10 ** places
    n, d = num.cast("bigint"), den.cast("bigint")
    q = F.floor((F.abs(n) * (2 * p) + d) / (d * 2)).cast("bigint")
    sign = F.when((n < 0) & (q > 0), F.lit("-")).otherwise(F.lit(""))
    whole = F.floor(q / p).cast("bigint").cast("string")
    if places == 0:
        return F.concat(sign, whole)
    return F.concat(sign, whole, F.lit("."), F.lpad((q % p).cast("string"), places, "0"))


def sec(ms: Column) -> Column:
    """Milliseconds as seconds with three digits."""
    return fixed(ms, F.lit(1000), 3)
