"""Text normalisation, formatting checks and line wrapping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_WS = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Formatting marks that should not be left in a clean cue.
OVERRIDE_TAG = r"\{[^}]*\}"
LITERAL_ESCAPE = r"\\[nNh]"
HTML_TAG = r"<[^>]+>"

# The three character ranges used for East Asian text.
CJK_QC = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]"
CJK_POLISH = (r"[\u2e80-\u2eff\u3000-\u9fff\uac00-\ud7af\uf900-\ufaff\ufe30-\ufe4f"
              r"\uff00-\uffef]")
CJK_PACK = r"[\u3000-\u303f\u3040-\u309f\u30a0-\u30ff\u4e00-\u9fff\uff00-\uffef]+"


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once per row, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def collapse_ws(c: Column) -> Column:
    # A single blank stays as it is, so most white space needs no replacement.
    return strip(F.regexp_replace(c, f"[{_WS}&&[^ ]]{_WS}*| {_WS}+", " "))


def words(c: Column) -> Column:
    """Words between runs of white space; an empty text has none."""
    t = collapse_ws(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def one_line(c: Column) -> Column:
    """Carriage returns removed, white space collapsed."""
    return collapse_ws(F.regexp_replace(c, "\r", ""))


def normalize_for_compare(c: Column) -> Column:
    """Lower case, single spaces, only letters, digits and underscores."""
    return strip(F.regexp_replace(collapse_ws(F.lower(c)), r"[^\p{L}\p{N}_ ]", ""))


def strip_formatting(c: Column) -> Column:
    t = F.regexp_replace(c, OVERRIDE_TAG, "")
    t = F.regexp_replace(t, LITERAL_ESCAPE, " ")
    return strip(F.regexp_replace(t, HTML_TAG, ""))


def display_lines(plain: Column) -> Column:
    """Lines of a plain text; none for an empty text, and no empty last line."""
    unified = F.regexp_replace(plain, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(unified, "\n$", ""), "\n"))


def has_cjk(c: Column, kind: str = "qc") -> Column:
    return c.rlike({"qc": CJK_QC, "polish": CJK_POLISH, "pack": CJK_PACK}[kind])


def japanese_share(c: Column) -> tuple[Column, Column]:
    """(Japanese characters, all non-space characters)."""
    dense = F.regexp_replace(c, _WS, "")
    return F.length(dense) - F.length(F.regexp_replace(dense, CJK_QC, "")), F.length(dense)


def strip_cjk(c: Column) -> Column:
    """CJK runs removed; the text itself where nothing would be left."""
    cleaned = strip(F.regexp_replace(c, CJK_PACK, ""))
    return F.when(cleaned == "", c).otherwise(cleaned)


def strip_cjk_all(texts: Column) -> Column:
    """:func:`strip_cjk` for each text of an array that holds CJK characters."""
    return F.transform(texts, lambda t: F.when(has_cjk(t, "pack"), strip_cjk(t)).otherwise(t))


def recover_prefix(c: Column) -> Column:
    """Latin text before a trailing CJK run, when it looks like a whole sentence."""
    head = F.regexp_extract(c, r"(?s)^(.*?)" + CJK_POLISH, 1)
    lead = strip(head)
    n = F.size(words(lead))
    ok = (has_cjk(c, "polish") & (lead != "") & (F.length(head) * 10 >= F.length(c) * 4)
          & (n >= 2) & (lead.rlike(r"[.!?…]$") | (n >= 4)))
    return F.when(ok, lead)


def contains_any(c: Column, markers: Iterable[str]) -> Column:
    """True when any marker occurs, ignoring case. The text is lowered once, not once a marker."""
    markers = list(markers)

    def any_of(low: Column) -> Column:
        hit = F.lit(False)
        for m in markers:
            hit = hit | low.contains(m.lower())
        return hit

    return let(F.lower(c), any_of)


def proper_nouns(c: Column) -> Column:
    """Capitalised words (not a lone A or I) and quoted terms, without repeats."""
    caps = F.filter(F.regexp_extract_all(c, F.lit(r"(?U)\b([A-Z][a-zA-Z]*)\b"), 1),
                    lambda w: ~w.isin("A", "I"))
    quoted = F.regexp_extract_all(c, F.lit("[\"']([^\"']+)[\"']"), 1)
    return F.array_distinct(F.concat(caps, quoted))


# Words that never count as key terms.
STOPWORDS = (
    "the and that this with from have your just really there they them what when where "
    "which will would could should about into only been were because then than here also "
    "their while"
).split()

TOKEN = r"([A-Za-z][A-Za-z'\-]{2,})"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), 1)


def keywords(c: Column) -> Column:
    """Tokens that carry meaning: not stop words, and capitalised or five letters long."""
    # A token starts with a letter of ASCII, and capitals stand in front of small letters.
    keep = F.filter(tokens(c), lambda w: ((F.length(w) >= 5) | (w < "a")) & ~F.lower(w).isin(STOPWORDS))
    return F.transform(keep, lambda w: F.lower(w))


def missing_terms(literal: Column, final: Column) -> Column:
    """Key terms of the literal text that the final text lacks; repeats and order kept."""
    have = F.array_distinct(F.transform(tokens(final), lambda w: F.lower(w)))
    return let(have, lambda h: F.filter(keywords(literal), lambda k: ~F.array_contains(h, k)))


def normalize_tags(tags: Column) -> Column:
    clean = F.filter(F.transform(tags, lambda t: strip(t)), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.array_sort(F.array_distinct(clean)), F.array().cast("array<string>"))


def first_reply_line(reply: Column) -> Column:
    """First non-blank line of a model reply without a ``Translation:`` style label; NULL if none."""
    lines = F.filter(F.transform(F.split(reply, "\r\n|\r|\n"), lambda x: strip(x)), lambda x: x != "")
    line = F.try_element_at(lines, F.lit(1))
    label = r"(?is)^\s*(?:translation|english|output)\s*:(.*)$"
    rest = strip(F.regexp_extract(line, label, 1))
    return F.when(line.rlike(label) & (rest != ""), rest).otherwise(line)


def split_by_punctuation(text: Column, target: int = 80, marks: str = ".!?;") -> Column:
    """Pack the text into pieces of at most ``target`` characters, cut at sentence marks.

    A mark and the spaces after it form a part of their own, so a full piece is closed in
    front of the mark and the next piece starts with it.
    """
    cls = "".join("\\" + m for m in marks)
    cut = F.regexp_replace(text, "([" + cls + "]" + _WS + "+)", "\u0001$1\u0001")
    parts = F.split(cut, "\u0001")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, part):
        full = (acc.cur != "") & (F.length(acc.cur) + F.length(part) > target)
        return F.struct(
            F.when(full, F.concat(acc.done, F.array(strip(acc.cur)))).otherwise(acc.done).alias("done"),
            F.when(full, part).otherwise(F.concat(acc.cur, part)).alias("cur"))

    def finish(acc):
        last = strip(acc.cur)
        return F.when(last != "", F.concat(acc.done, F.array(last))).otherwise(acc.done)

    pieces = F.aggregate(parts, empty, step, finish)
    return F.when(F.length(text) <= target, F.array(text)).otherwise(
        let(pieces, lambda p: F.when(F.size(p) == 0, F.array(text)).otherwise(p)))


def wrap_lines(text: Column, width: int = 42) -> Column:
    """Greedy word wrap; short texts stay as they are and long words get their own line."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def step(acc, w):
        fits = (acc.used > 0) & (acc.used + 1 + F.length(w) <= width)
        sep = F.when(acc.used == 0, F.lit("")).when(fits, F.lit(" ")).otherwise(F.lit("\n"))
        return F.struct(F.concat(acc.out, sep, w).alias("out"),
                        F.when(fits, acc.used + 1 + F.length(w)).otherwise(F.length(w)).alias("used"))

    return F.when(F.length(text) <= width, text).otherwise(
        F.aggregate(words(text), start, step, lambda a: a.out))
