"""Glossary matching and required-term checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import strip
from cuelake.ordered import top_k

ANCHOR = 3
PIECE = 64
SLICE_TERMS = 100_000
SLICE_LETTERS = 8_000_000
# Up to this many terms are looked for one by one: a search for a term costs far less than a row a place of the text.
FEW_TERMS = 1_000


def glossary_entries(raw: DataFrame) -> DataFrame:
    """Clean layered entries and keep the last layer per (kind, source).

    ``raw``: layer, kind, scope, source, target, required (text or NULL). Later layers win;
    within a layer the later row (``ord``). ``first`` is where an entry was first seen.
    """
    req = F.lower(F.trim(F.col("required").cast("string")))
    e = (raw.withColumn("source", strip(F.col("source"))).withColumn("target", strip(F.col("target")))
         .filter((F.col("source") != "") & (F.col("target") != ""))
         .withColumn("required", F.when(req.isin("1", "true", "yes", "on"), True)
                     .when(req.isin("0", "false", "no", "off"), False).otherwise(F.col("kind") != "term"))
         .withColumn("source_norm", F.lower("source")))
    key = F.struct("layer", "ord")
    best = e.groupBy("kind", "source_norm").agg(F.max_by(F.struct("scope", "source", "target", "required"), key).alias("e"),
                                                   F.min(key).alias("first"))
    return best.select("kind", "source_norm", "e.*", "first").withColumn("target_norm", F.lower("target"))


def _rank_kind() -> Column:
    return F.when(F.col("kind") == "name", 0).when(F.col("kind") == "honorific", 1).when(F.col("kind") == "term", 2).otherwise(3)


def _dictionary(glossary: DataFrame, slice_terms: int) -> tuple[list[DataFrame], int, list[int], int]:
    """Slices of the glossary that are small enough to be broadcast, its longest term, the lengths of its anchors, its terms.

    Terms and letters are counted first; terms are dealt into slices by hash, so each slice holds about
    ``slice_terms`` terms or ``SLICE_LETTERS`` letters at most, however large the glossary is.
    """
    seen = F.col("first") if "first" in glossary.columns else F.struct(F.lit(0).alias("layer"), F.lit(0).alias("ord"))
    n = F.length("source")
    g = glossary.filter(n > 0).select("kind", "scope", "source", "target", "required", seen.alias("_first"),
                                      F.left("source", F.lit(ANCHOR)).alias("_a"), n.alias("_n"))
    count, letters, longest, anchors = g.agg(F.count(F.lit(1)), F.sum("_n"), F.max("_n"), F.collect_set(F.least("_n", F.lit(ANCHOR)))).first()
    if not count:
        return [], 0, [], 0
    slices = max(-(-count // slice_terms), -(-letters // SLICE_LETTERS))
    parts = [g.filter(F.pmod(F.xxhash64("source"), F.lit(slices)) == i) for i in range(slices)]
    return parts, longest, sorted(anchors), count


def glossary_match(cues: DataFrame, glossary: DataFrame, keys, text: str = "text", max_terms: int | None = 6,
                   slice_terms: int = SLICE_TERMS, few_terms: int = FEW_TERMS) -> DataFrame:
    """Terms whose source occurs in the cue, best first, at most ``max_terms`` per cue.

    Each of up to ``few_terms`` broadcast terms is searched for in a text. For a larger glossary a text
    is cut into pieces that overlap by the longest term, so a term lies whole in one of them, and each place
    of a piece looks up its first letters in a broadcast slice of the glossary and the term is compared right there.
    Either way no text is exploded into a shuffle, only hits leave the scan. A glossary of more than one slice reads the
    texts once per slice. Equal ranks go by the place where an entry was first seen. A null or empty text has no
    terms, nor has an empty glossary.
    """
    keys = list(keys)
    parts, longest, anchors, count = _dictionary(glossary, slice_terms)
    step = max(PIECE, longest)
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{1,{step + max(longest, 1) - 1}}})).{{1,{step}}}"), F.lit(1))
    rows = cues.select(*keys, "idx", F.explode(pieces).alias("_p"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.least(F.length("_p"), F.lit(step)))).alias("_i"))
    if len(anchors) > 1:
        rows = rows.select("*", F.explode(F.array(*map(F.lit, anchors))).alias("_l"))
    else:
        rows = rows.withColumn("_l", F.lit(anchors[0] if anchors else 1))
    rows = rows.withColumn("_a", F.substr("_p", "_i", "_l"))
    entry = ["kind", "scope", "source", "target", "required", "_first"]

    def found(part: DataFrame) -> DataFrame:
        if count <= few_terms:
            hit = cues.select(*keys, "idx", F.col(text).alias("_t")).join(F.broadcast(part), F.contains("_t", "source"))
            return hit.select(*keys, "idx", *entry)
        hit = rows.join(F.broadcast(part), "_a").filter(F.substr("_p", "_i", "_n") == F.col("source"))
        return hit.select(*keys, "idx", *entry)

    if not parts:
        none = glossary.select("kind", "scope", "source", "target", "required", F.struct(F.lit(0).alias("layer"), F.lit(0).alias("ord")).alias("_first"))
        hits = cues.select(*keys, "idx").limit(0).join(none.limit(0), F.lit(True))
    else:
        hits = reduce(DataFrame.unionByName, map(found, parts)).distinct()
    if max_terms is None:
        return hits.drop("_first")
    order = [F.col("required").desc(), _rank_kind(), F.length("source").desc(), F.col("_first"), F.col("source")]
    return top_k(hits, [*keys, "idx"], order, max_terms).drop("_first")


def term_in_text(target: Column, text: Column) -> Column:
    """Whole-word search for plain ASCII targets, containment for all others."""
    t, x = F.lower(target), F.lower(text)
    whole = F.concat(F.lit(r"(?U)\b\Q"), t, F.lit(r"\E\b"))
    # A pattern is made for a row; where the target is not contained there is none to make.
    return F.when((t == "") | (x == "") | ~x.contains(t), F.lit(False)).when(
        t.rlike(r"^[a-z0-9][a-z0-9 '\-]*$"), F.rlike(x, whole)).otherwise(F.lit(True))


def term_drift(cues: DataFrame, glossary: DataFrame, keys, source: str = "source_text", final: str = "text") -> DataFrame:
    """Required terms of the source that the final text lacks."""
    keys = list(keys)
    hits = glossary_match(cues, glossary, keys, source, max_terms=None).filter("required")
    j = hits.join(cues.select(*keys, "idx", F.col(final).alias("_f")), [*keys, "idx"])
    j = j.filter((F.col("_f") != "") & ~term_in_text(F.col("target"), F.col("_f")))
    code = F.when(F.col("kind") == "name", "bad_name").when(F.col("kind") == "honorific", "bad_honorific").otherwise("wrong_meaning")
    return j.select(*keys, "idx", code.alias("code"), F.lit("warning").alias("severity"),
                    F.concat(F.lit("Required "), "kind", F.lit(" missing/changed: expected '"), "target",
                             F.lit("' for source '"), "source", F.lit("'")).alias("message"),
                    F.col("kind").alias("term_kind"), F.col("source").alias("source_term"),
                    F.col("target").alias("expected_target"), F.col("scope").alias("pack_scope"))


def glossary_block(matches: DataFrame, keys) -> DataFrame:
    """Prompt text of the matched terms per cue (at most a handful each)."""
    label = F.when(F.col("required"), "required").otherwise("preferred")
    line = F.concat(F.lit("- "), "source", F.lit(" -> "), "target", F.lit(" ("), "kind", F.lit(", "), label, F.lit(")"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n")
    return matches.groupBy(*keys, "idx").agg(F.concat(
        F.lit("Glossary enforcement (must follow for this cue):\n"), body).alias("glossary_block"))
