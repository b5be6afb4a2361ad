"""Context and prompt columns for model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import strip
from cuelake.operators import terms
from cuelake.ordered import carry_before, neighbours


def context_window(cues: DataFrame, keys, radius: int, text: str = "text") -> DataFrame:
    """Add ``context``: the cues around each cue, the cue itself marked with ``>>``."""
    near = lambda w: F.collect_list(F.struct(F.col("idx").alias("i"), F.col(text).alias("t"))).over(
        w.rowsBetween(-radius, radius))
    c = neighbours(cues, keys, "idx", {"_near": near}, before=radius, after=radius)
    me = F.col("idx")
    line = lambda x: F.concat(F.when(x["i"] == me, ">>").otherwise("  "), F.lit(" "),
                              (x["i"] + 1).cast("string"), F.lit(": "), x["t"])
    return c.withColumn("context", F.array_join(F.transform("_near", line), "\n")).drop("_near")


def prev_next(cues: DataFrame, keys, text: str = "text") -> DataFrame:
    """Add the neighbour texts, empty at the ends of a track."""
    return neighbours(cues, keys, "idx", {
        "previous_context": lambda w: F.coalesce(F.lag(text).over(w), F.lit("")),
        "next_context": lambda w: F.coalesce(F.lead(text).over(w), F.lit(""))}, before=1, after=1)


def previous_output(cues: DataFrame, keys, output: str) -> DataFrame:
    """Add the last non-blank earlier output."""
    t = strip(F.col(output))
    return carry_before(cues, keys, "idx", F.when(t != "", t), "previous_output", "last")


def batch_number(cues: DataFrame, size: int) -> DataFrame:
    """Batches of consecutive cues; positions are dense, so no window is needed."""
    return cues.withColumn("batch_no", F.floor(F.col("idx") / size).cast("bigint")).withColumn("pos", F.col("idx") % size + 1)


def numbered_messages(cues: DataFrame, keys, size: int) -> DataFrame:
    """One numbered message per batch of at most ``size`` cues."""
    b = batch_number(cues, size)
    line = F.concat(F.col("pos").cast("string"), F.lit(". "), "text")
    return b.groupBy(*keys, "batch_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("message"))


# What each mode asks for; any other mode asks for accuracy.
MODES = {"literal": "Translate literally and preserve all meaning, names, register, and implied subjects.",
         "natural_subtitle": "Translate into concise, natural English subtitle lines while preserving meaning."}
ACCURATE = "Translate for maximum accuracy first, then make the English subtitle natural. Do not omit, soften, sanitize, or add meaning."
LOW_CONFIDENCE = "If a line is uncertain due to unclear source/context, prefix the output with '[LOW_CONFIDENCE]' instead of guessing."


def instruction(mode: str, flag_low_confidence: bool = False, extra: tuple[str, ...] = ()) -> str:
    """What a mode asks of the model, with the sentences that profiles add."""
    return " ".join([MODES.get(mode, ACCURATE), *extra, *([LOW_CONFIDENCE] if flag_low_confidence else [])])


def prompt_table(cues: DataFrame, keys, glossary: DataFrame | None = None, memory: DataFrame | None = None,
                 output: str | None = None, radius: int = 2, baseline: str | None = None, mode: str | None = None,
                 profile: str = "default", flag_low_confidence: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """The prompt data set: one row per cue with context, rules, memory and message.

    ``memory``: keys, idx, memory_block, as made by ``memory.memory_block``. With a ``mode`` the prompt begins with mode,
    profile and instruction, and ends with what to return.
    """
    keys = list(keys)
    c = context_window(cues, keys, radius)
    c = previous_output(c, keys, output) if output else c.withColumn("previous_output", F.lit(None).cast("string"))
    if glossary is not None:
        hits = terms.glossary_match(cues, glossary, keys, "text")
        c = c.join(terms.glossary_block(hits, keys), [*keys, "idx"], "left")
    else:
        c = c.withColumn("glossary_block", F.lit(None).cast("string"))
    c = c.join(memory, [*keys, "idx"], "left") if memory is not None else c.withColumn("memory_block", F.lit(None).cast("string"))
    c = c.withColumn("glossary_block", F.coalesce("glossary_block", F.lit(""))).withColumn("memory_block", F.coalesce("memory_block", F.lit("")))
    base = F.concat(F.lit("Baseline translation:\n"), F.col(baseline)) if baseline else F.lit(None)
    prev = F.when(F.col("previous_output").isNotNull(), F.concat(F.lit("Previous accepted output:\n"), "previous_output"))
    head = F.lit(f"Mode: {mode}\nDialogue profile: {profile}\nInstruction: {instruction(mode, flag_low_confidence, extra)}") if mode else F.lit(None)
    close = F.lit("Return only the translation of this one cue.") if mode else F.lit(None)
    return c.withColumn("prompt", F.concat_ws("\n\n", head, F.lit("Translate only the line marked with >>."), "context", base, prev,
                                              F.nullif("glossary_block", F.lit("")), F.nullif("memory_block", F.lit("")),
                                              close, F.concat(F.lit("Cue:\n"), "text")))
