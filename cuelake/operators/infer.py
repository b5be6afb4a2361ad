"""Models as batch functions supplied by the user."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import is_blank
from cuelake.operators.guards import guard
from cuelake.session import made_once


def batch_infer(df: DataFrame, load: Callable, column: str, out: str, batch: int = 64) -> DataFrame:
    """Run ``load()(texts) -> texts`` over batches; ``load`` is called once per task.

    A failing batch leaves ``out`` NULL and its message in ``<out>_error``. So does a blank
    reply to a text that is not blank (H26).
    """
    def run(batches):
        model = load()
        for pdf in batches:
            made, errs = [], []
            texts = pdf[column].tolist()
            for i in range(0, len(texts), batch):
                part = texts[i:i + batch]
                try:
                    got = list(model(part))
                    if len(got) != len(part):
                        raise ValueError(f"model returned {len(got)} of {len(part)} texts")
                    bad = [t is not None and bool(t.strip()) and not (isinstance(g, str) and g.strip()) for t, g in zip(part, got)]
                    made += [None if b else g for b, g in zip(bad, got)]
                    errs += ["blank reply" if b else None for b in bad]
                except Exception as e:  # noqa: BLE001 - kept as a value of the row
                    made += [None] * len(part)
                    errs += [f"{type(e).__name__}: {e}"] * len(part)
            pdf[out], pdf[f"{out}_error"] = made, errs
            yield pdf

    schema = df.withColumn(out, F.lit("").cast("string")).withColumn(f"{out}_error", F.lit("").cast("string")).schema
    for f in schema.fields:
        f.nullable = True
    return df.mapInPandas(run, schema)


def infer_non_blank(df: DataFrame, load: Callable, column: str, out: str, batch: int = 64) -> DataFrame:
    """Blank texts skip the model and stay; a failed batch returns its inputs (P5)."""
    blank = is_blank(F.col(column))
    done = batch_infer(df.filter(~blank), load, column, out, batch).withColumn(out, F.coalesce(out, column))
    kept = df.filter(blank).withColumn(out, F.col(column)).withColumn(f"{out}_error", F.lit(None).cast("string"))
    return done.unionByName(kept)


def infer_with_fallback(df: DataFrame, keys, load: Callable, fallback: Callable, column: str, out: str,
                        per_row: bool = False, batch: int = 64) -> DataFrame:
    """Second model where the first one failed: for the whole track, or per row.

    ``fallback_reason`` is the row's own failure, or the smallest message of its track.
    """
    # Written once: the branches below must see one and the same answer of the model.
    keys = list(keys)
    a = made_once(batch_infer(df, load, column, out, batch), "first-model")
    failed = F.col(f"{out}_error").isNotNull()
    if per_row:
        good, bad = a.filter(~failed), a.filter(failed).withColumn("fallback_reason", F.col(f"{out}_error"))
    else:
        tracks = a.filter(failed).groupBy(*keys).agg(F.min(f"{out}_error").alias("fallback_reason"))
        good, bad = a.join(tracks, keys, "left_anti"), a.join(tracks, keys)
    redo = batch_infer(bad.drop(out, f"{out}_error"), fallback, column, out, batch)
    good = good.withColumn("fallback_reason", F.lit(None).cast("string")).withColumn("fallback", F.lit(False))
    return good.unionByName(redo.withColumn("fallback", F.lit(True)))


def two_pass(df: DataFrame, keys, literal: Callable, natural: Callable, column: str, batch: int = 64) -> DataFrame:
    """Literal pass, natural pass, then the drift and collapse guard.

    Each pass runs once per row. Where the literal pass failed, the source text stands for it
    and ``raw_text_error`` tells why; a failed natural pass keeps the literal text and its error.
    """
    a = made_once(batch_infer(df, literal, column, "raw_text", batch).withColumn("raw_text", F.coalesce("raw_text", column)), "literal-pass")
    b = made_once(batch_infer(a, natural, "raw_text", "new_text", batch), "natural-pass")
    return guard(b.withColumn("new_text", F.coalesce("new_text", "raw_text")), keys)
