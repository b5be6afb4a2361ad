"""Reads in nested metadata with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def meta_get(meta: Column, *paths: str, kind: str = "string") -> Column:
    """The first value among JSON ``paths`` that is there and not empty; null if none is.

    ``meta`` is JSON text or VARIANT. Values that do not fit ``kind``, and text that is no JSON,
    count as missing.
    """
    got = [F.try_variant_get(F.try_parse_json(meta), p, kind) for p in paths]
    return F.coalesce(*[F.when(g != "", g) if kind == "string" else g for g in got])


def source_text(meta: Column) -> Column:
    """Text of the cue in its source language, trimmed; empty where the metadata has none."""
    return F.trim(F.coalesce(meta_get(meta, "$.source_text_ja", "$.source_text"), F.lit("")))


def ocr_confidence(meta: Column) -> tuple[Column, Column]:
    """(there at all, value): a value that is no number counts as 0."""
    raw = F.try_variant_get(F.try_parse_json(meta), "$.ocr_confidence", "string")
    return raw.isNotNull(), F.coalesce(raw.try_cast("double"), F.lit(0.0))


def asr_warnings(meta: Column) -> Column:
    """Array of (type, severity, detail) of the speech warnings in the metadata; empty where there are none."""
    got = F.try_variant_get(F.try_parse_json(meta), "$.asr.warnings", "array<struct<type: string, severity: string, detail: string>>")
    return F.coalesce(got, F.array().cast("array<struct<type: string, severity: string, detail: string>>"))
