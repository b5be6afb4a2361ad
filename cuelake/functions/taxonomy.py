"""Failure codes and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelake.functions.text import strip

# Canonical codes with their default severity, and accepted other names.
CODES = {
    "wrong_meaning": "fail", "possible_omission": "warning", "added_meaning": "warning", "hallucination": "fail",
    "bad_name": "warning", "bad_honorific": "warning", "wrong_pronoun_or_relationship": "warning",
    "too_literal": "warning", "too_wordy": "warning", "register_softened": "warning", "censored_or_refused": "fail",
    "cjk_leakage": "warning", "subtitle_constraint_violation": "warning", "bad_asr_source": "warning",
    "bad_ocr_source": "warning", "timing_unreadable": "warning", "needs_human_review": "warning"}
ALIASES = {
    "missing_final_line": "possible_omission", "non_english_leakage": "cjk_leakage",
    "possible_added_meaning": "added_meaning", "final_literal_entity_drift": "wrong_meaning",
    "possible_context_hallucination": "hallucination", "llm_judge_review": "needs_human_review",
    "llm_judge_unavailable": "needs_human_review"}


def _table(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def normalize_code(code: Column) -> Column:
    names = {**{c: c for c in CODES}, **ALIASES}
    return F.coalesce(F.try_element_at(_table(names), F.lower(strip(code))), F.lit("needs_human_review"))


def normalize_severity(code: Column, severity: Column) -> Column:
    s = F.lower(strip(severity))
    return F.when(s.isin("fail", "warning"), s).otherwise(F.try_element_at(_table(CODES), normalize_code(code)))
