"""Queries on model stages, with deterministic stand-in models over the dialogue texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import infer
from cuelake.plans import views as v
from cuelake.plans.registry import REG

K = v.TRACK


def _shout():
    return lambda texts: [t.lower() for t in texts]


def _fragile():
    def run(texts):
        if any(len(t) > 1500 for t in texts):
            raise ValueError("too long")
        return ["a: " + t for t in texts]
    return run


def _plain():
    return lambda texts: ["b: " + t for t in texts]


@REG.query(f"WITH {v.Q_DIALOGUE} SELECT media, idx, lower(text) AS out FROM v_dialogue")
def batch_infer(spark, d):
    return infer.batch_infer(v.dialogue(spark, d), _shout, "text", "out").select("media", "idx", "out")


@REG.query(f"WITH {v.Q_DIALOGUE} SELECT media, idx, CASE WHEN bad THEN 'b: ' ELSE 'a: ' END || text AS out, bad AS fallback, "
           "CASE WHEN bad THEN 'ValueError: too long' END AS fallback_reason FROM "
           "(SELECT *, max(length(text)) OVER (PARTITION BY media) > 1500 AS bad FROM v_dialogue)")
def infer_with_fallback(spark, d):
    return infer.infer_with_fallback(v.dialogue(spark, d), K, _fragile, _plain, "text", "out", batch=1).select(
        "media", "idx", "out", "fallback", "fallback_reason")


@REG.query(f"WITH {v.Q_DIALOGUE} SELECT media, idx, CASE WHEN (media + idx) % 4 = 0 THEN '  ' ELSE lower(text) END AS out FROM v_dialogue")
def infer_non_blank(spark, d):
    c = v.dialogue(spark, d).withColumn("text", F.when((F.col("media") + F.col("idx")) % 4 == 0, "  ").otherwise(F.col("text")))
    return infer.infer_non_blank(c, _shout, "text", "out").select("media", "idx", "out")


@REG.query(f"""WITH {v.Q_DIALOGUE}, p AS (SELECT media, idx, 'b: ' || text AS r, lower('b: ' || text) AS n FROM v_dialogue)
  SELECT media, idx, n AS text, CASE WHEN r = n THEN 'unchanged' ELSE 'polished' END AS outcome, CAST(NULL AS VARCHAR) AS warning,
    CAST(NULL AS VARCHAR) AS raw_text_error, CAST(NULL AS VARCHAR) AS new_text_error FROM p""")
def two_pass(spark, d):
    return infer.two_pass(v.dialogue(spark, d), K, _plain, _shout, "text").select(
        "media", "idx", "text", "outcome", "warning", "raw_text_error", "new_text_error")
