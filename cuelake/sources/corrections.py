"""Correction records: reading, checking and dataset projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.text import normalize_tags, strip

SCHEMA = ("source_lang string, target_lang string, domain string, source_text string, bad_translation string, "
          "approved_translation string, previous_context string, next_context string, speaker string, "
          "tags array<string>, notes string, language_pack string, created_at string")

# The system message and the reason text of the exported datasets.
SFT_SYSTEM = "You translate source-language subtitles into natural target-language subtitles."
PREFERENCE_REASON = "approved human correction preserves meaning better"
REQUIRED = ("source_text", "approved_translation", "source_lang", "target_lang")


def parse_corrections(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines to normalised records; lines that are not JSON objects are dropped."""
    rec = F.from_json(F.col(column), SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rest = [c for c in lines.columns if c != column]
    p = lines.select(*rest, rec.alias("r")).filter("r IS NOT NULL AND r._bad IS NULL").select(*rest, "r.*").drop("_bad")
    return normalize(p)


def read_corrections(spark: SparkSession, paths) -> DataFrame:
    return parse_corrections(spark.read.text(paths))


def _clean(c: str) -> Column:
    return strip(F.coalesce(F.col(c), F.lit("")))


def normalize(raw: DataFrame) -> DataFrame:
    """Trim, lower-case the languages and fill their defaults."""
    lang = lambda c, d: F.lower(strip(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))))
    out = raw.withColumn("source_lang", lang("source_lang", "ja")).withColumn("target_lang", lang("target_lang", "en"))
    for c in ("domain", "source_text", "bad_translation", "approved_translation", "previous_context", "next_context",
              "notes", "language_pack"):
        if c in raw.columns:
            out = out.withColumn(c, _clean(c))
    return out.withColumn("tags", normalize_tags(F.col("tags"))) if "tags" in raw.columns else out


def filtered(records: DataFrame, source_lang: str | None = None, target_lang: str | None = None,
             domain: str | None = None) -> DataFrame:
    """Equality filters; None means no filter."""
    for c, val in (("source_lang", source_lang and source_lang.strip().lower()),
                   ("target_lang", target_lang and target_lang.strip().lower()), ("domain", domain and domain.strip())):
        if val:
            records = records.filter(F.col(c) == val)
    return records


def _missing() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c) == "", F.lit(c)) for c in REQUIRED]))


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejects with ``ord`` and ``reason``)."""
    m = records.withColumn("_m", _missing())
    bad = m.filter(F.size("_m") > 0).select("ord", F.concat(F.lit("missing_required_fields:"), F.array_join("_m", ",")).alias("reason"))
    return m.filter(F.size("_m") == 0).drop("_m"), bad


def _reference() -> Column:
    return F.struct("source_text", F.col("approved_translation").alias("reference_translation"), "previous_context", "next_context",
                    "source_lang", "target_lang", "domain", "tags")


def reference_rows(valid: DataFrame) -> DataFrame:
    return valid.select("ord", _reference().alias("r")).select("ord", "r.*")


def _sft(system: str) -> Column:
    user = F.concat(F.lit("Context before: "), "previous_context", F.lit("\nSource: "), "source_text",
                    F.lit("\nContext after: "), "next_context")
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.struct(F.array(msg("system", F.lit(system)), msg("user", user), msg("assistant", F.col("approved_translation"))).alias("messages"),
                    F.struct("source_lang", "target_lang", "domain", "tags", "language_pack").alias("metadata"))


def sft_messages(valid: DataFrame, system: str = SFT_SYSTEM) -> DataFrame:
    return valid.select("ord", _sft(system).alias("r")).select("ord", "r.*")


def _preference() -> Column:
    return F.struct("source_text", F.col("bad_translation").alias("rejected_translation"), F.col("approved_translation").alias("chosen_translation"),
                    F.lit(PREFERENCE_REASON).alias("reason"), "source_lang", "target_lang", "domain", "tags")


def preference_pairs(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    has = F.col("bad_translation") != ""
    rows = valid.filter(has).select("ord", _preference().alias("r")).select("ord", "r.*")
    return rows, valid.filter(~has).select("ord", F.lit("missing_required_fields:bad_translation").alias("reason"))


def export_summary(raw: DataFrame, **filters) -> DataFrame:
    """Written and skipped rows of the four datasets, from one pass over the records."""
    r = filtered(normalize(raw), **filters).withColumn("_ok", F.size(_missing()) == 0)
    n, ok = F.count(F.lit(1)), F.count_if("_ok")
    pref = F.count_if(F.col("_ok") & (F.col("bad_translation") != ""))
    t = r.agg(n.alias("n"), ok.alias("ok"), pref.alias("pref"))
    row = lambda name, w: F.struct(F.lit(name).alias("dataset"), w.alias("written"), (F.col("n") - w).alias("skipped"))
    return t.select(F.inline(F.array(row("approved_corrections", F.col("ok")), row("benchmark", F.col("ok")),
                                     row("sft", F.col("ok")), row("preference_pairs", F.col("pref")))))


DATASETS = ("approved_corrections", "benchmark", "sft", "preference_pairs", "skipped_records")


def export_all(raw: DataFrame, out: str, **filters) -> DataFrame:
    """Write the four JSON-lines datasets and their rejects under ``out``; return the counts (K7).

    One scan and one write: each record becomes the lines that it has in the datasets, dealt into folders by dataset,
    and is counted on the way. ``out/dataset=<name>`` holds a dataset.
    """
    r = filtered(normalize(raw), **filters).withColumn("_m", _missing())
    ok, bad = F.size("_m") == 0, F.col("bad_translation") != ""
    seen = Observation()
    r = r.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"), F.count_if(ok & bad).alias("pref"))
    plain = [c for c in r.columns if c not in ("ord", "_m")]

    def line(name: str, when: Column, row: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("dataset"), F.to_json(row).alias("value")))

    def skipped(reason: Column) -> Column:
        return F.struct(reason.alias("reason"))

    missing = F.concat(F.lit("missing_required_fields:"), F.array_join("_m", ","))
    lines = F.array(line("approved_corrections", ok, F.struct(*plain)), line("benchmark", ok, _reference()), line("sft", ok, _sft(SFT_SYSTEM)),
                    line("preference_pairs", ok & bad, _preference()), line("skipped_records", ~ok, skipped(missing)),
                    line("skipped_records", ok & ~bad, skipped(F.lit("missing_required_fields:bad_translation"))))
    r.select(F.inline(F.array_compact(lines))).write.mode("overwrite").partitionBy("dataset").text(out)
    n = seen.get
    rows = [(d, n[k], n["n"] - n[k]) for d, k in zip(DATASETS, ("ok", "ok", "ok", "pref"))]
    return raw.sparkSession.createDataFrame(rows, "dataset string, written long, skipped long")


def add_corrections(raw: DataFrame, path: str) -> DataFrame:
    """Append the valid ones of new records to the store at ``path`` as JSON lines; return the rejects.

    Records are normalised first, as on reading. ``ord`` names a record in the rejects and is
    not stored; other columns are not stored either.
    """
    valid, bad = split_valid(normalize(raw))
    fields = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    valid.select(*[c for c in fields if c in valid.columns]).write.mode("append").json(path)
    return bad
