"""Language and domain packs as tables, from constants or from pack files: aliases, routing rules and glossaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.sources.catalog import PACK_ALIASES

# The packs (source, target). Each takes untagged audio for its source language.
PACKS = (("en", "en"), ("es", "en"), ("ja", "en"), ("ko", "en"), ("zh", "en"))


def pack_table(spark: SparkSession, packs=PACKS) -> DataFrame:
    """pack_id, source_language, target_language, untagged_language, workflow: one row per pack, in order of its id."""
    rows = [(f"{s}_{t}", s, t, s, "transcription_only" if s == t else "translate") for s, t in sorted(packs)]
    return spark.createDataFrame(rows, "pack_id string, source_language string, target_language string, untagged_language string, workflow string")


def alias_table(spark: SparkSession, packs=PACKS, aliases=PACK_ALIASES) -> DataFrame:
    """pack_id, language, alias: the tags that a pack takes for its two languages."""
    rows = [(f"{s}_{t}", lang, a) for s, t in sorted(packs) for lang in sorted({s, t}) for a in aliases[lang]]
    return spark.createDataFrame(rows, "pack_id string, language string, alias string")


PACK_FILE = ("pack_id string, kind string, layer int, source_language string, target_language string, untagged_language string, workflow string, "
             "aliases map<string, array<string>>, glossary array<struct<kind: string, source: string, target: string, required: string>>")


def read_packs(spark: SparkSession, paths) -> DataFrame:
    """Pack files, one JSON object each, with their place ``path``.

    ``kind`` is ``language`` or ``domain``; packs of a higher ``layer`` win over lower ones, without one a language pack is
    layer 1 and a domain pack layer 2. A file that is no JSON object has nothing but its path.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    p = files.select("path", F.from_json("value", PACK_FILE).alias("p")).select("path", "p.*")
    layer = F.coalesce("layer", F.when(F.col("kind") == "domain", F.lit(2)).otherwise(F.lit(1)))
    return p.withColumn("layer", F.when(F.col("pack_id").isNotNull(), layer))


def pack_rows(files: DataFrame) -> DataFrame:
    """The pack table (see :func:`pack_table`) of the language packs among the files."""
    flow = F.coalesce("workflow", F.when(F.col("source_language") == F.col("target_language"), "transcription_only").otherwise("translate"))
    return files.filter((F.col("kind") == "language") & F.col("pack_id").isNotNull()).select(
        "pack_id", "source_language", "target_language", F.coalesce("untagged_language", "source_language").alias("untagged_language"), flow.alias("workflow"))


def alias_rows(files: DataFrame) -> DataFrame:
    """The alias table (see :func:`alias_table`); a language is an alias of itself."""
    given = files.select("pack_id", F.explode("aliases").alias("language", "alias")).select("pack_id", "language", F.explode("alias").alias("alias"))
    own = files.filter(F.col("kind") == "language").select("pack_id", F.explode(F.array("source_language", "target_language")).alias("language"))
    return given.unionByName(own.select("pack_id", "language", F.col("language").alias("alias"))).filter(F.col("alias").isNotNull()).distinct()


def glossary_rows(files: DataFrame, pack_ids: list[str]) -> DataFrame:
    """Raw glossary entries of the packs in use, for ``terms.glossary_entries``: the layer of a pack, then its place among
    the packs named, decides which entry wins; within a pack the later one (S6, U3)."""
    place = F.array_position(F.array(*map(F.lit, pack_ids)), F.col("pack_id"))
    e = files.filter(F.col("pack_id").isin(pack_ids)).select("layer", "kind", place.alias("place"), F.posexplode("glossary").alias("ord", "e"))
    return e.select((F.col("layer") * len(pack_ids) + F.col("place") - 1).cast("int").alias("layer"), "ord", F.col("e.kind").alias("kind"),
                    F.col("kind").alias("scope"), "e.source", "e.target", "e.required")


def pack_of_track(tracks: DataFrame, target: str, packs: DataFrame, aliases: DataFrame, tag: str = "language",
                  untagged: str | None = None) -> DataFrame:
    """Tracks with ``pack_id`` and ``workflow`` for translation into ``target``.

    A tag counts by itself or by its part before ``-``. Tracks without a tag take the pack
    whose ``untagged_language`` is ``untagged``, if given; tags of no pack give null.
    """
    p = packs.filter(F.col("target_language") == target)
    a = aliases.join(p.select("pack_id", "source_language", "workflow"), "pack_id").filter(F.col("language") == F.col("source_language")).select(
        F.col("alias").alias("_tag"), F.col("pack_id").alias("_pack"), F.col("workflow").alias("_flow"))
    code = F.lower(F.trim(F.col(tag)))
    if untagged:  # a pack takes its source language as the tag of what has none
        code = F.when(F.coalesce(code, F.lit("")) == "", F.lit(untagged)).otherwise(code)
    t = tracks.withColumn("_full", code).withColumn("_base", F.split_part(code, F.lit("-"), F.lit(1)))
    full = a.select(F.col("_tag").alias("_full"), F.col("_pack").alias("_p1"), F.col("_flow").alias("_f1"))
    base = a.select(F.col("_tag").alias("_base"), F.col("_pack").alias("_p2"), F.col("_flow").alias("_f2"))
    j = t.join(full, "_full", "left").join(base, "_base", "left")
    return j.withColumn("pack_id", F.coalesce("_p1", "_p2")).withColumn("workflow", F.coalesce("_f1", "_f2")).drop(
        "_full", "_base", "_p1", "_p2", "_f1", "_f2")


def passthrough(candidates: DataFrame, target: str, id_col: str = "candidate_id") -> DataFrame:
    """Candidates of a transcription-only pack: the target's language, a marked id, and defaults that values already there win over."""
    out = candidates.withColumn(id_col, F.concat(id_col, F.lit("_transcription_only"))).withColumn("language", F.lit(target))
    for name, value in (("translation_workflow", F.lit("transcription_only")), ("translation_engine", F.lit("none")),
                        ("translation_skipped", F.lit(True))):
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in candidates.columns else value)
    return out
