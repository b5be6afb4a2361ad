"""Media catalogues from probe JSON, and language names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE_SCHEMA = ("streams array<struct<index: bigint, codec_type: string, codec_name: string, channels: bigint, "
                "sample_rate: string, tags: map<string,string>>>, "
                "format struct<format_name: string, duration: string, size: string>")

# Container language names, bitmap codecs, and the alias sets of the language packs.
LANGUAGE_NAMES = {
    "jpn": "ja", "ja": "ja", "japanese": "ja", "eng": "en", "en": "en", "english": "en", "fre": "fr", "fra": "fr",
    "french": "fr", "chi": "zh", "zho": "zh", "chinese": "zh", "und": "und"}
BITMAP_CODECS = ("dvd_subtitle", "pgssub", "xsub")
PACK_ALIASES = {
    "en": ("en", "eng", "en-us", "en-gb", "english"), "ja": ("ja", "jpn", "jp", "ja-jp", "japanese"),
    "es": ("es", "spa", "es-es", "es-mx", "spanish"), "ko": ("ko", "kor", "ko-kr", "korean"),
    "zh": ("zh", "zho", "chi", "zh-cn", "zh-tw", "chinese", "cmn")}


def container_language(c: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.when(c != "", F.coalesce(F.try_element_at(m, F.lower(c)), F.lower(c)))


def normalize_language(c: Column, languages=tuple(PACK_ALIASES)) -> Column:
    """Canonical code of a tag by alias or by its part before ``-``; unknown tags stay (F2)."""
    pairs = [(a, lang) for lang in languages for a in PACK_ALIASES[lang]]
    m = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    code = F.lower(F.trim(c))
    return F.coalesce(F.try_element_at(m, code), F.try_element_at(m, F.split_part(code, F.lit("-"), F.lit(1))), c)


def lang_matches(c: Column, target: str) -> Column:
    code = F.lower(F.trim(c))
    aliases = PACK_ALIASES.get(target, (target,))
    return F.coalesce((c != "") & (code.isin(*aliases) | F.split_part(code, F.lit("-"), F.lit(1)).isin(*aliases)), F.lit(False))


def parse_catalog(probes: DataFrame, column: str = "value") -> DataFrame:
    """Per title: format, duration and its streams as an array with a number per kind."""
    p = F.from_json(F.col(column), PROBE_SCHEMA)
    rest = [c for c in probes.columns if c != column]
    raw = probes.select(*rest, p.alias("p"))

    def stream(s):
        raw_lang = F.try_element_at(s["tags"], F.lit("language"))
        codec = F.coalesce(s["codec_name"], F.lit("unknown"))
        return F.struct(F.coalesce(s["index"], F.lit(-1)).alias("index"), s["codec_type"].alias("kind"), codec.alias("codec"),
                        F.coalesce(s["channels"], F.lit(2)).alias("channels"),
                        F.coalesce(s["sample_rate"].try_cast("int"), F.lit(48000)).alias("sample_rate"),
                        container_language(raw_lang).alias("language"), raw_lang.alias("raw_language"),
                        F.try_element_at(s["tags"], F.lit("title")).alias("title"),
                        codec.isin(*BITMAP_CODECS).alias("is_bitmap"))

    all_streams = F.transform(F.coalesce("p.streams", F.array()), stream)
    return raw.select(*rest, F.coalesce("p.format.format_name", F.lit("unknown")).alias("format_name"),
                      F.col("p.format.duration").try_cast("double").alias("duration"), all_streams.alias("streams"))


def read_media_catalog(spark: SparkSession, paths) -> DataFrame:
    probes = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_catalog(probes)


def explode_streams(media: DataFrame) -> DataFrame:
    """One row per stream; ``ord`` counts the streams of a kind. Row-local, no window."""
    rest = [c for c in media.columns if c != "streams"]
    kinds = F.array_distinct(F.transform("streams", lambda s: s["kind"]))
    numbered = F.flatten(F.transform(kinds, lambda k: F.transform(
        F.filter("streams", lambda s: s["kind"] == k), lambda s, i: F.struct(i.cast("bigint").alias("ord"), s.alias("s")))))
    return media.select(*rest, F.inline(numbered)).select(*rest, "ord", "s.*")


def filter_tracks(streams: DataFrame, kind: str, languages, subtitle_filter: str = "text") -> DataFrame:
    """Tracks of a kind in the given languages; text or bitmap subtitles (F1)."""
    lang = F.lower(F.coalesce("language", "raw_language", F.lit("und")))
    out = streams.filter((F.col("kind") == kind) & lang.isin(*[x.lower() for x in languages]))
    if kind == "subtitle" and subtitle_filter in ("text", "bitmap"):
        out = out.filter(F.col("is_bitmap") == (subtitle_filter == "bitmap"))
    return out.withColumn("detected_language", lang)


def choose_audio(streams: DataFrame, title: str = "media", preferred=("ja", "jpn")) -> DataFrame:
    """Per title the number of its audio track in the first preferred language, else 0.

    ``streams``: kind, ord and language of every stream (:func:`explode_streams`). A title
    without audio has 0 too.
    """
    prio = F.lit(len(preferred))
    for i in range(len(preferred) - 1, -1, -1):
        prio = F.when(F.col("language") == container_language(F.lit(preferred[i])), i).otherwise(prio)
    hit = F.when((F.col("kind") == "audio") & (prio < len(preferred)), F.struct(prio.alias("p"), F.col("ord").alias("o")))
    return streams.groupBy(title).agg(F.coalesce(F.min(hit)["o"], F.lit(0)).cast("bigint").alias("audio_ord"))


# File endings of media files.
MEDIA_ENDINGS = ("mkv", "mp4", "avi", "mov", "m4v", "webm")


def list_media(spark: SparkSession, folder: str, recursive: bool = False, endings=MEDIA_ENDINGS) -> DataFrame:
    """path, length, modified of the media files of a folder (S8). Contents are never read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(endings) + "}")
             .option("recursiveFileLookup", str(recursive).lower()).load(folder))
    return files.select("path", "length", F.col("modificationTime").alias("modified"))
