"""Training pairs from matches and segment logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = ("struct<start: double, start_time: double, `end`: double, end_time: double, duration: double, text: string, "
           "text_ja: string>")


def parse_segment_log(logs: DataFrame, column: str = "value") -> DataFrame:
    """Segments of a log that is a list or an object with ``segments``; 1-based ``index``."""
    rest = [c for c in logs.columns if c != column]
    bare = F.from_json(F.col(column), f"array<{SEGMENT}>")
    boxed = F.from_json(F.col(column), f"segments array<{SEGMENT}>")["segments"]
    segs = F.when(F.trim(F.col(column)).startswith("["), bare).otherwise(boxed)
    s = logs.select(*rest, F.posexplode(segs).alias("index", "s"))
    return s.select(*rest, (F.col("index") + 1).cast("bigint").alias("index"), F.coalesce("s.text_ja", "s.text", F.lit("")).alias("japanese_text"),
                    F.coalesce("s.start", "s.start_time", F.lit(0.0)).alias("start_time"),
                    F.coalesce("s.end", "s.end_time", F.lit(0.0)).alias("end_time"),
                    F.coalesce(F.col("s.duration"), F.coalesce("s.end", F.lit(0.0)) - F.coalesce("s.start", F.lit(0.0))).alias("duration"))


def similarity_band(matches: DataFrame, low: float, high: float) -> DataFrame:
    """Half-open band."""
    return matches.filter((F.col("similarity") >= low) & (F.col("similarity") < high))


def training_pairs(matches: DataFrame, log: DataFrame, keys, low: float = 0.0, high: float = 1.0, also=()) -> DataFrame:
    """Matches in the band with their source text; a match without one is dropped (J8). ``also``: columns of the matches that go along."""
    keys = list(keys)
    m = similarity_band(matches, low, high)
    return m.join(log, [*keys, "index"]).select(
        *keys, *also, "index", "similarity", "japanese_text", F.col("generated_text").alias("generated_translation"),
        F.col("reference_text").alias("reference_translation"), "start_time", "end_time", "duration")


def write_training_pairs(pairs: DataFrame, out: str, fmt: str = "jsonl", compression: str | None = None) -> None:
    """jsonl, csv or a three-section text (K2), as plain files or with a codec such as ``gzip``."""
    writer = lambda df: df.write.mode("overwrite").options(**({"compression": compression} if compression else {}))
    if fmt == "jsonl":
        writer(pairs).json(out)
    elif fmt == "csv":
        writer(pairs).option("header", "true").option("escape", '"').csv(out)
    elif fmt == "txt":
        writer(pairs.select(F.format_string("Japanese: %s\nGenerated: %s\nReference: %s\n", "japanese_text", "generated_translation",
                                            "reference_translation").alias("value"))).text(out)
    else:
        raise ValueError(f"unknown format {fmt}")


def read_merged(spark: SparkSession, paths, schema) -> DataFrame:
    """Pair files of many titles as one table; the title is the folder name."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+/[^/]+$", 1)
    return spark.read.schema(schema).json(paths).select("*", folder.alias("source_video"))


PER_SEGMENT = ["generated_index", "reference_index", "similarity", "time_diff", "generated_text", "reference_text"]


def write_per_segment(matches: DataFrame, out: str, as_csv: bool = False) -> None:
    """The six comparison fields as CSV or JSON lines (K9)."""
    w = matches.select(*PER_SEGMENT).write.mode("overwrite")
    w.option("header", "true").option("escape", '"').csv(out) if as_csv else w.json(out)


def append_log(rows: DataFrame, out: str) -> None:
    """Append status or drift rows as JSON lines."""
    rows.write.mode("append").json(out)


# Keys whose values are hidden, always and in reports.
REDACTED = ("file", "file_path", "video_path", "input_path", "output_path", "qc_json", "origin_stream")
REDACTED_REPORT = ("video", "planned_output_srt", "output_srt", "qc_json", "review_ui_output")


def redact(js: Column, report: bool = False) -> Column:
    """Hide string, number and literal values of sensitive keys in JSON text at any depth (F8)."""
    keys = "|".join(sorted({*REDACTED, *(REDACTED_REPORT if report else ())}))
    scalar = r'(?:"(?:[^"\\]++|\\.)*+"|-?\d[\d.eE+-]*|true|false|null)'
    out = F.regexp_replace(js, rf'"({keys})"\s*:\s*{scalar}', '"$1":"<redacted>"')
    if report:
        out = F.regexp_replace(out, r'"stream"\s*:\s*"sidecar:(?:[^"\\]++|\\.)*+"', '"stream":"sidecar:<redacted>"')
    return out
