"""Names: catalogue ids in file names, follow-up models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern families in order, each with the groups that make the id, and the
# words that are no studio code.
FAMILIES = (
    ("fc2_ppv", r"(?<![A-Z0-9])(FC2)[-_ ]?(PPV)[-_ ]?(\d{6,8})(?!\d)", (1, 2, 3)),
    ("caribbean", r"(?<![A-Z0-9])(CARIB(?:BEANCOM)?)[-_ ]?(\d{6})[-_ ]?(\d{3})(?!\d)", (1, 2, 3)),
    ("heyzo", r"(?<![A-Z0-9])(HEYZO)[-_ ]?(\d{4})(?!\d)", (1, 2)),
    ("studio_serial", r"(?<![A-Z0-9])([A-Z]{2,10})[-_ ]?0*(\d{2,5})(?!\d)", (1, 2)),
)
GENERIC_WORDS = ("AAC", "AVC", "BD", "BDRIP", "FHD", "H264", "H265", "HEVC", "UHD", "WEB", "WEBDL", "X264", "X265")
FOLLOW_UP = {"mistral": "llama3", "llama3": "qwen2.5:7b", "qwen2.5:7b": "llama3.1"}


def catalog_id(file_name: Column, families=FAMILIES, generic=GENERIC_WORDS) -> Column:
    """Struct (canonical_id, id_family) of the first pattern family found in the name."""
    stem = F.upper(F.regexp_replace(F.regexp_replace(file_name, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", ""))
    norm = F.trim(F.regexp_replace(F.regexp_replace(stem, r"[\[\]().]+", " "), r"\s+", " "))
    options = []
    for name, pat, groups in families:
        parts = [F.regexp_extract(norm, pat, g) for g in groups]
        hit = norm.rlike(pat) & ~parts[0].isin(*generic)
        options.append(F.when(hit, F.struct(F.concat_ws("-", *parts).alias("canonical_id"), F.lit(name).alias("id_family"))))
    return F.coalesce(*options)


def retry_model(model: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in FOLLOW_UP.items() for x in kv])
    return F.coalesce(F.try_element_at(m, model), F.lit("llama3"))
