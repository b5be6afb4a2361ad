import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text) or (doc_id, text, lang) rows, in several partitions."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)
    return make


LONG = "word " * 30_000 + "end"

# Nulls, empty and very long texts, ties and repeated rows.
HARD = [(1, None), (2, ""), (None, "alone without id"), (3, LONG), (4, LONG), (5, "Same Text"), (6, "same text"), (6, "same text"),
        (6, "same text"), (7, " \n\t "), (None, None), (8, "one two three"), (9, "1 2 3 !!"), (None, "alone without id")]


@pytest.fixture(scope="session")
def hard(docs_of):
    return docs_of(HARD)


@pytest.fixture(scope="session")
def clashing(hard):
    """The same rows with columns named like those the operators use inside."""
    from pyspark.sql import functions as F

    names = ("h", "fp", "digest", "norm", "size", "slot", "arc", "th", "unit", "start", "end", "words", "kept_id", "kept_hash", "gone_id",
             "component_id", "score", "rejected", "lang_pred", "part", "segment", "item_id", "at", "r", "k", "span_list", "copies", "l", "d", "t")
    return hard.select("*", *[F.lit(7).alias(n) for n in names])
