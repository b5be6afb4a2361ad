"""Steps that cost more than the work asked for: ratio of pairs, terms in texts, marker lists."""

import difflib
import random

from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.operators import qc, terms, timing
from cuelake.operators.metrics import matched_chars, seq_ratio


def test_matched_chars_are_those_of_difflib():
    rnd = random.Random(5)
    letters = ["ab", "abcdefgh ", "".join(chr(97 + i) for i in range(300))]
    for i in range(400):
        a = "".join(rnd.choices(letters[i % 3], k=rnd.choice([0, 1, 20, 199, 200, 230, 430])))
        b = a[:rnd.randrange(len(a) + 1)] + "".join(rnd.choices(letters[i % 3], k=rnd.choice([0, 1, 20, 200]))) + a[len(a) // 2:]
        blocks = difflib.SequenceMatcher(None, a, b).get_matching_blocks()
        assert matched_chars(a, b) == sum(x.size for x in blocks), (a, b)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_terms_are_found_without_a_row_per_place(spark):
    raw = [(1, 0, "term", "s", "th", "TH", "on"), (1, 1, "name", "s", "太郎", "Taro", "true"), (1, 2, "term", "s", "a", "A", "on")]
    glossary = terms.glossary_entries(spark.createDataFrame(
        raw, "layer int, ord int, kind string, scope string, source string, target string, required string"))
    cues = spark.createDataFrame([(1, 0, "the 太郎"), (1, 1, "xx"), (1, 2, ""), (1, 3, None), (None, 4, "math"), (None, 4, "math")],
                                 "k int, idx bigint, text string")
    few = terms.glossary_match(cues, glossary, ["k"], max_terms=None)
    many = terms.glossary_match(cues, glossary, ["k"], max_terms=None, few_terms=0)
    assert "Generate" not in plan(few) and "Generate" in plan(many)
    key = lambda r: tuple(map(str, r))
    assert sorted(few.collect(), key=key) == sorted(many.collect(), key=key) and few.count() == 4


def test_markers_lower_a_text_once(spark):
    rows = spark.createDataFrame([("It is NOT sure",), ("clear",), (None,)], "t string")
    hit = rows.select(tx.contains_any(F.col("t"), ("not sure", "x", "y", "z")).alias("h"))
    assert [r.h for r in hit.collect()] == [True, False, None]
    assert plan(hit).count("lower(") == 1
    assert [r[0] for r in rows.select(tx.contains_any(F.col("t"), ())).collect()][:2] == [False, False]


def test_heuristics_strip_a_text_once(spark):
    cues = spark.createDataFrame([(1, 0, " セックス ", "do that"), (1, 1, None, None), (1, 2, "a long enough source", " x ")],
                                 "k int, idx bigint, source_text string, text string")
    found = qc.translation_heuristics(cues, ["k"], profile="live_action_adult")
    assert plan(found).count("trim(") <= 2
    assert {(r.cue_index, r.type) for r in found.collect()} == {
        (1, "translation_possible_softened_adult_dialogue"), (3, "translation_possible_omission")}


def test_ratio_of_pairs_reads_them_once(spark):
    long = "a quick brown fox " * 20
    rows = [(1, "The cat!", "the  cat"), (1, "abcd", "bcde"), (2, None, "x"), (2, long, long[5:] + "jumps"), (2, long, long[5:] + "jumps")]
    out = seq_ratio(spark.createDataFrame(rows, "k int, l string, r string"), "l", "r")
    assert plan(out).count("LogicalRDD") == 1
    got = {(r.l, r.r): r.similarity for r in out.collect()}
    norm = lambda x: " ".join(x.split())
    assert out.count() == 5 and got["The cat!", "the  cat"] == 1.0 and got["abcd", "bcde"] == 0.75 and got[None, "x"] == 1.0
    assert got[long, long[5:] + "jumps"] == difflib.SequenceMatcher(None, norm(long), norm(long[5:] + "jumps")).ratio()


def test_similarity_queries_have_their_texts(spark, tmp_path):
    from cuelake.plans import q_qc

    docs = [(1, "One line of words.\nAnother line of words here.", "en", "x"), (2, None, "en", "x"), (3, "a b c d e f g", None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = q_qc.similarities(spark, str(tmp_path))
    assert {"media", "cand", "ref_text", "cand_text", "similarity"} <= set(found.columns)
    assert all(0 <= r.similarity <= 1 for r in found.collect()) and found.count() > 0


def test_cues_are_cut_once(spark):
    long = "First sentence goes here. " * 8
    cues = spark.createDataFrame([(1, 0, 0, 9000, long), (1, 1, 8500, 8600, "x"), (1, 2, 9000, 9100, " "), (1, 3, 9200, 30000, "." * 90)],
                                 "k int, idx bigint, start_ms bigint, end_ms bigint, text string")
    cut = timing.split_long(cues, ["k"])
    assert plan(cut).count("aggregate(") == 1
    out = timing.prepare_cues(cues, ["k"])
    assert "aggregate(" not in plan(out)
    assert {r.idx for r in out.collect()} == {0, 1, 3} and "".join(r.text for r in out.orderBy("idx", "part").collect() if r.idx == 3) == "." * 90
