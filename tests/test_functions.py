import difflib
import random

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.functions import timecode as tc
from cuelake.functions.names import catalog_id, retry_model
from cuelake.functions.taxonomy import normalize_code, normalize_severity
from cuelake.operators import guards, metrics, terms
from cuelake.operators.memory import tm_similarity


def one(spark, col, **vals):
    df = spark.createDataFrame([tuple(vals.values())], list(vals)) if vals else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def test_timecodes(spark):
    assert one(spark, tc.ms_to_srt(F.lit(90_500))) == "00:01:30,500"
    assert one(spark, tc.ms_to_srt(F.lit(360_000_000))) == "100:00:00,000"
    assert one(spark, tc.ms_to_srt(F.lit(-5), clamp=True)) == "00:00:00,000"
    assert one(spark, tc.srt_to_ms(F.lit(" 00:01:30,500"))) == 90_500
    assert one(spark, tc.srt_to_ms(F.lit("nope"))) is None
    with pytest.raises(Exception, match="negative"):
        one(spark, tc.ms_to_srt(F.col("m")), m=-1)


def test_fixed_rounds_half_up(spark):
    assert one(spark, tc.fixed(F.lit(125), F.lit(1000), 2)) == "0.13"
    assert one(spark, tc.sec(F.lit(-61_005))) == "-61.005"


def test_formatting_and_lines(spark):
    assert one(spark, tx.strip_formatting(F.lit("{\\an8}<i>Hi\\Nyou</i> "))) == "Hi you"
    assert one(spark, tx.display_lines(F.lit("a\nb\n"))) == ["a", "b"]
    assert one(spark, tx.display_lines(F.lit(""))) == []


def test_wrap_and_split(spark):
    assert one(spark, tx.wrap_lines(F.lit("aaa bbb ccc"), 7)) == "aaa bbb\nccc"
    assert one(spark, tx.wrap_lines(F.lit("abcdefghij kl"), 5)) == "abcdefghij\nkl"
    assert one(spark, tx.split_by_punctuation(F.lit("One two. Three four. Five"), 10)) == ["One two.", "Three four", ". Five"]
    assert one(spark, tx.split_by_punctuation(F.lit("short"), 10)) == ["short"]


def test_cjk(spark):
    t = "You've got to be kidding me.三次元の話"
    assert one(spark, tx.recover_prefix(F.lit(t))) == "You've got to be kidding me."
    assert one(spark, tx.recover_prefix(F.lit("Why are you三次元三次元"))) is None
    assert one(spark, tx.recover_prefix(F.lit("三次元 tail text here ok"))) is None
    assert one(spark, tx.strip_cjk(F.lit("こんにちはHello there"))) == "Hello there"
    assert one(spark, tx.strip_cjk(F.lit("こんにちは"))) == "こんにちは"


def test_keywords(spark):
    assert one(spark, tx.keywords(F.lit("The Red house would stand"))) == ["red", "house", "stand"]
    assert one(spark, tx.missing_terms(F.lit("Anna Anna runs quickly"), F.lit("runs"))) == ["anna", "anna", "quickly"]


def test_reply_parsing(spark):
    got = one(spark, guards.numbered_reply(F.lit("1. one\n 2) two\n3.\nx\n2. deux")))
    assert [(r["pos"], r["text"]) for r in got] == [(1, "one"), (2, "two"), (2, "deux")]
    assert one(spark, tx.first_reply_line(F.lit("\n English : hi \nmore"))) == "hi"
    assert one(spark, tx.first_reply_line(F.lit(" \n"))) is None


def test_tags(spark):
    assert one(spark, tx.normalize_tags(F.array(F.lit(" b"), F.lit(""), F.lit("a"), F.lit("b")))) == ["a", "b"]
    assert one(spark, tx.normalize_tags(F.lit(None).cast("array<string>"))) == []


def test_names(spark):
    assert one(spark, catalog_id(F.lit("[x] heyzo-1234.mp4")))["canonical_id"] == "HEYZO-1234"
    assert one(spark, catalog_id(F.lit("abc00123.mkv")))["canonical_id"] == "ABC-123"
    assert one(spark, catalog_id(F.lit("X264 12.mkv"))) is None
    assert one(spark, retry_model(F.lit("other"))) == "llama3"


def test_taxonomy(spark):
    assert one(spark, normalize_code(F.lit(" Missing_Final_Line "))) == "possible_omission"
    assert one(spark, normalize_code(F.lit("zzz"))) == "needs_human_review"
    assert one(spark, normalize_severity(F.lit("hallucination"), F.lit("odd"))) == "fail"


def test_term_in_text(spark):
    assert one(spark, terms.term_in_text(F.lit("Taro"), F.lit("Hi taro!"))) is True
    assert one(spark, terms.term_in_text(F.lit("Taro"), F.lit("Tarot"))) is False
    assert one(spark, terms.term_in_text(F.lit("先輩"), F.lit("ねえ先輩"))) is True


@pytest.mark.parametrize("raw,new,reason", [
    ("Hello Anna", "Hello Bob", "noun_change"), ("same", "same", None), ("one two three", "one", "length_ratio"),
    ("one two three", "one two four", None), ("", "anything", None)])
def test_drift(spark, raw, new, reason):
    df = spark.createDataFrame([(raw, new)], "raw string, new string")
    assert guards.with_drift(df, "raw", "new").first()["drift_reason"] == reason


def test_tm_similarity(spark):
    def want(q, m):
        q, m = q.strip(), m.strip()
        if not q or not m:
            return 0.0
        if q == m:
            return 1.0
        if m in q or q in m:
            return min(len(q), len(m)) / max(len(q), len(m))
        g = lambda t: {t} if len(t) <= 2 else {t[i:i + 2] for i in range(len(t) - 1)}
        return len(g(q) & g(m)) / len(g(q) | g(m))
    rows = [("abc", "abd"), ("ab", "xaby"), ("a", "cab"), ("", "x"), ("same", "same"), ("日本語", "日本人")]
    df = spark.createDataFrame(rows, "q string, m string").withColumn("s", tm_similarity(F.col("q"), F.col("m")))
    for r in df.collect():
        assert abs(r["s"] - want(r["q"], r["m"])) < 1e-12


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def pairs(n=60, seed=3):
    rnd = random.Random(seed)
    ws = ["the", "a", "Été", "dog", "runs,", "no.", "42-1", "x&y", "日本", "ok"]
    text = lambda: " ".join(rnd.choice(ws) for _ in range(rnd.randint(1, 12)))
    return [(i % 3, i, text(), text() if i % 4 else "") for i in range(n)]


def test_wer_against_dynamic_programming(spark):
    rows = pairs()
    df = spark.createDataFrame(rows, "media int, idx int, ref_text string, cand_text string")
    got = {r["media"]: (r["word_edits"], r["ref_words"]) for r in metrics.corpus_wer(df, ["media"]).collect()}
    for m in range(3):
        mine = [r for r in rows if r[0] == m]
        assert got[m] == (sum(_edits(r[2].split(" "), [w for w in r[3].split(" ") if w]) for r in mine),
                          sum(len(r[2].split(" ")) for r in mine))


def test_wer_of_empty_reference_is_one(spark):
    df = spark.createDataFrame([(1, 0, "", "a"), (1, 1, "b", "b")], "media int, idx int, ref_text string, cand_text string")
    assert metrics.corpus_wer(df, ["media"]).first()["wer"] == 1.0


def test_word_edits_against_dynamic_programming_with_blocks_of_all_sizes():
    rnd = random.Random(11)
    for _ in range(3000):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(14))] for _ in "ab")
        assert metrics.word_edits(a, b, rnd.choice([1, 2, 3, 5, 64])) == _edits(a, b)
    long = [str(rnd.randrange(50)) for _ in range(700)]
    assert metrics.word_edits(long, long[5:] + ["x"], 256) == _edits(long, long[5:] + ["x"])


def test_wer_of_missing_texts_counts_nothing(spark):
    df = spark.createDataFrame([(1, 0, "a\t\tb c", "a b\u3000c"), (1, 1, "d", None), (1, 2, None, "e"), (2, 0, None, None)],
                               "media int, idx int, ref_text string, cand_text string")
    got = {r["media"]: (r["word_edits"], r["ref_words"]) for r in metrics.corpus_wer(df, ["media"]).collect()}
    # a single wide blank does not part words
    assert got == {1: (2, 4), 2: (None, None)}


def test_tokens_are_parted_at_marks_and_numbers_stay_whole(spark):
    marked = 'He said:  "1,000.5 - no, no."\u2003\n'
    got = one(spark, metrics.tokenize_13a(F.col("t")), t=marked)
    assert got.split() == ["He", "said", ":", '"', "1,000.5", "-", "no", ",", "no", ".", '"']
    assert one(spark, metrics.tokenize_13a(F.col("t")), t="1-2 x-\ny &amp; a.,b ,. 3").split() == [
        "1", "-", "2", "xy", "&", "a", ".", ",", "b", ",", ".", "3"]
    # a hyphen before the last line break stays
    assert one(spark, metrics.tokenize_13a(F.col("t")), t="well-\n").split() == ["well-"]


def test_gram_counts_against_counter():
    from collections import Counter
    rows = pairs(80, 9)
    ref, hyp = ["".join(r[2].split()) for r in rows], ["".join(r[3].split()) for r in rows]
    metrics.GRAM_SLICE, keep = 150, metrics.GRAM_SLICE
    got = metrics._sliced(ref, hyp, 6, True)
    metrics.GRAM_SLICE = keep
    for r, h, g in zip(ref, hyp, got):
        for n in range(1, 7):
            a = Counter(r[i:i + n] for i in range(len(r) - n + 1))
            b = Counter(h[i:i + n] for i in range(len(h) - n + 1)) if a else Counter()
            assert list(g[3 * n - 3:3 * n]) == [sum((a & b).values()), sum(b.values()), sum(a.values())]


def test_bleu_identity_and_hand_value(spark):
    df = spark.createDataFrame([(1, 0, "the cat sat on the mat today", "the cat sat on the mat today"),
                                (2, 0, "the cat is on the mat", "the the the the the the")],
                               "media int, idx int, ref_text string, cand_text string")
    got = {r["media"]: r for r in metrics.corpus_bleu(df, ["media"], detail=True).collect()}
    assert got[1]["bleu"] == 100.0 and got[1]["bp"] == 1.0
    # 2 of 6 unigrams, then smoothed 100/(2*5), 100/(4*4), 100/(8*3)
    want = (100 * 2 / 6 * 10 * 6.25 * (100 / 24)) ** 0.25
    assert abs(got[2]["bleu"] - want) < 0.01


def test_similarity_is_the_matching_block_ratio(spark):
    rows = pairs(30, 5)
    df = spark.createDataFrame(rows, "media int, idx int, ref_text string, cand_text string")
    for r in metrics.seq_ratio(df, "ref_text", "cand_text", normalize=False).collect():
        assert abs(r["similarity"] - difflib.SequenceMatcher(None, r["ref_text"], r["cand_text"]).ratio()) < 1e-12


def test_ter_counts_a_shift_once(spark):
    df = spark.createDataFrame([(1, 0, "a b c d e f", "d e f a b c")], "media int, idx int, ref_text string, cand_text string")
    r = metrics.corpus_ter(df, ["media"]).first()
    assert r["edits"] == 1 and r["ref_words"] == 6
