"""Texts of pairs: shuffled once, joined as before; training pairs and their files."""

import glob

from cuelake.operators import align, training
from cuelake.plans import q_align, q_export, views
from cuelake.session import tune


def _documents(spark, tmp_path):
    rows = [(i, "\n".join(f"Line {j} of {i} says more. Words {j * i} follow here" for j in range(5 + i % 4)), "en", "s") for i in range(12)]
    rows += [(3, "Another text\nof the same title\nin three lines", "en", "s"), (None, "no title\nhere", "en", "s"), (20, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _moved_by(df):
    """What the rows of a plan are dealt by, apart from rows without texts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.split("Exchange hashpartitioning(")[1].split(")")[0] for x in plan.splitlines() if "Exchange hashpartitioning(" in x]


def test_texts_are_dealt_by_title_only(spark, tmp_path):
    d = _documents(spark, tmp_path)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = q_align.aligned_texts(tune(spark), d)
        moved = _moved_by(t)
        got = sorted(map(tuple, t.collect()))
        tune(spark)
        want = sorted(map(tuple, align.with_texts(q_align.aligned(spark, d), views.cues(spark, d).drop("cand"),
                                                  views.cand_cues(spark, d), views.TRACK).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        tune(spark)
    assert moved and all("," not in x.rsplit(",", 1)[0] for x in moved), moved
    assert got and got == want


def test_training_pairs_query_has_texts(spark, tmp_path):
    d = _documents(spark, tmp_path)
    got = q_export.training_pairs(tune(spark), d).collect()
    m = align.align_with_tolerance(views.cand_cues(spark, d), q_align.ref_for_each(views.cues(spark, d), views.cand_cues(spark, d)), views.TRACK)
    band = {(r["media"], r["cand"], r["idx"] + 1) for r in m.filter("right_idx IS NOT NULL").collect()
            if 0.3 <= (r["media"] * 7 + r["idx"] * 13) % 100 / 100 < 0.9}
    assert band and {(r["media"], r["cand"], r["index"]) for r in got} == band
    assert all(r["generated_translation"] and r["reference_translation"] for r in got)
    assert len(set(map(tuple, got))) == len(got)
    tune(spark)


def test_training_pairs_take_columns_along(spark):
    m = spark.createDataFrame([(1, "a", 1, 0.5, "g", "r"), (1, "b", 1, 0.5, "g", "r"), (1, "a", 2, 0.95, "g", "r")],
                              "media bigint, cand string, index bigint, similarity double, generated_text string, reference_text string")
    log = spark.createDataFrame([(1, 1, "ja", 0.0, 1.0, 1.0), (1, 2, "ja", 0.0, 1.0, 1.0)],
                                "media bigint, index bigint, japanese_text string, start_time double, end_time double, duration double")
    got = training.training_pairs(m, log, ["media"], 0.3, 0.9, also=["cand"])
    assert got.columns[:3] == ["media", "cand", "index"]
    assert sorted((r["cand"], r["index"]) for r in got.collect()) == [("a", 1), ("b", 1)]


def test_pair_files_may_be_compressed(spark, tmp_path):
    rows = [(1, 1, 0.5, 'a "b"\nc', " g ", "r"), (1, 2, 0.25, "x,y", "", "ü")]
    cols = "media bigint, index bigint, similarity double, japanese_text string, generated_translation string, reference_translation string"
    p = spark.createDataFrame(rows, cols)
    training.write_training_pairs(p, f"{tmp_path}/j", compression="gzip")
    training.write_training_pairs(p, f"{tmp_path}/plain")
    assert glob.glob(f"{tmp_path}/j/*.json.gz") and not glob.glob(f"{tmp_path}/plain/*.gz")
    for x in ("j", "plain"):
        assert sorted(map(tuple, spark.read.schema(cols).json(f"{tmp_path}/{x}").collect())) == sorted(rows)


def test_lookup_scores_many_queries_together(monkeypatch):
    import pandas as pd

    from cuelake.operators import memory as tm

    texts = ["a", "ab", "abab", "bcab d", "先輩 ab", "ab", "é", "zz top", "abc" * 40]
    asked = sorted({*texts, "b", "d", "cab", "zz", "no gram", "top ab", "x"})
    m = pd.DataFrame({"ord": [5, 3, 9, 1, 7, 2, 8, 6, 4], "source_text": texts})
    q = pd.DataFrame({"qid": asked, "query_text": asked})
    grams = lambda t: {t} if len(t) <= 2 else {t[i:i + 2] for i in range(len(t) - 1)}

    def score(a, b):
        if a in b or b in a:
            return min(len(a), len(b)) / max(len(a), len(b))
        return len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    want = []
    for a in asked:
        rows = sorted((-score(a, t), t != a, o) for o, t in zip(m["ord"], texts) if score(a, t) > 0)
        want += [(a, o, -s, not other) for s, other, o in rows[:3]]
    for scores, letters, postings in ((2_000_000, 1_000_000, 4_000_000), (1, 1, 1), (40, 10, 7)):
        monkeypatch.setattr(tm, "SCORES", scores)
        monkeypatch.setattr(tm, "LETTERS", letters)
        monkeypatch.setattr(tm, "POSTINGS", postings)
        got = tm._lookup_block(3)(None, q, m)
        assert [tuple(r) for r in got.itertuples(index=False)] == want


def test_word_edits_step_through_what_differs(monkeypatch):
    from cuelake.operators import metrics

    seen = []
    whole = metrics._one_block
    monkeypatch.setattr(metrics, "_one_block", lambda r, h: seen.append((len(r), len(h))) or whole(r, h))
    assert metrics.word_edits(list("abXcdef"), list("abYZcdef")) == 2 and seen == [(2, 1)]
    assert metrics.word_edits(list("aXbYc"), list("abc")) == metrics.word_edits(list("abc"), list("aXbYc")) == 2
    assert [metrics.word_edits(list(a), list(b)) for a, b in (("", "ab"), ("ab", "ab"), ("aab", "ab"), ("kitten", "sitting"))] == [2, 0, 1, 3]
