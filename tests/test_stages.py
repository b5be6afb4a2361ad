"""Model stages, lineage and glossary rules that small tables show best."""

import random

import pytest

from cuelake.operators import infer, lineage, terms


def _random_model():
    import random as r

    def run(texts):
        if r.random() < 0.4:
            raise ValueError("model failed")
        return ["" if r.random() < 0.2 else f"m {r.random()}" for _ in texts]
    return run


def _second():
    return lambda texts: ["second " + t for t in texts]


@pytest.mark.parametrize("per_row", [True, False])
def test_fallback_keeps_every_key_once(spark, per_row):
    df = spark.range(200).selectExpr("id", "id % 20 AS track", "concat('text ', id) AS text").repartition(4)
    got = infer.infer_with_fallback(df, ["track"], _random_model, _second, "text", "out", per_row=per_row, batch=3).collect()
    assert sorted(r.id for r in got) == list(range(200))
    assert all(r.out is not None and r.fallback == (r.fallback_reason is not None) == r.out.startswith("second") for r in got)
    assert {r.fallback_reason for r in got} <= {None, "ValueError: model failed", "blank reply"}


def test_model_stages_run_once_per_row(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting():
        def run(texts):
            seen.add(len(texts))
            return ["lit " + t for t in texts]
        return run

    df = spark.range(120).selectExpr("id", "id % 7 AS track", "id AS idx", "concat('text ', id) AS text")
    assert infer.two_pass(df, ["track"], counting, counting, "text").count() == 120
    assert seen.value == 240
    assert infer.infer_with_fallback(df, ["track"], counting, _second, "text", "out").count() == 120
    assert seen.value == 360


def forest(n, seed):
    r = random.Random(seed)
    return [(i, r.randrange(i) if i and r.random() < 0.95 else None, r.choice([None, None, None, i])) for i in range(n)]


def test_lineage_with_cycles(spark):
    rows = [*forest(90, 5), *[(1000 + i, 1000 + i - 1, None) for i in range(1, 40)], (1000, 1001, 7), (2000, 9999, None), (2001, 2000, 3)]
    parent = {i: p for i, p, _ in rows}
    value = {i: v for i, _, v in rows}

    def up(i):
        out, seen = [], {i}
        while parent.get(i) in parent:
            i = parent[i]
            if i in seen:
                return None
            seen.add(i)
            out.append(i)
        return out

    t = spark.createDataFrame(rows, "id long, parent_id long, v long")
    paths, cyclic = lineage.ancestors(t)
    assert {r.id for r in cyclic.collect()} == {i for i in parent if up(i) is None} == set(range(1000, 1040))
    assert {(r.id, r.ancestor, r.distance) for r in paths.collect()} == {
        (i, a, d + 1) for i in parent if up(i) is not None for d, a in enumerate(up(i))}
    got = {r.id: r.v for r in lineage.propagate_meta(t, ["v"]).collect()}
    assert got == {i: next((value[x] for x in [i, *(up(i) or [])] if value[x] is not None), None) for i in parent}


def test_glossary_order_and_no_cap(spark):
    raw = [(1, k, "term", "s", s, s.upper(), "true") for k, s in enumerate(["zz", "yy", "xx"])]
    g = terms.glossary_entries(spark.createDataFrame(raw, "layer int, ord int, kind string, scope string, source string, target string, required string"))
    cues = spark.createDataFrame([(1, 0, "xx yy zz", "")], "media int, idx int, source_text string, text string")
    hits = terms.glossary_match(cues, g, ["media"], "source_text", max_terms=2).orderBy("rank").collect()
    assert [h.source for h in hits] == ["zz", "yy"]
    many = [(1, k, "term", "s", f"t{k:02d}", "absent", "true") for k in range(60)]
    g = terms.glossary_entries(spark.createDataFrame(many, "layer int, ord int, kind string, scope string, source string, target string, required string"))
    cues = spark.createDataFrame([(1, 0, " ".join(m[4] for m in many), "nothing")], "media int, idx int, source_text string, text string")
    assert terms.term_drift(cues, g, ["media"]).count() == 60


def test_glossary_matches_equal_containment(spark):
    """Terms over piece borders, a line of 100,000 letters, several slices, letters outside the basic plane, null and empty texts."""
    rnd = random.Random(5)
    letters = "abc \n先\U0001F600"
    terms_ = sorted({"".join(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 5, 70]))).strip() for _ in range(40)} - {""})
    texts = ["".join(rnd.choice(letters) for _ in range(n)) for n in (1, 5, 64, 65, 200, 1000)] + ["", None]
    texts += ["".join(rnd.choice(terms_) for _ in range(30)), "x" * 63 + terms_[-1] + "y" * 63, "ab" * 50_000 + "先"]
    g = spark.createDataFrame([("term", "s", t, t.upper(), True) for t in terms_], "kind string, scope string, source string, target string, required boolean")
    cues = spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], "media string, idx int, text string")
    want = {(i, t) for i, x in enumerate(texts) for t in terms_ if t in (x or "")}
    for size in (1000, 7):
        got = [(r.idx, r.source) for r in terms.glossary_match(cues, g, ["media"], max_terms=None, slice_terms=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert terms.glossary_match(cues, g.limit(0), ["media"]).count() == 0
