import random

from pyspark.sql import functions as F

from cuelake.operators import align, lifecycle, lineage, memory, qc, selection, terms, timing
from cuelake.sources import catalog, corrections, srt

CUE = "media string, idx bigint, start_ms bigint, end_ms bigint, text string"


def cues(n, seed, shift=0, span=40_000):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = rnd.randint(0, span) + shift
        out.append(("m", i, s, s + rnd.choice([0, 300, 2000, 9000]), f"t{i}"))
    return out


def brute_align(ref, cand):
    got = {}
    for _, i, s, e, _ in ref:
        best, ov = None, 0
        for _, j, s2, e2, _ in cand:
            o = max(0, min(e, e2) - max(s, s2))
            if o > ov:
                best, ov = j, o
        if best is None:
            best = min(cand, key=lambda c: abs((c[2] + c[3]) - (s + e)))[1]
        got[i] = best
    return got


def test_align_equals_brute_force(spark):
    for seed in (1, 2):
        ref, cand = cues(40, seed), cues(25, seed + 50, 5000)
        a = align.align(spark.createDataFrame(ref, CUE), spark.createDataFrame(cand, CUE), ["media"], bin_ms=1500)
        assert {r["idx"]: r["right_idx"] for r in a.collect()} == brute_align(ref, cand)


def test_long_cues_are_few_rows(spark):
    """Cues of all lengths, one of them from 0 to 10**9 ms: at most two rows a level, and the pairs of brute force."""
    rnd = random.Random(4)
    def some(n, seed):
        r = random.Random(seed)
        return [("m", i, s, s + r.choice([0, 500, 9_999, 10_000, 10_001, 79_000, 81_000, 700_000, 10_000_000]), f"t{i}")
                for i, s in enumerate(r.randint(0, 20_000_000) for _ in range(n))]
    ref, cand = some(60, 1) + [("m", 60, 0, 10 ** 9, "all")], some(40, 2) + [("m", 40, 5_000_000, 10 ** 9, "rest")]
    rnd.shuffle(ref)
    a = align.align(spark.createDataFrame(ref, CUE), spark.createDataFrame(cand, CUE), ["media"])
    assert {r["idx"]: r["right_idx"] for r in a.collect()} == brute_align(ref, cand)
    rows = spark.createDataFrame([("m", 0, 0, 10 ** 9, "")], CUE)
    s, e = F.col("start_ms"), F.col("end_ms")
    for place in (align.left_places, align.right_places):
        assert place(rows, s, e, F.lit(0)).count() <= 4  # its own level, for each way to meet
        assert place(rows, s, e, F.lit(align.LEVELS - 1)).count() <= 2 * align.LEVELS + 2


def test_nearest_over_many_slices(spark):
    ref, cand = cues(30, 7, span=10 ** 6), cues(10, 8, span=10 ** 6)
    n = align.nearest(spark.createDataFrame(ref, CUE), spark.createDataFrame(cand, CUE), ["media"], F.col("start_ms"), bin_width=50_000)
    got = {r["idx"]: r["right_idx"] for r in n.collect()}
    assert got == {i: min(cand, key=lambda c: abs(c[2] - s))[1] for _, i, s, _, _ in ref}


def test_align_without_partner_gives_no_pairs(spark):
    ref = spark.createDataFrame(cues(5, 1), CUE)
    assert align.align(ref, ref.limit(0), ["media"]).count() == 0


def brute_repair(rows, gap, short):
    fixed = sorted(([s, e, i] for _, i, s, e, _ in rows))
    for k in range(1, len(fixed)):
        p, c = fixed[k - 1], fixed[k]
        if c[0] >= p[1] + gap:
            continue
        if c[0] - gap >= p[0] + short:
            p[1] = c[0] - gap
        else:
            c[0] = p[1] + gap
            c[1] = max(c[1], c[0] + short)
    return {i: (s, e) for s, e, i in fixed}


def test_repair_equals_sequential_scan(spark):
    for seed, span in ((1, 30_000), (2, 200_000), (3, 5_000)):
        rows = [(m, i, s, max(e, s + 500), t) for m, i, s, e, t in cues(60, seed, span=span)]
        out = timing.repair_overlaps(spark.createDataFrame(rows, CUE), ["media"]).collect()
        assert {r["idx"]: (r["start_ms"], r["end_ms"]) for r in out} == brute_repair(rows, 50, 500)


def test_maps_of_parts_equal_sequential_scan():
    """A part as a function of the cue before it, for all kinds of cues and states."""
    rnd = random.Random(11)
    for _ in range(3000):
        gap, short = rnd.choice([(50, 500), (1, 3), (0, 1)])
        s = sorted(rnd.randint(0, rnd.choice([30, 300, 6000])) for _ in range(rnd.randint(1, 9)))
        e = [x + rnd.choice([0, 1, 4, short, 700, 2000]) for x in s]
        made = timing.part_map(s, e, gap, short)
        assert len(made["upto"]) == len(set(made["upto"])) and made["upto"] == sorted(made["upto"])
        for _ in range(4):
            a = rnd.randint(-700, s[0])
            before = [a, a + rnd.choice([0, 2, 500, 900, 4000]), -1]
            rows = [before, *([x, y, i] for i, (x, y) in enumerate(zip(s, e)))]
            last = list(before)
            for r in rows[1:]:
                if r[0] < last[1] + gap and r[0] - gap < last[0] + short:
                    r[0] = last[1] + gap
                    r[1] = max(r[1], r[0] + short)
                last = list(r)
            assert timing.after_part(made, (before[0], before[1]), gap, short) == (last[0], last[1])


def test_long_chains_are_repaired_in_parts(spark):
    """Chains longer than a part, among short ones and single cues; parts of one cue too."""
    rows = [(m, i, s, e, t) for k, m in enumerate("ab") for m, i, s, e, t in [(m, *c[1:]) for c in cues(150, k, span=(20_000, 60_000)[k])]]
    rows += [("c", i, i * 300, i * 300 + 280 + (i % 7) * 100, "t") for i in range(2000)] + [("d", 0, 5, 9, "alone")]
    table = spark.createDataFrame(rows, CUE).repartition(5)
    want = {(m, i): v for m in "abcd" for i, v in brute_repair([r for r in rows if r[0] == m], 50, 500).items()}
    for part in (1, 7, 100, 65_536):
        out = timing.repair_overlaps(table, ["media"], part_cues=part).collect()
        assert {(r["media"], r["idx"]): (r["start_ms"], r["end_ms"]) for r in out} == want
        assert len(out) == len(rows)


def test_prepare_keeps_invariants(spark):
    rows = [("m", i, i * 2000, i * 2000 + 9000, "One two three. Four five six! " * 4) for i in range(20)]
    out = sorted((r["start_ms"], r["end_ms"]) for r in timing.prepare_cues(spark.createDataFrame(rows, CUE), ["media"]).collect())
    assert all(e - s >= 500 for s, e in out)
    assert all(b[0] >= a[1] for a, b in zip(out, out[1:]))


def test_srt_round_trip(spark, tmp_path):
    rows = [("m", i, i * 1000, i * 1000 + 900, f"line {i}") for i in range(7)]
    blocks = timing.srt_blocks(spark.createDataFrame(rows, CUE), ["media"], order="idx")
    timing.write_srt(blocks, ["media"], str(tmp_path / "o"))
    docs = timing.render_srt(blocks, ["media"], part_cues=3)
    assert docs.count() == 3
    whole = timing.render_srt(blocks, ["media"]).select(F.col("srt").alias("content"))
    got = srt.parse_srt(whole, "qc").orderBy("idx").collect()
    assert [(r["seq"], r["start_ms"], r["end_ms"], r["text"]) for r in got] == [(i + 1, i * 1000, i * 1000 + 900, f"line {i}") for i in range(7)]
    assert srt.read_srt(spark, str(tmp_path / "o")).count() == 7


def test_srt_dialects(spark):
    doc = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nA\r\nB\r\n\r\nx\r\n0:00:03.000 --> 0:00:04.000\r\nC\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\nD"
    f = spark.createDataFrame([("p", doc)], "path string, content string")
    texts = lambda d: [r["text"] for r in srt.parse_srt(f, d).orderBy("idx").collect()]
    assert texts("tolerant") == ["A B", "D"]
    assert texts("writer") == ["A\nB", "D"]
    assert texts("qc")[-1] == "D"
    assert srt.parse_srt(spark.createDataFrame([("p", "")], "path string, content string"), "qc").count() == 0


def test_qc_rules(spark):
    rows = [("m", 0, 1, 0, 2000, "ok"), ("m", 1, 2, 1500, 1700, "{\\an8}x"), ("m", 2, 3, 1000, 9500, "a\nb\nc"), ("m", 3, 4, 9500, 10500, "y" * 50)]
    c = spark.createDataFrame(rows, "media string, idx bigint, seq bigint, start_ms bigint, end_ms bigint, text string")
    tracks = spark.createDataFrame([("m",), ("empty",)], "media string")
    v = qc.subtitle_qc(tracks, c, ["media"])
    got = sorted((r["cue_index"], r["type"]) for r in v.collect())
    assert got == sorted([(-1, "parse_failed"), (2, "overlap"), (2, "duration_too_short"), (2, "formatting_artifact"), (3, "out_of_order"),
                          (3, "overlap"), (3, "duration_too_long"), (3, "too_many_lines"), (4, "high_cps"), (4, "line_too_long")])
    s = {r["media"]: r for r in qc.qc_summary(tracks, c, v, ["media"]).collect()}
    assert not s["empty"]["parsed_ok"] and s["m"]["error_count"] == 6 and s["m"]["warning_count"] == 3
    assert qc.qc_sidecar(qc.qc_summary(tracks, c, v, ["media"]), v, ["media"], part_cues=2).count() == 3


def test_memory_lookup_equals_scan(spark):
    rnd = random.Random(5)
    text = lambda: "".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 9))).strip() or "a"
    mem = [(i, text(), "ja", "en") for i in range(60)]
    qs = [(i, text(), "ja", "en") for i in range(30)] + [(99, "a", "ja", "xx")]
    m = spark.createDataFrame(mem, "ord bigint, source_text string, source_lang string, target_lang string")
    q = spark.createDataFrame(qs, "qid bigint, query_text string, source_lang string, target_lang string")
    got = {}
    for r in memory.memory_lookup(q, m, k=4, block=17, slices=3).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["ord"]))

    def sim(a, b):
        if a == b:
            return 1.0
        if a in b or b in a:
            return min(len(a), len(b)) / max(len(a), len(b))
        g = lambda t: {t} if len(t) <= 2 else {t[i:i + 2] for i in range(len(t) - 1)}
        return len(g(a) & g(b)) / len(g(a) | g(b))
    for qid, t, _, tl in qs:
        best = sorted(((-sim(t, s), s != t, o) for o, s, _, _ in mem if sim(t, s) > 0)) if tl == "en" else []
        assert [o for _, o in sorted(got.get(qid, []))] == [o for _, _, o in best[:4]]


def test_glossary_match(spark):
    g = spark.createDataFrame([("term", "language", "an", "AN", True), ("name", "domain", "Bo", "BO", True), ("term", "language", "zzz", "Z", False)],
                              "kind string, scope string, source string, target string, required boolean")
    c = spark.createDataFrame([("m", 0, "Anna and Bo"), ("m", 1, "z"), ("m", 2, "zzzz")], "media string, idx bigint, text string")
    got = sorted((r.idx, r.source, r["rank"]) for r in terms.glossary_match(c, g, ["media"]).collect())
    assert got == [(0, "Bo", 1), (0, "an", 2), (2, "zzz", 1)]


def test_lineage_chain_and_cycle(spark):
    n = spark.createDataFrame([(i, i - 1 if i else None) for i in range(11)] + [(20, 21), (21, 20), (22, 21), (30, 99)], "id bigint, parent_id bigint")
    rows = lineage.candidate_chain(n).collect()
    chain = {}
    for r in rows:
        chain.setdefault(r["id"], {})[r["pos"]] = r["ancestor"]
    assert chain[10] == {i: i for i in range(11)}
    assert chain[30] == {0: 30}
    assert not {20, 21, 22} & set(chain)
    assert sorted(r["id"] for r in lineage.ancestors(n)[1].collect()) == [20, 21, 22]


def test_unique_append_and_status(spark):
    old = spark.createDataFrame([("r1",)], "run_id string")
    new = spark.createDataFrame([("r1", 1), ("r2", 2), ("r2", 3)], "run_id string, ord int")
    ok, bad = lifecycle.unique_append(old, new, "run_id", "ord")
    assert [(r["run_id"], r["ord"]) for r in ok.collect()] == [("r2", 2)]
    assert bad.count() == 2


def test_corrections_jsonl(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"source_text": " a ", "approved_translation": "b", "tags": ["y", " x"]}\n{oops\n\n[1]\n')
    r = corrections.read_corrections(spark, str(tmp_path / "c.jsonl")).filter("source_text <> ''").collect()
    assert len(r) == 1 and r[0]["source_lang"] == "ja" and r[0]["tags"] == ["x", "y"]


def test_export_all(spark, tmp_path):
    raw = spark.createDataFrame([(1, "ja", "en", "anime", "s", "bad", "good", "", "", ["t"], "", "p"), (2, "ja", "en", "", "s", "", "good", "", "", [], "", "p"),
                                 (3, "ja", "en", "", "", "x", "", "", "", [], "", "p")],
                                "ord int, source_lang string, target_lang string, domain string, source_text string, bad_translation string, "
                                "approved_translation string, previous_context string, next_context string, tags array<string>, notes string, language_pack string")
    got = {r["dataset"]: (r["written"], r["skipped"]) for r in corrections.export_all(raw, str(tmp_path)).collect()}
    assert got["sft"] == (2, 1) and got["preference_pairs"] == (1, 2)
    assert got["approved_corrections"] == got["benchmark"] == (2, 1)
    of = lambda name: spark.read.json(str(tmp_path / f"dataset={name}"))
    assert of("skipped_records").count() == 2 and of("sft").count() == 2 and of("preference_pairs").count() == 1
    # The lines are those of the single projections.
    valid, _ = corrections.split_valid(corrections.normalize(raw))
    for name, df in (("benchmark", corrections.reference_rows(valid)), ("sft", corrections.sft_messages(valid)), ("approved_corrections", valid)):
        assert sorted(r.value for r in spark.read.text(str(tmp_path / f"dataset={name}")).collect()) == sorted(df.drop("ord").toJSON().collect())


def test_source_ladder(spark):
    js = '{"streams":[{"index":0,"codec_type":"audio","codec_name":"aac","channels":2,"tags":{"language":"eng"}},' \
         '{"index":1,"codec_type":"subtitle","codec_name":"ass","tags":{"language":"jpn"}}],"format":{"duration":"x"}}'
    m = catalog.parse_catalog(spark.createDataFrame([(1, js), (2, '{"streams":[]}')], "media bigint, value string"))
    s = {r["media"]: r for r in selection.select_strategy(selection.detect_sources(m)).collect()}
    assert s[1]["strategy"] == "embedded_jp_mt" and s[1]["duration"] is None
    assert s[2]["error"] is not None


def test_texts_of_a_reference_without_the_candidates_key_are_those_of_its_copies(spark):
    rows = [(m, c, i, i * 1000, i * 1000 + 900, f" {c}{m}{i} ") for m in (1, 2) for c in ("a", "b") for i in range(3)]
    cand = spark.createDataFrame(rows, "media int, cand string, idx int, start_ms long, end_ms long, text string")
    ref = cand.filter("cand = 'a'").drop("cand")
    copies = ref.join(cand.select("media", "cand").distinct(), "media")
    pairs = cand.select("media", "cand", "idx", F.col("idx").alias("right_idx")).union(cand.select("media", "cand", "idx", F.lit(None)))
    keys = ["media", "cand"]
    got, want = (sorted(align.with_texts(pairs, r, cand, keys).select(
        *keys, "idx", "right_idx", "ref_start", "ref_text", "cand_start", "cand_text").collect(), key=repr) for r in (ref, copies))
    assert got == want and len(got) == 24
