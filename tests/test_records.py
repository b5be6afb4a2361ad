"""Quality floors, benchmark documents, registry reads, packs and metadata on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from cuelake.functions import meta
from cuelake.functions import text as tx
from cuelake.operators import benchmarks, packs, qc, registry_table, terms
from cuelake.operators import lifecycle as lc
from cuelake.sources import catalog, listed, srt
from cuelake.sources import corrections as co


def test_floors_are_read_and_missing_metrics_fail(spark, tmp_path):
    doc = {"fixture": "f", "engines": {"a": {"wer_max": 0.5, "bleu_min": 10.0, "chrf_min": 20.0}}, "notes": "x"}
    (tmp_path / "expected.json").write_text(json.dumps(doc, indent=2))
    floors = benchmarks.read_expected(spark, str(tmp_path / "expected.json"))
    runs = spark.createDataFrame([(1, "f", "a", 0.5, 10.0, 20.0), (2, "f", "a", None, 9.9, 21.0), (3, "f", "b", 0.1, 90.0, 90.0)],
                                 "id int, fixture string, engine string, wer double, bleu double, chrf double")
    got = {r.id: (r.gate, r.failed) for r in benchmarks.quality_gate(runs, floors).collect()}
    assert got == {1: ("pass", []), 2: ("fail", ["wer", "bleu"]), 3: ("no_floor", [])}


def test_progress_needs_all_three_conditions(spark):
    rows = [("k", 1, 0.4, 30.0, 50.0), ("k", 2, 0.4, 31.0, 52.0), ("k", 3, 0.41, 40.0, 60.0), ("k", 4, 0.3, 40.5, 70.0)]
    runs = spark.createDataFrame(rows, "k string, n long, wer double, bleu double, chrf double")
    got = benchmarks.run_progress(runs, ["k"], "n").orderBy("n").collect()
    assert [r.improved for r in got] == [False, True, False, False]
    assert got[1].chrf_delta == 2.0 and got[0].bleu_delta is None


def test_large_titles_come_in_parts(spark):
    c = spark.range(10).select(F.lit(1).alias("media"), F.col("id").alias("ord"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("candidate_id"),
                               F.lit("asr").alias("source"))
    refs = spark.createDataFrame([(1, "c0")], "media int, reference_id string")
    comp = c.filter("ord > 0").select("media", F.lit("c0").alias("ref_id"), F.col("candidate_id").alias("cand_id"), F.lit(0.1).alias("wer"),
                                      F.lit(1.0).alias("bleu"), F.lit(2.0).alias("chrf"))
    cards = c.select("media", "candidate_id", (F.col("ord") == 0).alias("is_reference"), F.lit(0.1).alias("wer"), F.lit(1.0).alias("bleu"),
                     F.lit(2.0).alias("chrf"), F.lit(0.5).alias("composite_score"), F.col("ord").alias("rank"))
    routes = spark.createDataFrame([(1, "ok", ["x"])], "media int, status string, reason_codes array<string>")
    docs = benchmarks.benchmark_documents(c, comp, cards, refs, routes, part_rows=4).orderBy("part").collect()
    parts = [json.loads(r.doc) for r in docs]
    assert [len(p["candidates"]) for p in parts] == [4, 4, 2] and [len(p["comparisons"]) for p in parts] == [3, 4, 2]
    assert [x["candidate_id"] for p in parts for x in p["scorecards"]] == [f"c{i}" for i in range(10)]
    assert all(p["review_task_routing"] == {"status": "ok", "reason_codes": ["x"]} and p["reference_id"] == "c0" for p in parts)


def test_registry_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, "m" + str(i % 2), "done" if i % 3 else "new") for i in range(9)], "id long, media string, status string").write.parquet(path)
    t = lc.read_registry(spark, path, order=[F.desc("id")], status="done", media=None, limit=2)
    assert [r.id for r in t.collect()] == [8, 7]
    plan = lc.read_registry(spark, path, media="m1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(media,m1)" in plan


def test_run_records_take_metrics_from_the_document(spark):
    inc = spark.createDataFrame([(1, "a", 0.5, '{"wer": 0.9, "bleu": 3}'), (2, "b", None, '{"wer": 0.25}'), (3, "b", None, "{}"), (4, "old", None, None)],
                                "ord long, run_id string, wer double, metrics string").withColumns({"bleu": F.lit(None).cast("double"), "chrf": F.lit(None).cast("double")})
    new, bad = lc.record_runs(spark.createDataFrame([("old",)], "run_id string"), inc)
    assert sorted((r.run_id, r.wer, r.bleu) for r in new.collect()) == [("a", 0.5, 3.0), ("b", 0.25, None)]
    assert sorted((r.ord, r.reason) for r in bad.collect()) == [(3, "run exists: b"), (4, "run exists: old")]


def test_corrections_are_appended(spark, tmp_path):
    cols = "ord long, source_lang string, target_lang string, domain string, source_text string, approved_translation string, tags array<string>"
    store = str(tmp_path / "store")
    one = spark.createDataFrame([(1, " JA ", None, "d", " x ", "y", ["b", "a", "b"]), (2, "ja", "en", "d", " ", "y", None)], cols)
    assert [r.reason for r in co.add_corrections(one, store).collect()] == ["missing_required_fields:source_text"]
    co.add_corrections(spark.createDataFrame([(3, "ko", "en", "d", "z", "w", None)], cols), store)
    got = sorted((r.source_lang, r.target_lang, r.source_text, tuple(r.tags)) for r in co.read_corrections(spark, store).collect())
    assert got == [("ja", "en", "x", ("a", "b")), ("ko", "en", "z", ())]


def test_media_files_are_listed_by_ending(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.mkv", "b.srt", "c.mp4", "sub/d.webm"):
        (tmp_path / n).write_bytes(b"xyz")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    flat = catalog.list_media(spark, str(tmp_path))
    assert names(flat) == ["a.mkv", "c.mp4"] and {r.length for r in flat.collect()} == {3}
    assert names(catalog.list_media(spark, str(tmp_path), recursive=True)) == ["a.mkv", "c.mp4", "d.webm"]


def test_listing_keeps_empty_and_unreadable_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    cue = "1\n00:00:01,000 --> 00:00:03,000\nHi\n"
    for n, b in (("a.srt", cue.encode()), ("b.SRT", b""), ("c.srt", b"\xff\xfe\x00"), ("sub/d.srt", b"no cue"), ("e.txt", b"x"), ("_f.srt", b"x")):
        (tmp_path / n).write_bytes(b)
    (tmp_path / "g.srt").symlink_to(tmp_path / "a.srt")
    files = listed.listed_files(spark, str(tmp_path), ["srt"])
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    got = {r.n: r for r in files.withColumn("n", name).collect()}
    assert set(got) == {"a.srt", "b.SRT", "c.srt", "d.srt", "g.srt"}
    assert got["a.srt"].content == got["g.srt"].content == cue and got["b.SRT"].content == "" and got["b.SRT"].length == 0
    assert got["c.srt"].content is None and got["c.srt"].error.startswith("UnicodeDecodeError")
    assert got["a.srt"].path == f"file://{tmp_path}/a.srt" and got["a.srt"].modified.year >= 2024
    found = qc.subtitle_qc(files, srt.parse_srt(files.select("path", "content"), "qc"), ["path"]).filter("type = 'parse_failed'")
    told = {r.n: r.detail for r in found.withColumn("n", name).collect()}
    assert set(told) == {"b.SRT", "c.srt", "d.srt"} and told["c.srt"].startswith("Cannot read") and told["b.SRT"].startswith("SRT file contains")
    assert {r.path.rsplit("/", 1)[1] for r in listed.listed_media(spark, str(tmp_path), endings=["srt"]).collect()} == {"a.srt", "b.SRT", "c.srt", "g.srt"}
    assert listed.listed_files(spark, str(tmp_path), ["none"]).count() == 0


def test_splits_of_a_listing():
    files = [(str(i), size, 0) for i, size in enumerate([5, 5, 30, 1, 0, 0])]
    assert [[f[1] for f in s.files] for s in listed.splits(files, 10, 2)] == [[5, 5], [30], [1, 0], [0]]
    assert [s.files for s in listed.splits([], 10, 2)] == [[]]


def test_packs_take_tags_and_untagged_audio(spark):
    t = spark.createDataFrame([(1, "JPN"), (2, "ko-XX"), (3, None), (4, "fr"), (5, " en-gb ")], "id int, language string")
    p, a = packs.pack_table(spark), packs.alias_table(spark)
    got = {r.id: (r.pack_id, r.workflow) for r in packs.pack_of_track(t, "en", p, a, untagged="ja").collect()}
    assert got == {1: ("ja_en", "translate"), 2: ("ko_en", "translate"), 3: ("ja_en", "translate"), 4: (None, None), 5: ("en_en", "transcription_only")}
    assert {r.id: r.pack_id for r in packs.pack_of_track(t, "en", p, a).collect()}[3] is None


def test_metadata_falls_back(spark):
    rows = [(1, '{"source_text_ja": "", "source_text": " b "}'), (2, '{"source_text_ja": "a", "ocr_confidence": "x"}'), (3, "no json"), (4, None),
            (5, '{"ocr_confidence": 0.5, "asr": {"warnings": [{"type": "t"}]}}')]
    has, conf = meta.ocr_confidence(F.col("m"))
    got = spark.createDataFrame(rows, "i int, m string").select("i", meta.source_text(F.col("m")), has, conf, F.size(meta.asr_warnings(F.col("m")))).collect()
    assert [tuple(r) for r in got] == [(1, "b", False, 0.0, 0), (2, "a", True, 0.0, 0), (3, "", False, 0.0, 0), (4, "", False, 0.0, 0), (5, "", True, 0.5, 1)]


def test_cjk_of_arrays(spark):
    df = spark.createDataFrame([(["先輩", "学園 hi", " as it is "],)], "t array<string>")
    assert df.select(tx.strip_cjk_all(F.col("t")).alias("t")).first().t == ["先輩", "hi", " as it is "]


def test_registry_reads_the_same_before_and_after_compaction(spark, tmp_path):
    """Three schema versions: defaults for older rows only, nulls of newer rows stay; fewer folders are read after compaction."""
    root, columns = str(tmp_path), ["name", "length", "lang"]
    added = [registry_table.Added(2, "length", "long", 0), registry_table.Added(3, "lang", "string", "und")]
    with pytest.raises(ValueError):
        registry_table.current(spark, root, columns, added=added)
    writes = [([("a", 1, 1, "x"), ("b", 1, 2, "y"), ("c", 2, 1, None)], "media_hash string, ts int, ord int, name string", 1),
              ([("a", 3, 1, "x2", None), ("d", 3, 2, "w", 7)], "media_hash string, ts int, ord int, name string, length long", 2),
              ([("b", 5, 1, "y3", 9, None), ("a", 2, 9, "late", 8, "en")], "media_hash string, ts int, ord int, name string, length long, lang string", 3)]
    want = [{"a": ("x", 0, "und", 1, 1), "b": ("y", 0, "und", 1, 1), "c": (None, 0, "und", 2, 2)},
            {"a": ("x2", None, "und", 1, 3), "b": ("y", 0, "und", 1, 1), "c": (None, 0, "und", 2, 2), "d": ("w", 7, "und", 3, 3)},
            {"a": ("x2", None, "und", 1, 3), "b": ("y3", 9, None, 1, 5), "c": (None, 0, "und", 2, 2), "d": ("w", 7, "und", 3, 3)}]

    def read():
        df = registry_table.current(spark, root, columns, added=added)
        return {r.media_hash: tuple(r)[1:] for r in df.collect()}, {f.split("/part-")[0].rsplit("/", 2)[-2] + "/" + f.split("/part-")[0].rsplit("/", 1)[-1] for f in df.inputFiles()}

    for n, ((rows, schema, version), state) in enumerate(zip(writes, want), 1):
        assert registry_table.append(spark.createDataFrame(rows, schema), root, version) == n
        got, folders = read()
        assert got == state
        assert registry_table.compact(spark, root, columns, version, added=added) == n
        after, fewer = read()
        assert after == state and fewer == {f"snapshot/upto={n}"} and len(fewer) <= len(folders)
        # Nothing new: no other snapshot.
        assert registry_table.compact(spark, root, columns, version, added=added) == n
    assert sorted(x.split(root)[1] for x in registry_table.stale(spark, root)) == ["/log/batch=1", "/log/batch=2", "/log/batch=3", "/snapshot/upto=1", "/snapshot/upto=2"]


def test_pack_files(spark, tmp_path):
    files = {"ja.json": {"pack_id": "ja_en", "kind": "language", "source_language": "ja", "target_language": "en", "aliases": {"ja": ["jpn"]},
                         "glossary": [{"kind": "term", "source": "a", "target": "A"}, {"kind": "term", "source": "A", "target": "A2"}]},
             "en.json": {"pack_id": "en_en", "kind": "language", "source_language": "en", "target_language": "en"},
             "dom.json": {"pack_id": "dom", "kind": "domain", "glossary": [{"kind": "term", "source": "a", "target": "D", "required": "yes"}]},
             "bad.json": [1, 2], "other.json": {"pack_id": "other", "kind": "domain", "layer": 9, "glossary": [{"kind": "term", "source": "a", "target": "Z"}]}}
    for name, x in files.items():
        (tmp_path / name).write_text(json.dumps(x, indent=1) if name != "bad.json" else "not json")
    p = packs.read_packs(spark, str(tmp_path))
    assert p.count() == 5 and p.filter("pack_id IS NULL").count() == 1
    rows = {r.pack_id: (r.untagged_language, r.workflow) for r in packs.pack_rows(p).collect()}
    assert rows == {"ja_en": ("ja", "translate"), "en_en": ("en", "transcription_only")}
    assert {(r.language, r.alias) for r in packs.alias_rows(p).filter("pack_id = 'ja_en'").collect()} == {("ja", "jpn"), ("ja", "ja"), ("en", "en")}
    assert [(r.target, r.required) for r in terms.glossary_entries(packs.glossary_rows(p, ["ja_en"])).collect()] == [("A2", False)]
    assert [(r.target, r.required) for r in terms.glossary_entries(packs.glossary_rows(p, ["ja_en", "dom"])).collect()] == [("D", True)]
