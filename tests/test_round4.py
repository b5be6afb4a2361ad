"""What the findings of round 4 asked for: the inbox in few tasks, merged titles written once."""

from collections import Counter
from pathlib import Path

from cuelake.session import tune
from cuelake.sources import srt
from cuelake.streaming import flows

CUES = "1\n00:00:01,000 --> 00:00:01,100\nHi\n\n2\n00:00:01,050 --> 00:00:03,000\nYou\n"


def _inbox(path, n):
    path.mkdir()
    for i in range(n):
        (path / f"f{i}.srt").write_text("\n" if i % 50 == 7 else CUES)
    return str(path)


def test_listing_of_an_inbox_takes_few_tasks(spark, tmp_path):
    tune(spark)
    q = flows.stream_qc(flows.watch_inbox(spark, _inbox(tmp_path / "in", 150)), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    seen = spark.sparkContext.statusTracker()
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup(str(q.runId)) for s in seen.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 64
    summary = spark.read.parquet(str(tmp_path / "out" / "summary"))
    assert sorted(r.cue_count for r in summary.collect()) == [0] * 3 + [2] * 147
    found = spark.read.parquet(str(tmp_path / "out" / "violations"))
    assert {r.type: r["count"] for r in found.groupBy("type").count().collect()} == {"overlap": 147, "duration_too_short": 147, "parse_failed": 3}
    # A batch's cues are gone when it is done.
    assert not list((tmp_path / "out" / "cues").glob("batch=*"))


def test_files_are_read_in_few_tasks_and_found_things_written_once(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i}", "" if i % 50 == 7 else CUES) for i in range(150)], "path string, content string").repartition(150)
    cues, found = tmp_path / "cues", tmp_path / "found"
    summary, rows = flows.qc_batch(files, cues_at=str(cues), found_at=str(found))
    assert 0 < len(list(cues.glob("part-*"))) <= 8 * spark.sparkContext.defaultParallelism
    assert sorted(rows.collect()) == sorted(spark.read.parquet(str(found)).collect()) and rows.count() == 297
    assert sorted((r.cue_count, r.error_count, r.parsed_ok) for r in summary.collect()) == [(0, 1, False)] * 3 + [(2, 2, True)] * 147


def test_files_without_cues_stay_with_outer(spark):
    f = spark.createDataFrame([("a", CUES), ("b", ""), ("c", None)], "path string, content string")
    got = sorted((r.path, r.idx if r.idx is not None else -1, r.text) for r in srt.parse_srt(f, outer=True).collect())
    assert got == [("a", 0, "Hi"), ("a", 1, "You"), ("b", -1, None), ("c", -1, None)]
    assert srt.parse_srt(f).count() == 2


def test_merged_titles_are_written_once_and_compressed(spark, tmp_path):
    """A title without documents is empty; documents without a number are in none."""
    from cuelake.plans import registry
    from cuelake.session import checkpoint_root

    docs = [(1, "One line.\n\nTwo lines"), (5, "Five\n \nmore"), (6, ""), (11, None), (10, "ten"), (None, "lost"), (-1, "less"), (1, "One again")]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    root = Path(checkpoint_root(spark).removeprefix("file:"))
    before = set(root.glob("titles-*"))
    got = registry.queries()["merge_datasets"](spark, str(tmp_path))
    rows = Counter((r.media, r["index"], r.similarity, r.source_video) for r in got.collect())
    want = [(1, 1), (1, 2), (5, 1), (5, 2), (10, 1), (1, 1)]
    assert rows == Counter((m, i, (m * 7 + (i - 1) * 13) % 100 / 100, f"t{m % 5}") for m, i in want)
    (out,) = set(root.glob("titles-*")) - before
    assert sorted(p.name for p in out.iterdir()) == ["t0", "t1", "t2", "t3", "t4"]
    files = list(out.glob("t*/pairs/part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)


def test_driver_keeps_no_copy_of_listings(spark):
    """Each batch of a stream lists its paths; a cache of listings would hold them all."""
    tune(spark)
    cache = spark._jvm.org.apache.spark.sql.execution.datasources.FileStatusCache.getOrCreate(spark._jsparkSession)
    assert cache.getClass().getSimpleName().startswith("NoopCache")


def test_inbox_is_listed_without_the_places_of_blocks(spark, tmp_path):
    tune(spark)
    files = flows.watch_inbox(spark, _inbox(tmp_path / "in", 3))
    assert files.isStreaming and spark.conf.get("spark.sql.sources.ignoreDataLocality") == "true"
    assert tune(spark).conf.get("spark.sql.sources.ignoreDataLocality") == "false"
