"""Work that grew faster than its input: the same results on rows that took too long, and stages that were left out."""

import random
import time

from cuelake.llm import near, simhash
from cuelake.operators import memory, metrics
from cuelake.sources import listed
from pyspark.sql import functions as F

import corpus_pipeline


def test_long_texts_are_compared_in_step(spark):
    a, b = " ".join(f"w{i}" for i in range(8000)), " ".join(f"w{i}" for i in range(1, 8001)) + " x"
    df = spark.createDataFrame([(a, b), ("ab", " ab "), ("", "x"), ("abcd", "abce"), (None, "x"), ("a", "bc")], "a string, b string")
    t0 = time.time()
    got = [r[0] for r in df.select(memory.tm_similarity(F.col("a"), F.col("b"))).collect()]
    grams = [{t[i:i + 2] for i in range(len(t) - 1)} for t in (a, b)]
    assert got == [len(grams[0] & grams[1]) / len(grams[0] | grams[1]), 1.0, 0.0, 0.5, None, 0.0]
    assert time.time() - t0 < 60


def test_ter_of_long_texts():
    r = random.Random(3)
    ref = [f"w{r.randrange(400)}" for _ in range(4000)]
    t0 = time.time()
    assert metrics._ter_edits([w for i, w in enumerate(ref) if i % 5 != 4], ref) == 800
    assert metrics._ter_edits(ref[:100] + ref[103:110] + ref[100:103] + ref[110:], ref) == 1
    assert metrics._ter_edits([], ref) == 4000 and metrics._ter_edits(ref, []) == 4000 and metrics._ter_edits([], []) == 0
    assert time.time() - t0 < 5


def test_files_of_a_key_are_listed_by_tasks(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(300)] + [(7, "again"), (301, ""), (302, None)]
    df = spark.createDataFrame(rows, "doc_id long, value string")
    listed.FOLDER_FILES, keep = 2, listed.FOLDER_FILES
    try:
        listed.write_files(df, f"{tmp_path}/files", "doc_id", "value")
    finally:
        listed.FOLDER_FILES = keep
    # Many folders: the driver lists none of their files.
    assert all(not s.files for s in listed.ListedReader({"path": f"{tmp_path}/files", "endings": "txt"}).partitions() if s.folders)
    got = {r.path.rsplit("/", 1)[1]: r.content for r in listed.listed_files(spark, f"{tmp_path}/files", ["txt"]).collect()}
    want = {f"doc_id={i}.txt": f"text {i}\n" for i in range(300)} | {"doc_id=301.txt": "\n", "doc_id=302.txt": "\n"}
    assert got == want | {"doc_id=7.txt": "again\ntext 7\n"}


def test_near_stage_links_fingerprints_and_shingles(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**6)}"
    phrase = " ".join(word() for _ in range(7))
    tails = [" ".join(word() for _ in range(40)) for _ in range(2)]
    same = [f"{phrase} " * 200 + t for t in tails]
    base = [word() for _ in range(100)]
    docs = [(1, same[0]), (2, same[1]), (3, " ".join(base)), (4, " ".join(base[:-4])), (5, " ".join(word() for _ in range(50)))]
    sets = [set(near.shingles(t).tolist()) for t in same]
    assert (simhash.fingerprint(same[0]) ^ simhash.fingerprint(same[1])).bit_count() <= 4
    assert 10 * len(sets[0] & sets[1]) < 8 * len(sets[0] | sets[1])
    df = spark.createDataFrame([(*d, None, None, None) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in near.keep_one(df).collect()} == {1, 2, 3, 5}
    assert {x.doc_id for x in corpus_pipeline.without_near_copies(spark, df, "").collect()} == {1, 3, 5}
