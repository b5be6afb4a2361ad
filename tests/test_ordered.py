import random

from pyspark.sql import functions as F

from cuelake.ordered import carry_before, dense_index, neighbours, top_k


def rows(n=57, seed=1):
    rnd = random.Random(seed)
    return [(k, i, rnd.choice([None, i * 3])) for k in ("a", "b") for i in range(n if k == "a" else 5)]


def test_neighbours_across_chunks(spark):
    df = spark.createDataFrame(rows(), "k string, idx bigint, v bigint")
    out = neighbours(df, ["k"], "idx", {"p": lambda w: F.lag("idx", 2).over(w), "n": lambda w: F.lead("idx").over(w)},
                     before=2, after=1, chunk=4).collect()
    assert len(out) == 62
    for r in out:
        last = 56 if r["k"] == "a" else 4
        assert r["p"] == (r["idx"] - 2 if r["idx"] >= 2 else None)
        assert r["n"] == (r["idx"] + 1 if r["idx"] < last else None)


def test_dense_index(spark):
    data = [("a", (i * 7919) % 101, i) for i in range(50)] + [("b", 5, i) for i in range(9)]
    df = spark.createDataFrame(data, "k string, o bigint, t bigint")
    got = {(r["k"], r["o"], r["t"]): r["idx"] for r in dense_index(df, ["k"], "o", ["t"], width=10).collect()}
    for k in "ab":
        for i, (_, o, t) in enumerate(sorted((x for x in data if x[0] == k), key=lambda x: (x[1], x[2]))):
            assert got[(k, o, t)] == i


def test_carry_before(spark):
    data = rows(40, 4)
    df = spark.createDataFrame(data, "k string, idx bigint, v bigint")
    last = {(r["k"], r["idx"]): r["x"] for r in carry_before(df, ["k"], "idx", F.col("v"), "x", "last", chunk=6).collect()}
    most = {(r["k"], r["idx"]): r["x"] for r in carry_before(df, ["k"], "idx", -F.col("v"), "x", "max", chunk=6).collect()}
    for k, i, _ in data:
        seen = [v for kk, j, v in data if kk == k and j < i and v is not None]
        assert last[(k, i)] == (seen[-1] if seen else None)
        assert most[(k, i)] == (max(-v for v in seen) if seen else None)


def test_top_k(spark):
    df = spark.createDataFrame([("a", i) for i in range(20)], "k string, v bigint")
    assert [r["v"] for r in top_k(df, ["k"], [F.desc("v")], 3).orderBy("rank").collect()] == [19, 18, 17]
