"""License scan, whitening and prefix trie against brute force and SQL on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import licenses, queries, trie, whitening
from tests.llm.conftest import HARD, LONG

# --- 11 ---------------------------------------------------------------------------------

MIT = next(t.markup for t in licenses.TEMPLATES if t.label == "mit-text")
SOME = [
    "released under the MIT license", "x Released under the\n\nMIT-License.", "mit license mit license", "CC BY-NC-SA 4.0", "cc by", "cc xby", "ccby",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "licensed under the apache license", "the GNU general public license, version 3", re.sub(r"[\[\]]", "", MIT), MIT.replace("[(including the next paragraph)]", "twice"),
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the"
    " Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "To the extent possible under law, A B C has waived all copyright and related or neighboring rights to D.",
    "To the extent possible under law, has waived all copyright and related or neighboring rights to D.",
    "gnu général public license", "apache license", "MİT LICENSE", LONG + " apache license " + LONG + " gnu general public license",
]


def test_license_scan_equals_regular_expressions(spark, docs_of):
    rnd = random.Random(3)
    vocabulary = sorted({w.decode() for t in licenses.TEMPLATES for w in licenses.words_of(re.sub(r"\{[^}]*\}", "", t.markup).encode())})[:60]
    rows = list(enumerate(SOME)) + [(100 + i, " ".join(rnd.choice(["cc", "by", "nc", "sa", "mit", "license", "apache", rnd.choice(vocabulary)]) for _ in range(40)))
                                    for i in range(60)] + [(1000 + i, t) for i, (_, t) in enumerate(HARD)]
    got = {r.doc_id: r for r in licenses.scan(docs_of(rows)).collect()}
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        assert got[i].n_words == len(words)
        spaced = [f" {w} " for w in words]
        starts = {t: [k for k in range(len(words)) if spaced[k].encode().strip() == licenses.parse(t.markup)[0]] for t in licenses.TEMPLATES}
        want = {(t.label, licenses.mandatory(licenses.parse(t.markup)), k) for t in licenses.TEMPLATES for k in starts[t]
                if re.match(licenses.as_regex(t.markup), "".join(spaced[k:k + 200]))}
        assert {(m.label, m.weight, m.start) for m in got[i].matches} == want, text


def test_license_markup():
    assert licenses.parse("a [b [c]] {d:0-2} e") == [b"a", ("opt", [b"b", ("opt", [b"c"])]), ("any", 0, 2), b"e"]
    for wrong in ("a ]", "a [b", "[a] b", "{a:1-2} b", "a {b}", "a {b:3-2}", "", "a }"):
        with pytest.raises(ValueError):
            licenses.parse(wrong)
    machine = licenses.Automaton((licenses.Template("t", "a [b [c]] {d:0-2} e"),))
    text = [b"a", b"b", b"c", b"x", b"y", b"e", b"a", b"e", b"a", b"x", b"y", b"z", b"w", b"e", b"a", b"c", b"e"]
    assert machine.run(text) == [(0, 0, 6), (6, 0, 8), (14, 0, 17)]


def test_license_hard_rows(docs, none):
    s = licenses.summary(licenses.scan(docs))
    assert s.count() == len(HARD) and {(r.n_base, r.first_word, r.labels, r.score) for r in s.collect()} == {(0, None, "", 0.0)}
    assert licenses.summary(licenses.scan(none)).count() == 0


@pytest.fixture(params=["plain", "clashing"])
def docs(request, hard, clashing):
    return hard if request.param == "plain" else clashing


@pytest.fixture
def none(docs_of):
    return docs_of([(1, "x")]).filter("doc_id < 0")


# --- 12 ---------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int"


def brute_whitening(rows, k=16):
    kept = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * 64).astype(np.int64) + 1_000_000) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.stack([x for _, x in kept]), axis=0)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    values, units = np.linalg.eigh(y.T @ y / n)
    values, units = values[::-1], units[:, ::-1]
    real = values > 1e-9 * max(values[0], 1e-300)
    values, units = values[real][:k], units[:, real][:, :k]
    return kept, n, s, values, units, (y * y).sum() / n


def test_whitening_equals_eigenvectors(spark):
    rnd = np.random.default_rng(7)
    base = rnd.normal(size=(300, 20)) * np.linspace(0.2, 3, 20)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, rows[1][1])] + [(600 + i, rows[5][1]) for i in range(200)]
    bad = [(700, None), (701, [None] + [0.0] * 19), (702, [float("nan")] * 20), (703, [float("inf")] + [1.0] * 19), (704, []), (705, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], VEC).repartition(5)
    x = whitening.same_length(whitening.vectors(table.withColumn("x", F.lit(3)).withColumn("n", F.lit("clash"))))
    got = whitening.whiten(x, whitening.fit_whitener(x)).collect()
    kept, n, s, values, units, trace = brute_whitening(rows)
    assert len(got) == len(kept) * 16 and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 17))
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-9 and 0 <= r.identity_error < 1e-9
    want = {i: (x - s / n) @ units / np.sqrt(values) for i, x in kept}
    mine = {i: np.array([by[i][k].whitened for k in range(1, 17)]) for i in want}
    sign = np.sign(sum(want[i] * mine[i] for i in want))
    assert all(np.allclose(want[i] * sign, mine[i], atol=1e-8) for i in want)
    assert all(by[i][1].deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)) for i, x in kept)


def test_whitening_of_low_rank_and_nothing(spark):
    def run(rows):
        x = whitening.same_length(whitening.vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], VEC)))
        return whitening.whiten(x, whitening.fit_whitener(x)).collect()

    assert run([]) == [] and run([(1, [1.0, 2.0])]) == [] and run([(1, [1.0]), (2, [1.0])]) == []
    # Two equal columns and a constant one: one component.
    got = run([(i, [float(i), float(i), 5.0]) for i in range(10)])
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)
    # Entries far apart: exact deviations beyond a long are null.
    far = run([(1, [2.0 ** 44, 0.0]), (2, [-2.0 ** 44, 1.0]), (3, [0.0, 0.0])])
    assert {r.deviation for r in far if r.vec_id != 3} == {None} and len(far) in (3, 6)


def test_factor_and_rotations():
    rnd = np.random.default_rng(1)
    for d, r in ((1, 1), (2, 2), (5, 3), (33, 33), (40, 12)):
        a = rnd.normal(size=(d, r))
        v = a @ a.T
        f = whitening.pivoted_cholesky(v)
        assert np.allclose(f @ f.T, v, atol=1e-10)
        values, units = whitening.one_sided_jacobi(f)
        assert np.allclose(values[:r], np.linalg.eigvalsh(v)[::-1][:r]) and np.allclose(units.T @ units, np.eye(len(values)), atol=1e-7)
        assert np.allclose((units * values) @ units.T, v, atol=1e-9)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


# --- 13 ---------------------------------------------------------------------------------

TURN = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[:len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(z) == len(q) + 1 and z[:len(q)] == q for z in under)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(60), -7, -10, 100_000]:
        for t in range(r.choice([0, 1, 2, 3, 6, 12])):
            rows.append((c, r.choice([t, t, t, None, 3]), r.choice(["user", "assistant", None]), r.choice(["a", "b", "", None, "é", "long " * 50])))
    same = [(c, t, "user", "a") for c in range(200, 260) for t in range(10)]
    return rows + same + rows[:5] + [(None, 0, "user", "x"), (None, None, None, None), (300, 0, None, LONG)]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = conversations(seed)
    table = spark.createDataFrame(rows, TURN).repartition(4)
    if seed == 2:
        for name in ("pos", "digest", "h", "h1", "x1", "p1", "q", "depth", "weight", "known", "_c", "base", "k", "m", "n_bytes"):
            table = table.withColumn(name, F.lit("clash"))
    convs, turns = trie.rebuilt(trie.turns_of(table))
    # Chunks of three turns: running values cross their borders.
    got = sorted((tuple(r) for r in trie.prefix_trie(convs, turns, chunk=3 if seed == 1 else 65_536).collect()), key=str)
    assert got == brute_trie(rows)


def test_trie_without_rows(spark):
    empty = spark.createDataFrame([], TURN)
    assert trie.prefix_trie(*trie.rebuilt(trie.turns_of(empty))).collect() == []


# --- the registered queries, end to end -------------------------------------------------

@pytest.mark.parametrize("name", ["op11_license_scan", "op12_whitening", "op13_prefix_trie"])
def test_registered_queries(spark, tmp_path, name):
    d = str(tmp_path)
    spark.createDataFrame([(i, t, None, None, None) for i, t in [*enumerate(SOME[:-1]), (50, None), (50, None)]],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(conversations(3), TURN).write.parquet(f"{d}/conversations.parquet")
    rnd = np.random.default_rng(2)
    spark.createDataFrame([(i, rnd.normal(size=4).astype(np.float32).tolist(), 1) for i in range(50)] + [(77, None, 0)], VEC).write.parquet(f"{d}/embeddings.parquet")
    got = queries.QUERIES[name](spark, d)
    columns = {
        "op11_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint",
                              "base_labels": "string", "labels": "string", "score": "double"},
        "op12_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double",
                           "identity_error": "double"},
        "op13_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint",
                             "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"}}
    assert dict(got.dtypes) == columns[name]
    if name in queries.SQL:
        db = duckdb.connect()
        for t in ("documents", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    else:
        assert got.count() == 50 * 4
