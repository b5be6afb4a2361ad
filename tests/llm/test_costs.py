"""What operators cost besides their results: memory of the driver, steps of a worker."""

from __future__ import annotations

import random
import sys
import tracemalloc

import numpy as np
import xxhash

from cuelake.llm import language, passages


def _some_text(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) + rnd.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


def test_language_sample_is_sparse_on_the_driver(spark):
    rnd = random.Random(1)
    rows = [(i, _some_text(rnd, 60), f"l{i % 2}") for i in range(640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    try:
        model = language.train(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.languages == ["l0", "l1"]
    # As dense rows the sample alone is 2 * 300 * DIM * 8 bytes, 79 MB, and its sort keys as much again.
    assert peak < 70e6


def test_language_rows_sort_like_their_dense_bytes():
    rnd = random.Random(2)
    dense = [np.zeros(language.DIM, np.int64) for _ in range(200)]
    for c in dense:
        for _ in range(rnd.randint(0, 4)):
            c[rnd.choice([0, 1, 2, language.DIM - 1])] = rnd.choice([1, 2, 255, 256, 257, 1 << 16])

    def order(c):
        at = np.nonzero(c)[0]
        return language._order(at.astype(np.uint16), c[at].astype(np.uint32))

    assert [c.tobytes() for c in sorted(dense, key=order)] == sorted(c.tobytes() for c in dense)


def _plain_chunks(text):
    """The definition, step by step."""
    word = text.lower().split()
    n, reach = len(word) - passages.CONTEXT + 1, passages.REACH
    if n < reach:
        return []
    code = np.fromiter((xxhash.xxh64_intdigest(w) for w in word), np.uint64, len(word))
    h = np.zeros(n, np.uint64)
    for k in range(passages.CONTEXT):
        h = (h ^ code[k:k + n]) * passages.MULTIPLIER
        h ^= h >> np.uint64(29)
    least = h[:n - reach + 1].copy()
    for k in range(1, reach):
        np.minimum(least, h[k:n - reach + 1 + k], out=least)
    pad = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
    most = pad[:n].copy()
    for k in range(1, reach):
        np.maximum(most, pad[k:n + k], out=most)
    kept = []
    for c in np.nonzero(most == h)[0].tolist():
        if not kept or int(h[c]) != kept[-1][1] or c - kept[-1][0] >= reach:
            kept.append((c, int(h[c])))
    space = np.fromiter(map(str.isspace, text), bool, len(text))
    at = np.nonzero(~space & np.r_[True, space[:-1]])[0].tolist()
    kept = [c for c, _ in kept]
    return [(at[a], at[b], b - a, " ".join(word[a:b + passages.MORE])) for a, b in zip(kept, kept[1:]) if b + passages.MORE <= len(word)]


def test_chunks_are_the_same_for_less():
    rnd = random.Random(3)
    odd = ["x " * n + "a b c " * m + "x " * n for n in range(0, 60, 7) for m in range(0, 40, 5)]
    odd += ["".join(rnd.choice(["a ", "b", "İ ", "\n", ". ", " ", "\x1c", "ß", "aa bb ", "🙂 "]) for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    assert [passages.chunks(t) for t in odd] == [_plain_chunks(t) for t in odd]
    text, calls = _some_text(rnd, 4000), []

    passages.chunk_columns(text)
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        passages.chunk_columns(text)
    finally:
        sys.setprofile(None)
    # Python steps for each chunk, not for each word.
    assert len(calls) < 2000


def test_units_begin_where_the_last_one_ended():
    for t in ("", " \n ", "One two. Three four five six. \n\n A b\nc d e f g h", "?! a b c d e f.  ", " ... x"):
        start, end, words, normal = passages.unit_columns(t)
        assert list(zip(start, end, words, normal)) == passages.units(t)
        assert start == ([0] + end[:-1] if end else [])
        assert [" ".join(t[a:b].lower().split()) for a, b in zip(start, end)] == normal and words == [len(x.split()) for x in normal]
