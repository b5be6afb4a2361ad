"""Operators against brute force on small tables, and the hard cases of each."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cuelake.llm import chat, components, decontam, exact, language, near, passages, ring, sentencepiece_rounds, simhash, token_blocks, token_cache
from cuelake.llm.byte_bpe import WordEncoder
from cuelake.llm.common import scratch
from tests.llm.conftest import HARD

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(params=["plain", "clashing"])
def docs(request, hard, clashing):
    return hard if request.param == "plain" else clashing


@pytest.fixture
def none(docs_of):
    return docs_of([(1, "x")]).filter("doc_id < 0")


# --- 1 ----------------------------------------------------------------------------------

def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, msg long, kind string, role string, text string")


def test_events_fold(spark):
    e = log(spark, [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "delta", "assistant", "a"), (1, 3, 2, "delta", "assistant", "b"),
        (1, 4, 2, "regenerate", "assistant", ""), (1, 5, 2, "delta", "assistant", "c"), (1, 6, 3, "message", "user", "next"),
        (1, 7, 2, "regenerate", "assistant", "d"), (1, 8, 2, "delta", "assistant", "e"), (1, 9, 4, "message", "user", "last"),
        (1, 10, 4, "edit", "user", "LAST"), (None, 1, 1, None, None, None), (2, 1, 1, "message", "user", "x"), (2, 1, 1, "message", "user", "x")])
    got = sorted((r.conv_id or 0, r.first, r.role, r.text) for r in chat.fold_events(e).collect())
    assert got == [(0, 1, "", ""), (1, 1, "user", "hi"), (1, 2, "assistant", "de"), (1, 9, "user", "LAST"), (2, 1, "user", "x")]


ODD = ["\\", "\\\\", "###", "####", "</turn>", "\n", "\\h", "\\e", "\\c", "### Assistant: ", "a", ": ", "=", "é", "<", "</turn", "\U0001F600"]


def test_format_is_reversible(spark):
    r = random.Random(4)
    convs, rows = {}, []
    for c in range(60):
        turns = [(r.choice(["user", "assistant", "system", "tool", "", "User", "x: y", "\\c", "##"]),
                  "".join(r.choice(ODD) for _ in range(r.randint(0, 9)))) for _ in range(r.randint(1, 6))]
        convs[c] = turns
        rows += [(c, t, role, text) for t, (role, text) in enumerate(turns)]
    rows += [(99, 0, None, None), (99, 0, "assistant", "z"), (99, 0, "assistant", "z"), (100, 0, "assistant", "w " * 60_000)]
    convs[99], convs[100] = [("", ""), ("assistant", "z"), ("assistant", "z")], [("assistant", "w " * 60_000)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("msg", F.lit(2))
    got = chat.read_back(chat.format_messages(chat.fold_events(chat.table_log(t)))).collect()
    assert {x.conv_id: [tuple(y) for y in x.turns] for x in got} == convs
    assert {x.conv_id: x.learned for x in got} == {c: "".join(b for a, b in v if a == "assistant") for c, v in convs.items()}
    assert chat.read_back(chat.format_messages(chat.fold_events(chat.table_log(t.filter("conv_id < 0"))))).count() == 0


# --- 2 ----------------------------------------------------------------------------------

def test_token_files(spark, docs, none):
    path = scratch(spark, "test-blocks")
    token_blocks.write_tokens(docs, path, BPE, end_id=0, segment_tokens=1000)
    got = token_blocks.read_tokens(spark, path).orderBy("start").collect()
    enc = WordEncoder(BPE)
    want = Counter((d, enc.library(t or "") + bytes(4)) for d, t in HARD)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert token_blocks.token_files(none, BPE).count() == 0


# --- 3 ----------------------------------------------------------------------------------

def brute_components(fps: np.ndarray, limit: int) -> dict[int, int]:
    p = list(range(len(fps)))

    def root(i):
        while p[i] != i:
            i = p[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = root(i), root(j)
                p[max(a, b)] = min(a, b)
    return {int(fps[i]): root(i) for i in range(len(fps))}


@pytest.mark.parametrize("tile", [4096, 5])
def test_links_connect_like_all_pairs(spark, tile):
    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(60)}
    for b in list(fps)[:12]:
        x = b
        for _ in range(25):
            for k in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << k
            fps.add(x)
            x = r.choice([x, b])
    arr = np.array(sorted(fps), np.uint64)
    want = brute_components(arr, 4)
    df = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long")
    got = {r.node % 2**64: r.component % 2**64 for r in components.components(simhash.links(df, tile=tile), "a", "b").collect()}
    mine = {x: got.get(x, x) for x in want}
    assert len(set(mine.values())) == len(set(want.values()))
    assert len({(mine[x], want[x]) for x in want}) == len(set(want.values()))


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 101), (None, 5), (7, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(e, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(e.filter("a < 0"), "a", "b").count() == 0


def test_near_duplicates(docs, none):
    got = simhash.near_duplicates(docs)
    by = defaultdict(list)
    for r in got.collect():
        by[r.fp].append(r)
    fps = np.array([f % 2**64 for f in by], np.uint64)
    want = brute_components(fps, 4)
    ids = defaultdict(list)
    for f, rs in by.items():
        ids[want[f % 2**64]] += [r.doc_id for r in rs if r.doc_id is not None]
    for f, rs in by.items():
        assert {r.component_id for r in rs} == {min(ids[want[f % 2**64]], default=None)}
    assert sum(map(len, by.values())) == len(HARD)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3, 5, 8, 9]
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def jaccard(a, b):
    a, b = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_stage_finds_near_copies(spark, docs_of, docs, none):
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    rows = []
    for g in range(60):
        w = [word() for _ in range(r.choice([6, 30, 120, 400]))]
        rows.append((3 * g, " ".join(w)))
        for c in (1, 2):
            x = list(w)
            for p in r.sample(range(len(x)), max(1, round(len(x) * r.uniform(0.005, 0.06)))):
                x[p] = word()
            rows.append((3 * g + c, " ".join(x)))
    want = set(range(len(rows)))
    far = 0
    for g in range(60):
        a, b, c = (rows[3 * g + k][1] for k in range(3))
        ab, ac, bc = jaccard(a, b) >= 0.8, jaccard(a, c) >= 0.8, jaccard(b, c) >= 0.8
        want -= {3 * g + 1} if ab or (ac and bc) else set()
        want -= {3 * g + 2} if ac or bc else set()
        far += sum(jaccard(x, y) >= 0.8 and (simhash.fingerprint(x) ^ simhash.fingerprint(y)).bit_count() > 4 for x, y in ((a, b), (a, c), (b, c)))
    assert far > 10 and len(want) < len(rows)
    d = docs_of(rows)
    assert {x.doc_id for x in near.keep_one(d).collect()} == want
    assert {x.doc_id for x in corpus_pipeline.without_near_copies(spark, d, "").collect()} == want
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id or 0 for x in kept.collect()) == [0, 0, 1, 3, 5, 8, 9]
    assert near.keep_one(none).count() == 0


@pytest.mark.parametrize("tile", [2, 1000])
def test_near_links_in_tiles(spark, tile):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(100)]
    found = {}
    for i in range(40):
        x = list(base)
        for p in r.sample(range(100), 6):
            x[p] = r.getrandbits(64)
        found[i] = np.unique(np.array(x, np.uint64))
    keys = spark.createDataFrame([(i, len(x), [7]) for i, x in found.items()], "s long, n int, keys array<long>")
    hashes = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in found.items()], "s long, hashes binary")
    got = components.components(near.links(near.buckets(keys, tile_rows=tile), hashes), "a", "b").collect()
    p = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(i):
                if len(np.intersect1d(found[i], found[j])) / len(np.union1d(found[i], found[j])) >= 0.8:
                    p[i] = p[j] = min(p[i], p[j])
    assert {x.node: x.component for x in got} == {i: c for i, c in enumerate(p) if p.count(c) > 1}


# --- 4 ----------------------------------------------------------------------------------

ITEM = ("A farmer named Boris sells 12 apples and 7 pears at the market every morning. How many pieces of fruit does Boris sell in 4 days "
        "if nothing else changes at all?")


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, "Which river runs through the old town?"), (3, None), (4, ""), (5, "??"), (1, ITEM)],
                                 "item_id long, text string").withColumn("doc_id", F.lit(3)).withColumn("h", F.lit(1))


def test_decontamination(docs_of, bench):
    other = ITEM.replace("Boris", "Clara").replace("12", "31").replace("7", "9").replace("4", "6")
    mixed = other.replace("does Clara", "does Derek")
    rows = [(1, f"before words here {ITEM} and after"), (2, f"Intro text. {other} End."), (3, f"Intro text. {mixed} End."), (4, ITEM.upper()),
            (5, "Some say the river runs through the old town in spring"), (6, "x which river runs through the old town y"), (7, None), (8, ""),
            (9, "nothing of the kind " * 500), (10, ITEM), (10, ITEM), (None, ITEM), (11, " ".join(ITEM.split()[:9]))]
    d = docs_of(rows).withColumn("item_id", F.lit(0)).withColumn("h", F.lit(0)).withColumn("kind", F.lit(0))
    found = decontam.contaminated(d, bench)
    got = Counter((r.doc_id, r.item_id) for r in found.collect())
    assert got == Counter({(1, 1): 1, (2, 1): 1, (4, 1): 1, (6, 2): 1, (10, 1): 1, (None, 1): 1})
    assert [r.plain for r in found.filter("doc_id = 2").collect()] != [None]
    clean = decontam.without_leaks(d, bench)
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == [3, 5, 7, 8, 9, 11]
    assert decontam.contaminated(d, bench.filter("item_id > 99")).count() == 0
    assert decontam.contaminated(d.filter("doc_id > 99"), bench).count() == 0


def test_names_at_starts_and_of_more_words(spark, docs_of):
    tom = "Tom has 5 apples. Tom buys 7 more. How many apples does Tom have now?"
    boris = "A man called Boris sold 12 big apples to Anna on the market square. How many apples did Boris sell?"
    short = "Tom put 5 pears into the old wooden box today"
    bench = spark.createDataFrame([(1, tom), (2, boris), (3, short)], "item_id long, text string")
    sara = tom.replace("Tom", "Sara").replace("5", "8").replace("7", "3")
    longer = boris.replace("called Boris", "called Boris Petrov").replace("12", "13").replace("Anna", "Anna Lee")
    rows = [(1, sara), (2, f"Intro words. {longer} End."), (3, f"Intro. {short.replace('Tom', 'Mary Ann Smith').replace('5', '9')}."),
            (4, sara.replace("does Sara", "does Derek")), (5, longer.replace("did Boris", "did Derek")),
            (6, sara.replace("Sara", "Sara Lee").replace("does Sara Lee", "does Sara")), (7, "They say Tom put 6 pears into the old wooden box today"),
            (8, "Tom put 5 pears into the old wooden bag today"), (9, "Intro. Mary Smith put 5 pears into the old wooden bag today.")]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(rows), bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (6, 1), (7, 3)}
    assert sorted(r.doc_id for r in decontam.without_leaks(docs_of(rows), bench).collect()) == [4, 5, 8, 9]


def test_short_items_leak_by_whole_sentences(spark, docs_of):
    bench = spark.createDataFrame([(1, "Yes."), (2, "No. Never"), (3, "Tom has 5")], "item_id long, text string")
    rows = [(1, "He said yes to it."), (2, "Is it? YES! Right."), (3, "yes"), (4, "oh. no. never. more"), (9, "oh no. never. more"), (5, "no. never more"), (6, "Tom has 6"), (7, "tom has 5\n"),
            (8, "Tom has 5 apples")]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(rows), bench).collect()}
    assert got == {(2, 1), (3, 1), (4, 2), (7, 3)}


def brute_leaks(docs, items):
    """Plain and template windows of every text against every item, by lists of words; without inner slot conflicts across forms."""
    def tokens(text):
        out, begins = [], True
        for w in re.findall(r"\d+(?:[.,]\d+)*|\w+|[.!?\n]", text or ""):
            if w in ".!?\n":
                begins = True
                continue
            unit = out and out[-1][1] == "number" and w.lower() in decontam.UNITS
            out.append((w.lower(), "unit" if unit else "number" if w[0] in "0123456789" else "name" if w[0].isupper() else "", begins))
            begins = False
        return out

    def form(tok, kind):
        parts = []
        for n, (w, slot, begins) in enumerate(tok):
            slot = "" if kind == 0 or (kind == 1 and begins and slot == "name") else slot
            if slot == "name" and parts and parts[-1][1] == "name" and not begins:
                parts[-1][2].append(w)
            else:
                parts.append((n, slot, [w]))
        return parts

    def windows(parts, size, kind):
        out = []
        for i in range(len(parts) - size + 1):
            p = parts[i:i + size]
            held = sum(bool(s) for _, s, _ in p)
            if kind == 0 or (held and size - held >= min(4, size - 1)):
                out.append((i, p[0][0], tuple(f"<{s}>" if s else w[0] for _, s, w in p), [(s, w) for _, s, w in p if s]))
        return out

    found = set()
    for item, text in items:
        own = tokens(text)
        for doc, body in docs:
            other = tokens(body)
            sound = set()
            for kind in (0, 1, 2):
                a, b = form(own, kind), form(other, kind)
                size = min(8, len(a))
                if not size:
                    continue
                by = defaultdict(list)
                for w in windows(b, size, kind):
                    by[w[2]].append(w)
                hits = defaultdict(list)
                for i, word, words, slots in windows(a, size, kind):
                    for j, _, _, theirs in by[words]:
                        hits[j - i].append((word, slots, theirs))
                for lag, hs in hits.items():
                    pairs = defaultdict(set)
                    for _, s, t in hs:
                        for (k, x), (_, y) in zip(s, t):
                            pairs[k, tuple(x)].add(tuple(y))
                    if kind == 0 or all(len(v) == 1 for v in pairs.values()):
                        sound |= {(kind, word) for word, _, _ in hs}
            for kind in (0, 1, 2):
                n = len(form(own, kind)) - min(8, len(form(own, kind))) + 1
                at = {w for k, w in sound if k == kind}
                if kind:
                    begins = [p[0] for p in form(own, kind)]
                    free = [w for k, w in sound if k == 0 and not any(s for _, s, _ in form(own, kind)[bisect_right(begins, w) - 1:bisect_right(begins, w + 7)])]
                    at |= set(free)
                if own and len(at) >= min(n, 6):
                    found.add((doc, item))
    return found


def test_leaks_equal_brute_force(spark, docs_of):
    r = random.Random(8)
    small = "the old cat sat on a mat near my red house with two big dogs while it was raining and then".split()
    names = ["Ann", "Bob", "Cy", "Dee"]

    def text(n):
        return " ".join(w + r.choice(["", "", "", "", ".", "?"]) for w in (r.choice([*r.sample(small, 9), r.choice(names), str(r.randint(1, 9)),
                                                                                     str(r.randint(1, 9)) + " kg"]) for _ in range(n)))

    def again(t):
        """The same question with other names and numbers, each name and number for one other."""
        other = dict(zip(names, r.sample(["Eve", "Flo", "Gus", "Hal"], 4)))
        number = dict(zip("123456789", r.sample([str(k) for k in range(11, 40)], 9)))
        return " ".join(re.sub(r"^\w+", lambda m: other.get(m[0], number.get(m[0], m[0])), w) for w in t.split(" "))

    items = [(i, text(r.choice([9, 14, 20, 40]))) for i in range(12)]
    docs = []
    for i, t in items:
        docs += [(100 + i, f"{text(10)} {t} {text(10)}"), (200 + i, f"{text(5)}. {again(t)}. {text(5)}"), (300 + i, " ".join(t.split()[:r.randint(6, 13)])),
                 (400 + i, again(t).replace("Eve", "Flo")), (500 + i, text(60))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(docs_of(docs), bench).collect()}
    assert got == brute_leaks(docs, items)
    assert {(100 + i, i) for i, _ in items} <= got
    # Nearly all questions that are asked anew with other values are found.
    assert len({(200 + i, i) for i, _ in items} & got) >= 10


# --- 5 ----------------------------------------------------------------------------------

def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("digest", [exact.sha256, lambda b: len(b).to_bytes(4, "little")])
def test_exact_duplicates(docs, digest):
    got = exact.exact_duplicates(docs, digest=digest).collect()
    g = defaultdict(list)
    for d, t in HARD:
        g[lowered(t)].append(d)
    want, seen = Counter(), set()
    for d, t in HARD:
        ids = g[lowered(t)]
        keep = max((i for i in ids if i is not None), default=None)
        k = d == keep and (d, lowered(t)) not in seen
        seen.add((d, lowered(t)))
        want[(d, keep, len(ids), k)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want


def test_keep_exact(docs, none):
    kept = exact.keep_exact(docs)
    assert kept.columns == docs.columns
    assert Counter(lowered(r.text) for r in kept.collect()) == Counter({lowered(t): 1 for _, t in HARD})
    assert exact.exact_duplicates(none).count() == 0 and exact.keep_exact(none).count() == 0


# --- 6 ----------------------------------------------------------------------------------

@pytest.mark.parametrize("tokenizer", [BPE, PIECES])
def test_token_counts(spark, docs, none, tokenizer):
    cache = scratch(spark, "test-cache")
    enc = WordEncoder(BPE) if tokenizer == BPE else token_cache._Pieces(PIECES)
    want = Counter((d, len((t or "").encode()), len(enc.ids(t or "")) // 4, len(enc.ids(t or "")) // 4 > 1024) for d, t in HARD)
    assert rows_of(token_cache.count_tokens(docs.filter("doc_id < 5"), cache, tokenizer)).total() == 4
    first = spark.read.parquet(cache).count()
    assert first == len({t or "" for d, t in HARD if d is not None and d < 5})
    assert rows_of(token_cache.count_tokens(docs, cache, tokenizer)) == want
    # Only misses were added; a further call adds none.
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in HARD})
    assert rows_of(token_cache.count_tokens(docs, cache, tokenizer)) == want
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in HARD})
    assert token_cache.count_tokens(none, cache, tokenizer).count() == 0


# --- 7 ----------------------------------------------------------------------------------

def test_pieces(docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for d, t in HARD:
        ids = [*lib.encode(t or ""), lib.eos_id()]
        want[(d, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))] += 1
    assert rows_of(sentencepiece_rounds.piece_digests(docs, PIECES)) == want
    assert sentencepiece_rounds.encode_decode(none, PIECES).count() == 0


# --- 8 ----------------------------------------------------------------------------------

def sentences(r, words, n=12):
    return " ".join(r.choice(words) for _ in range(n))


def test_language(docs_of, docs, none):
    r = random.Random(2)
    words = {"aa": "the of and thing reason ocean".split(), "bb": "der und nicht straße öffnen".split(), "cc": "été leçon que où".split()}
    rows = [(i, sentences(r, words[lang]), lang) for i, lang in enumerate(random.Random(1).choices(list(words), k=240))]
    d = docs_of([*rows, (1000, None, "aa"), (1001, "12 34", "aa"), (1002, "the ocean", None)])
    held = d.withColumn("held", language.in_fold(F.col("doc_id")))
    assert {x.doc_id: x.held for x in held.collect()} == {x.doc_id: zlib.crc32(str(x.doc_id).encode()) % 4 == 2 for x in held.collect()}
    m = language.train(held.filter("NOT held"), sample=40)
    assert m.languages == ["aa", "bb", "cc"] and set(m.owner.tolist()) == {0, 1, 2}
    got = {x.doc_id: x for x in language.classify(held, m).collect()}
    out = [i for i, _, _ in rows if got[i].held]
    assert out and all(got[i].lang_pred == rows[i][2] and not got[i].rejected for i in out)
    assert all(0 <= x.score <= 1 for x in got.values())
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "aa"
    assert language.Centroids(m.languages, m.idf, m.matrix, m.owner, m.least).predict("漢字 かな")[2]
    judged = language.classify(docs, m)
    assert judged.count() == len(HARD) and set(docs.columns) <= set(judged.columns)
    again = language.train(held.repartition(5).filter("NOT held"), sample=40)
    assert np.allclose(again.matrix, m.matrix)
    empty = language.train(none)
    assert empty.languages == [] and {x.lang_pred for x in language.classify(docs, empty).collect()} == {"und"}
    assert language.classify(none, m).count() == 0


FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem "
          "i powinni postępować wobec innych w duchu braterstwa.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı "
          "kardeşlik zihniyeti ile hareket etmelidirler.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän "
          "on toimittava toisiaan kohtaan veljeyden hengessä."}


def test_unlearned_languages_of_the_same_script_are_rejected(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", language.in_fold(F.col("doc_id")))
    # A mislabelled row or two in the sample must not open the limits.
    odd = spark.createDataFrame([(10**6 + i, t, lang) for i, (lang, t) in enumerate([("en", FOREIGN["pl"]), ("de", "zzz qqq xxx")])],
                                "doc_id long, text string, lang string")
    m = language.train(d.filter("NOT held").select("doc_id", "text", "lang").unionByName(odd))
    for text in FOREIGN.values():
        assert m.predict(text)[2] and m.predict(text * 20)[2] and m.predict(text[:80])[2]
    got = language.classify(d.filter("held AND source IS NOT NULL"), m).filter("lang_pred = lang").agg(
        F.count("*").alias("n"), F.sum(F.col("rejected").cast("int")).alias("out")).first()
    assert got.n > 200 and got.out == 0


# --- 9 ----------------------------------------------------------------------------------

def check_shards(rows, docs, shards, slack_rows):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    slots, load = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(load.values()) <= sum(load.values()) / shards + slack_rows
    return load


def test_shards(spark, docs_of, docs, none):
    check_shards(ring.shard_rows(docs, 4, vnodes=8).collect(), HARD, 4, 200_000)
    r = random.Random(6)
    rows = [(i, "x" * r.randint(0, 60)) for i in range(600)] + [(i, "a hot text of some length") for i in range(600, 900)]
    d = docs_of(rows)
    load = check_shards(ring.shard_rows(d, 6, vnodes=16, chunk_rows=50).collect(), rows, 6, 90)
    assert len(load) == 6
    # Chunks change neither the loads' bound nor the slots; no hash node keeps a row from its place without need.
    check_shards(ring.shard_rows(d, 6, vnodes=16, heavy_parts=10_000).collect(), rows, 6, 90)
    loose = ring.shard_rows(d.filter("doc_id < 600"), 6, vnodes=16, slack=10.0).collect()
    assert not any(x.moved for x in loose)
    assert ring.shard_rows(none, 4, vnodes=8).count() == 0


# --- 10 ---------------------------------------------------------------------------------

def test_passages(docs_of, docs, none):
    r = random.Random(11)
    w = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    p = ". ".join(w(8).capitalize() for _ in range(8)) + "."
    rows = [(i, f"{w(20)}.\n{w(9)} {w(3)}. {p} {w(7)}.\n{w(12)}") for i in (4, 2, 9)] + [(20, w(60)), (21, None), (22, "")]
    rows += [(30 + i, f"{w(10)}.\nshared line of some six words\n{w(10)}") for i in range(3)]
    d = docs_of(rows)
    got = passages.repeated_spans(d).collect()
    assert {x.doc_id for x in got} == {4, 9} and all(x.kept_doc_id == 2 for x in got)
    text = dict(rows)
    assert all(p.split()[8:][0] in text[x.doc_id][x.start:x.end] and x.n_words >= 50 for x in got)
    clean = {x.doc_id: x for x in passages.remove_spans(d, passages.repeated_spans(d)).collect()}
    for i in (4, 9):
        (a, b), = [(s.start, s.end) for s in clean[i].removed]
        assert clean[i].clean_text == text[i][:a] + text[i][b:]
    assert clean[2].clean_text == text[2] and clean[21].clean_text is None and clean[22].removed is None
    assert {x.doc_id for x in passages.repeated_spans(d, min_words=6).collect()} == {4, 9, 31, 32}
    hard_spans = passages.repeated_spans(docs).collect()
    assert {x.doc_id for x in hard_spans} == {4}
    assert passages.remove_spans(docs, passages.repeated_spans(docs)).count() == len(HARD)
    assert passages.repeated_spans(none).count() == 0


def test_passages_without_sentence_ends(docs_of):
    r = random.Random(17)
    w = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    inner, half, run = w(51), w(26) + ". " + w(25), "word " * 51
    rows = [(1, f"{w(40)} {inner} {w(33)}"), (2, f"{w(13)} {inner.replace(' ', chr(10), 30)} {w(60)}"), (3, f"{w(30)} {half} {w(20)}"),
            (4, f"{w(17)} {half} {w(41)}"), (5, f"{w(20)} {run}{w(30)}"), (6, f"{w(31)} {run}{w(9)}"), (7, f"{w(80)} {' '.join(inner.split()[:11])} {w(80)}")]
    d = docs_of(rows)
    spans = passages.repeated_spans(d)
    got = {x.doc_id: x for x in spans.filter("doc_id NOT IN (5, 6)").collect()}
    assert {i: x.kept_doc_id for i, x in got.items()} == {2: 1, 4: 3}
    assert spans.filter("doc_id = 6").count() >= 1
    for i, p in ((2, inner), (4, half)):
        part = " ".join(dict(rows)[i][got[i].start:got[i].end].split())
        assert part in " ".join(p.split()) and len(part.split()) >= 20
    for x in passages.remove_spans(d, spans).collect():
        assert x.clean_text == "".join(c for k, c in enumerate(x.text) if not any(s.start <= k < s.end for s in x.removed or []))


def test_passages_end_where_texts_part(docs_of):
    r = random.Random(23)
    w = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    passage, part, lines = w(55), w(45), ". ".join(w(9) for _ in range(5)) + "."
    rows = [(1, f"{w(70)} {passage} {w(40)}"), (None, f"{w(33)} {passage.upper()} {w(90)}"), (2, f"{w(64)} {part} {w(30)}"), (3, f"{w(31)} {part} {w(50)}"),
            (4, f"{w(30)}. {lines} {w(30)}"), (5, f"{w(40)}. {lines} {w(20)}"), (6, f"{w(60)} {passage}")]
    d = docs_of(rows * 2)
    got = {x.doc_id: x for x in passages.repeated_spans(d).collect()}
    # Fewer than 50 words stay, of longer passages all words go, none beside them.
    assert set(got) == {6, None} and all(x.n_words == 55 and x.kept_doc_id == 1 for x in got.values())
    assert all(dict(rows)[i][x.start:x.end].strip().lower() == passage for i, x in got.items())
    assert {x.doc_id for x in passages.repeated_spans(d, min_words=40).collect()} == {None, 3, 5, 6}


def test_words_beside_a_place():
    text = "One two\n three.four  five"
    near = [x for x in passages.words_beside(text, [(0, 0), (0, 1), (15, 0), (15, 1), (25, 1)], 2)]
    assert near == [([], []), (["one", "two"], [3, 7]), (["three.", "two"], [9, 4]), (["four", "five"], [19, 25]), ([], [])]


def test_chunks_of_any_passage_align():
    r = random.Random(5)
    for k in range(300):
        words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(51)]
        if k % 10 == 0:
            words = ["aa"] * 51
        texts = [" ".join(["".join(r.choices("ijklm", k=5)) for _ in range(r.randint(0, 40))] + words + ["".join(r.choices("ijklm", k=5)) for _ in range(r.randint(0, 40))])
                 for _ in range(2)]
        a, b = ([x for x in passages.chunks(t)] for t in texts)
        digests = {x[3] for x in a}
        best = held = 0
        for x in b:
            held = held + x[2] if x[3] in digests else 0
            best = max(best, held)
        assert best >= 20
