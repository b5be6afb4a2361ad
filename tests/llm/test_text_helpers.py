"""Spark-free parts against their libraries or plain versions."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cuelake.llm import decontam, language, passages, simhash, token_blocks
from cuelake.llm.byte_bpe import WordEncoder
from cuelake.llm.sentencepiece_rounds import Model

ODD = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'ll", "<|endoftext|>", "</s>", "<unk>", "<0x41>", "1", "23", " ",
       "　", "漢", "!", "\x1c", "\r\n", "x", "▁", "…", "½", "​", "\U0001F600", "aaaa", "tion", "ll", "\x00", "벨"]


def odd_texts(n: int, longest: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_word_encoder_equals_library():
    e = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert e.by_word
    for t in ["", " ", "a", "\n", *odd_texts(4000, 14, 1)]:
        assert e.ids(t) == e.library(t), repr(t)


def test_other_tokenizers_get_whole_texts():
    e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not e.by_word
    assert e.ids("Some  Text") == e.library("Some  Text")


@pytest.fixture(scope="module")
def pieces():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return Model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_piece_rounds_equal_library(pieces):
    m, lib = pieces
    r = random.Random(5)
    runs = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(0, 80))) for _ in range(800)]
    vocab = [p.replace("▁", " ") for p in m.pieces[259:]]
    joined = ["".join(r.choice(vocab) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    texts = ["", " ", "   ", "▁", "\n", " \n ", "aaaaaaaaaaaaaaaaaaaaa", "the" * 500, *runs, *joined, *odd_texts(3000, 18, 2)]
    for t, got, want in zip(texts, m.encode(texts), lib.encode(texts)):
        assert got.tolist() == want, repr(t)
        assert m.decode(np.array([*want, m.end], np.int64)) == lib.decode([*want, m.end]), repr(t)


def test_piece_rounds_on_a_long_word(pieces):
    m, lib = pieces
    r = random.Random(9)
    t = "".join(r.choice("etaoinsh") for _ in range(5000)) + "ab" * 4000
    assert m.encode([t])[0].tolist() == lib.encode(t)


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 1000])
@pytest.mark.parametrize("high", [1, 7, 50_000, 2**32])
def test_blocks_round_trip(n, high):
    ids = np.random.default_rng(n + high % 97).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    if n > 5:
        ids[4] = 2**32 - 1  # an exception
    b = token_blocks.pack(ids)
    assert (token_blocks.unpack(b, n) == ids).all()
    if n > 128:
        assert (token_blocks.unpack(b, n, only=np.array([1]))[0][:min(128, n - 128)] == ids[128:256]).all()
    doc, length, blocks, count = token_blocks.from_bytes(token_blocks.to_bytes([None, 5], [n, 0], ids))
    assert doc == [None, 5] and length.tolist() == [n, 0] and count == n
    assert (token_blocks.unpack(blocks, n) == ids).all()


def test_fingerprint_by_the_letter():
    import re

    import xxhash

    for t in ["", " \t", "One", "one two THREE", "Ä b c d e f \x0b g\x0c h", " x y z w v", "a " * 100, "é" * 50 + " q r s t u"]:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t)
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sh = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(t) == want, repr(t)


def test_any_four_bits_share_a_bucket():
    masks = simhash.bucket_masks()
    r = random.Random(3)
    for _ in range(500):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), 4):
            b ^= 1 << k
        assert any(a & m == b & m for m in masks)


def test_template_tokens():
    t = decontam.Tokens(["", "In total Ann has 3.5 kg of rice. Tom ate 2 apples", "5", "kg ΟΔΟΣ οδος"])
    assert t.window(1, 0, 7) == (1, "in total <name> has <number> <unit> of", 0, 0, ["3ann", "13.5", "2kg"])
    assert t.window(2, 8, 3)[1:] == ("<name> ate <number>", 8, 8, ["3tom", "12"])
    # A unit follows a number of its own text, a window lies in one text, equal words have equal codes.
    assert t.window(0, 13, 2) == (3, "kg οδος", 0, 0, []) and t.forms[1][1][13] == 0 and t.code[14] == t.code[15]
    assert [at.tolist() for kind, at, _ in t.hashes(3) if kind == 0] == [[*range(10), 13]]
    assert decontam.Tokens([""]).hashes(8) == [] and decontam.Tokens([" .!\n"]).raw == []


def test_units_cover_whole_lines():
    t = "One two. Three four five six.\nshort\n\nA passage of words, no end"
    u = passages.units(t)
    assert [x[3] for x in u] == ["one two. three four five six.", "short", "a passage of words, no end"]
    assert all(t[a:b].lower().split() == n.split() for a, b, _, n in u)
    assert passages.units("") == [] and passages.units(" \n ") == []


def test_language_counts_ignore_what_is_no_letter():
    assert (language.counts("Abc,  def") == language.counts("abc 1 DEF")).all()
    assert not language.has_letter("12 !") and not language.has_letter(None) and language.has_letter("1é")
