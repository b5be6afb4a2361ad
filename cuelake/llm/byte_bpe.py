"""Byte-level BPE through the tokenizers library, one library call per distinct word.

A byte-level pre-tokenizer never joins what stands before a space to what follows it, so a
text may be cut in front of every space that follows a non-space: the parts encode exactly
as they do inside the text. Words repeat, so each worker keeps the ids of words it has seen.
Tokenizers of any other build are given whole texts.
"""

from __future__ import annotations

import json
import os
from array import array

WORDS_KEPT = 800_000

def cuts_at_spaces(spec: dict) -> bool:
    """Is a cut in front of a space harmless for this tokenizer (its JSON)?"""
    pre = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"])
                for t in spec.get("added_tokens") or [])
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout") and plain)


def byte_letters() -> dict[int, str]:
    """The published byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 onwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """``ids(text)``: little-endian unsigned 32-bit token ids of a whole text, as bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_word = cuts_at_spaces(json.load(f))
        self.model, self.alphabet = self.tok.model, byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, s: str) -> bytes:
        """Ids of letters, one space in front or none: a single word to the pre-tokenizer, so its model is asked at once."""
        if not s.isascii():
            s = s.encode().decode("latin-1").translate(self.alphabet)
        elif s[0] == " ":
            s = "\u0120" + s[1:]
        return array("I", [t.id for t in self.model.tokenize(s)]).tobytes()

    def part(self, s: str) -> bytes:
        """Ids of a part that begins a text or follows a non-space."""
        spaced = len(s) > 1 and s[0] == " " and s[1] != " "
        kept, key = (self.words, s[1:]) if spaced else (self.parts, s)
        v = kept.get(key)
        if v is not None:
            return v
        at = s.find("\n")
        if 0 < at < len(s) - 1 and not s[at - 1].isspace() and not s[at + 1].isspace():
            return self.part(s[:at]) + self.part("\n") + self.part(s[at + 1:])  # a single line end stands alone
        if len(s) > 2 and s[-1] in ".," and s[-2] < "\u0250" and s[-2].isalpha():
            v = self.part(s[:-1]) + self.part(s[-1])  # letters end where punctuation begins
        else:
            word = key if spaced else s
            v = self.letters(s) if word.isalpha() and max(word) < "\u0250" else self.library(s)
        if len(s) < 48:
            if len(kept) >= WORDS_KEPT:
                kept.clear()
            kept[key] = v
        return v

    def ids(self, text: str) -> bytes:
        if not self.by_word:
            return self.library(text)
        pieces = text.split(" ")
        out = list(map(self.words.get, pieces))
        out[0] = self.part(pieces[0]) if pieces[0] else b""
        if None in out:
            last = 0  # the piece in front of the spaces
            for i, v in enumerate(out):
                p = pieces[i]
                if v is None:
                    if not p:
                        out[i] = b""
                        continue
                    out[i] = self.part(" " * (i - last) + p)
                elif i - last > 1:
                    out[i] = self.part(" " * (i - last) + p)
                last = i
            if last < len(pieces) - 1:
                out.append(self.part(" " * (len(pieces) - 1 - last)))
        return b"".join(out)
