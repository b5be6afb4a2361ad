"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The text, spaces escaped, is cut where no piece of the vocabulary can reach across: in front
of a run of escaped spaces and around line ends (both tested against the vocabulary). Distinct
words of a batch are laid out in one flat symbol array. Each round looks up the rank of every
adjacent pair, takes the minimum per word, and merges in all words at once, then compacts the
array; words without a pair leave. In a word, equal pairs merge together from the left where
that cannot differ from one at a time: where no piece built on the new symbol ranks before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import bounded_batches, lean, nonnull_text, worker_state

SPACE = "▁"
NO = np.iinfo(np.int64).max
# Bytes of words and their ids kept per generation, with what Python adds to each, and words that are looked up together.
KEPT_BYTES, PER_WORD, GROUP = 24 << 20, 200, 1 << 17
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Model:
    """A BPE model with identity normalisation and byte fallback, read from its file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        norm, train = m.normalizer_spec, m.trainer_spec
        types = {p.type for p in m.pieces}
        if (train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or not train.byte_fallback or train.treat_whitespace_as_suffix or types & {USER_DEFINED, UNUSED}):
            raise ValueError("only BPE models with identity normalisation and byte fallback are supported")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in m.pieces]
        self.types = [p.type for p in m.pieces]
        ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.unknown = self.types.index(UNKNOWN)
        self.end = ids.get("</s>", next((i for i, p in enumerate(m.pieces) if p.piece == "</s>"), -1))
        self.byte = [0] * 256
        for i, p in enumerate(m.pieces):
            if p.type == BYTE:
                self.byte[int(p.piece[3:-1], 16)] = i
        # Rank: place in the order of falling score. Equal scores share a rank (leftmost first).
        scores = sorted({m.pieces[i].score for i in ids.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        n = len(m.pieces)
        self.rank = np.full(n, NO)
        for i in ids.values():
            self.rank[i] = rank_of[m.pieces[i].score]
        pairs: dict[int, int] = {}
        early = np.zeros(n, bool)  # a piece built on this one ranks before it, or level with it
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
                    for x in (a, b):
                        if self.rank[i] <= self.rank[x]:
                            early[x] = True
        self.n, self.early = n, early
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_id = np.array([pairs[k] for k in self.pair_key.tolist()], np.int64)
        self.slot = None
        chars = {c: i for c, i in ids.items() if len(c) == 1}
        self.char_key = np.array(sorted(map(ord, chars)), np.int64)
        self.char_id = np.array([chars[chr(k)] for k in self.char_key.tolist()], np.int64)
        self.ids = ids
        inner = [p for p in ids if len(p) > 1]
        self.line_cut = not any("\n" in p for p in inner)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in inner):
            raise ValueError("a piece holds a space behind another character")
        self.split = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if self.line_cut else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self._hash()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.kept_bytes = 0

    def _hash(self) -> None:
        """Open-addressed table of pairs: a few gathers instead of a binary search."""
        bits = int(np.ceil(np.log2(len(self.pair_key) * 4 + 2)))
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.slot_key, self.slot_id = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.probes = 1
        for k, v in zip(self.pair_key.tolist(), self.pair_id.tolist()):
            s = ((k * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> int(self.shift)
            step = 1
            while self.slot_key[s] != -1:
                s, step = (s + 1) % size, step + 1
            self.slot_key[s], self.slot_id[s] = k, v
            self.probes = max(self.probes, step)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the piece that a pair makes, or -1. Unknown characters (negative) make none."""
        key = a * self.n + b
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        out = np.full(len(a), -1, np.int64)
        todo = np.nonzero((a >= 0) & (b >= 0))[0]
        for _ in range(self.probes):
            k = self.slot_key[at[todo]]
            hit = k == key[todo]
            out[todo[hit]] = self.slot_id[at[todo[hit]]]
            todo = todo[~hit & (k != -1)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.slot_key) - 1)
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (without spaces escaped anew): merge rounds over all words at once."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        at = np.minimum(np.searchsorted(self.char_key, code), len(self.char_key) - 1)
        sym = np.where(self.char_key[at] == code, self.char_id[at], -1 - code)
        word = np.repeat(np.arange(len(words)), length)
        done_sym, done_word, done_pos = [], [], []
        pos = np.arange(len(sym))
        made = self.merged(sym[:-1], sym[1:]) if len(sym) > 1 else np.zeros(0, np.int64)
        while len(sym) > 1:
            made = np.where(word[:-1] == word[1:], made, -1)
            rank = np.where(made >= 0, self.rank[made], NO)
            first = np.nonzero(np.r_[True, word[1:] != word[:-1]])[0]
            low = np.minimum.reduceat(np.append(rank, NO), first)  # the last pair of a word is with the next: NO
            live = low < NO
            count = np.diff(np.append(first, len(sym)))
            if not live.all():
                keep = np.repeat(live, count)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                done_pos.append(pos[~keep])
                both = keep[:-1] & keep[1:]
                sym, word, pos = sym[keep], word[keep], pos[keep]
                if not len(sym):
                    break
                # Pairs inside kept words stay; those between words are masked anew.
                inner = np.full(len(sym) - 1, -1, np.int64)
                src = np.nonzero(keep)[0][:-1]
                ok = both[src]
                inner[ok] = made[src[ok]]
                made = np.where(word[:-1] == word[1:], inner, -1)
                rank = np.where(made >= 0, self.rank[made], NO)
                low, count = low[live], count[live]
            least = np.repeat(low, count)[:-1]
            cand = np.nonzero((rank == least) & (rank < NO))[0]
            w, m = word[cand], made[cand]
            lead = np.r_[True, w[1:] != w[:-1]]
            # The leftmost pair, and equal pairs (the same piece) to its right where that is safe.
            head = np.maximum.accumulate(np.where(lead, np.arange(len(cand)), 0))
            same = (m == m[head]) & (sym[cand] == sym[cand[head]]) & ~self.early[m]
            take = lead | same
            # A candidate that another one of its word precedes with a different piece waits.
            other = np.where(take, 0, 1)
            blocked = np.cumsum(other) - np.cumsum(other)[head] + other[head] > 0
            take &= ~blocked | lead
            cand, m = cand[take], m[take]
            # Overlapping pairs (a a a): every second one of a chain of neighbours, from the left.
            chain = np.r_[True, np.diff(cand) != 1]
            start = np.maximum.accumulate(np.where(chain, np.arange(len(cand)), 0))
            even = (np.arange(len(cand)) - start) % 2 == 0
            cand, m = cand[even], m[even]
            sym[cand] = m
            keep = np.ones(len(sym), bool)
            keep[cand + 1] = False
            moved = np.cumsum(keep) - 1
            pairs = np.append(made, -1)[keep][:-1]
            sym, word, pos = sym[keep], word[keep], pos[keep]
            if len(sym) < 2:
                break
            # Only pairs with a new symbol are looked up again.
            at = moved[cand]
            new = np.zeros(len(sym), bool)
            new[at] = True
            new[at[at > 0] - 1] = True
            fresh = np.nonzero(new[:-1])[0]
            pairs[fresh] = self.merged(sym[fresh], sym[fresh + 1])
            made = pairs
        sym, word, pos = (np.concatenate([*d, x]) for d, x in ((done_sym, sym), (done_word, word), (done_pos, pos)))
        order = np.argsort(pos, kind="stable")
        sym, word = sym[order], word[order]
        return self._ids(sym, word, len(words))

    def _ids(self, sym: np.ndarray, word: np.ndarray, n: int) -> list[bytes]:
        """Unknown characters become the byte pieces of their UTF-8 form."""
        bad = np.nonzero(sym < 0)[0]
        if len(bad):
            size = np.ones(len(sym), np.int64)
            raw = [chr(-1 - c).encode("utf-8", "replace") for c in sym[bad].tolist()]
            size[bad] = [len(r) for r in raw]
            at = np.cumsum(size) - size
            out = np.repeat(sym, size)
            for p, r in zip(at[bad].tolist(), raw):
                out[p:p + len(r)] = [self.byte[x] for x in r]
            sym, word = out, np.repeat(word, size)
        cut = (np.searchsorted(word, np.arange(n + 1)) * 4).tolist()
        raw = sym.astype(np.int32).tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def _know(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words. They are kept in two generations: what the older one has and is asked for again moves to the newer."""
        if self.kept_bytes > KEPT_BYTES:
            self.known, self.before, self.kept_bytes = {}, self.known, 0
        known, before = self.known, self.before
        new = words - known.keys()
        met = new & before.keys()
        for w in met:
            known[w] = before[w]
        # Words of like length together, so that long ones do not keep short ones waiting.
        todo = sorted(new - met, key=len)
        i = 0
        while i < len(todo):
            j, size = i, 0
            while j < len(todo) and (size < 400_000 or j == i):
                size += len(todo[j])
                j += 1
            known.update(zip(todo[i:j], self.words(todo[i:j])))
            i = j
        self.kept_bytes += sum(PER_WORD + len(w) + len(known[w]) for w in new)
        return known

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, without end ids. An empty text has none. ``GROUP`` words of the texts are looked up together."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def look_up() -> None:
            known = self._know(set(chain.from_iterable(ws for _, ws in held)))
            for i, ws in held:
                out[i].append(b"".join(map(known.__getitem__, ws)))
            held.clear()

        for i, t in enumerate(texts):
            words = self.split.findall(((SPACE if self.prefix else "") + t).replace(" ", SPACE)) if t else []
            for k in range(0, len(words), GROUP):
                held.append((i, words[k:k + GROUP] if len(words) > GROUP else words))
                size += len(held[-1][1])
                if size >= GROUP:
                    look_up()
                    size = 0
        look_up()
        return [np.frombuffer(b"".join(x), np.int32) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control pieces vanish, bytes join, the added space goes."""
        if not len(ids):
            return ""
        plain, high = self._surface()
        if high[ids].any():
            out, raw, byte_of = [], bytearray(), self._byte_of()
            for i in ids.tolist():
                b = byte_of.get(i)
                if b is not None:
                    raw.append(b)
                    continue
                if raw:
                    out.append(bytes(raw).decode("utf-8", "replace"))
                    raw.clear()
                out.append(plain[i])
            if raw:
                out.append(bytes(raw).decode("utf-8", "replace"))
            s = "".join(out)
        else:
            s = "".join(map(plain.__getitem__, ids.tolist()))
        lead = next((i for i in ids.tolist() if self.types[i] != CONTROL), None)
        return s[1:] if lead is not None and self.prefix and self.pieces[lead].startswith(SPACE) else s

    def _byte_of(self) -> dict[int, int]:
        if not hasattr(self, "_bytes"):
            self._bytes = {i: b for b, i in enumerate(self.byte)}
        return self._bytes

    def _surface(self) -> tuple[list[str], np.ndarray]:
        """Texts of pieces; which pieces are bytes of longer characters. A byte below 128 is a character."""
        if not hasattr(self, "_text"):
            text = [" \u2047 " if t == UNKNOWN else "" if t in (CONTROL, BYTE) else p.replace(SPACE, " ")
                    for p, t in zip(self.pieces, self.types)]
            high = np.zeros(len(text), bool)
            for b, i in enumerate(self.byte):
                text[i], high[i] = (chr(b), False) if b < 128 else ("", True)
            self._text = text, high
        return self._text


def load(path: str) -> Model:
    return worker_state(("piece_rounds", path), lambda: Model(path))


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (with one end id), decoded text.

    Null text counts as empty: the end id alone, decoded to an empty text. Rows stay as they
    are, repeated ones and null ids too; other columns are not read.
    """
    schema = "ids array<int>, decoded string"
    return _per_text(docs, id_col, text_col, model, schema, lambda m: lambda ids: [
        pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(m.decode, ids)), pa.string())])


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """Encoding and decoding as digests: doc_id, n_tokens, ids_sha256, decoded_sha256. Rows as in :func:`encode_decode`."""
    def digests(m: Model):
        decimal = [str(i) for i in range(m.n)]
        sha = lambda texts: pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in texts], pa.string())
        return lambda ids: [pa.array(list(map(len, ids)), pa.int64()), sha(" ".join(map(decimal.__getitem__, x.tolist())) for x in ids), sha(map(m.decode, ids))]

    return _per_text(docs, "doc_id", "text", model, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _per_text(docs: DataFrame, id_col: str, text_col: str, model: str, schema: str, columns) -> DataFrame:
    """doc_id and the columns that ``columns(model)`` makes of the ids of some texts; encoding and decoding are one pass."""
    bounded_batches(docs.sparkSession)
    schema = f"doc_id long, {schema}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        end, made = np.array([m.end], np.int32), columns(m)
        for b in batches:
            for i in range(0, b.num_rows, 128):
                ids = [np.append(x, end) for x in m.encode(b.column(1).slice(i, 128).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 128), *made(ids)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), nonnull_text(text_col).alias("t")).mapInArrow(lean(run), schema)
