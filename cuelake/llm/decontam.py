"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so that a question asked anew with other
parameters has the same template. A run of capitalised words inside a sentence is one name,
however many words it has. A capital at the start of a sentence tells nothing, so there are
two templates: with such openers as words, and with them as (part of) names.

Windows of ``WINDOW`` words are hashed, in their plain form and, where they hold a placeholder,
in template form, and joined to the windows of the benchmark by hash and content. What stood in
the placeholders must be consistent: one value of the item stands for one value of the document;
a name may be longer in one place than in another. A document leaks an item when windows that
cover ``RUN`` words of it match (all its windows, for a shorter item); words of a template are
counted with each name as one. An item with fewer than ``SHORT`` words is leaked only where its words, as they
are, begin and end with sentences of the document: a document does not leak an item ``Yes.`` by that word. Template windows with fewer than ``LITERALS`` words that are not
placeholders do not match.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import bounded_batches, lean, nonnull_text, worker_state, written

WINDOW = 8
RUN = 13
LITERALS = 4
SHORT = 5
TOKEN = re.compile(r"[^\W\d]\w*|\d+(?:[.,]\d+)*|[.!?\n]")
# Words that count as units behind a number.
UNITS = frozenset("""mm cm m km mi ft in yd inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
kilometre kilometres centimeter centimeters g kg mg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons
ml cl l liter liters litre litres gallon gallons s sec ms min h hr second seconds minute minutes hour hours day days week weeks month
months year years percent dollar dollars cent cents euro euros usd eur mph kmh degree degrees celsius fahrenheit watt watts kw
volt volts amp amps hz khz mhz ghz kb mb gb tb byte bytes""".split())
NUMBER, UNIT, NAME = (zlib.crc32(f"\0{k}".encode()) for k in ("number", "unit", "name"))
SLOT_CODE = np.array([0, NUMBER, UNIT, NAME], np.uint64)
# Classes of tokens: 0 to 3 as slots, and the end of a sentence. So many words are coded at once.
END, SLICE = 4, 200_000
# Characters of texts that are coded together.
GROUP = 100_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(64, MULTIPLIER))
FILTER_BITS = 23
WINDOWS = "h long, kind int, words string, at int, word int, slots array<string>"


class Letters:
    """Tables over all characters: lower case (one character each; the final sigma as any), and whether it is a capital."""

    def __init__(self):
        every = [chr(i) for i in range(0x110000)]
        lower = [c.lower() for c in every]
        self.lower = np.fromiter((ord(x) if len(x) == 1 else i for i, x in enumerate(lower)), np.uint32, 0x110000)
        self.lower[ord("\u03c2")] = ord("\u03c3")
        self.capital = np.fromiter(map(str.isupper, every), bool, 0x110000)
        self.units = np.sort(self.words(sorted(UNITS))[0])

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes and classes of words: END, 1 begins with a digit, 3 with a capital, else 0. Equal words have equal codes."""
        parts = [self._words(words[k:k + SLICE]) for k in range(0, len(words), SLICE)] or [(np.zeros(0, np.uint64), np.zeros(0, np.int8))]
        return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts)))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        c = np.frombuffer("\0".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate([[0], np.nonzero(c == 0)[0] + 1])
        size = np.diff(np.append(at, len(c) + 1))
        place = np.arange(len(c)) - np.repeat(at, size)[:len(c)]
        code = np.add.reduceat(self.lower[c] * POWERS[np.minimum(place, len(POWERS) - 1)], at)
        first = c[at]
        kind = np.where(self.capital[first], 3, 0).astype(np.int8)
        kind[(first >= 48) & (first <= 57)] = 1
        kind[(first == 46) | (first == 33) | (first == 63) | (first == 10)] = END
        return code ^ (code >> np.uint64(31)), kind


class Tokens:
    """Words of texts one after another, plain and as templates. Places count over all texts of the group."""

    def __init__(self, texts: list[str]):
        letters = worker_state("decontam-letters", Letters)
        raws = [TOKEN.findall(t) for t in texts]
        raw = raws[0] if len(raws) == 1 else list(chain.from_iterable(raws))
        text = np.repeat(np.arange(len(raws)), np.fromiter(map(len, raws), np.int64, len(raws)))
        code, kind = letters.words(raw)
        word = np.nonzero(kind != END)[0]
        self.raw = list(map(raw.__getitem__, word.tolist())) if len(word) < len(raw) else raw
        starts = np.ones(len(raw), bool)
        starts[1:] = (kind[:-1] == END) | (text[1:] != text[:-1])
        # Which words begin a sentence; behind the last word one may begin.
        self.starts = np.append(starts[word], True)
        starts, self.code, named, self.text = starts[word], code[word], kind[word], text[word]
        # A capital makes a name, a digit in front a number, a unit follows a number.
        behind = np.nonzero((named[:-1] == 1) & (self.text[1:] == self.text[:-1]))[0] + 1
        near = letters.units[np.minimum(np.searchsorted(letters.units, self.code[behind]), len(letters.units) - 1)]
        named[behind[near == self.code[behind]]] = 2
        # Template 1 has a sentence's first word as it is, template 2 as a name if it has a capital.
        inside = np.where(starts & (named == 3), 0, named).astype(np.int8)
        every = np.arange(len(word))
        self.forms = {0: (every, np.zeros(len(word), np.int8), self.code, every + 1), 1: self._form(inside, starts)}
        self.forms[2] = self._form(named, starts) if (inside != named).any() else self.forms[1]
        # Where each text's parts begin.
        self.offsets = {k: np.searchsorted(self.text[f[0]], np.arange(len(raws) + 1)) for k, f in self.forms.items()}

    def _form(self, slot: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, placeholder, code and end of each part of the template: a run of names in one sentence is one part."""
        first = np.ones(len(slot), bool)
        first[1:] = (slot[1:] != 3) | (slot[:-1] != 3) | starts[1:]
        begin = np.nonzero(first)[0]
        slot, code = slot[begin], self.code[begin]
        return begin, slot, np.where(slot > 0, SLOT_CODE[slot], code), np.append(begin[1:], len(self.raw))

    def parts(self, kind: int, text: int = 0) -> int:
        return int(self.offsets[kind][text + 1] - self.offsets[kind][text])

    def hashes(self, size: int, kinds: tuple[int, ...] = (0, 1, 2)) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, window starts, window hashes) of windows inside one text: kind 0 plain, 1 and 2 templates of windows with
        a slot and enough words."""
        out = []
        for kind in kinds:
            begin, slot, code, _ = self.forms[kind]
            n = len(begin) - size + 1
            if n <= 0:
                continue
            if kind == 2 and self.forms[2] is self.forms[1] and out and out[-1][0] == 1:
                out.append((2, *out[-1][1:]))
                continue
            text = self.text[begin]
            fits = text[:n] == text[size - 1:]
            if kind:
                slots = np.concatenate([[0], np.cumsum(slot > 0)])
                held = slots[size:] - slots[:-size]
                fits &= (held > 0) & (size - held >= min(LITERALS, size - 1))
            at = np.nonzero(fits)[0]
            h = np.full(n, (kind > 0) * 977 + size, np.uint64)
            for k in range(size):
                h ^= code[k:k + n]
                h *= MULTIPLIER
                h ^= h >> np.uint64(29)
            out.append((kind, at, h if len(at) == n else h[at]))
        return out

    def whole(self, i: int, size: int) -> bool:
        """Do these words begin a sentence, and end one?"""
        return bool(self.starts[i] and self.starts[i + size])

    def any_slot(self, kind: int, i: int, size: int) -> bool:
        """Does a template have a slot among these words?"""
        begin, slot, _, _ = self.forms[kind]
        a, b = np.searchsorted(begin, [i, i + size - 1], side="right") - 1
        return bool((slot[a:b + 1] > 0).any())

    def window(self, kind: int, i: int, size: int) -> tuple[int, str, int, int, list[str]]:
        """Text, words, place of the first part and of its first word in the text, and the slots (kind and words) of a window."""
        begin, slot, _, end = (x[i:i + size].tolist() for x in self.forms[kind])
        text = int(self.text[begin[0]])
        if kind == 0:
            words, slots = " ".join(self.raw[i:i + size]), []
        else:
            words = " ".join(("", "<number>", "<unit>", "<name>")[s] or self.raw[w] for w, s in zip(begin, slot))
            slots = [f"{s}{' '.join(self.raw[w:e]).lower()}" for w, e, s in zip(begin, end, slot) if s]
        return text, words.lower(), i - int(self.offsets[kind][text]), begin[0] - int(self.offsets[0][text]), slots


def groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Number of the first text and texts that are coded together: many short ones, or a long one."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t.as_py()
        if held and size + len(t) > GROUP:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def _rows(ids: list, found: list[tuple], name: str) -> pa.RecordBatch:
    types = pa.schema([(name, pa.int64()), ("h", pa.int64()), ("kind", pa.int32()), ("words", pa.string()), ("at", pa.int32()),
                       ("word", pa.int32()), ("slots", pa.list_(pa.string()))])
    cols = list(zip(*found)) if found else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip([ids, *cols], types)], schema=types)


def benchmark_windows(bench: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """The windows of each item, with size, parts (of the item's form) and free (the templates in which a plain window
    holds no slot); an item shorter than a window is one window, one under ``SHORT`` words a plain one."""
    bounded_batches(bench.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, parts, free, found = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tok = Tokens([t])
                for form in tok.forms if tok.parts(0) >= SHORT else (0,):
                    size = min(window, tok.parts(form))
                    for kind, at, h in tok.hashes(size, (form,)) if size else []:
                        for p, x in zip(at.tolist(), h.view(np.int64).tolist()):
                            ids.append(i)
                            sizes.append(size)
                            parts.append(tok.parts(form))
                            free.append([k for k in (1, 2) if kind == 0 and not tok.any_slot(k, p, size)])
                            _, words, part, word, slots = tok.window(kind, p, size)
                            found.append((x, kind, words, part, word, slots))
            rows = _rows(ids, found, "item_id")
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sizes, pa.int32()), pa.array(parts, pa.int32()), pa.array(free, pa.list_(pa.int32()))],
                                             names=[*rows.schema.names, "size", "parts", "free"])

    return (bench.select(F.col(id_col).cast("long").alias("item_id"), nonnull_text(text_col).alias("t"))
            .mapInArrow(lean(run), f"item_id long, {WINDOWS}, size int, parts int, free array<int>"))


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, run_words: int = RUN) -> DataFrame:
    """One row per document and leaked item: doc_id, h (hash of the text), item_id, matched, plain, needed.

    ``matched`` item windows lie in the document, ``plain`` of them word by word. Null texts,
    empty texts and items without a word match nothing. Repeated rows of a document count as one.
    Items are told apart by id: rows of one id are taken as one item. Other columns are not read.
    """
    spark = bounded_batches(docs.sparkSession)
    items = written(benchmark_windows(bench, item_col, item_text, window), "benchmark-windows")
    # Windows that a form has, not only those with enough words in them.
    least = F.least(F.max("parts") - F.max("size") + 1, F.lit(max(1, run_words - window + 1)))
    need = items.withColumn("form", F.col("kind")).groupBy("item_id", "form").agg(least.alias("form_needs"))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most `window` values
    # A bit filter of fixed size for the windows of the benchmark; what passes is joined exactly.
    shift = 64 - FILTER_BITS
    bit = F.shiftrightunsigned("h", shift)
    words = items.select(bit.alias("bit")).select(F.expr("bit DIV 64").alias("w"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT))").alias("b"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # at most 2^17 words
        table[r.w] = np.uint64(r.b & (2**64 - 1))
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            ids, marks, found = [], [], []
            names, hashes = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, texts in groups(b.column(2)):
                tok = Tokens(texts)
                for size in sizes:
                    for kind, at, h in tok.hashes(size):
                        k = h >> np.uint64(shift)
                        hit = np.nonzero((bits[(k >> np.uint64(6)).view(np.int64)] >> (k & np.uint64(63))) & np.uint64(1))[0]
                        for p, x in zip(at[hit].tolist(), h[hit].view(np.int64).tolist()):
                            if kind == 0 and size < SHORT and not tok.whole(p, size):
                                continue
                            text, words, part, word, slots = tok.window(kind, p, size)
                            ids.append(names[first + text])
                            marks.append(hashes[first + text])
                            found.append((x, kind, words, part, word, slots))
            rows = _rows(ids, found, "doc_id")
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(marks, pa.int64()), *rows.columns[1:]],
                                             names=["doc_id", "th", *rows.schema.names[1:]])

    text = nonnull_text(text_col)
    seen = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("t"))
            .mapInArrow(lean(run), "doc_id long, th long, " + WINDOWS))
    # Templates meet their own kind only: the places of one form are not those of another.
    item = items.select("item_id", "h", "kind", "words", F.col("at").alias("item_at"), F.col("word").alias("item_word"), "free",
                        F.col("slots").alias("item_slots"))
    hits = seen.join(item, ["h", "kind", "words"]).select("doc_id", "th", "item_id", "kind", "item_word", "free", (F.col("at") - F.col("item_at")).alias("lag"),
                                                         F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc")).alias("pairs"))
    hits = written(hits.distinct(), "benchmark-hits")
    # Slots of one alignment: an item value that stands for two document values breaks it.
    key = ["doc_id", "th", "item_id", "kind", "lag"]
    values = (hits.filter("kind > 0").select(*key, F.explode("pairs").alias("p"))
              .select(*key, F.substring("p.item", 1, 1).alias("type"), F.split(F.expr("substring(p.item, 2)"), " ").alias("i"),
                      F.split(F.expr("substring(p.doc, 2)"), " ").alias("d")).distinct())
    # Names of as many words stand for each other word by word; else the first word that differs stands for the rest.
    differs = "filter(sequence(0, least(size(i), size(d)) - 1), k -> i[k] != d[k])"
    both = F.expr(f"""CASE WHEN size(i) = size(d) THEN transform(i, (x, k) -> struct(x AS value, array(d[k]) AS as))
                      ELSE transform(array(coalesce(get({differs}, 0), 0)), k -> struct(i[k] AS value, slice(d, k + 1, size(d)) AS as)) END""")
    values = values.select(*key, "type", F.explode(both).alias("v")).select(*key, "type", "v.value", "v.as")
    common = F.expr("size(aggregate(slice(a, 2, size(a)), a[0], (x, y) -> array_intersect(x, y))) = 0")
    broken = (values.groupBy(*key, "type", "value").agg(F.collect_set("as").alias("a")).filter(common).select(*key).distinct()
              .withColumnsRenamed({k: f"b_{k}" for k in key}))
    on = [hits[k].eqNullSafe(broken[f"b_{k}"]) for k in key]
    sound = hits.join(broken, on[0] & on[1] & on[2] & on[3] & on[4], "left_anti").filter("kind > 0").unionByName(hits.filter("kind = 0"))
    of = lambda k: F.countDistinct(F.when((F.col("kind") == k) | F.array_contains("free", k), F.col("item_word")))
    per = sound.groupBy("doc_id", "th", "item_id").agg(
        F.countDistinct("item_word").alias("all"), F.countDistinct(F.when(F.col("kind") == 0, F.col("item_word"))).alias("plain"),
        of(1).alias("one"), of(2).alias("two"))
    forms = F.expr("explode(array(struct(0 AS form, all AS matched), struct(1 AS form, one AS matched), struct(2 AS form, two AS matched)))")
    per = per.select("doc_id", "th", "item_id", "plain", forms.alias("f")).select("doc_id", "th", "item_id", "plain", "f.*")
    need = need.withColumnsRenamed({"item_id": "need_id", "form": "need_form"})
    return (per.join(need, per["item_id"].eqNullSafe(need["need_id"]) & (per["form"] == need["need_form"])).filter("matched >= form_needs")
            .groupBy("doc_id", F.col("th").alias("h"), "item_id")
            .agg(F.max("matched").cast("long").alias("matched"), F.max("plain").alias("plain"), F.min("form_needs").cast("long").alias("needed")))


def without_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents, with all their columns, that leak no item."""
    bad = contaminated(docs, bench).select(F.col("doc_id").alias("bad_id"), F.col("h").alias("bad_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(nonnull_text(docs["text"])) == bad["bad_hash"]), "left_anti")
