"""Substring dedup by hashing lines.

A line is cut into sentences; a unit is a line or the least run of its sentences with
``UNIT_WORDS`` words, so that a passage set in the middle of a line has units of its own.
Units are normalised (lower case, single spaces) and hashed; equal digests are grouped
globally and the occurrence with the lowest rank, by doc_id and place, stays. Others that
stand together for ``SEED_WORDS`` words or more are where a passage may be; it is removed if
its words, as far as they agree on both sides with the place that stays, are ``MIN_WORDS``
or more. Spans are offsets into the text as it was.

A passage may begin and end inside sentences, or have no sentence end. So a text is also cut
into chunks at words that its content alone tells: a cut is where the hash of ``CONTEXT`` words
is the least of ``REACH`` hashes in a row. Two cuts are at most ``REACH`` words apart, and cuts
inside a passage are the same wherever it stands, whatever the spaces between its words; a
passage of 51 words holds whole chunks of 51 - (CONTEXT - 1) - 2 (REACH - 1) - MORE words at
least, 21. A chunk's digest covers ``MORE`` words behind it, so that no chunk is a word or two.
Spans of both ways that overlap are one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import bounded_batches, lean, nonnull_text, worker_state, written

UNIT_WORDS = 5
MIN_WORDS, SEED_WORDS = 50, 20
FILTER_BITS = 23
CONTEXT, REACH, MORE = 3, 13, 4
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+[\"'”’)\]]*\s*|[^.!?\n]+")


def unit_columns(text: str, unit_words: int = UNIT_WORDS) -> tuple[list[int], list[int], list[int], list[str]]:
    """Starts, ends, words and normalised texts of units. Sentences follow each other without a gap, so a unit begins where the last one ended."""
    ends, words, normal, held, end = [], [], [], [], 0
    for s in SENTENCE.findall(text):
        end += len(s)
        held = held + s.split() if held else s.split()
        if held and (len(held) >= unit_words or "\n" in s):
            ends.append(end)
            words.append(len(held))
            normal.append(" ".join(held).lower())
            held = []
    if held:
        ends.append(end)
        words.append(len(held))
        normal.append(" ".join(held).lower())
    return [0, *ends[:-1]] if ends else [], ends, words, normal


def units(text: str, unit_words: int = UNIT_WORDS) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normalised): a unit ends with a sentence once it has enough words, or with its line."""
    return list(zip(*unit_columns(text, unit_words)))


def _spaces() -> np.ndarray:
    return np.fromiter((chr(i).isspace() for i in range(0x110000)), bool, 0x110000)


def _sliding(of: np.ufunc, h: np.ndarray) -> np.ndarray:
    """The minimum or maximum of each ``REACH`` values in a row, of windows that double."""
    size = 1
    while 2 * size <= REACH:
        h = of(h[:-size], h[size:])
        size *= 2
    return of(h[:len(h) - REACH + size], h[REACH - size:]) if size < REACH else h


def chunk_columns(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Starts, ends, words and normalised texts of chunks."""
    word = text.lower().split()
    n = len(word) - CONTEXT + 1
    if n < REACH:
        none = np.zeros(0, np.int64)
        return none, none, none, []
    code = np.frombuffer(b"".join(map(xxhash.xxh64_digest, word)), ">u8").astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(CONTEXT):
        h = (h ^ code[k:k + n]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    least = _sliding(np.minimum, h)
    # A window's least hash is no larger than any in it, so only the largest of the windows of a place can be its own.
    pad = np.zeros(len(least) + 2 * (REACH - 1), np.uint64)
    pad[REACH - 1:n] = least
    most = _sliding(np.maximum, pad)
    cuts = np.nonzero(most == h)[0]
    value = h[cuts]
    if (value[1:] == value[:-1]).any():
        # In a run of the same words a cut each REACH words is enough.
        kept = []
        for c, v in zip(cuts.tolist(), value.tolist()):
            if not kept or v != kept[-1][1] or c - kept[-1][0] >= REACH:
                kept.append((c, v))
        cuts = np.array([c for c, _ in kept])
    gap = worker_state("spaces", _spaces)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    first = ~gap
    first[1:] &= gap[:-1]
    # A chunk without all the words behind it is left out; only the last ones can be.
    cuts = cuts[:np.searchsorted(cuts, len(word) - MORE, side="right")]
    at, place = np.nonzero(first)[0][cuts], cuts.tolist()
    return at[:-1], at[1:], np.diff(cuts), [" ".join(word[a:b + MORE]) for a, b in zip(place, place[1:])]


def chunks(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normalised with the words behind): runs of words between cuts that content decides."""
    start, end, words, normal = chunk_columns(text)
    return list(zip(start.tolist(), end.tolist(), words.tolist(), normal))


def unit_table(docs: DataFrame, unit_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (hash of the text), way (0 sentences, 1 chunks), unit, start, end, words, h1, h2 (a digest of 128 bits)."""
    bounded_batches(docs.sparkSession)
    types = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("way", pa.int8()), ("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                       ("words", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = [t.as_py() for t in b.column(2)]
            for way, cut in enumerate((lambda t: unit_columns(t, unit_words), chunk_columns)):
                digest = partial(xxhash.xxh3_128_digest, seed=way)
                size, raw, spans = [], [], ([], [], [])
                for t in texts:
                    *columns, normal = cut(t)
                    size.append(len(normal))
                    raw += map(digest, normal)
                    for held, c in zip(spans, columns):
                        held.append(c)
                size = np.array(size, np.int64)
                h = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
                row = np.repeat(np.arange(len(size)), size)
                unit = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                take = pa.array(row, pa.int64())
                at = [np.fromiter(chain.from_iterable(c), np.int32, len(row)) if way == 0 else np.concatenate(c).astype(np.int32) for c in spans]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(row), way, np.int8)), pa.array(unit.astype(np.int32)), *map(pa.array, at),
                     pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))], schema=types)

    text = nonnull_text(text_col)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("t"))
            .mapInArrow(run, "doc_id long, th long, way byte, unit int, start int, end int, words int, h1 long, h2 long"))


def words_beside(text: str, places: list[tuple[int, int]], count: int) -> Iterator[tuple[list[str], list[int]]]:
    """For each (place, side): up to ``count`` words before (side 0) or behind (1) it, nearest first and in lower case, and their far ends."""
    at = [m.span() for m in re.finditer(r"\S+", text)]
    starts = [a for a, _ in at]
    for pos, side in places:
        i = bisect_left(starts, pos)
        # A place inside a word parts it.
        parted = i > 0 and at[i - 1][1] > pos
        if side:
            near = ([(pos, at[i - 1][1])] if parted else []) + at[i:i + count]
        else:
            near = ([(starts[i - 1], pos)] if parted else []) + at[max(0, i - parted - count):i - parted][::-1]
        near = near[:count]
        yield [text[a:b].lower() for a, b in near], [b if side else a for a, b in near]


def contexts(docs: DataFrame, places: DataFrame, count: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th, pos, side, near (words), ends: the words beside each place (doc_id, th, pos, side).

    Only texts that a place names are shuffled, but for those that a bit filter of fixed size lets through by chance: it is
    broadcast as at most 2^17 rows, and lets more through the more documents have places.
    """
    spark = bounded_batches(docs.sparkSession)

    def bits(df: DataFrame) -> DataFrame:
        bit = F.shiftrightunsigned(F.xxhash64("doc_id", "th"), 64 - FILTER_BITS)
        return df.withColumn("bit", bit).withColumn("w", F.expr("bit DIV 64")).withColumn("b", F.expr("shiftleft(1L, CAST(bit % 64 AS INT))"))

    table = bits(places).groupBy("w").agg(F.bit_or("b").alias("set"))
    text = nonnull_text(text_col)
    named = (bits(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("t")))
             .join(F.broadcast(table), "w").filter(F.col("set").bitwiseAND(F.col("b")) != 0).select("doc_id", "th", "t"))
    # The places of one text, no more than its units.
    per = places.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.collect_set(F.struct("pos", "side")).alias("l"))
    j = named.join(per, named["doc_id"].eqNullSafe(per["d"]) & (named["th"] == per["h"])).select("doc_id", "th", "t", "l")
    types = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("side", pa.int32()), ("near", pa.list_(pa.string())),
                       ("ends", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at = [(x["pos"], x["side"]) for x in b.column(3)[i].as_py()]
                near, ends = zip(*words_beside(b.column(2)[i].as_py(), at, count))
                same = pa.array([i] * len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(same), b.column(1).take(same), pa.array([p for p, _ in at], pa.int32()),
                                                  pa.array([s for _, s in at], pa.int32()), pa.array(near, types[4].type), pa.array(ends, types[5].type)], schema=types)

    # Repeated rows of a document have the same words.
    out = j.mapInArrow(lean(run), "doc_id long, th long, pos int, side int, near array<string>, ends array<int>")
    return out.dropDuplicates(["doc_id", "th", "pos", "side"])


def true_ends(docs: DataFrame, short: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """The spans of ``short`` with the words on both sides that agree with the places that stay.

    Before the first unit up to ``min_words`` words are compared; from the start of the last unit, which is shorter than
    that, twice as many.
    """
    def edge(side: int, unit: str):
        return F.struct(F.lit(side).alias("side"), F.col(f"{unit}.start").alias("pos"), F.col(f"{unit}.first.doc_id").alias("kdoc"),
                        F.col(f"{unit}.first.th").alias("kth"), F.col(f"{unit}.first.start").alias("kpos"))

    span = ["doc_id", "th", "way", "start", "end", "n_units", "n_words", "kept_doc_id", F.col("r.words").alias("last")]
    edges = short.select(*span, F.inline(F.array(edge(0, "l"), edge(1, "r"))))
    places = edges.select("doc_id", "th", "pos", "side").union(edges.select("kdoc", "kth", "kpos", "side")).distinct()
    near = written(contexts(docs, written(places, "passage-edges"), 2 * min_words, id_col, text_col), "passage-contexts")
    here = near.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("pos").alias("p"), F.col("side").alias("s"), "near", "ends")
    there = near.select(F.col("doc_id").alias("kd"), F.col("th").alias("kh"), F.col("pos").alias("kp"), F.col("side").alias("ks"), F.col("near").alias("kept_near"))
    j = (edges.join(here, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("pos") == F.col("p")) & (F.col("side") == F.col("s")))
         .join(there, F.col("kdoc").eqNullSafe(F.col("kd")) & (F.col("kth") == F.col("kh")) & (F.col("kpos") == F.col("kp")) & (F.col("side") == F.col("ks"))))
    same = F.zip_with("near", "kept_near", lambda a, b: F.coalesce(a == b, F.lit(False)))
    other = F.array_position(same, False).cast("int")
    j = j.withColumn("agree", F.when(other == 0, F.size(same)).otherwise(other - 1))
    far = F.when(F.col("agree") > 0, F.get("ends", F.col("agree") - 1))
    before, behind = (F.max(F.when(F.col("side") == k, F.col("agree"))) for k in (0, 1))
    grown = j.groupBy("doc_id", "th", "way", "start", "end", "n_units", "n_words", "kept_doc_id", "last").agg(
        before.alias("before"), behind.alias("behind"), F.min(F.when(F.col("side") == 0, far)).alias("from"), F.max(F.when(F.col("side") == 1, far)).alias("to"))
    return grown.select("doc_id", "th", "way", F.least("start", "from").alias("start"), F.greatest("end", "to").alias("end"), "n_units",
                        (F.col("n_words") + F.col("before") + F.greatest(F.col("behind") - F.col("last"), F.lit(0))).alias("n_words"), "kept_doc_id")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, unit_words: int = UNIT_WORDS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Spans to remove: doc_id, th (hash of the text), start, end, n_units, n_words, kept_doc_id.

    Ranks are doc_id (null last), text and place; ``kept_doc_id`` is where the span's first unit
    stays. Units that stand together for ``SEED_WORDS`` words (``min_words``, if fewer) are a span if they hold ``min_words`` words, or come to
    as many with the words beside them that agree with the place where the first (before) and the last unit (behind) stay.
    Repeats of sentences inside a document count too; of chunks those of other documents.
    Repeated rows of a document are one document: its spans come once and hold for each. Null and empty texts have no units. Other columns are
    not read.
    """
    table = unit_table(docs, unit_words, id_col, text_col)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "start")
    # Partial minima come before the shuffle: a unit that stands everywhere is one row per task.
    # Written, so that the join below has plain exchanges on both sides and a hot digest can be split.
    first = written(table.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "first"),
                    "repeated-units")
    # Chunks that a document repeats of itself stay: a run of one word is no passage from elsewhere.
    own = (F.col("way") == 1) & F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th"))
    again = table.join(first, ["h1", "h2"]).filter(~(rank.eqNullSafe(F.col("first"))) & ~own).select(
        "doc_id", "th", "way", "unit", "start", "end", "words", "first").distinct()
    # Units next to each other make one span. A document's own units only, so one row's text bounds a group.
    w = Window.partitionBy("doc_id", "th", "way").orderBy("unit")
    runs = again.withColumn("run", F.col("unit") - F.row_number().over(w))
    found = written(runs.groupBy("doc_id", "th", "way", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("words").alias("n_words"),
        F.min_by(F.struct("start", "first"), "unit").alias("l"), F.max_by(F.struct("start", "words", "first"), "unit").alias("r"))
        .filter(F.col("n_words") >= min(min_words, SEED_WORDS)).drop("run").withColumn("kept_doc_id", F.col("l.first.doc_id")), "passage-spans")
    grown = true_ends(docs, found.filter(F.col("n_words") < min_words), min_words, id_col, text_col)
    spans = found.filter(F.col("n_words") >= min_words).select(*grown.columns).unionByName(grown.filter(F.col("n_words") >= min_words))
    # Spans of both ways that overlap are one; its units and words are those of the way that has more words in it.
    order = Window.partitionBy("doc_id", "th").orderBy("start", "end", "way")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1))
    joined = spans.withColumn("new", new).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    per_way = joined.groupBy("doc_id", "th", "span", "way").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_units").alias("n_units"), F.sum("n_words").alias("n_words"),
        F.min_by("kept_doc_id", "start").alias("kept_doc_id"))
    more = F.max(F.struct("n_words", "n_units")).alias("m")
    return (per_way.groupBy("doc_id", "th", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), more,
                                                        F.min_by("kept_doc_id", F.struct("start", "way")).alias("kept_doc_id"))
            .select("doc_id", "th", "start", "end", "m.n_units", "m.n_words", "kept_doc_id"))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All rows and columns of docs with ``clean_text`` (text without its spans) and ``removed`` (their offsets)."""
    text = nonnull_text(docs["text"])
    per = spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("span_list")).select(
        F.col("doc_id").alias("span_id"), F.col("th").alias("span_hash"), "span_list")
    j = docs.join(per, docs["doc_id"].eqNullSafe(per["span_id"]) & (F.xxhash64(text) == per["span_hash"]), "left")
    spans_of = per["span_list"]

    def piece(i):
        begin = F.coalesce(F.get(spans_of, i - 1)["end"], F.lit(0))
        return F.substr(docs["text"], begin + 1, F.coalesce(F.get(spans_of, i)["start"], F.length(docs["text"])) - begin)

    # What stands between the spans, joined once.
    clean = F.when(spans_of.isNull(), docs["text"]).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans_of)), piece), ""))
    return j.select(*[docs[c] for c in docs.columns], clean.alias("clean_text"), per["span_list"].alias("removed"))
