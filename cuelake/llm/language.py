"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed letter n-grams, of length one. Each language is
described by several centroids (spherical k-means over its sample); a text takes the language
of the centroid with the largest cosine. Cosines grow with the length of a text, so each
language has a limit for each class of lengths (powers of two of letters): ``REJECT_SHARE`` of
the cosine that all but ``REJECT_TAIL`` of its sample reach there. Beginnings of the sample's
texts stand for shorter ones. A text below the limit of its language is rejected.

The classifier is fitted on at most ``SAMPLE`` rows per language, whole texts, chosen by a
hash; every row is then classified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import bounded_batches, lean, partitions, worker_state

SAMPLE = 300
DIM = 1 << 14
GRAMS = (1, 2, 3)
CENTROIDS = 4
MAX_LANGUAGES = 256
REJECT_SHARE = 0.35
REJECT_TAIL = 0.05
CLASSES = 24
LEAST_ROWS = 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams over the lowered letters, runs of anything else as one gap."""
    letter = worker_state("letters", _letters)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    c = np.where(letter[np.minimum(c, 0x10FFFF)], c, 32)
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]].astype(np.uint64)
    out, key = np.zeros(DIM, np.int64), np.zeros(len(c), np.uint64)
    for n in GRAMS:
        key = key[:len(c) - n + 1] * np.uint64(0x110000) + c[n - 1:] if n > 1 else c
        h = ((key + np.uint64(n)) * SPREAD) >> np.uint64(64 - 14)
        out += np.bincount(h.astype(np.int64), minlength=DIM)
    return out


def length_class(c: np.ndarray) -> int:
    """Class of a text by its n-gram counts: the power of two of its letters."""
    return min(CLASSES - 1, (int(c.sum()) // len(GRAMS)).bit_length())


def beginnings(text: str) -> list[str]:
    """Shorter texts from a text: its first 25, 50, 100, ... characters."""
    return [text[:25 << i] for i in range(CLASSES) if 25 << i < 0.8 * len(text)]


class Centroids:
    """languages, idf, one matrix of centroids with their language, and the least cosine allowed per language and length class."""

    def __init__(self, languages: list[str], idf: np.ndarray, matrix: np.ndarray, owner: np.ndarray, least: np.ndarray):
        self.languages, self.idf, self.matrix, self.owner, self.least = languages, idf, matrix, owner, least

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """language, cosine, rejected. A text without any letter (or null) is ``und``, 0, rejected."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        c = counts(text)
        cos = self.matrix @ _unit(c, self.idf)
        k = int(np.argmax(cos))
        s = float(min(1.0, max(0.0, cos[k])))
        return self.languages[self.owner[k]], s, bool(s < self.least[self.owner[k], length_class(c)])


def _unit(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(c) * idf).astype(np.float32)
    n = np.linalg.norm(v)
    return v / n if n else v


def _limits(cosines: list[list[float]]) -> list[float]:
    """Least cosine of each length class; classes with few rows take the limit of the next shorter class with enough, or else of the next longer."""
    enough = min(LEAST_ROWS, max(map(len, cosines)))
    own = [REJECT_SHARE * float(np.quantile(x, REJECT_TAIL)) if len(x) >= enough else None for x in cosines]
    last = next(x for x in own if x is not None)
    return [last := last if x is None else x for x in own]


def _dense(at: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros(DIM, np.int64)
    out[at] = c
    return out


def _order(at: np.ndarray, c: np.ndarray) -> bytes:
    """Sorts counts like the bytes of the dense array, which is many times as large."""
    key = np.empty(len(at), [("at", ">u2"), ("c", "<u4")])
    key["at"], key["c"] = DIM - at.astype(np.int64), c
    return key.tobytes()


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], shorter: Iterable[tuple[str, np.ndarray, np.ndarray]] = (), k: int = CENTROIDS,
        rounds: int = 8) -> Centroids:
    """Centroids of (language, n-grams, their counts) rows; the same rows in any order give the same model.

    ``shorter`` are rows of the same kind from beginnings of the texts; they tell the limits only.
    Rows are dense for one language at a time, as vectors of single precision.
    """
    samples = sorted(samples, key=lambda x: (x[0], _order(x[1], x[2])))
    languages = sorted({s[0] for s in samples})
    df = np.zeros(DIM)
    for _, at, _ in samples:
        df[at] += 1
    idf = np.log((1 + len(samples)) / (1 + df)) + 1
    rows, owner, seen = [], [], {}
    for n, lang in enumerate(languages):
        own = [s[1:] for s in samples if s[0] == lang]
        x = np.empty((len(own), DIM), np.float32)
        for i, s in enumerate(own):
            x[i] = _unit(_dense(*s), idf)
        start = [0]  # far from each other, from the mean outwards
        start[0] = int(np.argmax(x @ x.mean(axis=0)))
        while len(start) < min(k, len(x)):
            start.append(int(np.argmin((x @ x[start].T).max(axis=1))))
        c = x[start]
        for _ in range(rounds):
            near = np.argmax(x @ c.T, axis=1)
            c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        seen[lang] = [[] for _ in range(CLASSES)]
        for (_, count), cos in zip(own, (x @ c.T).max(axis=1).tolist()):
            seen[lang][length_class(count)].append(cos)
        rows.append(c)
        owner += [n] * len(c)
        del x
    matrix = np.concatenate(rows).astype(np.float32) if rows else np.zeros((0, DIM), np.float32)
    owner = np.array(owner, int)
    for lang, at, c in shorter:
        seen[lang][length_class(c)].append(float((matrix[owner == languages.index(lang)] @ _unit(_dense(at, c), idf)).max()))
    return Centroids(languages, idf, matrix, owner, np.array([_limits(seen[x]) for x in languages]).reshape(-1, CLASSES))


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Centroids:
    """Fit on at most ``sample`` rows of each language: the first by a hash of the id, whole texts.

    Rows with null text, null language or no letter teach nothing. No more than MAX_LANGUAGES.
    """
    spark = bounded_batches(docs.sparkSession)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("d"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    # Counted first: what follows broadcasts and collects so much per language.
    if known.select("l").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # A row limit per group is applied before each shuffle too. The limit holds per task, per salt
    # of tasks, then per language: with n tasks about sqrt(n) * sample short rows meet, not n * sample.
    salt = F.spark_partition_id() % max(1, isqrt(partitions(spark)))
    salted = Window.partitionBy("l", "salt").orderBy(F.xxhash64("d"), "d")
    first = Window.partitionBy("l").orderBy(F.xxhash64("d"), "d")
    some = known.select("d", "l", salt.alias("salt")).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= sample)
    ids = some.select("d", "l").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= sample).select("d", "l").distinct()
    again = Window.partitionBy("l").orderBy(F.xxhash64("d"), "d", F.xxhash64("t"))
    rows = (known.join(F.broadcast(ids), ["d", "l"], "left_semi").withColumn("r", F.row_number().over(again))
            .filter(F.col("r") <= sample).select("l", "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for whole, x in ((True, t), *((False, y) for y in beginnings(t))):
                    if has_letter(x):
                        c = counts(x)
                        at = np.nonzero(c)[0]
                        out.append((lang, whole, at.astype(np.uint16).tobytes(), c[at].astype(np.uint32).tobytes()))
            kinds = (pa.string(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["l", "whole", "at", "c"])

    # Bounded: sample * languages, and the beginnings of a text are about twice as long as it at most, together.
    got = rows.mapInArrow(lean(run), "l string, whole boolean, at binary, c binary").collect()

    def sparse(r) -> tuple[str, np.ndarray, np.ndarray]:
        return r.l, np.frombuffer(r.at, np.uint16), np.frombuffer(r.c, np.uint32)

    return fit([sparse(r) for r in got if r.whole], (sparse(r) for r in got if not r.whole))


def classify(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """All columns of docs and lang_pred, score, rejected; input columns of these names are replaced.

    Null text and text without a letter: ``und``, score 0, rejected. Repeated rows are judged
    alike; an untrained model answers ``und`` throughout.
    """
    spark = bounded_batches(docs.sparkSession)
    # At most MAX_LANGUAGES * CENTROIDS vectors, as plain arrays.
    shared = spark.sparkContext.broadcast((model.languages, model.idf, model.matrix, model.owner, model.least))

    @F.pandas_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def judge(texts):
        import pandas as pd

        m = Centroids(*shared.value)
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    judged = docs.withColumn("_judged", judge(F.col(text_col)))
    return judged.withColumns({n: F.col(f"_judged.{n}") for n in ("lang_pred", "score", "rejected")}).drop("_judged")


def in_fold(id_col: Column, fold: int = 2, folds: int = 4) -> Column:
    """Is the row in this fold, by the checksum of its id?"""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))
