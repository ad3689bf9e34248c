"""Language identification by string kernels: which n-grams two texts share decides how alike they are.

The blended-spectrum presence kernel counts the character n-grams of several lengths that both texts have, divided
by the geometric mean of their own numbers. A Nyström map through landmark texts turns it into a few
hundred features, on which one ridge regression per language is solved; scoring is two matrix products
per batch. n-grams are hashed into a fixed number of presence bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mistgrove.llm.common import pieces, stored

#: n-gram lengths, presence bits, landmark texts per language, training texts per language, ridge.
LENGTHS, BITS, LANDMARKS, SAMPLE, RIDGE = (1, 2, 3), 1 << 13, 24, 400, 1e-3
#: Bytes of the longest text to learn from, and texts of all languages together (at least two of each), so that the sample has a bound.
LONGEST, ALL = 100_000, 40_000
#: Documents per matrix product.
BLOCK = 512
#: Name of texts without a letter.
NONE = "und"


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters made one space, one at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    kinds = alphabetic()
    inside = kinds[np.minimum(points, len(kinds) - 1)]
    kept = np.where(inside, points, np.uint32(32))
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    return np.concatenate([[np.uint32(32)], kept[keep], [np.uint32(32)]]).astype(np.uint64)


_KINDS: list[np.ndarray] = []


def alphabetic() -> np.ndarray:
    """For each code point whether it is a letter; computed once a process."""
    if not _KINDS:
        _KINDS.append(np.array([chr(c).isalpha() for c in range(0x32000)], bool))
    return _KINDS[0]


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of BITS zeros and ones per text, scaled to length 1 (no letter: all 0), and which texts have letters."""
    rows = np.zeros((len(texts), BITS), np.float32)
    some = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        points = letters(text or "")
        if len(points) < 3:
            continue
        some[i] = True
        for n in LENGTHS:
            grams = points[: len(points) - n + 1].copy()
            for k in range(1, n):
                grams = grams * np.uint64(0x100000001B3) + points[k : len(points) - n + 1 + k]
            mixed = (grams + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            rows[i, (mixed >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = 1
    rows /= np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
    return rows, some


@dataclass
class Model:
    """Landmarks' presence rows, folded with the Nyström map and the regressions into one matrix per step."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def decide(self, rows: np.ndarray) -> np.ndarray:
        """One-versus-rest values, a column a language."""
        kernel = rows @ self.landmarks.T
        return kernel @ self.weights[:-1] + self.weights[-1]


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression in the Nyström space; the first texts of each language are its landmarks. No texts: no language."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((1, BITS), np.float32), np.zeros((2, 0), np.float32))
    rows, _ = presence(texts)
    told = np.array([names.index(x) for x in languages])
    chosen = np.concatenate([np.flatnonzero(told == k)[:landmarks] for k in range(len(names))])
    marks = rows[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > values[-1] * 1e-6
    root = vectors[:, kept] / np.sqrt(values[kept])  # the Nyström map: kernel with the landmarks times this
    features = (rows @ marks.T).astype(np.float64) @ root
    mean = features.mean(0)
    goal = np.where(told[:, None] == np.arange(len(names)), 1.0, -1.0)
    centred = features - mean
    solved = np.linalg.solve(centred.T @ centred + ridge * len(texts) * np.eye(centred.shape[1]), centred.T @ (goal - goal.mean(0)))
    weights = root @ solved
    return Model(names, marks, np.vstack([weights, goal.mean(0) - mean @ solved]).astype(np.float32))


def training_sample(docs: DataFrame, train: F.Column, key: str, text: str, lang: str, per_language: int = SAMPLE) -> tuple[list[str], list[str]]:
    """At most per_language different texts of each language, those of least text hash, in a fixed order.

    Null languages, texts that are null, without letters or above LONGEST bytes don't count; repeated rows and copies count once. Languages
    come from the data; every one gets its share. Each task keeps its least hashes before anything is exchanged; texts are read for the chosen alone.
    """
    usable = docs.where(train & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (F.octet_length(text) <= LONGEST)) \
        .select(F.col(lang).alias("lang"), F.xxhash64(F.lit("landmark"), F.col(text)).alias("order"), F.col(text).alias("text"))
    kinds = stored(usable.select("lang", "order").distinct(), "language-texts")
    languages = kinds.select("lang").distinct().count()
    most = max(2, min(per_language, ALL // max(languages, 1)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    chosen = kinds.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    rows = usable.join(F.broadcast(chosen), ["lang", "order"]).dropDuplicates(["lang", "order"]).collect()  # ALL, or two a language
    rows = sorted(rows, key=lambda r: (r["lang"], r["order"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, lang_pred, score, from the whole text.

    score is the softmax share (sharpness 4) of the chosen language's value, so it lies between 0 and 1. Null,
    empty and letterless texts, and all texts where no language was learned, are `und` with score 0. Ties go to the first language by name. Repeated rows give
    repeated rows; an empty table gives an empty result; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x BITS floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in pieces(batches, 1):
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                rows, some = presence([None if x is None else x.decode() for x in part.column(1).to_pylist()])
                values = known.decide(rows).astype(np.float64)
                if not known.languages:
                    values, some = np.zeros((len(rows), 1)), np.zeros(len(rows), bool)
                best = values.argmax(1)
                shares = np.exp(4 * (values - values.max(1, keepdims=True)))
                share = np.where(some, 1 / shares.sum(1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([known.languages[k] if ok else NONE for k, ok in zip(best, some, strict=True)], pa.string()),
                     pa.array(share, pa.float64())], names=["key", "lang_pred", "score"])

    read = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return read.mapInArrow(score, "key long, lang_pred string, score double").withColumnRenamed("key", key)
