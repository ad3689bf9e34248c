"""Toxicity by subword bags: a word is the mean of its character n-grams' vectors, a text the mean of its words.

Vectors and a linear softmax are trained together in numpy. As everything up to the softmax is a mean,
a trained word adds one number to its text's score; words never seen share n-grams with those that were.
Long texts dilute a few toxic words, so a text is read in overlapping windows and has the score of its worst one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mistgrove.llm.common import fresh, pieces, stored

#: n-gram lengths (words are padded by < and >), hash buckets, vector size.
LENGTHS, BUCKETS, SIZE = (3, 4, 5, 6), 1 << 17, 4
#: Documents per class to learn from, words of a window and between windows.
SAMPLE, WINDOW, STRIDE = 2000, 8, 4
#: Spread of the random start.
START = 0.1
#: Bytes of the longest text to learn from, so that the sample has a bound.
LONGEST = 100_000
#: Words whose scores a task keeps before it starts anew.
HELD = 200_000


def words(text: str) -> list[str]:
    return text.lower().split()


def grams(found: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """n-gram buckets of all words one after the other, and where each word starts; every word has at least one."""
    parts = [some_grams(found[i : i + step]) for i in range(0, len(found), step)]
    shifts = np.cumsum([0] + [len(b) for b, _ in parts])
    return np.concatenate([b for b, _ in parts]), np.concatenate([s + shift for (_, s), shift in zip(parts, shifts, strict=False)])


def some_grams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for a few words, by one array of their padded UTF-8 bytes."""
    padded = [b"<" + w.encode("utf-8", "replace") + b">" for w in found]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    data = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint64)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes left in the word from here
    owner = np.repeat(np.arange(len(padded), dtype=np.int32), sizes)
    kinds, owners = [], []
    for n in LENGTHS:
        whole = (room == sizes[owner]) & (sizes[owner] < n) if n == LENGTHS[0] else False  # a word too short for any n-gram
        at = np.flatnonzero((room >= n) | whole)
        hashed = np.full(len(at), n, np.uint64)
        for k in range(n):
            hashed = hashed * np.uint64(0x100000001B3) + data[np.minimum(at + k, len(data) - 1)]
        kinds.append(((hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
        owners.append(owner[at])
    buckets, owned = np.concatenate(kinds), np.concatenate(owners)
    order = np.argsort(owned, kind="stable")
    return buckets[order], np.searchsorted(owned[order], np.arange(len(padded)))


@dataclass
class Model:
    """vectors: a row a bucket; head: weights of the two classes; bias."""

    vectors: np.ndarray
    head: np.ndarray
    bias: np.ndarray

    def word_scores(self, found: list[str]) -> np.ndarray:
        """What each word adds, averaged over a window's words, to the log odds of toxic."""
        if not found:
            return np.zeros(0)
        buckets, starts = grams(found)
        odds = self.vectors @ (self.head[1] - self.head[0])
        sums = np.add.reduceat(odds[buckets], starts)
        return sums / np.diff(np.append(starts, len(buckets)))


def window_starts(n: int) -> np.ndarray:
    """Where the windows of a text of n words begin; the last one reaches its end."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


class Bags:
    """Texts as word numbers, their windows, and the words' n-gram buckets."""

    def __init__(self, texts: list[str]):
        bags = [words(t) or ["<empty>"] for t in texts]
        vocabulary = {w: i for i, w in enumerate(sorted({w for b in bags for w in b}))}
        self.buckets, self.starts = grams(list(vocabulary))
        self.per_word = np.diff(np.append(self.starts, len(self.buckets)))
        self.lengths = np.array([len(b) for b in bags])
        self.ids = np.fromiter((vocabulary[w] for b in bags for w in b), np.int64, self.lengths.sum())
        self.first = np.cumsum(self.lengths) - self.lengths
        windows = [window_starts(n) for n in self.lengths]
        self.owner = np.repeat(np.arange(len(bags)), [len(w) for w in windows])
        self.begins = np.concatenate([w + f for w, f in zip(windows, self.first, strict=True)])
        self.ends = np.minimum(self.begins + WINDOW, (self.first + self.lengths)[self.owner])

    def parts(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The buckets of the given words, where each word's begin, and how many it has."""
        spans = self.per_word[used]
        heads = np.cumsum(spans) - spans
        return self.buckets[np.arange(spans.sum()) + np.repeat(self.starts[used] - heads, spans)], heads, spans

    def worst(self, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's window of the largest mean, as begin, end and that mean, given the buckets' odds."""
        summed = np.concatenate([[0.0], np.cumsum((np.add.reduceat(odds[self.buckets], self.starts) / self.per_word)[self.ids])])
        value = (summed[self.ends] - summed[self.begins]) / (self.ends - self.begins)
        order = np.lexsort((value, self.owner))
        at = order[np.append(self.owner[order][1:] != self.owner[order][:-1], True)]
        return self.begins[at], self.ends[at], value[at]

    def log_odds(self, toxic: np.ndarray, prior: float = 5.0) -> np.ndarray:
        """Per bucket the log ratio of the shares of toxic and other texts that hold it, drawn to 0 by a prior count."""
        held = np.zeros((2, BUCKETS))
        for i, kind in enumerate(toxic):
            used = np.unique(self.ids[self.first[i] : self.first[i] + self.lengths[i]])
            held[kind, np.unique(self.parts(used)[0])] += 1
        texts = np.maximum(np.bincount(toxic, minlength=2), 1)
        share = held / texts[:, None] + prior / texts.min()
        return np.log(share[1] / share[0])


def balance(told: np.ndarray) -> np.ndarray:
    """Weights that give both classes half of the loss."""
    return np.where(told == 1, 0.5 / max(1, told.sum()), 0.5 / max(1, (1 - told).sum()))


def softmax(logits: np.ndarray) -> np.ndarray:
    shares = np.exp(logits - logits.max(1, keepdims=True))
    return shares / shares.sum(1, keepdims=True)


def fit(texts: list[str], toxic: list[int], rounds: int = 40, rate: float = 0.5, seed: int = 1) -> Model:
    """Train vectors and softmax together on every text's worst window so far.

    Vectors and softmax start at random, drawn along one direction by the n-grams' log odds; a bag is the average of a window's words. A round steps against the gradient of the mean
    log loss, classes weighed equally, scaled so that its largest entry is `rate`, which falls to zero: what
    many texts agree on moves first. Every fourth text of a class is held back for the softmax's scale and bias alone, since
    vectors fit their own texts too well to say what a score is worth. Without texts of both classes every score is 0.5.
    """
    told = np.array(toxic, np.int64)
    if not (0 < told.sum() < len(told)):  # nothing to tell apart
        return Model(np.zeros((BUCKETS, SIZE)), np.zeros((2, SIZE)), np.zeros(2))
    nth = np.where(told == 1, np.cumsum(told), np.cumsum(1 - told))  # within the class
    aside = nth % 4 == 0
    bags, kinds = Bags([t for t, a in zip(texts, aside, strict=True) if not a]), told[~aside]
    weight = balance(kinds)
    random = np.random.default_rng(seed)
    direction = random.normal(0, 1, SIZE)
    direction /= np.linalg.norm(direction)
    head, bias = np.stack([-direction / 2, direction / 2]) + random.normal(0, START, (2, SIZE)), np.zeros(2)
    vectors = random.normal(0, START, (BUCKETS, SIZE)) + bags.log_odds(kinds)[:, None] * direction
    for step in range(rounds):
        lo, hi, value = bags.worst(vectors @ (head[1] - head[0]))
        if not step:
            bias = np.array([1.0, -1.0]) * np.median(value) / 2
        sizes = hi - lo
        doc_of = np.repeat(np.arange(len(sizes)), sizes)
        chosen = bags.ids[np.arange(sizes.sum()) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)]
        used, local = np.unique(chosen, return_inverse=True)
        parts, heads, spans = bags.parts(used)
        word_vectors = np.add.reduceat(vectors[parts], heads) / spans[:, None]
        bag = np.stack([np.bincount(doc_of, word_vectors[local, k], len(sizes)) for k in range(SIZE)], 1) / sizes[:, None]
        error = (softmax(bag @ head.T + bias) - (kinds[:, None] == np.arange(2))) * weight[:, None]
        to_bag = error @ head / sizes[:, None]
        to_word = np.stack([np.bincount(local, to_bag[doc_of, k], len(used)) for k in range(SIZE)], 1) / spans[:, None]
        slope = np.stack([np.bincount(parts, np.repeat(to_word[:, k], spans), BUCKETS) for k in range(SIZE)], 1)
        pace = rate * (1 - step / rounds)
        vectors -= slope * (pace / max(np.abs(slope).max(), 1e-300))
        head -= pace * error.T @ bag
        bias -= pace * error.sum(0)
    if aside.any():
        others = Bags([t for t, a in zip(texts, aside, strict=True) if a])
        value, kinds = others.worst(vectors @ (head[1] - head[0]))[2], told[aside]
        scale, offset = calibrate(value, kinds)
        head, bias = head * scale, np.array([-offset, offset]) / 2
    return Model(vectors, head, bias)


def calibrate(value: np.ndarray, kinds: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Scale and offset of the log odds by Newton steps on the weighted log loss of the held-back texts."""
    spread = max(value.std(), 1e-9)
    x = np.stack([(value - value.mean()) / spread, np.ones_like(value)], 1)
    weight, w = balance(kinds), np.zeros(2)
    for _ in range(50):
        share = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (share - kinds)) + ridge * w
        w -= np.linalg.solve((x * (weight * share * (1 - share))[:, None]).T @ x + ridge * np.eye(2), slope)
    return w[0] / spread, w[1] - w[0] * value.mean() / spread


def training_sample(docs: DataFrame, labels: DataFrame, train: Column, key: str, text: str, label: str, per_class: int = SAMPLE) -> tuple[list[str], list[int]]:
    """At most per_class different texts of each class, those of least text hash, in a fixed order.

    Rows without a label or text, and texts above LONGEST bytes, don't count. Copies count once: of repeated
    texts the larger label holds. Only keys and hashes are joined; texts are read for the chosen alone.
    """
    told = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("label"))
    usable = docs.where(train & F.col(text).isNotNull() & (F.octet_length(text) <= LONGEST)) \
        .select(F.col(key).alias("key"), F.xxhash64(text).alias("order"), F.col(text).alias("text"))
    kinds = stored(usable.select("key", "order").join(told, "key").groupBy("order").agg(F.max("label").alias("label"), F.min("key").alias("key")), "sample")
    chosen = [kinds.where(F.col("label") == kind).orderBy("order").limit(per_class) for kind in (0, 1)]
    rows = usable.join(F.broadcast(chosen[0].union(chosen[1])), ["key", "order"]).dropDuplicates(["order"]).collect()  # 2 * per_class at most
    rows = sorted(rows, key=lambda r: r["order"])
    return [r["text"] for r in rows], [r["label"] for r in rows]


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
                name: str = "score") -> DataFrame:
    """One row per document: key and the columns in keep, with (named by name) its score: the softmax share of toxic in the worst window.

    Whole texts are read, in windows, a batch of about 8 MB at a time. Null and empty texts score as a window that adds
    nothing. Repeated rows give repeated rows; an empty table gives an empty result. A task remembers the scores of
    at most HELD words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x SIZE floats
    others = [c for c in keep if c != key]
    text_name, score_name = fresh([key, *others], "_text"), fresh([key, *others], "_score")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, remembered = shared.value, {}
        bias = known.bias[1] - known.bias[0]
        for batch in pieces(batches, 0):
            bags = [words(x.decode()) if x else [] for x in batch.column(0).to_pylist()]
            if len(remembered) > HELD:
                remembered.clear()
            new = list({w for b in bags for w in b if w not in remembered})
            remembered.update(zip(new, known.word_scores(new).tolist(), strict=True))
            values = []
            for bag in bags:
                summed = np.concatenate([[0.0], np.cumsum([remembered[w] for w in bag])])
                begins = window_starts(len(bag))
                ends = np.minimum(begins + WINDOW, len(bag))
                values.append(((summed[ends] - summed[begins]) / np.maximum(ends - begins, 1)).max() + bias)
            odds = np.clip(np.array(values, np.float64), -500, 500)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(1 / (1 + np.exp(-odds)), pa.float64())],
                                             names=[*batch.schema.names[1:], score_name])

    read = docs.select(F.col(text).cast("binary").alias(text_name), F.col(key), *others)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[1:])
    return read.mapInArrow(score, f"{fields}, `{score_name}` double").withColumnRenamed(score_name, name)
