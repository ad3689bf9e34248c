"""Bigram language model over the corpus itself: counted, smoothed and queried shard by shard as Elias-Fano tries.

P(w | v) = (c(v w) + M P(w)) / (c(v) + M), with P(w) = (c(w) + 1) / (N + V + 1). Its logarithm is that of P(w), plus
log(M / (c(v) + M)), plus log(1 + c(v w) / (M P(w))), which is 0 for unseen pairs. So a document adds up its words'
own part, and every shard of word pairs adds what its trie knows. All words and all pairs count: the most frequent words
have numbers and counts in a table sent to every task, any other word is told by a 63-bit hash and gets its own and its
context's part by a join.

A task hands each shard its different pairs, how often training texts have them, and which documents hold them. The
shard sums the counts, builds its trie and answers with one sum a document. A pair occurs once per batch of texts
in this exchange, and contexts of many successors are dealt over several shards, so no word makes a hot one. Pairs that
end in a rare word are dealt by that word, so its shard sees all of them and knows its count.
"""

from __future__ import annotations

import os
import tempfile
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from mistgrove.llm.common import pieces, stored
from mistgrove.llm.trie import Sequence, Trie

#: Frequent words' numbers are below; two are the text's beginning and end. A rare word's number has the highest bit set.
WORDS = 1 << 17
BEGIN, END = WORDS - 1, WORDS - 2
RARE = 1 << 63
#: Weight of the word's own probability; step of the stored logarithms; training tokens per shard; words a task holds.
WEIGHT, STEP, PER_SHARD, HELD = 2.0, 0.04, 2_000_000, 300_000

ROWS = ("key long, held_out boolean, row long, n_tokens long, n_known long, base double, context double, rare array<binary>, times array<int>, "
        "shard int, block long, words binary, firsts binary, seconds binary, trained binary, holders binary, docs binary, often binary")
NAMES = [x.split()[0] for x in ROWS.split(", ")]


def thin(values: np.ndarray) -> bytes:
    """A non-negative array byte plane by byte plane, without the planes that are all zero; the table it is stored in compresses it."""
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = 1 + max((k for k in range(4) if raw[:, k].any()), default=0)
    return bytes([planes]) + raw[:, :planes].T.tobytes()


def thick(data: bytes) -> np.ndarray:
    planes = data[0]
    rows = np.frombuffer(data, np.uint8, offset=1).reshape(planes, -1)
    out = rows[0].astype(np.int64)
    for k in range(1, planes):
        out |= rows[k].astype(np.int64) << (8 * k)
    return out


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """Columns word (binary, A-Z lower-cased), n over the given texts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], names=["word", "n"])

        for batch in pieces(batches, 0):
            for value in batch.column(0).to_pylist():
                counted.update((value or b"").lower().split())
                if len(counted) > HELD:
                    yield handed()
                    counted.clear()
        if counted:
            yield handed()

    return docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(gather, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Numbers(dict):
    """Frequent words' numbers; any other word's is its hash."""

    def __missing__(self, word: bytes) -> int:
        return xxh3_64_intdigest(word) | RARE


class Vocabulary:
    """Numbers and training counts of the frequent words, the beginning and the end; totals of all words."""

    def __init__(self, words: list[bytes], counts: list[int], texts: int, tokens: int, kinds: int):
        self.number = Numbers((w, i) for i, w in enumerate(words))
        self.counts = np.zeros(WORDS, np.int64)
        self.counts[: len(counts)] = counts
        self.counts[[BEGIN, END]] = texts
        self.tokens, self.kinds, self.texts = tokens, kinds, texts
        self.shards = max(4, tokens // PER_SHARD)
        self.own = np.log10((self.counts + 1) / (tokens + kinds + 1))  # of each word: log10 P(w)
        self.context = np.log10(WEIGHT / (self.counts + WEIGHT))
        spread = np.maximum(1, 4 * self.counts * self.shards // max(tokens, 1))  # shards that share a context
        self.spread = np.append(spread, 1).astype(np.uint64)  # the last: of rare words

    def shard(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        turn = (second * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % self.spread[np.minimum(first, WORDS)]
        dealt = np.where(second < RARE, first + turn * np.uint64(7919), second)
        return ((dealt * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)).astype(np.int64) % self.shards

    def values(self, single: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One byte for log10(1 + c / (M P(w))); single: the counts of w."""
        gain = np.log10(1 + counts * (self.tokens + self.kinds + 1) / (WEIGHT * (single + 1)))
        return np.clip(np.round(gain / STEP), 1, 255).astype(np.uint8)


def requests(known: Vocabulary, bags: list[np.ndarray], held: np.ndarray) -> Iterator[tuple]:
    """Per shard: the words of its different pairs, both places among them, training counts, how many documents hold each, those and how often."""
    lengths = np.array([len(b) for b in bags])
    words, ids = np.unique(np.concatenate(bags), return_inverse=True)
    doc = np.repeat(np.arange(len(bags)), lengths)
    good = doc[1:] == doc[:-1]
    kinds, pair = np.unique(ids[:-1][good] * len(words) + ids[1:][good], return_inverse=True)
    bits = max(1, len(bags)).bit_length()
    listed, often = np.unique((pair << bits) | doc[1:][good], return_counts=True)
    pair, doc = listed >> bits, listed & ((1 << bits) - 1)
    _, start, holders = np.unique(pair, return_index=True, return_counts=True)
    trained = np.add.reduceat(np.where(held[doc], 0, often), start) if len(pair) else start
    first, second = kinds // len(words), kinds % len(words)
    shard = known.shard(words[first], words[second])
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(part):
            spans = holders[part]
            at = np.arange(spans.sum()) + np.repeat(start[part] - (np.cumsum(spans) - spans), spans)
            here, places = np.unique(np.concatenate([first[part], second[part]]), return_inverse=True)
            named = words[here].tobytes()
            yield int(shard[part[0]]), named, *map(thin, (np.diff(places[: len(part)], prepend=0), places[len(part) :], trained[part], spans, doc[at], often[at]))


@contextmanager
def mapped(trie: bytes):
    """The trie as a file mapped into memory; the file lies in the task's own scratch folder and a retried task writes its own."""
    handle, path = tempfile.mkstemp(prefix="trie-")
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(trie)
        yield np.memmap(path, np.uint8, "r")
    finally:
        os.unlink(path)


def answers(known: Vocabulary, table: pa.Table) -> tuple[bytes, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The shard's words and trie in one buffer, and per batch of texts the documents and what the trie adds to each."""
    named = [np.frombuffer(x.as_py(), np.uint64) for x in table["words"]]
    words, local = np.unique(np.concatenate(named), return_inverse=True)
    asked, begin = [], 0
    for own, firsts, seconds in zip(named, table["firsts"], table["seconds"], strict=True):
        own, begin = local[begin : begin + len(own)], begin + len(own)
        asked.append(own[np.cumsum(thick(firsts.as_py()))] * len(words) + own[thick(seconds.as_py())])
    kinds, back = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.bincount(back, np.concatenate([thick(x.as_py()) for x in table["trained"]]), len(kinds)).astype(np.int64)
    first, second = kinds // len(words), kinds % len(words)
    # all pairs that end in a rare word are here, so its count is theirs
    single = np.where(words < RARE, known.counts[np.minimum(words, WORDS - 1)], np.bincount(second, counts, len(words)).astype(np.int64))
    seen = counts > 0
    used, places = np.unique(np.concatenate([first[seen], second[seen]]), return_inverse=True)
    numbers = Sequence.built(words[used])
    trie = numbers + Trie.built(*np.split(places, 2), known.values(single[second[seen]], counts[seen]), len(used))
    at = np.full(len(words), -1)
    at[used] = np.arange(len(used))
    there = np.flatnonzero((at[first] >= 0) & (at[second] >= 0))
    gains = np.zeros(len(kinds))
    with mapped(trie) as levels:
        gains[there] = Trie(levels[len(numbers) :]).lookup(at[first[there]], at[second[there]], len(used)) * STEP
    out, done = [], 0
    for i, pairs in enumerate(asked):
        gain = gains[back[done : done + len(pairs)]]
        done += len(pairs)
        holders, docs, often = (thick(table[c][i].as_py()) for c in ("holders", "docs", "often"))
        total = np.bincount(docs, np.repeat(gain, holders) * often)
        some = np.unique(docs)
        out.append((table["block"][i].as_py(), some, total[some]))
    return trie, out


def score_corpus(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", tries: str | None = None) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is learned from rows whose held_out is not true. Null and empty texts are one end token. Repeated rows are
    scored, and counted, each. Without training rows every count is 0. An empty table gives an empty result; other columns
    are not looked at. `tries` names a folder that gets the shards' tries as a table (shard, trie), each after the sequence of
    its words' numbers.
    """
    texts = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("binary").alias("text"))
    learned = texts.where("not held_out")
    words = stored(word_counts(learned, "text"), "lm-words")
    totals = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    training = learned.count()
    top = words.orderBy(F.col("n").desc(), "word").limit(WORDS - 2).toArrow()  # at most WORDS rows
    known = Vocabulary(top["word"].to_pylist(), top["n"].to_pylist(), training, (totals["n"] or 0) + training, totals["kinds"] + (training > 0))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        numbered, seq = known.number.__getitem__, 0
        kinds = [f.type for f in pa.schema([("key", pa.int64()), ("held_out", pa.bool_()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                 ("base", pa.float64()), ("context", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())), ("shard", pa.int32()),
                 ("block", pa.int64()), *[(n, pa.binary()) for n in NAMES[11:]]])]
        for batch in pieces(batches, 2):
            block = (TaskContext.get().partitionId() << 24) + seq
            seq += 1
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            bags, rare, times = [], [], []
            for value in batch.column(2).to_pylist():
                found = (value or b"").lower().split()
                bag = np.array([BEGIN, *map(numbered, found), END], np.uint64)
                bags.append(bag)
                missing = Counter([found[i] for i in np.flatnonzero(bag[1:-1] >= RARE).tolist()])
                rare.append(list(missing))
                times.append(list(missing.values()))
            own, context, sure = [], [], []
            for bag in bags:
                inside = bag[1:][bag[1:] < WORDS]
                own.append(known.own[inside].sum())
                sure.append(int((known.counts[inside] > 0).sum()))
                before = bag[:-1][bag[:-1] < WORDS]
                context.append(known.context[before].sum())
            n = len(bags)
            columns = [batch.column(0), batch.column(1), (block << 20) + np.arange(n), [len(b) - 1 for b in bags], sure, own, context, rare, times]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds, strict=False)]
                                             + [pa.nulls(n, k) for k in kinds[9:]], names=NAMES)
            asked = list(requests(known, bags, held))
            filled = [[x[0] for x in asked], [block] * len(asked), *([x[i] for x in asked] for i in range(1, len(NAMES) - 10))]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(asked), k) for k in kinds[:9]] + [pa.array(x, k) for x, k in zip(filled, kinds[9:], strict=True)], names=NAMES)

    def shard(table: pa.Table) -> pa.Table:
        trie, out = answers(shared.value, table)
        which = table["shard"][0].as_py()
        return pa.table({"shard": pa.array([which] * (len(out) + 1), pa.int32()), "block": pa.array([None] + [x[0] for x in out], pa.int64()),
                         "docs": pa.array([None] + [x[1].tolist() for x in out], pa.list_(pa.int32())),
                         "sums": pa.array([None] + [x[2].tolist() for x in out], pa.list_(pa.float64())), "trie": pa.array([trie] + [None] * len(out), pa.binary())})

    def together(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        total = np.zeros(1 << 20)
        for docs, sums in zip(table["docs"], table["sums"], strict=True):
            total[docs.values.to_numpy()] += sums.values.to_numpy()
        some = np.flatnonzero(total)
        return pa.table({"row": pa.array((block << 20) + some, pa.int64()), "gain": pa.array(total[some], pa.float64())})

    rows = stored(texts.mapInArrow(cut, ROWS), "lm-rows")
    each = rows.where("shard is null")
    answered = stored(rows.where("shard is not null").select("shard", *NAMES[10:]).groupBy("shard").applyInArrow(
        shard, "shard int, block long, docs array<int>, sums array<double>, trie binary"), "lm-answers")
    if tries:
        answered.where("trie is not null").select("shard", "trie").write.mode("overwrite").parquet(tries)
    gains = answered.where("block is not null").select("block", "docs", "sums").groupBy("block").applyInArrow(together, "row long, gain double")
    count = F.coalesce("n", F.lit(0))
    rare = each.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times")) \
        .join(words, "word", "left").groupBy("row").agg(
            F.sum(F.col("times") * F.log10((count + 1) / F.lit(float(known.tokens + known.kinds + 1)))).alias("more"),
            F.sum(F.col("times") * F.log10(F.lit(WEIGHT) / (count + F.lit(WEIGHT)))).alias("more_context"),
            F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("more_known"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    return each.select("row", "key", "held_out", "n_tokens", "n_known", "base", "context").join(rare, "row", "left").join(gains, "row", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (base + F.col("context") + F.coalesce("more_context", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("score"))
