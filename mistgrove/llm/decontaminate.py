"""Test items in training documents: an inverted index of the items, asked with every passage of every document.

Items are scored by BM25, as a share of what the item scores against itself, and found by block-max WAND: a passage keeps
one cursor per distinct term in that term's postings (in order of items). Cursors are ordered by their item, and the item at
which the terms' largest weights add up to the threshold is the pivot: no item before it can reach it. If the largest
weights within the pivot's block can't reach it either, the cursors skip to the block's end; else they
meet at the pivot and it is scored. All passages of a batch take their steps together, as numpy arrays of cursors;
passages whose rarer terms lead to no item within reach take none.
Every item above the threshold is then verified by the n-grams that the passage's surroundings hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mistgrove.llm.common import pieces, stored

#: BM25's parameters; the share of its own score an item must reach; the share of n-grams of question and answer; their length.
K1, B, THRESHOLD, OVERLAP, GRAM = 1.2, 0.75, 0.6, 0.5, 3
#: Words in half a passage at least; passages overlap by half and are twice as long as the longest item.
HALF = 64
#: Items in a block; items in one index, about (more items: more indexes, one after the other).
BLOCK, ITEMS = 8, 20_000
WORDS = re.compile(r"[^\W_]+")
OUTPUT = "key long, item long, score double, question double, answer double"


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def ngrams(tokens: list) -> set[tuple]:
    span = min(GRAM, len(tokens))
    return {tuple(tokens[i : i + span]) for i in range(len(tokens) - span + 1)} if span else set()


def overlap(wanted: set[tuple], tokens: list) -> float:
    """The share of the wanted n-grams that occur; 1 if none are wanted."""
    if not wanted:
        return 1.0
    span = len(next(iter(wanted)))
    there = {tuple(tokens[i : i + span]) for i in range(len(tokens) - span + 1)}
    return len(wanted & there) / len(wanted)


def weights(items: list[list[str]], frequency: dict[str, int], number: int, mean: float) -> list[dict[str, float]]:
    """Per item its terms' BM25 weights as shares of their sum. frequency: items that hold a term; number, mean: of all items."""
    out = []
    for tokens in items:
        norm = K1 * (1 - B + B * len(tokens) / mean)
        raw = {t: np.log1p((number - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in Counter(tokens).items()}
        total = sum(raw.values())
        out.append({t: w / total for t, w in raw.items()})
    return out


class Index:
    """Postings of items sorted by length, with each term's largest weight overall and in every block of items.

    items: (question, answer) of each; answers are None where items come as one text.
    """

    def __init__(self, keys: list[int], items: list[tuple[list[str], list[str] | None]], frequency: dict[str, int], number: int, mean: float):
        order = sorted(range(len(keys)), key=lambda i: (len(items[i][0]) + len(items[i][1] or ()), keys[i]))
        self.keys = [keys[i] for i in order]
        split = [items[i] for i in order]
        shares = weights([q + (a or []) for q, a in split], frequency, number, mean)
        self.terms = {t: i for i, t in enumerate(sorted({t for s in shares for t in s}))}
        self.shares = [{self.terms[t]: w for t, w in s.items()} for s in shares]
        self.grams = [tuple(ngrams([self.terms[t] for t in part]) if part is not None else None for part in pair) for pair in split]
        self.half = max([HALF, *(len(q) + len(a or ()) for q, a in split)])
        postings = sorted((t, i, w) for i, s in enumerate(self.shares) for t, w in s.items())
        term = np.array([t for t, _, _ in postings], np.int64)
        self.item = np.array([i for _, i, _ in postings], np.int64)
        self.weight = np.array([w for _, _, w in postings], float)
        self.place = term * len(split) + self.item  # in order, so that a cursor finds its next item by binary search
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        # an item's most common terms, up to half the threshold, are summed; only the postings of the rarer ones are followed at first
        self.common, rare = np.zeros(len(split)), set()
        for i, s in enumerate(shares):
            for t in sorted(s, key=lambda t: (-frequency[t], t)):
                if self.common[i] + s[t] > THRESHOLD / 2:
                    rare.add((i, self.terms[t]))
                else:
                    self.common[i] += s[t]
        followed = np.array([(i, t) in rare for t, i, _ in postings], bool)
        self.rare = np.flatnonzero(followed)
        self.rare_first = np.searchsorted(term[self.rare], np.arange(len(self.terms) + 1))
        self.largest = np.zeros(len(self.terms))
        np.maximum.at(self.largest, term, self.weight)
        begins = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (self.item[1:] // BLOCK != self.item[:-1] // BLOCK)][: len(term)])
        # runs: a term's postings within a block of items; one more at the end stands behind all
        self.run = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(term)]))
        self.run_begin, self.run_block = np.r_[begins, len(term)], np.r_[self.item[begins] // BLOCK, 0]
        self.run_largest = np.r_[np.maximum.reduceat(self.weight, begins) if len(begins) else [], 0.0]
        self.last_run = np.searchsorted(term[begins], np.arange(len(self.terms)), side="right")
        self.place = np.r_[term[begins], len(self.terms)] * (len(split) // BLOCK + 2) + self.run_block

    def seek(self, at: np.ndarray, term: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The cursors' first runs in the block or behind it (the term's last_run if there is none): two steps, then binary search."""
        run, last = self.run[at], self.last_run[term]
        late = np.flatnonzero(self.run_block[run] < block)
        for _ in range(2):
            run[late] += 1
            late = late[(run[late] < last[late]) & (self.run_block[run[late]] < block[late])]
        wanted = term[late] * (len(self.keys) // BLOCK + 2) + block[late]
        run[late] = np.searchsorted(self.place, wanted)
        return run

    def cursors(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct (passage, term), and the first passage of every text. ids: all texts' terms in a row, -1 outside the index."""
        start = np.cumsum(lengths) - lengths
        passages = np.maximum(1, -(-lengths // self.half) - 1)
        offset = np.cumsum(passages) - passages
        at = np.flatnonzero(ids >= 0)
        text = np.repeat(np.arange(len(lengths)), lengths)[at]
        place = (at - start[text]) // self.half
        # a word lies in the passage that begins with its half and in the one before
        text, term, place = (np.concatenate(x) for x in ((text, text), (ids[at], ids[at]), (place, place - 1)))
        good = (place >= 0) & (place < passages[text])
        both = np.unique((offset[text] + place)[good] * len(self.terms) + term[good])
        return both // max(1, len(self.terms)), both % max(1, len(self.terms)), offset

    def promising(self, passage: np.ndarray, term: np.ndarray, enough: float) -> np.ndarray:
        """Which cursors belong to passages that may hold an item: one reached by its rarer terms there and all its common ones."""
        spans = self.rare_first[term + 1] - self.rare_first[term]
        posting = self.rare[np.arange(spans.sum()) + np.repeat(self.rare_first[term] - (np.cumsum(spans) - spans), spans)]
        pairs = np.repeat(passage, spans) * len(self.keys) + self.item[posting]
        order = np.argsort(pairs, kind="stable")
        pairs, weight = pairs[order], self.weight[posting[order]]
        begins = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)])
        total = np.add.reduceat(weight, begins) if len(begins) else np.zeros(0)
        whole, item = pairs[begins] // len(self.keys), pairs[begins] % len(self.keys)
        live = np.zeros(passage[-1] + 1 if len(passage) else 0, bool)
        live[whole[total + self.common[item] >= enough]] = True
        return live[passage]

    def candidates(self, ids: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, passage, item) of all items that reach the threshold in a passage."""
        passage, term, offset = self.cursors(ids, lengths)
        enough, items = THRESHOLD - 1e-9, len(self.keys)
        near = self.promising(passage, term, enough)
        passage, term = passage[near], term[near]
        at = self.first[term]
        found = []
        while len(passage):
            here = self.item[at]
            order = np.argsort(passage * items + here, kind="stable")
            passage, term, at, here = passage[order], term[order], at[order], here[order]
            begins = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
            sizes = np.diff(np.r_[begins, len(passage)])
            running = np.cumsum(self.largest[term])
            before = np.repeat(running[begins] - self.largest[term[begins]], sizes)
            reaches = np.flatnonzero(running - before >= enough)
            # the first cursor of each passage at which the sum reaches the threshold is its pivot; passages without one are done
            owner = np.repeat(np.arange(len(begins)), sizes)
            open_, first = np.unique(owner[reaches], return_index=True)
            pivot = np.full(len(begins), -1)
            pivot[open_] = here[reaches[first]]
            alive = np.repeat(pivot >= 0, sizes)
            passage, term, at, here, owner = passage[alive], term[alive], at[alive], here[alive], owner[alive]
            if not len(passage):
                break
            item = pivot[owner]
            upto = here <= item
            block = item // BLOCK
            run = self.seek(at, term, block)
            most = np.where((run < self.last_run[term]) & (self.run_block[run] == block), self.run_largest[run], 0.0)
            bound, reach = np.bincount(owner, most * upto, len(begins)), np.bincount(owner, most, len(begins))
            scored = bound[owner] >= enough
            # skipped: to the block's end, but where cursors behind the pivot might make up for it no further than the next of them
            behind = np.full(len(begins), items)
            np.minimum.at(behind, owner[~upto], here[~upto])
            skip = np.where(reach >= enough, np.minimum((pivot // BLOCK + 1) * BLOCK, behind), (pivot // BLOCK + 1) * BLOCK)
            at = self.moved(term, at, here, run, np.where(scored, item, skip[owner]))
            meet = scored & (at < self.first[term + 1]) & (self.item[np.minimum(at, len(self.item) - 1)] == item)
            score = np.bincount(owner[meet], self.weight[at[meet]], len(begins))
            hit = np.flatnonzero(score >= enough)
            whose = np.zeros(len(begins), np.int64)
            whose[owner] = passage
            found += zip(whose[hit].tolist(), pivot[hit].tolist(), strict=True)
            at = at + meet
            left = at < self.first[term + 1]
            passage, term, at = passage[left], term[left], at[left]
        if not found:
            return []
        whole, item = np.array(sorted(found)).T
        text = np.searchsorted(offset, whole, side="right") - 1
        return list(zip(text.tolist(), (whole - offset[text]).tolist(), item.tolist(), strict=True))

    def moved(self, term: np.ndarray, at: np.ndarray, here: np.ndarray, run: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Cursors that stand before their target, at their first posting from it on or at the end of their list.

        run: the cursors' first runs in the pivot's block or behind it; targets lie in that block or at its end.
        """
        late = np.flatnonzero(here < target)
        moved, end = at.copy(), self.first[term[late] + 1]
        # postings before the run lie in earlier blocks; those of the run are at most BLOCK
        moved[late] = np.maximum(at[late], self.run_begin[run[late]])
        late = late[moved[late] < end]
        while len(late):
            late = late[self.item[moved[late]] < target[late]]
            moved[late] += 1
            late = late[moved[late] < self.first[term[late] + 1]]
        return moved

    def verified(self, item: int, around: list[int]) -> tuple[float, float] | None:
        """Shares of question and answer that the words hold, if the item counts as found; items of one text count as a question."""
        question, answer = self.grams[item]
        shares = overlap(question, around), overlap(answer, around) if answer is not None else None
        return shares if all(s is None or s >= OVERLAP for s in shares) else None

    def leaks(self, texts: list[list[str]]) -> list[tuple[int, int, float, float, float | None]]:
        """(text, item key, best score, question's and answer's overlap) of all verified items."""
        known = self.terms
        coded = [[known.get(w, -1) for w in t] for t in texts]
        lengths = np.array([len(t) for t in coded], np.int64)
        ids = np.fromiter(chain.from_iterable(coded), np.int64, lengths.sum())
        best: dict[tuple[int, int], tuple[float, float, float | None]] = {}
        for text, passage, i in self.candidates(ids, lengths):
            at = passage * self.half
            there = set(coded[text][at : at + 2 * self.half])
            score = round(sum(w for t, w in self.shares[i].items() if t in there), 9)
            if score < THRESHOLD or best.get((text, i), (0,))[0] >= score:
                continue
            found = self.verified(i, coded[text][max(0, at - self.half) : at + 3 * self.half])
            if found:
                best[text, i] = (score, *found)
        return [(text, self.keys[i], *found) for (text, i), found in sorted(best.items())]


def tokenised(items: DataFrame, item: str, texts: list[str]) -> DataFrame:
    """(item, part, question, answer): the words of items that have any; answer is null without a column of answers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [[words(t) for t in batch.column(i).to_pylist()] for i in range(1, batch.num_columns)]
            listed = pa.list_(pa.string())
            answers = told[1] if len(told) > 1 else [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told[0], listed), pa.array(answers, listed)],
                                             names=["item", "question", "answer"])

    read = items.select(F.col(item).cast("long").alias("item"), *[F.col(t).alias(f"text{i}") for i, t in enumerate(texts)])
    return read.mapInArrow(cut, "item long, question array<string>, answer array<string>") \
        .where(F.size("question") + F.greatest(F.size("answer"), F.lit(0)) > 0)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text", answer_text: str | None = None) -> DataFrame:
    """One row per document row and item that it holds: key, item, score, question, answer (shares of n-grams found).

    An item in one text is found where at least OVERLAP of its n-grams stand, whichever end is cut off; its share is in
    `question`, and `answer` is null. With a column of answers both parts must reach OVERLAP (a part without words does).
    Null, empty or wordless items are found nowhere, such documents hold nothing; repeated documents give repeated rows,
    repeated items one row each; without items or documents the result is empty. Whole texts are searched, about 4 MB
    at a time. Lengths and document frequencies are aggregated over all items by Spark; the driver holds one part of
    about ITEMS items at a time, with the frequencies of its own terms, and sends its index out.
    """
    spark = docs.sparkSession
    told = tokenised(items, item, [item_text] + ([answer_text] if answer_text else []))
    both = F.concat("question", F.coalesce("answer", F.array().cast("array<string>")))
    told = stored(told.select("item", "question", "answer", both.alias("words")), "leak-items")
    number, length = told.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    rounds = -(-number // ITEMS)
    share = F.pmod(F.xxhash64("item", "words"), F.lit(max(1, rounds)))
    own = told.select(share.alias("part"), F.explode(F.array_distinct("words")).alias("term"))
    frequency = stored(own.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.collect_set("part").alias("parts")), "leak-terms") if number else None
    read = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    result = spark.createDataFrame([], OUTPUT)
    for k in range(rounds):  # one part of the items at a time
        rows = told.where(share == k).select("item", "question", "answer").collect()
        held = {r["term"]: r["n"] for r in frequency.where(F.array_contains("parts", k)).select("term", "n").collect()}
        index = spark.sparkContext.broadcast(Index([r["item"] for r in rows], [(r["question"], r["answer"]) for r in rows], held, number, length / number))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in pieces(batches, 1, 4 << 20):
                keys = batch.column(0).to_pylist()
                found = known.leaks([words(x.decode()) if x else [] for x in batch.column(1).to_pylist()])
                kinds = [pa.int64(), pa.int64()] + [pa.float64()] * 3
                rows = [(keys[i], *rest) for i, *rest in found]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kinds[i]) for i in range(5)],
                                                 names=["key", "item", "score", "question", "answer"])

        result = result.union(read.mapInArrow(search, OUTPUT))
    return result.withColumnRenamed("key", key).withColumnRenamed("item", item)
