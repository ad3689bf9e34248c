"""Alignment of two tokenizers' tokens over the same bytes, and how often their tokens overlap in the whole corpus.

Where both tokenizations end at the same byte a group ends. Most groups hold one token of either side, at a fixed
distance of their numbers (the shift). From a place where such a stretch begins, windows of 1, 2, 4, ... ends are compared at
that shift until one differs, and halved to the first that does; the whole stretch is one jump. The irregular group behind it is
resolved token by token, and its lengths give the shift of the next stretch.

Both tokenizers work on the space and the text. Neither merges across the pieces that they are cut into here (a byte-level
one's pre-tokens; for the other, runs of spaces with what follows, since no entry of its vocabulary has a space behind
another character), so every distinct piece is tokenised once a task.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mistgrove.llm.common import pieces, stored
from mistgrove.llm.tokens import splitter

#: So many of the most frequent id pairs are sent to every task; the bound of that table.
FREQUENT = 1 << 19
#: Links a task gathers before it hands on their counts, and pieces of text whose tokens it remembers.
HELD, KNOWN = 1_000_000, 200_000
#: Characters of the pieces that a task remembers, and bytes of texts it works on at once.
REMEMBERED, BATCH = 4_000_000, 1 << 20

ROWS = "key long, row long, n_a long, n_b long, n_groups long, n_links long, sha string, pairs array<long>, often array<int>"
OUT = "key long, row long, n_a long, n_b long, n_groups long, n_links long, sha string, best long, sum long, rare array<long>, times array<int>"
SPACED = re.compile(" *[^ ]+| +")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Numbers(dict):
    """Pieces of text in the order of their first use; new ones wait to be tokenised."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.waiting.append(piece)
        return number


class Side:
    """A tokenizer of batches of texts that remembers the pieces it has seen, and the bytes of every id."""

    def __init__(self, cut, encode, names: list[bytes]):
        self.cut, self.encode, self.names = cut, encode, names
        self.length = np.array([len(x) for x in names], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known, self.held = Numbers(), 0
        self.flat, self.start, self.bad = array("i"), array("q", [0]), bytearray()

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts, how many each text has, and whether they are the text's bytes."""
        if len(self.known) > KNOWN or self.held > REMEMBERED:
            self.forget()
        number = self.known.__getitem__
        found = [list(map(number, self.cut(text))) for text in texts]
        new, self.known.waiting = self.known.waiting, []
        self.held += sum(map(len, new))
        for part, ids in zip(new, self.encode(new) if new else [], strict=True):
            self.flat.extend(ids)
            self.start.append(len(self.flat))
            self.bad.append(b"".join([self.names[i] for i in ids]) != part.encode())
        sizes = np.array([len(x) for x in found], np.int64)
        used = np.fromiter(chain.from_iterable(found), np.int64, sizes.sum())
        of = np.repeat(np.arange(len(texts)), sizes)
        start = np.array(self.start)  # copies, as these go on growing
        tokens = start[used + 1] - start[used]
        before = np.cumsum(tokens) - tokens
        ids = np.array(self.flat)[np.repeat(start[used] - before, tokens) + np.arange(tokens.sum())]
        right = np.bincount(of, np.array(self.bad)[used], len(texts)) == 0
        return ids.astype(np.int64), np.bincount(of, tokens, len(texts)).astype(np.int64), right


@lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    """The byte-level BPE tokenizer in a .json file; special strings are plain text."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are side by side already
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    parts = splitter(path, special=False)
    alphabet = byte_alphabet()
    entries = library.get_vocab(with_added_tokens=True)
    names = [b""] * (max(entries.values()) + 1)
    for name, i in entries.items():
        names[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
    return Side(lambda text: parts(text)[0], lambda new: [x.ids for x in library.encode_batch(new, add_special_tokens=False)], names)


@lru_cache(maxsize=2)
def spaced(path: str) -> Side:
    """The BPE tokenizer with byte fallback in a .model file, whose library adds the first space itself."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=path)
    entries = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    if any(re.search("[^▁]▁", x) for x in entries):
        raise ValueError("a vocabulary without spaces inside its entries is needed")
    names = [bytes([int(x[3:5], 16)]) if library.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(entries)]
    alone = library.piece_to_id("▁")

    def encode(new: list[str]) -> list[list[int]]:
        return [ids or [alone] for ids in library.encode([x[1:] for x in new], num_threads=1)]

    return Side(SPACED.findall, encode, names)


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the ends of two rows of tokens over the same bytes: whether a token of either side ends a group, and all linked pairs.

    The last ends are equal. Pairs of one-to-one stretches come first, then those of irregular groups.
    """
    raw_a, raw_b, ends_a, ends_b = a.tobytes(), b.tobytes(), a.tolist(), b.tolist()
    wide = a.itemsize
    from_a, from_b, runs = [], [], []
    inner_a, inner_b, link_a, link_b = [], [], [], []
    i, j, all_a, all_b = 0, 0, len(ends_a), len(ends_b)
    while i < all_a:
        # jump: how many ends from here on are equal at the shift j - i
        most = min(all_a - i, all_b - j)
        run, step, at, to = 0, 1, i * wide, j * wide
        while run < most and raw_a[at : at + step * wide] == raw_b[to : to + step * wide]:
            run += step
            at += step * wide
            to += step * wide
            step *= 2
        if run < most:  # the window that differs is halved to its first difference
            while step > 1:
                step //= 2
                if raw_a[at : at + step * wide] == raw_b[to : to + step * wide]:
                    run += step
                    at += step * wide
                    to += step * wide
        else:
            run = most
        if run:
            from_a.append(i)
            from_b.append(j)
            runs.append(run)
            i += run
            j += run
            if i == all_a:
                break
        # an irregular group, token by token, up to the next common end
        x, y = ends_a[i], ends_b[j]
        link_a.append(i)
        link_b.append(j)
        while x != y:
            if x < y:
                inner_a.append(i)
                i += 1
                x = ends_a[i]
            else:
                inner_b.append(j)
                j += 1
                y = ends_b[j]
            link_a.append(i)
            link_b.append(j)
        i += 1
        j += 1
    last_a, last_b = np.ones(all_a, bool), np.ones(all_b, bool)
    last_a[inner_a] = False
    last_b[inner_b] = False
    size = np.array(runs, np.int64)
    along = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    both = [np.append(np.repeat(np.array(f, np.int64), size) + along, np.array(x, np.int64)) for f, x in ((from_a, link_a), (from_b, link_b))]
    return last_a, last_b, *both


def group_digests(ids: tuple[np.ndarray, np.ndarray], last: tuple[np.ndarray, np.ndarray], of: tuple[np.ndarray, np.ndarray], texts: int, shown: pa.Array) -> list[str]:
    """Per text the digest of its groups, `a1,a2|b1;a3|b2,b3`; `of` tells each token's text, `shown` spells ids with what follows them."""
    group = [np.cumsum(x) - x for x in last]  # number of the group of each token
    ends = [np.append(0, np.flatnonzero(x) + 1) for x in last]
    place = np.arange(len(ids[0])) + ends[1][group[0]], np.arange(len(ids[1])) + ends[0][group[1] + 1]
    half = len(shown) // 2
    wanted = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    wanted[place[0]] = 2 * ids[0] + last[0]
    wanted[place[1]] = half + 2 * ids[1] + last[1]
    spelled = shown.take(pa.array(wanted))
    offsets = np.frombuffer(spelled.buffers()[1], np.int64)[: len(wanted) + 1]
    data = memoryview(spelled.buffers()[2])
    counts = np.bincount(of[0], minlength=texts) + np.bincount(of[1], minlength=texts)
    edges = offsets[np.append(0, np.cumsum(counts))].tolist()
    return [hashlib.sha256(data[x : y - 1]).hexdigest() for x, y in zip(edges, edges[1:], strict=False)]


def aligned_rows(path_a: str, path_b: str):
    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_level(path_a), spaced(path_b)
        width, entries = len(two.names), max(len(one.names), len(two.names))
        shown = pa.array([f"{i}{x}" for marks in (",|", ",;") for i in range(entries) for x in marks], pa.large_string())
        for batch in pieces(batches, 2, BATCH):
            texts = [" " + x.decode() if x else "" for x in batch.column(2).to_pylist()]
            n = len(texts)
            ids, sizes, right = zip(one.ids(texts), two.ids(texts), strict=True)
            some = right[0] & right[1] & (sizes[0] > 0)
            of = [np.repeat(np.arange(n), x) for x in sizes]
            ids = [x[some[o]] for x, o in zip(ids, of, strict=True)]
            of = [o[some[o]] for o in of]
            last_a, last_b, link_a, link_b = align(np.cumsum(one.length[ids[0]]), np.cumsum(two.length[ids[1]]))
            counts = [np.bincount(x, minlength=n) for x in (of[0], of[1], of[0][last_a], of[0][link_a])]
            digests = group_digests((ids[0], ids[1]), (last_a, last_b), (of[0], of[1]), n, shown)
            kinds, times = np.unique((of[0][link_a] * entries + ids[0][link_a]) * width + ids[1][link_b], return_counts=True)
            held = kinds // (entries * width)
            ends = pa.array(np.append(0, np.cumsum(np.bincount(held, minlength=n))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in counts], pa.array([d if s else "" for d, s in zip(digests, some, strict=True)], pa.string()),
                 pa.ListArray.from_arrays(ends, pa.array(kinds % (entries * width))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))],
                names=[x.split()[0] for x in ROWS.split(", ")])
        one.forget()  # workers outlive their tasks
        two.forget()

    return walked


def pair_counts(rows: DataFrame) -> DataFrame:
    """Columns pair, n: how many links of all rows hold each id pair; summed in the task before anything is exchanged."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            kinds, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.bincount(back, np.concatenate([x[1] for x in held])).astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            held.append((batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()))
            size += len(held[-1][0])
            if size > HELD:
                yield summed()
                held, size = [], 0
        if size:
            yield summed()

    return rows.select("pairs", "often").mapInArrow(gather, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `path_a` is a byte-level vocabulary (.json), `path_b` one with spaces marked (.model), both on every machine. The count of an
    id pair is how many links of the whole corpus hold it; n_best are a document's links whose pair has the highest count among
    those of its id in B. Texts that are null, empty or do not come back from both vocabularies have zeros and an empty digest.
    Repeated rows count each and give repeated rows; an empty table gives an empty one; other columns are not looked at. Texts are
    tokenised whole, a batch of about 8 MB at a time. The most frequent pairs (`frequent` at most) are looked up in place, others joined.
    """
    width = len(spaced(path_b).names)
    read = docs.select(F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("binary").alias("text"))
    rows = stored(read.mapInArrow(aligned_rows(path_a, path_b), ROWS), "aligned-rows")
    counts = stored(pair_counts(rows), "aligned-pairs")
    highest = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most"))  # one row per entry of B
    told = stored(counts.withColumn("b", F.col("pair") % width).join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "aligned-counts")
    top = told.orderBy(F.col("n").desc(), "pair").limit(frequent).toArrow().sort_by("pair")  # at most `frequent` rows
    shared = docs.sparkSession.sparkContext.broadcast([top[c].to_numpy() for c in ("pair", "n", "best")])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            lists, often = batch.column("pairs"), batch.column("often").flatten().to_numpy().astype(np.int64)
            wanted = lists.flatten().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pair, wanted), max(len(pair) - 1, 0))
            found = pair[at] == wanted if len(pair) else np.zeros(len(wanted), bool)
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, of[found], often[found] * n[at[found]])
            np.add.at(bests, of[found], often[found] * best[at[found]])
            ends = pa.array(np.append(0, np.cumsum(np.bincount(of[~found], minlength=batch.num_rows))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(7)] + [pa.array(bests), pa.array(sums), pa.ListArray.from_arrays(ends, pa.array(wanted[~found])),
                 pa.ListArray.from_arrays(ends, pa.array(often[~found].astype(np.int32)))], names=[x.split()[0] for x in OUT.split(", ")])

    known = stored(rows.mapInArrow(look_up, OUT), "aligned-known")
    rare = known.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    more = rare.join(told, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    zero = F.lit(0).cast("long")
    return known.drop("rare", "times").join(more, "row", "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("sum") + F.coalesce("more", zero)).alias("count_sum"), F.col("sha").alias("groups_sha256"))
