"""Token counts without token ids: every distinct pre-token is counted once, documents add up their pre-tokens' counts.

A byte-level BPE never merges across pre-tokens, so a document's count is the sum over its pre-tokens. The
first pass gathers the distinct pre-tokens, which the tokenizer sees once each. The second makes every
document's pre-token frequencies: the most frequent pre-tokens (a fixed number) are looked up in place, the others
go through a join.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mistgrove.llm.common import pieces, stored

#: So many of the most frequent pre-tokens are sent to every task; the bound of that table.
FREQUENT = 1 << 17
#: Distinct pre-tokens a task counts before it hands them on.
HELD = 300_000
#: Below this code point the compiled pattern knows every character's class; texts beyond go to the library's own splitter.
KNOWN = 0x530


@lru_cache(maxsize=4)
def splitter(path: str, special: bool = True):
    """A function from text to (pre-tokens, number of special tokens), agreeing with the tokenizer in the file.

    Without `special`, special strings are plain text.
    """
    import regex
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    split = told.get("pre_tokenizer") or {}
    if told.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("a byte-level tokenizer without normalizer or added space is needed")
    strings = [t["content"] for t in told.get("added_tokens", ())] if special else []
    apart = re.compile("|".join(map(re.escape, sorted(strings, key=len, reverse=True)))) if strings else None

    def members(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(KNOWN) if regex.match(kind, chr(c)))

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    # Fixed value: the pattern of byte-level pre-tokens, with its character classes spelled out.
    pattern = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
    far = re.compile(f"[^\x00-{chr(KNOWN - 1)}]")
    library = Tokenizer.from_file(path).pre_tokenizer

    def parts(text: str) -> list[str]:
        if far.search(text):
            return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]
        return pattern.findall(text)

    def whole(text: str) -> tuple[list[str], int]:
        if apart is None or not apart.search(text):
            return parts(text), 0
        segments = apart.split(text)
        return [x for s in segments for x in parts(s)], len(segments) - 1

    return whole


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary(docs: DataFrame, path: str, text: str) -> DataFrame:
    """Columns word, n, tokens: every distinct pre-token, its frequency and how many tokens it makes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counted = splitter(path), Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], names=["word", "n"])

        for batch in pieces(batches, 0):
            for value in batch.column(0).to_pylist():
                counted.update(split((value or b"").decode())[0])
                if len(counted) > HELD:
                    yield handed()
                    counted.clear()
        if counted:
            yield handed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokenizer(path)
        for batch in batches:
            encoded = library.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in encoded], pa.int32())],
                                             names=["word", "n", "tokens"])

    words = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(gather, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n"))
    return stored(words.mapInArrow(count, "word string, n long, tokens int"), "token-words")


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, as the tokenizer in the file `path` (on every machine) counts whole texts.

    Special strings inside texts are single tokens, none are added. Null counts as empty: no tokens. Repeated rows give
    repeated rows, an empty table gives an empty result, other columns are not looked at. Texts are split whole,
    a batch of about 8 MB at a time.
    """
    words = vocabulary(docs, path, text)
    top = words.orderBy(F.col("n").desc(), "word").limit(FREQUENT).select("word", "tokens").toArrow()  # at most FREQUENT rows
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(top["word"].to_pylist(), top["tokens"].to_pylist(), strict=True)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, tokens = splitter(path), known.value
        for batch in pieces(batches, 2):
            sums, rare, times = [], [], []
            for value in batch.column(2).to_pylist():
                found, total = split((value or b"").decode())
                left, often = [], []
                for word, n in Counter(found).items():
                    if (k := tokens.get(word)) is None:
                        left.append(word)
                        often.append(n)
                    else:
                        total += n * k
                sums.append(total)
                rare.append(left)
                times.append(often)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sums, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                names=["key", "n_bytes", "tokens", "rare", "times"])

    read = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                       F.col(text).cast("binary").alias("text"))
    rows = stored(read.mapInArrow(frequencies, "key long, n_bytes long, tokens long, rare array<string>, times array<int>")
                  .withColumn("row", F.monotonically_increasing_id()), "token-rows")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    more = rare.join(words.select("word", F.col("tokens").alias("each")), "word") \
        .groupBy("row").agg(F.sum(F.col("times") * F.col("each")).alias("more"))
    total = F.col("tokens") + F.coalesce("more", F.lit(0))
    return rows.select("row", "key", "n_bytes", "tokens").join(more, "row", "left").select(
        F.col("key").alias(key), "n_bytes", total.cast("long").alias("n_tokens"))
