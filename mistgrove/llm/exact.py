"""Exact duplicates by progressive refinement: length, then a prefix's hash, then the hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mistgrove.llm.common import ascii_lower, attach, stored

#: Characters whose hash is the second refinement.
PREFIX = 256


def full_digest(text: Column) -> Column:
    """SHA-256, in lower-case hex, of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def shared(rows: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, bool]:
    """The key values that more than one row has, and whether they are few enough to be sent to every executor."""
    counted = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys), "exact-keys")
    return counted, counted.count() <= most


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest_all: bool = False,
                 broadcast_rows: int = 500_000) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The first pass reads lengths only,
    the second hashes prefixes of rows whose length occurs twice, the third hashes whole texts of rows whose
    length and prefix do. text_sha256 is null for rows that dropped out before, unless digest_all asks for the
    digest of every row (then the third pass hashes the others too, but groups only the survivors). Survivors
    are found by joins with the surviving keys; where those are more than broadcast_rows, the pass
    goes on with all rows of its predecessor, since moving texts would cost more than hashing them. Results are equal.

    The row with the largest key stays; of rows that repeat key and text, one. Null keys are smallest. An empty
    table gives an empty result; other columns are not looked at. One text may hold any share of the rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    length = F.octet_length(whole).alias("length")
    head = F.xxhash64(ascii_lower(F.substring(whole, 1, PREFIX))).alias("head")
    lengths, few_lengths = shared(docs.select(length), ["length"], broadcast_rows)
    told = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), length)
    candidates = told.join(F.broadcast(lengths), "length", "left_semi") if few_lengths else told
    heads, few_heads = shared(candidates.select("length", F.xxhash64(ascii_lower(F.substring(F.coalesce("text", F.lit("")), 1, PREFIX))).alias("head")),
                              ["length", "head"], broadcast_rows)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), length, head)
    if few_heads:
        rows = rows.join(F.broadcast(heads.withColumn("alive", F.lit(True))), ["length", "head"], "left")
    elif few_lengths:
        rows = rows.join(F.broadcast(lengths.withColumn("alive", F.lit(True))), ["length"], "left")
    else:
        rows = rows.withColumn("alive", F.lit(True))
    alive = F.coalesce("alive", F.lit(False))
    digest = full_digest(F.col("text"))
    hashed = stored(rows.select("key", alive.alias("alive"), (digest if digest_all else F.when(alive, digest)).alias("digest"),
                                F.monotonically_increasing_id().alias("row")), "exact-digests")
    groups = hashed.where("alive").groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("key", "row")).alias("keep")).where("group_size > 1")
    joined = attach(hashed.where("alive"), groups, "digest", F.col("group_size"), hashed.count()) \
        .unionByName(hashed.where("not alive"), allowMissingColumns=True)
    single = F.col("group_size").isNull()
    return joined.select(
        F.col("key").alias(key), F.when(single, F.col("key")).otherwise(F.col("keep.key")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep.row"))).alias("kept"), F.col("digest").alias("text_sha256"))
