"""Mixing sources to target weights by thresholds in hash space.

Every document has a hash. Words are summed by source and hash bucket; the bucket in which a source's budget
runs out is split into finer buckets, and only that one, until it holds a single hash. The result is one
threshold per source, so the mix is a filter: nothing is sorted and no document table is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mistgrove.llm.common import stored, word_count

#: Hashes have 60 bits, looked at 12 at a time.
BITS, STEP = 60, 12

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def position(key: Column, seed: str) -> Column:
    """A document's place in hash space: the first 15 hex digits of the MD5 of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Columns source, source_size of one row per source, with its target added.

    Sources by code point, null last, get the weights in turn and share `share` of all words; no target exceeds
    `most` times its source, and what is cut is shared by weight among the others until none is above. That
    end state is one common level per unit of weight: sources whose cap per weight is under it stop at their cap.
    One row per source is sorted, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights)) + 1)) \
        .withColumn("cap", most * F.col("source_size"))
    # capped first: those with the least cap per weight, ties by name
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = weighed.select(
        "*", F.row_number().over(fill).alias("rank"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("spent"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"),
        (F.sum("source_size").over(everything) * F.lit(share)).alias("budget"),
    ).withColumn("level", (F.col("budget") - F.col("spent")) / F.col("open"))
    stops = (F.col("cap").cast("double") <= F.col("weight") * F.col("level"))
    # the level of the first source that doesn't stop holds for it and all after it
    final = F.min(F.when(~stops, F.struct("rank", "level"))).over(everything)["level"]
    return run.withColumn("final", final).select(
        "source", "source_size", F.when(stops, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def by_source(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Join on the source, null too; broadcast only where there are few sources, else adaptive joins split a hot one."""
    right = sources.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5,
        most: int = 2, seed: str = "mix", broadcast_rows: int = 100_000) -> DataFrame:
    """One row per document: key, source, size, source_size, target, hash, copies, taken = size * copies.

    A source whose target is k times its size and a rest takes all its documents k times, and once more those
    under a hash threshold at which the sum comes nearest to the rest. Documents of one hash (repeated ids) go
    together. Null or empty texts have size 0 and take nothing; an empty table gives an empty one; columns of
    the input other than the three named are not looked at. Only the four small columns are stored.
    """
    rows, limits, few = limits_by_source(docs, key, text, source, share, most, seed, broadcast_rows)
    copies = copies_of(F.col("hash"))
    return by_source(rows, limits, few).select(F.col("key").alias(key), F.col("source"), "size", "source_size", "target", "hash",
                                               copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def copies_of(hashed: Column) -> Column:
    """How often a document is taken, next to its source's columns copies and limit."""
    return F.col("copies") + F.when(hashed <= F.col("limit"), 1).otherwise(0)


def limits_by_source(docs: DataFrame, key: str, text: str, source: str, share: float, most: int, seed: str,
                     broadcast_rows: int) -> tuple[DataFrame, DataFrame, bool]:
    """Rows key, source, size, hash; per source its target, copies and limit; whether the sources are few."""
    rows = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                              position(F.col(key), seed).alias("hash")), "mix-rows")
    aims = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most)
                  .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
                  .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-aims")
    few = aims.count() <= broadcast_rows
    limits = thresholds(rows, aims.select("source", "rest"), few)
    return rows, stored(by_source(aims, limits, few), "mix-limits"), few


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5,
            most: int = 2, seed: str = "mix", broadcast_rows: int = 100_000) -> DataFrame:
    """The documents themselves, all columns, each as often as the mix takes it. Texts aren't shuffled where sources are few.

    Wordless documents are taken with their source's other documents under the threshold. Defined otherwise as mix.
    """
    _, limits, few = limits_by_source(docs, key, text, source, share, most, seed, broadcast_rows)
    limits = limits.select(F.col("source").alias("_source"), "copies", "limit")
    whole = docs.select(F.struct("*").alias("_doc"), F.col(source).alias("_own"), position(F.col(key), seed).alias("_hash"))
    met = whole.join(F.broadcast(limits) if few else limits, F.col("_own").eqNullSafe(F.col("_source")))
    taken = met.withColumn("_n", copies_of(F.col("_hash"))).where("_n > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_n"))).select("_doc.*")


def thresholds(rows: DataFrame, rests: DataFrame, few: bool) -> DataFrame:
    """Per source the largest hash that is still taken (-1: none), from rows (source, size, hash) and rests (source, rest)."""
    state = rests.select("source", "rest", F.lit(0).cast("long").alias("spent"), F.lit(0).cast("long").alias("prefix"))
    for shift in range(BITS - STEP, -1, -STEP):
        inside = by_source(rows, state, few).where(F.shiftright("hash", shift + STEP) == F.col("prefix"))
        buckets = inside.groupBy("source", "rest", "spent", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        along = Window.partitionBy("source").orderBy("bucket")  # at most 2**STEP rows a source
        sums = buckets.withColumn("upto", F.col("spent") + F.sum("words").over(along))
        # the first bucket that goes beyond the rest, else the last one
        crossing = sums.groupBy("source", "rest").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", "upto", "words", "n"))).alias("cross"),
            F.max(F.struct("bucket", "upto", "words", "n")).alias("last"))
        at = F.coalesce(F.col("cross"), F.col("last"))
        state = stored(crossing.select("source", "rest", (at["upto"] - at["words"]).alias("spent"), at["bucket"].alias("prefix"),
                                       at["words"].alias("words"), at["n"].alias("n")), "mix-buckets")
        if shift and (state.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    # what is left is one document or one hash: take it where that comes nearer to the rest
    near = 2 * F.col("spent") + F.col("words") <= 2 * F.col("rest")
    first, beyond = F.shiftleft("prefix", shift), F.shiftleft(F.col("prefix") + 1, shift)
    limit = F.when(F.col("rest") <= 0, -1).when(near, beyond - 1).otherwise(first - 1)  # nothing left: wordless documents neither
    return state.select("source", limit.alias("limit"))
