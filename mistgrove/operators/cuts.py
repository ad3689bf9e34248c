"""Candidate cut points of numeric columns and class counts between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mistgrove.functions.lookup import CASE_LIMIT, double_array, opened, rank_of, ranks
from mistgrove.operators.scale import melt, range_edges
from mistgrove.storage import BROADCAST_ROWS, settle, small_side

EQUAL_WIDTH = "equal_width"
EQUAL_FREQUENCY = "equal_frequency"


def min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, lo, hi) of every column, from one partial-and-final aggregation."""
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(cols)
                    for k, f in (("lo", F.min), ("hi", F.max))])
    parts = [
        F.struct(F.lit(c).alias("feature"), F.col(f"lo_{i}").alias("lo"), F.col(f"hi_{i}").alias("hi"))
        for i, c in enumerate(cols)
    ]
    return ends.select(F.inline(F.array(*parts)))


def class_map(df: DataFrame, label: str) -> DataFrame:
    """(label, class): the distinct labels numbered from 0 in sorted order."""
    distinct = df.select(F.col(label).alias("label")).distinct()
    return distinct.withColumn("class", F.row_number().over(Window.orderBy("label")) - 1)


@dataclass(frozen=True)
class FitSizes:
    """Sizes a partition search works with."""

    rows: int
    bins: int
    splits: int
    min_instances: int


def fit_sizes(rows: int, max_bins: int = 1000, min_ratio: float = 0.0) -> FitSizes:
    """Usable bins, inner cuts and the least rows of a segment, from the number of rows."""
    bins = min(max_bins, rows)
    return FitSizes(rows, bins, bins - 1, int(min_ratio * rows))


def fit_metadata(df: DataFrame, max_bins: int = 1000, min_ratio: float = 0.0) -> DataFrame:
    """The same sizes as a one-row table (rows, bins, splits, min_instances)."""
    bins = F.least(F.lit(max_bins).cast("bigint"), F.col("rows"))
    return df.agg(F.count("*").alias("rows")).select(
        "rows", bins.alias("bins"), (bins - 1).alias("splits"),
        F.floor(F.col("rows") * F.lit(float(min_ratio))).alias("min_instances"),
    )


def subsample(df: DataFrame, fraction: float, seed: int = 17, key: list[str] | None = None) -> DataFrame:
    """A sample without replacement, only for finding candidate cuts; all rows from fraction 1.

    A row is taken by the first 60 bits of the MD5 of seed and key columns (all columns unless named), so the sample
    does not depend on how rows are laid out; rows of one key go together.
    """
    if fraction >= 1.0:
        return df
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key or df.columns])
    return df.where(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") < F.lit(int(fraction * 16**15)))


def equi_width_cuts(ends: DataFrame, splits: int) -> DataFrame:
    """(feature, cut): `splits` + 2 evenly spaced points from lo to hi; both ends when they are equal."""
    if splits < 0:
        raise ValueError("the number of splits must not be negative")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(splits + 1))
    even = F.transform(F.sequence(F.lit(0), F.lit(splits + 1)), lambda i: F.col("lo") + width * i)
    spread = F.when(F.col("hi") > F.col("lo"), even).when(F.col("hi") == F.col("lo"), F.array("lo", "hi"))
    checked = F.coalesce(spread, F.raise_error(F.lit("maximum below minimum, or no rows")).cast("array<double>"))
    return ends.select("feature", F.posexplode(checked).alias("bin", "cut"))


def equi_frequency_cuts(
    df: DataFrame, cols: list[str], splits: int, block: str, rows: int | None = None, buckets: int | None = None
) -> DataFrame:
    """(block, feature, cut): in every block, cuts between values so that bins hold similar counts.

    Walking a block's distinct values in order, a cut is put half-way before a value when the
    count before it is nearer to the next multiple of rows/(splits+1) than the count after it;
    the least and greatest values are added. One step passes at most one cut, so with k(i) the
    multiples lying below the middle of the two counts at value i, value i gives a cut exactly
    when k(i) - i is no less than every k(s) - s before it. That is a running minimum over
    running counts: windows, split by value range so that no block has to fit in one task.
    """
    if splits < 0:
        raise ValueError("the number of splits must not be negative")
    rows = df.count() if rows is None else rows
    if buckets is None:
        buckets = min(4096, 1 + rows // 1_000_000)
    long = melt(df, cols, range_edges(df, cols, buckets, rows), F.col(block).alias("block"))
    keys = ["block", "feature"]
    counts = long.groupBy(*keys, "bucket", "value").agg(F.count("*").alias("n"))

    local = Window.partitionBy(*keys, "bucket").orderBy("value")
    upto_here = local.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)

    # Running counts: inside the range, plus the totals of the ranges before it.
    ranges = (
        counts.groupBy(*keys, "bucket")
        .agg(F.sum("n").alias("rn"), F.count("*").alias("rv"), F.max("value").alias("top"))
        .select(
            *keys, "bucket",
            F.coalesce(F.sum("rn").over(earlier), F.lit(0)).alias("n0"),
            F.coalesce(F.sum("rv").over(earlier), F.lit(0)).alias("i0"),
            F.max("top").over(earlier).alias("v0"),
            F.sum("rn").over(whole).alias("total"),
        )
    )
    placed = (
        counts.withColumns({
            "c": F.sum("n").over(upto_here),
            "i": F.row_number().over(local),
            "prev": F.lag("value").over(local),
        })
        .join(ranges, [*keys, "bucket"])
        .select(
            *keys, "bucket", "value",
            (F.col("i0") + F.col("i") - 1).alias("i"),
            F.coalesce("prev", "v0").alias("prev"),
            ((2 * (F.col("n0") + F.col("c")) - F.col("n")) * (splits + 1)).alias("x"),
            (2 * F.col("total")).alias("d"),
        )
        .withColumn("k", F.when(F.col("i") == 0, 0).otherwise(F.expr("(x - 1) div d")) - F.col("i"))
    )
    # Running minimum, put together the same way.
    before_here = local.rowsBetween(Window.unboundedPreceding, -1)
    floors = (
        placed.groupBy(*keys, "bucket").agg(F.min("k").alias("rk"))
        .select(*keys, "bucket", F.min("rk").over(earlier).alias("k0"))
    )
    inner = (
        placed.withColumn("low", F.min("k").over(before_here))
        .join(floors, [*keys, "bucket"])
        .filter(F.col("prev").isNotNull() & (F.col("k") >= F.least("low", "k0")))
        .select(*keys, ((F.col("prev") + F.col("value")) / 2).alias("cut"))
    )
    ends = counts.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return inner.unionByName(ends.select(*keys, F.explode(F.array("lo", "hi")).alias("cut")))


def range_of(column: str, edges: dict[str, list[float]]) -> Column:
    """In a long table (feature, ...): the range of a value among the edges of its feature."""
    return F.coalesce(*[F.when(F.col("feature") == name, rank_of(F.col(column), e)) for name, e in edges.items()]).cast("int")


def ranges_before(counted: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(feature, bucket, before): of the ranges' counts `n`, the sum over all ranges before; empty ranges included."""
    parts = [F.struct(F.lit(name).alias("feature"), F.sequence(F.lit(0), F.lit(len(e))).alias("buckets")) for name, e in edges.items()]
    every = counted.sparkSession.range(1).select(F.inline(F.array(*parts))).select("feature", F.explode("buckets").alias("bucket"))
    earlier = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = every.join(counted, ["feature", "bucket"], "left")
    found = filled.select("feature", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return small_side(found, sum(len(e) + 1 for e in edges.values()))


def merge_cuts(cuts: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(feature, bin, cut): the distinct cuts of all blocks, numbered in order per column.

    More than `most` cuts are numbered range by range, so that no task has to order a whole column.
    """
    distinct = settle(cuts.select("feature", "cut").distinct())
    total = distinct.count()
    if total <= most:
        order = Window.partitionBy("feature").orderBy("cut")
        return distinct.withColumn("bin", F.row_number().over(order) - 1)
    buckets = min(4096, 2 + total // max(1, most))
    probes = double_array([i / buckets for i in range(1, buckets)])
    found = distinct.groupBy("feature").agg(F.percentile_approx("cut", probes, 10 * buckets).alias("edges")).collect()  # a row a column
    edges = {r.feature: sorted(set(r.edges)) for r in found}
    placed = distinct.withColumn("bucket", range_of("cut", edges))
    before = ranges_before(placed.groupBy("feature", "bucket").agg(F.count("*").alias("n")), edges)
    inside = F.row_number().over(Window.partitionBy("feature", "bucket").orderBy("cut"))
    return placed.withColumn("nth", inside).join(before, ["feature", "bucket"]).select(
        "feature", "cut", (F.col("before") + F.col("nth") - 1).cast("int").alias("bin"))


def candidate_cuts(
    df: DataFrame, cols: list[str], strategy: str, splits: int, block: str | None = None, fraction: float = 1.0,
    seed: int = 17, sample_key: list[str] | None = None,
) -> DataFrame:
    """(feature, bin, cut) by the named strategy; equal frequency works per value of `block`."""
    sample = subsample(df, fraction, seed, sample_key)
    if strategy == EQUAL_WIDTH:
        return equi_width_cuts(min_max(sample, cols), splits)
    if strategy == EQUAL_FREQUENCY:
        named = "__block" if block is None else block
        source = sample.withColumn(named, F.lit(0)) if block is None else sample
        return merge_cuts(equi_frequency_cuts(source, cols, splits, named))
    raise ValueError(f"unknown cut strategy {strategy!r}")


def cut_lists(cuts: DataFrame) -> dict[str, list[float]]:
    """The cuts of each column in order; for tables whose number of rows has been looked at."""
    found: dict[str, list[float]] = {}
    for r in cuts.orderBy("feature", "bin").collect():
        found.setdefault(r.feature, []).append(r.cut)
    return found


def cut_ends(cuts: DataFrame) -> dict[str, tuple[float, float, int]]:
    """First cut, last cut and number of cuts of each column: all that evenly spaced cuts need."""
    ends = cuts.groupBy("feature").agg(F.min("cut").alias("lo"), F.max("cut").alias("hi"), F.count("*").alias("n"))
    return {r.feature: (r.lo, r.hi, r.n) for r in ends.collect()}


def rank_join(df: DataFrame, label: str, cuts: DataFrame, cols: list[str], rows: int, buckets: int | None = None) -> DataFrame:
    """(feature, bin, label, n) where bin is the number of the column's cuts below a value, for any number of cuts.

    Values, counted per class, and cuts go into one table that is dealt out by column and value range. Within a range the cuts
    passed so far are a running sum; the cuts of the ranges before it are added. A hot value is one row per class. Ranges come from
    a sample and only steer the work. Neither values nor cuts reach the driver. Nulls are left out.
    """
    if buckets is None:
        buckets = min(4096, 1 + rows // 1_000_000)
    edges = range_edges(df, cols, buckets, rows)
    long = melt(df, cols, edges, F.col(label).alias("label")).filter("value is not null")
    counted = long.groupBy("feature", "bucket", "value", "label").agg(F.count("*").alias("n"))
    marks = cuts.filter(F.col("feature").isin(cols)).select("feature", range_of("cut", edges).alias("bucket"), F.col("cut").alias("value"))
    both = counted.withColumn("cuts", F.lit(0)).unionByName(marks.withColumn("cuts", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy("feature", "bucket").orderBy("value", "cuts").rowsBetween(Window.unboundedPreceding, 0)
    before = ranges_before(marks.groupBy("feature", "bucket").agg(F.count("*").alias("n")), edges)
    placed = both.withColumn("passed", F.sum("cuts").over(upto)).filter("cuts = 0").join(before, ["feature", "bucket"])
    return placed.groupBy("feature", (F.col("before") + F.col("passed")).cast("int").alias("bin"), "label").agg(F.sum("n").alias("n"))


def contingency_between(df: DataFrame, label: str, cuts: DataFrame, cols: list[str], strategy: str, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """(feature, bin, label, n) from a table of cuts: evenly spaced ones by arithmetic, `most` others by search in the pass, more by a rank join."""
    if strategy == EQUAL_WIDTH:
        return even_counts(df, label, cut_ends(cuts))
    if cuts.count() <= most:
        return contingency(df, label, cut_lists(cuts), strategy)
    return rank_join(df, label, cuts, cols, rows)


def contingency(df: DataFrame, label: str, cuts: dict[str, list[float]], strategy: str) -> DataFrame:
    """(feature, bin, label, n): rows per bin and class, combined before the shuffle.

    Equal width: the bin is found by arithmetic and closed on the left; values outside the
    cuts, possible when these came from a sample, go to the nearest bin. Equal frequency: the
    bin is the number of cuts below the value, so it is closed on the right; long lists of cuts are searched on
    Arrow batches.
    """
    if strategy == EQUAL_FREQUENCY and max(map(len, cuts.values()), default=0) > CASE_LIMIT:
        found = ranks(list(cuts.values()))(F.array(*[F.col(c).cast("double") for c in cuts]))
        placed = df.select(F.col(label).alias("label"), found.alias("bins"))
        names = F.array(*[F.lit(c) for c in cuts])
        long = placed.select("label", F.posexplode("bins").alias("at", "bin")).groupBy("at", "bin", "label").agg(F.count("*").alias("n"))
        return long.select(F.get(names, F.col("at")).alias("feature"), "bin", "label", "n")
    if strategy == EQUAL_WIDTH:
        return even_counts(df, label, {c: (e[0], e[-1], len(e)) for c, e in cuts.items()})
    parts = [F.struct(F.lit(name).alias("feature"), rank_of(F.col(name).cast("double"), edges).cast("int").alias("bin")) for name, edges in cuts.items()]
    long = opened(df, [F.col(label).alias("label")], parts, sum(len(v) for v in cuts.values()))
    return long.groupBy("feature", "bin", "label").agg(F.count("*").alias("n"))


def even_counts(df: DataFrame, label: str, ends: dict[str, tuple[float, float, int]]) -> DataFrame:
    """The same for evenly spaced cuts, from the first, the last and the number of each column's."""
    parts = []
    for name, (lo, hi, cuts) in ends.items():
        x, inner = F.col(name).cast("double"), cuts - 1
        place = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(inner))) if hi > lo else F.lit(0)
        place = F.greatest(F.lit(0), F.least(place.cast("int"), F.lit(inner - 1)))
        parts.append(F.struct(F.lit(name).alias("feature"), place.cast("int").alias("bin")))
    return opened(df, [F.col(label).alias("label")], parts, 0).groupBy("feature", "bin", "label").agg(F.count("*").alias("n"))
