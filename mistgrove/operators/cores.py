"""Class cardinalities of fuzzy sets over binned counts, and the choice of the best new core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mistgrove.functions.impurity import LN2, entropy_from_sums, mdlp_accept, xlogx


def searchable_bins(cuts: DataFrame, counts: DataFrame, classes: int) -> DataFrame:
    """(feature, bin, x, label, n) for every bin the search may use, empty bins included.

    A column with C cuts has bins 0..C; the search covers 0..C-2, where bin i stands at cut i.
    With equal-frequency counts this leaves out the rows between the last inner cut and the
    maximum, which is part of the defined result.
    """
    last = cuts.groupBy("feature").agg(F.max("bin").alias("last"))
    inner = cuts.join(F.broadcast(last), "feature").filter("bin < last")  # a row a column
    labels = F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("label")
    grid = inner.select("feature", "bin", F.col("cut").alias("x"), labels)
    return grid.join(counts, ["feature", "bin", "label"], "left").fillna(0, ["n"])


def range_counts(bins: DataFrame, lo: Column | int, hi: Column | int) -> DataFrame:
    """(feature, label, n): class counts of the bins lo <= bin < hi."""
    inside = (F.col("bin") >= lo) & (F.col("bin") < hi)
    return bins.groupBy("feature", "label").agg(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("n"))


def segment_sums(bins: DataFrame) -> DataFrame:
    """Add what every cardinality is built from, per (feature, seg, label) and bin.

    With d the distance from the segment's first point: `nb`, `mb` are the sums of n and n*d
    over the earlier bins, `nt`, `mt` those of the whole segment, `p` the distance of the
    previous bin's point (the middle core of a candidate), `span` that of the last point.
    """
    group = Window.partitionBy("feature", "seg", "label")
    order = group.orderBy("bin")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        bins.withColumn("d", F.col("x") - F.min("x").over(group))
        .withColumns({
            "nb": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "mb": F.coalesce(F.sum(F.col("n") * F.col("d")).over(before), F.lit(0.0)),
            "nb2": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -2)), F.lit(0)),
            "p": F.lag("d").over(order),
            "nt": F.sum("n").over(group),
            "mt": F.sum(F.col("n") * F.col("d")).over(group),
            "span": F.max("d").over(group),
            "edges": F.first("n").over(full) + F.last("n").over(full),
        })
    )


def two_sets(sums: DataFrame) -> DataFrame:
    """Add `t0`, `t1`: class cardinality of the two sets with cores at the segment's ends.

    A segment of one bin has no two ends: both are 0.
    """
    t1 = F.when(F.col("span") > 0, F.col("mt") / F.col("span")).otherwise(0.0)
    t0 = F.when(F.col("span") > 0, F.col("nt") - t1).otherwise(0.0)
    return sums.withColumns({"t0": t0, "t1": t1})


def three_sets(sums: DataFrame) -> DataFrame:
    """Add `s0`, `s1`, `s2`: class cardinality with a middle core one bin before the candidate.

    Null where that core would sit on the segment's first point.
    """
    left = F.when(F.col("p") > 0, F.col("mb") / F.col("p"))
    rest = F.col("nt") - F.col("nb")
    right = (F.col("mt") - F.col("mb") - rest * F.col("p")) / (F.col("span") - F.col("p"))
    right = F.when((F.col("p") > 0) & (F.col("span") > F.col("p")), right)
    return sums.withColumns({"s0": F.col("nb") - left, "s1": left + rest - right, "s2": right})


def best_cores(
    bins: DataFrame, first_level: bool, min_instances: int, min_gain: float, mdlp: bool = True
) -> DataFrame:
    """(feature, seg, core, gain): per open segment the accepted new core, if any.

    All segments of all columns are searched in one pass of windows. The prior is the crisp
    class entropy on the first level and the entropy of the two end sets below it. The least
    weighted entropy wins, the first bin among equals, and must pass the gain and MDLP tests.
    """
    sums = three_sets(two_sets(segment_sums(bins)))
    # Which classes have members in a set follows from whole counts, free of rounding.
    present = {
        "k0": F.col("nb2") > 0,
        "k1": F.col("nt") - F.col("edges") > 0,
        "k2": F.col("nt") - F.col("nb") > 0,
        "kt": F.col("nt") > 0,
    }
    # Null sets (no valid middle core) are left out below by `p`.
    per_set = [c for s in ("s0", "s1", "s2", "t0", "t1")
               for c in (F.sum(s).alias(f"{s}_t"), F.sum(xlogx(F.col(s))).alias(f"{s}_l"))]
    gathered = sums.groupBy("feature", "seg", "bin").agg(
        F.sum("nb").alias("left"), F.sum("nt").alias("total"), F.sum(xlogx(F.col("nt"))).alias("nt_l"),
        F.first("p").alias("p"), *per_set, *[F.count_if(c).alias(k) for k, c in present.items()],
    )

    def mass(s: str) -> Column:  # entropy times cardinality
        return (xlogx(F.col(f"{s}_t")) - F.col(f"{s}_l")) / LN2

    def bits(s: str) -> Column:
        return entropy_from_sums(F.col(f"{s}_t"), F.col(f"{s}_l"))

    total = F.col("total")
    prior = (xlogx(total) - F.col("nt_l")) / LN2 if first_level else mass("t0") + mass("t1")
    candidates = gathered.filter(
        (total > 0) & (total >= min_instances) & (F.col("left") > min_instances)
        & (total - F.col("left") > min_instances) & (F.col("p") > 0)
    ).select(
        "feature", "seg", "bin", "total", "kt",
        (prior / total).alias("prior"),
        ((mass("s0") + mass("s1") + mass("s2")) / total).alias("entropy"),
        sum((F.col(k) * bits(s) for k, s in (("k0", "s0"), ("k1", "s1"), ("k2", "s2"))), F.lit(0.0)).alias("set_term"),
    )
    ranked = candidates.withColumn(
        "place",
        F.row_number().over(Window.partitionBy("feature", "seg").orderBy(F.round("entropy", 12), "bin")),
    ).filter("place = 1").withColumn("gain", F.col("prior") - F.col("entropy"))
    accepted = ranked.filter(F.col("gain") > min_gain)
    if mdlp:
        accepted = accepted.filter(mdlp_accept(
            F.col("gain"), F.col("prior"), total.cast("double"), F.col("kt"), F.col("set_term")
        ))
    return accepted.select("feature", "seg", F.col("bin").alias("core"), "gain")


def split_segments(bins: DataFrame, cores: DataFrame) -> DataFrame:
    """The bins of the two parts of every segment that got a core; a segment is named by its first bin."""
    parted = bins.join(cores.select("feature", "seg", "core"), ["feature", "seg"])
    seg = F.when(F.col("bin") >= F.col("core"), F.col("core")).otherwise(F.col("seg"))
    return parted.select("feature", "bin", "x", "label", "n", seg.alias("seg"))
