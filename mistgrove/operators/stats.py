"""Distributed sums of memberships per (node, feature, bin, class)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mistgrove.functions.impurity import entropy
from mistgrove.functions.membership import tnorm as tnorm_named
from mistgrove.operators.bins import lower_bin, upper_degree

STATS_KEYS = ["node_id", "feature", "bin", "label"]


def node_stats(routed: DataFrame, tnorm: str = "product", binary: bool = False) -> DataFrame:
    """(node_id, feature, bin, label, u, freq) over the rows `routed` to the nodes being split.

    `u` sums t-norm(membership, activation), `freq` counts rows with a membership above 0.
    A coordinate stands for its lower and its upper bin, so each row gives one record per
    feature that carries both sums; partial aggregation folds them before anything is shuffled.
    The two halves are laid out as bins afterwards, on the aggregated rows. (`coords` is never
    empty; the outer form only spares the optimizer's extra filter on its size.)

    Multi-way: features in the node's `used` list are left out, since no split may use them.
    Binary: a feature in the node's `allowed` map has membership 1 for its allowed fired bins.
    """
    t = tnorm_named(tnorm)
    act = F.col("activation")
    opened = routed.select("node_id", "activation", "label", *(["allowed"] if binary else ["used"]),
                           F.posexplode_outer("coords").alias("feature", "coord"))
    if binary:
        opened = opened.withColumn("permitted", F.try_element_at("allowed", F.col("feature")))
    else:
        opened = opened.filter(~F.array_contains("used", F.col("feature")))
    low, up = lower_bin(F.col("coord")), upper_degree(F.col("coord"))

    def side(bin_: Column, hit: Column, degree: Column) -> tuple[Column, Column]:
        if binary:
            first_use = F.col("permitted").isNull()
            hit = hit & (first_use | F.array_contains("permitted", bin_))
            degree = F.when(first_use, degree).otherwise(1.0)
        return hit, F.when(hit, t(degree, act)).otherwise(0.0)

    low_hit, low_u = side(low, F.col("coord") >= 0, 1.0 - up)
    high_hit, high_u = side(low + 1, up > 0, up)
    folded = opened.groupBy("node_id", "feature", low.alias("low"), "label").agg(
        F.sum(low_u).alias("u0"), F.count_if(low_hit).alias("f0"),
        F.sum(high_u).alias("u1"), F.count_if(high_hit).alias("f1"),
    )
    halves = F.array(
        F.struct(F.col("low").alias("bin"), F.col("u0").alias("u"), F.col("f0").alias("freq")),
        F.struct((F.col("low") + 1).alias("bin"), F.col("u1").alias("u"), F.col("f1").alias("freq")),
    )
    # Laid out by node: all later sums and rankings are per node and need no further exchange.
    # A node has at most bins x classes rows here, however many rows of data it holds.
    return (
        folded.repartition("node_id")
        .select("node_id", "feature", "label", F.inline(halves)).filter("freq > 0")
        .groupBy(*STATS_KEYS).agg(F.sum("u").alias("u"), F.sum("freq").alias("freq"))
    )


def class_arrays(classes: int, u: str = "u", freq: str = "freq") -> list[Column]:
    """Aggregates turning long class rows into the arrays `u` and `freq`."""

    def spread(value: str, zero: Column) -> Column:
        return F.array(*[
            F.sum(F.when(F.col("label") == j, F.col(value)).otherwise(zero)) for j in range(classes)
        ])

    return [spread(u, F.lit(0.0)).alias("u"), spread(freq, F.lit(0)).cast("array<double>").alias("freq")]


def node_predict(stats: DataFrame, classes: int) -> DataFrame:
    """(node_id, u, freq, impurity) of nodes, from the bins of the first feature.

    Partitions are strong, so `u` is the same for every feature; `freq` counts a row once per
    fired bin of that first feature.
    """
    first = stats.filter("feature = 0").groupBy("node_id").agg(*class_arrays(classes))
    return first.withColumn("impurity", entropy(F.col("u")))
