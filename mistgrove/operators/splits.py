"""Candidate splits of the nodes of a level, their gains, and the best one per node."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mistgrove.features import Feature
from mistgrove.functions.impurity import (
    array_total, category_subset, entropy, entropy_from_sums, info_gain, whole_weight, xlogx,
)
from mistgrove.functions.lookup import constant
from mistgrove.operators.stats import class_arrays


def unordered_limit(max_bins: int) -> int:
    """The largest arity whose category subsets all fit in `max_bins`."""
    return math.floor(math.log(max_bins // 2 + 1) / math.log(2.0) + 1)


def split_kind(feature: Feature, classes: int, max_bins: int) -> str:
    """How a binary tree splits a column: by cut (numeric, ordered) or by subset (unordered)."""
    if feature.kind == "numeric":
        return "numeric"
    return "unordered" if classes > 2 and feature.arity <= unordered_limit(max_bins) else "ordered"


def bin_plan(features: DataFrame, classes: int, max_bins: int, binary: bool = True) -> DataFrame:
    """Add (split_kind, slots, splits) to a features table with kind and bins."""
    subsets = (F.col("kind") == "nominal") & F.lit(classes > 2) & (F.col("bins") <= unordered_limit(max_bins))
    kind = F.when(F.col("kind") == "numeric", "numeric").when(subsets, "unordered").otherwise("ordered")
    pairs = (F.pow(F.lit(2.0), F.col("bins") - 1) - 1).cast("int")
    if not binary:
        kind = F.lit("multi")
    return features.withColumn("split_kind", kind).withColumns({
        "slots": F.when(F.col("split_kind") == "unordered", pairs * 2).otherwise(F.col("bins")),
        "splits": F.when(F.col("split_kind") == "unordered", pairs).otherwise(F.col("bins") - 1),
    })


def subset_splits(features: DataFrame) -> DataFrame:
    """(feature, split, left_bins): every way to part the categories of an unordered column."""
    codes = F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.col("bins") - 1) - 1).cast("int"))
    coded = features.select("feature", "bins", F.explode(codes).alias("code"))
    return coded.select(
        "feature", (F.col("code") - 1).alias("split"), category_subset(F.col("code"), F.col("bins")).alias("left_bins")
    )


def plan_constant(features: list[Feature], classes: int, max_bins: int) -> Column:
    """The split plan as a constant array, to be opened next to each node."""
    rows = [{"feature": i, "kind": split_kind(f, classes, max_bins), "bins": f.bins} for i, f in enumerate(features)]
    return constant(rows, "array<struct<feature:int,kind:string,bins:int>>")


def first_best(candidates: DataFrame, *ties: str) -> DataFrame:
    """Per node the candidate of greatest gain; among equals the first by `ties`. Invalid ones are dropped."""
    order = Window.partitionBy("node_id").orderBy(F.round("gain", 12).desc(), *ties)
    valid = candidates.filter(F.col("gain").isNotNull())
    return valid.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def multi_gains(stats: DataFrame, nodes: DataFrame, classes: int, min_gain: float) -> DataFrame:
    """(node_id, feature, gain, parts): the one multi-way split each column allows.

    `parts` maps every non-empty bin to its class sums and impurity. `nodes` gives the impurity
    of each node; pass it through `small_side`. A gain that is too small, or undefined as all
    weights are 0, is null.
    """
    per_bin = stats.groupBy("node_id", "feature", "bin").agg(*class_arrays(classes)).withColumns({
        "impurity": entropy(F.col("u")), "weight": whole_weight(array_total(F.col("u"))),
    })
    part = F.struct("bin", F.struct("u", "freq", "impurity"))
    per_feature = per_bin.groupBy("node_id", "feature").agg(
        F.sum(F.col("impurity") * F.col("weight")).alias("weighted"), F.sum("weight").alias("weight"),
        F.map_from_entries(F.collect_list(part)).alias("parts"),  # at most one entry per bin
    )
    gain = info_gain(F.col("parent"), F.col("weighted"), F.col("weight"), min_gain)
    parents = nodes.select("node_id", F.col("impurity").alias("parent"))
    return per_feature.join(parents, "node_id").select("node_id", "feature", gain.alias("gain"), "parts")


def best_split_multi(stats: DataFrame, nodes: DataFrame, classes: int, min_gain: float = 1e-6) -> DataFrame:
    """(node_id, feature, gain, parts) of the best multi-way split; nodes without a valid one are absent."""
    return first_best(multi_gains(stats, nodes, classes, min_gain), "feature")


def slots(stats: DataFrame, nodes: DataFrame, features: list[Feature], classes: int, max_bins: int) -> DataFrame:
    """(node_id, feature, kind, bin, label, u, freq): the sums of every bin a node may still use, zeros included.

    Laid out by node, so that the orders and running sums below need no exchange. `stats` is
    no larger than the grid it fills; pass it through `small_side`.
    """
    opened = nodes.select("node_id", "allowed").repartition("node_id").select(
        "*", F.inline(plan_constant(features, classes, max_bins))
    )
    every = F.sequence(F.lit(0), F.col("bins") - 1)
    usable = opened.withColumn("usable", F.coalesce(F.try_element_at("allowed", F.col("feature")), every))
    labels = F.sequence(F.lit(0), F.lit(classes - 1))
    grid = usable.select("node_id", "feature", "kind", F.explode("usable").alias("bin")).select(
        "*", F.explode(labels).alias("label")
    )
    return grid.join(stats, ["node_id", "feature", "bin", "label"], "left").fillna(0, ["u", "freq"])


def with_order(slots_: DataFrame, classes: int) -> DataFrame:
    """Add (rank, left_bins): the order in which the bins of a column are cut.

    Numeric bins keep their order. Categories are ordered by entropy with more than two classes,
    by their largest class with two; those whose whole weight is 0 come last; ties by bin.
    `left_bins` are the bins up to and including this one.
    """
    per_bin = Window.partitionBy("node_id", "feature", "bin")
    total = F.sum("u").over(per_bin)
    if classes > 2:
        centroid = F.round(entropy_from_sums(total, F.sum(xlogx(F.col("u"))).over(per_bin)), 12)
    else:
        centroid = F.max(F.struct("u", (-F.col("label")).alias("y"))).over(per_bin)["y"] * F.lit(-1.0)
    key = F.when(F.col("kind") == "numeric", F.col("bin").cast("double")).when(whole_weight(total) != 0, centroid)
    place = F.struct(F.coalesce("key", F.lit(float("inf"))).alias("key"), F.col("bin").alias("bin"))
    every = F.array_sort(F.collect_set(place).over(Window.partitionBy("node_id", "feature")))
    return slots_.withColumn("key", key).withColumns({"place": place, "every": every}).withColumn(
        "rank", F.array_position("every", F.col("place")).cast("int") - 1
    ).withColumn("left_bins", F.slice("every", 1, F.col("rank") + 1)["bin"]).drop("key", "place", "every")


def order_categories(slots_: DataFrame, classes: int) -> DataFrame:
    """(node_id, feature, bin, rank, left_bins): the same, one row per bin."""
    ordered = with_order(slots_, classes).filter("label = 0")
    return ordered.select("node_id", "feature", "bin", "rank", "left_bins")


def running_bins(slots_: DataFrame, classes: int) -> DataFrame:
    """Cut candidates with the class sums of both sides: running sums along the bin order.

    The right side is summed from the other end, so a class that is absent there is exactly 0.
    """
    window = Window.partitionBy("node_id", "feature", "label").orderBy("rank")
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    after = window.rowsBetween(1, Window.unboundedFollowing)
    sums = {f"{side}_{c}": F.sum(c).over(w) for side, w in (("l", upto), ("r", after)) for c in ("u", "freq")}
    ordered = with_order(slots_, classes)
    return ordered.withColumns(sums).filter(F.col("r_u").isNotNull()).select(
        "node_id", "feature", F.col("rank").alias("split"), "left_bins", "label", *sums
    )


def subset_candidates(slots_: DataFrame, features: list[Feature], unordered: list[int]) -> DataFrame:
    """Subset candidates of unordered columns with the class sums of both sides.

    A subset must lie within the node's usable categories and leave at least one out.
    """
    arity = slots_.sparkSession.createDataFrame(
        [(i, features[i].arity) for i in unordered], "feature int, bins int"
    )
    usable = F.collect_set("bin").over(Window.partitionBy("node_id", "feature"))
    fits = (F.size(F.array_except("left_bins", "usable")) == 0) & (F.size("left_bins") < F.size("usable"))
    subsets = F.broadcast(subset_splits(arity))  # unordered columns have at most max_bins / 2 subsets
    inside = F.array_contains("left_bins", F.col("bin"))
    sums = {
        f"{side}_{c}": F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(f"{side}_{c}")
        for side, hit in (("l", inside), ("r", ~inside)) for c in ("u", "freq")
    }
    return slots_.withColumn("usable", usable).join(subsets, "feature").filter(fits).groupBy(
        "node_id", "feature", "split", "left_bins", "label"
    ).agg(*sums.values())


def binary_gains(sides: DataFrame, nodes: DataFrame, classes: int, min_gain: float) -> DataFrame:
    """(node_id, feature, split, left_bins, gain, left, right) of candidates given by `sides`."""
    measures = []
    for s in ("l", "r"):
        u, freq = class_arrays(classes, f"{s}_u", f"{s}_freq")
        measures += [u.alias(f"{s}_us"), freq.alias(f"{s}_fs"), F.sum(f"{s}_u").alias(f"{s}_t"),
                     F.sum(xlogx(F.col(f"{s}_u"))).alias(f"{s}_l")]
    gathered = sides.groupBy("node_id", "feature", "split", "left_bins").agg(*measures).withColumns({
        f"{s}_e": entropy_from_sums(F.col(f"{s}_t"), F.col(f"{s}_l")) for s in ("l", "r")
    })
    weight = {s: whole_weight(F.col(f"{s}_t")) for s in ("l", "r")}
    weighted = F.col("l_e") * weight["l"] + F.col("r_e") * weight["r"]
    gain = info_gain(F.col("parent"), weighted, weight["l"] + weight["r"], min_gain)
    parents = nodes.select("node_id", F.col("impurity").alias("parent"))

    def side(s: str) -> Column:
        return F.struct(F.col(f"{s}_us").alias("u"), F.col(f"{s}_fs").alias("freq"), F.col(f"{s}_e").alias("impurity"))

    return gathered.join(parents, "node_id").select(
        "node_id", "feature", "split", "left_bins", gain.alias("gain"), side("l").alias("left"), side("r").alias("right")
    )


def candidate_gains_binary(
    stats: DataFrame, nodes: DataFrame, features: list[Feature], classes: int, max_bins: int, min_gain: float = 1e-6,
    kinds: tuple[str, ...] = ("numeric", "ordered", "unordered"),
) -> DataFrame:
    """Every binary candidate of the asked kinds with its gain (null when invalid)."""
    all_slots = slots(stats, nodes, features, classes, max_bins)
    present = {split_kind(f, classes, max_bins) for f in features} & set(kinds)
    sides = None
    if present & {"numeric", "ordered"}:
        cut = all_slots.filter(F.col("kind").isin(sorted(present & {"numeric", "ordered"})))
        sides = running_bins(cut, classes)
    if "unordered" in present:
        unordered = [i for i, f in enumerate(features) if split_kind(f, classes, max_bins) == "unordered"]
        parted = subset_candidates(all_slots.filter("kind = 'unordered'"), features, unordered)
        sides = parted if sides is None else sides.unionByName(parted)
    if sides is None:
        raise ValueError(f"no column is split by {kinds}")
    return binary_gains(sides, nodes, classes, min_gain)


def best_split_binary(
    stats: DataFrame, nodes: DataFrame, features: list[Feature], classes: int, max_bins: int, min_gain: float = 1e-6,
    kinds: tuple[str, ...] = ("numeric", "ordered", "unordered"),
) -> DataFrame:
    """The best binary split per node; nodes without a valid one are absent."""
    gains = candidate_gains_binary(stats, nodes, features, classes, max_bins, min_gain, kinds)
    return first_best(gains, "feature", "split")


def allowed_bins(parent: Column, left: Column) -> tuple[Column, Column]:
    """Usable bins of the split column in the left and the right child."""
    return left, F.array_except(parent, left)
