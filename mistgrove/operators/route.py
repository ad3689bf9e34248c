"""Sending rows down a tree as joins with the table of splits.

The fan-out opens a constant array of sides (0: lower bin or left child, 1: upper bin or right
child) and derives the child by arithmetic. Together with the scan and the partial sums this
stays one fused stage whose generated method is small enough for the JVM to compile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from mistgrove.functions.membership import tnorm as tnorm_named
from mistgrove.operators.bins import lower_bin, upper_degree

ROOT = 1


def at_root(fuzzy_rows: DataFrame, *keep: str) -> DataFrame:
    """Every row at the root with activation 1."""
    return fuzzy_rows.select(
        F.lit(ROOT).cast("bigint").alias("node_id"), F.lit(1.0).alias("activation"), "coords", *keep
    )


def join_splits(routed: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows with the split of the node they are at; pass `splits` through `small_side`."""
    return routed.join(splits, "node_id")


def root_split(routed: DataFrame, split: Row) -> DataFrame:
    """The same for the root, whose single split needs no join."""
    types = {"split_feature": "int", "first_child": "bigint", "left_bins": "array<int>"}

    def literal(name: str) -> Column:
        value = split[name]
        return (F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)).cast(types[name])

    return routed.withColumns({name: literal(name) for name in types if name in split})


def _sides(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def descend_multi(here: DataFrame, keep: list[str], tnorm: str = "product") -> DataFrame:
    """Rows at the children of their multi-way split: one per fired bin.

    `here` has node_id, activation, coords, split_feature and first_child. An undeclared
    category fires no bin, so its row ends here.
    """
    t = tnorm_named(tnorm)
    coord = F.col("coord")
    up = upper_degree(coord)
    sides = F.when(up > 0, _sides(0, 1)).when(coord >= 0, _sides(0)).otherwise(_sides())
    opened = here.withColumn("coord", F.get("coords", F.col("split_feature"))).select(
        "activation", "first_child", "coord", *keep, F.explode_outer(sides).alias("side")
    ).filter("side is not null")
    degree = F.when(F.col("side") == 0, 1.0 - up).otherwise(up)
    return opened.select(
        (F.col("first_child") + lower_bin(coord) + F.col("side")).alias("node_id"),
        t(F.col("activation"), degree).alias("activation"), *keep,
    )


def descend_binary(here: DataFrame, keep: list[str], tnorm: str = "product") -> DataFrame:
    """Rows at the children of their binary split in training.

    `here` has node_id, activation, crossed, coords, split_feature and left_bins. All fired bins
    left: left child. None left: right child. Else both, with the t-norm applied only the first
    time the row is parted on that feature, as `crossed` remembers.
    """
    t = tnorm_named(tnorm)
    coord, feature, side = F.col("coord"), F.col("split_feature"), F.col("side")
    low, up = lower_bin(coord), upper_degree(coord)
    low_left = F.array_contains("left_bins", low)
    high_left = F.when(up > 0, F.array_contains("left_bins", low + 1)).otherwise(low_left)
    marked = here.withColumn("coord", F.get("coords", feature)).withColumns({
        "low_left": low_left, "parted": low_left != high_left,
    })
    sides = F.when(F.col("parted"), _sides(0, 1)).when(F.col("low_left"), _sides(0)).otherwise(_sides(1))
    opened = marked.select(
        "node_id", "activation", "crossed", "split_feature", "coord", "low_left", *keep,
        (F.col("parted") & ~F.array_contains("crossed", feature)).alias("fresh"), "parted",
        F.explode_outer(sides).alias("side"),
    )
    lower_side = F.col("low_left") == (side == 0)
    degree = F.when(lower_side, 1.0 - up).otherwise(up)
    return opened.select(
        (F.col("node_id") * 2 + side).alias("node_id"),
        F.when(F.col("fresh"), t(F.col("activation"), degree)).otherwise(F.col("activation")).alias("activation"),
        F.when(F.col("fresh"), F.array_append("crossed", feature)).otherwise(F.col("crossed")).alias("crossed"),
        *keep,
    )


def route_multi(routed: DataFrame, splits: DataFrame, tnorm: str = "product") -> DataFrame:
    """One level down a multi-way tree; rows at nodes without a split are dropped."""
    keep = [c for c in routed.columns if c not in ("node_id", "activation")]
    return descend_multi(join_splits(routed, splits), keep, tnorm)


def route_binary(routed: DataFrame, splits: DataFrame, tnorm: str = "product") -> DataFrame:
    """One level down a binary tree in training; rows at nodes without a split are dropped."""
    keep = [c for c in routed.columns if c not in ("node_id", "activation", "crossed")]
    return descend_binary(join_splits(routed, splits), keep, tnorm)
