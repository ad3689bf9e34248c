"""Training of multi-way and binary fuzzy trees, one pass over the table per level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mistgrove.features import Feature
from mistgrove.functions.impurity import array_total, node_purity
from mistgrove.functions.lookup import double_array
from mistgrove.operators.bins import with_coords
from mistgrove.operators.encode import check_bins, validate
from mistgrove.operators.route import (
    at_root, descend_binary, descend_multi, root_split, route_binary, route_multi,
)
from mistgrove.operators.splits import allowed_bins, best_split_binary, best_split_multi
from mistgrove.operators.stats import node_predict, node_stats
from mistgrove.storage import discard, settle, small_side, spread, written

#: Fuzzified rows of at most this size are kept between levels; larger tables are scanned again,
#: which costs less than storing them.
KEEP_BYTES = 4 << 30

#: After so many levels the frontier, all rows at their open nodes, is written; later levels start there, not at the root.
STRIDE = 4

#: Chosen splits carry class sums of their children; only so many are sent to every executor.
WIDE_ROWS = 5_000

PATH = "array<struct<feature:int,bins:array<int>,inside:boolean>>"
ALLOWED = "map<int,array<int>>"
NODE_COLUMNS = [
    "node_id", "parent_id", "level", "split_feature", "first_child", "left_bins", "path", "allowed",
    "is_leaf", "gain", "impurity", "u", "freq",
]


@dataclass(frozen=True)
class TreeModel:
    """A trained tree: its nodes as a table, and what is needed to read them."""

    kind: str  # 'multi' | 'binary'
    nodes: DataFrame
    features: list[Feature]
    classes: int
    tnorm: str


@dataclass(frozen=True)
class TreeOptions:
    """Stopping rules of tree growth."""

    max_depth: int
    max_bins: int = 32
    min_instances: int = 1
    min_fuzzy: float = 0.0
    purity: float = 1.0
    min_gain: float = 1e-6

    def __post_init__(self) -> None:
        if not 0 <= self.max_depth <= 30:
            raise ValueError("the depth must lie between 0 and 30")


def bin_index(features: list[Feature]) -> Column:
    """Number of bins of each feature, as a constant array."""
    return double_array([f.bins for f in features]).cast("array<int>")


def _root(stats: DataFrame, classes: int) -> DataFrame:
    """The root as a one-row table of open nodes."""
    return node_predict(stats, classes).select(
        "node_id", F.lit(0).cast("bigint").alias("parent_id"), F.lit(0).alias("level"),
        F.array().cast(PATH).alias("path"), F.create_map().cast(ALLOWED).alias("allowed"),
        "impurity", "u", "freq",
    )


def _decide(open_nodes: DataFrame, best: DataFrame, options: TreeOptions) -> DataFrame:
    """Open nodes with their best split, or marked as leaves."""
    joined = open_nodes.join(best, "node_id", "left")
    leaf = (
        F.col("gain").isNull() | (F.col("gain") <= 0) | (F.col("level") == options.max_depth)
        | (node_purity(F.col("u")) >= options.purity)
    )
    decided = joined.withColumn("is_leaf", F.coalesce(leaf, F.lit(True)))
    return decided.withColumn("split_feature", F.when(~F.col("is_leaf"), F.col("feature"))).drop("feature")


def _child_leaf(options: TreeOptions, few: Column) -> Column:
    return (
        (F.col("level") == options.max_depth) | (F.col("impurity") <= 0) | few
        | (array_total(F.col("u")) <= options.min_fuzzy)
    )


def _multi_children(split: DataFrame, features: list[Feature], classes: int, options: TreeOptions) -> DataFrame:
    """One child per bin of the split column, empty bins included."""
    zeros = F.array(*[F.lit(0.0)] * classes)
    empty = F.struct(zeros.alias("u"), zeros.alias("freq"), F.lit(0.0).alias("impurity"))
    part = F.coalesce(F.try_element_at("parts", F.col("bin")), empty)
    bins = F.sequence(F.lit(0), F.get(bin_index(features), F.col("split_feature")) - 1)
    step = F.struct(
        F.col("split_feature").alias("feature"), F.array("bin").alias("bins"), F.lit(True).alias("inside")
    )
    children = split.select("*", F.explode(bins).alias("bin")).withColumn("part", part).select(
        (F.col("first_child") + F.col("bin")).alias("node_id"), F.col("node_id").alias("parent_id"),
        (F.col("level") + 1).alias("level"), F.array_append("path", step).alias("path"), "allowed",
        "part.impurity", "part.u", "part.freq",
    )
    few = array_total(F.col("freq")) <= options.min_instances
    return children.withColumn("is_leaf", _child_leaf(options, few))


def _binary_children(split: DataFrame, features: list[Feature], options: TreeOptions) -> DataFrame:
    """The left child 2i and the right child 2i+1 with the bins each may still use."""
    feature = F.col("split_feature")
    every = F.sequence(F.lit(0), F.get(bin_index(features), feature) - 1)
    before = F.coalesce(F.try_element_at("allowed", feature), every)
    left, right = allowed_bins(before, F.col("left_bins"))
    others = F.map_filter("allowed", lambda k, _: k != F.col("split_feature"))

    def child(offset: int, side: str, usable: Column) -> Column:
        step = F.struct(
            feature.alias("feature"), F.col("left_bins").alias("bins"), F.lit(offset == 0).alias("inside")
        )
        return F.struct(
            (F.col("node_id") * 2 + offset).alias("node_id"), F.col("node_id").alias("parent_id"),
            (F.col("level") + 1).alias("level"), F.array_append("path", step).alias("path"),
            F.map_concat(others, F.create_map(feature, usable)).alias("allowed"),
            F.col(side)["impurity"].alias("impurity"), F.col(side)["u"].alias("u"), F.col(side)["freq"].alias("freq"),
        )

    children = split.select(F.inline(F.array(child(0, "left", left), child(1, "right", right))))
    few = array_total(F.col("freq")) < options.min_instances
    return children.withColumn("is_leaf", _child_leaf(options, few))


def _numbered(decided: DataFrame, features: list[Feature], binary: bool, next_id: int) -> DataFrame:
    """Add `first_child`: 2i in a binary tree, else the next free id of a run in node order.

    The running sum goes over the nodes of one level, not over data.
    """
    if binary:
        return decided.withColumn("first_child", F.when(~F.col("is_leaf"), F.col("node_id") * 2))
    width = F.when(F.col("is_leaf"), 0).otherwise(F.get(bin_index(features), F.col("split_feature")))
    earlier = Window.orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(next_id) + F.coalesce(F.sum("width").over(earlier), F.lit(0))
    return decided.withColumn("width", width).withColumn(
        "first_child", F.when(~F.col("is_leaf"), start.cast("bigint"))
    ).drop("width")


def train_tree(
    df: DataFrame, features: list[Feature], label: str, classes: int, binary: bool, tnorm: str, options: TreeOptions,
    checked: bool = False, stride: int = STRIDE,
) -> TreeModel:
    """Grow a tree level by level.

    Each level is one pass: rows are routed through the splits found since the last frontier by
    joins with small tables, in the same stage as the scan and the partial sums. Every STRIDE levels the frontier is
    written: the coordinates, activation and memory of each row at each node still open. Rows whose
    leaves are all closed are no longer in it. So no level routes through more than STRIDE splits, and the work
    grows with the depth, not with its square. Only the sums per (node, feature, bin, class)
    are shuffled; they and the chosen nodes are kept in the checkpoint folder.
    """
    rows = df.count() if checked else validate(df, features, label, classes)
    max_bins = check_bins(features, options.max_bins, rows, binary)
    fuzzy = with_coords(df, features, F.col(label).cast("int").alias("label"))
    kept = rows * (8 * len(features) + 32) <= KEEP_BYTES
    if kept:
        fuzzy = spread(fuzzy, rows).persist(StorageLevel.MEMORY_AND_DISK)
    state = ["coords", "label"]
    route, descend = (route_binary, descend_binary) if binary else (route_multi, descend_multi)
    all_bins = sum(f.bins for f in features)
    levels: list[tuple[DataFrame, int]] = []  # splits of each level since the frontier and a bound on their number
    frontier, path = at_root(fuzzy, *state), None
    if binary:
        frontier = frontier.withColumn("crossed", F.array().cast("array<int>"))
    finished: list[DataFrame] = []
    open_nodes, open_count, next_id = None, 1, 2
    for level in range(options.max_depth + 1):
        routed = frontier
        for depth, (splits, count) in enumerate(levels):
            if depth == 0 and path is None:
                routed = descend(root_split(routed, first_split), state, tnorm)
            else:
                routed = route(routed, small_side(splits, count), tnorm)
        if len(levels) == stride:
            ids = small_side(open_nodes.select("node_id"), open_count)
            before = path
            frontier, path = written(routed.join(ids, "node_id", "left_semi"), "frontier")
            routed, levels = frontier, []
            if before:
                discard(df.sparkSession, before)
        if level == 0:
            routed = routed.withColumns({
                "allowed": F.create_map().cast(ALLOWED), "used": F.array().cast("array<int>"),
            })
        else:
            limits = open_nodes.select("node_id", "allowed", F.transform("path", lambda p: p["feature"]).alias("used"))
            routed = routed.join(small_side(limits, open_count), "node_id")
        stats = node_stats(routed, tnorm, binary)
        if binary or level == 0:  # read more than once
            stats = settle(stats)
        if level == 0:
            open_nodes = settle(_root(stats, classes))
        parents = small_side(open_nodes.select("node_id", "impurity", "allowed"), open_count)
        if binary:
            sums = small_side(stats, open_count * all_bins * classes)
            best = best_split_binary(sums, parents, features, classes, max_bins, options.min_gain)
            best = best.drop("split")
        else:
            best = best_split_multi(stats, parents, classes, options.min_gain)
        best = small_side(best, open_count, WIDE_ROWS)
        decided = settle(_numbered(_decide(open_nodes, best, options), features, binary, next_id))
        finished.append(decided)
        split = decided.filter(~F.col("is_leaf"))
        children = (
            _binary_children(split, features, options) if binary
            else _multi_children(split, features, classes, options)
        )
        found = children.agg(F.count("*").alias("all"), F.count_if(~F.col("is_leaf")).alias("open")).first()
        finished.append(children.filter("is_leaf"))
        if found.open == 0:
            break
        next_id += found["all"]
        columns = ["node_id", "split_feature", "left_bins" if binary else "first_child"]
        if level == 0:
            first_split = split.select(*columns).first()
        levels.append((split.select(*columns), found["all"]))
        open_nodes, open_count = children.filter(~F.col("is_leaf")).drop("is_leaf"), found.open
    nodes = None
    for part in finished:
        extra = {
            "split_feature": "int", "first_child": "bigint", "left_bins": "array<int>", "gain": "double",
        }
        full = part.withColumns({c: F.lit(None).cast(t) for c, t in extra.items() if c not in part.columns})
        blank = {c: F.when(~F.col("is_leaf"), F.col(c)) for c in ("first_child", "left_bins", "gain")}
        full = full.withColumns(blank).select(*NODE_COLUMNS)
        nodes = full if nodes is None else nodes.unionByName(full)
    nodes = settle(nodes)
    if path:
        discard(df.sparkSession, path)
    if kept:
        fuzzy.unpersist()
    return TreeModel("binary" if binary else "multi", nodes, features, classes, tnorm)


def train_multi(
    df: DataFrame, features: list[Feature], label: str, classes: int, tnorm: str = "product", max_depth: int = 5,
    **options,
) -> TreeModel:
    """Train a multi-way tree: a split opens one child per bin, and a column splits once per path."""
    checked, stride = options.pop("checked", False), options.pop("stride", STRIDE)
    return train_tree(df, features, label, classes, False, tnorm, TreeOptions(max_depth, **options), checked, stride)


def train_binary(
    df: DataFrame, features: list[Feature], label: str, classes: int, tnorm: str = "product", max_depth: int = 10,
    **options,
) -> TreeModel:
    """Train a binary tree: a split parts the bins of one column in two, and columns may be reused."""
    checked, stride = options.pop("checked", False), options.pop("stride", STRIDE)
    return train_tree(df, features, label, classes, True, tnorm, TreeOptions(max_depth, **options), checked, stride)
