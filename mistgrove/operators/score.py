"""Scoring: class confidences from all leaves a row reaches, and the predicted class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mistgrove.functions.impurity import class_shares
from mistgrove.functions.lookup import arrow_matrix
from mistgrove.operators.bins import with_coords
from mistgrove.operators.descent import FlatTree, descend_batch, root_state
from mistgrove.plans.trees import TreeModel

#: Nodes, and nodes x bins, that one stage of scoring holds; a larger tree takes more stages.
STAGE_NODES, STAGE_CELLS = 100_000, 50_000_000


def flat_tree(model: TreeModel, first: int, last: int) -> FlatTree:
    """The nodes numbered first to last as arrays: as many as one stage holds."""
    nodes = model.nodes.where(F.col("node_id").between(first, last)).withColumn("share", class_shares(F.col("u"))).select(
        "node_id", "split_feature", "first_child", "left_bins", "share"
    ).orderBy("node_id").collect()
    left = None
    if model.kind == "binary":
        left = np.zeros((len(nodes), max(f.bins for f in model.features)), bool)
        for i, n in enumerate(nodes):
            left[i, n.left_bins or []] = True
    return FlatTree(
        np.array([n.node_id for n in nodes], np.int64),
        np.array([-1 if n.split_feature is None else n.split_feature for n in nodes], np.int64),
        np.array([-1 if n.first_child is None else n.first_child for n in nodes], np.int64),
        np.array([n.share for n in nodes], np.float64).reshape(len(nodes), model.classes), left, model.tnorm.lower() == "product",
    )


def runs(model: TreeModel, stage_nodes: int) -> list[tuple[int, int]]:
    """First and last node number of runs of about half of, never more than, what a stage holds."""
    most = max(1, min(stage_nodes, STAGE_CELLS // max(f.bins for f in model.features)))
    span = model.nodes.agg(F.count("*").alias("n"), F.max("node_id").alias("last")).first()
    if span.n <= most:
        return [(1, span.last)]
    # exact ranks by counting ranges of numbers, which are even enough after a few halvings
    cut, ranges = [], [(1, span.last)]
    while ranges:
        edges = F.lit(None).cast("int")
        for k, (lo, hi) in enumerate(ranges):
            edges = F.when(F.col("node_id").between(lo, hi), k).otherwise(edges)
        held = {r.part: r.n for r in model.nodes.groupBy(edges.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a range
        large = [r for k, r in enumerate(ranges) if held.get(k, 0) > most]
        cut += [r for k, r in enumerate(ranges) if 0 < held.get(k, 0) <= most]
        ranges = [half for lo, hi in large for half in ((lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi))]
    return sorted(cut)


def scores_in_place(model: TreeModel, stage_nodes: int = STAGE_NODES):
    """A function of the `coords` column giving the class confidences, an array empty if no leaf fired.

    It works on Arrow batches of map-only stages, so it needs no row key and no shuffle and
    serves streaming tables as well. A row opens into many leaves and closes again, which
    built-in operators can only do with a shuffle on a row key or with interpreted lambdas.
    A tree of any size is scored the same way: nodes are numbered from the root down, a stage holds one run of them
    (sent out as a broadcast), and rows take the places that are beyond it to the next. One Python worker of a task takes
    a batch through all stages: as expressions of their own, each stage would keep a worker and a queue of rows in every task.
    """
    width, classes, binary = len(model.features), model.classes, model.kind == "binary"
    context = model.nodes.sparkSession.sparkContext
    trees = [context.broadcast(flat_tree(model, *run)) for run in runs(model, stage_nodes)]

    @F.arrow_udf("array<double>")
    def scores(coords: pa.Array) -> pa.Array:
        rows, places = len(coords), arrow_matrix(coords, width)
        state, totals, hit = root_state(rows, width, binary), np.zeros((rows, classes)), np.zeros(rows, bool)
        for tree in trees:
            if not len(state[0]):
                break
            state = descend_batch(tree.value, places, state, totals, hit)
        ends = np.concatenate([[0], np.cumsum(np.where(hit, classes, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(totals[hit].ravel()))

    return scores


def predict_class(scores: Column) -> Column:
    """The class of the highest score, the later one among equals; -1 when no leaf fired."""
    numbered = F.transform(scores, lambda v, j: F.struct(F.round(v, 12).alias("score"), j.alias("label")))
    return F.coalesce(F.array_max(numbered)["label"], F.lit(-1)).cast("int")


def score_table(df: DataFrame, model: TreeModel, keep: list[str], stage_nodes: int = STAGE_NODES) -> DataFrame:
    """The kept columns, `scores` (one confidence per class) and `prediction` for every row."""
    scored = with_coords(df, model.features, *keep).withColumn("scores", scores_in_place(model, stage_nodes)("coords")).drop("coords")
    return scored.withColumn("prediction", predict_class(F.col("scores")))


def score_rows(scored: DataFrame, *keep: str) -> DataFrame:
    """Long form (kept columns, label, score) of the confidences.

    The outer form spares the optimizer's filter on the array's size, which would score every row a second time.
    """
    opened = scored.select(*keep, F.posexplode_outer("scores").alias("__label", "score")).filter("__label is not null")
    return opened.withColumnRenamed("__label", "label")
