"""Trees: against the MLlib tree on crisp data, against each other, and against plain Python."""

from __future__ import annotations

import pickle
import random

import pytest
from conftest import CATEGORICAL, labelled_points
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from mistgrove import nominal, numeric
from mistgrove.operators.bins import with_coords
from mistgrove.operators.describe import tree_rules, tree_stats
from mistgrove.operators.encode import validate
from mistgrove.operators.evaluate import accuracy_stats, confusion_matrix, error_rate
from mistgrove.operators.route import at_root, descend_multi, root_split
from mistgrove.operators.score import flat_tree, predict_class, runs, score_rows, score_table
from mistgrove.operators.stats import node_stats
from mistgrove.plans import trees as trees_module
from mistgrove.plans.trees import train_binary, train_multi

TWO = [nominal("f0", 2), nominal("f1", 2)]
TEN = [nominal("f0", 10), nominal("f1", 10)]
CORES = [numeric("f0", [0, 0.5, 1]), numeric("f1", [0, 0.5, 1])]


def sizes(model):
    r = tree_stats(model).first()
    return r.max_depth, r.nodes, r.leaves


def predictions(df, model):
    return {(r.f0, r.f1): r.prediction for r in score_table(df, model, ["f0", "f1"]).distinct().drop("scores").collect()}


def crisp_tree(df, classes=2):
    vectors = VectorAssembler(inputCols=["f0", "f1"], outputCol="features").transform(df)
    model = DecisionTreeClassifier(impurity="entropy", maxDepth=3, maxBins=100, minInfoGain=1e-6).fit(vectors)
    leaves = (model.numNodes + 1) // 2
    found = {(r.f0, r.f1): int(r.prediction) for r in model.transform(vectors).select("f0", "f1", "prediction").distinct().collect()}
    return (model.depth, model.numNodes, leaves), found


@pytest.mark.parametrize("features", [TWO, TEN, CORES])
def test_binary_tree_equals_crisp_tree(spark, features):
    df = labelled_points(spark, CATEGORICAL)
    model = train_binary(df, features, "label", 2, max_depth=3, max_bins=100)
    size, found = crisp_tree(df)
    assert sizes(model) == size
    assert predictions(df, model) == found


def test_binary_tree_equals_crisp_tree_on_three_classes(spark):
    rows = [(2, 2, 2)] * 1000 + [(1, 1, 2)] * 1000 + [(0, 0, 1)] * 1000
    df = labelled_points(spark, rows)
    model = train_binary(df, [nominal("f0", 3), nominal("f1", 3)], "label", 3, max_depth=3, max_bins=100)
    assert predictions(df, model) == {(2.0, 2.0): 2, (1.0, 2.0): 1, (0.0, 1.0): 0}


@pytest.mark.parametrize("binary_features", [TWO, TEN])
def test_binary_tree_equals_multi_way_tree_on_two_values(spark, binary_features):
    df = labelled_points(spark, CATEGORICAL)
    binary = train_binary(df, binary_features, "label", 2, max_depth=3, max_bins=100)
    multi = train_multi(df, TWO, "label", 2, max_depth=3, max_bins=100)
    assert sizes(binary) == sizes(multi)
    assert predictions(df, binary) == predictions(df, multi)


def banded(spark, rows=600, seed=2):
    draw = random.Random(seed)
    out = []
    for _ in range(rows):
        a, b = draw.random(), draw.random()
        y = 0 if a + 0.3 * b < 0.4 else (1 if a < 0.8 else 2)
        out.append((y if draw.random() < 0.9 else draw.randrange(3), a, b))
    return labelled_points(spark, out)


FUZZY = [numeric("f0", [0, 0.2, 0.4, 0.6, 0.8, 1]), numeric("f1", [0, 0.3, 0.6, 1])]


def memberships(feature, x):
    cores = feature.cores
    if x <= cores[0]:
        return {0: 1.0}
    if x >= cores[-1]:
        return {len(cores) - 1: 1.0}
    k = max(i for i, c in enumerate(cores) if c <= x)
    up = (x - cores[k]) / (cores[k + 1] - cores[k])
    return {k: 1.0} if up == 0 else {k: 1.0 - up, k + 1: up}


def score_multi(nodes, row, features, norm, at=1, act=1.0):
    node = nodes[at]
    if node.split_feature is None:
        total = sum(node.u)
        return [u / total * act if total > 0 else 0.0 for u in node.u]
    fired = memberships(features[node.split_feature], row[node.split_feature])
    parts = [score_multi(nodes, row, features, norm, node.first_child + b, norm(act, mu)) for b, mu in fired.items()]
    return [sum(p) for p in zip(*parts)]


def score_binary(nodes, row, features, norm, at=1, act=1.0, memory=None):
    memory, node = memory or {}, nodes[at]
    if node.split_feature is None:
        total = sum(node.u)
        return [u / total * act if total > 0 else 0.0 for u in node.u]
    f, left = node.split_feature, set(node.left_bins)
    fired = memberships(features[f], row[f])
    inside = [b for b in fired if b in left]
    s = round(sum(fired[b] for b in inside), 12)

    def go(right, activation, kept):
        return score_binary(nodes, row, features, norm, 2 * at + right, activation, kept)

    if f not in memory:
        if s == 0:
            return go(1, act, memory)
        if s == 1:
            return go(0, act, memory)
        parts = go(0, norm(act, s), {**memory, f: max(inside)}), go(1, norm(act, 1 - s), {**memory, f: -1})
        return [x + y for x, y in zip(*parts)]
    if memory[f] != -1:
        return go(0 if memory[f] in left else 1, act, memory)
    return go(0, act, {**memory, f: max(inside)}) if s > 0 else go(1, act, memory)


@pytest.mark.parametrize("tnorm", ["product", "min"])
@pytest.mark.parametrize("binary", [False, True])
def test_scores_against_recursion(spark, binary, tnorm):
    df = banded(spark)
    train = train_binary if binary else train_multi
    model = train(df, FUZZY, "label", 3, tnorm=tnorm, max_depth=6 if binary else 2)
    nodes = {n.node_id: n for n in model.nodes.collect()}
    norm = (lambda x, y: x * y) if tnorm == "product" else min
    walk = score_binary if binary else score_multi
    keep = ["f0", "f1", "label"]
    scored = {(r.f0, r.f1): r for r in score_table(df, model, keep).collect()}
    joined = {(r.f0, r.f1): r for r in score_table(df, model, keep, stage_nodes=3).collect()}
    for key, r in scored.items():
        want = walk(nodes, key, FUZZY, norm)
        assert r.scores == pytest.approx(want, abs=1e-9)
        assert joined[key].scores == pytest.approx(want, abs=1e-9)
        assert r.prediction == joined[key].prediction
        if tnorm == "product" and not binary:
            assert sum(r.scores) == pytest.approx(1.0)
    paths = [[s.feature for s in n.path] for n in nodes.values()]
    reused = any(len(set(p)) < len(p) for p in paths)
    assert reused == binary  # a column is used again on a path only in a binary tree
    right = sum(r.label == r.prediction for r in scored.values())
    assert right / len(scored) > 0.75


def test_statistics_against_brute_force(spark):
    df = banded(spark, 300)
    rows = at_root(with_coords(df, FUZZY, "label"), "label").withColumn("used", F.array().cast("array<int>"))
    got = {(r.feature, r.bin, r.label): (r.u, r.freq) for r in node_stats(rows).collect()}
    want: dict = {}
    for r in df.collect():
        for f, feature in enumerate(FUZZY):
            for b, mu in memberships(feature, (r.f0, r.f1)[f]).items():
                u, n = want.get((f, b, r.label), (0.0, 0))
                want[f, b, r.label] = (u + mu, n + 1)
    assert set(got) == set(want)
    for k, (u, n) in want.items():
        assert got[k][1] == n and got[k][0] == pytest.approx(u)
    for f in (0, 1):  # a strong partition: every column carries the whole table
        assert sum(u for (g, _, _), (u, _) in got.items() if g == f) == pytest.approx(300)


@pytest.mark.parametrize("least, least_fuzzy", [(80, 50.0), (50, 50.0)])
def test_inner_nodes_hold_enough_rows(spark, least, least_fuzzy):
    df = banded(spark)
    for train in (train_binary, train_multi):
        model = train(df, FUZZY, "label", 3, max_depth=5, min_instances=least, min_fuzzy=least_fuzzy)
        inner = [n for n in model.nodes.collect() if not n.is_leaf]
        assert inner
        assert all(sum(n.freq) >= least and sum(n.u) >= least_fuzzy for n in inner)


def test_node_ids_and_rules(spark):
    df = banded(spark)
    multi = train_multi(df, FUZZY, "label", 3, max_depth=2)
    ids = sorted(n.node_id for n in multi.nodes.collect())
    assert ids == list(range(1, len(ids) + 1))
    rules = tree_rules(multi).collect()
    assert len(rules) == tree_stats(multi).first().leaves
    assert all(" = " in r.rule for r in rules)
    binary = train_binary(df, FUZZY, "label", 3, max_depth=3)
    assert all(n.node_id in (1, 2 * n.parent_id, 2 * n.parent_id + 1) for n in binary.nodes.collect())
    assert any(" not in [" in r.rule for r in tree_rules(binary).collect())


def test_single_leaf_tree(spark):
    df = labelled_points(spark, [(1, 0, 1)] * 5)
    for train in (train_multi, train_binary):
        model = train(df, TWO, "label", 2, max_depth=3)
        assert sizes(model) == (0, 1, 1)
        assert predictions(df, model) == {(0.0, 1.0): 1}
    assert sizes(train_multi(labelled_points(spark, CATEGORICAL), TWO, "label", 2, max_depth=0)) == (0, 1, 1)


def test_unknown_category_gives_no_class(spark):
    model = train_multi(labelled_points(spark, CATEGORICAL), TWO, "label", 2)
    odd = labelled_points(spark, [(0, 5, 5)])
    assert score_table(odd, model, ["label"]).first().prediction == -1
    assert score_rows(score_table(odd, model, ["label"]), "label").count() == 0


def test_later_class_wins_ties(spark):
    arrays = spark.createDataFrame([([0.5, 0.5, 0.0],), ([0.2, 0.1, 0.2],), ([],)], "s array<double>")
    assert [r[0] for r in arrays.select(predict_class(F.col("s"))).collect()] == [1, 2, -1]


def test_options_are_checked(spark):
    df = labelled_points(spark, CATEGORICAL)
    with pytest.raises(ValueError):
        train_multi(df, TWO, "label", 2, max_depth=31)
    with pytest.raises(ValueError):
        train_binary(df, [nominal("f0", 200), nominal("f1", 2)], "label", 2)
    with pytest.raises(ValueError):
        train_binary(df, [nominal("f0", 2), nominal("f1", 1)], "label", 2)


def test_validation(spark):
    df = labelled_points(spark, [(0, 0, 1), (1, 1, 0)])
    assert validate(df, TWO, "label", 2) == 2
    for rows, message in (([(0, float("nan"), 0)], "f0"), ([(0, 3, 0)], "f0"), ([(2, 0, 0)], "label")):
        features = CORES if rows[0][1] != rows[0][1] else TWO
        with pytest.raises(ValueError, match=message):
            validate(labelled_points(spark, rows), features, "label", 2)
    with pytest.raises(ValueError, match="empty"):
        validate(df.limit(0), TWO, "label", 2)
    with pytest.raises(ValueError, match="missing"):
        validate(df.drop("f1"), TWO, "label", 2)


def test_evaluation(spark):
    rows = [(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)] + [(-1, 0)]
    scored = spark.createDataFrame(rows, "label int, prediction int")
    matrix = confusion_matrix(scored, 2)
    assert {(r.label, r.prediction): r.n for r in matrix.collect()} == {(0, 0): 6, (0, 1): 2, (1, 0): 1, (1, 1): 3}
    got = accuracy_stats(matrix).first()
    assert got.accuracy == 0.75 and got.mean_recall == 0.75 and got.geometric_mean == pytest.approx(0.75)
    assert error_rate(scored).first().error_rate == pytest.approx(4 / 13)
    three = accuracy_stats(confusion_matrix(scored, 3)).first()
    assert three.accuracy == 0.75 and three.mean_recall != three.mean_recall and three.geometric_mean != three.geometric_mean


def test_training_pass_is_one_fused_scan(spark, tmp_path):
    """No Python, no nested loops, only the needed columns, and one exchange before the sums are small."""
    wide = banded(spark, 50).withColumn("unused", F.lit("x"))
    wide.write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    rows = at_root(with_coords(df, FUZZY, "label"), "label").withColumn("used", F.array().cast("array<int>"))
    splits = spark.createDataFrame([(1, 0, 2)], "node_id bigint, split_feature int, first_child bigint")
    limits = spark.createDataFrame([(k, [0]) for k in range(2, 8)], "node_id bigint, used array<int>")
    below = descend_multi(root_split(rows.drop("used"), splits.first()), ["coords", "label"])
    plan = node_stats(below.join(F.broadcast(limits), "node_id"))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapIn" not in plan
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "SortMergeJoin" not in plan
    assert "ReadSchema: struct<label:int,f0:double,f1:double>" in plan
    assert "partial_sum" in plan


@pytest.fixture(scope="module")
def winding(spark):
    """Rows whose class changes often along three columns, so that deep trees keep growing."""
    draw = random.Random(8)
    rows = []
    for _ in range(700):
        a, b, c = (draw.random() for _ in range(3))
        rows.append((int(7 * a + 5 * b * c + 3 * draw.random() ** 4) % 3, a, b, c))
    df = spark.createDataFrame(rows, "y int, a double, b double, c double").repartition(4).cache()
    return df, [numeric(x, [i / 6 for i in range(7)]) for x in "abc"]


@pytest.mark.parametrize("train", [train_binary, train_multi])
def test_frontier_gives_the_same_deep_tree(spark, winding, train):
    df, features = winding
    columns = ["node_id", "parent_id", "level", "split_feature", "is_leaf", "u"]
    trees = []
    for stride in (2, 99):
        nodes = train(df, features, "y", 3, max_depth=6, stride=stride).nodes.select(*columns).collect()
        trees.append(sorted((*r[:5], tuple(round(x, 6) for x in r["u"])) for r in nodes))
    assert trees[0] == trees[1]
    assert max(r[2] for r in trees[0]) == (6 if train is train_binary else 3)


def test_no_level_routes_through_more_than_the_stride(spark, winding, monkeypatch):
    df, features = winding
    joins = []
    stats = trees_module.node_stats

    def seen(routed, *rest):
        joins.append(routed._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return stats(routed, *rest)

    monkeypatch.setattr(trees_module, "node_stats", seen)
    train_binary(df, features, "y", 3, max_depth=9, stride=3)
    assert len(joins) >= 8 and max(joins) <= 4


@pytest.mark.parametrize("train", [train_binary, train_multi])
def test_stages_share_one_worker(spark, winding, train):
    """However many stages a tree takes, a task has one Python worker, and rows opened by class are scored once."""
    df, features = winding
    model = train(df, features, "y", 3, max_depth=4)
    keep = ["a", "b", "c"]
    odd = spark.createDataFrame([tuple(r) for r in df.select(*keep).collect()] + [(None, float("nan"), 0.5)] * 2, "a double, b double, c double")
    whole = score_table(odd, model, keep)
    assert len(runs(model, 4)) > 4
    staged = score_rows(score_table(odd, model, keep, stage_nodes=4), *keep)
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    want = sorted((str((r.a, r.b, r.c)), j, v) for r in whole.collect() for j, v in enumerate(r.scores))
    got = sorted((str((r.a, r.b, r.c)), r.label, r.score) for r in staged.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)


@pytest.mark.parametrize("train", [train_binary, train_multi])
def test_a_sent_run_is_read_from_a_map(spark, winding, train):
    df, features = winding
    model = train(df, features, "y", 3, max_depth=2)
    sent = flat_tree(model, *runs(model, 99)[0])
    got = pickle.loads(pickle.dumps(sent))
    assert got.product == sent.product and (got.left is None) == (sent.left is None)
    for name in ("number", "split", "child", "share", "left"):
        a, b = getattr(sent, name), getattr(got, name)
        if a is not None:
            assert a.dtype == b.dtype and a.shape == b.shape and (a == b).all()
            assert not b.flags.owndata and not b.flags.writeable and b.flags.aligned
