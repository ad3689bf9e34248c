"""Fuzzy sets, t-norms, impurities and lookups on small fixed inputs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from mistgrove import nominal, numeric
from mistgrove.functions import impurity as imp
from mistgrove.functions import membership as mem
from mistgrove.functions.lookup import double_array, rank_of
from mistgrove.operators.bins import (
    bin_features, coordinate, partition_table, sets_of, uniform_cores, with_coords,
)
from mistgrove.operators.splits import bin_plan, split_kind, subset_splits


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def membership_table(spark, feature, xs):
    points = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", F.inline(sets_of(feature)))
    mu = mem.triangular_membership(F.col("x"), F.col("a"), F.col("b"), F.col("c"))
    inside = mem.in_support(F.col("x"), F.col("a"), F.col("c"))
    return {(r.x, r.bin): (r.mu, r.inside) for r in points.select("x", "bin", mu.alias("mu"), inside.alias("inside")).collect()}


def test_triangular_partition_over_five_points(spark):
    feature = numeric("x", [3, 1, 2, 5, 4])
    got = membership_table(spark, feature, [-0.5, -1, 1, 1.5, 2, 2.5, 3, 4, 5, 5.5])
    assert got[1.0, 0] == (1.0, True) and got[2.0, 0] == (0.0, False)
    assert got[-0.5, 0] == (1.0, True) and got[4.0, 0][1] is False
    assert got[5.0, 4] == (1.0, True) and got[4.0, 4] == (0.0, False)
    assert got[5.5, 4] == (1.0, True) and got[3.0, 4][1] is False
    for k in (1, 2, 3):
        assert got[float(k + 1), k][0] == 1.0 and got[1.0, k][0] == 0.0 and got[-1.0, k][1] is False
    assert got[1.5, 0][0] == got[1.5, 1][0] == 0.5


def test_singleton_partition(spark):
    rows = partition_table(spark, [nominal("x", 5)]).collect()
    assert sorted((r.bin, r.b) for r in rows) == [(k, float(k)) for k in range(5)]
    assert one(spark, mem.singleton_membership(F.lit(3.0), F.lit(3.0))) == 1.0
    assert one(spark, mem.singleton_membership(F.lit(-1.0), F.lit(3.0))) == 0.0


def test_membership_of_nan_is_zero(spark):
    nan = F.lit(float("nan"))
    assert one(spark, mem.triangular_membership(nan, F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0))) == 0.0


def test_triangular_set_sorts_its_parameters(spark):
    t = one(spark, mem.triangular_set(F.lit(3.0), F.lit(1.0), F.lit(2.0)))
    assert (t.a, t.b, t.c) == (1.0, 2.0, 3.0)


def test_tnorms(spark):
    assert one(spark, mem.tnorm_product(F.lit(0.5), F.lit(0.25))) == 0.125
    assert one(spark, mem.tnorm_min(F.lit(0.5), F.lit(0.25))) == 0.25
    assert one(spark, mem.tnorm("MIN")()) == one(spark, mem.tnorm("Product")()) == 1.0
    with pytest.raises(ValueError):
        mem.tnorm("sum")


def test_uniform_cores():
    assert uniform_cores(5) == [0.0, 0.25, 0.5, 0.75, 1.0]
    with pytest.raises(ValueError):
        uniform_cores(1)


def test_equal_cores_are_merged():
    assert numeric("x", [1, 1, 2]).cores == (1.0, 2.0)
    with pytest.raises(ValueError):
        numeric("x", [1, 1])


def test_entropies(spark):
    assert one(spark, imp.entropy(double_array([5, 5]))) == pytest.approx(1.0)
    assert one(spark, imp.entropy(double_array([0, 7]))) == 0.0
    assert one(spark, imp.entropy(double_array([0, 0]))) == 0.0
    sets = F.array(double_array([4, 4]), double_array([8, 0]))
    assert one(spark, imp.weighted_impurity(sets, F.lit(16.0))) == pytest.approx(0.5)


def test_node_measures(spark):
    assert one(spark, imp.node_purity(double_array([3, 1]))) == 0.75
    assert one(spark, imp.node_purity(double_array([0, 0]))) is None
    assert one(spark, imp.class_shares(double_array([0, 0]))) == [0.0, 0.0]
    assert one(spark, imp.is_mono_label(double_array([0, 2]))) is True


def test_mdlp(spark):
    def accept(gain, prior, total, k, term):
        return one(spark, imp.mdlp_accept(*[F.lit(float(v)) for v in (gain, prior, total)], F.lit(k), F.lit(float(term))))

    bound = (math.log2(99) + math.log2(3**2 - 2) - (2 * 1.0 - 0.5)) / 100
    assert accept(bound + 1e-9, 1.0, 100, 2, 0.5) is True
    assert accept(bound - 1e-9, 1.0, 100, 2, 0.5) is False


def test_category_subset(spark):
    assert one(spark, imp.category_subset(F.lit(13), F.lit(10))) == [3, 2, 0]


def test_bins_of_nominal_and_ordered_columns(spark):
    ordered, unordered = nominal("x", 10), nominal("x", 3)
    assert split_kind(numeric("x", range(100, 1000, 100)), 2, 100) == "numeric"
    assert split_kind(nominal("x", 2), 2, 100) == "ordered"
    assert split_kind(unordered, 100, 100) == "unordered"
    assert split_kind(ordered, 100, 100) == "ordered"
    table = spark.createDataFrame([(0, "nominal", 2), (1, "nominal", 10), (2, "nominal", 3), (3, "numeric", 9)],
                                  "feature int, kind string, bins int")
    two = {r.feature: r.splits for r in bin_plan(table, 2, 100).collect()}
    assert (two[0], two[1]) == (1, 9)
    many = {r.feature: (r.split_kind, r.slots, r.splits) for r in bin_plan(table, 100, 100).collect()}
    assert many[1] == ("ordered", 10, 9) and many[2] == ("unordered", 6, 3) and many[3] == ("numeric", 9, 8)
    subsets = subset_splits(table.filter("feature = 2")).orderBy("split").collect()
    assert [r.left_bins for r in subsets] == [[0], [1], [1, 0]]


@pytest.mark.parametrize("size", [1, 5, 64, 65, 1000])
@pytest.mark.parametrize("inclusive", [False, True])
def test_rank_of_is_a_count(spark, size, inclusive):
    draw = random.Random(size)
    values = sorted(draw.randrange(200) / 4 for _ in range(size))
    xs = [draw.randrange(-8, 220) / 4 for _ in range(300)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(rank_of(F.col("x"), values, inclusive)).collect()
    want = [sum(v <= x if inclusive else v < x for v in values) for x in xs]
    assert [r[0] for r in got] == want


@pytest.mark.parametrize("sets", [2, 5, 200])
def test_memberships_sum_to_one(spark, sets):
    draw = random.Random(sets)
    feature = numeric("x", [draw.random() for _ in range(sets)])
    rows = spark.createDataFrame([(draw.random() * 1.4 - 0.2,) for _ in range(200)] + [(c,) for c in feature.cores], "x double")
    fired = bin_features(rows.withColumnRenamed("x", "k").withColumn("x", F.col("k")), [feature], "k")
    total = F.aggregate("x", F.lit(0.0), lambda acc, p: acc + p["mu"])
    assert all(r[0] == pytest.approx(1.0) for r in fired.select(total).collect())
    out = with_coords(rows, [feature], "x").select("x", F.get("coords", F.lit(0)).alias("c")).collect()
    cores = feature.cores
    for r in out:
        k = sum(c <= r.x for c in cores) - 1
        if k < 0 or k == len(cores) - 1:
            assert r.c == max(k, 0)
        else:
            assert r.c == pytest.approx(k + (r.x - cores[k]) / (cores[k + 1] - cores[k]), abs=1e-12)


def test_undeclared_category_fires_nothing(spark):
    rows = spark.createDataFrame([(0,), (1,), (-1,), (2,)], "x int")
    got = [list(map(tuple, r[0])) for r in bin_features(rows, [nominal("x", 2)]).collect()]
    assert got == [[(0, 1.0)], [(1, 1.0)], [], []]
    assert [r[0] for r in rows.select(coordinate(nominal("x", 2))).collect()] == [0.0, 1.0, -1.0, -1.0]
