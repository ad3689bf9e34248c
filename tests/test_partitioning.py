"""Quantiles, cuts and the entropy search against plain Python on small tables."""

from __future__ import annotations

import bisect
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mistgrove.operators import cuts as cutting
from mistgrove.operators.cores import best_cores, searchable_bins
from mistgrove.operators.describe import partition_listing, partition_stats
from mistgrove.operators.scale import exact_quantiles, quantile_lists, quantile_positions, to_uniform, wanted_ranges
from mistgrove.plans.partitioning import fuzzy_partition, search_cores


def skewed(rows, seed):
    """A third of all rows share one value; the rest are spread unevenly."""
    draw = random.Random(seed)
    return [(draw.randrange(3), 7.0 if i % 3 == 0 else round(draw.random() ** 3 * 100, 2)) for i in range(rows)]


@pytest.mark.parametrize("buckets", [1, 7, 300])
@pytest.mark.parametrize("bins", [4, 100])
def test_exact_quantiles(spark, buckets, bins):
    values = [x for _, x in skewed(2000, 3)]
    df = spark.createDataFrame([(v, -v) for v in values], "a double, b double").repartition(5)
    got = quantile_lists(exact_quantiles(df, ["a", "b"], bins, buckets))
    places = quantile_positions(len(values), bins)
    assert got["a"] == [sorted(values)[p] for p in places]
    assert got["b"] == [sorted(-v for v in values)[p] for p in places]


@pytest.mark.parametrize("k", [8, 40, None])
def test_quantiles_do_not_depend_on_the_sketch(spark, k):
    """A sketch of size 8 misses most positions, so ranges outside its intervals are looked into as well."""
    draw = random.Random(11)
    columns = {
        "skewed": [draw.random() ** 9 * 1e6 for _ in range(3000)], "same": [4.5] * 3000,
        "hot": [0.0 if i % 3 else draw.gauss(0, 1) for i in range(3000)],
        "signed": [draw.choice([-0.0, 0.0, float("inf"), float("-inf"), -1.5]) for _ in range(3000)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(6)
    got = quantile_lists(exact_quantiles(df, list(columns), 20, 400, k))
    places = quantile_positions(3000, 20)
    assert got == {c: [sorted(v)[p] for p in places] for c, v in columns.items()}


def test_quantiles_of_an_empty_table(spark):
    assert exact_quantiles(spark.createDataFrame([], "a double"), ["a"], 10).collect() == []


def test_ranges_of_a_sketch_cover_its_intervals():
    edges, inside = wanted_ranges(np.array([[1.0, 2.0, 3.0], [2.5, 2.6, 4.0], [9.0, 9.0, 9.0]]), 100)
    at = [bisect.bisect_left(edges, x) for x in (0.5, 1.0, 2.0, 3.5, 4.0, 4.1, 8.9, 9.0, 9.1)]
    assert [inside[i] for i in at] == [False, True, True, True, True, False, False, True, False]
    assert wanted_ranges(np.array([[1.0, 2.0, 3.0], [2.5, 2.6, 4.0]]), 2) == ([2.6], [True, True])


def test_quantiles_of_a_tiny_table(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (2.0,)], "a double")
    assert quantile_lists(exact_quantiles(df, ["a"], 1000))["a"] == [1.0, 2.0, 3.0]


def test_to_uniform_with_repeated_quantiles_and_values_outside(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 9.0)], "a double")
    got = [r.a for r in to_uniform(df, {"a": [2.0, 2.0, 4.0, 4.0]}, {"a": 0.0}).collect()]
    assert got == pytest.approx([-0.125, 0.0, 0.125, 0.25, 0.625, 0.75, 1.0])


def walk(values, splits):
    """The walk over (value, count) pairs that equal-frequency cuts are defined by."""
    distinct, counts = np.unique(values, return_counts=True)
    stride, found, seen, target = len(values) / (splits + 1), [distinct[0]], counts[0], 1
    for i in range(1, len(distinct)):
        before, seen = seen, seen + counts[i]
        if abs(before - target * stride) < abs(seen - target * stride):
            found.append((distinct[i - 1] + distinct[i]) / 2)
            target += 1
    return sorted({float(c) for c in [*found, distinct[-1]]})


@pytest.mark.parametrize("buckets", [1, 2, 13, 50])
@pytest.mark.parametrize("splits", [0, 3, 16, 999])
def test_equi_frequency_cuts(spark, buckets, splits):
    draw = random.Random(11)
    rows = [("big" if i % 3 else draw.choice("abc"), x) for i, (_, x) in enumerate(skewed(3000, 5))]
    df = spark.createDataFrame(rows, "block string, x double").repartition(4)
    found = cutting.equi_frequency_cuts(df, ["x"], splits, "block", buckets=buckets).distinct().collect()
    for block in {b for b, _ in rows}:
        want = walk([x for b, x in rows if b == block], splits)
        assert sorted(r.cut for r in found if r.block == block) == want


def test_equi_width_cuts(spark):
    ends = spark.createDataFrame([("a", 0.0, 1.0), ("b", 2.0, 2.0)], "feature string, lo double, hi double")
    got = cutting.cut_lists(cutting.equi_width_cuts(ends, 3))
    assert got == {"a": [0.0, 0.25, 0.5, 0.75, 1.0], "b": [2.0, 2.0]}
    with pytest.raises(ValueError):
        cutting.equi_width_cuts(ends, -1)
    empty = spark.createDataFrame([("a", 1.0, 0.0)], "feature string, lo double, hi double")
    with pytest.raises(Exception, match="maximum below minimum"):
        cutting.equi_width_cuts(empty, 3).collect()


def test_contingency_bins(spark):
    df = spark.createDataFrame([(0, v) for v in (0.0, 0.1, 0.25, 0.3, 1.0, 1.5, -2.0)], "y int, x double")
    cuts = {"x": [0.0, 0.25, 0.5, 0.75, 1.0]}
    width = {r.bin: r.n for r in cutting.contingency(df, "y", cuts, cutting.EQUAL_WIDTH).collect()}
    assert width == {0: 3, 1: 2, 3: 2}  # closed on the left, outer values in the nearest bin
    freq = {r.bin: r.n for r in cutting.contingency(df, "y", cuts, cutting.EQUAL_FREQUENCY).collect()}
    assert freq == {0: 2, 1: 2, 2: 1, 4: 1, 5: 1}  # closed on the right
    flat = {r.bin: r.n for r in cutting.contingency(df, "y", {"x": [2.0, 2.0]}, cutting.EQUAL_WIDTH).collect()}
    assert flat == {0: 7}


def test_rank_join_with_more_cuts_than_rows(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(3), draw.gauss(0, 1), round(draw.gauss(0, 1), 1)) for _ in range(400)] + [(1, 0.25, 7.0)] * 200 + [(0, None, 1.0)]
    df = spark.createDataFrame(rows, "y int, a double, b double").repartition(4)
    lists = {"a": sorted({draw.gauss(0, 1) for _ in range(5000)} | {0.25}), "b": sorted({round(x / 100, 2) for x in range(-300, 300)})}
    every = [(c, x) for c, cuts in lists.items() for x in cuts]
    cuts = cutting.merge_cuts(spark.createDataFrame(every + every[:99], "feature string, cut double").repartition(3), most=100)
    assert {(r.feature, r.bin, r.cut) for r in cuts.collect()} == {(c, i, x) for c, known in lists.items() for i, x in enumerate(known)}
    want = Counter()
    for y, *values in rows:
        for c, x in zip("ab", values):
            if x is not None:
                want[c, bisect.bisect_left(lists[c], x), y] += 1
    for buckets in (1, 8):
        got = cutting.rank_join(df, "y", cuts, ["a", "b"], len(rows), buckets).collect()
        assert {(r.feature, r.bin, r.label): r.n for r in got} == want and len(got) == len(want)
    chosen = cutting.contingency_between(df.dropna(), "y", cuts, ["a", "b"], cutting.EQUAL_FREQUENCY, len(rows), most=1000)
    few = cutting.contingency(df.dropna(), "y", lists, cutting.EQUAL_FREQUENCY)
    assert {tuple(r) for r in chosen.collect()} == {tuple(r) for r in few.collect()}


def bits(counts):
    total = sum(counts)
    return -sum(c / total * math.log2(c / total) for c in counts if c > 0) if total > 0 else 0.0


def searched(xs, n, lo, hi, least, min_gain, first=True):
    """The recursive search over bins lo..hi-1 with class counts n[bin][class] at points xs."""
    classes = range(len(n[0]))
    whole = [sum(n[b][j] for b in range(lo, hi)) for j in classes]
    total = sum(whole)
    if total == 0 or total < least:
        return []

    def spread(weights):
        return [sum(n[b][j] * weights[b - lo] for b in range(lo, hi)) for j in classes]

    if first:
        prior = bits(whole)
    elif hi - lo == 1:
        prior = 0.0
    else:
        up = [(xs[b] - xs[lo]) / (xs[hi - 1] - xs[lo]) for b in range(lo, hi)]
        prior = sum(bits(s) * sum(s) for s in (spread([1 - u for u in up]), spread(up))) / total
    best, core, sets = prior, None, None
    for i in range(lo + 2, hi):
        left = sum(sum(n[b]) for b in range(lo, i))
        if left <= least or total - left <= least:
            continue
        peak = xs[i - 1]
        a = [(xs[b] - xs[lo]) / (peak - xs[lo]) if b < i else None for b in range(lo, hi)]
        z = [(xs[b] - peak) / (xs[hi - 1] - peak) if b >= i else None for b in range(lo, hi)]
        three = (
            spread([1 - u if u is not None else 0 for u in a]),
            spread([u if u is not None else 1 - v for u, v in zip(a, z)]),
            spread([v if v is not None else 0 for v in z]),
        )
        found = sum(bits(s) * sum(s) for s in three) / total
        if found < best - 1e-12:
            best, core, sets = found, i, three
    if core is None or prior - best <= min_gain:
        return []
    present = sum(c > 0 for c in whole)
    delta = math.log2(3**present - 2) - (present * prior - sum(sum(c > 0 for c in s) * bits(s) for s in sets))
    if prior - best < (math.log2(total - 1) + delta) / total:
        return []
    return [
        *searched(xs, n, lo, core, least, min_gain, False), core, *searched(xs, n, core, hi, least, min_gain, False)
    ]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("least", [0, 40])
def test_search_against_recursion(spark, seed, least):
    draw = random.Random(seed)
    bins, classes = 24, 3
    xs = sorted(draw.random() * 10 for _ in range(bins + 1))
    steps = sorted(draw.sample(range(bins), 3))
    n = [[draw.randrange(40) if sum(b >= s for s in steps) % classes == j else draw.randrange(4) * (b % 2)
          for j in range(classes)] for b in range(bins)]
    cuts = spark.createDataFrame([("x", b, v) for b, v in enumerate(xs)], "feature string, bin int, cut double")
    counts = spark.createDataFrame(
        [("x", b, j, n[b][j]) for b in range(bins) for j in range(classes) if n[b][j]],
        "feature string, bin int, label int, n bigint",
    )
    grid = searchable_bins(cuts, counts, classes)
    assert grid.count() == bins * classes
    got = sorted(r.core for r in search_cores(grid, least).collect())
    assert got == searched(xs, n, 0, bins, least, 1e-6)
    first = best_cores(grid.withColumn("seg", F.lit(0)), True, least, 1e-6).collect()
    assert [r.core for r in first] == got or len(first) == (1 if got else 0)


def test_partition_discards_noise_and_keeps_signal(spark):
    draw = random.Random(1)
    rows = []
    for _ in range(3000):
        x = draw.random()
        rows.append((int(x > 0.3) + int(x > 0.7), x, draw.random(), 5.0))
    df = spark.createDataFrame(rows, "y int, signal double, noise double, flat double")
    found = fuzzy_partition(df, ["signal", "noise", "flat"], "y", 3, cutting.EQUAL_WIDTH, max_bins=50)
    cores = {r.feature: r.cores for r in found.collect()}
    assert cores["noise"] == [] and cores["flat"] == []
    inner = cores["signal"]
    assert len(inner) >= 4 and min(inner) < 0.01 and max(inner) > 0.99
    sizes = partition_stats(found).first()
    assert (sizes.discarded, sizes.most_feature, sizes.fewest_feature) == (2, "signal", "signal")
    assert sizes.total_sets == sizes.most_sets == len(inner) and sizes.average_sets == len(inner) / 3
    assert {r.feature for r in partition_listing(found).collect()} == {"signal", "noise", "flat"}
    freq = fuzzy_partition(df, ["signal", "noise"], "y", 3, max_bins=50)
    assert {r.feature: bool(r.cores) for r in freq.collect()} == {"signal": True, "noise": False}


def test_sizes_and_sample(spark):
    assert cutting.fit_sizes(10, 1000, 0.25) == cutting.FitSizes(10, 10, 9, 2)
    df = spark.range(1000)
    assert cutting.subsample(df, 1.0) is df
    assert 300 < cutting.subsample(df, 0.5).count() < 700
    with pytest.raises(ValueError):
        cutting.candidate_cuts(df, ["id"], "other", 3)
