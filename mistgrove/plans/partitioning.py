"""Supervised fuzzy partitioning: from a table and a class to the cores of each numeric column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mistgrove.features import numeric
from mistgrove.operators.cores import best_cores, searchable_bins, split_segments
from mistgrove.operators.cuts import (
    EQUAL_FREQUENCY, candidate_cuts, contingency_between, fit_sizes,
)
from mistgrove.operators.encode import validate
from mistgrove.storage import settle, spread


def search_cores(bins: DataFrame, min_instances: int = 0, min_gain: float = 1e-6) -> DataFrame:
    """(feature, core): all accepted bins, found level by level over every open segment at once.

    `bins` holds at most one row per bin and class, so each level is a small job.
    """
    open_bins = settle(bins.withColumn("seg", F.lit(0)))
    found = None
    level = 0
    while True:
        chosen = settle(best_cores(open_bins, level == 0, min_instances, min_gain))
        if level and chosen.isEmpty():
            return found
        part = chosen.select("feature", "core")
        found = part if found is None else found.unionByName(part)
        open_bins = settle(split_segments(open_bins, chosen))
        level += 1


def fuzzy_partition(
    df: DataFrame, cols: list[str], label: str, classes: int, strategy: str = EQUAL_FREQUENCY,
    max_bins: int = 1000, min_gain: float = 1e-6, fraction: float = 1.0, min_ratio: float = 0.0,
    block: str | None = None, seed: int = 17, sample_key: list[str] | None = None,
) -> DataFrame:
    """(feature, cores): per numeric column its cores in order; an empty list discards the column.

    Candidate cuts come from the whole table (or a sample when `fraction` < 1), class counts
    from the whole table. Cores are the first cut, the accepted ones and the last cut. Nulls, NaN and
    labels outside the classes are counted in the pass that counts the rows, and raise.
    """
    if not cols:
        raise ValueError("no numeric column to partition")
    checked = [numeric(c, [0.0, 1.0]) for c in cols]  # only names and kinds matter here
    sizes = fit_sizes(validate(df, checked, label, classes), max_bins, min_ratio)
    df = spread(df, sizes.rows)
    cuts = settle(candidate_cuts(df, cols, strategy, sizes.splits, block, fraction, seed, sample_key))
    counts = contingency_between(df, label, cuts, cols, strategy, sizes.rows)
    found = search_cores(searchable_bins(cuts, counts, classes), sizes.min_instances, min_gain)
    points = cuts.withColumnRenamed("bin", "core")
    inner = found.join(points, ["feature", "core"]).select("feature", "cut")
    outer = points.join(found.select("feature").distinct(), "feature", "left_semi")
    ends = outer.groupBy("feature").agg(F.min("cut").alias("lo"), F.max("cut").alias("hi"))
    cores = inner.unionByName(ends.select("feature", F.explode(F.array("lo", "hi")).alias("cut")))
    listed = cores.groupBy("feature").agg(F.sort_array(F.collect_set("cut")).alias("cores"))
    names = cuts.select("feature").distinct()
    return names.join(listed, "feature", "left").select(
        "feature", F.coalesce("cores", F.array().cast("array<double>")).alias("cores")
    )
