"""Exact quantiles by distributed counting, and the map of columns to a uniform distribution."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mistgrove.functions.lookup import CASE_LIMIT, arrow_lists, arrow_matrix, constant, double_array, let, opened, rank_of, ranks
from mistgrove.storage import discard, settle, spread, written


def range_edges(df: DataFrame, cols: list[str], buckets: int, rows: int, seed: int = 17) -> dict[str, list[float]]:
    """Sorted values cutting each column into about `buckets` ranges of similar size.

    They come from a sample of a fixed expected size, so they are cheap and bounded. They only
    steer how work is divided: no result depends on where they fall.
    """
    if buckets < 2:
        return {c: [] for c in cols}
    share = min(1.0, 16.0 * buckets / max(rows, 1))
    sample = df if share == 1.0 else df.sample(False, share, seed)
    probes = double_array([i / buckets for i in range(1, buckets)])
    found = sample.agg(
        *[F.percentile_approx(F.col(c).cast("double"), probes, 10 * buckets).alias(c) for c in cols]
    ).first()
    return {c: sorted(set(found[c] or [])) for c in cols}


def melt(df: DataFrame, cols: list[str], edges: dict[str, list[float]], *keep) -> DataFrame:
    """Long form (kept columns, feature, bucket, value); `bucket` is the value's range."""
    parts = [
        F.struct(
            F.lit(c).alias("feature"),
            rank_of(F.col(c), edges[c]).cast("int").alias("bucket"),
            F.col(c).alias("value"),
        )
        for c in cols
    ]
    doubled = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    kept = [c for c in doubled.columns if c not in cols]
    return opened(doubled, kept, parts, sum(len(v) for v in edges.values()))


def quantile_positions(rows: int, bins: int) -> list[int]:
    """0-based sorted positions of the `bins` quantiles, without repeats."""
    return sorted({max(0, math.ceil(i / bins * rows - 1)) for i in range(1, bins + 1)})


def sketched(df: DataFrame, cols: list[str], bins: int, k: int, sides: int = 64) -> tuple[int, dict[str, np.ndarray]]:
    """One scan: the number of rows, and per column where a sketch of its values sees the ends of every quantile's interval.

    Columns with nulls or NaN are refused. Every task sketches its rows; sketches meet in `sides` groups of tasks before they meet
    in one place. Row j of a column's matrix holds the values at ranks (j + 1) / bins less, plus nothing and plus the sketch's error.
    """
    values = {c: F.col(c).cast("double") for c in cols}
    bad = [F.count_if(v.isNull() | F.isnan(v)).alias(f"bad{i}") for i, v in enumerate(values.values())]
    sketch = [F.kll_sketch_agg_double(v, k).alias(f"sketch{i}") for i, v in enumerate(values.values())]
    tasks = df.select(*cols).withColumn("__side", F.pmod(F.spark_partition_id(), F.lit(sides)))
    part = tasks.groupBy("__side").agg(F.count("*").alias("rows"), *bad, *sketch)
    each = range(len(cols))
    met = part.agg(
        F.sum("rows").alias("rows"), *[F.sum(f"bad{i}").alias(f"bad{i}") for i in each],
        *[F.kll_merge_agg_double(f"sketch{i}").alias(f"sketch{i}") for i in each])
    error = rank_error(k)
    probes = double_array([min(1.0, max(0.0, i / bins + e)) for i in range(1, bins + 1) for e in (-error, 0.0, error)])
    seen = F.col("rows") > 0
    found = met.select("rows", *[f"bad{i}" for i in each], *[
        F.when(seen & (F.col(f"bad{i}") == 0), F.kll_sketch_get_quantile_double(f"sketch{i}", probes)).alias(f"at{i}") for i in each]).first()
    wrong = [f"{c}: {found[f'bad{i}']} rows" for i, c in enumerate(cols) if found[f"bad{i}"]]
    if wrong:
        raise ValueError("null or NaN in " + "; ".join(wrong))
    return found.rows or 0, {c: np.array(found[f"at{i}"] or [], np.float64).reshape(-1, 3) for i, c in enumerate(cols)}


def rank_error(k: int) -> float:
    """About the share of rows by which a sketch of size k misses a rank. It only steers: no result depends on it."""
    return 2.3 / k ** 0.9


def wanted_ranges(probes: np.ndarray, buckets: int) -> tuple[list[float], list[bool]]:
    """Sorted edges of a column's ranges, and which ranges to look into, by the matrix that `sketched` gives.

    Range j holds the values above edge j - 1 up to edge j. With room for fewer ranges than intervals every range is looked into.
    """
    low, middle, high = np.nextafter(probes[:, 0], -np.inf), probes[:, 1], probes[:, 2]
    if buckets < 2 * len(probes):
        edges = np.unique(middle[(np.arange(1, buckets) * len(probes)) // buckets])
        return edges.tolist(), [True] * (len(edges) + 1)
    edges = np.unique(np.concatenate([low, middle, high]))
    below = np.append(-np.inf, edges)  # the open lower end of every range
    covered = np.searchsorted(np.sort(low), below, "right") > np.searchsorted(np.sort(high), below, "right")
    return edges.tolist(), covered.tolist()


def counted_ranges(df: DataFrame, edges: dict[str, list[float]], inside: dict[str, list[bool]]) -> DataFrame:
    """(feature, bucket, value, n): rows per value in the ranges inside, rows per range (with a null value) elsewhere."""
    cols = list(edges)
    values = F.array(*[F.col(c).cast("double") for c in cols])
    if max(map(len, edges.values())) > CASE_LIMIT:
        at = ranks(list(edges.values()))(values)
    else:
        at = F.array(*[rank_of(F.col(c).cast("double"), e).cast("int") for c, e in edges.items()])
    placed = df.select(values.alias("values"), at.alias("at"))
    parts = []
    for i, c in enumerate(cols):
        bucket, value = F.get("at", F.lit(i)), F.get("values", F.lit(i))
        looked = F.lit(True) if all(inside[c]) else F.get(constant([bool(b) for b in inside[c]], "array<boolean>"), bucket)
        parts.append(F.struct(F.lit(c).alias("feature"), bucket.alias("bucket"), F.when(looked, value + 0.0).alias("value")))
    return opened(placed, [], parts, 0).groupBy("feature", "bucket", "value").agg(F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, cols: list[str], bins: int = 1000, buckets: int | None = None, k: int | None = None) -> DataFrame:
    """(feature, idx, q): the exact value at every quantile position of every column.

    No sort of the table, and two scans: the first counts rows, refuses nulls and NaN, and sketches every column; the sketch gives
    an interval round each quantile. The second counts rows per value inside the intervals and rows per range outside.
    Running counts of the ranges then prove which of them hold a wanted position. Should one lie outside the intervals
    (sketches err now and then), those ranges are looked into by a third scan, so results never depend on the sketch.

    `k` is the size of a sketch (64 * bins up to its limit of 65,535). Up to `buckets` ranges a column (by default one per 50,000
    rows, at most 8 * bins); below two per quantile the intervals are left out and every value is counted.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, idx int, q double")
    df = df.select(*cols)
    rows, probes = sketched(df, cols, bins, min(65_535, max(8, k or 64 * bins)))
    if not rows:
        return df.sparkSession.createDataFrame([], "feature string, idx int, q double")
    positions = quantile_positions(rows, bins)
    if buckets is None:
        buckets = min(8 * bins, max(1, rows // 50_000))
    df = spread(df, rows)
    plans = {c: wanted_ranges(probes[c], buckets) for c in cols}
    edges, inside = {c: p[0] for c, p in plans.items()}, {c: p[1] for c, p in plans.items()}
    counted, path = written(counted_ranges(df, edges, inside), "quantile-ranges")

    def covered(upto):
        return rank_of(upto.cast("double"), positions)

    def walked(values: DataFrame, ranges: DataFrame) -> DataFrame:
        in_range = Window.partitionBy("feature", "bucket").orderBy("value")
        at = values.join(F.broadcast(ranges), ["feature", "bucket"])  # at most len(cols) * bins rows
        at = at.withColumn("upto", F.col("before") + F.sum("n").over(in_range)).withColumns(
            {"first": covered(F.col("upto") - F.col("n")), "last": covered(F.col("upto")) - 1}).filter("first <= last")
        return at.select("feature", F.explode(F.sequence("first", "last")).alias("idx"), F.col("value").alias("q"))

    in_order = Window.partitionBy("feature").orderBy("bucket")
    needed = settle(
        counted.groupBy("feature", "bucket").agg(F.sum("n").alias("n"), F.count_if(F.col("value").isNull()).alias("outside"))
        .withColumn("upto", F.sum("n").over(in_order))
        .withColumn("before", F.col("upto") - F.col("n"))
        .filter(covered(F.col("upto")) > covered(F.col("before")))
        .select("feature", "bucket", "before", "outside"))
    found = walked(counted, needed.where("outside = 0"))
    missed = {c: [False] * len(inside[c]) for c in cols}
    for r in needed.where("outside > 0").collect():  # at most len(cols) * bins ranges
        missed[r.feature][r.bucket] = True
    if any(map(any, missed.values())):
        again = counted_ranges(df, edges, missed).where("value is not null")
        found = found.unionByName(walked(again, needed.where("outside > 0")))
    found = settle(found)
    discard(df.sparkSession, path)
    return found


def quantile_lists(quantiles: DataFrame) -> dict[str, list[float]]:
    """The quantiles of each column in order (at most columns * bins values)."""
    found: dict[str, list[float]] = {}
    for r in quantiles.orderBy("feature", "idx").collect():
        found.setdefault(r.feature, []).append(r.q)
    return found


def _uniform_batches(df: DataFrame, quantiles: dict[str, list[float]], lower: dict[str, float]) -> DataFrame:
    """The same map for all columns at once."""
    names, tables = list(quantiles), []
    for name, q in quantiles.items():
        ends, n = np.array(q), len(q)
        starts = np.append(float(lower[name]), ends[:-1])
        low, high = np.arange(n) / n, np.arange(1, n + 1) / n
        width = ends - starts
        slope = np.divide(high - low, width, out=np.zeros(n), where=width > 0)
        tables.append((ends, np.append(slope, 0.0), np.append(starts, 0.0), np.append(low, 1.0)))

    @F.arrow_udf("array<double>")
    def mapped(values: pa.Array) -> pa.Array:
        matrix = arrow_matrix(values, len(tables))
        out = np.empty_like(matrix)
        for i, (ends, slope, start, low) in enumerate(tables):
            at = np.searchsorted(ends, matrix[:, i])
            out[:, i] = slope[at] * (matrix[:, i] - start[at]) + low[at]
        return arrow_lists(out)

    packed = df.withColumn("__uniform", mapped(F.array(*[F.col(c).cast("double") for c in names])))
    return packed.withColumns({c: F.when(F.col(c).isNotNull(), F.get("__uniform", F.lit(i))) for i, c in enumerate(names)}).drop("__uniform")


def to_uniform(df: DataFrame, quantiles: dict[str, list[float]], lower: dict[str, float]) -> DataFrame:
    """Map each listed column to [0, 1] through its quantiles; all other columns stay as they are.

    A value in the segment that ends at quantile i of n maps linearly to [i/n, (i+1)/n]; the
    first segment starts at the declared lower bound; values past the last quantile give 1.
    Among equal quantiles the first is used. Test rows reuse the quantiles of the training rows. Nulls stay.
    Short tables are searched by compiled comparisons, long ones by numpy on Arrow batches.
    """
    if max(map(len, quantiles.values()), default=0) > CASE_LIMIT:
        return _uniform_batches(df, quantiles, lower)

    def along(x: Column):
        return lambda s: s["m"] * (x - s["x1"]) + s["y1"]

    mapped = {}
    for name, q in quantiles.items():
        n = len(q)
        starts = [float(lower[name]), *q[:-1]]
        segments = []
        for i, (x1, x2) in enumerate(zip(starts, q)):
            y1, y2 = i / n, (i + 1) / n
            segments.append({"m": (y2 - y1) / (x2 - x1) if x2 > x1 else 0.0, "x1": x1, "y1": y1})
        segments.append({"m": 0.0, "x1": 0.0, "y1": 1.0})
        table = constant(segments, "array<struct<m:double,x1:double,y1:double>>")
        x = F.col(name).cast("double")
        mapped[name] = let(F.get(table, rank_of(x, q)), along(x))
    return df.withColumns(mapped)
