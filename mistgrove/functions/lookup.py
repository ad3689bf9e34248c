"""Constant tables and their binary search: inside expressions, or for long tables on Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many values a search is compiled into nested comparisons.
CASE_LIMIT = 64

#: Expressions with more comparisons than this are computed outside the fused stage.
FUSED_COMPARISONS = 40


def double_array(values: Sequence[float]) -> Column:
    """An array<double> constant. One string keeps plan building cheap; Catalyst folds it."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def constant(rows: list, schema: str) -> Column:
    """A nested constant (arrays, structs) of the given type, folded at planning time."""
    return F.from_json(F.lit(json.dumps(rows)), schema)


def decide(x: Column, values: Sequence[float], leaf: Callable[[int], Column], inclusive: bool) -> Column:
    """Balanced comparisons of `x` with the sorted `values`, ending in `leaf(values passed)`."""

    def branch(lo: int, hi: int) -> Column:
        if lo == hi:
            return leaf(lo)
        mid = (lo + hi) // 2
        edge = F.lit(float(values[mid]))
        passed = x >= edge if inclusive else x > edge
        return F.when(passed, branch(mid + 1, hi)).otherwise(branch(lo, mid))

    return branch(0, len(values))


def rank_of(x: Column, values: Sequence[float], inclusive: bool = False) -> Column:
    """How many of the sorted `values` are below `x` (with `inclusive`, below or equal)."""
    if len(values) <= CASE_LIMIT:
        return decide(x, values, F.lit, inclusive)
    table = double_array(values)
    strides = [1 << b for b in reversed(range(len(values).bit_length()))]

    def advance(found: Column, stride: Column) -> Column:
        edge = F.get(table, found + stride - 1)  # null past the end, which stops the advance
        passed = x >= edge if inclusive else x > edge
        return F.when(passed, found + stride).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in strides]), F.lit(0), advance)


def arrow_lists(matrix: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow array of lists."""
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))


def arrow_matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Arrow lists of `width` doubles as a matrix; nulls inside become NaN."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def ranks(tables: Sequence[Sequence[float]]):
    """A function from an array of doubles, one per sorted table, to how many values of each table are below.

    For long tables: a binary search over whole Arrow batches, where an expression would interpret every step.
    """
    arrays = [np.asarray(t, np.float64) for t in tables]

    @F.arrow_udf("array<int>")
    def found(values: pa.Array) -> pa.Array:
        matrix = arrow_matrix(values, len(arrays))
        return arrow_lists(np.stack([np.searchsorted(t, matrix[:, i]) for i, t in enumerate(arrays)], 1).astype(np.int32))

    return found


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def apart(values: Column, comparisons: int) -> Column:
    """An array whose elements take so many comparisons, kept out of the fused stage if they are many.

    An identity `transform` has no fused code. Its projection is then generated as many small
    methods instead of one that is too long for the JVM to compile.
    """
    return F.transform(values, lambda v: v) if comparisons > FUSED_COMPARISONS else values


def opened(df: DataFrame, keep: list, parts: list[Column], comparisons: int) -> DataFrame:
    """Each row once per struct in `parts`, with its fields as columns.

    The outer form spares the optimizer's extra filter on the array's size, which would compute
    the structs a second time.
    """
    rows = df.select(*keep, apart(F.array(*parts), comparisons).alias("__parts"))
    return rows.select(*[c for c in rows.columns if c != "__parts"], F.inline_outer("__parts"))
