"""Entropies, gains and node measures over class arrays or aggregated class sums."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)

#: Sums of memberships that should be whole can miss by summation order; see `whole_weight`.
WHOLE_EPSILON = 1e-6


def xlogx(x: Column) -> Column:
    """x ln x, 0 where x is not positive."""
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def entropy_from_sums(total: Column, sum_xlogx: Column) -> Column:
    """Entropy in bits from the total of class counts and the sum of their x ln x."""
    return F.when(total > 0, (xlogx(total) - sum_xlogx) / (total * LN2)).otherwise(0.0)


def array_total(values: Column) -> Column:
    """Sum of an array<double>."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def entropy(counts: Column) -> Column:
    """Entropy in bits of an array of class counts."""
    logs = F.aggregate(counts, F.lit(0.0), lambda acc, v: acc + xlogx(v))
    return entropy_from_sums(array_total(counts), logs)


def weighted_impurity(sets: Column, cardinality: Column) -> Column:
    """Cardinality-weighted mean entropy of an array of class arrays."""
    summed = F.aggregate(sets, F.lit(0.0), lambda acc, s: acc + entropy(s) * array_total(s))
    return F.when(cardinality > 0, summed / cardinality)


def whole_weight(total: Column) -> Column:
    """A child's weight in a gain: its membership sum cut to a whole number."""
    return F.floor(total + WHOLE_EPSILON)


def info_gain(parent: Column, weighted_sum: Column, weight: Column, min_gain: float) -> Column:
    """Parent impurity minus the weighted child impurity; null where that is no valid split."""
    gain = F.when(weight > 0, parent - weighted_sum / weight)
    return F.when(gain >= min_gain, gain)


def mdlp_accept(gain: Column, prior: Column, total: Column, classes: Column, set_term: Column) -> Column:
    """Minimum description length test of a split.

    `classes` is the number of classes present, `set_term` the sum over the new sets of
    classes present times entropy, `total` the cardinality of the split segment.
    """
    delta = F.log2(F.pow(F.lit(3.0), classes) - 2.0) - (classes * prior - set_term)
    return F.when(total > 1, gain >= (F.log2(total - 1.0) + delta) / total).otherwise(False)


def node_purity(u: Column) -> Column:
    """Largest class share of a node; null for an empty node."""
    return F.try_divide(F.array_max(u), array_total(u))


def class_shares(values: Column) -> Column:
    """Per-class share of the total, zeros when the total is 0 (for memberships or frequencies)."""
    total = array_total(values)
    return F.transform(values, lambda v: F.when(total > 0, v / total).otherwise(0.0))


def is_mono_label(freq: Column) -> Column:
    """Whether exactly one class is present."""
    return F.size(F.filter(freq, lambda v: v > 0)) == 1


def category_subset(code: Column, arity: Column) -> Column:
    """Positions of the 1-bits of `code` below `arity`, highest first."""
    positions = F.sequence(arity - 1, F.lit(0), F.lit(-1))
    return F.filter(positions, lambda j: F.call_function("shiftright", code, j).bitwiseAND(F.lit(1)) == 1)
