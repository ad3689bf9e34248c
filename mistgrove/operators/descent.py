"""Vectorised descent of Arrow batches through part of a tree: the task-side part of scoring.

A batch is a matrix of coordinates (rows x features). All places a row is at are kept as flat
arrays (row, node, activation), stepped down together until they are at leaves or in nodes of a later
part, and what leaves give is summed per row. Spark splits the table and carries the batches; nothing is shuffled.
"""

from __future__ import annotations

import mmap
import tempfile
from dataclasses import dataclass

import numpy as np

FRESH, LOWER, UPPER, RIGHT = 0, 1, 2, 3  # what a row remembers of a column in a binary tree


@dataclass(frozen=True)
class FlatTree:
    """A run of a tree's nodes, in order of their numbers, as arrays; `left[i, b]` tells whether bin b goes left at the i-th.

    Children have larger numbers than their parent, so a descent goes through the runs one after the other.
    """

    number: np.ndarray  # of each node
    split: np.ndarray  # feature, -1 at leaves
    child: np.ndarray  # number of the first child
    share: np.ndarray  # nodes x classes
    left: np.ndarray | None  # binary trees only
    product: bool

    def norm(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x * y if self.product else np.minimum(x, y)

    def __reduce__(self):
        return received, (self.number, self.split, self.child, self.share, self.left, self.product)


def received(number, split, child, share, left, product: bool) -> FlatTree:
    """A run as a task gets it: in a scratch file without a name, read through a memory map.

    A worker meets all runs of a tree; so mapped, they take memory that the system can have back, not the worker's own.
    """
    arrays = [a for a in (number, split, child, share, left) if a is not None]  # single bytes last, so all others are aligned
    with tempfile.TemporaryFile() as file:
        for a in arrays:
            file.write(a.tobytes())
        file.flush()
        held = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    ends = np.cumsum([a.nbytes for a in arrays])
    mapped = [np.frombuffer(held, a.dtype, a.size, end - a.nbytes).reshape(a.shape) for a, end in zip(arrays, ends)]
    return FlatTree(*mapped, *([None] if left is None else []), product)


def _multi_step(tree: FlatTree, coords: np.ndarray, row, node, act):
    coord = coords[row, tree.split[node]]
    low = np.floor(coord)
    up = coord - low
    first = tree.child[node] + low.astype(np.int64)
    a, b = coord >= 0, up > 0
    return (
        np.concatenate([row[a], row[b]]),
        np.concatenate([first[a], first[b] + 1]),
        np.concatenate([tree.norm(act[a], 1.0 - up[a]), tree.norm(act[b], up[b])]),
    )


def _binary_step(tree: FlatTree, coords: np.ndarray, row, node, act, memory):
    feature = tree.split[node]
    coord = coords[row, feature]
    low = np.floor(coord)
    up = coord - low
    bin_ = low.astype(np.int64)
    last = tree.left.shape[1] - 1
    low_left = (coord >= 0) & tree.left[node, np.maximum(bin_, 0)]
    high_left = (up > 0) & tree.left[node, np.minimum(bin_ + 1, last)]
    s = np.round(np.where(low_left, 1.0 - up, 0.0) + np.where(high_left, up, 0.0), 12)
    known = memory[np.arange(len(row)), feature]
    fresh, right_before = known == FRESH, known == RIGHT
    remembered = np.where(known == LOWER, low_left, tree.left[node, np.minimum(bin_ + 1, last)])
    both = fresh & (s > 0) & (s != 1.0)
    goes_left = np.where(fresh | right_before, s > 0, remembered)
    l, r = both | goes_left, both | ~goes_left
    marked = np.where(high_left, UPPER, LOWER).astype(np.int8)

    def side(mask, offset, degree, note, noted):
        kept = memory[mask]
        kept[np.arange(len(kept)), feature[mask]] = np.where(noted[mask], note[mask], known[mask])
        activation = np.where(both[mask], tree.norm(act[mask], degree[mask]), act[mask])
        return row[mask], tree.child[node[mask]] + offset, activation, kept

    parts = (
        side(l, 0, s, marked, both | right_before),
        side(r, 1, 1.0 - s, np.full(len(row), RIGHT, np.int8), both),
    )
    return tuple(np.concatenate(pair) for pair in zip(*parts))


def root_state(rows: int, features: int, binary: bool) -> list[np.ndarray]:
    """All rows at the root, number 1: row, node, activation and, in a binary tree, what each remembers of every column."""
    state = [np.arange(rows), np.ones(rows, np.int64), np.ones(rows)]
    return [*state, np.zeros((rows, features), np.int8)] if binary else state


def descend_batch(tree: FlatTree, coords: np.ndarray, state: list[np.ndarray], scores: np.ndarray, hit: np.ndarray) -> list[np.ndarray]:
    """Follow all places through this run of nodes; add leaves to scores and hit, return the places beyond it."""
    step = _multi_step if tree.left is None else _binary_step
    last = tree.number[-1] if len(tree.number) else -1
    beyond = [[part[:0]] for part in state]
    while len(state[0]):
        later = state[1] > last
        for kept, part in zip(beyond, state):
            kept.append(part[later])
        row, node, act, *memory = (part[~later] for part in state)
        node = np.searchsorted(tree.number, node)
        leaf = tree.split[node] < 0
        hit[row[leaf]] = True
        for j in range(scores.shape[1]):
            scores[:, j] += np.bincount(row[leaf], tree.share[node[leaf], j] * act[leaf], minlength=len(scores))
        state = step(tree, coords, *(part[~leaf] for part in (row, node, act, *memory)))
    return [np.concatenate(parts) for parts in beyond]
