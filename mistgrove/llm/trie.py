"""A two-level n-gram trie in one buffer: Elias-Fano sequences for contexts, pointers and successors, one byte a value.

An Elias-Fano sequence keeps a non-decreasing row of numbers as their low bits, packed, and their high bits in unary, with a
small directory for select. All parts are views of one buffer; `lm.mapped` makes it a file mapped into memory.
"""

from __future__ import annotations

import numpy as np

#: Every so many set bits of the high part, the directory notes a position.
EVERY = 64


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Bit-packed low parts, with room to read 8 bytes at the end."""
    if 8 <= width <= 57:  # every value starts in a byte of its own: byte k of all values at once
        bit = np.arange(len(values), dtype=np.int64) * width
        out = np.zeros((len(values) * width + 7) // 8 + 9, np.uint8)
        shifted = values << (bit & 7).astype(np.uint64)
        for k in range((width + 14) // 8):
            out[(bit >> 3) + k] |= ((shifted >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
        return out
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.concatenate([np.packbits(bits.reshape(-1), bitorder="little"), np.zeros(9, np.uint8)])


class Sequence:
    """A non-decreasing sequence in a buffer of bytes; access by place, and search in a range of places."""

    def __init__(self, buffer: np.ndarray):
        self.n, self.width, low, high, marks = (int(x) for x in buffer[:40].view(np.uint64))
        self.size = 40 + low + high + marks
        self.low, self.high = buffer[40 : 40 + low], buffer[40 + low : 40 + low + high]
        self.marks = buffer[40 + low + high : self.size].view(np.uint64)

    @staticmethod
    def built(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = min(57, max(0, (top // max(n, 1)).bit_length() - 1))  # at most what 8 bytes hold from any bit on
        low = packed(values & np.uint64((1 << width) - 1), width) if width else np.zeros(9, np.uint8)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(places[-1]) // 8 + 1 if n else 0), np.uint8)
        np.bitwise_or.at(high, places >> 3, (1 << (places & 7)).astype(np.uint8))
        marks = places[::EVERY].astype(np.uint64)
        parts = []
        for x in (low, high):
            parts.append(np.concatenate([x, np.zeros(-len(x) % 8, np.uint8)]))
        head = np.array([n, width, len(parts[0]), len(parts[1]), 8 * len(marks)], np.uint64)
        return head.tobytes() + parts[0].tobytes() + parts[1].tobytes() + marks.tobytes()

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        at = np.asarray(at, np.int64)
        if not len(at):
            return np.zeros(0, np.uint64)
        # select: from the noted position, byte by byte until the wanted set bit is inside
        byte = (self.marks[at // EVERY] >> np.uint64(3)).astype(np.int64)
        inside = (self.marks[at // EVERY] & np.uint64(7)).astype(np.uint8)
        left = at % EVERY + COUNT[self.high[byte] & ((1 << inside.astype(np.int64)) - 1)]
        open_ = np.arange(len(at))
        while len(open_):
            held = COUNT[self.high[byte[open_]]]
            on = left[open_] >= held
            open_ = open_[on]
            left[open_] -= held[on]
            byte[open_] += 1
        high = (byte * 8 + PLACE[self.high[byte], left] - at).astype(np.uint64)
        if not self.width:
            return high
        bit = at * self.width
        window = np.zeros(len(at), np.uint64)
        for k in range(8):
            window |= self.low[(bit >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        return (high << np.uint64(self.width)) | ((window >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1))

    def search(self, wanted: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place in [begin, end) that holds each wanted value, or -1: halving in all ranges at once."""
        lo, hi = begin.copy(), end.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) // 2
            less = self[middle] < wanted[open_]
            lo[open_[less]], hi[open_[~less]] = middle[less] + 1, middle[~less]
        found = np.full(len(wanted), -1)
        there = np.flatnonzero(lo < end)
        equal = self[lo[there]] == wanted[there]
        found[there[equal]] = lo[there[equal]]
        return found


#: Set bits of a byte, and the place of its k-th set bit; both follow from the byte.
COUNT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)
PLACE = np.array([([k for k in range(8) if byte >> k & 1] + [0] * 8)[:8] for byte in range(256)])


class Trie:
    """Contexts, where each one's successors begin, the successors, and one byte for each of them."""

    def __init__(self, buffer):
        data = np.frombuffer(buffer, np.uint8)
        self.contexts = Sequence(data)
        data = data[self.contexts.size :]
        self.pointers = Sequence(data)
        data = data[self.pointers.size :]
        self.successors = Sequence(data)
        self.values = data[self.successors.size :]

    @staticmethod
    def built(contexts: np.ndarray, successors: np.ndarray, values: np.ndarray, words: int) -> bytes:
        """From sorted different pairs and their byte values; successors are numbers below `words`."""
        names, first = np.unique(contexts, return_index=True)
        rank = np.searchsorted(names, contexts)
        return (Sequence.built(names) + Sequence.built(np.append(first, len(contexts)))
                + Sequence.built(rank.astype(np.uint64) * np.uint64(words) + successors.astype(np.uint64)) + values.astype(np.uint8).tobytes())

    def lookup(self, contexts: np.ndarray, successors: np.ndarray, words: int) -> np.ndarray:
        """Byte values of the pairs, 0 if absent: the context's place, its range, the successor relative to it."""
        names, back = np.unique(contexts, return_inverse=True)
        n = len(names)
        rank = self.contexts.search(names.astype(np.uint64), np.zeros(n, np.int64), np.full(n, self.contexts.n))
        known = np.maximum(rank, 0)
        begin, end = (self.pointers[known + k].astype(np.int64) if self.contexts.n else np.zeros(n, np.int64) for k in (0, 1))
        end = np.where(rank < 0, begin, end)
        place = self.successors.search(known[back].astype(np.uint64) * np.uint64(words) + successors.astype(np.uint64), begin[back], end[back])
        found = np.zeros(len(contexts), np.uint8)
        found[place >= 0] = self.values[place[place >= 0]]
        return found
