"""A K2-treap over a grid of terms and documents, as flat arrays, and its best-first search.

The grid is a square of 2**depth cells a side, cut into quarters level by level. A node is a quarter that is not empty;
of each node a level stores four bits (which of its quarters are not empty), the number of nodes that the bits before it
stand for, and the greatest impact inside. Nodes of a level are in Morton order, so the children of a node follow each
other and are found by counting bits.

A search has one path for each row (term) of the question. All paths descend together over ranges of documents: the
bound of a range is the sum, over the rows, of weight times the greatest impact in the row's cell. Ranges wait in a heap;
the best ones are split in halves, many at once, until no range can hold a better document than those found.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Ranges taken off the heap at once.
AT_ONCE = 256
_BITS = np.array([bin(x).count("1") for x in range(256)], np.int64)


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of x (below 2**31) with a zero between any two."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """Entries (row, column, impact > 0), each cell once."""

    def __init__(self, row: np.ndarray, column: np.ndarray, impact: np.ndarray, rows: int, columns: int):
        self.depth = max(1, int(max(rows, columns, 2) - 1).bit_length())
        code = (spread(row) << np.uint64(1)) | spread(column)
        order = np.argsort(code)
        code, peak = code[order], impact[order].astype(np.int64)
        # from the cells up: quarters and maxima of each level; levels[0] is the root
        self.quarters, self.first, self.peak = [], [], [peak]
        for _ in range(self.depth):
            up = code >> np.uint64(2)
            start = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]])) if len(up) else np.zeros(0, np.int64)
            bit = (1 << (code & np.uint64(3)).astype(np.int64)).astype(np.uint8)
            self.quarters.append(np.bitwise_or.reduceat(bit, start) if len(start) else bit)
            self.first.append(start.astype(np.int64))
            peak = np.maximum.reduceat(peak, start) if len(start) else peak
            self.peak.append(peak)
            code = up[start]
        for level in (self.quarters, self.first, self.peak):
            level.reverse()

    def step(self, level: int, node: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """The child of each node of the level (-1: none) in the given quarter, -1 where it is empty."""
        at = np.maximum(node, 0)
        bits = self.quarters[level][at].astype(np.int64)
        child = self.first[level][at] + _BITS[bits & ((1 << quarter) - 1)]
        return np.where((node >= 0) & ((bits >> quarter) & 1 == 1), child, -1)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 0) -> list[tuple[int, int]]:
        """The k best (score, column), greatest first, then least column; of scores above `least` only.

        The score of a column is the sum over rows of weight * impact. Nothing is left out: a range is dropped only
        when its bound is below the k-th score found (or equal, with columns after it).
        """
        if not len(self.peak[-1]) or not len(rows):
            return []
        found: list[tuple[int, int]] = []  # a heap of (score, -column)
        top = int(self.peak[0][0]) * int(weights.sum())
        heap = [(-top, 0, 0, np.zeros(len(rows), np.int64))]  # bound, first column, level, a node for each row
        while heap:
            floor = (found[0][0], found[0][1]) if len(found) == k else (least, 1)
            if -heap[0][0] < floor[0] or (-heap[0][0], -heap[0][1]) <= floor:
                break
            same: dict[int, list] = {}
            for _ in range(min(AT_ONCE, len(heap))):
                bound, start, level, node = heapq.heappop(heap)
                if (-bound, -start) <= floor:
                    break
                same.setdefault(level, []).append((start, node))
            for level, some in same.items():
                start = np.repeat(np.array([s for s, _ in some], np.int64), 2)
                half = np.tile(np.array([0, 1], np.int64), len(some))
                side = self.depth - 1 - level
                start += half << side
                node = np.repeat(np.array([n for _, n in some]), 2, axis=0)
                quarter = 2 * ((rows >> side) & 1)[None, :] + half[:, None]
                node = self.step(level, node, quarter)
                bound = (np.where(node >= 0, self.peak[level + 1][np.maximum(node, 0)], 0) * weights).sum(axis=1)
                if side:
                    for i in np.flatnonzero(bound > (found[0][0] - 1 if len(found) == k else least)):
                        heapq.heappush(heap, (-int(bound[i]), int(start[i]), level + 1, node[i]))
                else:
                    for i in np.flatnonzero(bound > (found[0][0] - 1 if len(found) == k else least)):
                        one = (int(bound[i]), -int(start[i]))
                        if len(found) < k:
                            heapq.heappush(found, one)
                        elif one > found[0]:
                            heapq.heapreplace(found, one)
        return [(s, -c) for s, c in sorted(found, reverse=True)]
