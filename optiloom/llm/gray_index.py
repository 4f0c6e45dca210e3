"""Hierarchical Hamming index over fingerprints in Gray order.

Sorting by Gray rank puts fingerprints with long common bit patterns side by
side. Runs of ``FAN`` neighbours share an upper node, which holds the mask of
bits on which all of them agree and their values; a child holds only the bits
it adds. A query descends adding up, node by node, the differing bits, and
drops a whole subtree once the sum passes the limit.
"""

from __future__ import annotations

import numpy as np

FAN = 8
#: Queries that descend together.
BLOCK = 512


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the reflected Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Index of distinct 64-bit fingerprints, held in Gray order in ``points``."""

    def __init__(self, fingerprints: np.ndarray):
        self.order = np.argsort(gray_rank(fingerprints), kind="stable")
        self.points = fingerprints[self.order]
        every, some = self.points, self.points
        #: From the leaves up: (mask of agreed bits, their values).
        levels = [(np.full(len(self.points), ~np.uint64(0)), self.points)]
        while len(every) > 1:
            cuts = np.arange(0, len(every), FAN)
            every, some = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(some, cuts)
            levels.append((~(every ^ some), every))
        self.levels = levels

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) positions within ``limit`` differing bits."""
        if not len(self.points) or not len(queries):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        mask, value = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(mask))
        node = np.tile(np.arange(len(mask)), len(queries))
        added = np.bitwise_count((queries[q] ^ value[node]) & mask[node]).astype(np.int64)
        q, node, added = q[added <= limit], node[added <= limit], added[added <= limit]
        for depth in range(len(self.levels) - 2, -1, -1):
            above = mask
            mask, value = self.levels[depth]
            child = node[:, None] * FAN + np.arange(FAN)
            there = child < len(mask)
            parent, child = np.repeat(node, there.sum(1)), child[there]
            q, added = np.repeat(q, there.sum(1)), np.repeat(added, there.sum(1))
            added = added + np.bitwise_count((queries[q] ^ value[child]) & mask[child] & ~above[parent])
            near = added <= limit
            q, node, added = q[near], child[near], added[near]
        return q, node


def spanning_edges(fingerprints: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges that connect exactly what links of at most ``limit`` bits connect: a spanning forest."""
    index = GrayIndex(fingerprints)
    root = np.arange(len(index.points))
    out: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for low in range(0, len(index.points), BLOCK):
        q, p = index.search(index.points[low : low + BLOCK], limit)
        q += low
        q, p = q[p > q], p[p > q]
        label = root
        while (label != label[label]).any():
            label = label[label]
        root = label.copy()
        apart = label[q] != label[p]
        if not apart.any():
            continue
        q, p = q[apart], p[apart]
        _, one = np.unique(q * np.int64(len(root)) + label[p], return_index=True)
        for i, j in zip(q[one].tolist(), p[one].tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(index.points[i]), int(index.points[j])))
    return out
