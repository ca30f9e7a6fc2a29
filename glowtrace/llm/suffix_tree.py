"""Suffix trees (Ukkonen, 1995) whose Euler tours answer longest common extensions in constant time."""

from __future__ import annotations

import numpy as np


def _grown(symbols: list[int], sigma: int) -> tuple[list[int], list[int], dict[int, int], list[int]]:
    """Ukkonen's tree of ``symbols``, which end with a symbol of their own: (start, end, child, suffix).

    Node v's edge is symbols[start[v]:end[v]], a child is found under v * sigma + its first symbol, and suffix[v] is the suffix
    of a leaf, -1 for inner nodes. Node 0 is the root."""
    size = len(symbols)
    start, end, link, suffix = [0], [0], [0], [-1]
    child: dict[int, int] = {}
    node = length = edge = first = 0  # the active point, and the suffix that is inserted next
    for i, c in enumerate(symbols):
        last = 0
        while first <= i:
            if not length:
                edge = i
            key = node * sigma + symbols[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i), end.append(size), link.append(0), suffix.append(first)
                if last:
                    link[last] = node
                    last = 0
            else:
                at = start[below]
                span = min(end[below], i + 1) - at
                if length >= span:
                    edge, length, node = edge + span, length - span, below
                    continue
                if symbols[at + length] == c:
                    if last:
                        link[last] = node
                    length += 1
                    break
                middle = len(start)
                start += [at, i]
                end += [at + length, size]
                link += [0, 0]
                suffix += [-1, first]
                child[key] = middle
                child[middle * sigma + c] = middle + 1
                start[below] = at + length
                child[middle * sigma + symbols[at + length]] = below
                if last:
                    link[last] = middle
                last = middle
            first += 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = first
    return start, end, child, suffix


class Extensions:
    """Longest common extensions of the suffixes of a sequence of symbols >= 1.

    The Euler tour of the suffix tree visits the leaves in the order of their suffixes; between two leaves it turns at their
    lowest common ancestor, so only the depths of those turns are kept. The least depth between two leaves, by a table of
    the least of 2^k turns, is how far their suffixes agree."""

    def __init__(self, symbols: np.ndarray):
        text = [*symbols.tolist(), 0]
        sigma = int(symbols.max(initial=0)) + 1
        start, end, child, suffix = _grown(text, sigma)
        keys = np.fromiter(child, np.int64, len(child))
        order = np.argsort(keys)
        below = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        cut = np.searchsorted(keys[order] // sigma, np.arange(len(start) + 1)).tolist()
        leaves, turns = [], []
        stack = [(0, 0, 0)]  # node, depth of the node above it, depth of the turn before its first leaf
        while stack:
            node, depth, turn = stack.pop()
            if suffix[node] >= 0:
                leaves.append(suffix[node])
                turns.append(turn)
                continue
            depth += end[node] - start[node]
            a, b = cut[node], cut[node + 1]
            stack += [(v, depth, depth) for v in reversed(below[a + 1 : b])]
            stack.append((below[a], depth, turn))
        self.rank = np.empty(len(text), np.int64)
        self.rank[leaves] = np.arange(len(text))
        table = [np.array(turns, np.int32)]
        while 2 << (len(table) - 1) <= len(text):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self._least = table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and j, i != j, have in common from their start; both may be the end."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            here = level == k
            out[here] = np.minimum(self._least[k][low[here]], self._least[k][high[here] - (1 << int(k))])
        return out
