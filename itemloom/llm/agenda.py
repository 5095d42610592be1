"""Merge agendas of many units at once.

A unit is a run of symbols; a candidate is an adjacent pair that has a rank. The candidate of the least rank is
merged, the leftmost on ties, until none is left. Units of one length lie side by side as the columns of a
matrix: each step finds the best candidate of all of them, merges these, and proposes the two pairs that arise.
A draw may skip a candidate: it is a hash of the unit's key and of the candidate's two spans, so it is the same
whenever the unit is worked on again. Memory is bounded by ROWS units and what is given.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

from itemloom.llm import blocks as B

#: Symbols of a unit up to which it is worked on beside others; longer ones have a heap each.
WIDEST = 24
#: Cells of the matrices, small enough for a CPU cache.
CELLS = 1 << 17
NONE = (1 << 31) - 1
ALL = (1 << 64) - 1


def mixed(x: int) -> int:
    """blocks.mixed of a plain number."""
    x = (x ^ x >> 32) * B.MIX & ALL
    return x ^ x >> 29


def span_key(start: int, middle: int, end: int) -> int:
    """Of a candidate, by the places in its unit where its two symbols start, and where the second ends."""
    return mixed((mixed((mixed(start * B.BASE + 1 & ALL) + middle) * B.BASE & ALL) + end) * B.BASE & ALL)


class Pairs:
    """Which pairs of symbols merge: a table in which each left symbol's row is displaced until it fits."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray, symbols: int):
        """Symbols are numbers below `symbols`; that number itself never merges."""
        self.none = symbols
        bits = max(10, int(4 * len(left)).bit_length())
        self.mask = (1 << bits) - 1
        self.shift = np.zeros(symbols + 1, np.int32)
        self.owner = np.full(self.mask + 1, -1, np.int32)
        self.rank = np.full(self.mask + 1, NONE >> 5, np.int32)
        self.result = np.zeros(self.mask + 1, np.int32)
        order = np.argsort(left, kind="stable")
        left, right, rank, result = (x[order] for x in (left, right, rank, result))
        at = np.flatnonzero(np.append(True, left[1:] != left[:-1])) if len(left) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(left))
        rng = np.random.default_rng(1)
        for i in np.argsort(at - ends, kind="stable"):  # the longest rows first
            a, b = at[i], ends[i]
            while True:
                shift = int(rng.integers(self.mask))
                slots = (right[a:b] + shift) & self.mask
                if (self.owner[slots] < 0).all():
                    break
            self.shift[left[a]] = shift
            self.owner[slots], self.rank[slots], self.result[slots] = left[a], rank[a:b], result[a:b]
        self.plain = {(int(x), int(y)): (int(r), int(z)) for x, y, r, z in zip(left, right, rank, result)}

    def slots(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each pair in the table, and whether it is there."""
        at = (self.shift[a] + b) & self.mask
        return at, self.owner[at] == a


def span_keys() -> np.ndarray:
    w = WIDEST + 1
    return np.array([span_key(i, j, k) if i < j < k else 0 for i in range(w) for j in range(w) for k in range(w)], np.uint64)


class Agenda:
    def __init__(self, pairs: Pairs, below: int = 0):
        """below: a candidate is skipped if the upper half of its draw is below this number."""
        self.pairs, self.below = pairs, below
        self.keys = span_keys() if below else np.zeros(0, np.uint64)

    def settle(self, symbols: np.ndarray, starts: np.ndarray, owns: np.ndarray | None = None) -> None:
        """Work on all units (from each start to the next), in place: what is left stands where it starts, others are -1."""
        lens = np.diff(np.append(starts, len(symbols)))
        kind = np.minimum(lens, WIDEST + 1).astype(np.int8)
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(WIDEST + 2))
        for width in range(2, WIDEST + 1):
            end = cuts[width + 1]
            step = max(1, CELLS // width)
            for a in range(cuts[width], end, step):
                which = order[a : min(end, a + step)]
                self._beside(symbols, starts[which], width, owns[which] if self.below else None)
        for u in order[cuts[WIDEST + 1] :]:
            a, b = int(starts[u]), int(starts[u] + lens[u])
            own = int(owns[u]) if self.below else 0
            symbols[a:b] = self.alone(symbols[a:b].tolist(), (lambda *c: mixed(span_key(*c) ^ own) >> 32 < self.below) if self.below else None)

    def _skipped(self, start, middle, end, own: np.ndarray) -> np.ndarray:
        w = WIDEST + 1
        x = self.keys[(start * w + middle) * w + end] ^ own
        x ^= x >> np.uint64(32)
        x *= np.uint64(B.MIX)
        x ^= x >> np.uint64(29)
        return x < np.uint64(self.below << 32)

    def _beside(self, symbols: np.ndarray, starts: np.ndarray, width: int, own: np.ndarray | None) -> None:
        pairs, n = self.pairs, len(starts)
        columns = np.arange(width)[:, None]
        sym = np.full((width + 2, n), pairs.none, np.int32)  # two rows of symbols that never merge, behind and before
        sym[:width] = symbols[starts[None, :] + columns]
        after = np.empty((width + 2, n), np.int32)
        before = np.empty((width + 2, n), np.int32)
        after[:] = np.arange(1, width + 3)[:, None]
        before[:] = np.arange(-1, width + 1)[:, None]
        after[width] = width
        before[0] = width + 1
        at, there = pairs.slots(sym[: width - 1], sym[1:width])
        if own is not None:
            first = np.arange(width - 1)[:, None]
            there &= ~self._skipped(first, first + 1, first + 2, own[None, :])
        rank = np.full((width + 2, n), NONE, np.int32)
        rank[: width - 1] = np.where(there, pairs.rank[at] << 5 | columns[: width - 1].astype(np.int32), NONE)
        made = np.zeros((width + 2, n), np.int32)
        made[: width - 1] = pairs.result[at]
        while True:
            best = rank[:width].min(axis=0)
            rows = np.flatnonzero(best != NONE)
            if 2 * len(rows) < n:
                done = best == NONE
                symbols[starts[done][None, :] + columns] = sym[:width, done]
                if not len(rows):
                    return
                n, best, starts = len(rows), best[rows], starts[rows]
                sym, after, before, rank, made = (np.ascontiguousarray(x[:, rows]) for x in (sym, after, before, rank, made))
                own = own[rows] if own is not None else None
                rows = np.arange(n)
            s, a, b, r, m = sym.reshape(-1), after.reshape(-1), before.reshape(-1), rank.reshape(-1), made.reshape(-1)
            i = (best[rows] if len(rows) < n else best) & 31
            fi = i * n + rows
            j = a[fi]
            fj = j * n + rows
            k = a[fj]
            fk = k * n + rows
            new = m[fi]
            s[fi] = new
            s[fj] = -1
            r[fj] = NONE
            a[fi] = k
            b[fk] = i
            mine = own[rows] if own is not None else None
            # The pair with what follows, then the pair with what comes before.
            at, there = pairs.slots(new, s[fk])
            r[fi] = np.where(there, pairs.rank[at] << 5 | i, NONE)
            m[fi] = pairs.result[at]
            p = b[fi]
            fp = p * n + rows
            at2, there2 = pairs.slots(s[fp], new)
            r[fp] = np.where(there2, pairs.rank[at2] << 5 | p, NONE)
            m[fp] = pairs.result[at2]
            if mine is not None:
                x = np.flatnonzero(there)
                x = x[self._skipped(i[x], k[x], a[fk[x]], mine[x])]
                r[fi[x]] = NONE
                x = np.flatnonzero(there2)
                x = x[self._skipped(p[x], i[x], k[x], mine[x])]
                r[fp[x]] = NONE

    def alone(self, unit: list[int], skips: Callable[[int, int, int], bool] | None) -> list[int]:
        """The same for one unit of any length, by a heap."""
        n = len(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []
        plain = self.pairs.plain

        def propose(i: int) -> None:
            j = after[i]
            if j < n:
                found = plain.get((unit[i], unit[j]))
                if found and not (skips and skips(i, j, after[j])):
                    heapq.heappush(heap, (found[0], i, j, after[j], found[1]))

        for i in range(n - 1):
            propose(i)
        while heap:
            _, i, j, k, new = heapq.heappop(heap)
            if unit[i] < 0 or after[i] != j or unit[j] < 0 or after[j] != k:
                continue  # one of the two has been merged since
            unit[i], unit[j] = new, -1
            after[i] = k
            if k < n:
                before[k] = i
            if before[i] >= 0:
                propose(before[i])
            propose(i)
        return unit
