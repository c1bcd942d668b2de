"""Merging adjacent symbols in order of rank, for very many short stretches together.

Every stretch has an agenda: the rank of each pair of neighbours that may be
merged. A step merges the best pair of each stretch, the leftmost of equals,
so all stretches of one length lose one symbol and stay a matrix. Stretches
beyond LONG symbols go through a heap one by one.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

LONG = 48
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Agenda:
    """Ranks of pairs: (left, right) symbols below `width` become `merged` at `rank`."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, width: int):
        self.width = width
        bits = max(8, int(len(left) * 6).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        # entry n is what a pair that cannot be merged finds
        self.rank, self.merged = np.append(rank, _NONE).astype(np.int32), np.append(merged, 0).astype(np.int32)
        self.keys, self.entry = np.full(1 << bits, -1, np.int64), np.full(1 << bits, len(left), np.int32)
        keys = np.asarray(left, np.int64) * width + right
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.entry[slot[free]] = keys[todo[free]], todo[free]
            lost = self.keys[slot] != keys[todo]
            todo, slot = todo[lost], slot[lost] + 1 & self.mask
        self._dict: dict[int, tuple[int, int]] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _MIX >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The entry of each pair."""
        keys = left.astype(np.int64) * self.width + right
        slot = self._slot(keys)
        out, there = self.entry[slot], self.keys[slot]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            at = slot[open_]
            out[open_], there = self.entry[at], self.keys[at]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        # a slot that holds nothing has the entry of no pair
        return out

    def run(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols that stay, how many of each stretch): symbols[:sizes[0]] is the first stretch, and so on."""
        out, counts = symbols.copy(), sizes.copy()
        begin = np.cumsum(sizes) - sizes
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            if size > LONG:
                for k in at.tolist():
                    left = self._one(symbols[begin[k] : begin[k] + size].tolist())
                    out[begin[k] : begin[k] + len(left)], counts[k] = left, len(left)
            elif size > 1:
                self._level(symbols[begin[at, None] + np.arange(size)], at, begin, out, counts)
        fill = np.zeros(len(symbols) + 1, np.int32)
        np.add.at(fill, begin, 1)
        np.add.at(fill, begin + counts, -1)
        return out[np.cumsum(fill[:-1]) > 0], counts

    def _level(self, m: np.ndarray, at: np.ndarray, begin: np.ndarray, out: np.ndarray, counts: np.ndarray) -> None:
        """Merge stretches of one length, rows of m; what stays goes to the front of each one's place in out."""

        def settle(rows: np.ndarray, of: np.ndarray) -> None:
            out[begin[of, None] + np.arange(rows.shape[1])] = rows
            counts[of] = rows.shape[1]

        found = self.find(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1)
        while m.shape[1] > 1:
            rank = self.rank[found]
            best = rank.argmin(1)
            rows = np.arange(len(m))
            go = rank[rows, best] != _NONE
            if not go.all():
                settle(m[~go], at[~go])
                m, at, found, best = m[go], at[go], found[go], best[go]
                if not len(m):
                    return
                rows = np.arange(len(m))
            n, width = m.shape
            new = self.merged[found[rows, best]]
            keep = np.ones(m.shape, bool)
            keep[rows, best + 1] = False
            m = m[keep].reshape(n, width - 1)
            m[rows, best] = new
            if width == 2:
                break
            keep = np.ones(found.shape, bool)
            keep[rows, best] = False
            found = found[keep].reshape(n, width - 2)
            for k, where in ((best - 1, best > 0), (best, best < width - 2)):
                r = rows[where]
                found[r, k[where]] = self.find(m[r, k[where]], m[r, k[where] + 1])
        settle(m, at)

    def _one(self, symbols: list[int]) -> list[int]:
        if not self._dict:
            used = np.flatnonzero(self.keys >= 0)
            e = self.entry[used]
            self._dict = dict(zip(self.keys[used].tolist(), zip(self.rank[e].tolist(), self.merged[e].tolist())))
        pairs, width, n = self._dict, self.width, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(p[0], i, i + 1, symbols[i], symbols[i + 1], p[1]) for i in range(n - 1) if (p := pairs.get(symbols[i] * width + symbols[i + 1]))]
        heapify(agenda)
        while agenda:
            _, left, right, a, b, new = heappop(agenda)
            # a pair of which one side has changed or gone since is out of date
            if symbols[left] != a or symbols[right] != b or after[left] != right:
                continue
            symbols[left], symbols[right] = new, -1
            following = after[left] = after[right]
            if following >= 0:
                before[following] = left
                if p := pairs.get(new * width + symbols[following]):
                    heappush(agenda, (p[0], left, following, new, symbols[following], p[1]))
            former = before[left]
            if former >= 0 and (p := pairs.get(symbols[former] * width + new)):
                heappush(agenda, (p[0], former, left, symbols[former], new, p[1]))
        return [s for s in symbols if s >= 0]
