"""Suffix arrays by external induced sorting: the method named for exact repeats, as a prototype that no query uses.

Suffixes of type S* (smaller than their right neighbour, after a larger one) are sorted by naming their substrings and by recursion on the names.
All others follow by induction: the least suffix known names the suffix one place before it, which goes into a
priority queue by (symbol, order of arrival).  The queue keeps a bounded heap and spills sorted runs to disk, so memory does not grow with
what waits.  One suffix passes the queue at a time, which is what makes it slow in Python: README has the measured cost.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np


class DiskQueue:
    """A priority queue of (symbol, order, place); beyond ``limit`` entries the heap is written out as a sorted run and merged back as it is read."""

    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self.heap: list[tuple[int, int, int]] = []
        self.runs: list[Iterator[tuple[int, int, int]]] = []
        self.heads: list[tuple[tuple[int, int, int], int]] = []

    def push(self, item: tuple[int, int, int]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            # sorted runs of entries that come later stay apart from those that are read now
            run = np.array(sorted(self.heap), np.int64)
            f = tempfile.TemporaryFile()
            run.tofile(f)
            f.seek(0)
            self.heap.clear()
            self.runs.append(self._read(f))
            self._advance(len(self.runs) - 1)

    @staticmethod
    def _read(f) -> Iterator[tuple[int, int, int]]:
        while len(part := np.fromfile(f, np.int64, 3 * 4096)):
            yield from map(tuple, part.reshape(-1, 3).tolist())
        f.close()

    def _advance(self, k: int) -> None:
        if (item := next(self.runs[k], None)) is not None:
            heapq.heappush(self.heads, (item, k))

    def least(self) -> tuple[int, int, int] | None:
        a = self.heap[0] if self.heap else None
        b = self.heads[0][0] if self.heads else None
        return b if a is None or (b is not None and b < a) else a

    def pop(self) -> tuple[int, int, int]:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, k = heapq.heappop(self.heads)
            self._advance(k)
            return item
        return heapq.heappop(self.heap)


def suffix_array(text: Sequence[int], limit: int = 1 << 20) -> list[int]:
    """Places of the suffixes of ``text`` (bytes, or numbers from 0) in ascending order."""
    n = len(text)
    if n == 0:
        return []
    small = bytearray(n + 1)  # 1: of type S; the empty suffix at n is the least of all
    small[n] = 1
    for i in range(n - 2, -1, -1):
        small[i] = text[i] < text[i + 1] or (text[i] == text[i + 1] and small[i + 1])
    stars = [i for i in range(1, n) if small[i] and not small[i - 1]]
    ends = [*stars[1:], n]
    # symbols with their types: a suffix of type L comes before those of type S with the same symbol
    parts = [tuple(2 * text[j] + small[j] if j < n else -1 for j in range(a, b + 1)) for a, b in zip(stars, ends)]
    name = {p: k for k, p in enumerate(sorted(set(parts)))}
    names = [name[p] for p in parts]
    order = [stars[k] for k in (suffix_array(names, limit) if len(name) < len(names) else sorted(range(len(names)), key=names.__getitem__))]
    # suffixes of type L, upwards
    queue, turn, large, k = DiskQueue(limit), 0, [], 0
    queue.push((text[n - 1], 0, n - 1))
    while True:
        top = queue.least()
        if top is not None and (k == len(order) or top[0] <= text[order[k]]):
            i = queue.pop()[2]
            large.append(i)
        elif k < len(order):
            i = order[k]
            k += 1
        else:
            break
        if i and not small[i - 1]:
            turn += 1
            queue.push((text[i - 1], turn, i - 1))
    # suffixes of type S, downwards
    queue, turn, out, k = DiskQueue(limit), 0, [], len(large) - 1
    while True:
        top = queue.least()
        if top is not None and (k < 0 or -top[0] >= text[large[k]]):
            i = queue.pop()[2]
        elif k >= 0:
            i = large[k]
            k -= 1
        else:
            break
        out.append(i)
        if i and small[i - 1]:
            turn += 1
            queue.push((-text[i - 1], turn, i - 1))
    return out[::-1]
