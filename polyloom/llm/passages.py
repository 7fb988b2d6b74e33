"""Near-duplicate passages by compact windows.

A text is a sequence of 5-word shingles.  Two stretches of ``width`` shingles are similar if they face each other in at least ``need`` of them.  What they
lack is at most ``width - need`` shingles, and an edit takes three or more (a word put in beside its like) to five.  So they share a run
of at least ``need / (1 + edits)`` shingles (21 of 46: ``_run``), and no pair is lost if every such run is looked up.

For a hash, a compact window (l, c, r) stands for all subsequences of l..r that contain c: their least hash is that of c (a node of the
Cartesian tree over the hashes, with its range).  The windows of at least a run are read off the minima of all stretches of that
length: both texts name the least hash of a run they share.  What is hashed are grams of ``GRAM`` shingles (17 words), which
hardly repeat by chance or for a short phrase that many texts share.
Breaks that cost less lie within a word repeated three times or more: grams of 9 words that begin or end with a doubled word are named as well.

1. The hashes named are counted; those that occur twice set a bit in a map, which is broadcast.
2. Windows of one hash and equal surroundings (``width`` - 1 shingles to either side of c) are one class: all of them repeat.
3. Classes of one hash are compared by their surroundings, aligned at c: a pair is linked if facing stretches of
   ``width`` shingles have a Jaccard similarity of at least ``similarity``.  Every class is compared with all that are not yet of its component.
   A hash with over ``BUCKET`` classes is cut into parts, and every two parts are compared together in a task of their own.

Stretches found give each document's passages; documents linked by them form classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm.common import WORD, connected_components, cut, stored
from polyloom.llm.substring_exact import sliding_min

SHINGLE = 5
#: Equal texts (two bigints each) that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Bits of the map of hashes that may repeat (2^26: 8 MB; up to 2^29 for more of them), and of one of its pages.
MAP_BITS, MOST_BITS, PAGE = 26, 29, 32768
#: Classes of one hash that one task compares.
BUCKET = 1 << 16
#: Shingles in a row that are named by one hash, and those at doubled words.
GRAM, TWIN_GRAM = 13, 5
_BLOCK = 1 << 18
_pw = _inv = np.ones(1, np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (A-Z lowered) of the UTF-8 bytes."""
    return _words(b)[0]


def _words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, and where they start."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    if not len(b):
        return none
    space = _SPACE[b]
    inside = ~space
    first = inside & np.concatenate([[True], space[:-1]])
    start = np.flatnonzero(first)
    if not len(start):
        return none
    at = np.flatnonzero(inside)
    word = np.cumsum(first)[at] - 1
    depth = at - start[word]
    power = np.multiply.accumulate(np.full(int(depth.max()) + 1, _P))
    c = b[at]
    c = np.where((c >= 65) & (c <= 90), c + 32, c).astype(np.uint64) + np.uint64(1)
    return np.add.reduceat(c * power[depth], np.flatnonzero(first[at])), start


def shingle_hashes(b: np.ndarray) -> np.ndarray:
    w = word_hashes(b)
    n = len(w) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = _mix(h * _P + w[i : i + n])
    return h


def compact_windows(x: np.ndarray, width: int, function: int, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least hash, l, c, r) of the compact windows of at least ``width`` shingles; ``text`` numbers the text of each shingle, none crosses a border."""
    n = len(x) - width + 1
    if n <= 0:
        z = np.empty(0, np.int64)
        return z, z, z, z
    h = _mix(x ^ np.uint64((function + 1) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF))
    # hash first, then place: ties go to the leftmost (places are counted in pieces of 2^20 that overlap)
    c = np.empty(n, np.int64)
    step = 1 << 19
    for s in range(0, n, step):
        e = min(n, s + step)
        part = h[s : e + width - 1]
        m = sliding_min((part >> np.uint64(20) << np.uint64(20)) | np.arange(len(part), dtype=np.uint64), width)
        c[s:e] = (m & np.uint64((1 << 20) - 1)).astype(np.int64) + s
    start = np.arange(n) if text is None else np.flatnonzero(text[:n] == text[width - 1 :])
    if not len(start):
        return start, start, start, start
    c = c[start]
    lo = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (start[1:] != start[:-1] + 1)]))
    hi = np.concatenate([lo[1:] - 1, [len(c) - 1]])
    return h[c[lo]].view(np.int64), start[lo], c[lo], start[hi] + width - 1  # hashes of two functions differ by their seeds


def _blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shingle hashes, number of the text each belongs to, 1 if it begins with a doubled word and 2 if it ends with one) of the texts,
    some ``_BLOCK`` bytes at a time; null texts have none."""
    raws: list[bytes] = []
    rows: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.frombuffer(b"\n".join(raws), np.uint8)
        w, first = _words(b)
        n = len(w) - SHINGLE + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)
        of = np.searchsorted(np.cumsum([0, *[len(r) + 1 for r in raws[:-1]]]), first, side="right") - 1
        h = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            h = _mix(h * _P + w[i : i + n])
        same = of[:n] == of[SHINGLE - 1 :]
        twin = (w[1:] == w[:-1]).astype(np.uint8)
        return h[same], np.array(rows)[of[:n][same]], (twin[:n] | twin[SHINGLE - 2 :] << np.uint8(1))[same]

    for i, t in enumerate(texts):
        raw = t.as_buffer()
        if raw is None or not raw.size:
            continue
        raws.append(raw)
        rows.append(i)
        size += raw.size
        if size >= _BLOCK:
            yield flush()
            raws, rows, size = [], [], 0
    if raws:
        yield flush()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pw, _inv
    if len(_pw) < n:
        size = max(n, 2 * len(_pw))
        _pw, _inv = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(k))])) for k in (int(_P), pow(int(_P), -1, 1 << 64)))
    return _pw[:n], _inv[:n]


def surroundings(x: np.ndarray, text: np.ndarray, c: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shingles before c, shingles after c, c within its text) of what is around each c, ``width`` - 1 to either side in its text."""
    edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]]))
    k = np.searchsorted(edge, c, side="right") - 1
    first, end = edge[k], edge[k + 1]
    lo, hi = np.maximum(first, c - width + 1), np.minimum(end, c + width)
    pw, inv = _powers(len(x))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * pw)])
    h = (run[hi] - run[lo]) * inv[lo]
    before, after = c - lo, hi - 1 - c
    return _mix(_mix(h) ^ (before.astype(np.uint64) * _P) ^ (after.astype(np.uint64) << np.uint64(40))).view(np.int64), before, after, c - first


def _need(width: int, similarity: float) -> int:
    """Shingles that two sets of ``width`` share at least."""
    return int(np.ceil(2 * width * similarity / (1 + similarity) - 1e-9))


def _edits(width: int, similarity: float) -> int:
    """Breaks that similar stretches may have."""
    lacks = width - _need(width, similarity)
    return lacks // 3 if _drift(width, similarity) <= 1 else lacks


def _run(width: int, similarity: float) -> int:
    """Shingles in a row that similar stretches share at least."""
    return -(-_need(width, similarity) // (_edits(width, similarity) + 1))


def _grams(x: np.ndarray, text: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of all ``g`` shingles in a row of one text."""
    n = len(x) - g + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    y = np.full(n, np.uint64(g))
    for i in range(g):
        y = _mix(y * _P + x[i : i + n])
    at = np.flatnonzero(text[:n] == text[g - 1 :])
    return y[at], at


def anchors(x: np.ndarray, text: np.ndarray, twin: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the grams that stand for all stretches of ``run`` shingles, and of short ones at doubled words."""
    long, short = min(GRAM, run), min(TWIN_GRAM, run)
    y, at = _grams(x, text, long)
    c = compact_windows(y, run - long + 1, 0, text[at])[2]
    z, where = _grams(x, text, short)
    mark = (twin[where] & 1 | twin[where + short - 1] & 2) > 0
    mark[1:] &= (z[1:] != z[:-1]) | (text[where[1:]] != text[where[:-1]])
    return np.concatenate([y[c], z[mark]]).view(np.int64), np.concatenate([at[c], where[mark]])


def _hashes(run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """text -> v, the hashes named."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, text, twin in _blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(x, text, twin, run)[0])], names=["v"])

    return every


def _again(v: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (v.view(np.uint64) >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _candidates(width: int, run: int, bits: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """node, text -> node, v, k, place: grams named that may repeat.

    k: hash of the surroundings; place: c, and the shingles around it before and after, in one bigint.
    """

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits, np.uint8)
        for batch in batches:
            for x, text, twin in _blocks(batch.column(1)):
                v, c = anchors(x, text, twin, run)
                some = _again(v, known)
                v, c = v[some], c[some]
                if len(v):
                    k, before, after, at = surroundings(x, text, c, width)
                    node = batch.column(0).take(pa.array(text[c]))
                    yield pa.RecordBatch.from_arrays([node, pa.array(v), pa.array(k), pa.array(at << 32 | before << 16 | after)], names=["node", "v", "k", "place"])

    return every


def _fetch(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """node, text, want (list of v, place, salt) -> v, salt, node, place, x (16 bits of each shingle around c, 0 outside the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(2)
            at, part = want.offsets.to_numpy(), want.values
            place = part.field("place").to_numpy()
            for x, text, _ in _blocks(batch.column(1)):
                rows = np.unique(text)
                n = at[rows + 1] - at[rows]
                k = np.repeat(at[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first = np.repeat(np.searchsorted(text, rows), n)
                for lo in range(0, len(k), 4096):
                    j = k[lo : lo + 4096]
                    p = place[j]
                    off = np.arange(1 - width, width)
                    inside = (off >= -(p >> 16 & 0xFFFF)[:, None]) & (off <= (p & 0xFFFF)[:, None])
                    i = np.where(inside, (first[lo : lo + 4096] + (p >> 32))[:, None] + off, 0)
                    near = np.where(inside, x[i] & np.uint64(0xFFFF), np.uint64(0)).astype("<u2")
                    kept = part.take(pa.array(j))
                    node = batch.column(0).take(pa.array(np.repeat(rows, n)[lo : lo + 4096]))
                    content = pa.FixedSizeBinaryArray.from_buffers(pa.binary(near.shape[1] * 2), len(j), [None, pa.py_buffer(near.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([kept.field("v"), kept.field("salt"), node, kept.field("place"), content], names=["v", "salt", "node", "place", "x"])

    return run


def _drift(width: int, similarity: float) -> int:
    """By how many places words put in or left out can move a similar stretch."""
    return max(0, width - _need(width, similarity) - SHINGLE + 1)


def similar(a: np.ndarray, b: np.ndarray, before: np.ndarray, after: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of surroundings (aligned at the middle; ``before`` and ``after`` count what both texts have there) the first and last start
    of facing stretches of ``width`` shingles with a Jaccard similarity of at least ``similarity``; last < first if there are none.

    A shingle counts if the facing stretch has it at the same place or, for words put in or left out, at most ``drift`` places off.
    """
    need = _need(width, similarity)
    drift = _drift(width, similarity)
    n, size = a.shape
    first, last = np.full(n, width), np.full(n, -1)
    off = np.full(a.shape, 127, np.int8)  # distance of the match next to each place
    for d in range(drift, 0, -1):
        v = off[:, d:]
        v[a[:, d:] == b[:, :-d]] = -d
        v = off[:, :-d]
        v[a[:, :-d] == b[:, d:]] = d
    off[a == b] = 0
    hit = off < 127
    some = np.flatnonzero(hit.sum(axis=1) >= need)
    if not len(some):
        return first, last
    off, hit = off[some], hit[some]
    total = np.zeros((len(some), size + 1), np.int16)
    np.cumsum(hit, axis=1, out=total[:, 1:])
    count = total[:, width:] - total[:, : size - width + 1]
    for d in range(1, drift + 1):
        # a match that lies outside the facing stretch
        for e in range(d):
            count -= off[:, e : e + count.shape[1]] == -d
            count -= off[:, width - 1 - e : width - 1 - e + count.shape[1]] == d
    s = np.arange(count.shape[1])
    ok = (count >= need) & (s >= (width - 1 - before[some])[:, None]) & (s <= after[some][:, None])
    found = ok.any(axis=1)
    first[some[found]] = ok[found].argmax(axis=1)
    last[some[found]] = width - 1 - ok[found, ::-1].argmax(axis=1)
    return first, last


class _Groups:
    """Compares the classes of each group; pairs of small groups are pooled."""

    def __init__(self, width: int, similarity: float):
        self.width, self.similarity = width, similarity
        self.pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pooled = 0

    def _compare(self, x: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which pairs are similar; widens the stretches lo, hi (around c) of their members."""
        good = np.zeros(len(i), bool)
        for s in range(0, len(i), 8192):
            a, b = i[s : s + 8192], j[s : s + 8192]
            before = np.minimum(place[a] >> 16 & 0xFFFF, place[b] >> 16 & 0xFFFF)
            after = np.minimum(place[a] & 0xFFFF, place[b] & 0xFFFF)
            p, q = similar(x[a], x[b], before, after, self.width, self.similarity)
            ok = q >= p
            good[s : s + 8192] = ok
            for side in (a[ok], b[ok]):
                np.minimum.at(lo, side, p[ok] - self.width + 1)
                np.maximum.at(hi, side, q[ok])
        return good

    def large(self, x: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(component, lo, hi) of the classes of one group: each is compared with all of another component that can be similar.

        One that agrees with many is compared with all first.  Where two others agree in what it explains of them, they agree with it as well: a pair of different
        components agrees in two neighbouring shingles that it does not explain in one of them or the other, so only classes that share such shingles are compared.
        What that argument leaves out (a run of one shingle at a break, shingles that two face at once where a word is repeated) keeps a class just
        below the limit: all that come so near to the first are compared with every class.
        """
        m = len(x)
        comp, lo, hi = np.arange(m), np.full(m, self.width), np.full(m, -self.width)
        if m < 2:
            return comp, lo, hi

        def join(i: int, j: np.ndarray) -> None:
            good = j[self._compare(x, place, np.minimum(i, j), np.maximum(i, j), lo, hi)]
            if len(good):
                both = np.unique(comp[np.append(good, i)])
                comp[np.isin(comp, both)] = both[0]

        some = np.arange(0, m, -(-m // 256))
        first = int(some[(x[some, None] == x[some]).sum(axis=(1, 2)).argmax()])
        join(first, np.delete(np.arange(m), first))
        need, drift = _need(self.width, self.similarity), _drift(self.width, self.similarity)
        off = np.arange(1 - self.width, self.width)

        def blocks() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """(first row, which shingles the first explains, every two neighbouring shingles), some rows at a time."""
            for s in range(0, m, 4096):
                y = x[s : s + 4096]
                known = y == x[first]
                for d in range(1, drift + 1):
                    known[:, d:] |= y[:, d:] == x[first, :-d]
                    known[:, :-d] |= y[:, :-d] == x[first, d:]
                yield s, known, y[:, :-1].astype(np.uint32) << np.uint32(16) | y[:, 1:]

        near, values = np.zeros(m, bool), []
        for s, known, two in blocks():
            values.append(np.unique(two[(~known[:, :-1] | ~known[:, 1:]) & (two != 0)]))
            p = place[s : s + 4096]
            known &= (off >= -(p >> 16 & 0xFFFF)[:, None]) & (off <= (p & 0xFFFF)[:, None])
            total = np.cumsum(known, axis=1, dtype=np.int32)
            held = total[:, self.width - 1 :] - total[:, : self.width] + known[:, : self.width]
            near[s : s + 4096] = held.max(axis=1) >= need - _edits(self.width, self.similarity) - 2 * drift
        every = np.arange(m)
        for i in np.flatnonzero(near & (comp != comp[first])).tolist():
            j = every[comp != comp[i]]
            if len(j):
                join(i, j)
        values = np.unique(np.concatenate(values))
        if not len(values):
            return comp, lo, hi
        # who has each of the values, the first of its rows in ascending order; even codes: it is unexplained there
        codes = []
        for s, known, two in blocks():
            k = np.minimum(np.searchsorted(values, two), len(values) - 1)
            row, at = np.nonzero(values[k] == two)
            codes.append(np.unique((k[row, at] * m + row + s) * 2 + (known[row, at] & known[row, at + 1])))
        code = np.sort(np.concatenate(codes))
        code = code[np.concatenate([[True], code[1:] >> 1 != code[:-1] >> 1])]
        value, row, new = (code >> 1) // m, (code >> 1) % m, code & 1 == 0
        # values within one component are done
        edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        mixed = np.minimum.reduceat(comp[row], edge) != np.maximum.reduceat(comp[row], edge)
        size = np.diff(edge, append=len(value))
        keep = np.repeat(mixed, size)
        row, new, size = row[keep], new[keep], size[mixed]
        end = np.cumsum(size)
        of = np.repeat(np.arange(len(size)), size)[new]
        order = np.argsort(row[new], kind="stable")
        left, begin = np.unique(row[new][order], return_index=True)
        waits = np.isin(np.arange(m), left)
        for i, mine in zip(left.tolist(), np.split(of[order], begin[1:])):
            if size[mine].sum() <= m:
                at = np.concatenate([np.arange(z - n, z) for n, z in zip(size[mine].tolist(), end[mine].tolist())])
                at = at[comp[row[at]] != comp[i]]
                j = np.unique(row[at[(row[at] > i) | ~new[at]]])
            else:
                j = every[(comp != comp[i]) & ((every > i) | ~waits)]
            if len(j):
                join(i, j)
        return comp, lo, hi

    def small(self, sizes: list[int], x: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for many small groups that lie one after the other: all their pairs at once."""
        start = np.cumsum([0, *sizes[:-1]])
        pairs = [np.stack(np.triu_indices(n, 1)) + s for n, s in zip(sizes, start)]
        i, j = np.concatenate(pairs, axis=1)
        m = len(x)
        comp, lo, hi = np.arange(m), np.full(m, self.width), np.full(m, -self.width)
        good = self._compare(x, place, i, j, lo, hi)
        i, j = i[good], j[good]
        while len(i):
            a, b = comp[i], comp[j]
            low = np.minimum(a, b)
            np.minimum.at(comp, a, low)
            np.minimum.at(comp, b, low)
            # the least member of each component
            while (up := comp[comp]).tobytes() != comp.tobytes():
                comp = up
            open_ = comp[i] != comp[j]
            i, j = i[open_], j[open_]
        return comp, lo, hi


def _compare_groups(width: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """v, salt, node, place, x sorted by v and salt -> node, root, l, r of the classes that are similar to another."""
    size = 2 * (2 * width - 1)

    def emit(t: pa.Table, comp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, place = t["node"].to_numpy(), t["place"].to_numpy()
        found = np.flatnonzero(hi >= lo)
        c = place[found] >> 32
        if len(found):
            ends = [pa.array((c + side[found]).astype(np.int32)) for side in (lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(node[comp[found]]), *ends], names=["node", "root", "l", "r"])

    def flat(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t["x"].to_pylist()), "<u2").reshape(-1, size // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Groups(width, similarity)
        pool: list[pa.Table] = []
        sizes: list[int] = []
        group: list[pa.Table] = []

        def drain() -> Iterator[pa.RecordBatch]:
            if pool:
                t = pa.concat_tables(pool)
                yield from emit(t, *g.small(sizes, flat(t), t["place"].to_numpy()))
                pool.clear()
                sizes.clear()

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(group)
            group.clear()
            if len(t) <= 32:
                pool.append(t)
                sizes.append(len(t))
                if sum(sizes) > 20_000:
                    yield from drain()
            else:
                yield from emit(t, *g.large(flat(t), t["place"].to_numpy()))

        last = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            v, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((v[1:] != v[:-1]) | (salt[1:] != salt[:-1])) + 1).tolist(), len(v)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if group and (v[a], salt[a]) != last:
                    yield from close()
                last = (v[a], salt[a])
                group.append(t.slice(a, z - a))
        if group:
            yield from close()
        yield from drain()

    return run


def _merged(extra: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """node, s (list of l, r in shingles) -> node, merged (list of l, r in words): overlapping and touching spans are one."""
    kind = pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(1)
            at = spans.offsets.to_numpy()
            lo, hi = (spans.values.field(k).to_numpy() for k in (0, 1))
            out = []
            for i in range(batch.num_rows):
                a, z = lo[at[i] : at[i + 1]], hi[at[i] : at[i + 1]] + extra
                order = np.argsort(a, kind="stable")
                a, z = a[order], np.maximum.accumulate(z[order])
                new = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1] + 1]))
                out.append([{"l": x, "r": y} for x, y in zip(a[new].tolist(), z[np.concatenate([new[1:] - 1, [len(z) - 1]]).astype(int)].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["node", "merged"])

    return run


def _repeated_hashes(texts: DataFrame, run: int) -> bytes:
    """A map of 2^MAP_BITS bits or more: those of the hashes named that occur twice are set (others may share them)."""
    v = texts.select("text").mapInArrow(_hashes(run), "v bigint")
    twice = stored(v.groupBy("v").count().filter("count > 1").select("v"), "passage-hashes")
    size = min(max(MAP_BITS, (16 * twice.count()).bit_length()), MOST_BITS)
    twice = twice.select(F.shiftrightunsigned("v", 64 - size).alias("b"))
    pages = twice.groupBy(F.floor(F.col("b") / PAGE).cast("int").alias("page")).agg(F.expr(f"bitmap_construct_agg(b % {PAGE})").alias("bits"))
    bits = bytearray(1 << size - 3)
    for r in pages.toLocalIterator():
        bits[r.page * (PAGE // 8) : (r.page + 1) * (PAGE // 8)] = r.bits
    return bytes(bits)


def near_passages(docs: DataFrame, words: int = 50, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_passages, n_passage_words, passages (array of first and last word), component_id: a row for each row of ``docs``.

    A passage is a run of at least ``words`` words with a near copy in another text, or at another place of one.  component_id is the least
    doc_id among the documents reachable over such passages (equal texts of that many words included; itself, if none).
    Texts that are null, empty or shorter have no passages; very long ones are read whole.  Rows with equal texts share passages, whatever their ids;
    a null doc_id is no one's component_id but its own.  An empty table gives no rows; other columns are ignored.
    """
    width = words - SHINGLE + 1
    if not 2 <= width < 1 << 13 or not 0 < similarity <= 1:
        raise ValueError("words or similarity out of range")
    run = _run(width, similarity)
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).select("doc_id", F.xxhash64(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).alias("node"), "text")
    # of equal texts one row goes on; the others are listed (up to BROADCAST_ROWS of them broadcast, more joined by a shuffle)
    copies = texts.groupBy("node").agg(F.min(F.col("doc_id")).alias("rep"), F.count("*").alias("n")).filter("n > 1").select("node", "rep")
    copies = stored(copies, "passage-copies")
    few = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    single = texts.join(few, "node", "left").filter(F.col("rep").isNull() | (F.col("rep") == F.col("doc_id"))).select("node", "text")
    bits = spark.sparkContext.broadcast(_repeated_hashes(single, run))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _candidates(width, run, bits.value)(batches)

    rows = stored(single.mapInArrow(candidates, "node bigint, v bigint, k bigint, place bigint"), "windows")
    # rows that repeat in id and text come twice, at one place
    at = F.struct("node", "place")
    classes = rows.groupBy("v", "k").agg(F.min(at).alias("rep"), (F.min(at) != F.max(at)).alias("again"))
    classes = stored(classes, "window-classes")
    # equal surroundings
    same = rows.join(classes.filter("again").select("v", "k", F.col("rep.node").alias("root")), ["v", "k"])
    c, before, after = F.shiftright("place", 32), F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF)), F.col("place").bitwiseAND(F.lit(0xFFFF))
    same = same.select("node", "root", (c - before).cast("int").alias("l"), (c + after).cast("int").alias("r")).distinct()
    found = [stored(same, "passages-equal")]
    # similar surroundings: one row for each class
    many = classes.groupBy("v").agg(F.count("*").alias("m")).filter("m > 1")
    level = classes.select("v", "k", "rep.node", "rep.place").join(many, "v")
    # over BUCKET classes: parts of half as many, each in one group with every other
    parts = F.ceil(2 * F.col("m") / BUCKET).cast("int")
    own = F.pmod("k", parts).cast("int")
    salts = F.when(F.col("m") > BUCKET, F.transform(F.filter(F.sequence(F.lit(0), parts - 1), lambda j: j != own), lambda j: F.least(own, j).cast("long") * parts + F.greatest(own, j))).otherwise(F.array(F.lit(0).cast("long")))
    want = level.select("node", "v", "place", F.explode(salts).alias("salt")).groupBy("node").agg(F.collect_list(F.struct("v", "place", "salt")).alias("want"))
    got = single.join(want, "node").dropDuplicates(["node"]).select("node", "text", "want").mapInArrow(_fetch(width), "v bigint, salt bigint, node bigint, place bigint, x binary")
    out = got.repartition("v", "salt").sortWithinPartitions("v", "salt").mapInArrow(_compare_groups(width, similarity), "node bigint, root bigint, l int, r int")
    found.append(stored(out, "passages-similar"))
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    linked = every.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    spans = every.groupBy("node").agg(F.collect_set(F.struct("l", "r")).alias("s")).mapInArrow(_merged(SHINGLE - 1), "node bigint, merged array<struct<l:int,r:int>>")
    return _per_document(texts, linked, spans, words)


def _per_document(texts: DataFrame, linked: DataFrame, spans: DataFrame, words: int) -> DataFrame:
    base = stored(texts.select("doc_id", "node", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("n_words")), "passage-texts")
    least = base.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n_words").alias("nw"))
    comps = connected_components(linked)
    named = comps.join(least, "node")
    low = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = cut(named.join(low, "component").select("node", "component_id"))
    info = least.join(of, "node", "left").join(spans, "node", "left")
    whole = F.array(F.struct(F.lit(0).alias("l"), (F.col("nw") - 1).cast("int").alias("r")))
    passages = F.when((F.col("copies") > 1) & (F.col("nw") >= words), whole).otherwise(F.coalesce("merged", F.slice(whole, 1, 0)))
    info = info.select("node", passages.alias("passages"), F.when(F.col("nw") >= words, F.coalesce("component_id", "least")).alias("component_id"))
    out = base.join(info, "node")
    return out.select(
        "doc_id",
        F.size("passages").cast("long").alias("n_passages"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda acc, x: acc + x["r"] - x["l"] + 1).alias("n_passage_words"),
        "passages",
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )
