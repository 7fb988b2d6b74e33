"""Exact repeated byte strings: every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else.

The question is which of the corpus's windows of LENGTH bytes occur twice.  Each window names an anchor, the least of its
inner GRAM-byte strings by hash (the leftmost of equals), so equal windows name equal anchors, and
consecutive windows mostly share one.  The windows of one anchor occurrence form a segment.

1. Anchors: one row a segment (about one in 170 bytes): the anchor's hash, where its windows start, a 128-bit hash of the segment.
2. An anchor that occurs once has no repeated window.  One whose segments are all the same has only repeated windows.
3. For the others one segment of each kind is fetched, and windows are compared within the anchor by rolling hash.
4. Repeated starts come back to every text that holds the segment; covered bytes are merged and cut out.

Texts count by class of equal texts, so a crowd of copies is one text in steps 1 to 3 and goes whole if it is long enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm.common import stored

GRAM, CHUNK = 64, 1 << 19
_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Anchors with more kinds of segments than this are compared by a shuffle of window hashes, not in one task.
HOT_KINDS = 20_000


def rolling(b: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit polynomial hash of each ``length`` bytes, by doubling."""
    h = b.astype(np.uint64) + np.uint64(1)
    out, out_len, size, power = None, 0, 1, _B
    rest = length
    while True:
        if rest & 1:
            if out is None:
                out, out_len = h, size
            else:
                n = len(b) - out_len - size + 1
                out = out[:n] * np.uint64(power) + h[out_len : out_len + n]
                out_len += size
        rest >>= 1
        if not rest:
            break
        n = len(h) - size
        h = h[:n] * np.uint64(power) + h[size : size + n]
        size *= 2
        power = power * power & _MASK
    h = out
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _rolling(b: np.ndarray, length: int) -> np.ndarray:
    return rolling(b, length) if len(b) >= length else np.empty(0, np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours: running minima of blocks from either side."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(b: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first start, last start) of the segments, for a chunk of starts at a time."""
    w = length - GRAM + 1
    last = len(b) - length
    for c in range(0, last + 1, CHUNK):
        e = min(last, c + CHUNK - 1)
        g = rolling(b[c : e + length], GRAM)
        m = sliding_min((g >> np.uint64(20) << np.uint64(20)) | np.arange(len(g), dtype=np.uint64), w)
        at = (m & np.uint64((1 << 20) - 1)).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        hi = np.concatenate([lo[1:] - 1, [e - c]])
        yield g[at[lo]].view(np.int64), lo + c, hi + c


def _anchor_rows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, c1, c2, text -> doc_id, c1, c2, h, s1, s2, lo, hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i0 in range(0, batch.num_rows, 512):
                part = batch.slice(i0, 512)
                row, hs, los, his, kinds = [], [], [], [], []
                for i, t in enumerate(part.column(3)):
                    raw = t.as_buffer()
                    if raw is None or raw.size < length:
                        continue
                    view = memoryview(raw)
                    for h, lo, hi in segments(np.frombuffer(raw, np.uint8), length):
                        row.append(np.full(len(h), i))
                        hs.append(h)
                        los.append(lo)
                        his.append(hi)
                        kinds += [xxhash.xxh3_128_digest(view[a : z + length]) for a, z in zip(lo.tolist(), hi.tolist())]
                if row:
                    at = pa.array(np.concatenate(row))
                    s = np.frombuffer(b"".join(kinds), "<i8").reshape(-1, 2)
                    cols = [part.column(k).take(at) for k in range(3)]
                    yield pa.RecordBatch.from_arrays(
                        [*cols, pa.array(np.concatenate(hs)), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), pa.array(np.concatenate(los)), pa.array(np.concatenate(his))],
                        names=["doc_id", "c1", "c2", "h", "s1", "s2", "lo", "hi"],
                    )

    return run


def _fetch(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """text, want (list of h, s1, s2, lo, hi) -> h, s1, s2, seg."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i0 in range(0, batch.num_rows, 256):
                part = batch.slice(i0, 256)
                out: list[list] = [[], [], [], []]
                for text, want in zip(part.column(0), part.column(1)):
                    raw = memoryview(text.as_buffer())
                    for x in want.as_py():
                        out[0].append(x["h"])
                        out[1].append(x["s1"])
                        out[2].append(x["s2"])
                        out[3].append(bytes(raw[x["lo"] : x["hi"] + length]))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.binary())], names=["h", "s1", "s2", "seg"])

    return run


def _windows(rows: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window hash, row and offset of every window of the segments."""
    sizes = np.array([len(r[3]) for r in rows])
    h = _rolling(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), length)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return h[starts[row] + off], row, off


def _runs(row: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive offsets of one row as (row, first, last)."""
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1)])
    lo = np.flatnonzero(new)
    hi = np.concatenate([lo[1:] - 1, [len(row) - 1]])
    return row[lo], off[lo], off[hi]


def _compare(length: int, block: int = 3_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """h, s1, s2, seg sorted by h -> h, s1, s2, a, b: runs of window offsets that some other window of the anchor equals."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        w, row, off = _windows(rows, length)
        anchor = np.array([r[0] for r in rows], np.int64).view(np.uint64)[row]
        w = w ^ (anchor * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(w, kind="stable")
        s = w[order]
        same = s[1:] == s[:-1]
        hit = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        if not len(hit):
            return None
        hit.sort()
        r, a, b = _runs(row[hit], off[hit])
        keys = np.array([x[:3] for x in rows], np.int64)[r]
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(keys[:, 2].copy()), pa.array(a), pa.array(b)], names=["h", "s1", "s2", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= block and r[0] != last:
                    if (out := solve(rows)) is not None:
                        yield out
                    rows, size = [], 0
                last = r[0]
                rows.append(r)
                size += len(r[3])
        if rows and (out := solve(rows)) is not None:
            yield out

    return run


def _window_rows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """h, s1, s2, seg -> a row a window, for anchors too large for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for lo in range(0, len(rows), 2000):
                part = rows[lo : lo + 2000]
                w, row, off = _windows(part, length)
                keys = np.array([x[:3] for x in part], np.int64)[row]
                yield pa.RecordBatch.from_arrays([*[pa.array(keys[:, k].copy()) for k in range(3)], pa.array(w.view(np.int64)), pa.array(off)], names=["h", "s1", "s2", "w", "a"])

    return run


def _cut_out(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, text, copies, runs (list of a, b) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, spans, sha = [], [], [], []
            for text, copies, runs in zip(batch.column(1), batch.column(2), batch.column(3)):
                raw = memoryview(text.as_buffer() or b"")
                n = len(raw)
                cuts = [(0, n)] if copies.as_py() > 1 and n >= length else merged_spans([(x["a"], x["b"]) for x in runs.as_py() or []], length)
                h = hashlib.sha256()
                at = 0
                for a, z in cuts:
                    h.update(raw[at:a])
                    at = z
                h.update(raw[at:])
                n_bytes.append(n)
                removed.append(sum(z - a for a, z in cuts))
                spans.append(len(cuts))
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def merged_spans(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Bytes covered by windows that start in the runs, as maximal [from, to)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + length))
        else:
            out.append((a, b + length))
    return out


def _classed(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", t.alias("text")).select("doc_id", F.xxhash64("text").alias("c1"), F.xxhash64(F.lit(1), "text").alias("c2"), "text")


def repeated_starts(docs: DataFrame, length: int = 400) -> DataFrame:
    """c1, c2 (a text's class), runs: array of (a, b), the starts of its windows that occur anywhere else in another text or at another place of it."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    texts = _classed(docs)
    rows = texts.mapInArrow(_anchor_rows(length), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, c1 bigint, c2 bigint, h bigint, s1 bigint, s2 bigint, lo bigint, hi bigint")
    occ = rows.groupBy("c1", "c2", "lo").agg(*[F.min(c).alias(c) for c in ("hi", "h", "s1", "s2", "doc_id")])
    occ = stored(occ, "anchors")
    per = occ.groupBy("h").agg(F.count("*").alias("n"), F.min("s1").alias("x"), F.max("s1").alias("y")).filter("n > 1").select("h", (F.col("x") == F.col("y")).alias("same"))
    again = stored(occ.join(per, "h"), "anchors-again")
    whole = again.filter("same").select("c1", "c2", F.col("lo").alias("a"), F.col("hi").alias("b"))
    mixed = again.filter("not same")
    kinds = mixed.groupBy("h", "s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct("c1", "c2", "doc_id", "lo", "hi")).alias("r"))
    kinds = stored(kinds, "anchor-kinds")
    want = kinds.groupBy("r.c1", "r.c2", "r.doc_id").agg(F.collect_list(F.struct("h", "s1", "s2", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))).alias("want"))
    seg = texts.join(want, ["c1", "c2", "doc_id"]).dropDuplicates(["c1", "c2", "doc_id"]).select("text", "want").mapInArrow(_fetch(length), "h bigint, s1 bigint, s2 bigint, seg binary")
    hot = stored(kinds.groupBy("h").count().filter(F.col("count") > HOT_KINDS).select("h"), "anchors-hot")
    n_hot = hot.count()
    usual = seg.join(hot, "h", "left_anti") if n_hot else seg
    found = usual.repartition("h").sortWithinPartitions("h").mapInArrow(_compare(length), "h bigint, s1 bigint, s2 bigint, a bigint, b bigint")
    if n_hot:
        w = seg.join(hot, "h", "left_semi").mapInArrow(_window_rows(length), "h bigint, s1 bigint, s2 bigint, w bigint, a bigint")
        twice = w.groupBy("h", "w").count().filter("count > 1").select("h", "w")
        found = found.union(w.join(twice, ["h", "w"]).select("h", "s1", "s2", "a", F.col("a").alias("b")))
    # a kind that occurs twice repeats in all its windows
    found = found.join(kinds.filter("n > 1").select("h", "s1", "s2"), ["h", "s1", "s2"], "left_anti")
    several = mixed.join(kinds.filter("n > 1").select("h", "s1", "s2"), ["h", "s1", "s2"], "left_semi").select("c1", "c2", F.col("lo").alias("a"), F.col("hi").alias("b"))
    single = mixed.join(found, ["h", "s1", "s2"]).select("c1", "c2", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))
    return whole.union(several).union(single).groupBy("c1", "c2").agg(F.collect_list(F.struct("a", "b")).alias("runs"))


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of ``docs``.

    Matches never cross rows.  Null texts are empty.  Rows with equal texts lose them whole if they have ``length`` bytes.  Other columns are ignored.
    """
    texts = _classed(docs)
    runs = stored(repeated_starts(docs, length), "repeats")
    copies = texts.groupBy("c1", "c2").agg(F.count("*").alias("copies")).filter("copies > 1")
    side = runs.join(copies, ["c1", "c2"], "full")
    j = texts.join(side, ["c1", "c2"], "left").select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "runs")
    return j.mapInArrow(_cut_out(length), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
