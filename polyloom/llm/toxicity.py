"""Toxicity by compression distance.

zstandard trains two dictionaries, one on toxic and one on ordinary text.
Each window of a text is compressed with both; where the toxic
dictionary makes it shorter, the window speaks for toxicity.

Labels hold for whole documents and most of a toxic document is ordinary, so dictionaries trained on all of either class are
nearly equal and differ by noise.  What the toxic dictionary is trained on is therefore chosen: the parts of words in toxic documents that are made of byte n-grams
whose document frequencies differ between the classes beyond chance (likelihood ratio) and by far.  The ordinary dictionary is trained
on windows spread evenly over the ordinary texts.  The ordinary one's content also follows the toxic one's own, at the same
distances (the trainer runs again on parts it left out), and a marker ends both and every window (so that either compressor writes at least one sequence and a further
match costs two or three bytes): a window without toxic parts compresses to the same length with either.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm.common import cut

WINDOW, OVERLAP, GRAM = 64, 16, 5
_OFFSETS = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])
MARK = bytes([1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17])


@dataclass(frozen=True)
class ToxicityModel:
    """Both dictionaries, and the calibration: score = logistic(weights . features(gains))."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def windows(text: bytes) -> list[bytes]:
    """Overlapping windows, so that a segment of up to OVERLAP bytes is whole in one of them."""
    return [text[i : i + WINDOW + OVERLAP] for i in range(0, len(text), WINDOW)]


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


class Distance:
    """Window lengths under both dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        # literals are stored as they are (fast strategy with a target length), so lengths differ by matches alone
        p = zstandard.ZstdCompressionParameters(
            window_log=16, hash_log=17, min_match=GRAM, strategy=zstandard.STRATEGY_FAST, target_length=1, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        self.toxic, self.ordinary = (
            zstandard.ZstdCompressor(compression_params=p, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for c in (toxic, ordinary)
        )

    def gains(self, text: bytes) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, for each window."""
        t, o = self.toxic.compress, self.ordinary.compress
        return np.array([len(o(w := text[i : i + WINDOW + OVERLAP] + MARK)) - len(t(w)) for i in range(0, len(text), WINDOW)], dtype=np.float64)


def features(gains: np.ndarray) -> np.ndarray:
    """One, the gains' density, how many windows gain, and how many gain much; nothing gained gives zeros, whatever the length."""
    up = np.clip(gains, 0.0, 3.0).sum()
    return np.array([1.0, 10.0 * up / (len(gains) + 20.0), np.log1p((gains >= 2).sum()), np.log1p((gains >= 3).sum())])


def logistic(x: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x @ np.asarray(weights), -30.0, 30.0)))


def _grams(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(b) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for i in range(GRAM):
        g = (g << np.uint64(8)) | b[i : i + n]
    return g


def _document_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and the number of documents that have them after different bytes.

    Near copies of one document repeat its n-grams in one context, so a crowd of them counts once.
    """
    each = []
    for t in texts:
        g, at = np.unique(_grams(t), return_index=True)
        before = np.frombuffer(b"\x00" * 8 + t, np.uint8)
        ctx = np.zeros(len(g), np.uint64)
        for k in range(8):
            ctx = ctx * np.uint64(0x9E3779B97F4A7C15) + before[at + k]
        each.append((g << np.uint64(16)) | (ctx >> np.uint64(48)))
    pairs = np.unique(np.concatenate([np.empty(0, np.uint64), *each]))
    return np.unique(pairs >> np.uint64(16), return_counts=True)


def _telling(own: tuple, other: tuple, n_own: int, n_other: int, least_g2: float, least_lift: float) -> np.ndarray:
    """n-grams that more documents of the own class have than chance allows (log-likelihood ratio)."""
    keys, counts = own
    if not len(keys):
        return keys
    there = np.zeros(len(keys))
    if len(other[0]):
        at = np.searchsorted(other[0], keys)
        at[at == len(other[0])] = 0
        there = np.where(other[0][at] == keys, other[1][at], 0)
    p = (counts + there) / (n_own + n_other)

    def term(k: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9)), 0.0)

    g2 = 2 * (term(counts, n_own * p) + term(there, n_other * p) + term(n_own - counts, n_own * (1 - p)) + term(n_other - there, n_other * (1 - p)))
    # beyond chance, and by far: a syllable that is merely commoner would mark ordinary words
    return keys[(g2 > least_g2) & (counts / n_own > least_lift * (there + 0.5) / n_other)]


def _parts(texts: list[bytes], telling: np.ndarray) -> list[bytes]:
    """Every part of a word covered by telling n-grams, with a space before those that begin a word and a zero byte after."""
    out: list[bytes] = []
    for t in texts if len(telling) else []:
        g = _grams(t)
        pos = np.searchsorted(telling, g)
        pos[pos == len(telling)] = 0
        hit = np.flatnonzero(telling[pos] == g)
        if not len(hit):
            continue
        for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
            lo, hi = int(run[0]), int(run[-1]) + GRAM
            for m in re.finditer(rb"\S+", t[lo:hi]):
                part = m.group()
                if lo + m.start() > 0 and t[lo + m.start() - 1 : lo + m.start()].isspace():
                    part = b" " + part
                if len(part) >= GRAM:
                    out.append(part + b"\x00")
    return out


def _dictionary(samples: list[bytes], capacity: int) -> bytes:
    """A dictionary trained by zstandard; of samples that are too few to train on, those seen most often."""
    try:
        # the content follows the entropy tables, which end in three repeat offsets
        return zstandard.train_dictionary(capacity, samples).as_bytes().partition(_OFFSETS)[2]
    except zstandard.ZstdError:
        often = sorted(Counter(samples).items(), key=lambda x: (x[1], x[0]))
        return b"".join(s for s, n in often if n > 2)[-capacity:]


def _in_rounds(parts: list[bytes], capacity: int) -> bytes:
    """The trainer keeps a few segments of what it is given, so it is run again on the parts that its dictionary lacks."""
    out, left = b"", parts
    while left and capacity - len(out) >= 256:
        out = _dictionary(left, capacity - len(out)) + out
        lacking = {p for p in set(left) if p[:-1] not in out}
        rest = [p for p in left if p in lacking]
        if len(rest) == len(left):
            often = sorted(Counter(rest).items(), key=lambda x: (x[1], x[0]))
            out = b"".join(s for s, n in often if n > 2)[-(capacity - len(out)) :] + out
            break
        left = rest
    # the compressor indexes every third place of a dictionary: thrice, at all three remainders, no part is missed
    return b"".join(out + b"\x00" * (1 + (-len(out)) % 3) for _ in range(3))


def fit(toxic: list[bytes], ordinary: list[bytes], capacity: int = 4096, common: int = 512, sample_windows: int = 20_000, least_g2: float = 30.0, least_lift: float = 4.0) -> ToxicityModel:
    """Train both dictionaries and calibrate their gains with a logistic regression of four weights.

    ``sample_windows`` bounds the windows the ordinary dictionary is trained on, every n-th of all of them.
    """
    if not toxic or not ordinary:
        return ToxicityModel(MARK, MARK, (-4.0, 0.0, 0.0, 0.0))
    ct, co = _document_counts(toxic), _document_counts(ordinary)
    parts = _parts(toxic, _telling(ct, co, len(toxic), len(ordinary), least_g2, least_lift))
    own = _in_rounds(parts, capacity)
    total = sum(-(-len(t) // WINDOW) for t in ordinary)
    step = -(-total // sample_windows)
    pool = [w for k, w in enumerate(w for t in ordinary for w in windows(t)) if k % step == 0] if total else []
    base = _dictionary(pool, 8192)[-common:]
    dict_t, dict_o = (s + base + MARK for s in (own, b"\x00" * len(own)))
    d = Distance(dict_t, dict_o)
    x = np.array([features(d.gains(t)) for t in [*toxic, *ordinary]])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    # a gain never speaks against toxicity: features whose weight would be negative are left out
    w, used = np.zeros(x.shape[1]), np.arange(x.shape[1])
    while True:
        v, z = np.zeros(len(used)), x[:, used]
        for _ in range(30):
            p = logistic(z, tuple(v))
            h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(used))
            v = v + np.linalg.solve(h, z.T @ (y - p) - 1e-2 * v)
        if len(used) == 1 or v[1:].min() >= 0:
            break
        used = np.delete(used, 1 + int(v[1:].argmin()))
    w[used] = v
    # move the border 0.5 to where the harmonic mean of recall and precision is best; equal scores fall on one side of it
    order = np.argsort(-(x @ w), kind="stable")
    down, hits = (x @ w)[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.flatnonzero(np.append(down[1:] < down[:-1], True))
    k = int(ends[f1[ends].argmax()])
    w[0] -= (down[k] + down[k + 1]) / 2 if k + 1 < len(down) else down[k] - 1e-6
    return ToxicityModel(dict_t, dict_o, tuple(map(float, w)))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, sample_chars: int = 1 << 18) -> ToxicityModel:
    """Learn from ``text`` of ``docs`` and ``toxic`` (0/1) of ``labels`` with the same doc_id; rows without a label or text teach nothing.

    ``sample_docs`` bounds the labelled documents taken of either class, by a hash of their id, the same each time; of one with over
    ``sample_chars`` characters 64 pieces spread over the whole text, so many in sum, are read.  Only the sampled ids (two times the bound at most) are
    broadcast, so no text is shuffled but the sample, which one task fits the model on; the driver gets the dictionaries alone.  Documents that
    repeat a text count once; one that has both labels counts for either.  Without labels of both kinds nothing is toxic.
    """
    each = [
        labels.filter(F.col("toxic") == k).select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample_docs) for k in (1, 0)
    ]
    picked = cut(each[0].union(each[1]))
    size, piece = F.char_length("text"), sample_chars // 64
    place = lambda i: (i * (size - piece) / 63).cast("int") + 1
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.substring(F.col("text"), place(i), F.lit(piece))), " ")
    texts = docs.filter("text is not null").select("doc_id", F.when(size > sample_chars, spread).otherwise(F.col("text")).alias("text"))
    sample = texts.join(F.broadcast(picked), "doc_id").select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {(k, normal(t)) for b in batches for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        # in an order of the texts' own, whatever the partitions
        m = fit(sorted(t for k, t in seen if k == 1), sorted(t for k, t in seen if k == 0))
        yield pa.RecordBatch.from_arrays([pa.array([m.toxic], pa.binary()), pa.array([m.ordinary], pa.binary()), pa.array([list(m.weights)], pa.list_(pa.float64()))], names=["toxic", "ordinary", "weights"])

    row = sample.repartition(1).mapInArrow(run, "toxic binary, ordinary binary, weights array<double>").first()
    if row is None:
        return fit([], [])
    return ToxicityModel(bytes(row.toxic), bytes(row.ordinary), tuple(row.weights))


def score(docs: DataFrame, model: ToxicityModel, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_cols`` and ``score`` (0 to 1) of every row's whole text.

    Null and empty texts have no evidence and score low.  Very long texts are read whole, a window at a time.  Rows may repeat, each is scored by itself; equal
    texts score equally.  An empty table gives no rows; other columns are ignored, whatever their names.
    """
    n = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Distance(model.toxic, model.ordinary)
        for batch in batches:
            x = np.array([features(d.gains(normal(t.as_py()))) for t in batch.column(n)]).reshape(-1, len(model.weights))
            s = logistic(x, model.weights)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(s)], names=[*id_cols, "score"])

    lean = docs.select(*id_cols, F.col("text").alias("text_to_score"))
    kinds = ", ".join(f"`{c}` {lean.schema[c].dataType.simpleString()}" for c in id_cols)
    return lean.mapInArrow(run, f"{kinds}, score double")
