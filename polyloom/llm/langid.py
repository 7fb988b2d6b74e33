"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting and scoring work on flat numpy arrays of code points, a bounded block
of a text at a time, so one very long text costs no more memory than many
short ones.  The log-probability matrix (buckets x languages, 64 K x a few)
is broadcast; its size depends on two parameters and not on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 19
_MUL = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and log P(bucket | language) as float32 [buckets, languages]."""

    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray
    orders: tuple[int, ...]

    @property
    def bits(self) -> int:
        return int(self.log_prob.shape[0]).bit_length() - 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def fold(text: str) -> str:
    """Case folded, with a space at either end so that word edges count."""
    return f" {text.lower()} "


def gram_buckets(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The bucket of each n-gram of code points."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, order, np.uint64)
    for i in range(order):
        h ^= points[i : i + n]
        h *= _MUL
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def blocks(text: str, overlap: int) -> Iterator[np.ndarray]:
    """Code points of ``text`` in blocks that share ``overlap`` points: no n-gram is lost or seen twice."""
    points = code_points(fold(text))
    for at in range(0, max(1, len(points) - overlap), BLOCK):
        yield points[at : at + BLOCK + overlap]


def text_counts(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    total = np.zeros(1 << bits, np.int64)
    for order in orders:
        for part in blocks(text, order - 1):
            total += np.bincount(gram_buckets(part, order, bits), minlength=1 << bits)
    return total


def batch_scores(texts: list[str], model: LanguageModel) -> np.ndarray:
    """Log joint probability [text, language].

    Sparse: the n-grams of many texts lie end to end; rows of the matrix are gathered by bucket
    and summed between text borders.
    """
    out = np.tile(model.log_prior.astype(np.float64), (len(texts), 1))
    pending: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not pending:
            return
        # a separator shorter than any text cannot make n-grams cross borders: those are cut out by the borders below
        for order in model.orders:
            parts = [(i, gram_buckets(p, order, model.bits)) for i, p in pending]
            parts = [(i, b) for i, b in parts if len(b)]
            if not parts:
                continue
            rows = model.log_prob[np.concatenate([b for _, b in parts])]
            starts = np.cumsum([0, *[len(b) for _, b in parts[:-1]]])
            sums = np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
            np.add.at(out, [i for i, _ in parts], sums)
        pending.clear()
        size = 0

    top = max(model.orders)
    for i, text in enumerate(texts):
        points = code_points(fold(text))
        for at in range(0, len(points), BLOCK):
            # n-grams that start in this block
            part = points[at : at + BLOCK + top - 1]
            if at + BLOCK < len(points):
                for order in model.orders:
                    b = gram_buckets(part[: BLOCK + order - 1], order, model.bits)
                    out[i] += model.log_prob[b].sum(axis=0, dtype=np.float64)
            else:
                pending.append((i, part))
                size += len(part)
        if size >= BLOCK:
            flush()
    flush()
    return out


def train(docs: DataFrame, label: str = "lang", sample_chars: int = 24_000_000, bits: int = 16, orders: tuple[int, ...] = (1, 2, 3), max_languages: int = 256, alpha: float = 0.5) -> LanguageModel:
    """Learn from ``text`` and ``label`` of ``docs``.

    ``sample_chars`` bounds what is read to learn: documents are taken by a hash of their text until about as many
    characters a run are expected, the same documents each time.  Counts are summed per partition on the executors;
    ``max_languages`` bounds the counts (languages x buckets) that reach the driver: with more labels than that (an unlikely
    column to learn from) it raises.  Rows may repeat, and count as often; without a labelled text the model knows no language.
    """
    d = docs.select(F.col("text"), F.col(label).alias("label")).filter("text is not null and label is not null")
    stats = d.groupBy("label").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).limit(max_languages + 1).collect()
    if len(stats) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = tuple(sorted(r.label for r in stats))
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros((1 << bits, 0), np.float32), orders)
    share = {r.label: min(1.0, sample_chars / len(stats) / max(1, r.chars)) for r in stats}
    keep = F.shiftrightunsigned(F.xxhash64("text", F.lit(17)), 11).cast("double") / float(1 << 53)
    wanted = F.lit(0.0)
    for lang, s in share.items():
        wanted = F.when(F.col("label") == lang, s).otherwise(wanted)
    picked = d.filter(keep < wanted)
    index = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                c = text_counts(text.as_py(), orders, bits)
                k = index[lang.as_py()]
                sums[k] = sums[k] + c if k in sums else c
        if sums:
            hit = [(k, np.flatnonzero(c)) for k, c in sums.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.full(len(b), k, np.int32) for k, b in hit])), pa.array(np.concatenate([b for _, b in hit]).astype(np.int32)), pa.array(np.concatenate([sums[k][b] for k, b in hit]))],
                names=["k", "b", "c"],
            )

    tall = picked.mapInArrow(count, "k int, b int, c long").groupBy("k", "b").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros((1 << bits, len(languages)))
    counts[tall["b"].to_numpy(), tall["k"].to_numpy()] = tall["c"].to_numpy()
    prob = (counts + alpha) / (counts.sum(axis=0) + alpha * (1 << bits))
    prior = np.array([next(r.n for r in stats if r.label == x) for x in languages], float)
    return LanguageModel(languages, np.log(prior / prior.sum()), np.log(prob).astype(np.float32), orders)


def predict(docs: DataFrame, model: LanguageModel, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_cols``, lang_pred, score for every row.

    Score is the posterior probability of the language named.  A text that is null, empty or
    without any letter is ``und`` with score 0.  Rows may repeat; each is scored by itself.
    """
    spark = docs.sparkSession
    # plain values: the class itself travels with the task
    shared = spark.sparkContext.broadcast((model.languages, model.log_prior, model.log_prob, model.orders))
    lean = docs.select(*id_cols, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    n = len(id_cols)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(*shared.value)
        for batch in batches:
            texts = batch.column(n).to_pylist()
            langs = np.full(len(texts), "und", dtype=object)
            probs = np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if t is not None]
            if at and m.languages:
                s = batch_scores([texts[i] for i in at], m)
                best = s.argmax(axis=1)
                langs[at] = np.array(m.languages, dtype=object)[best]
                probs[at] = 1.0 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(langs, pa.string()), pa.array(probs)], names=[*id_cols, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {lean.schema[c].dataType.simpleString()}" for c in id_cols)
    return lean.mapInArrow(score, f"{kinds}, lang_pred string, score double")
