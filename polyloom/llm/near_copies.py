"""Near copies: documents whose sets of five-word shingles have a Jaccard index of at least ``similarity``, all of them.

SimHash comes first: sets whose fingerprints (the bits that over half of the shingles set) differ in at most two bits are compared, and those that are similar are linked.
It can't find all: a pair at 0.8 differs in about ten of 64 bits, and segments of so few bits select nothing.  So what is not
of one component then goes through a prefix filter, which is exact.  In any common order of the shingles, two similar sets of up to n share one of their first n - ceil(similarity * n) + 1.

1. Equal sets are one node.  Each names its prefix; shingles that are frequent in a sample come last in the order (any order is right,
   rare shingles first keeps boilerplate out of the prefixes).
2. Sets that share a prefix shingle, and whose sizes, places in the order and parity bits allow the overlap, are compared in full.  Of a shingle that more than
   ``HOT`` sets share, first the smallest is compared with the others; then those that are not yet of one component, among themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyloom.llm import simhash
from polyloom.llm.common import connected_components, cut, stored
from polyloom.llm.passages import _P, _mix, shingle_hashes, word_hashes

HOT = 16
#: Nodes (two bigints each) that may be broadcast to fetch their texts.
BROADCAST_ROWS = 1_000_000
#: One of so many documents is in the sample; a shingle is frequent that OFTEN of them hold; at most FREQUENT are kept.
SAMPLE, OFTEN, FREQUENT = 64, 8, 1 << 16
#: Bits a set is first compared by.
PARITY = 2048
_EPS = 1e-9


def shingle_set(b: np.ndarray) -> np.ndarray:
    """The distinct shingles in ascending order; of fewer than five words the one of all."""
    x = shingle_hashes(b)
    if len(x):
        return np.unique(x)
    h = np.zeros(1, np.uint64)
    w = word_hashes(b)
    for k in range(len(w)):
        h = _mix(h * _P + w[k : k + 1])
    return h if len(w) else np.empty(0, np.uint64)


def _set_of(text: pa.Scalar) -> np.ndarray:
    raw = text.as_buffer()
    return shingle_set(np.frombuffer(raw, np.uint8)) if raw is not None and raw.size else np.empty(0, np.uint64)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))


def _prefixes(similarity: float, last: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """..., text -> ..., node, n (size of the set), fp (its SimHash), prefix (shingles in order; those in ``last`` come last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i0 in range(0, batch.num_rows, 512):
                part = batch.slice(i0, 512)
                node, size, first, sets = [], [], [], []
                for t in part.column(part.num_columns - 1):
                    x = _set_of(t)
                    n = len(x)
                    sets.append(x)
                    node.append(xxhash.xxh3_64_intdigest(x.tobytes()))
                    size.append(n)
                    if len(last) and n:
                        late = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x
                        x = np.concatenate([x[~late], x[late]])
                    first.append(x[: n - int(np.ceil(similarity * n - _EPS)) + 1])
                prefix = _lists(first)
                (marks,) = simhash.bit_majority(iter([pa.RecordBatch.from_arrays([_lists(sets)], names=["h"])]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), marks.column(0), prefix],
                    names=[*part.schema.names[:-1], "node", "n", "fp", "prefix"],
                )

    return run


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> x, a row for each of its distinct shingles."""
    for batch in batches:
        for i0 in range(0, batch.num_rows, 512):
            sets = [_set_of(t) for t in batch.column(0).slice(i0, 512)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["x"])


def packed(x: np.ndarray) -> bytes:
    """A sorted set of 32-bit numbers: its gaps, byte by byte, compressed (some 2 bytes a member)."""
    gaps = np.diff(x, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text -> node, n (size of the set), x (the set, packed), p (the parity of its members in each of PARITY classes).

    Members are cut to 32 bits: of two sets of n members n * n / 2^32 are taken for common that are not, 0.0001 for texts of usual length.
    """
    for batch in batches:
        for i0 in range(0, batch.num_rows, 256):
            part = batch.slice(i0, 256)
            sets = [np.unique(_set_of(t).astype(np.uint32)) for t in part.column(1)]
            parity = [np.packbits(np.bincount((x % np.uint32(PARITY)).astype(np.int64), minlength=PARITY) & 1).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array([packed(x) for x in sets], pa.binary()), pa.array(parity, pa.binary())], names=["node", "n", "x", "p"]
            )


def _close(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """a, b, na, nb, pa, pb -> a, b.  Parities that differ are at most as many as the members that only one set has, so no similar pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (m, n, p, q) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))):
                differ = (int.from_bytes(p) ^ int.from_bytes(q)).bit_count()
                good[k] = differ * (1 + similarity) <= (1 - similarity) * (m + n) + _EPS
            yield batch.select([0, 1]).filter(pa.array(good))

    return run


def _similar(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """a, b, xa, xb -> a, b of the pairs that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (p, q) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = unpacked(p.as_py()), unpacked(q.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[k] = both >= similarity * (len(x) + len(y) - both) - _EPS
            yield batch.select([0, 1]).filter(pa.array(good))

    return run


def _may(similarity: float) -> Column:
    """Whether sets of na and nb that share their shingles at ia and ib, and none before, can overlap enough."""
    return F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (1 + similarity) >= similarity * (F.col("na") + F.col("nb")) - _EPS


def _verified(pairs: DataFrame, base: DataFrame, texts: DataFrame, similarity: float, name: str) -> DataFrame:
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-pairs")
    # one document of each set is read again; a second row with its id and text would only repeat a pair
    nodes = base.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").groupBy("node").agg(F.min(F.struct("th_", "doc_id")).alias("r"))
    nodes = stored(nodes.select("node", F.col("r.th_").alias("t_"), F.col("r.doc_id").alias("k_")), f"{name}-nodes")
    few = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    own = texts.join(few, (texts.th_ == few.t_) & texts.doc_id.eqNullSafe(few.k_)).select("node", "text")
    sets = stored(own.mapInArrow(_sets, "node bigint, n int, x binary, p binary"), f"{name}-sets")
    end = lambda k, *cols: sets.select(F.col("node").alias(k), *[F.col(c).alias(c + k) for c in cols])
    near = pairs.join(end("a", "n", "p"), "a").join(end("b", "n", "p"), "b").select("a", "b", "na", "nb", "pa", "pb")
    near = stored(near.mapInArrow(_close(similarity), "a bigint, b bigint").distinct(), f"{name}-close")
    both = near.join(end("a", "x"), "a").join(end("b", "x"), "b")
    return stored(both.select("a", "b", "xa", "xb").mapInArrow(_similar(similarity), "a bigint, b bigint"), name)


def simhash_pairs(base: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): nodes with one SimHash fingerprint, or with two that ``simhash.links`` links; the least node stands for a fingerprint."""
    at = base.select("fp", "node").distinct()
    least = at.groupBy("fp").agg(F.min("node").alias("least"))
    alike = at.join(least, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = simhash.links(least.select("fp"), bits)
    near = near.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return alike.union(near.select(F.col("x").alias("a"), F.col("y").alias("b"))).filter("a <> b")


def links(base: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of nodes that between them connect all similar ones.  base: doc_id, th_, node, n, fp, prefix; texts: doc_id, th_, text."""
    found = _verified(simhash_pairs(base), base, texts, similarity, "near-simhash-links")
    first = cut(connected_components(found).withColumnRenamed("component", "comp"))

    def apart(pairs: DataFrame) -> DataFrame:
        """Without pairs that SimHash has connected."""
        of = lambda k: first.select(F.col("node").alias(k), F.col("comp").alias("comp" + k))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("compa", "a") != F.coalesce("compb", "b")).select("a", "b")

    rows = base.select("node", "n", F.posexplode("prefix").alias("i", "key"))
    w = Window.partitionBy("key")
    met = rows.withColumn("lo", F.min("node").over(w)).withColumn("hi", F.max("node").over(w)).filter("lo <> hi")
    met = stored(met.select("key", "node", "n", "i").distinct(), "near-keys")
    many = met.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("n", "node", "i")).alias("least"))
    met = stored(met.join(many, "key"), "near-members")
    end = lambda s, *more: met.select("key", "m", *[F.col(c).alias(c + s) for c in ("node", "n", "i")], *more)
    few = end("a").filter(F.col("m") <= HOT).drop("m").join(end("b").filter(F.col("m") <= HOT).drop("m"), "key").filter("nodea < nodeb")
    crowd = met.filter(F.col("m") > HOT)
    star = crowd.select("key", F.col("least.node").alias("nodea"), F.col("least.n").alias("na"), F.col("least.i").alias("ia"), F.col("node").alias("nodeb"), F.col("n").alias("nb"), F.col("i").alias("ib")).filter("nodea <> nodeb")
    pick = lambda df: df.filter(_may(similarity)).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"))
    good = found.union(_verified(apart(pick(few).union(pick(star))), base, texts, similarity, "near-links"))
    if crowd.isEmpty():
        return good
    # members of a crowd that its least one did not link: all pairs of two components
    comps = cut(connected_components(good).withColumnRenamed("component", "comp"))
    named = crowd.join(comps, "node", "left").select("key", "node", "n", "i", F.coalesce("comp", "node").alias("comp"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    named = stored(named.join(mixed, "key"), "near-crowds")
    side = lambda s: named.select("key", *[F.col(c).alias(c + s) for c in ("node", "n", "i", "comp")])
    rest = side("a").join(side("b"), "key").filter("compa < compb")
    return good.union(_verified(pick(rest), base, texts, similarity, "near-rest"))


def one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stand for their group (documents connected by similar pairs): the least id, of those the least hash of the text.

    Null texts and those without a word are alike; letters A-Z and white space do not matter.  Rows that repeat in id and text are one document.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    th = F.xxhash64("text", F.lit(3))
    some = docs.filter(F.pmod(F.xxhash64("text", F.lit(4)), F.lit(SAMPLE)) == 0).select("text").distinct()
    often = some.mapInArrow(_all_shingles, "x bigint").groupBy("x").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "x").limit(FREQUENT)
    last = np.sort(np.array([r.x for r in often.select("x").collect()], np.int64).view(np.uint64))
    kind = docs.schema["doc_id"].dataType.simpleString()
    lean = docs.select("doc_id", th.alias("th_"), "text")
    base = stored(lean.mapInArrow(_prefixes(similarity, last), f"doc_id {kind}, th_ bigint, node bigint, n int, fp bigint, prefix array<bigint>"), "near-sets")
    found = connected_components(links(base, lean, similarity))
    g = base.select("doc_id", "th_", "node").join(cut(found), "node", "left").withColumn("group", F.coalesce("component", "node"))
    keep = g.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th_")).alias("r")).select(F.col("r.doc_id").alias("k_"), F.col("r.th_").alias("t_"))
    d = docs.select(F.struct(*docs.columns).alias("row_"), F.col("doc_id").alias("d_"), th.alias("h_"))
    return d.join(keep, d.d_.eqNullSafe(keep.k_) & (d.h_ == keep.t_)).dropDuplicates(["d_", "h_"]).select("row_.*")
