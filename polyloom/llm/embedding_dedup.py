"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits the unit sphere by one random direction a level, at the median of a bounded sample that
reached the node (below the depth that the sample allows: that reached the last fitted node above); vectors within a few percent of the median go down both sides (spill).
Trees differ in their directions, so a close pair that one tree parts is together in another.
Vectors are compared within leaves, found pairs are verified in double precision,
and their union over the trees gives links and components.

Identical vectors are one class before anything else, so a crowd of copies is one point in a leaf.  A leaf that holds
more than ``BLOCK`` vectors is compared block against block, each pair of blocks in a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyloom.llm.common import connected_components, cut, stored

BLOCK = 1024


def usable(v: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    x = np.asarray(flat, np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Forest:
    """Directions [tree, level, dim]; for each tree and node (heap order) the median and the spill band; the same for each fitted leaf and each
    level below it, where the sample is too thin for a median a node: those levels cut all parts of a leaf at the leaf's own medians.

    Made of plain arrays, which is what is broadcast.
    """

    def __init__(self, directions: np.ndarray, cuts: np.ndarray, below: np.ndarray):
        self.directions, self.cuts, self.below = directions, cuts, below

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, depth: int, more: int, spill: float, seed: int) -> Forest:
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        directions = rng.standard_normal((trees, max(depth + more, 1), dim))
        directions /= np.linalg.norm(directions, axis=2, keepdims=True)
        cuts, below = np.zeros((trees, 1 << depth, 3)), np.zeros((trees, 1 << depth, more, 3))
        band = [0.5, 0.5 - spill, 0.5 + spill]
        for t in range(trees):
            node = np.ones(len(sample), np.int64)
            for level in range(depth):
                p = sample @ directions[t, level]
                for k in range(1 << level, 2 << level):
                    mine = p[node == k]
                    cuts[t, k] = np.quantile(mine, band) if len(mine) else (0.0, 0.0, 0.0)
                node = 2 * node + (p > cuts[t, node, 0])
            for k in range(1 << depth if more else 0):
                mine = sample[node == k + (1 << depth)]
                if len(mine):
                    below[t, k] = np.quantile(mine @ directions[t, depth:].T, band, axis=0).T
        return cls(directions, cuts, below)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, tree and leaf of every place a vector falls into."""
        rows, trees, nodes = [], [], []
        depth = self.cuts.shape[1].bit_length() - 1
        for t in range(len(self.cuts)):
            row, node, leaf = np.arange(len(x)), np.ones(len(x), np.int64), np.zeros(len(x), np.int64)
            for level in range(depth + self.below.shape[2]):
                p = (x @ self.directions[t, level])[row]
                if level == depth:
                    leaf = node - (1 << depth)
                cut = self.cuts[t, node] if level < depth else self.below[t, leaf, level - depth]
                left, right = p <= cut[:, 2], p >= cut[:, 1]
                # a vector outside the band goes down one side only
                row, node, leaf = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1]), np.concatenate([leaf[left], leaf[right]])
            rows.append(row)
            trees.append(np.full(len(row), t))
            nodes.append(node)
        return np.concatenate(rows), np.concatenate(trees), np.concatenate(nodes)


def _comparer(dim: int, threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Pairs of one block, or between two blocks, of a leaf."""

    def compare(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        x = unit_rows(group["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dim)
        side = group["mb"].to_numpy()
        a_s, b_s = [], []
        if group["lo"][0].as_py() == group["hi"][0].as_py():
            left = right = np.arange(len(ids))
        else:
            left, right = np.flatnonzero(side == group["lo"][0].as_py()), np.flatnonzero(side == group["hi"][0].as_py())
        for s in range(0, len(left), 512):
            part = left[s : s + 512]
            i, j = np.nonzero(x[part] @ x[right].T >= threshold)
            a, b = ids[part[i]], ids[right[j]]
            ok = a < b if left is right else a != b
            a_s.append(np.minimum(a[ok], b[ok]))
            b_s.append(np.maximum(a[ok], b[ok]))
        return pa.table({"a": np.concatenate([np.empty(0, np.int64), *a_s]), "b": np.concatenate([np.empty(0, np.int64), *b_s])})

    return compare


def find_links(classes: DataFrame, threshold: float, trees: int, leaf: int, sample: int, spill: float, seed: int) -> DataFrame:
    """(a, b), a < b: classes (id, label, embedding) of one label and dimension with cosine >= ``threshold`` that share a leaf."""
    spark = classes.sparkSession
    sizes = classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()
    largest = classes.groupBy("label", F.size("embedding").alias("dim")).count().agg(F.max("count")).first()[0] or 0
    out = None
    for r in sizes:
        dim, n = r.dim, r.n
        wanted = max(0, math.ceil(math.log2(max(1, largest / leaf))))
        depth = min(wanted, int(math.log2(max(1, sample / 8))))
        keep = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") / float(1 << 53) < min(1.0, sample / n)
        mine = classes.filter(F.size("embedding") == dim)
        rows = mine.filter(keep).orderBy("id").limit(2 * sample).select("embedding").toArrow()["embedding"].combine_chunks()
        got = unit_rows(rows.flatten().to_numpy(zero_copy_only=False), dim) if len(rows) else np.zeros((0, dim))
        fitted = Forest.fit(got, trees, depth, wanted - depth, spill, seed) if len(got) else Forest.fit(got, trees, 0, 0, spill, seed)
        forest = spark.sparkContext.broadcast((fitted.directions, fitted.cuts, fitted.below))

        def place(batches: Iterator[pa.RecordBatch], forest=forest, dim=dim) -> Iterator[pa.RecordBatch]:
            f = Forest(*forest.value)
            for batch in batches:
                v = batch.column(2)
                if not len(v):
                    continue
                row, tree, node = f.leaves(unit_rows(v.flatten().to_numpy(zero_copy_only=False), dim))
                at = pa.array(row)
                for lo in range(0, len(row), 8192):
                    s = slice(lo, lo + 8192)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at[s]), batch.column(1).take(at[s]), v.take(at[s]), pa.array(tree[s].astype(np.int32)), pa.array(node[s])], names=["id", "label", "embedding", "tree", "node"]
                    )

        kinds = f"id bigint, label {classes.schema['label'].dataType.simpleString()}, embedding {classes.schema['embedding'].dataType.simpleString()}, tree int, node bigint"
        placed = stored(mine.select("id", "label", "embedding").mapInArrow(place, kinds), "leaves")
        full = placed.groupBy("tree", "node", "label").count().filter("count > 1").withColumn("nb", F.ceil(F.col("count") / BLOCK).cast("int"))
        full = full.select("tree", "node", "label", "nb")
        own = placed.join(full, ["tree", "node", "label"])
        mine_b = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
        own = own.withColumn("mb", mine_b).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        own = own.withColumn("lo", F.least("mb", "x")).withColumn("hi", F.greatest("mb", "x"))

        pairs = own.groupBy("tree", "node", "label", "lo", "hi").applyInArrow(_comparer(dim, threshold), "a bigint, b bigint").distinct()
        out = pairs if out is None else out.union(pairs)
    return out if out is not None else spark.createDataFrame([], "a bigint, b bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, trees: int = 8, leaf: int = 256, sample: int = 16384, spill: float = 0.04, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors`` (vec_id, embedding, label).

    Vectors are compared only within a label that is not null and with vectors of their own dimension.  A vector that is null, zero, or
    holds null or non-finite components, or whose label is null, has no links and is its own component.
    Repeated rows are vectors of their own, linked to each other.  Other columns are ignored.

    The least vec_id stands for a component, so rows that repeat an id with other vectors are nodes of their own and link by their own vectors.
    A null vec_id counts as greater than any.  An empty table gives no rows.

    ``sample`` bounds the vectors the trees' medians are fitted on; all vectors are indexed, and leaves hold about ``leaf`` of them whatever their number.
    """
    fine = usable(F.col("embedding")) & F.col("label").isNotNull()
    base = vectors.select("vec_id", "embedding", "label")
    good = base.filter(fine).withColumn("id", F.xxhash64("label", "embedding"))
    # nodes are classes of equal label and vector
    classes = stored(good.groupBy("id", "label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")), "classes")
    pairs = cut(find_links(classes, threshold, trees, leaf, sample, spill, seed))
    comps = connected_components(pairs)
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = classes.select("id", "least", "copies")
    others = both.join(own.select(F.col("id").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    named = comps.select(F.col("node").alias("id"), "component").join(own.select("id", "least"), "id")
    low = named.groupBy("component").agg(F.min("least").alias("low"))
    of = named.join(low, "component").select("id", "low")
    info = own.join(others.withColumnRenamed("a", "id"), "id", "left").join(of, "id", "left")
    info = info.select("id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("low", "least").alias("component_id"))
    j = good.select("vec_id", "id").join(info, "id").select("vec_id", "n_links", "component_id")
    rest = base.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return j.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
