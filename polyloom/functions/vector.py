"""Vector distances as column expressions over arrays, quantizers, and exact search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: x * y))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """l2 (squared), cosine (1 - cos), inner_product (negated), manhattan, chebyshev, hamming and jaccard (components over 0.5 count as set), pearson (1 - r)."""
    if metric == "l2":
        return _sum(_zip(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "inner_product":
        return -dot(a, b)
    if metric == "cosine":
        norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(norm == 0, 1.0).otherwise(1 - dot(a, b) / norm)
    if metric == "manhattan":
        return _sum(_zip(a, b, lambda x, y: F.abs(x - y)))
    if metric == "chebyshev":
        return F.array_max(_zip(a, b, lambda x, y: F.abs(x - y)))
    if metric == "hamming":
        return _sum(_zip(a, b, lambda x, y: F.when((x > 0.5) != (y > 0.5), 1.0).otherwise(0.0)))
    if metric == "jaccard":
        both = _sum(_zip(a, b, lambda x, y: F.when((x > 0.5) & (y > 0.5), 1.0).otherwise(0.0)))
        some = _sum(_zip(a, b, lambda x, y: F.when((x > 0.5) | (y > 0.5), 1.0).otherwise(0.0)))
        return F.when(some == 0, 0.0).otherwise(1 - both / some)
    if metric == "pearson":
        n = F.size(a)
        ma, mb = _sum(F.transform(a, lambda x: x.cast("double"))) / n, _sum(F.transform(b, lambda x: x.cast("double"))) / n
        xy = _sum(_zip(a, b, lambda x, y: (x - ma) * (y - mb)))
        xx = _sum(F.transform(a, lambda x: (x.cast("double") - ma) * (x.cast("double") - ma)))
        yy = _sum(F.transform(b, lambda y: (y.cast("double") - mb) * (y.cast("double") - mb)))
        return F.when(xx * yy == 0, 1.0).otherwise(1 - xy / F.sqrt(xx * yy))
    raise ValueError(f"unknown metric {metric!r}")


def search(df: DataFrame, vector: str, query: list[float], k: int, metric: str = "l2", key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The ``k`` nearest rows (filtered first): a bounded heap in each task, no sort of the table.  Ties by key."""
    d = df if where is None else df.filter(where)
    return d.withColumn("distance", distance(F.col(vector), literal(query), metric)).orderBy("distance", key).limit(k)


def sq8_codes(v: Column, lo: Column, hi: Column) -> Column:
    """Each component scaled between its dimension's bounds to 0..255."""
    return F.transform(F.arrays_zip(v.alias("x"), lo.alias("lo"), hi.alias("hi")), lambda s: F.when(s["hi"] > s["lo"], F.round((s["x"] - s["lo"]) / (s["hi"] - s["lo"]) * 255)).otherwise(0).cast("int"))


def bounds(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """One row: arrays of the least and greatest value of each dimension (partial aggregates)."""
    at = lambda i: F.get(F.col(vector), i)
    return df.agg(F.array(*[F.min(at(i)) for i in range(dim)]).alias("lo"), F.array(*[F.max(at(i)) for i in range(dim)]).alias("hi"))


def sign_bits(v: Column, word: int) -> Column:
    """Signs of components 63 * word .. as bits of a bigint."""
    part = F.slice(v, word * 63 + 1, 63)
    return F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0))


def ivf_search(df: DataFrame, vector: str, query: list[float], k: int, cells: int = 16, nprobe: int = 4, key: str = "vec_id", sample: int = 10_000, seed: int = 3) -> DataFrame:
    """Approximate search: k-means cells fitted on a bounded sample, exact distances within the ``nprobe`` nearest cells."""
    import numpy as np

    n = df.count()
    part = df.select(vector, key).filter(F.abs(F.hash(F.col(key))) % max(1, math.ceil(n / sample)) == 0).limit(2 * sample).toArrow()
    x = np.array(part[vector].to_pylist(), float)
    if not len(x):
        return search(df, vector, query, k, key=key)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(10):
        near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    order = ((c - np.array(query)) ** 2).sum(1).argsort()[:nprobe].tolist()
    each = F.array(*[F.struct(distance(F.col(vector), literal(list(row)), "l2").alias("d"), F.lit(j).alias("j")) for j, row in enumerate(c)])
    return search(df.filter(F.array_min(each)["j"].isin(order)), vector, query, k, key=key)
