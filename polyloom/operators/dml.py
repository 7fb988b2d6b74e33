"""Changes to tables as new DataFrames: insert, upsert, update, delete; key-value access."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Fields of ``rows`` that are not null replace those of the row with the same key; other rows are added."""
    new = rows.select(F.col(key), *[F.col(c).alias(f"{c}__new") for c in rows.columns if c != key])
    j = table.join(new, key, "full")
    cols = [F.col(key)]
    for c in table.columns:
        if c != key:
            cols.append(F.coalesce(F.col(f"{c}__new"), F.col(c)).alias(c) if c in rows.columns else F.col(c))
    return j.select(*cols, *[F.col(f"{c}__new").alias(c) for c in rows.columns if c not in table.columns])


def update(table: DataFrame, changes: dict[str, Column], where: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> DataFrame:
    """A predicate that is null deletes nothing."""
    return table.filter(~F.coalesce(where, F.lit(False)))


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


def glob(pattern: str) -> str:
    """A regular expression for ``*`` and ``?``."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


class KeyValue:
    """Access by key over rows with columns key, fields and, if there is any expiry, expire_at (ms)."""

    def __init__(self, table: DataFrame, key: str = "key", now_ms: int | None = None):
        self.key, self.now = key, now_ms
        live = F.lit(True)
        if "expire_at" in table.columns and now_ms is not None:
            live = F.col("expire_at").isNull() | (F.col("expire_at") > now_ms)
        self.all, self.table = table, table.filter(live)

    def get(self, *keys) -> DataFrame:
        return self.table.filter(F.col(self.key).isin(*keys))

    def fields(self, key, *names: str) -> DataFrame:
        return self.get(key).select(*names)

    def scan(self, pattern: str = "*", where: Column | None = None) -> DataFrame:
        d = self.table.filter(F.col(self.key).cast("string").rlike(glob(pattern)))
        return d if where is None else d.filter(where)

    def ttl(self, key) -> int:
        """-2 missing, -1 without expiry, else milliseconds left."""
        row = self.get(key).select("expire_at").first() if "expire_at" in self.table.columns else (None,) if not self.get(key).isEmpty() else None
        if row is None:
            return -2
        return -1 if row[0] is None else row[0] - self.now

    def expire(self, key, ms: int) -> DataFrame:
        return update(self.all if "expire_at" in self.all.columns else self.all.withColumn("expire_at", F.lit(None).cast("long")), {"expire_at": F.lit(self.now + ms).cast("long")}, F.col(self.key) == key)

    def persist(self, key) -> DataFrame:
        return update(self.all, {"expire_at": F.lit(None).cast("long")}, F.col(self.key) == key)


def secured(table: DataFrame, policies: list[Column]) -> DataFrame:
    """Row-level security: all policies hold, or the row is not there; no policy denies nothing."""
    for p in policies:
        table = table.filter(F.coalesce(p, F.lit(False)))
    return table


def metadata_filter(tree: dict) -> Column:
    """{"eq": [f, v]}, ne, gt, gte, lt, lte, in, contains, and {"and"|"or": [...]}, {"not": ...}."""
    (op, arg), = tree.items()
    if op in ("and", "or"):
        out = metadata_filter(arg[0])
        for t in arg[1:]:
            out = out & metadata_filter(t) if op == "and" else out | metadata_filter(t)
        return out
    if op == "not":
        return ~metadata_filter(arg)
    f, v = F.col(arg[0]), arg[1]
    return {"eq": lambda: f == v, "ne": lambda: f != v, "gt": lambda: f > v, "gte": lambda: f >= v, "lt": lambda: f < v, "lte": lambda: f <= v, "in": lambda: f.isin(*v), "contains": lambda: f.contains(v)}[op]()
