"""MATCH patterns compiled to joins over an edge table (src, label, dst) and a node table (id, properties).

    MATCH (a:Person)-[r:KNOWS]->(b), (b)-[:LIKES*1..2]->(c) OPTIONAL MATCH (c)-[:X]->(d)
    WHERE a.age > 30 AND NOT EXISTS { MATCH (a)-[:BLOCKED]->(c) } RETURN a, b.name AS who ORDER BY who LIMIT 10

Triples are joined by label selectivity, bound variables first; Catalyst picks the join strategy.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Node:
    var: str
    label: str | None = None


@dataclass
class Triple:
    left: Node
    edge: str | None
    label: str | None
    direction: str
    lo: int
    hi: int
    right: Node


@dataclass
class Clause:
    optional: bool
    triples: list[Triple] = field(default_factory=list)


_NODE = re.compile(r"\s*\(\s*(\w*)\s*(?::\s*(\w+))?\s*\)")
_EDGE = re.compile(r"\s*(<)?-\s*(?:\[\s*(\w*)\s*(?::\s*(\w+))?\s*(?:(\*)\s*(?:(\d+)?\s*(\.\.)?\s*(\d+)?)?)?\s*\])?\s*-(>)?")
MAX_HOPS = 10


class MatchError(ValueError):
    pass


def _chains(text: str, fresh: list[int]) -> list[Triple]:
    out: list[Triple] = []
    at = 0

    def node() -> Node:
        nonlocal at
        m = _NODE.match(text, at)
        if not m:
            raise MatchError(f"a node expected at {text[at : at + 20]!r}")
        at = m.end()
        fresh[0] += 1
        return Node(m[1] or f"_n{fresh[0]}", m[2])

    while True:
        left = node()
        while m := _EDGE.match(text, at):
            at = m.end()
            right = node()
            if m[4]:
                lo = int(m[5]) if m[5] else 1
                hi = int(m[7]) if m[7] else (lo if m[5] and not m[6] else MAX_HOPS)
            else:
                lo = hi = 1
            direction = "in" if m[1] and not m[8] else "out" if m[8] and not m[1] else "both"
            out.append(Triple(left, m[2] or None, m[3], direction, lo, hi, right))
            left = right
        rest = text[at:].lstrip()
        if not rest:
            return out
        if rest[0] != ",":
            raise MatchError(f"not understood: {rest[:20]!r}")
        at = len(text) - len(rest) + 1


@dataclass
class Pattern:
    clauses: list[Clause]
    where: list[str]
    not_exists: list[list[Triple]]
    returns: list[tuple[str, str]]
    distinct: bool
    order: list[tuple[str, bool]]
    limit: int | None


def parse(text: str) -> Pattern:
    fresh = [0]
    not_exists: list[list[Triple]] = []

    def inner(m: re.Match) -> str:
        not_exists.append(_chains(m[1], fresh))
        return "true"

    text = re.sub(r"(?is)NOT\s+EXISTS\s*\{\s*MATCH\s+(.*?)\}", inner, text.strip().rstrip(";"))
    m = re.fullmatch(r"(?is)(.*?)(?:\bWHERE\b(.*?))?\bRETURN\b(\s+DISTINCT\b)?(.*?)(?:\bORDER\s+BY\b(.*?))?(?:\bLIMIT\s+(\d+)\s*)?", text)
    if not m:
        raise MatchError("MATCH ... RETURN ... expected")
    clauses = [Clause(bool(opt), _chains(body, fresh)) for opt, body in re.findall(r"(?is)(OPTIONAL\s+)?MATCH\b(.*?)(?=(?:OPTIONAL\s+)?MATCH\b|$)", m[1].strip())]
    if not clauses:
        raise MatchError("no MATCH clause")
    where = [w.strip() for w in re.split(r"(?i)\bAND\b", m[2]) if w.strip() and w.strip().lower() != "true"] if m[2] else []
    returns = []
    for item in m[4].split(","):
        expr, _, alias = re.sub(r"(?i)\s+AS\s+", "\0", item.strip()).partition("\0")
        returns.append((expr.strip(), (alias or expr).strip().replace(".", "_")))
    order = [(p.split()[0], p.upper().endswith(" DESC")) for p in (x.strip() for x in (m[5] or "").split(",")) if p]
    return Pattern(clauses, where, not_exists, returns, bool(m[3]), order, int(m[6]) if m[6] else None)


class Matcher:
    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None):
        self.edges = edges
        self.nodes = nodes
        self._size: dict[str | None, int] = {}

    def _labelled(self, t: Triple) -> DataFrame:
        e = self.edges.filter(F.col("label") == t.label) if t.label else self.edges
        e = e.select(F.col("src").alias("a_"), F.col("dst").alias("b_"), F.col("label").alias("l_"))
        if t.direction == "in":
            return e.select(F.col("b_").alias("a_"), F.col("a_").alias("b_"), "l_")
        if t.direction == "both":
            return e.union(e.select(F.col("b_").alias("a_"), F.col("a_").alias("b_"), "l_"))
        return e

    def _hops(self, t: Triple) -> DataFrame:
        one = self._labelled(t)
        if t.lo == t.hi == 1:
            return one
        step = one.select("a_", "b_").distinct()
        walk, out = step, None
        for k in range(1, t.hi + 1):
            if k > 1:
                walk = walk.join(step.select(F.col("a_").alias("b_"), F.col("b_").alias("c_")), "b_").select("a_", F.col("c_").alias("b_")).distinct()
            if k >= t.lo:
                out = walk if out is None else out.union(walk)
        if t.lo == 0:
            ids = step.select("a_").union(step.select("b_")).distinct()
            zero = ids.select("a_", F.col("a_").alias("b_"))
            out = zero if out is None else out.union(zero)
        return out.distinct().withColumn("l_", F.lit(t.label))

    def _selectivity(self, t: Triple) -> int:
        if t.label not in self._size:
            e = self.edges.filter(F.col("label") == t.label) if t.label else self.edges
            self._size[t.label] = e.count()
        return self._size[t.label] * (4 ** (t.hi - 1))

    def _table(self, t: Triple) -> DataFrame:
        d = self._hops(t)
        cols = [F.col("a_").alias(t.left.var)]
        if t.left.var == t.right.var:
            d = d.filter("a_ = b_")
        else:
            cols.append(F.col("b_").alias(t.right.var))
        if t.edge:
            cols.append(F.col("l_").alias(t.edge))
        d = d.select(*cols)
        for n in (t.left, t.right):
            if n.label and self.nodes is not None and "label" in self.nodes.columns:
                d = d.join(self.nodes.filter(F.col("label") == n.label).select(F.col("id").alias(n.var)), n.var, "left_semi")
        return d

    def _join(self, triples: list[Triple], start: DataFrame | None = None) -> DataFrame:
        left = list(triples)
        out = start
        while left:
            bound = set(out.columns) if out is not None else set()
            left.sort(key=lambda t: (out is not None and not ({t.left.var, t.right.var} & bound), self._selectivity(t)))
            t = left.pop(0)
            d = self._table(t)
            shared = [c for c in d.columns if c in bound]
            out = d if out is None else out.join(d, shared) if shared else out.crossJoin(d)
        return out

    def run(self, text: str) -> DataFrame:
        p = parse(text)
        out: DataFrame | None = None
        for c in p.clauses:
            if c.optional and out is not None:
                d = self._join(c.triples)
                shared = [x for x in d.columns if x in out.columns]
                out = out.join(d, shared, "left")
            else:
                out = self._join(c.triples, out)
        for triples in p.not_exists:
            d = self._join(triples)
            shared = [x for x in d.columns if x in out.columns]
            out = out.join(d.select(*shared).distinct(), shared, "left_anti")
        used = set(re.findall(r"\b(\w+)\.(\w+)\b", " ".join([*p.where, *(e for e, _ in p.returns), *(e for e, _ in p.order)])))
        for var in sorted({v for v, _ in used if v in out.columns}):
            if self.nodes is None:
                raise MatchError("properties need a node table")
            props = sorted({f for v, f in used if v == var})
            out = out.join(self.nodes.select(F.col("id").alias(var), *[F.col(f).alias(f"{var}__{f}") for f in props]), var, "left")
        fix = lambda e: re.sub(r"\b(\w+)\.(\w+)\b", r"\1__\2", e)
        for w in p.where:
            out = out.filter(F.expr(fix(w)))
        names = {e: a for e, a in p.returns}
        out = out.select(*[F.expr(fix(e)).alias(a) for e, a in p.returns])
        if p.distinct:
            out = out.distinct()
        if p.order:
            keys = [F.col(names.get(e, e)) for e, _ in p.order]
            out = out.orderBy(*[k.desc() if d else k.asc() for k, (_, d) in zip(keys, p.order)])
        return out.limit(p.limit) if p.limit is not None else out


def match(edges: DataFrame, text: str, nodes: DataFrame | None = None) -> DataFrame:
    return Matcher(edges, nodes).run(text)
