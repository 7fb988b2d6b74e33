"""Property-graph traversal and algorithms over an edge table (src, dst[, label, weight]).

Iterative algorithms write each round to the checkpoint folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of an exchange's partition, and neighbours in a row of ``_adjacency``, at most.
ROWS, CHUNK = 1_000_000, 4096


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="polyloom-graph-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def _spread(spark: SparkSession, rows: int) -> Iterator[int]:
    """Exchanges of up to ``rows`` rows get partitions by that number (no fewer than set), so a task's memory does not grow with the input."""
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    parts = max(1, math.ceil(rows / ROWS))
    spark.conf.set(name, str(max(int(was), parts)))
    try:
        yield parts
    finally:
        spark.conf.set(name, was)


@contextlib.contextmanager
def _adjacency(edges: DataFrame, direction: str = "both", simple: bool = False) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(id) of all nodes, and (a, k, near): arrays of the nodes one step from ``a``, k steps a row.  ``simple``: each once, no loops.

    The edges are computed once.  Rounds exchange one row a node (hubs: a row for each ``CHUNK``) instead of one an edge; they run within the
    block, whose tables (Parquet in the checkpoint folder) are deleted at its end.
    """
    spark = edges.sparkSession
    where = f"{_folder(spark)}/{uuid.uuid4().hex}"

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{where}/{name}")
        return spark.read.schema(df.schema).parquet(f"{where}/{name}")

    try:
        e = saved(edges.select("src", "dst"), "edges")
        with _spread(spark, e.count() * (2 if direction == "both" else 1)) as parts:
            ids = saved(nodes(e), "nodes")
            steps = undirected(e).toDF("a", "b") if simple else _steps(e, direction)
            steps = steps.filter("a is not null").repartition(parts, "a").sortWithinPartitions("a")
            at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
            rows = steps.withColumn("row_", F.floor(at / CHUNK)).groupBy("a", "row_").agg(F.count("*").alias("k"), F.collect_list("b").alias("near"))
            yield ids, saved(rows.drop("row_"), "near")
    finally:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _sent(near: DataFrame, state: DataFrame, *values: str) -> DataFrame:
    """(b, values): what each node of ``state`` (id, ...) sends to the nodes one step from it.  The nodes are hashed, never the edges sorted."""
    return near.join(state.select(F.col("id").alias("a"), *values).hint("shuffle_hash"), "a").select(F.explode("near").alias("b"), *values)


def _unsettled(what: str, rounds: int) -> RuntimeError:
    return RuntimeError(f"{what} did not settle in {rounds} rounds")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct neighbour pairs in both directions, without loops."""
    e = edges.select("src", "dst").filter("src <> dst")
    return _steps(e, "both").toDF("src", "dst").distinct()


def with_label(edges: DataFrame, labels: list[str] | None) -> DataFrame:
    """No labels: all edges.  An unknown label matches nothing."""
    return edges.filter(F.col("label").isin(*labels)) if labels else edges


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    out, back = F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))
    # both ways from one pass over the edges
    return edges.select(F.inline(F.array(*{"out": [out], "in": [back], "both": [out, back]}[direction])))


def neighbors(edges: DataFrame, start, direction: str = "out", labels: list[str] | None = None) -> DataFrame:
    return _steps(with_label(edges, labels), direction).filter(F.col("a") == start).select(F.col("b").alias("id")).distinct()


def bfs(edges: DataFrame, starts: list, depth: int, direction: str = "out", labels: list[str] | None = None) -> DataFrame:
    """(id, depth) of nodes within ``depth`` steps, the starts (depth 0) included."""
    seen = edges.sparkSession.createDataFrame([(s,) for s in starts], ["id"]).select(F.col("id").cast(edges.schema["src"].dataType), F.lit(0).alias("depth")).distinct()
    front = seen
    with _adjacency(with_label(edges, labels), direction) as (_, near):
        for k in range(1, depth + 1):
            got = _sent(near, front).withColumnRenamed("b", "id").distinct()
            front = _cut(got.join(seen.hint("shuffle_hash"), "id", "left_anti").withColumn("depth", F.lit(k)))
            if front.isEmpty():
                break
            seen = _cut(seen.union(front))
    return seen


def shortest_path(edges: DataFrame, src, dst, max_depth: int = 10, labels: list[str] | None = None) -> DataFrame:
    """One row ``path`` (array of ids): a shortest directed path, the least in order of ids; none: no row."""
    e = with_label(edges, labels).select("src", "dst").distinct()
    kind = edges.schema["src"].dataType
    front = edges.sparkSession.range(1).select(F.lit(src).cast(kind).alias("id"), F.array(F.lit(src).cast(kind)).alias("path"))
    seen = front.select("id")
    for _ in range(max_depth + 1):
        hit = front.filter(F.col("id") == dst).select("path")
        if not hit.isEmpty():
            return hit
        # one path a node: the least
        nxt = front.join(e, front.id == e.src).groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = _cut(nxt.join(seen, "id", "left_anti"))
        if front.isEmpty():
            break
        seen = _cut(seen.union(front.select("id")))
    return front.filter(F.lit(False)).select("path")


def subgraph(edges: DataFrame, starts: list, depth: int) -> DataFrame:
    """Edges between nodes within ``depth`` steps."""
    ids = bfs(edges, starts, depth).select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def degree(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(node_id, centrality): degree / (n - 1)."""
    ends = {"out": edges.select(F.col("src").alias("id")), "in": edges.select(F.col("dst").alias("id"))}
    d = ends["out"].union(ends["in"]) if direction == "both" else ends[direction]
    n = nodes(edges)
    total = n.count()
    g = n.join(d.groupBy("id").agg(F.count("*").alias("k")), "id", "left")
    return g.select(F.col("id").alias("node_id"), (F.coalesce("k", F.lit(0)) / F.lit(max(1, total - 1))).alias("centrality"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-7) -> DataFrame:
    """(node_id, rank); rank of nodes without out-edges is spread over all."""
    d = min(0.99, max(0.01, damping))
    with _adjacency(edges, "out") as (ids, near):
        deg = near.groupBy(F.col("a").alias("id")).agg(F.sum("k").alias("deg"))
        r = _cut(ids.join(deg, "id", "left"))
        near = near.select("a", "near")
        n = r.count()
        if not n:
            return r.select(F.col("id").alias("node_id"), F.lit(0.0).alias("rank"))
        loose = r.filter("deg is null").count() / n
        r = r.withColumn("rank", F.lit(1.0 / n))
        for _ in range(iterations):
            got = _sent(near, r.withColumn("part", F.col("rank") / F.col("deg")), "part").groupBy(F.col("b").alias("id")).agg(F.sum("part").alias("got"))
            new = F.lit((1 - d) / n + d * loose / n) + d * F.coalesce("got", F.lit(0.0))
            nxt = _cut(r.join(got.hint("shuffle_hash"), "id", "left").select("id", "deg", new.alias("new"), "rank"))
            moved, loose = nxt.agg(F.sum(F.abs(F.col("new") - F.col("rank"))), F.coalesce(F.sum(F.when(F.col("deg").isNull(), F.col("new"))), F.lit(0.0))).first()
            r = nxt.select("id", "deg", F.col("new").alias("rank"))
            if moved < tolerance:
                break
    return r.select(F.col("id").alias("node_id"), "rank")


def components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node_id, component_id): the least node of each weakly connected component (least labels spread, with pointer jumping)."""
    with _adjacency(edges, simple=True) as (ids, near):
        near = near.select("a", "near")
        lab = _cut(ids.withColumn("c", F.col("id")))
        for _ in range(max_rounds):
            got = _sent(near, lab, "c").groupBy(F.col("b").alias("id")).agg(F.min("c").alias("m"))
            nxt = _cut(lab.join(got.hint("shuffle_hash"), "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old")))
            jump = nxt.select(F.col("id").alias("j"), F.col("c").alias("jc"))
            nxt = _cut(nxt.join(jump.hint("shuffle_hash"), nxt.c == jump.j).select("id", F.least("c", "jc").alias("c"), "old"))
            changed = nxt.filter("c <> old").limit(1).count()
            lab = nxt.select("id", "c")
            if not changed:
                break
        else:
            raise _unsettled("components", max_rounds)
    return lab.select(F.col("id").alias("node_id"), F.col("c").alias("component_id"))


def label_propagation(edges: DataFrame, iterations: int = 10) -> DataFrame:
    """(node_id, community_id): each round every node takes its neighbours' most frequent label, the least of equals."""
    e = _cut(undirected(edges))
    lab = _cut(nodes(edges).withColumn("c", F.col("id")))
    for _ in range(iterations):
        votes = e.join(lab.select(F.col("id").alias("dst"), "c"), "dst").groupBy("src", "c").agg(F.count("*").alias("k"))
        best = votes.groupBy("src").agg(F.max(F.struct("k", (-F.col("c")).alias("nc"))).alias("b")).select("src", (-F.col("b.nc")).alias("m"))
        nxt = _cut(lab.join(best, lab.id == best.src, "left").select("id", F.coalesce("m", "c").alias("c"), F.col("c").alias("old")))
        done = nxt.filter("c <> old").isEmpty()
        lab = nxt.select("id", "c")
        if done:
            break
    return lab.select(F.col("id").alias("node_id"), F.col("c").alias("community_id"))


def _triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): each triangle once.  Edges point from the end of lower degree, which bounds the pairs a hub makes."""
    u = undirected(edges)
    deg = u.groupBy("src").agg(F.count("*").alias("k"))
    ends = u.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("k").alias("kd")), "dst")
    up = _cut(ends.filter("k < kd or (k = kd and src < dst)").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    wedge = up.join(up.select("a", F.col("b").alias("c")), "a").filter("b < c")
    closed = u.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return wedge.join(closed, ["b", "c"], "left_semi")


def triangles(edges: DataFrame) -> DataFrame:
    """(node_id, triangles), nodes without any included."""
    each = _triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    return nodes(edges).join(each, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("t", F.lit(0)).alias("triangles"))


def triangle_count(edges: DataFrame) -> DataFrame:
    return _triangles(edges).agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node_id, coefficient) = 2 t / (k (k - 1)), 0 below two neighbours."""
    deg = undirected(edges).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("k"))
    t = triangles(edges).join(deg, "node_id", "left")
    return t.select("node_id", F.when(F.col("k") >= 2, 2 * F.col("triangles") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("coefficient"))


def sssp(edges: DataFrame, source, max_rounds: int = 100_000) -> DataFrame:
    """(node_id, distance) by weight (1 if there is no such column); unreachable nodes have infinity.  A cycle of negative weight raises."""
    w = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    e = _cut(edges.select("src", "dst", w.cast("double").alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")))
    ids = nodes(edges)
    if ids.filter(F.col("id") == source).isEmpty():
        raise ValueError(f"no node {source!r}")
    inf = F.lit(float("inf"))
    d = _cut(ids.select("id", F.when(F.col("id") == source, 0.0).otherwise(inf).alias("d"), (F.col("id") == source).alias("new")))
    for _ in range(max_rounds):
        # only nodes that got nearer in the last round relax their edges
        got = d.filter("new").join(e, d.id == e.src).groupBy("dst").agg(F.min(F.col("d") + F.col("w")).alias("g"))
        d = _cut(d.join(got, d.id == got.dst, "left").select("id", F.least("d", F.coalesce("g", inf)).alias("d"), (F.coalesce("g", inf) < F.col("d")).alias("new")))
        if d.filter("new").isEmpty():
            break
    else:
        raise _unsettled("sssp", max_rounds)
    return d.select(F.col("id").alias("node_id"), F.col("d").alias("distance"))


def kcore(edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(node_id, coreness): each node takes the largest h with h neighbours of at least h, until nothing changes."""
    with _adjacency(edges, simple=True) as (ids, near):
        k = near.groupBy(F.col("a").alias("id")).agg(F.sum("k").cast("int").alias("k"))
        k = _cut(ids.join(k, "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("k")))
        for _ in range(max_rounds):
            # h-index from counts of values, so no neighbour list is gathered
            counts = _sent(near.select("a", "near"), k, "k").groupBy("b", "k").agg(F.count("*").alias("c"))
            run = F.sum("c").over(Window.partitionBy("b").orderBy(F.desc("k")))
            h = counts.withColumn("run", run).groupBy("b").agg(F.max(F.least("run", "k")).cast("int").alias("h"))
            nxt = _cut(k.join(h.withColumnRenamed("b", "id").hint("shuffle_hash"), "id", "left").select("id", F.least("k", F.coalesce("h", F.lit(0))).alias("k"), F.col("k").alias("old")))
            done = nxt.filter("k <> old").isEmpty()
            k = nxt.select("id", "k")
            if done:
                break
        else:
            raise _unsettled("kcore", max_rounds)
    return k.select(F.col("id").alias("node_id"), F.col("k").alias("coreness"))


def distances(edges: DataFrame, max_depth: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(source, id, depth) for all pairs reachable along undirected edges (within ``max_depth`` steps, if given); give ``sources`` (id) to sample large graphs."""
    e = _cut(undirected(edges))
    ids = sources if sources is not None else nodes(edges)
    seen = _cut(ids.select(F.col("id").alias("source"), F.col("id"), F.lit(0).alias("depth")))
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = front.join(e, front.id == e.src).select("source", F.col("dst").alias("id")).distinct()
        front = _cut(nxt.join(seen, ["source", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = _cut(seen.unionByName(front.select("source", "id", "depth")))
    return seen


def closeness(edges: DataFrame) -> DataFrame:
    """(node_id, centrality): Wasserman and Faust's form for graphs in parts."""
    n = nodes(edges).count()
    d = distances(edges).groupBy(F.col("source").alias("node_id")).agg(F.sum("depth").alias("s"), (F.count("*") - 1).alias("r"))
    return d.select("node_id", F.when(F.col("s") > 0, (F.col("r") / F.lit(max(1, n - 1))) * (F.col("r") / F.col("s"))).otherwise(0.0).alias("centrality"))


def harmonic(edges: DataFrame) -> DataFrame:
    n = nodes(edges).count()
    d = distances(edges).groupBy(F.col("source").alias("node_id")).agg(F.sum(F.when(F.col("depth") > 0, 1.0 / F.col("depth"))).alias("s"))
    return d.select("node_id", (F.coalesce("s", F.lit(0.0)) / F.lit(max(1, n - 1))).alias("centrality"))


def diameter(edges: DataFrame) -> DataFrame:
    """(diameter, radius): greatest and least eccentricity."""
    ecc = distances(edges).groupBy("source").agg(F.max("depth").alias("e"))
    return ecc.agg(F.max("e").alias("diameter"), F.min("e").alias("radius"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(node_id, centrality): Brandes on shortest-path counts, undirected, halved; levels forward, then back."""
    e = _cut(undirected(edges))
    d = distances(edges, sources=sources)
    depth = d.agg(F.max("depth")).first()[0] or 0
    # sigma: number of shortest paths from the source
    sigma = _cut(d.filter("depth = 0").select("source", "id", "depth", F.lit(1.0).alias("sigma")))
    level = sigma
    for k in range(1, depth + 1):
        here = d.filter(F.col("depth") == k)
        got = level.join(e, level.id == e.src).select("source", F.col("dst").alias("id"), "sigma").groupBy("source", "id").agg(F.sum("sigma").alias("sigma"))
        level = _cut(here.join(got, ["source", "id"]).select("source", "id", "depth", "sigma"))
        sigma = sigma.union(level)
    sigma = _cut(sigma)
    delta = _cut(sigma.filter(F.col("depth") == depth).select("source", "id", "sigma", F.lit(0.0).alias("delta")))
    total = delta
    for k in range(depth - 1, 0, -1):
        part = delta.join(e, delta.id == e.src).select("source", F.col("dst").alias("id"), ((1 + F.col("delta")) / F.col("sigma")).alias("x"))
        part = part.groupBy("source", "id").agg(F.sum("x").alias("x"))
        delta = _cut(sigma.filter(F.col("depth") == k).join(part, ["source", "id"], "left").select("source", "id", "sigma", (F.col("sigma") * F.coalesce("x", F.lit(0.0))).alias("delta")))
        total = total.union(delta)
    sums = total.groupBy("id").agg((F.sum("delta") / 2).alias("c"))
    return nodes(edges).join(sums, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("c", F.lit(0.0)).alias("centrality"))


def louvain(edges: DataFrame, iterations: int = 10, resolution: float = 1.0) -> DataFrame:
    """(node_id, community_id): local moves by modularity gain, half of the nodes a round (by hash), so that neighbours do not swap for ever."""
    u = undirected(edges)
    e = _cut(u.withColumn("w", F.lit(1.0)))
    m2 = e.agg(F.sum("w")).first()[0] or 1.0
    deg = _cut(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    lab = _cut(nodes(edges).withColumn("c", F.col("id")))
    idle = 0
    for i in range(3 * iterations):
        tot = lab.join(deg, "id").groupBy("c").agg(F.sum("k").alias("tot"))
        near = e.join(lab.select(F.col("id").alias("dst"), "c"), "dst").groupBy("src", "c").agg(F.sum("w").alias("kin"))
        own = lab.join(deg, "id").select(F.col("id").alias("src"), F.col("c").alias("now"), "k")
        cand = near.join(own, "src").join(tot, "c")
        others = F.col("tot") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
        gain = F.col("kin") - resolution * F.col("k") * others / m2
        best = cand.groupBy("src").agg(F.max(F.struct(F.round(gain, 9).alias("g"), (F.col("c") == F.col("now")).alias("stay"), (-F.col("c")).alias("nc"))).alias("b"))
        moves = best.filter((F.abs(F.xxhash64("src", F.lit(i))) % 2 == 0) & (F.col("b.g") > 0)).select("src", (-F.col("b.nc")).alias("to"))
        nxt = _cut(lab.join(moves, lab.id == moves.src, "left").select("id", F.coalesce("to", "c").alias("c"), F.col("c").alias("old")))
        # a round moves only the half that its hash picks: some idle rounds in a row mean rest
        idle = idle + 1 if nxt.filter("c <> old").isEmpty() else 0
        lab = nxt.select("id", "c")
        if idle >= 4:
            break
    low = lab.groupBy("c").agg(F.min("id").alias("community_id"))
    return lab.join(low, "c").select(F.col("id").alias("node_id"), "community_id")


def statistics(edges: DataFrame) -> DataFrame:
    """(label, edges, sources, targets, selectivity)."""
    total = edges.agg(F.count("*").alias("all_"))
    g = edges.groupBy("label").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))
    return g.crossJoin(F.broadcast(total)).select("label", "edges", "sources", "targets", (F.col("edges") / F.col("all_")).alias("selectivity"))  # one row of totals


def put_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """New edges replace those with the same ends and label."""
    return edges.join(new, ["src", "label", "dst"], "left_anti").unionByName(new, allowMissingColumns=True)


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["src", "label", "dst"], "left_anti")


