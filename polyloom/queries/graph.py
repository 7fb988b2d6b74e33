"""Graph queries: nations joined by who sells to whom; customers and suppliers by orders; turns by succession."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyloom.operators import graph as G
from polyloom.plans.match import match
from polyloom.queries import query
from polyloom.session import load

# a small directed graph over nations, by arithmetic on the keys, with two labels
_E = "SELECT n_nationkey AS src, 'near' AS label, (n_nationkey * 7 + 3) % 25 AS dst, (n_nationkey % 5 + 1)::DOUBLE AS weight FROM nation UNION ALL SELECT n_nationkey, 'far', (n_nationkey * 11 + 1) % 25, (n_nationkey % 3 + 2)::DOUBLE FROM nation WHERE n_nationkey % 2 = 0"
_U = f"e AS ({_E}), u AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst)"


def small(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    near = n.select(F.col("k").alias("src"), F.lit("near").alias("label"), ((F.col("k") * 7 + 3) % 25).alias("dst"), (F.col("k") % 5 + 1).cast("double").alias("weight"))
    far = n.filter("k % 2 = 0").select(F.col("k").alias("src"), F.lit("far").alias("label"), ((F.col("k") * 11 + 1) % 25).alias("dst"), (F.col("k") % 3 + 2).cast("double").alias("weight"))
    return near.union(far)


def _small(name: str, oracle: str | None, run) -> None:
    query(name, oracle)(lambda spark, sf_dir: run(small(spark, sf_dir)))


_small("n2_neighbors", f"WITH {_U} SELECT DISTINCT dst AS id FROM e WHERE src = 4", lambda e: G.neighbors(e, 4))
_small("n2_neighbors_in", f"WITH {_U} SELECT DISTINCT src AS id FROM e WHERE dst = 3 AND label = 'near'", lambda e: G.neighbors(e, 3, "in", ["near"]))
_BFS = f"WITH RECURSIVE {_U}, b(id, depth) AS (SELECT 0, 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.id WHERE b.depth < 4) "
_small("n3_bfs", _BFS + "SELECT id, min(depth) AS depth FROM b GROUP BY id", lambda e: G.bfs(e, [0], 4))
_small("n4_shortest_path", _BFS.replace("b.depth < 4", "b.depth < 10") + "SELECT min(depth) AS hops FROM b WHERE id = 17 HAVING min(depth) IS NOT NULL", lambda e: G.shortest_path(e, 0, 17).select((F.size("path") - 1).alias("hops")))
_small("n5_subgraph", _BFS.replace("b.depth < 4", "b.depth < 2") + ", s AS (SELECT DISTINCT id FROM b) SELECT src, label, dst, weight FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)", lambda e: G.subgraph(e, [0], 2).select("src", "label", "dst", "weight"))
_PR = f"WITH RECURSIVE {_U}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM v), g AS (SELECT src, count(*) AS deg FROM e GROUP BY src), x AS (SELECT e.src, e.dst, g.deg FROM e JOIN g USING (src)), "
_ranks = "r0 AS (SELECT id, 1 / n AS rank FROM v, n)"
for _i in range(5):
    _ranks += f", r{_i + 1} AS (SELECT v.id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce((SELECT sum(rank) FROM r{_i} WHERE id NOT IN (SELECT src FROM g)), 0) / n + 0.85::DOUBLE * coalesce(s.s, 0) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT x.dst, sum(r.rank / x.deg) AS s FROM x JOIN r{_i} r ON r.id = x.src GROUP BY x.dst) s ON s.dst = v.id)"
_small("n6_pagerank", _PR.replace("RECURSIVE ", "") + _ranks + " SELECT id AS node_id, round(rank, 9) AS rank FROM r5", lambda e: G.pagerank(e, iterations=5, tolerance=0).select("node_id", F.round("rank", 9).alias("rank")))
_REACH = f"WITH RECURSIVE {_U}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), c(id, other) AS (SELECT id, id FROM v UNION SELECT c.id, u.dst FROM c JOIN u ON u.src = c.other) "
_small("n7_wcc", _REACH + "SELECT id AS node_id, min(other) AS component_id FROM c GROUP BY id", G.components)
_small("n8_label_propagation", None, G.label_propagation)
_TRI = f"WITH {_U}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), t AS (SELECT a.src AS id, count(*) // 2 AS t FROM u a JOIN u b ON a.src = b.src AND a.dst <> b.dst JOIN u c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src) "
_small("n9_lcc", _TRI + ", k AS (SELECT src AS id, count(*) AS k FROM u GROUP BY src) SELECT v.id AS node_id, round(CASE WHEN k >= 2 THEN 2 * coalesce(t, 0) / (k * (k - 1))::DOUBLE ELSE 0 END, 9) AS coefficient FROM v LEFT JOIN t USING (id) LEFT JOIN k USING (id)", lambda e: G.clustering(e).select("node_id", F.round("coefficient", 9).alias("coefficient")))
_small("n16_triangles", _TRI + "SELECT v.id AS node_id, coalesce(t, 0)::BIGINT AS triangles FROM v LEFT JOIN t USING (id)", G.triangles)
_small("n16_triangle_count", _TRI + "SELECT (sum(t) // 3)::BIGINT AS triangles FROM t", G.triangle_count)
_small("n10_sssp", f"WITH RECURSIVE {_U}, d(id, w, hops) AS (SELECT 0, 0.0::DOUBLE, 0 UNION SELECT e.dst, d.w + e.weight, d.hops + 1 FROM d JOIN e ON e.src = d.id WHERE d.hops < 25), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT v.id AS node_id, coalesce(min(d.w), 'inf'::DOUBLE) AS distance FROM v LEFT JOIN d ON d.id = v.id GROUP BY v.id", lambda e: G.sssp(e, 0))
_DIST = f"WITH RECURSIVE {_U}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), b(source, id, depth) AS (SELECT id, id, 0 FROM v UNION SELECT b.source, u.dst, b.depth + 1 FROM b JOIN u ON u.src = b.id WHERE b.depth < 8), d AS (SELECT source, id, min(depth) AS depth FROM b GROUP BY ALL), n AS (SELECT count(*) AS n FROM v) "
_small("n12_closeness", _DIST + "SELECT source AS node_id, round(CASE WHEN sum(depth) > 0 THEN (count(*) - 1)::DOUBLE / (max(n) - 1) * ((count(*) - 1)::DOUBLE / sum(depth)) ELSE 0 END, 9) AS centrality FROM d, n GROUP BY source", lambda e: G.closeness(e).select("node_id", F.round("centrality", 9).alias("centrality")))
_small("n13_harmonic", _DIST + "SELECT source AS node_id, round(coalesce(sum(CASE WHEN depth > 0 THEN 1.0::DOUBLE / depth END), 0) / (max(n) - 1), 9) AS centrality FROM d, n GROUP BY source", lambda e: G.harmonic(e).select("node_id", F.round("centrality", 9).alias("centrality")))
_small("n17_diameter", _DIST + "SELECT max(e)::INTEGER AS diameter, min(e)::INTEGER AS radius FROM (SELECT source, max(depth) AS e FROM d GROUP BY source) x", G.diameter)
_small("n11_betweenness", None, lambda e: G.betweenness(e).select("node_id", F.round("centrality", 6).alias("centrality")))
_small("n14_degree", f"WITH {_U}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT v.id AS node_id, round((SELECT count(*) FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) x WHERE x.id = v.id)::DOUBLE / ((SELECT count(*) FROM v) - 1), 9) AS centrality FROM v", lambda e: G.degree(e).select("node_id", F.round("centrality", 9).alias("centrality")))
_small("n15_louvain", None, G.louvain)
_small("n18_kcore", None, G.kcore)
_small("n20_statistics", f"WITH {_U} SELECT label, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, round(count(*)::DOUBLE / (SELECT count(*) FROM e), 9) AS selectivity FROM e GROUP BY label", lambda e: G.statistics(e).withColumn("selectivity", F.round("selectivity", 9)))
_small("n1_put_delete", f"WITH {_U} SELECT src, label, dst FROM e WHERE NOT (src = 0 AND label = 'near') UNION ALL SELECT 100, 'new', 101", lambda e: G.put_edges(G.delete_edges(e, e.filter("src = 0 and label = 'near'").select("src", "label", "dst")), e.sparkSession.createDataFrame([(100, "new", 101)], "src int, label string, dst int")).select("src", "label", "dst"))

# customers (even ids) and the suppliers (odd ids) of what they ordered: the whole of orders and lineitem
_TRADE = "e AS (SELECT DISTINCT o.o_custkey * 2 AS src, l.l_suppkey * 2 + 1 AS dst FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    # partitions by the number of rows (of which Parquet keeps count), so a task's memory does not grow with the input
    parts = max(1, math.ceil(l.count() / G.ROWS))
    sold = o.repartition(parts, "o_orderkey").join(l.repartition(parts, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = sold.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    return e.repartition(parts, "src", "dst").distinct()


@query("n14_trade_degree", f"WITH {_TRADE} SELECT v.id AS node_id, round(count(*)::DOUBLE / (SELECT count(*) - 1 FROM v), 9) AS centrality FROM v JOIN (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) x USING (id) GROUP BY v.id")
def trade_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree(trade(spark, sf_dir)).select("node_id", F.round("centrality", 9).alias("centrality"))


_TRADE_RANKS = ", r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v), g AS (SELECT src, count(*) AS deg FROM e GROUP BY src)" + "".join(
    f", r{i + 1} AS MATERIALIZED (SELECT v.id, (0.15::DOUBLE + 0.85::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM g))) / (SELECT count(*) FROM v) + 0.85::DOUBLE * coalesce(s.s, 0) AS rank"
    f" FROM v LEFT JOIN (SELECT e.dst, sum(r.rank / g.deg) AS s FROM e JOIN g USING (src) JOIN r{i} r ON r.id = e.src GROUP BY e.dst) s ON s.dst = v.id)"
    for i in range(20)
)


@query("n6_trade_pagerank", f"WITH {_TRADE}{_TRADE_RANKS} SELECT id AS node_id, round(rank, 9) AS rank FROM r20")
def trade_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(trade(spark, sf_dir), tolerance=0).select("node_id", F.round("rank", 9).alias("rank"))


@query("n3_trade_bfs", f"WITH RECURSIVE {_TRADE}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), b(id, depth) AS (SELECT 2, 0 UNION SELECT u.b, b.depth + 1 FROM b JOIN u ON u.a = b.id WHERE b.depth < 3) SELECT id, min(depth) AS depth FROM b GROUP BY id")
def trade_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bfs(trade(spark, sf_dir), [2], 3, "both")


@query("n7_trade_components")
def trade_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(trade(spark, sf_dir))


@query("n18_trade_kcore")
def trade_kcore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.kcore(trade(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = load(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    nodes = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("label"), "role", "conv_id", "turn")
    nxt = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("src"), F.lit("NEXT").alias("label"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("dst"))
    return nxt.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "label", "dst"), nodes


_C = "c AS (SELECT DISTINCT ON (conv_id, turn) conv_id * 1000 + turn AS id, role, conv_id, turn FROM conversations ORDER BY conv_id, turn), n AS (SELECT a.id AS src, b.id AS dst FROM c a JOIN c b ON b.id = a.id + 1)"


def _turns(name: str, oracle: str, text: str) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges, nodes = turns(spark, sf_dir)
        return match(edges, text, nodes)


_turns("m1_match_chain", f"WITH {_C} SELECT x.src AS a, y.dst AS c FROM n x JOIN n y ON x.dst = y.src", "MATCH (a)-[:NEXT]->(b)-[:NEXT]->(c) RETURN a, c")
_turns("m1_match_in", f"WITH {_C} SELECT src AS b, dst AS a FROM n", "MATCH (a)<-[:NEXT]-(b) RETURN a, b")
_turns("m2_variable_length", f"WITH {_C} SELECT x.src AS a, x.dst AS b FROM n x UNION SELECT x.src, y.dst FROM n x JOIN n y ON x.dst = y.src UNION SELECT x.src, z.dst FROM n x JOIN n y ON x.dst = y.src JOIN n z ON y.dst = z.src", "MATCH (a)-[:NEXT*1..3]->(b) RETURN a, b")
_turns("m3_optional", f"WITH {_C} SELECT x.src AS a, y.dst AS c FROM n x LEFT JOIN n y ON x.dst = y.src", "MATCH (a)-[:NEXT]->(b) OPTIONAL MATCH (b)-[:NEXT]->(c) RETURN a, c")
_turns("m4_where", f"WITH {_C} SELECT x.src AS a, q.role AS role FROM n x JOIN c p ON p.id = x.src JOIN c q ON q.id = x.dst WHERE p.turn >= 1 AND q.role <> p.role", "MATCH (a)-[:NEXT]->(b) WHERE a.turn >= 1 AND b.role <> a.role RETURN a, b.role AS role")
_turns("m5_not_exists", f"WITH {_C} SELECT x.dst AS last FROM n x WHERE NOT EXISTS (SELECT 1 FROM n y WHERE y.src = x.dst)", "MATCH (a)-[:NEXT]->(b) WHERE NOT EXISTS { MATCH (b)-[:NEXT]->(c) } RETURN b AS last")
_turns("m6_comma", f"WITH {_C} SELECT x.src AS a, y.dst AS c FROM n x JOIN n y ON x.dst = y.src", "MATCH (a)-[:NEXT]->(b), (b)-[:NEXT]->(c) RETURN a, c")
_turns("m7_return_limit", f"WITH {_C} SELECT x.src AS a, p.role AS role FROM n x JOIN c p ON p.id = x.src ORDER BY a DESC LIMIT 15", "MATCH (a)-[:NEXT]->(b) RETURN a, a.role AS role ORDER BY a DESC LIMIT 15")
_turns("m1_node_label", f"WITH {_C} SELECT x.src AS a FROM n x JOIN c p ON p.id = x.src WHERE p.role = 'user'", "MATCH (a:user)-[:NEXT]->(b) RETURN a")
