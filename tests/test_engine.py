"""Hand-computed cases for the operators and functions."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from polyloom.functions import geo, scalar
from polyloom.functions import timeseries as ts
from polyloom.functions import vector as V
from polyloom.operators import dml, graph, text
from polyloom.operators.temporal import asof_join, latest_on
from polyloom.plans import promql
from polyloom.plans.match import MatchError, match
from polyloom.plans.statements import Database, StatementError
from polyloom.sources import ingest
from polyloom.streaming import continuous as C


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_rate_resets_and_standing_time(spark):
    d = spark.createDataFrame([("a", 0, 0.0), ("a", 1000, 10.0), ("a", 2000, 30.0), ("a", 3000, 5.0), ("a", 3000, 9.0), ("b", 0, 1.0), ("b", 500, 6.0)], "s string, ms long, v double")
    w = Window.partitionBy("s").orderBy("ms", "v")
    got = [r.x for r in d.select("s", "ms", "v", ts.rate(F.col("v"), F.col("ms"), w).alias("x")).orderBy("s", "ms", "v").collect()]
    assert got == [None, 10.0, 20.0, 5.0, None, None, 10.0]


def test_moving_average_and_interpolation(spark):
    d = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (5, None)], "ms long, v double")
    w = Window.partitionBy(F.lit(0)).orderBy("ms")
    out = d.select("ms", *[ts.interpolate(F.col("v"), F.col("ms"), m, w).alias(m) for m in ("linear", "prev", "next", "zero")], ts.moving_avg(F.col("ms").cast("double"), 2, w).alias("ma")).orderBy("ms").collect()
    assert [tuple(r) for r in out] == [(1, 1.0, 1.0, 1.0, 1.0, None), (2, 2.0, 1.0, 3.0, 0.0, 1.5), (3, 3.0, 3.0, 3.0, 3.0, 2.5), (5, 3.0, 3.0, 0.0, 0.0, 4.0)]


def test_ema_carries_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        d = spark.createDataFrame([("a", i, float(i % 5)) for i in range(9)] + [("b", 0, 7.0)], "s string, t int, v double")
        got = {(r.s, r.t): r.ema for r in ts.ema(d, ["s"], ["t"], "v", 0.3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    e = 0.0
    for i in range(9):
        e = float(i % 5) if i == 0 else 0.3 * (i % 5) + 0.7 * e
        assert got["a", i] == pytest.approx(e)
    assert got["b", 0] == 7.0
    with pytest.raises(ValueError):
        ts.ema(d, ["s"], ["t"], "v", 0)


@pytest.mark.parametrize("text_, ms", [("15m", 900_000), ("2 hours", 7_200_000), ("INTERVAL '1 day'", 86_400_000), ("PT5M", 300_000), ("P1DT1H", 90_000_000), ("250", 250), ("1h30m", 5_400_000)])
def test_intervals(text_, ms):
    assert ts.interval_ms(text_) == ms


@pytest.mark.parametrize("bad", ["", "5x", "m", "0s", "1h nonsense"])
def test_bad_intervals(bad):
    with pytest.raises(ValueError):
        ts.interval_ms(bad)


@pytest.mark.parametrize("tol, expect", [(None, ["x", "y", "z"]), (10, ["x", None, None]), (50, ["x", "y", "z"])])
def test_asof(spark, tol, expect):
    left = spark.createDataFrame([(100,), (200,), (300,)], "ts long")
    right = spark.createDataFrame([(90, "x"), (150, "y"), (250, "z")], "ts long, d string")
    assert [r.d for r in asof_join(left, right, "ts", tolerance=tol).orderBy("ts").collect()] == expect
    assert [r.d for r in asof_join(left, right.limit(0), "ts").collect()] == [None] * 3
    keyed = asof_join(left.withColumn("k", F.lit(1)), right.withColumn("k", F.lit(1)), "ts", ["k"], tol)
    assert [r.d for r in keyed.orderBy("ts").collect()] == expect


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=30), st.lists(st.integers(0, 50), max_size=30))
def test_asof_without_keys_matches_brute_force(spark, a, b):
    left = spark.createDataFrame([(x, i) for i, x in enumerate(a)], "ts long, i int")
    right = spark.createDataFrame([(x, i) for i, x in enumerate(b)], "ts long, r int")
    got = {r.i: r.r for r in asof_join(left, right, "ts", tiebreak=["r"]).collect()}
    for i, x in enumerate(a):
        cand = [(y, j) for j, y in enumerate(b) if y <= x]
        assert got[i] == (max(cand)[1] if cand else None)


def test_latest_keeps_the_first_of_equals(spark):
    d = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 4, 3), (2, 1, 4)], "k int, t int, id int")
    assert rows(latest_on(d, ["k"], "t", ["id"]), "k", "id") == [(1, 1), (2, 4)]


def test_gap_fill_constant_and_null(spark):
    d = spark.createDataFrame([(0, 1.0), (3000, 4.0)], "b long, v double")
    assert rows(ts.gap_fill(d, "b", "1s", ["v"]), "b", "v") == [(0, 1.0), (1000, None), (2000, None), (3000, 4.0)]
    assert rows(ts.gap_fill(d, "b", "1s", ["v"], fill="linear"), "b", "v") == [(0, 1.0), (1000, 2.0), (2000, 3.0), (3000, 4.0)]


def test_promql_functions(spark):
    s = spark.createDataFrame([({"__name__": "c", "h": "x"}, t * 1000, float(10 * t)) for t in range(4)] + [({"__name__": "c", "h": "y"}, 3000, 5.0)], "labels map<string,string>, ts long, value double")
    e = promql.Engine(s, 3000)
    one = lambda q: {(r.labels.get("h"), round(r.value, 6)) for r in e.query(q).collect()}
    assert one("rate(c[10s])") == {("x", 10.0)}
    assert one("c") == {("x", 30.0), ("y", 5.0)}
    assert one("sum(c)") == {(None, 35.0)}
    assert one('c{h!="y"} + 1') == {("x", 31.0)}
    assert one("c unless c > 10") == {("y", 5.0)}
    assert one("absent(nothing)") == {(None, 1.0)}
    assert one("2 ^ 3 ^ 2") == {(None, 512.0)}
    assert one("-2 ^ 2") == {(None, -4.0)}
    assert one("holt_winters(c[10s], 0.5, 0.5)") == {("x", 30.0)}
    assert one("predict_linear(c[10s], 2)") == {("x", 50.0)}
    for bad in ("rate(c)", "c[5m]", "sum(", "c{h~1}", "nofn(c)"):
        with pytest.raises(promql.PromQLError):
            e.query(bad)


def test_histogram_in_the_last_bucket_gives_the_finite_bound(spark):
    s = spark.createDataFrame([({"le": b}, 0, c) for b, c in (("1", 1.0), ("2", 2.0), ("+Inf", 10.0))], "labels map<string,string>, ts long, value double")
    q = lambda p: promql.Engine(s, 0).query(f'histogram_quantile({p}, {{le=~".+"}})').first().value
    assert q(0.9) == 2.0
    assert q(0.1) == 1.0
    assert q(0.15) == 1.5


@pytest.fixture(scope="module")
def social(spark):
    return spark.createDataFrame([("alice", "KNOWS", "bob"), ("bob", "KNOWS", "carol"), ("carol", "KNOWS", "dave"), ("alice", "LIKES", "carol"), ("bob", "BLOCKED", "dave")], "src string, label string, dst string")


def test_match(spark, social):
    assert rows(match(social, "MATCH (a)-[:KNOWS]->(b) WHERE a = 'alice' RETURN b"), "b") == [("bob",)]
    assert rows(match(social, "MATCH (a)-[:KNOWS*2]->(b) WHERE a = 'alice' RETURN b"), "b") == [("carol",)]
    assert rows(match(social, "MATCH (a)-[:KNOWS]->(b) OPTIONAL MATCH (a)-[:LIKES]->(c) RETURN a, c"), "a", "c") == [("alice", "carol"), ("bob", None), ("carol", None)]
    assert match(social, "MATCH (a)-[:KNOWS]->(b) WHERE NOT EXISTS { MATCH (a)-[:BLOCKED]->(x) } RETURN a, b").count() == 2
    assert rows(match(social, "MATCH (a)-[r]-(b) WHERE a = 'carol' AND r = 'LIKES' RETURN b"), "b") == [("alice",)]
    with pytest.raises(MatchError):
        match(social, "RETURN 1")
    with pytest.raises(MatchError):
        match(social, "MATCH (a)-[:X]->(b) RETURN a.name")


def test_graph_algorithms(spark, social):
    tri = spark.createDataFrame([("a", "e", "b"), ("b", "e", "c"), ("c", "e", "a")], "src string, label string, dst string")
    assert all(abs(r["rank"] - 1 / 3) < 1e-6 for r in graph.pagerank(tri).collect())
    assert graph.triangle_count(tri).first().triangles == 1
    assert {r.coefficient for r in graph.clustering(tri).collect()} == {1.0}
    assert {r.coreness for r in graph.kcore(tri).collect()} == {2}
    w = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 3.0), ("a", "c", 10.0), ("x", "a", 1.0)], "src string, dst string, weight double")
    d = {r.node_id: r.distance for r in graph.sssp(w, "a").collect()}
    assert d["c"] == 5.0 and d["x"] == float("inf")
    with pytest.raises(ValueError):
        graph.sssp(w, "zz")
    assert graph.shortest_path(social, "alice", "dave").first().path == ["alice", "bob", "dave"]
    assert graph.shortest_path(social, "dave", "alice").count() == 0
    assert graph.bfs(social, ["alice"], 1, labels=["NONE"]).count() == 1
    path = spark.createDataFrame([(i, i + 1) for i in range(4)], "src int, dst int")
    assert {r.node_id: r.centrality for r in graph.betweenness(path).collect()} == {0: 0.0, 1: 3.0, 2: 4.0, 3: 3.0, 4: 0.0}
    two = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (12, 10), (3, 10)], "src int, dst int")
    groups = {r.node_id: r.community_id for r in graph.louvain(two).collect()}
    assert len({groups[i] for i in (1, 2, 3)}) == 1 and len({groups[i] for i in (10, 11, 12)}) == 1 and groups[1] != groups[10]
    assert graph.components(path).select("component_id").distinct().count() == 1


def test_text(spark):
    d = spark.createDataFrame([("d1", "Rust is a systems programming language"), ("d2", "Python is great for machine learning"), ("d3", "Rust and Python are both great languages"), ("d4", None)], "doc_id string, text string")
    got = text.bm25(d, "doc_id", "text", ["rust", "programming"], "or").orderBy(F.desc("score")).collect()
    assert [r.doc_id for r in got] == ["d1", "d3"]
    assert text.bm25(d, "doc_id", "text", ["rust", "programming"], "and").count() == 1
    assert spark.range(1).select(text.standard_tokens(F.lit("the running jumps quickly")).alias("t")).first().t[:2] == ["run", "jump"]
    assert rows(text.fuzzy_terms(d, "text", "pythn"), "term", "edits") == [("python", 1)]
    assert spark.range(1).select(text.fold(F.lit("Élan")).alias("t")).first().t == "elan"


def test_vectors(spark):
    d = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = {(m, r.vec_id): r.d for m in ("l2", "cosine", "manhattan", "chebyshev", "hamming", "jaccard", "inner_product") for r in d.select("vec_id", V.distance(F.col("embedding"), V.literal([0.0, 1.0]), m).alias("d")).collect()}
    assert got["l2", 1] == 2.0 and got["cosine", 1] == 1.0 and got["cosine", 2] == 1.0 and got["manhattan", 1] == 2.0
    assert got["chebyshev", 1] == 1.0 and got["hamming", 1] == 2.0 and got["jaccard", 0] == 0.0 and got["inner_product", 0] == -1.0
    with pytest.raises(ValueError):
        V.distance(F.col("embedding"), F.col("embedding"), "none")


def test_geometry():
    sq = lambda o, s=4: {"type": "Polygon", "coordinates": [[[o, o], [o + s, o], [o + s, o + s], [o, o + s], [o, o]]]}
    p = lambda x, y: {"type": "Point", "coordinates": [x, y]}
    assert geo.intersects_(sq(0), sq(2)) and not geo.intersects_(sq(0), sq(5)) and geo.intersects_(sq(0), sq(4))
    assert geo.contains_(sq(0), p(2, 2)) and not geo.contains_(sq(0), p(0, 2)) and geo.contains_(sq(0), sq(1, 2)) and not geo.contains_(sq(0), sq(2))
    assert geo.distance_(p(0, 0), p(0, 1)) == pytest.approx(111194.9, rel=1e-4)
    assert geo.distance_(sq(0), p(5, 2)) == pytest.approx(111194.9, rel=2e-3)
    assert geo.encode_geohash(-5.6, 42.6, 5) == "ezs42"
    assert len(geo.geohash_neighbors("ezs42")) == 8
    assert geo.bounds_(geo.intersection_(sq(0), sq(2))) == (2, 2, 4, 4)
    for g in (p(1, 2), sq(0), {"type": "LineString", "coordinates": [[0, 0], [1, 1.5]]}):
        assert geo.from_wkt_(geo.to_wkt_(g)) == json.loads(json.dumps(g, default=float))
    assert geo.valid_(sq(0)) and not geo.valid_({"type": "Polygon", "coordinates": [[[0, 0], [1, 1]]]})


def test_lines(spark):
    lines = ["cpu,z=3,a=1 value=1.0 1000", "temp,loc=out\\ side v=-12.5,s=\"a,b=c\",n=3i,ok=t", "", "# no", "bad", "m, x=1", "m x=oops"]
    got = ingest.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.measurement for r in got] == ["cpu", "temp", None, None, None]
    assert list(got[0].tags) == ["a", "z"] and got[0].ts_ns == 1000
    assert got[1].tags == {"loc": "out side"} and got[1].fields["s"].text == "a,b=c" and got[1].fields["n"].kind == "int" and got[1].ts_ns is None
    assert all(r.error for r in got[2:])


def test_changes_to_tables(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "id int, name string, v double")
    up = dml.upsert(t, spark.createDataFrame([(2, "B"), (3, "c")], "id int, name string"), "id")
    assert rows(up, "id", "name", "v") == [(1, "a", 1.0), (2, "B", None), (3, "c", None)]
    assert rows(dml.delete(t, F.col("v") > 0), "id") == [(2,)]
    assert rows(dml.update(t, {"name": F.lit("z")}, F.col("v").isNull()), "name") == [("a",), ("z",)]
    kv = dml.KeyValue(spark.createDataFrame([("us-east", 10), ("eu-west", None), ("us-west", 900)], "key string, expire_at long"), "key", 500)
    assert rows(kv.scan("us-*"), "key") == [("us-west",)] and kv.ttl("us-west") == 400 and kv.ttl("eu-west") == -1 and kv.ttl("us-east") == -2


def test_statements(spark, social):
    db = Database(spark)
    db.put("edges", social)
    assert db.execute("GRAPH NEIGHBORS edges OF 'bob'").count() == 2
    assert db.execute("GRAPH ALGO wcc ON edges").count() == 4
    assert db.execute("ON edges MATCH (a)-[:KNOWS]->(b) RETURN a, b").count() == 3
    db.execute("GRAPH INSERT EDGE INTO edges FROM 'x' TYPE 'T' TO 'y'")
    assert db.execute("SELECT * FROM edges").count() == 6
    db.execute("CREATE COLLECTION v (id INT, e VECTOR(2))")
    db.execute("INSERT INTO v VALUES (1, array(0.0, 1.0)), (2, array(1.0, 0.0))")
    assert db.execute("SEARCH v USING VECTOR (e, [0, 1], 1)").first().id == 1
    db.execute("TRUNCATE v")
    assert db.execute("SELECT * FROM v").count() == 0
    with pytest.raises(StatementError):
        db.execute("GRAPH ALGO nothing ON edges")
    with pytest.raises(StatementError):
        db.execute("DROP COLLECTION missing")


def test_late_rows_count(spark, tmp_path):
    agg = C.ContinuousAggregate(str(tmp_path / "a"), "ms", "1s", [], [C.Measure("count"), C.Measure("avg", "v"), C.Measure("first", "v")])
    agg.write_batch(spark.createDataFrame([(1500, 3.0), (2500, 1.0)], "ms long, v double"), 0)
    agg.write_batch(spark.createDataFrame([(1200, 5.0)], "ms long, v double"), 1)
    agg.write_batch(spark.createDataFrame([(1200, 5.0)], "ms long, v double"), 1)
    assert rows(agg.read(spark), "bucket", "count_all", "avg_v", "first_v") == [(1000, 2, 4.0, 5.0), (2000, 1, 1.0, 1.0)]
    assert agg.watermark(spark) == 2500


def test_json(spark):
    d = spark.createDataFrame([('{"a":{"b":[5,6]},"s":"x"}',), (None,), ("nonsense",)], "j string")
    got = d.select(scalar.json_get(F.col("j"), "a.b.1").alias("v"), scalar.json_exists(F.col("j"), "$.s").alias("e"), scalar.json_type(F.col("j")).alias("t")).collect()
    assert [(r.v, r.e, r.t) for r in got] == [("6", True, "object"), (None, False, None), (None, False, None)]


def test_compaction_keeps_results(spark, tmp_path):
    from polyloom.streaming.continuous import ContinuousAggregate, Measure

    agg = ContinuousAggregate(f"file://{tmp_path}/agg", "ms", "1h", ["k"], [Measure("count"), Measure("avg", "v"), Measure("last", "v")])
    for b in range(3):
        agg.write_batch(spark.createDataFrame([(b * 1_800_000 + i, i % 2, float(i + b)) for i in range(10)], "ms long, k int, v double"), b)
    before = sorted(map(tuple, agg.read(spark).collect()))
    agg.compact(spark)
    assert len(agg._batches(spark)) == 1 and sorted(map(tuple, agg.read(spark).collect())) == before
    agg.write_batch(spark.createDataFrame([(5, 0, 1.0)], "ms long, k int, v double"), 3)
    agg.compact(spark)
    assert agg.read(spark).agg(F.sum("count_all")).first()[0] == 31 and len(agg._batches(spark)) == 1


def test_terms_are_literal(spark):
    d = spark.createDataFrame([(1, "c++ (beta) and a.b"), (2, "axb beta")], "id long, t string")
    marked = {r.id: r.m for r in d.select("id", text.highlight(F.col("t"), ["(beta", "a.b"]).alias("m")).collect()}
    assert marked == {1: "c++ <b>(beta</b>) and <b>a.b</b>", 2: "axb beta"}
    assert [r.id for r in text.bm25(d, "id", "t", ["beta", "axb"]).collect()] == [2]
    assert text.bm25(d, "id", "t", ["beta", "axb"], "or").count() == 2


def test_long_paths_have_their_distances(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    with pytest.raises(RuntimeError):
        graph.sssp(edges, 0, max_rounds=3)
    with pytest.raises(RuntimeError):
        graph.kcore(edges, max_rounds=1)
    assert graph.distances(edges, 2).agg(F.max("depth")).first()[0] == 2
    d = graph.distances(edges, sources=spark.createDataFrame([(0,)], "id long"))
    assert d.agg(F.max("depth")).first()[0] == 12


def _counted(spark, pairs):
    """Edges (src, dst), and how often each row was computed."""
    seen = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return spark.createDataFrame(pairs, "src long, dst long").mapInArrow(rows, "src long, dst long"), lambda: seen.value / len(pairs)


_GRAPH = [(i, (i * i + j) % 40) for i in range(40) for j in range(1 + i % 4)] + [(100, 101), (101, 101)]


def _coreness(pairs):
    near = {v: {a + b - v for a, b in pairs if v in (a, b)} - {v} for p in pairs for v in p}
    out, k = {}, 0
    while near:
        v = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[v]))
        out[v] = k
        for w in near.pop(v):
            near[w].discard(v)
    return out


def test_kcore_computes_edges_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "CHUNK", 3, raising=False)
    edges, times = _counted(spark, _GRAPH)
    assert {r.node_id: r.coreness for r in graph.kcore(edges).collect()} == _coreness(_GRAPH)
    assert times() == 1


def test_dwithin_join_of_crowded_points(spark, monkeypatch):
    monkeypatch.setattr(geo, "SIDE", 16, raising=False)
    a = spark.range(600).selectExpr("id", "10.0D + id % 3 AS lng", "50.0D AS lat")
    b = spark.range(200).selectExpr("id AS sid", "10.0D + id % 2 AS lng", "50.1D AS lat")
    got = geo.dwithin_join(a, b, 20_000)
    assert got.agg(F.count("*"), F.countDistinct("id", "sid_r")).first() == (40_000, 40_000)
    # one place has 200 x 100 pairs: they are spread over tasks
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 8000


def test_generators_make_a_batch_at_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(scalar.secrets, "token_bytes", lambda n, real=scalar.secrets.token_bytes: calls.append(n) or real(n))
    makers = {}
    monkeypatch.setattr(scalar, "_generator", lambda make: makers.setdefault(len(makers), make))
    scalar.uuid_v7(), scalar.ulid(), scalar.cuid2(), scalar.nanoid()
    for make, size, letters in zip(makers.values(), (36, 26, 24, 21), ("0123456789abcdef-", scalar._BASE32, "abcdefghijklmnopqrstuvwxyz0123456789", None)):
        ids = make(5000)
        assert len(set(ids)) == 5000 and {len(i) for i in ids} == {size}
        assert letters is None or set("".join(ids)) == set(letters)
        assert make(0) == []
    assert len(calls) < 100
    monkeypatch.undo()
    d = spark.range(300).select(scalar.ulid().alias("u"), scalar.uuid_v7().alias("v"))
    assert d.filter(scalar.is_ulid(F.col("u")) & (scalar.uuid_version(F.col("v")) == 7)).count() == 300
    import time

    assert abs(d.select(scalar.ulid_timestamp(F.col("u"))).first()[0] / 1000 - time.time()) < 600


def test_standard_tokens_in_one_pass_a_step(spark):
    words = "classes ponies cats running hopped élans Ärgers grass bees it".split()
    d = spark.createDataFrame([(" ".join(words),), (None,), ("plain stopped",)], "t string").select(text.standard_tokens(F.col("t")).alias("x"))
    assert [r.x for r in d.collect()] == [["class", "poni", "cat", "run", "hop", "elan", "arger", "grass", "bee"], [], ["plain", "stop"]]
    # each step names its pattern once; nested they came to 31 replacements
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == len(text._STEMS)
    assert [r[0] for r in spark.createDataFrame([("hopping",), (None,)], "t string").select(text.stem(F.col("t"))).collect()] == ["hop", None]


def test_rounds_compute_edges_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "CHUNK", 3, raising=False)
    ids = sorted({v for p in _GRAPH for v in p})
    edges, times = _counted(spark, _GRAPH)
    low = {v: v for v in ids}
    for _ in ids:
        for a, b in _GRAPH:
            low[a] = low[b] = min(low[a], low[b])
    assert {r.node_id: r.component_id for r in graph.components(edges).collect()} == low
    assert times() == 1
    edges, times = _counted(spark, _GRAPH)
    rank, out = {v: 1 / len(ids) for v in ids}, {v: [b for a, b in _GRAPH if a == v] for v in ids}
    for _ in range(2):
        loose = sum(rank[v] for v in ids if not out[v])
        rank = {v: (0.15 + 0.85 * loose) / len(ids) + 0.85 * sum(rank[u] * out[u].count(v) / len(out[u]) for u in ids if out[u]) for v in ids}
    assert {r.node_id: r["rank"] for r in graph.pagerank(edges, iterations=2, tolerance=0).collect()} == pytest.approx(rank)
    assert times() == 1
    edges, times = _counted(spark, _GRAPH)
    assert {r.id: r.depth for r in graph.bfs(edges, [100], 3, "both").collect()} == {100: 0, 101: 1}
    assert times() == 1
