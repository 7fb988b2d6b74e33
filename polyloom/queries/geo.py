"""Geospatial queries over points derived from customer and supplier keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyloom.functions import geo as G
from polyloom.queries import query
from polyloom.session import load

_LNG, _LAT = "(({k} * 37) % 360 - 180 + 0.25)::DOUBLE", "(({k} * 17) % 170 - 85)::DOUBLE"
_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"


def places(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    k = F.col(key)
    return load(spark, sf_dir, table).select(k.alias("id"), ((k * 37) % 360 - 180 + F.lit(0.25)).cast("double").alias("lng"), ((k * 17) % 170 - 85).cast("double").alias("lat"))


_PTS = f"p AS (SELECT c_custkey AS id, {_LNG.format(k='c_custkey')} AS lng, {_LAT.format(k='c_custkey')} AS lat FROM customer)"


@query("l1_distance", f"WITH {_PTS} SELECT id, round({_HAV.format(x1='lng', y1='lat', x2='13.4', y2='52.5')}, 3) AS d FROM p")
def distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir, "customer", "c_custkey")
    return p.select("id", F.round(G.haversine(F.col("lng"), F.col("lat"), F.lit(13.4), F.lit(52.5)), 3).alias("d"))


@query("l2_bearing", f"WITH {_PTS} SELECT id, round((degrees(atan2(sin(radians(13.4 - lng)) * cos(radians(52.5)), cos(radians(lat)) * sin(radians(52.5)) - sin(radians(lat)) * cos(radians(52.5)) * cos(radians(13.4 - lng)))) + 360) % 360, 6) AS b FROM p")
def bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir, "customer", "c_custkey")
    return p.select("id", F.round(G.bearing(F.col("lng"), F.col("lat"), F.lit(13.4), F.lit(52.5)), 6).alias("b"))


@query("l9_dwithin_points", f"WITH {_PTS} SELECT id FROM p WHERE {_HAV.format(x1='lng', y1='lat', x2='10.0', y2='40.0')} <= 1500000")
def dwithin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir, "customer", "c_custkey")
    return p.filter(G.haversine(F.col("lng"), F.col("lat"), F.lit(10.0), F.lit(40.0)) <= 1_500_000).select("id")


@query(
    "j15_spatial_join",
    f"WITH {_PTS}, s AS (SELECT s_suppkey AS sid, ({_LNG.format(k='s_suppkey')} + 1.5) AS lng, ({_LAT.format(k='s_suppkey')} + 0.5) AS lat FROM supplier) SELECT p.id, s.sid FROM p JOIN s ON {_HAV.format(x1='p.lng', y1='p.lat', x2='s.lng', y2='s.lat')} <= 300000",
)
def spatial_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir, "customer", "c_custkey")
    s = places(spark, sf_dir, "supplier", "s_suppkey").withColumn("lng", F.col("lng") + 1.5).withColumn("lat", F.col("lat") + 0.5)
    return G.dwithin_join(p, s, 300_000).select("id", F.col("id_r").alias("sid"))


@query("s11_spatial_scan", f"WITH {_PTS} SELECT id FROM p WHERE lng > -20 AND lng < 40 AND lat > 30 AND lat < 60")
def spatial_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir, "customer", "c_custkey").filter("lng between -20 and 40 and lat between 30 and 60")  # box first, then the predicate
    area = G.box(F.lit(-20.0), F.lit(30.0), F.lit(40.0), F.lit(60.0))
    return p.filter(G.st_contains(area, G.point(F.col("lng"), F.col("lat")))).select("id")


@query("l3_constructors", f"WITH {_PTS} SELECT id, lng AS x, lat AS y, 'Point' AS kind FROM p")
def constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir, "customer", "c_custkey").withColumn("g", G.point(F.col("lng"), F.col("lat")))
    return p.select("id", G.x(F.col("g")).alias("x"), G.y(F.col("g")).alias("y"), G.kind(F.col("g")).alias("kind"))


@query("l5_geohash")
def geohash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir, "customer", "c_custkey").select("id", G.geohash(F.col("lng"), F.col("lat"), 6).alias("hash"))


_SQ = "s AS (SELECT n_nationkey AS id, 5 * n_nationkey AS x FROM nation), q AS (SELECT id, x + 2 AS x FROM s)"


def squares(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 1.0).alias("v"))
    sq = lambda o: G.box(F.col("v") * 5 / 2 + o, F.col("v") * 2 + o, F.col("v") * 5 / 2 + o + 4, F.col("v") * 2 + o + 4)
    return n.select("id", sq(0).alias("g")), n.select(F.col("id").alias("id2"), sq(1).alias("h"))


@query(
    "l7_predicates",
    "WITH a AS (SELECT n_nationkey AS id, n_nationkey * 2.5 AS x, n_nationkey * 2.0 AS y FROM nation) SELECT a.id, b.id AS id2 FROM a JOIN a b ON a.x <= b.x + 5 AND b.x + 1 <= a.x + 4 AND a.y <= b.y + 5 AND b.y + 1 <= a.y + 4",
)
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = squares(spark, sf_dir)
    return a.join(F.broadcast(b), F.abs(F.col("id") - F.col("id2")) <= 4).filter(G.st_intersects(F.col("g"), F.col("h"))).select("id", "id2")


@query("l4_buffer_area")
def buffer_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir, "supplier", "s_suppkey").withColumn("g", G.point(F.col("lng"), F.col("lat")))
    b = p.withColumn("b", G.st_buffer(F.col("g"), 1000.0))
    return b.select("id", F.round(G.geo_area(F.col("b")), 0).alias("area"), F.round(G.geo_length(F.col("b")), 0).alias("perimeter"), G.st_contains(F.col("b"), F.col("g")).alias("inside"))


@query("l11_set_operations", "SELECT n_nationkey AS id, 'MultiPolygon' AS u, n_nationkey * 2.5::DOUBLE + 1 AS west, TRUE AS valid FROM nation")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = squares(spark, sf_dir)
    j = a.join(b, F.col("id") == F.col("id2"))
    i = G.st_envelope(G.st_intersection(F.col("g"), F.col("h")))
    return j.select("id", G.kind(G.st_union(F.col("g"), F.col("h"))).alias("u"), F.get_json_object(i, "$.coordinates[0][0][0]").cast("double").alias("west"), G.geo_is_valid(F.col("g")).alias("valid"))


@query("l13_wkt", f"WITH {_PTS} SELECT id, lng AS x, lat AS y FROM p")
def wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir, "customer", "c_custkey").withColumn("g", G.geo_from_wkt(G.geo_as_wkt(G.point(F.col("lng"), F.col("lat")))))
    return p.select("id", G.x(F.col("g")).alias("x"), G.y(F.col("g")).alias("y"))
