"""Scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyloom.functions import scalar as S
from polyloom.functions import timeseries as ts
from polyloom.queries import query, same
from polyloom.session import load


def _cols(name: str, table: str, key: str, make, sql: str | None) -> None:
    @query(name, f"SELECT {key}, {sql} FROM {table}" if sql else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return load(spark, sf_dir, table).select(key, *[c.alias(n) for n, c in make().items()])


c = F.col
_cols("f1_upper_lower", "part", "p_partkey", lambda: {"u": F.upper("p_name"), "l": F.lower("p_type")}, "upper(p_name) AS u, lower(p_type) AS l")
_cols("f2_trim", "part", "p_partkey", lambda: {"b": S.trim(F.concat(F.lit(" \t"), c("p_name"), F.lit("  "))), "l": S.trim(F.concat(F.lit("  "), c("p_name")), "left"), "r": S.trim(F.concat(c("p_name"), F.lit("  ")), "right")}, "p_name AS b, p_name AS l, p_name AS r")
_cols("f3_length", "documents", "doc_id", lambda: {"n": F.char_length("text"), "b": F.octet_length("text")}, "length(text)::INTEGER AS n, strlen(text)::INTEGER AS b")
_cols("f4_substr", "part", "p_partkey", lambda: {"a": S.substr(c("p_name"), 2, 3), "b": S.substr(c("p_name"), 0, 4), "d": S.substr(c("p_name"), 3)}, "substr(p_name, 2, 3) AS a, substr(p_name, 1, 4) AS b, substr(p_name, 3) AS d")
_cols("f5_concat", "part", "p_partkey", lambda: {"a": S.concat(c("p_name"), F.lit(None), F.lit("/"), c("p_size"))}, "concat(p_name, NULL, '/', p_size) AS a")
_cols("f6_replace_reverse", "part", "p_partkey", lambda: {"a": F.replace("p_name", F.lit("red"), F.lit("blue")), "b": F.reverse("p_name"), "d": S.split_part(c("p_name"), " ", 2)}, "replace(p_name, 'red', 'blue') AS a, reverse(p_name) AS b, split_part(p_name, ' ', 2) AS d")
_cols("f9_math", "customer", "c_custkey", lambda: {"a": F.abs("c_acctbal"), "b": F.ceil("c_acctbal").cast("long"), "d": F.floor("c_acctbal").cast("long"), "e": F.round("c_acctbal", 1), "f": F.signum("c_acctbal")}, "abs(c_acctbal) AS a, ceil(c_acctbal)::BIGINT AS b, floor(c_acctbal)::BIGINT AS d, round(c_acctbal, 1) AS e, sign(c_acctbal)::DOUBLE AS f")
_cols("f12_power_sqrt", "customer", "c_custkey", lambda: {"a": S.power(c("c_nationkey"), F.lit(2)), "b": S.sqrt(c("c_acctbal")), "d": S.mod(c("c_custkey"), F.lit(7)), "e": S.mod(c("c_custkey"), F.lit(0))}, "power(c_nationkey, 2)::DOUBLE AS a, CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END AS b, c_custkey % 7 AS d, NULL::BIGINT AS e")
_cols("f15_logs", "part", "p_partkey", lambda: {"a": F.round(S.log(c("p_retailprice")), 9), "b": F.round(S.log(c("p_retailprice"), "10"), 9), "d": F.round(S.log(c("p_retailprice"), "2"), 9), "e": F.round(F.exp(c("p_size") / 10), 6)}, "round(ln(p_retailprice), 9) AS a, round(log10(p_retailprice), 9) AS b, round(log2(p_retailprice), 9) AS d, round(exp(p_size / 10.0::DOUBLE), 6) AS e")
_cols("f17_greatest_least", "part", "p_partkey", lambda: {"a": F.greatest(c("p_size"), F.lit(20), F.lit(None).cast("int")), "b": F.least(c("p_size"), F.lit(20))}, "greatest(p_size, 20) AS a, least(p_size, 20) AS b")
_cols("f18_typeof", "part", "p_partkey", lambda: {"a": S.type_of(c("p_size")), "b": S.type_of(c("p_retailprice")), "d": S.type_of(c("p_name")), "e": S.type_of(F.lit(None))}, "'int' AS a, 'float' AS b, 'string' AS d, 'null' AS e")


@query("f19_generators", "SELECT count(*) AS n, count(*) AS u4, count(*) AS u7, count(*) AS ul, count(*) AS cu, count(*) AS na FROM part")
def generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    # a file as small as this one is read by a task or two; ids are made by one for each 100,000 rows
    part = part.select("p_partkey").repartition(max(1, math.ceil(part.count() / 100_000)))
    d = part.select(S.uuid_v4().alias("u4"), S.uuid_v7().alias("u7"), S.ulid().alias("ul"), S.cuid2().alias("cu"), S.nanoid().alias("na"))
    return d.agg(
        F.count("*").alias("n"),
        F.count_if(S.uuid_version(c("u4")) == 4).alias("u4"),
        F.count_if(S.uuid_version(c("u7")) == 7).alias("u7"),
        F.count_if(S.is_ulid(c("ul"))).alias("ul"),
        F.count_if(S.is_cuid2(c("cu"))).alias("cu"),
        F.count_if(S.is_nanoid(c("na"))).alias("na"),
    )


@query("f21_id_detectors", "SELECT 'uuid' AS a, 'ulid' AS b, 'unknown' AS d, 4::INTEGER AS v, 1469922850259::BIGINT AS ms")
def detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, ul = F.lit("3f2b8c1e-9d4a-4c6b-8e2f-1a2b3c4d5e6f"), F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV")
    return spark.range(1).select(S.id_type(u).alias("a"), S.id_type(ul).alias("b"), S.id_type(F.lit("x")).alias("d"), S.uuid_version(u).alias("v"), S.ulid_timestamp(ul).alias("ms"))


_cols("f23_decimal", "part", "p_partkey", lambda: {"a": S.decimal(c("p_size"), 2).cast("double"), "b": S.decimal(c("p_name"), 2).cast("double")}, "p_size::DOUBLE AS a, NULL::DOUBLE AS b")
def _t() -> Column:
    return F.col("o_orderdate").cast("timestamp")


_cols("f25_datetime", "orders", "o_orderkey", lambda: {"a": F.unix_seconds(S.to_datetime(F.lit("2024-02-03T04:05:06Z"))), "b": F.unix_seconds(_t()), "d": F.unix_millis(_t()), "e": F.unix_micros(S.to_datetime(c("o_orderkey"), "bigint"))}, "1706933106::BIGINT AS a, (epoch_us(o_orderdate) // 1000000)::BIGINT AS b, (epoch_us(o_orderdate) // 1000)::BIGINT AS d, o_orderkey AS e")
_cols("f27_extract", "orders", "o_orderkey", lambda: {p: S.extract(p, _t()).cast("long") for p in ("year", "month", "day", "hour", "minute", "second", "microsecond", "epoch", "dow")}, ", ".join(f"extract({p} FROM o_orderdate)::BIGINT AS {p}" for p in ("year", "month", "day", "hour", "minute", "second")) + ", (epoch_us(o_orderdate) % 1000000)::BIGINT AS microsecond, (epoch_us(o_orderdate) // 1000000)::BIGINT AS epoch, dayofweek(o_orderdate)::BIGINT AS dow")
_cols("f28_date_trunc", "orders", "o_orderkey", lambda: {p: F.unix_seconds(F.date_trunc(p, _t())) for p in ("year", "month", "day", "hour")}, ", ".join(f"(epoch_us(date_trunc('{p}', o_orderdate)::TIMESTAMP) // 1000000)::BIGINT AS {p}" for p in ("year", "month", "day", "hour")))
_cols("f29_date_add", "orders", "o_orderkey", lambda: {"a": F.unix_seconds(S.add_duration(_t(), "36h")), "b": F.unix_seconds(S.add_duration(_t(), "15m", -1)), "d": S.date_diff(S.add_duration(_t(), "90s"), _t())}, "(epoch_us(o_orderdate) // 1000000 + 129600)::BIGINT AS a, (epoch_us(o_orderdate) // 1000000 - 900)::BIGINT AS b, 90.0::DOUBLE AS d")
_cols("f32_date_format", "orders", "o_orderkey", lambda: {"a": F.date_format(_t(), "yyyy-MM-dd HH:mm")}, "strftime(o_orderdate, '%Y-%m-%d %H:%M') AS a")
_cols("f31_duration", "region", "r_regionkey", lambda: {"a": F.lit(ts.interval_ms("1h 30m")).cast("long")}, "5400000::BIGINT AS a")
same("f24_now", "SELECT count(*) AS n FROM region WHERE current_timestamp > TIMESTAMP '2020-01-01 00:00:00'", "SELECT count(*) AS n FROM region")
def _p() -> Column:
    return F.col("props")


_cols("f34_json_get", "events", "event_id", lambda: {"a": S.json_get(_p(), "k").try_cast("long"), "b": S.json_get(_p(), "$.missing"), "d": S.json_get(F.lit('{"a":{"b":[5,6]}}'), "a.b.1").try_cast("long")}, "(props->>'k')::BIGINT AS a, NULL::VARCHAR AS b, 6::BIGINT AS d")
_cols("f35_json_set_remove", "events", "event_id", lambda: {"a": S.json_get(S.json_set(_p(), "z", F.lit(5)), "z").try_cast("long"), "b": S.json_get(S.json_remove(_p(), "k"), "k"), "d": S.json_remove(_p(), "k")}, "5::BIGINT AS a, NULL::VARCHAR AS b, '{}' AS d")
_cols("f37_json_keys", "events", "event_id", lambda: {"a": F.array_join(S.json_keys(_p()), ","), "b": F.array_join(S.json_values(_p()), ",").try_cast("long"), "d": S.json_length(_p()).cast("long"), "e": S.json_type(_p())}, "'k' AS a, (props->>'k')::BIGINT AS b, 1::BIGINT AS d, 'object' AS e")
_cols("f40_json_make", "nation", "n_nationkey", lambda: {"a": S.json_array(c("n_nationkey"), c("n_regionkey")), "b": S.json_object(k=c("n_nationkey"), v=c("n_name"))}, "'[' || n_nationkey || ',' || n_regionkey || ']' AS a, '{\"k\":' || n_nationkey || ',\"v\":\"' || n_name || '\"}' AS b")
_cols("f41_json_contains", "events", "event_id", lambda: {"a": S.json_contains(_p(), F.lit("k")), "b": S.json_contains(F.lit("[1,2,3]"), c("event_id")), "d": S.json_get(S.json_merge(_p(), F.lit('{"k":1,"m":2}')), "k").try_cast("long")}, "TRUE AS a, event_id IN (1, 2, 3) AS b, 1::BIGINT AS d")
_cols("f43_doc_get", "events", "event_id", lambda: {"a": S.json_get(_p(), "$.k"), "b": S.json_exists(_p(), "$.k"), "d": S.json_exists(_p(), "$.q"), "e": S.array_contains_value(F.lit('{"t":["x","7"]}'), "$.t", c("user_id"))}, "props->>'k' AS a, TRUE AS b, FALSE AS d, user_id = 7 AS e")
