"""PromQL over ``events``: a counter a user and type, an hourly grid over three days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyloom.functions.timeseries import epoch_ms
from polyloom.plans.promql import Engine
from polyloom.queries import query
from polyloom.session import load

START, STEP, N = 1_704_585_600_000, 3_600_000, 25  # 2024-01-07 00:00 UTC


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    labels = F.create_map(F.lit("__name__"), F.lit("ev"), F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    return e.select(labels.alias("labels"), epoch_ms(F.col("ts")).alias("ts"), "value")


_G = f"WITH s AS (SELECT user_id::VARCHAR AS u, event_type AS ty, epoch_us(ts) // 1000 AS ts, value AS v FROM events), g AS (SELECT {START} + i * {STEP} AS t FROM range({N}) r(i))"
_I = _G + ", i AS (SELECT t, u, ty, arg_max(v, ts) AS v FROM g JOIN s ON s.ts <= t AND s.ts >= t - 21600000 GROUP BY ALL)"


def _w(hours: int) -> str:
    return _G + f", w AS (SELECT t, u, ty, ts, v, lag(v) OVER (PARTITION BY t, u, ty ORDER BY ts) AS p FROM g JOIN s ON s.ts <= t AND s.ts > t - {hours * STEP})"


def _prom(name: str, text: str, oracle: str | None, lookback: int = 21_600_000) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = Engine(samples(spark, sf_dir), START, START + (N - 1) * STEP, STEP, lookback).query(text)
        get = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit(""))
        return d.select("t", get("user").alias("u"), get("type").alias("ty"), F.round("value", 6).alias("v"))


_prom("r1_instant", "ev", _I + " SELECT t, u, ty, round(v, 6) AS v FROM i")
_prom("r3_matchers", 'ev{type=~"cl.*|view", user!="7", type!~"v.*"}', _I + " SELECT t, u, ty, round(v, 6) AS v FROM i WHERE ty = 'click' AND u <> '7'")
_prom("r1_offset", 'ev{type="view"} offset 2h', _G + " SELECT t, u, ty, round(arg_max(v, ts), 6) AS v FROM g JOIN s ON s.ts <= t - 7200000 AND s.ts >= t - 28800000 WHERE ty = 'view' GROUP BY ALL")
_INC = "sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END)"
_prom("r5_increase", "increase(ev[24h])", _w(24) + f" SELECT t, u, ty, round({_INC}, 6) AS v FROM w GROUP BY ALL HAVING count(*) > 1")
_prom("r5_rate", "rate(ev[24h])", _w(24) + f" SELECT t, u, ty, round({_INC} / ((max(ts) - min(ts)) / 1000.0::DOUBLE), 6) AS v FROM w GROUP BY ALL HAVING count(*) > 1")
_prom("r6_delta", "delta(ev[24h])", _w(24) + " SELECT t, u, ty, round(arg_max(v, ts) - arg_min(v, ts), 6) AS v FROM w GROUP BY ALL HAVING count(*) > 1")
_prom("r7_deriv", "deriv(ev[24h]) * 1000", _w(24) + " SELECT t, u, ty, round(regr_slope(v, (ts - t) / 1000.0::DOUBLE) * 1000, 6) AS v FROM w GROUP BY ALL HAVING count(*) > 1")
for _f, _s in (("avg", "avg(v)"), ("sum", "sum(v)"), ("min", "min(v)"), ("max", "max(v)"), ("count", "count(*)::DOUBLE")):
    _prom(f"r8_{_f}_over_time", f"{_f}_over_time(ev[12h])", _w(12) + f" SELECT t, u, ty, round({_s}, 6) AS v FROM w GROUP BY ALL")
_prom("r9_quantile_over_time", "quantile_over_time(0.75, ev[24h])", _w(24) + " SELECT t, u, ty, round(quantile_cont(v, 0.75), 6) AS v FROM w GROUP BY ALL")
_prom("r10_stddev_over_time", "stddev_over_time(ev[24h])", _w(24) + " SELECT t, u, ty, round(stddev_pop(v), 6) AS v FROM w GROUP BY ALL HAVING count(*) > 1")
_prom("r11_changes", "changes(ev[24h])", _w(24) + " SELECT t, u, ty, coalesce(sum(CASE WHEN p IS NOT NULL AND p <> v THEN 1.0::DOUBLE ELSE 0 END), 0) AS v FROM w GROUP BY ALL")
_prom("r11_resets", "resets(ev[24h])", _w(24) + " SELECT t, u, ty, coalesce(sum(CASE WHEN p > v THEN 1.0::DOUBLE ELSE 0 END), 0) AS v FROM w GROUP BY ALL")
_prom("r12_absent", 'absent(ev{type="none"})', _G + " SELECT t, '' AS u, 'none' AS ty, 1.0::DOUBLE AS v FROM g")
_prom("r13_holt_winters", "holt_winters(ev[24h], 0.5, 0.3)", None)
_prom("r14_math", "sqrt(abs(ev)) + floor(ev)", _I + " SELECT t, u, ty, round(sqrt(abs(v)) + floor(v), 6) AS v FROM i")
_prom("r15_trigonometry", "deg(atan(ev))", _I + " SELECT t, u, ty, round(degrees(atan(v)), 6) AS v FROM i")
_prom("r16_clamp", "clamp(ev, 10, 50)", _I + " SELECT t, u, ty, round(greatest(10, least(50, v)), 6) AS v FROM i")
_prom("r17_time", "time() - 5", _G + " SELECT t, '' AS u, '' AS ty, t / 1000.0::DOUBLE - 5 AS v FROM g")
_prom("r18_label_replace", 'label_replace(ev, "type", "x-$1", "type", "(c.*)")', _I + " SELECT t, u, CASE WHEN ty LIKE 'c%' THEN 'x-' || ty ELSE ty END AS ty, round(v, 6) AS v FROM i")
_prom("r18_label_join", 'label_join(ev, "type", "/", "user", "type")', _I + " SELECT t, u, u || '/' || ty AS ty, round(v, 6) AS v FROM i")
for _f, _s in (("sum", "sum(v)"), ("avg", "avg(v)"), ("min", "min(v)"), ("max", "max(v)"), ("count", "count(*)::DOUBLE"), ("group", "1.0::DOUBLE"), ("stddev", "stddev_pop(v)"), ("stdvar", "var_pop(v)")):
    _prom(f"r20_{_f}_by", f"{_f} by (type) (ev)", _I + f" SELECT t, '' AS u, ty, round({_s}, 6) AS v FROM i GROUP BY t, ty")
_prom("r20_sum_without", "sum without (type) (ev)", _I + " SELECT t, u, '' AS ty, round(sum(v), 6) AS v FROM i GROUP BY t, u")
_prom("r20_quantile", "quantile by (type) (0.5, ev)", _I + " SELECT t, '' AS u, ty, round(quantile_cont(v, 0.5), 6) AS v FROM i GROUP BY t, ty")
_prom("r20_topk", "topk by (type) (2, ev)", _I + " SELECT t, u, ty, round(v, 6) AS v FROM i QUALIFY row_number() OVER (PARTITION BY t, ty ORDER BY v DESC, u) <= 2")
_prom("r20_bottomk", "bottomk(3, ev)", _I + " SELECT t, u, ty, round(v, 6) AS v FROM i QUALIFY row_number() OVER (PARTITION BY t ORDER BY v, ty, u) <= 3")
_prom("r21_scalar_op", "2 * ev + 1", _I + " SELECT t, u, ty, round(2 * v + 1, 6) AS v FROM i")
_prom("r21_compare", "ev > 50", _I + " SELECT t, u, ty, round(v, 6) AS v FROM i WHERE v > 50")
_prom("r21_compare_bool", "ev >= bool 50", _I + " SELECT t, u, ty, CASE WHEN v >= 50 THEN 1.0::DOUBLE ELSE 0 END AS v FROM i")
_prom("r21_vector_op", "ev / ev", _I + " SELECT t, u, ty, CASE WHEN v = 0 THEN 'nan'::DOUBLE ELSE 1 END AS v FROM i")
_prom("r21_and_or_unless", "(ev > 50 and ev < 100) or (ev unless ev > 20)", _I + " SELECT t, u, ty, round(v, 6) AS v FROM i WHERE (v > 50 AND v < 100) OR NOT v > 20")
_prom("r21_on", "sum by (type) (ev) / on (type) count by (type) (ev)", _I + " SELECT t, '' AS u, ty, round(sum(v) / count(*), 6) AS v FROM i GROUP BY t, ty")
_prom("r22_unary", "-(ev)", _I + " SELECT t, u, ty, round(-v, 6) AS v FROM i")
_prom("r23_subquery", "max_over_time(sum by (type) (ev)[6h:1h])", _G + f", h AS (SELECT {START} - 21600000 + i * {STEP} AS t FROM range({N} + 6) r(i)), i AS (SELECT t, u, ty, arg_max(v, ts) AS v FROM h JOIN s ON s.ts <= t AND s.ts >= t - 21600000 GROUP BY ALL), a AS (SELECT t, ty, sum(v) AS v FROM i GROUP BY ALL) SELECT g.t, '' AS u, ty, round(max(a.v), 6) AS v FROM g JOIN a ON a.t <= g.t AND a.t >= g.t - 21600000 GROUP BY ALL")


@query("r19_histogram_quantile")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    bounds = F.array(F.lit("10"), F.lit("50"), F.lit("100"), F.lit("+Inf"))
    b = e.groupBy("event_type").agg(*[F.count_if(F.col("value") <= x).alias(f"b{i}") for i, x in enumerate((10.0, 50.0, 100.0, float("inf")))])
    b = b.select("event_type", F.posexplode(F.array("b0", "b1", "b2", "b3")).alias("i", "c"))
    s = b.select(F.create_map(F.lit("__name__"), F.lit("h_bucket"), F.lit("type"), F.col("event_type"), F.lit("le"), F.get(bounds, F.col("i"))).alias("labels"), F.lit(START).alias("ts"), F.col("c").cast("double").alias("value"))
    d = Engine(s, START).query("histogram_quantile(0.9, h_bucket)")
    return d.select(F.element_at("labels", "type").alias("ty"), F.round("value", 6).alias("v"))
