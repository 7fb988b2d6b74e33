"""Buckets, gap filling, series functions, joins in time and approximate aggregates over ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from polyloom.functions import timeseries as ts
from polyloom.operators.temporal import asof_join, latest_on
from polyloom.queries import query, same
from polyloom.session import load

HOUR = 3_600_000
def _v() -> Column:
    return F.col("value")



def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", ts.epoch_ms(F.col("ts")).alias("ms"), "user_id", "event_type", "value", "props")


def _w() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ms", "event_id")

_OW = "(PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id)"

DASHBOARD = f"""SELECT (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS top, round(quantile_cont(value, 0.99), 6) AS p99
 FROM events GROUP BY ALL"""


@query("g1_dashboard", DASHBOARD)
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir).groupBy(ts.time_bucket("1h", F.col("ms")).alias("bucket"), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top"), F.round(ts.percentile(_v(), 0.99), 6).alias("p99"))


@query("g1_time_bucket", f"SELECT (epoch_us(ts) // 1000) // 900000 * 900000 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(ts.time_bucket("15m", F.col("ms")).alias("bucket")).agg(F.count("*").alias("n"))


@query("g2_interval_forms", "SELECT 900000::BIGINT AS a, 7200000::BIGINT AS b, 86400000::BIGINT AS c, 300000::BIGINT AS d, 1500::BIGINT AS e, 604800000::BIGINT AS f")
def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(*[F.lit(ts.interval_ms(x)).cast("long").alias(k) for k, x in zip("abcdef", ("15m", "2 hours", "INTERVAL '1 day'", "PT5M", "1500", "1w"))])


@query(
    "g3_bucket_aggregate",
    "SELECT (epoch_us(ts) // 1000) // 86400000 * 86400000 AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS s, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, first(value ORDER BY ts, event_id) AS f, last(value ORDER BY ts, event_id) AS l FROM events GROUP BY ALL",
)
def bucket_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("ms", "event_id")
    g = events(spark, sf_dir).groupBy(ts.time_bucket("1d", F.col("ms")).alias("bucket"), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"), F.min_by("value", at).alias("f"), F.max_by("value", at).alias("l"))


_FILLED = """WITH g AS (SELECT user_id, (epoch_us(ts) // 1000) // 86400000 * 86400000 AS bucket, round(sum(value), 4) AS s FROM events GROUP BY ALL),
 b AS (SELECT user_id, min(bucket) AS lo, max(bucket) AS hi FROM g GROUP BY user_id), f AS (SELECT user_id, unnest(range(lo, hi + 1, 86400000)) AS bucket FROM b),
 j AS (SELECT f.user_id, f.bucket, g.s FROM f LEFT JOIN g USING (user_id, bucket)) """
_GAP = {
    "null": (None, _FILLED + "SELECT user_id, bucket, s FROM j"),
    "prev": ("prev", _FILLED + "SELECT user_id, bucket, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS s FROM j"),
    "constant": (0.0, _FILLED + "SELECT user_id, bucket, coalesce(s, 0) AS s FROM j"),
    "linear": (
        "linear",
        _FILLED
        + """, k AS (SELECT *, last_value(s IGNORE NULLS) OVER p AS s0, last_value(CASE WHEN s IS NOT NULL THEN bucket END IGNORE NULLS) OVER p AS t0, first_value(s IGNORE NULLS) OVER q AS s1,
 first_value(CASE WHEN s IS NOT NULL THEN bucket END IGNORE NULLS) OVER q AS t1 FROM j WINDOW p AS (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
 SELECT user_id, bucket, round(coalesce(s, s0 + (s1 - s0) * ((bucket - t0)::DOUBLE / (t1 - t0))), 6) AS s FROM k""",
    ),
}


def _gap(kind: str) -> None:
    @query(f"g4_gap_fill_{kind}", _GAP[kind][1])
    def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = events(spark, sf_dir).groupBy("user_id", ts.time_bucket("1d", F.col("ms")).alias("bucket")).agg(F.round(F.sum("value"), 4).alias("s"))
        out = ts.gap_fill(g, "bucket", "1d", ["s"], ["user_id"], _GAP[kind][0])
        return out.withColumn("s", F.round("s", 6)) if kind == "linear" else out


for _k in _GAP:
    _gap(_k)

_DT = f"(((epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER {_OW}) / 1000.0)"
_PREV = f"lag(value) OVER {_OW}"


def _series(name: str, column, sql: str) -> None:
    @query(name, f"SELECT event_id, {sql} AS x FROM events")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return events(spark, sf_dir).select("event_id", column().alias("x"))


_series("w13_ts_rate", lambda: F.round(ts.rate(_v(), F.col("ms"), _w()), 9), f"round(CASE WHEN {_PREV} IS NOT NULL AND {_DT} > 0 THEN (CASE WHEN value >= {_PREV} THEN value - {_PREV} ELSE value END) / {_DT}::DOUBLE END, 9)")
_series("w14_ts_derivative", lambda: F.round(ts.derivative(_v(), F.col("ms"), _w()), 9), f"round(CASE WHEN {_PREV} IS NOT NULL AND {_DT} > 0 THEN (value - {_PREV}) / {_DT}::DOUBLE END, 9)")
_series("w15_ts_delta", lambda: ts.delta(_v(), _w()), f"value - {_PREV}")
_series("w16_ts_moving_avg", lambda: F.round(ts.moving_avg(_v(), 4, _w()), 6), f"round(CASE WHEN count(*) OVER {_OW[:-1]} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 THEN avg(value) OVER {_OW[:-1]} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END, 6)")
_series("w19_ts_lag", lambda: F.lag("value", 2).over(_w()), f"lag(value, 2) OVER {_OW}")
_series("w20_ts_lead", lambda: F.lead("value", 1).over(_w()), f"lead(value) OVER {_OW}")
_series("w21_ts_rank", lambda: F.rank().over(Window.partitionBy("user_id").orderBy("value")), "(rank() OVER (PARTITION BY user_id ORDER BY value))::INTEGER")

_KNOWN = "(CASE WHEN event_id % 3 <> 0 THEN value END)"


def _interp(method: str, sql: str) -> None:
    @query(f"w18_ts_interpolate_{method}", f"WITH k AS (SELECT *, (epoch_us(ts) // 1000) AS ms, {_KNOWN} AS v FROM events) SELECT event_id, round({sql}, 6) AS x FROM k WINDOW p AS (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = F.when(F.col("event_id") % 3 != 0, _v())
        return events(spark, sf_dir).select("event_id", F.round(ts.interpolate(v, F.col("ms"), method, _w()), 6).alias("x"))


_B, _A = "last_value(v IGNORE NULLS) OVER p", "first_value(v IGNORE NULLS) OVER q"
_T0, _T1 = "last_value(CASE WHEN v IS NOT NULL THEN ms END IGNORE NULLS) OVER p", "first_value(CASE WHEN v IS NOT NULL THEN ms END IGNORE NULLS) OVER q"
_interp("linear", f"coalesce(v, {_B} + ({_A} - {_B}) * ((ms - {_T0})::DOUBLE / ({_T1} - {_T0})), {_B}, {_A})")
_interp("prev", f"coalesce(v, {_B}, 0)")
_interp("next", f"coalesce(v, {_A}, 0)")
_interp("zero", "coalesce(v, 0)")


@query(
    "w17_ts_ema",
    """WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS rn FROM events),
 e AS (SELECT event_id, user_id, rn, value AS ema FROM o WHERE rn = 1 UNION ALL SELECT o.event_id, o.user_id, o.rn, 0.3 * o.value + 0.7 * e.ema FROM e JOIN o ON o.user_id = e.user_id AND o.rn = e.rn + 1)
 SELECT event_id, round(ema, 6) AS ema FROM e""",
)
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "ms", "value")
    return ts.ema(e, ["user_id"], ["ms", "event_id"], "value", 0.3).select("event_id", F.round("ema", 6).alias("ema"))


@query("x5_ts_percentile", "SELECT user_id, round(quantile_cont(value, 0.9), 6) AS p FROM events GROUP BY user_id")
def ts_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(ts.percentile(_v(), 0.9), 6).alias("p"))


@query("x6_ts_stddev", "SELECT user_id, round(CASE WHEN count(value) >= 2 THEN stddev_pop(value) END, 6) AS s FROM events GROUP BY user_id")
def ts_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(ts.stddev(_v()), 6).alias("s"))


@query("x7_ts_correlate", "SELECT event_type, round(corr(value, event_id::DOUBLE), 6) AS r FROM events GROUP BY event_type")
def ts_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(ts.correlate(_v(), F.col("event_id").cast("double")), 6).alias("r"))


@query("x1_approx_count_distinct")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("n"))


@query("x2_approx_percentile")
def approx_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.percentile_approx("value", [0.5, 0.99], 10000).alias("p"))


@query("x3_approx_topk")
def approx_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.transform(F.expr("approx_top_k(user_id, 10)"), lambda x: F.struct(x["item"].alias("item"), x["count"].alias("count"), F.lit(0).alias("error")))
    return events(spark, sf_dir).groupBy("event_type").agg(F.to_json(top).alias("top"))


@query("x4_approx_count", "SELECT event_type, count(*) FILTER (user_id = 7) AS n FROM events GROUP BY event_type")
def approx_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.count_if(F.col("user_id") == 7).alias("n"))


@query("x8_sketch_merge")
def sketch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each day, merged."""
    day = events(spark, sf_dir).groupBy(ts.time_bucket("1d", F.col("ms")).alias("day"), "event_type").agg(F.hll_sketch_agg("user_id", F.lit(14)).alias("sk"))
    return day.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("sk")).alias("n"))


@query("j12_asof", "WITH l AS (SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE event_id % 2 = 0), r AS (SELECT (epoch_us(ts) // 1000) AS ms, max(event_id) AS rid FROM events WHERE event_id % 2 = 1 GROUP BY ALL) SELECT l.event_id, r.rid FROM l ASOF LEFT JOIN r ON l.ms >= r.ms")
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    left, right = e.filter("event_id % 2 = 0").select("event_id", "ms"), e.filter("event_id % 2 = 1").select(F.col("event_id").alias("rid"), "ms")
    return asof_join(left, right, "ms", tiebreak=["rid"]).select("event_id", "rid")


_KEYED = "WITH l AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE event_type <> 'purchase'), r AS (SELECT user_id, (epoch_us(ts) // 1000) AS ms, max(event_id) AS rid FROM events WHERE event_type = 'purchase' GROUP BY ALL), j AS (SELECT l.event_id, r.rid, l.ms - r.ms AS age FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ms >= r.ms) "


@query("j13_asof_keyed", _KEYED + "SELECT event_id, rid FROM j")
def asof_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    left, right = e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ms"), e.filter("event_type = 'purchase'").select(F.col("event_id").alias("rid"), "user_id", "ms")
    return asof_join(left, right, "ms", ["user_id"], tiebreak=["rid"]).select("event_id", "rid")


@query("j13_asof_tolerance", _KEYED + "SELECT event_id, CASE WHEN age <= 86400000 THEN rid END AS rid FROM j")
def asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    left, right = e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ms"), e.filter("event_type = 'purchase'").select(F.col("event_id").alias("rid"), "user_id", "ms")
    return asof_join(left, right, "ms", ["user_id"], tolerance=86_400_000, tiebreak=["rid"]).select("event_id", "rid")


@query("j14_latest_on", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) DESC, event_id) AS rn FROM events) t WHERE rn = 1")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_on(events(spark, sf_dir), ["user_id"], "ms", ["event_id"]).select("user_id", "event_id", "value")


@query("g5_downsample", f"SELECT user_id, (epoch_us(ts) // 1000) // (6 * {HOUR}) * (6 * {HOUR}) AS bucket, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", ts.time_bucket("6h", F.col("ms")).alias("bucket")).agg(F.round(F.avg("value"), 6).alias("value"))


@query("s7_time_range", "WITH b AS (SELECT max((epoch_us(ts) // 1000)) AS hi FROM events) SELECT event_id, value FROM events, b WHERE (epoch_us(ts) // 1000) > hi - 86400000")
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.join(F.broadcast(e.agg(F.max("ms").alias("hi"))), F.col("ms") > F.col("hi") - 86_400_000).select("event_id", "value")


same("g6_log_scan", "SELECT event_id, event_type FROM events WHERE event_id BETWEEN 100 AND 200")
same("g9_tag_values", "SELECT DISTINCT event_type FROM events WHERE event_type LIKE 'p%'")
same("g10_tag_filter", "SELECT count(*) AS n FROM events WHERE (event_type = 'purchase' OR event_type = 'click') AND user_id < 50")
same("g8_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
