"""Timeseries functions as window expressions, buckets and gap filling.

Every function takes the series' window (``Window.partitionBy(series).orderBy(time)``) where it needs one, so the plan is
one shuffle by series, whatever number of functions is evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window
from pyspark.sql import functions as F

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
_LONG = {
    "millisecond": "ms", "milliseconds": "ms", "msec": "ms", "sec": "s", "second": "s", "seconds": "s", "min": "m", "minute": "m", "minutes": "m",
    "hour": "h", "hours": "h", "day": "d", "days": "d", "week": "w", "weeks": "w",
}


def interval_ms(text: str | int) -> int:
    """Milliseconds of ``15m``, ``2 hours``, ``INTERVAL '1 day'``, ``PT5M``, ``P1DT2H`` or a bare number of milliseconds."""
    s = str(text).strip()
    if m := re.fullmatch(r"(?i)interval\s+'([^']+)'", s):
        s = m[1].strip()
    if re.fullmatch(r"\d+", s):
        return _positive(int(s), text)
    if m := re.fullmatch(r"(?i)P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", s):
        parts = zip(m.groups(), ("w", "d", "h", "m", "s"))
        return _positive(sum(int(v) * _UNITS[u] for v, u in parts if v), text)
    total, at = 0, 0
    for m in re.finditer(r"\s*(\d+)\s*([a-zA-Z]+)\s*", s):
        unit = m[2].lower()
        unit = _LONG.get(unit, unit)
        if m.start() != at or unit not in _UNITS:
            raise ValueError(f"not an interval: {text!r}")
        total += int(m[1]) * _UNITS[unit]
        at = m.end()
    if at != len(s) or not s:
        raise ValueError(f"not an interval: {text!r}")
    return _positive(total, text)


def _positive(ms: int, text: str | int) -> int:
    if ms <= 0:
        raise ValueError(f"an interval must be positive: {text!r}")
    return ms


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def time_bucket(interval: str | int, ms: Column) -> Column:
    """Start of the bucket (epoch milliseconds); integer division truncates toward zero."""
    i = interval_ms(interval)
    return ms - ms % i


def rate(v: Column, ms: Column, w: WindowSpec) -> Column:
    """Increase a second of a counter; a fall is a reset, from which the new value counts.  Null for the first row and where time stands."""
    prev, dt = F.lag(v).over(w), (ms - F.lag(ms).over(w)) / F.lit(1000.0)
    inc = F.when(v >= prev, v - prev).otherwise(v)
    return F.when(prev.isNotNull() & (dt > 0), inc / dt)


def derivative(v: Column, ms: Column, w: WindowSpec) -> Column:
    prev, dt = F.lag(v).over(w), (ms - F.lag(ms).over(w)) / F.lit(1000.0)
    return F.when(prev.isNotNull() & (dt > 0), (v - prev) / dt)


def delta(v: Column, w: WindowSpec) -> Column:
    return v - F.lag(v).over(w)


def moving_avg(v: Column, n: int, w: WindowSpec) -> Column:
    """Mean of the last ``n`` samples, null until there are as many; all null for n = 0."""
    if n <= 0:
        return F.lit(None).cast("double")
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.lit(1)).over(f) == n, F.avg(v).over(f))


def interpolate(v: Column, ms: Column, method: str, w: WindowSpec) -> Column:
    """Fill nulls: linear (flat at the ends), prev/locf, next/nocb, zero.  prev and next give 0 where nothing is known."""
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    before, after = F.last(v, ignorenulls=True).over(back), F.first(v, ignorenulls=True).over(ahead)
    if method == "zero":
        return F.coalesce(v, F.lit(0.0))
    if method in ("prev", "locf"):
        return F.coalesce(v, before, F.lit(0.0))
    if method in ("next", "nocb"):
        return F.coalesce(v, after, F.lit(0.0))
    if method != "linear":
        raise ValueError(f"unknown method {method!r}")
    at = F.when(v.isNotNull(), ms)
    t0, t1 = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead)
    mid = before + (after - before) * ((ms - t0) / (t1 - t0))
    return F.coalesce(v, mid, before, after)


def percentile(v: Column, p: float) -> Column:
    """Exact, linear between ranks; NaN left out."""
    return F.percentile(F.when(~F.isnan(v), v), F.lit(min(1.0, max(0.0, p))))


def stddev(v: Column) -> Column:
    """Of the population; null below two values."""
    x = F.when(~F.isnan(v), v)
    return F.when(F.count(x) >= 2, F.stddev_pop(x))


def correlate(x: Column, y: Column) -> Column:
    """Pearson's r; null below two pairs or without variance."""
    r = F.corr(x, y)
    return F.when(F.isnan(r), None).otherwise(r)


def ema(df: DataFrame, series: list[str], order: list[str], value: str, alpha: float, out: str = "ema") -> DataFrame:
    """Exponential average: e0 = v0, ei = alpha vi + (1 - alpha) e(i-1), rows of a series in ``order``.

    A fold over ordered rows, so Arrow batches of each series go through pandas' recursive filter; the carried state is
    one number a series, and a series may be longer than a batch.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = df.repartition(int(n), *series).sortWithinPartitions(*series, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf[series].apply(tuple, axis=1)
            parts = []
            for k, g in pdf.groupby((ids != ids.shift()).cumsum(), sort=False):
                here = ids.loc[g.index[0]]
                v = g[value].astype(float)
                if here == key:
                    e = pd.concat([pd.Series([state]), v]).ewm(alpha=alpha, adjust=False).mean().iloc[1:]
                else:
                    e = v.ewm(alpha=alpha, adjust=False).mean()
                key, state = here, float(e.iloc[-1])
                parts.append(g.assign(**{out: e.to_numpy()}))
            yield pd.concat(parts)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return placed.mapInPandas(run, f"{schema}, `{out}` double")


def gap_fill(df: DataFrame, bucket: str, interval: str | int, values: list[str], series: list[str] | None = None, fill: str | float | None = None) -> DataFrame:
    """Rows for the buckets missing between a series' first and last; values null, ``prev``, ``linear`` or a constant."""
    i, keys = interval_ms(interval), series or []
    span = df.groupBy(*keys).agg(F.min(bucket).alias("lo_"), F.max(bucket).alias("hi_"))
    grid = span.select(*keys, F.explode(F.sequence("lo_", "hi_", F.lit(i).cast("long"))).alias(bucket))
    full = grid.join(df, [*keys, bucket], "left")
    w = Window.partitionBy(*keys).orderBy(bucket) if keys else Window.partitionBy(F.lit(0)).orderBy(bucket)
    for c in values:
        v = F.col(c)
        if fill == "prev":
            full = full.withColumn(c, F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        elif fill == "linear":
            full = full.withColumn(c, interpolate(v, F.col(bucket), "linear", w))
        elif fill is not None:
            full = full.withColumn(c, F.coalesce(v, F.lit(float(fill))))
    return full
