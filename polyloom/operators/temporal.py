"""Joins in time: as-of, keyed as-of, latest row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, time: str, keys: list[str] | None = None, tolerance: int | None = None, tiebreak: list[str] | None = None, suffix: str = "_right") -> DataFrame:
    """Each left row with the latest right row at or before it (within ``tolerance``); left rows without one stay.

    Both sides are unioned and the last right row is carried along the ordered window: one shuffle by key and no
    product of the sides.  Without keys, time itself is cut into ranges that are carried into each other, so no single
    task orders everything.  At equal times right rows come first; of right rows with one time the last by ``tiebreak`` counts.
    """
    keys = keys or []
    payload = [c for c in right.columns if c not in keys]
    r = F.struct(*[F.col(c) for c in payload])
    null = F.lit(None).cast(right.select(r.alias("r")).schema["r"].dataType)
    lcols = [c for c in left.columns if c not in keys]
    ls = F.struct(*[F.col(c) for c in lcols])
    lnull = F.lit(None).cast(left.select(ls.alias("l")).schema["l"].dataType)
    tie = F.struct(*[F.col(c) for c in tiebreak]) if tiebreak else F.struct(F.lit(0))
    tie_null = F.lit(None).cast(right.select(tie.alias("t")).schema["t"].dataType)
    a = left.select(*keys, F.col(time).alias("t_"), F.lit(1).alias("side_"), tie_null.alias("tie_"), ls.alias("l_"), null.alias("r_"))
    b = right.filter(F.col(time).isNotNull()).select(*keys, F.col(time).alias("t_"), F.lit(0).alias("side_"), tie.alias("tie_"), lnull.alias("l_"), r.alias("r_"))
    both = a.unionByName(b)
    order = ["t_", "side_", "tie_"]
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("m_", F.last("r_", ignorenulls=True).over(w))
    else:
        n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cuts = both.agg(F.percentile_approx("t_", [i / n for i in range(1, n)] or [0.5], 10000).alias("b")).first().b or []
        part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("t_"))) if cuts else F.lit(0)
        both = both.withColumn("p_", part)
        w = Window.partitionBy("p_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        # one row a range: the last right row of all ranges before it
        ends = both.filter("side_ = 0").groupBy("p_").agg(F.max_by("r_", F.struct("t_", "tie_")).alias("e_"))
        carry = both.select("p_").distinct().join(ends, "p_", "left")
        carry = carry.withColumn("c_", F.last("e_", ignorenulls=True).over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1))).select("p_", "c_")
        out = both.withColumn("m_", F.last("r_", ignorenulls=True).over(w)).join(carry, "p_").withColumn("m_", F.coalesce("m_", "c_"))
    out = out.filter("side_ = 1")
    match = F.col("m_")
    if tolerance is not None:
        match = F.when(F.col("t_") - F.col(f"m_.{time}") <= tolerance, F.col("m_"))
    out = out.withColumn("m_", match)
    taken = set(left.columns)
    return out.select(*keys, *[F.col(f"l_.{c}").alias(c) for c in lcols], *[F.col(f"m_.{c}").alias(c + suffix if c in taken else c) for c in payload])


def latest_on(df: DataFrame, keys: list[str], time: str, tiebreak: list[str] | None = None) -> DataFrame:
    """The newest row of each key (a partial maximum; no sort).  Of equal times the first by ``tiebreak``."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(time), *[-F.col(c) for c in tiebreak or []])
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r_"))
    return g.select(*keys, *[F.col(f"r_.{c}").alias(c) for c in rest])
