"""Continuous aggregates that never drop late data, change streams, geofence events, materialized views."""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyloom.functions.timeseries import interval_ms, time_bucket


@dataclass
class Measure:
    """One aggregate: sum, count, min, max, avg, first, last, count_distinct, percentile (param q) or topk (param k)."""

    fn: str
    column: str | None = None
    param: float | None = None

    @property
    def name(self) -> str:
        return f"{self.fn}_{self.column or 'all'}"


@dataclass
class ContinuousAggregate:
    """Buckets of a time column (epoch ms) and groups, kept as mergeable partial states in a Parquet folder.

    Each micro-batch is reduced to partial states and appended under its batch id (replaying a batch overwrites its own folder, so the
    sink is idempotent).  Reading merges all states, so a row that comes late still counts in its bucket.
    ``compact`` replaces the states by one a bucket.
    """

    path: str
    time: str
    bucket: str
    group_by: list[str] = field(default_factory=list)
    measures: list[Measure] = field(default_factory=list)

    def partial(self, batch: DataFrame) -> DataFrame:
        g = batch.groupBy(time_bucket(self.bucket, F.col(self.time)).alias("bucket"), *self.group_by)
        aggs: list[Column] = [F.max(self.time).alias("watermark")]
        for m in self.measures:
            c = F.col(m.column) if m.column else F.lit(1)
            at = F.struct(F.col(self.time), c)
            aggs += {
                "sum": lambda c=c, m=m: [F.sum(c).alias(m.name)],
                "count": lambda c=c, m=m: [F.count(c).alias(m.name)],
                "min": lambda c=c, m=m: [F.min(c).alias(m.name)],
                "max": lambda c=c, m=m: [F.max(c).alias(m.name)],
                "avg": lambda c=c, m=m: [F.struct(F.sum(c).alias("s"), F.count(c).alias("n")).alias(m.name)],
                "first": lambda at=at, m=m: [F.min(at).alias(m.name)],
                "last": lambda at=at, m=m: [F.max(at).alias(m.name)],
                "count_distinct": lambda c=c, m=m: [F.hll_sketch_agg(c, F.lit(14)).alias(m.name)],
                "percentile": lambda c=c, m=m: [F.expr(f"kll_sketch_agg_double(cast({m.column} as double))").alias(m.name)],
                "topk": lambda c=c, m=m: [F.expr(f"approx_top_k_accumulate({m.column})").alias(m.name)],
            }[m.fn]()
        return g.agg(*aggs)

    def _merged(self, states: DataFrame) -> DataFrame:
        aggs: list[Column] = [F.max("watermark").alias("watermark")]
        for m in self.measures:
            n = m.name
            aggs.append(
                {
                    "sum": lambda n=n: F.sum(n),
                    "count": lambda n=n: F.sum(n),
                    "min": lambda n=n: F.min(n),
                    "max": lambda n=n: F.max(n),
                    "avg": lambda n=n: F.struct(F.sum(f"{n}.s").alias("s"), F.sum(f"{n}.n").alias("n")),
                    "first": lambda n=n: F.min(n),
                    "last": lambda n=n: F.max(n),
                    "count_distinct": lambda n=n: F.hll_union_agg(n),
                    "percentile": lambda n=n: F.expr(f"kll_merge_agg_double({n})"),
                    "topk": lambda n=n: F.expr(f"approx_top_k_combine({n})"),
                }[m.fn]().alias(n)
            )
        return states.groupBy("bucket", *self.group_by).agg(*aggs)

    def _final(self, merged: DataFrame) -> DataFrame:
        out = []
        for m in self.measures:
            n = m.name
            c = F.col(n)
            if m.fn == "avg":
                c = F.col(f"{n}.s") / F.col(f"{n}.n")
            elif m.fn in ("first", "last"):
                c = F.col(n)[m.column]
            elif m.fn == "count_distinct":
                c = F.hll_sketch_estimate(n)
            elif m.fn == "percentile":
                c = F.expr(f"kll_sketch_get_quantile_double({n}, {m.param or 0.5}D)")
            elif m.fn == "topk":
                c = F.expr(f"approx_top_k_estimate({n}, {int(m.param or 10)})")
            out.append(c.alias(n))
        return merged.select("bucket", *self.group_by, *out)

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        self.partial(batch).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def compact(self, spark: SparkSession) -> None:
        """Replace the states of all batches by one a bucket.  Run it while nothing reads or writes; if it is cut off, the hidden folder holds all states."""
        old = self._batches(spark)
        merged = self._merged(self.states(spark))
        name = f"{self.path}/.compacting-{uuid.uuid4().hex}"
        merged.write.parquet(name)
        fs, path = _files(spark, self.path)
        for p in old:
            fs.delete(path(p), True)
        fs.rename(path(name), path(f"{self.path}/batch={-1 - len(old)}"))

    def _batches(self, spark: SparkSession) -> list[str]:
        fs, path = _files(spark, self.path)
        return [s.getPath().toString() for s in fs.listStatus(path(self.path)) if s.getPath().getName().startswith("batch=")]

    def start(self, stream: DataFrame, checkpoint: str, policy: str = "available"):
        """``available``: all there is, then stop; ``periodic:1 minute``; both merge on read."""
        w = stream.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if policy == "available" else w.trigger(processingTime=policy.partition(":")[2])).start()

    def states(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._final(self._merged(self.states(spark)))

    def watermark(self, spark: SparkSession) -> int | None:
        """The highest time aggregated."""
        return self.states(spark).agg(F.max("watermark")).first()[0]

    def retain(self, spark: SparkSession, keep: str) -> DataFrame:
        """Without buckets older than ``keep`` before the newest; independent of the source's own retention."""
        top = self.watermark(spark)
        return self.read(spark).filter(F.col("bucket") >= (top or 0) - interval_ms(keep))


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def tumbling(stream: DataFrame, time: str, size: str, keys: list[str], measures: list[Column], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Watermarked windows (sliding with ``slide``); later rows than ``late`` are dropped, unlike in ContinuousAggregate."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(*measures)


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], measures: list[Column], late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*measures)


def changes(stream: DataFrame, collection: str | None = None, fields: list[str] | None = None, since: int | None = None) -> DataFrame:
    """Change events (lsn, collection, op, ts_ms, fields): of a collection, from a time on, some columns; batch or stream."""
    d = stream
    if collection is not None:
        d = d.filter(F.col("collection") == collection)
    if since is not None:
        d = d.filter(F.col("ts_ms") >= since)
    return d.select(*fields) if fields else d


def on_event(stream: DataFrame, when: Column, then: Callable[[DataFrame], None], checkpoint: str):
    """Run ``then`` on each batch of rows for which ``when`` holds."""
    return stream.filter(when).writeStream.foreachBatch(lambda df, _: then(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def geofence(points: DataFrame, entity: str, time: str, inside: Column) -> DataFrame:
    """Enter and exit events; the first sighting inside enters."""
    w = Window.partitionBy(entity).orderBy(time)
    d = points.withColumn("in_", inside).withColumn("was_", F.coalesce(F.lag(inside).over(w), F.lit(False)))
    return d.filter(F.col("in_") != F.col("was_")).select(entity, time, F.when(F.col("in_"), "enter").otherwise("exit").alias("event"))


def refresh_view(source: DataFrame, path: str) -> DataFrame:
    """Full refresh: written beside the old version, which readers keep until they look again."""
    spark = source.sparkSession
    version = f"{path}/v-{uuid.uuid4().hex}"
    source.write.parquet(version)
    return spark.read.parquet(version)


def replay(spark: SparkSession, df: DataFrame, folder: str, parts: int = 3, order: str = "event_id") -> DataFrame:
    """``df`` written as files and read back as a stream, one file a batch."""
    src = f"{folder}/source"
    df.repartitionByRange(parts, order).write.mode("overwrite").parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def remove(folder: str) -> None:
    if Path(folder).is_dir():
        shutil.rmtree(folder)


