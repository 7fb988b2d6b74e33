"""Sessions and table access."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(app: str = "polyloom", **conf: str) -> SparkSession:
    """A session with the settings the engine assumes: UTC, adaptive execution, ANSI arithmetic."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views for the tables that a statement names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            load(spark, sf_dir, name).createOrReplaceTempView(name)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    views(spark, sf_dir, text)
    return spark.sql(text)
