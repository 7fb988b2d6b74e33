"""Named queries over the star schema and the event, text and vector tables, each with SQL that another engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polyloom.session import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def same(name: str, text: str, oracle: str | None = None) -> None:
    """A query that Spark SQL runs as it stands; ``oracle`` where the other engine needs another wording."""
    if name in QUERIES:
        raise ValueError(name)
    QUERIES[name] = lambda spark, sf_dir: sql(spark, sf_dir, text)
    ORACLES[name] = oracle or text


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def collect() -> tuple[dict[str, Query], dict[str, str]]:
    from polyloom.queries import dml, functions, geo, graph, promql, relational, retrieval, scalar, streaming, timeseries  # noqa: F401

    return QUERIES, ORACLES
