"""A small statement layer: SQL as Spark runs it, and the statements Spark does not have."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyloom.functions import geo
from polyloom.functions import sql as sql_functions, vector
from polyloom.operators import dml, graph, text
from polyloom.plans import match as match_plan
from polyloom.plans.promql import Engine
from polyloom.sources import ingest

_ALGO = {
    "pagerank": graph.pagerank, "wcc": graph.components, "label_propagation": graph.label_propagation, "lcc": graph.clustering, "triangles": graph.triangles, "degree": graph.degree,
    "closeness": graph.closeness, "harmonic": graph.harmonic, "betweenness": graph.betweenness, "louvain": graph.louvain, "kcore": graph.kcore, "diameter": graph.diameter,
}


class StatementError(ValueError):
    pass


class Database:
    """Collections by name (temporary views of this session) and their rows as DataFrames."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        sql_functions.register(spark)
        spark.udf.register("st_contains", geo._binary(geo.contains_, "boolean"))
        spark.udf.register("st_intersects", geo._binary(geo.intersects_, "boolean"))
        spark.udf.register("st_distance", geo._binary(geo.distance_, "double"))

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.tables[name] = df
        df.createOrReplaceTempView(name)
        return df

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise StatementError(f"no collection {name!r}")
        return self.tables[name]

    def execute(self, statement: str) -> DataFrame:
        s = statement.strip().rstrip(";").strip()
        for pattern, run in self._ROUTES:
            if m := re.fullmatch(pattern, s, re.I | re.S):
                return run(self, *m.groups())
        return self.spark.sql(s)

    def _row(self, **cols) -> DataFrame:
        return self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])

    # -- statements ----------------------------------------------------------------------------------------------------
    def _create(self, kind: str, name: str, cols: str | None) -> DataFrame:
        names = {"INT64": "BIGINT", "FLOAT64": "DOUBLE", "TEXT": "STRING", "BYTES": "BINARY", "BOOL": "BOOLEAN", "TIMESTAMPTZ": "TIMESTAMP"}
        spec = []
        for c in re.split(r",(?![^(]*\))", cols or "id STRING"):
            n, t = c.split()[:2]
            t = re.sub(r"(?i)^VECTOR\(\d+\)$", "ARRAY<FLOAT>", t)
            spec.append(f"{n} {names.get(t.upper(), t)}")
        return self.put(name, self.spark.createDataFrame([], ", ".join(spec)))

    def _drop(self, name: str) -> DataFrame:
        self.table(name)
        del self.tables[name]
        self.spark.catalog.dropTempView(name)
        return self._row(dropped=name)

    def _show(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(self.tables)], "collection string")

    def _describe(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in self.table(name).schema], "field string, type string, nullable boolean")

    def _insert(self, upsert: str, name: str, body: str) -> DataFrame:
        fields = dict(re.findall(r"(\w+)\s*:\s*('(?:[^']|'')*'|[^,{}]+)", body))
        row = self.spark.sql("SELECT " + ", ".join(f"{v.strip()} AS {k}" for k, v in fields.items()))
        t = self.table(name)
        row = row.select(*[F.col(c).cast(t.schema[c].dataType) if c in t.columns else F.col(c) for c in row.columns])
        return self.put(name, dml.upsert(t, row, t.columns[0]) if upsert.upper() == "UPSERT" else dml.insert(t, row))

    def _insert_values(self, name: str, cols: str | None, values: str) -> DataFrame:
        t = self.table(name)
        names = [c.strip() for c in cols.split(",")] if cols else t.columns
        rows = self.spark.sql(f"SELECT * FROM VALUES {values} AS v({', '.join(names)})")
        return self.put(name, dml.insert(t, rows.select(*[F.col(c).cast(t.schema[c].dataType).alias(c) for c in names])))

    def _insert_select(self, name: str, query: str) -> DataFrame:
        return self.put(name, dml.insert(self.table(name), self.spark.sql(query)))

    def _update(self, name: str, changes: str, where: str | None) -> DataFrame:
        sets = dict(re.split(r"\s*=\s*", c.strip(), maxsplit=1) for c in re.split(r",(?![^(]*\))", changes))
        return self.put(name, dml.update(self.table(name), {k: F.expr(v) for k, v in sets.items()}, F.expr(where or "true")))

    def _delete(self, name: str, where: str | None) -> DataFrame:
        return self.put(name, dml.delete(self.table(name), F.expr(where or "true")))

    def _truncate(self, name: str) -> DataFrame:
        return self.put(name, dml.truncate(self.table(name)))

    def _copy(self, name: str, path: str, fmt: str | None) -> DataFrame:
        return self.put(name, ingest.copy_from(self.spark, path, fmt or "ndjson"))

    def _estimate(self, name: str, column: str) -> DataFrame:
        return self.table(name).agg(F.approx_count_distinct(column).alias("estimate"))

    def _changes(self, name: str, since: str, limit: str | None) -> DataFrame:
        d = self.table("changes").filter((F.col("collection") == name) & (F.col("ts_ms") >= int(since))).orderBy("lsn")
        return d.limit(int(limit)) if limit else d

    def _search_vector(self, name: str, column: str, array: str, k: str) -> DataFrame:
        t = self.table(name)
        return vector.search(t, column, [float(x) for x in array.split(",")], int(k), key=t.columns[0])

    def _search_text(self, name: str, column: str, query: str, k: str) -> DataFrame:
        t = self.table(name)
        key = t.columns[0]
        return text.bm25(t, key, column, text.analyze(self.spark, query)).orderBy(F.desc("score"), key).limit(int(k))

    def _algo(self, name: str, edges: str) -> DataFrame:
        if name.lower() not in _ALGO:
            raise StatementError(f"no algorithm {name!r}")
        return _ALGO[name.lower()](self.table(edges))

    def _value(self, v: str):
        return int(v) if re.fullmatch(r"-?\d+", v) else v.strip("'")

    def _traverse(self, edges: str, start: str, depth: str) -> DataFrame:
        return graph.bfs(self.table(edges), [self._value(start)], int(depth))

    def _neighbors(self, edges: str, of: str, direction: str | None) -> DataFrame:
        return graph.neighbors(self.table(edges), self._value(of), (direction or "out").lower())

    def _path(self, edges: str, a: str, b: str) -> DataFrame:
        return graph.shortest_path(self.table(edges), self._value(a), self._value(b))

    def _edge(self, edges: str, src: str, label: str, dst: str) -> DataFrame:
        t = self.table(edges)
        row = self.spark.range(1).select(*[F.lit(self._value(v)).cast(t.schema[c].dataType).alias(c) for c, v in (("src", src), ("label", label), ("dst", dst))])
        return self.put(edges, graph.put_edges(t, row))

    def _cut_edge(self, edges: str, src: str, label: str, dst: str) -> DataFrame:
        t = self.table(edges)
        row = self.spark.range(1).select(*[F.lit(self._value(v)).cast(t.schema[c].dataType).alias(c) for c, v in (("src", src), ("label", label), ("dst", dst))])
        return self.put(edges, graph.delete_edges(t, row))

    def _match(self, edges: str, body: str) -> DataFrame:
        return match_plan.match(self.table(edges), body, self.tables.get("nodes"))

    def _promql(self, name: str, query: str, at: str) -> DataFrame:
        return Engine(self.table(name), int(at)).query(query)

    def _view(self, name: str, query: str) -> DataFrame:
        return self.put(name, self.spark.sql(query))

    _ROUTES = (
        (r"CREATE\s+(COLLECTION|TIMESERIES|TABLE)\s+(\w+)\s*(?:\((.*)\))?", _create),
        (r"CREATE\s+MATERIALIZED\s+VIEW\s+(\w+)\s+AS\s+(.*)", _view),
        (r"DROP\s+(?:COLLECTION|TABLE)\s+(\w+)", _drop),
        (r"SHOW\s+COLLECTIONS", _show),
        (r"DESCRIBE\s+(\w+)", _describe),
        (r"(INSERT|UPSERT)\s+INTO\s+(\w+)\s*(\{.*\})", _insert),
        (r"INSERT\s+INTO\s+(\w+)\s*(?:\(([\w\s,]+)\))?\s*VALUES\s*(.*)", _insert_values),
        (r"INSERT\s+INTO\s+(\w+)\s+(SELECT\b.*)", _insert_select),
        (r"UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?", _update),
        (r"DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?", _delete),
        (r"TRUNCATE\s+(?:TABLE\s+|COLLECTION\s+)?(\w+)", _truncate),
        (r"COPY\s+(\w+)\s+FROM\s+'([^']+)'(?:\s+WITH\s*\(\s*FORMAT\s+(\w+)\s*\))?", _copy),
        (r"(?:SELECT\s+)?ESTIMATE_COUNT\s*\(\s*(\w+)\s*,\s*'?(\w+)'?\s*\)", _estimate),
        (r"SHOW\s+CHANGES\s+FOR\s+(\w+)\s+SINCE\s+(\d+)(?:\s+LIMIT\s+(\d+))?", _changes),
        (r"SEARCH\s+(\w+)\s+USING\s+VECTOR\s*\(\s*(\w+)\s*,\s*\[([^\]]*)\]\s*,\s*(\d+)\s*\)", _search_vector),
        (r"SEARCH\s+(\w+)\s+USING\s+TEXT\s*\(\s*(\w+)\s*,\s*'([^']*)'\s*,\s*(\d+)\s*\)", _search_text),
        (r"GRAPH\s+ALGO\s+(\w+)\s+ON\s+(\w+)", _algo),
        (r"GRAPH\s+TRAVERSE\s+(\w+)\s+FROM\s+(\S+)\s+DEPTH\s+(\d+)", _traverse),
        (r"GRAPH\s+NEIGHBORS\s+(\w+)\s+OF\s+(\S+)(?:\s+DIRECTION\s+(\w+))?", _neighbors),
        (r"GRAPH\s+PATH\s+(\w+)\s+FROM\s+(\S+)\s+TO\s+(\S+)", _path),
        (r"GRAPH\s+INSERT\s+EDGE\s+INTO\s+(\w+)\s+FROM\s+(\S+)\s+TYPE\s+(\S+)\s+TO\s+(\S+)", _edge),
        (r"GRAPH\s+DELETE\s+EDGE\s+FROM\s+(\w+)\s+FROM\s+(\S+)\s+TYPE\s+(\S+)\s+TO\s+(\S+)", _cut_edge),
        (r"ON\s+(\w+)\s+(MATCH\b.*)", _match),
        (r"PROMQL\s+(\w+)\s+'(.*)'\s+AT\s+(\d+)", _promql),
    )


