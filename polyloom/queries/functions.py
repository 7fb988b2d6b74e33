"""The engine's functions, called from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyloom.functions.sql import register
from polyloom.queries import query
from polyloom.session import sql


def _sql(name: str, text: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark)
        return sql(spark, sf_dir, text)


_sql("g1_sql_time_bucket", "SELECT time_bucket(900000, unix_ms(ts)) AS bucket, count(*) AS n FROM events GROUP BY 1", "SELECT (epoch_us(ts) // 1000) // 900000 * 900000 AS bucket, count(*) AS n FROM events GROUP BY ALL")
_sql(
    "w13_sql_rate",
    "SELECT event_id, round(ts_rate_step(value, lag(value) OVER w, (unix_ms(ts) - lag(unix_ms(ts)) OVER w) / 1000D), 9) AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY unix_ms(ts), event_id)",
    "SELECT event_id, round(CASE WHEN d > 0 THEN (CASE WHEN value >= p THEN value - p ELSE value END) / d END, 9) AS x FROM (SELECT *, lag(value) OVER w AS p, ((epoch_us(ts) // 1000) - lag(epoch_us(ts) // 1000) OVER w) / 1000.0::DOUBLE AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id)) e",
)
_sql("f34_sql_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.none') AS has FROM events", "SELECT event_id, (props->>'$.k')::BIGINT AS k, json_exists(props, '$.none') AS has FROM events")
_sql(
    "v3_sql_distance",
    "SELECT a.vec_id, round(vector_distance(CAST(a.embedding AS ARRAY<DOUBLE>), CAST(b.embedding AS ARRAY<DOUBLE>)), 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1",
    "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1",
)
_sql("h8_sql_text", "SELECT doc_id FROM documents WHERE text_has(text, 'Ering')", "SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'ering')")
