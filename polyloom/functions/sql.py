"""The engine's functions in SQL: ``register`` makes them temporary functions of a session.

Bodies are SQL expressions, which Spark inlines into the plan: they stay in generated code, push down and fold like built-in functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "time_bucket": ("width BIGINT, ms BIGINT", "BIGINT", "ms - pmod(ms, width)"),
    "unix_ms": ("t TIMESTAMP", "BIGINT", "unix_millis(t)"),
    "ts_counter_step": ("value DOUBLE, before DOUBLE", "DOUBLE", "CASE WHEN value >= before THEN value - before ELSE value END"),
    "ts_rate_step": ("value DOUBLE, before DOUBLE, seconds DOUBLE", "DOUBLE", "CASE WHEN seconds > 0 THEN (CASE WHEN value >= before THEN value - before ELSE value END) / seconds END"),
    "json_extract": ("doc STRING, path STRING", "STRING", "get_json_object(doc, path)"),
    "json_exists": ("doc STRING, path STRING", "BOOLEAN", "get_json_object(doc, path) IS NOT NULL"),
    "json_array_size": ("doc STRING", "INT", "json_array_length(doc)"),
    "vector_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "vector_inner_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vector_cosine_distance": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0)",
    ),
    "text_has": ("body STRING, term STRING", "BOOLEAN", "array_contains(split(lower(body), '[^\\\\p{L}\\\\p{N}]+'), lower(term))"),
    "rrf_part": ("place BIGINT, k DOUBLE", "DOUBLE", "1 / (k + place)"),
    "haversine_m": (
        "lng1 DOUBLE, lat1 DOUBLE, lng2 DOUBLE, lat2 DOUBLE",
        "DOUBLE",
        "2 * 6371000 * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2))))",
    ),
}


def register(spark: SparkSession) -> None:
    """Idempotent: a function of the same name in the session is replaced."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
