"""Line protocol, COPY FROM, and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# a character of a name: escaped, or not one of the separators
_NAME = r"(?:\\.|[^,= \\])+"
_HEAD = rf"^((?:\\.|[^, \\])+)((?:,{_NAME}={_NAME})*) (.+?)(?: (-?\d+))?$"


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([,= ])", "$1")


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """measurement, tags (map, by name), fields (map of struct kind/text), ts_ns, error; blank lines and comments are left out.

    Fields are float, int (``1i``), uint (``1u``), str or bool; a line that cannot be read has null columns and an error.
    All of it is column expressions, so parsing runs where the text is read.
    """
    raw = F.trim(F.col(column))
    d = lines.filter((raw != "") & ~raw.startswith("#")).withColumn("line_", raw)
    part = lambda i: F.regexp_extract("line_", _HEAD, i)
    ok = F.col("line_").rlike(_HEAD)
    tags = F.transform(F.regexp_extract_all(part(2), F.lit(rf",({_NAME}={_NAME})"), F.lit(1)), lambda t: t)
    pair = lambda t: F.struct(_unescape(F.regexp_extract(t, rf"^({_NAME})=", 1)).alias("k"), _unescape(F.regexp_extract(t, rf"^{_NAME}=(.*)$", 1)).alias("v"))
    fields = F.regexp_extract_all(part(3), F.lit(rf"({_NAME}=(?:\"(?:\\.|[^\"\\])*\"|[^,]+))"), F.lit(1))

    def field(t: Column) -> Column:
        v = F.regexp_extract(t, rf"^{_NAME}=(?s)(.*)$", 1)
        kind = (
            F.when(v.rlike('^".*"$'), "str")
            .when(v.rlike(r"^-?\d+i$"), "int")
            .when(v.rlike(r"^\d+u$"), "uint")
            .when(F.lower(v).isin("t", "true", "f", "false"), "bool")
            .when(v.try_cast("double").isNotNull(), "float")
            .otherwise("bad")
        )
        text = F.when(kind == "str", F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r'\\(["\\])', "$1")).when(kind.isin("int", "uint"), F.regexp_replace(v, "[iu]$", "")).otherwise(v)
        return F.struct(_unescape(F.regexp_extract(t, rf"^({_NAME})=", 1)).alias("k"), F.struct(kind.alias("kind"), text.alias("text")).alias("v"))

    d = d.withColumn("t_", F.when(ok, F.array_sort(F.transform(tags, pair)))).withColumn("f_", F.when(ok, F.transform(fields, field)))
    bad = F.when(~ok, "not a line").when(F.size("f_") == 0, "no fields").when(F.exists("f_", lambda f: f["v"]["kind"] == "bad"), "bad field")
    good = bad.isNull()
    return d.select(
        F.when(good, _unescape(part(1))).alias("measurement"),
        F.when(good, F.map_from_entries("t_")).alias("tags"),
        F.when(good, F.map_from_entries("f_")).alias("fields"),
        F.when(good, F.nullif(part(4), F.lit("")).try_cast("long")).alias("ts_ns"),
        bad.alias("error"),
    )


def wide(parsed: DataFrame, measurement: str, tags: list[str], fields: dict[str, str]) -> DataFrame:
    """Rows of one measurement with a column a tag and a field (name: Spark type)."""
    d = parsed.filter(F.col("error").isNull() & (F.col("measurement") == measurement))
    return d.select("ts_ns", *[F.try_element_at("tags", F.lit(t)).alias(t) for t in tags], *[F.try_element_at("fields", F.lit(f))["text"].try_cast(k).alias(f) for f, k in fields.items()])


def copy_from(spark: SparkSession, path: str, fmt: str = "ndjson", schema: str | None = None) -> DataFrame:
    """``COPY ... FROM``: ndjson (default), json (one array), csv with a header, parquet."""
    r = spark.read if schema is None else spark.read.schema(schema)
    f = fmt.lower()
    if f in ("ndjson", "jsonl"):
        return r.json(path)
    if f == "json":
        return r.option("multiLine", True).json(path)
    if f == "csv":
        return r.option("header", True).option("inferSchema", schema is None).csv(path)
    if f == "parquet":
        return r.parquet(path)
    raise ValueError(f"unknown format {fmt!r}")


def to_ndjson(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def to_arrow(df: DataFrame):
    return df.toArrow()
