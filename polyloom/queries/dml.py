"""Sources, changes to tables, key-value access and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyloom.operators import dml as D
from polyloom.plans.statements import Database
from polyloom.queries import query
from polyloom.session import load
from polyloom.sources import ingest

_C = "SELECT c_custkey, c_name, c_acctbal FROM customer"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")


@query("s19_insert", f"{_C} UNION ALL SELECT -1, 'new', 1.5")
def insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([(-1, "new", 1.5)], "c_custkey long, c_name string, c_acctbal double")
    return D.insert(customers(spark, sf_dir), new)


@query("s20_insert_select", f"{_C} UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").filter("s_acctbal > 0")
    return D.insert(customers(spark, sf_dir), s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal")))


@query("s21_upsert", "SELECT coalesce(c_custkey, s_suppkey + 0) AS c_custkey, coalesce(s_name, c_name) AS c_name, c_acctbal FROM customer FULL JOIN (SELECT s_suppkey * 20 AS s_suppkey, s_name FROM supplier) s ON c_custkey = s_suppkey")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_name").alias("c_name"))
    return D.upsert(customers(spark, sf_dir), s, "c_custkey")


@query("s22_update", "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.update(customers(spark, sf_dir), {"c_acctbal": F.lit(0.0)}, F.col("c_acctbal") < 0)


@query("s23_delete", f"{_C} WHERE NOT coalesce(c_acctbal < 0, FALSE)")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.delete(customers(spark, sf_dir), F.col("c_acctbal") < 0)


@query("s8_kv_get", f"{_C} WHERE c_custkey IN (3, 5, 8)")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.KeyValue(customers(spark, sf_dir), "c_custkey").get(3, 5, 8)


@query("s9_kv_scan", "SELECT c_name AS key, c_acctbal FROM customer WHERE regexp_full_match(c_name, '.*1.') AND c_acctbal > 0")
def kv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.KeyValue(load(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), "c_acctbal")).scan("*1?", F.col("c_acctbal") > 0)


@query("s10_kv_ttl", "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 OR c_custkey * 10 > 5000")
def kv_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = customers(spark, sf_dir).withColumn("expire_at", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") * 10))
    return D.KeyValue(t, "c_custkey", 5000).scan().select("c_custkey")


@query("s15_line_protocol", "SELECT event_type AS kind, user_id, value, (epoch_us(ts) // 1000) * 1000000 AS ts_ns FROM events")
def line_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    lines = e.select(F.concat(F.lit("ev,kind="), "event_type", F.lit(" user="), F.col("user_id"), F.lit("i,value="), F.col("value"), F.lit(" "), ms * 1_000_000).alias("value"))
    return ingest.wide(ingest.parse_lines(lines), "ev", ["kind"], {"user": "long", "value": "double"}).select("kind", F.col("user").alias("user_id"), "value", "ts_ns")


@query("s25_ndjson", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation")
def ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.to_ndjson(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query("p19_metadata_filter", "SELECT p_partkey FROM part WHERE p_size >= 10 AND (p_brand = 'Brand#1' OR NOT p_type = 'SMALL')")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {"and": [{"gte": ["p_size", 10]}, {"or": [{"eq": ["p_brand", "Brand#1"]}, {"not": {"eq": ["p_type", "SMALL"]}}]}]}
    return load(spark, sf_dir, "part").filter(D.metadata_filter(tree)).select("p_partkey")


@query("p20_row_security", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 100")
def security(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.secured(load(spark, sf_dir, "customer"), [F.col("c_nationkey") == 3, F.col("c_acctbal") > 100]).select("c_custkey")


@query("d1_statements", "SELECT n_nationkey AS id, n_name || '!' AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 99, 'x'")
def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.put("nations", load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey"))
    db.execute("CREATE COLLECTION t (id INT, name TEXT)")
    db.execute("INSERT INTO t SELECT id, name FROM nations WHERE n_regionkey = 1")
    db.execute("UPDATE t SET name = concat(name, '!')")
    db.execute("INSERT INTO t VALUES (99, 'y'), (98, 'z')")
    db.execute("UPSERT INTO t { id: 99, name: 'x' }")
    db.execute("DELETE FROM t WHERE id = 98")
    return db.execute("SELECT id, name FROM t")


@query("d2_search_text", None)
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.put("docs", load(spark, sf_dir, "documents").select("doc_id", "text"))
    return db.execute("SEARCH docs USING TEXT (text, 'ering there', 10)")
