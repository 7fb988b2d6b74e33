"""Vector, full-text and hybrid search."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyloom.functions import vector as V
from polyloom.operators import text as T
from polyloom.queries import query
from polyloom.session import load

# the query vector is the embedding of the row with the least id: fetched as one row, as a client would pass it
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_PAIR = "FROM (SELECT e.vec_id, e.label, e.embedding::DOUBLE[] AS a, q.embedding::DOUBLE[] AS b FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) t"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"
_SQL = {
    "l2": "list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "inner_product": "-" + _DOT.format("a", "b"),
    "cosine": f"1 - {_DOT.format('a', 'b')} / (sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}))",
    "manhattan": "list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2])))",
    "chebyshev": "list_max(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2])))",
    "hamming": "list_sum(list_transform(list_zip(a, b), lambda p: CASE WHEN (p[1] > 0.5) <> (p[2] > 0.5) THEN 1.0::DOUBLE ELSE 0 END))",
    "jaccard": "1 - list_sum(list_transform(list_zip(a, b), lambda p: CASE WHEN p[1] > 0.5 AND p[2] > 0.5 THEN 1.0::DOUBLE ELSE 0 END)) / nullif(list_sum(list_transform(list_zip(a, b), lambda p: CASE WHEN p[1] > 0.5 OR p[2] > 0.5 THEN 1.0::DOUBLE ELSE 0 END)), 0)",
    "pearson": None,
}


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = load(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row.embedding] if row else []


def _metric(metric: str, sql: str | None) -> None:
    @query(f"v1_{metric}", f"SELECT vec_id, round(coalesce({sql}, 0), 6) AS d {_PAIR}" if sql else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = query_vector(spark, sf_dir)
        return load(spark, sf_dir, "embeddings").select("vec_id", F.round(V.distance(F.col("embedding"), V.literal(q), metric), 6).alias("d"))


for _m, _s in _SQL.items():
    _metric(_m, _s)


@query("v2_top_k", f"SELECT vec_id, round({_SQL['l2']}, 6) AS d {_PAIR} ORDER BY {_SQL['l2']}, vec_id LIMIT 10")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.search(load(spark, sf_dir, "embeddings"), "embedding", query_vector(spark, sf_dir), 10)
    return d.select("vec_id", F.round("distance", 6).alias("d"))


@query("v5_filtered", f"SELECT vec_id, round({_SQL['cosine']}, 6) AS d {_PAIR} WHERE label = 3 ORDER BY {_SQL['cosine']}, vec_id LIMIT 10")
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.search(load(spark, sf_dir, "embeddings"), "embedding", query_vector(spark, sf_dir), 10, "cosine", where=F.col("label") == 3)
    return d.select("vec_id", F.round("distance", 6).alias("d"))


@query(
    "v4_multi_vector",
    f"WITH t AS (SELECT vec_id, a, b {_PAIR}), x AS (SELECT vec_id, row_number() OVER (ORDER BY {_SQL['l2']}, vec_id) AS r FROM t), y AS (SELECT vec_id, row_number() OVER (ORDER BY {_SQL['manhattan']}, vec_id) AS r FROM t) SELECT vec_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM x WHERE r <= 20 UNION ALL SELECT * FROM y WHERE r <= 20) u GROUP BY vec_id",
)
def multi_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = load(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir)
    lists = [T.ranked(e.select("vec_id", V.distance(F.col("embedding"), V.literal(q), m).alias("d")), [F.col("d"), F.col("vec_id")], 20) for m in ("l2", "manhattan")]
    return T.fuse(lists, "vec_id").select("vec_id", F.round("score", 9).alias("score"))


@query("v8_ivf")
def ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ivf_search(load(spark, sf_dir, "embeddings"), "embedding", query_vector(spark, sf_dir), 10).select("vec_id", F.round("distance", 6).alias("d"))


@query("v9_sq8", "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), b AS (SELECT i, min(x) AS lo, max(x) AS hi FROM x GROUP BY i) SELECT vec_id, sum(round((x - lo) / (hi - lo) * 255))::BIGINT AS checksum FROM x JOIN b USING (i) GROUP BY vec_id")
def sq8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    b = V.bounds(e, "v", len(query_vector(spark, sf_dir)))
    codes = e.crossJoin(F.broadcast(b)).select("vec_id", V.sq8_codes(F.col("v"), F.col("lo"), F.col("hi")).alias("codes"))  # one row of bounds
    return codes.select("vec_id", F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@query("v9_binary", "SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END))::BIGINT AS d " + _PAIR)
def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.literal(query_vector(spark, sf_dir))
    words = range(math.ceil(len(query_vector(spark, sf_dir)) / 63))
    d = functools.reduce(lambda a, b: a + b, [F.bit_count(V.sign_bits(F.col("embedding"), w).bitwiseXOR(V.sign_bits(q, w))) for w in words])
    return load(spark, sf_dir, "embeddings").select("vec_id", d.cast("long").alias("d"))


@query("v10_sparse", "WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) x WHERE term IN ('the', 'of', 'and') GROUP BY ALL), w AS (SELECT * FROM (VALUES ('the', 0.5), ('of', 1.5), ('and', 2.0)) v(term, w)) SELECT doc_id, round(sum(tf * w)::DOUBLE, 6) AS score FROM t JOIN w USING (term) GROUP BY doc_id ORDER BY sum(tf * w) DESC, doc_id LIMIT 20")
def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"the": 0.5, "of": 1.5, "and": 2.0}
    d = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")).filter(F.col("term").isin(*weights))
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return d.groupBy("doc_id").agg(F.round(F.sum(w[F.col("term")]), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


_TOK = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


def _bm25(terms: list[str], mode: str) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE) + 1) * (tf{i} * 2.2::DOUBLE) / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ELSE 0 END" for i in range(len(terms)))
    need = len(terms) if mode == "and" else 1
    has = " + ".join(f"(tf{i} > 0)::INT" for i in range(len(terms)))
    return f"WITH d AS (SELECT doc_id, len(t) AS dl, {tf} FROM (SELECT doc_id, {_TOK} AS t FROM documents) x), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM d), b AS (SELECT doc_id, {part} AS score FROM d, s WHERE {has} >= {need}) "


_TERMS = ["ering", "there", "hation"]


@query("h1_bm25", _bm25(_TERMS, "or") + "SELECT doc_id, round(score, 6) AS score FROM b")
def bm25_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bm25(load(spark, sf_dir, "documents"), "doc_id", "text", T.analyze(spark, "ering there hation"), "or").select("doc_id", F.round("score", 6).alias("score"))


@query("h4_bm25_and", _bm25(["the", "of"], "and") + "SELECT doc_id, round(score, 6) AS score FROM b")
def bm25_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bm25(load(spark, sf_dir, "documents"), "doc_id", "text", ["the", "of"]).select("doc_id", F.round("score", 6).alias("score"))


@query("h9_bm25_top", _bm25(["the", "and"], "or") + "SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 20")
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.bm25(load(spark, sf_dir, "documents"), "doc_id", "text", ["the", "and"], "or")
    return d.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


_RRF = _bm25(["the", "and"], "or") + ", x AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b QUALIFY r <= 50), y AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 50) "


def _lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    docs = load(spark, sf_dir, "documents")
    return [T.ranked(T.bm25(docs, "doc_id", "text", ["the", "and"], "or"), [F.desc("score"), F.col("doc_id")], 50), T.ranked(docs.select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 50)]


@query("h2_rrf", _RRF + "SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y) u GROUP BY doc_id")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fuse(_lists(spark, sf_dir), "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query("h3_weighted_rrf", _RRF + "SELECT doc_id, round(sum(1.0::DOUBLE / (k + r)), 9) AS score FROM (SELECT *, 60 / 0.7::DOUBLE AS k FROM x UNION ALL SELECT *, 60 / 0.3::DOUBLE AS k FROM y) u GROUP BY doc_id")
def weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fuse(_lists(spark, sf_dir), "doc_id", [60 / 0.7, 60 / 0.3]).select("doc_id", F.round("score", 9).alias("score"))


@query("h5_fuzzy", f"WITH t AS (SELECT unnest({_TOK}) AS term FROM documents) SELECT term, levenshtein(term, 'ering')::INTEGER AS edits, count(*) AS count FROM t WHERE abs(length(term) - 5) <= 1 AND levenshtein(term, 'ering') <= 1 GROUP BY term")
def fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fuzzy_terms(load(spark, sf_dir, "documents"), "text", "ering")


@query("h6_ngrams", "SELECT p_partkey, (SELECT count(*) FROM (SELECT unnest(string_split(p_name, ' ')) AS w) x, range(1, 20) r(i) WHERE i <= length(w) - 2)::BIGINT AS trigrams FROM part")
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.size(T.ngram_tokens(F.col("p_name"), 3, 3)).cast("long").alias("trigrams"))


@query("h6_standard_analyzer")
def standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.size(T.standard_tokens(F.col("text"))).alias("n_terms"))


@query("h7_synonyms", _bm25(["ering", "eron", "there"], "or") + "SELECT count(*) AS n FROM b")
def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = T.analyze(spark, "ering there", synonyms={"ering": ["eron"]})
    return T.bm25(load(spark, sf_dir, "documents"), "doc_id", "text", terms, "or").agg(F.count("*").alias("n"))


@query("h8_text_match", f"SELECT doc_id, lang FROM (SELECT *, {_TOK} AS t FROM documents) x WHERE list_contains(t, 'ering')")
def text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.filter(F.array_contains(T.simple_tokens(F.col("text")), "ering")).select("doc_id", "lang")


@query("h11_highlight", "SELECT p_partkey, regexp_replace(p_name, '\\b(red|blue)\\b', '<b>\\1</b>', 'gi') AS marked FROM part")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", T.highlight(F.col("p_name"), ["red", "blue"]).alias("marked"))


@query(
    "h10_hybrid",
    _bm25(["the", "and"], "or")
    + f", x AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b QUALIFY r <= 50), v AS (SELECT vec_id AS doc_id, {_SQL['cosine']} AS d {_PAIR}), y AS (SELECT doc_id, row_number() OVER (ORDER BY d, doc_id) AS r FROM v QUALIFY r <= 50) SELECT doc_id, round(sum(1.0::DOUBLE / (k + r)), 9) AS score FROM (SELECT *, 120.0::DOUBLE AS k FROM x UNION ALL SELECT *, 120.0::DOUBLE AS k FROM y) u GROUP BY doc_id",
)
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, _ = _lists(spark, sf_dir)
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), V.distance(F.col("embedding"), V.literal(query_vector(spark, sf_dir)), "cosine").alias("d"))
    return T.fuse([text, T.ranked(e, [F.col("d"), F.col("doc_id")], 50)], "doc_id", [60 / 0.5, 60 / 0.5]).select("doc_id", F.round("score", 9).alias("score"))

