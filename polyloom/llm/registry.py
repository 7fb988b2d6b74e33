"""The queries of this folder by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyloom.llm.common import crc_mod, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; a fifth of the ids is held out of training."""
    from polyloom.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 5) != 0)
    model = toxicity.train(docs, labels)
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every document, links at two or fewer differing bits."""
    from polyloom.llm import simhash

    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


#: A public vocabulary; the path is a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op3_sentencepiece(spark: SparkSession, sf_dir: str, path: str = PIECES) -> DataFrame:
    """doc_id, ids, n_ids, exact (decoding gives the text again) of every document."""
    from polyloom.llm import pieces

    return pieces.encode(table(spark, sf_dir, "documents"), path).select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "exact")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; a third of the ids is held out of training."""
    from polyloom.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(crc_mod(F.col("doc_id"), 3) != 1))
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: all documents, sources weighing 1, 2, 3 in turn."""
    from polyloom.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (lines kept), n_lines, n_removed of every document."""
    from polyloom.llm import line_dedup

    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: strings of 400 bytes that also start elsewhere go."""
    from polyloom.llm import substring_exact

    return substring_exact.remove_repeats(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_passages, n_passage_words, passages, component_id: near-duplicate passages of 50 words or more."""
    from polyloom.llm import passages

    return passages.near_passages(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    from polyloom.llm import fingerprints

    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every embedding; cosine 0.98 within a label."""
    from polyloom.llm import embedding_dedup

    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * (2000 * size // (size + 100)))::BIGINT AS full_words FROM base GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM per),
l AS (SELECT *, sum(source_size) OVER () AS total,
  3 * coalesce(sum(source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM w),
lv AS (SELECT min_by((total - capped)::DOUBLE / w_rest::DOUBLE, capped) AS lam FROM l
  WHERE (total - capped)::DOUBLE / w_rest::DOUBLE * w <= 3 * source_size),
t AS (SELECT source, source_size, full_words, CASE WHEN 3 * source_size <= lam * w THEN (3 * source_size)::DOUBLE ELSE lam * w END AS target FROM w, lv),
e AS (SELECT b.doc_id, b.source, b.size, t.source_size, t.target,
  t.target / t.source_size::DOUBLE AS rate, (2000 * b.size // (b.size + 100))::DOUBLE / 1000.0::DOUBLE - t.full_words::DOUBLE / t.source_size::DOUBLE / 1000.0::DOUBLE AS lean,
  (('0x' || substr(md5(coalesce(b.doc_id::VARCHAR, '') || ':' || b.h), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CASE WHEN source_size > 0 AND target > 0
  THEN greatest(0.0::DOUBLE, least(3.0::DOUBLE, rate * (1 + least(0.5::DOUBLE, (3 - rate) / (2 * rate)) * lean))) ELSE 0 END AS expect FROM e),
p AS (SELECT *, floor(expect)::BIGINT AS whole, expect - floor(expect) AS p FROM x),
q AS (SELECT *, CASE WHEN size > 0 AND p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q,
  target - sum(whole * size) OVER (PARTITION BY source) AS quota FROM p),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM q)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN q IS NOT NULL AND ahead + size / 2.0 <= quota THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
"""


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, n - 1 AS line_no, raw, regexp_replace(raw, '^[ \t\r\v\f]+|[ \t\r\v\f]+$', '', 'g') AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
f AS (SELECT line, min((doc_id, line_no)) AS first, length(line) AS n FROM l WHERE length(line) >= 16 GROUP BY line),
h AS (SELECT line, first, n, m, (m // 2)::BIGINT AS h FROM (SELECT *, unnest([n, n - 1]) AS m FROM f)),
p AS (SELECT a.line, a.first, b.line AS other, b.first AS other_first FROM h a JOIN h b ON a.m = b.m AND left(a.line, a.h) = left(b.line, b.h) AND a.line < b.line
  UNION SELECT a.line, a.first, b.line, b.first FROM h a JOIN h b ON a.m = b.m AND right(a.line, a.m - a.h) = right(b.line, b.m - b.h) AND a.line < b.line),
near AS (SELECT DISTINCT CASE WHEN first > other_first THEN line ELSE other END AS line FROM p WHERE abs(length(line) - length(other)) <= 1 AND levenshtein(line, other) <= 1),
j AS (SELECT l.*, coalesce(length(l.line) >= 16 AND ((l.doc_id, l.line_no) > f.first OR near.line IS NOT NULL), FALSE) AS gone
  FROM l LEFT JOIN f ON l.line = f.line LEFT JOIN near ON l.line = near.line)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM j GROUP BY doc_id) g ON d.doc_id = g.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_simhash": op2_simhash,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_language_id": op4_language_id,
        "op5_mixing": op5_mixing,
        "op6_line_dedup": op6_line_dedup,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_fingerprints": op9_fingerprints,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": OP5_SQL, "op6_line_dedup": OP6_SQL}
