"""From raw documents to token ids: drop toxic documents, repeated lines and near copies, mix the sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyloom.llm import line_dedup, mixing, near_copies, pieces, toxicity
from polyloom.llm.common import shared_folder, table
from polyloom.llm.registry import PIECES

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose compression distance marks them as toxic (learned from all of ``labels``)."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).filter("score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that (nearly) repeat an earlier one; documents of which nothing is left go."""
    d = line_dedup.dedup_lines(docs.select(*COLUMNS))
    d = d.filter((F.col("n_removed") == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return d.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by pairs whose five-word shingles have a Jaccard index of at least 0.8: SimHash, then a prefix filter for what it can't find."""
    return near_copies.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (a row a copy)."""
    return mixing.take(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_ids, exact."""
    out = pieces.encode(docs, PIECES, id_cols=("doc_id", "source"))
    return out.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_ids"), "exact")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece encoding", encode),
]

#: SQL can express neither the compression nor the near copies; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
