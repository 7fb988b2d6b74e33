"""Full-text search: analysis, BM25, fuzzy terms, rank fusion, highlighting."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STOP = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)
_STEMS = ((r"(ss)es$", "$1"), (r"ies$", "i"), (r"([^s])s$", "$1"), (r"([aeiouy].*?)(?:ed|ing)$", "$1"), (r"([bdfgmnprt])\1$", "$1"))
K1, B = 1.2, 0.75


def _unmarked(text: str) -> str:
    parts = unicodedata.normalize("NFD", text)
    marks = {ord(c): None for c in set(parts) if unicodedata.combining(c)}
    return (parts.translate(marks) if marks else parts).lower()


def fold(text: Column) -> Column:
    """Lower case without combining marks (letters keep together)."""

    @F.pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else _unmarked(t))

    # a Python function gets all rows whatever the branch, so ASCII texts are null to it
    ascii_ = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_, F.lower(text)).otherwise(strip(F.when(~ascii_, text)))


def simple_tokens(text: Column) -> Column:
    """Lower case, split on anything but letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def stem(token: Column) -> Column:
    """A light English stemmer: plural and participle endings."""
    return _stems(F.array(token))[0]


def _stems(tokens: Column) -> Column:
    """One pass over the array a step: nested in one expression, each step would evaluate the one before it three times."""

    def step(pattern: str, to: str):
        return lambda w: F.when(F.char_length(w) > 3, F.regexp_replace(w, pattern, to)).otherwise(w)

    for pattern, to in _STEMS:
        tokens = F.transform(tokens, step(pattern, to))
    return tokens


def standard_tokens(text: Column) -> Column:
    """Folded, split on what is no letter, digit, - or _, without short tokens and stop words, stemmed."""
    words = F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_-]+")
    kept = F.filter(words, lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP))
    return _stems(kept)


def keyword_tokens(text: Column) -> Column:
    return F.array(text)


def ngram_tokens(text: Column, lo: int, hi: int, edge: bool = False) -> Column:
    """Character n-grams of each token, or only those at its start."""

    def grams(w: Column) -> Column:
        def of(n: int) -> Column:
            last = F.lit(1) if edge else F.char_length(w) - n + 1
            return F.when(F.char_length(w) >= n, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

        return F.concat(*[of(n) for n in range(lo, hi + 1)])

    return F.flatten(F.transform(simple_tokens(text), grams))


ANALYZERS = {"simple": simple_tokens, "standard": standard_tokens, "keyword": keyword_tokens}


def postings(docs: DataFrame, key: str, text: str, analyzer: str = "simple") -> DataFrame:
    """(key, term, tf, dl): one row a document and term."""
    t = docs.select(key, ANALYZERS[analyzer](F.col(text)).alias("terms_"))
    t = t.select(key, F.size("terms_").alias("dl"), F.explode("terms_").alias("term"))
    return t.groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


def analyze(spark, query: str, analyzer: str = "simple", synonyms: dict[str, list[str]] | None = None) -> list[str]:
    terms = spark.range(1).select(ANALYZERS[analyzer](F.lit(query)).alias("t")).first().t
    out = list(dict.fromkeys(terms))
    for t in list(out):
        out += [s for s in (synonyms or {}).get(t, []) if s not in out]
    return out


def _occurrences(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def _quoted(term: str) -> str:
    """A term as a literal part of a regular expression."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], mode: str = "and", analyzer: str = "simple") -> DataFrame:
    """key, score of the documents with all (mode ``or``: any) of the terms.

    Documents without any term drop out before anything is grouped: each keeps its length and the counts of the query's terms,
    so the only exchange is that of the totals (one row a task).
    """
    if analyzer == "simple":
        # runs of letters and digits are counted where they stand: no list of tokens is made
        low = F.lower(F.coalesce(F.col(text), F.lit("")))
        tf = [F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}]){_quoted(t)}(?![\p{{L}}\p{{N}}])")).alias(f"tf{i}") for i, t in enumerate(terms)]
        d = docs.select(key, F.regexp_count(low, F.lit(r"[\p{L}\p{N}]+")).alias("dl"), *tf)
    else:
        tokens = docs.select(key, ANALYZERS[analyzer](F.col(text)).alias("t_"))
        d = tokens.select(key, F.size("t_").alias("dl"), *[_occurrences("t_", t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = d.agg(F.count("*").alias("n_"), F.avg("dl").alias("avgdl_"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    d = d.crossJoin(F.broadcast(stats))  # one row of totals
    score, found = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        t, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln((F.col("n_") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(t > 0, idf * (t * (K1 + 1)) / (t + K1 * (1 - B + B * F.col("dl") / F.col("avgdl_")))).otherwise(0.0)
        found = found + (t > 0).cast("int")
    need = len(terms) if mode == "and" else 1
    return d.filter(found >= need).select(key, score.alias("score"))


def fuzzy_terms(docs: DataFrame, text: str, term: str, analyzer: str = "simple") -> DataFrame:
    """(term, edits): indexed terms within the bound for the term's length (0 up to 3 letters, 1 up to 6, else 2), nearest first."""
    bound = 0 if len(term) <= 3 else 1 if len(term) <= 6 else 2
    words = docs.select(F.explode(ANALYZERS[analyzer](F.col(text))).alias("term")).filter(F.abs(F.char_length("term") - len(term)) <= bound).groupBy("term").count()
    d = F.levenshtein("term", F.lit(term), bound)
    return words.withColumn("edits", d).filter("edits >= 0").select("term", "edits", "count")


def fuse(lists: list[DataFrame], key: str, ks: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank from 1): sum of 1 / (k + rank)."""
    ks = ks or [60.0] * len(lists)
    parts = [d.select(key, (1.0 / (F.lit(float(k)) + F.col("rank"))).alias("part")) for d, k in zip(lists, ks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("part").alias("score"))


def ranked(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows with their rank; the window sees those k rows only."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def highlight(text: Column, terms: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    pattern = "(?iu)(?<![\\p{L}\\p{N}])(" + "|".join(map(_quoted, terms)) + ")(?![\\p{L}\\p{N}])"
    return F.regexp_replace(text, pattern, f"{before}$1{after}")
