"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Targets: the total size is shared by the sources' weights; a source's target
stops at ``cap`` times its size and the excess goes to the others by weight.
That is water filling: sources sorted by cap/weight, a prefix of them is at
the cap, and the rest share what is left, so two running sums over the (one row
a source) table give the level without a loop.

Sampling: a document expects ``target / source_size`` copies, more if it is long and fewer if it is short: fragments
of a few words are the least wanted part of any source.  The lean is balanced in each source, so that expected words
add up to the target, and never lifts a document over the cap (or, if a ``tilt`` column is named, expected copies are in proportion to it).
The whole part of the expected number is taken for
certain; the remaining fraction is its inclusion probability p, and documents
are ranked by (u/(1-u)) / (p/(1-p)), u being a hash of the id and text.  The first
documents in that order are taken until the source's remaining words are used
up.  The order is cut without a sort of the whole source: ranks fall in
bins of some thousand documents, bins are summed and accumulated, and only the one
bin in which the quota ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyloom.llm.common import WORD, stored


def word_count(text: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) -> with n_docs kept, ``target``: the share of each source.

    One row a source, so the two unpartitioned windows see sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    level = Window.orderBy((F.lit(cap) * F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    onward = level.rowsBetween(0, Window.unboundedFollowing)
    whole = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        (F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("capped"),
        F.sum("w").over(onward).alias("w_rest"),
    ).withColumn("lambda", (F.col("total") - F.col("capped")) / F.col("w_rest"))
    # the first source in this order that the level does not push over its cap fixes the level for it and all after it
    fits = F.when(F.col("lambda") * F.col("w") <= F.lit(cap) * F.col("source_size"), F.struct("capped", "w_rest", F.col("lambda").alias("l")))
    s = s.withColumn("level", F.min(fits).over(whole))
    return s.withColumn(
        "target",
        F.when(F.col("level").isNull() | (F.lit(cap) * F.col("source_size") <= F.col("level.l") * F.col("w")), (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(
            F.col("level.l") * F.col("w")
        ),
    ).drop("total", "capped", "w_rest", "lambda", "level", "w")


def unit(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the md5 of the id and the text: the same in every run and in any SQL engine; rows without an id differ by their texts."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def fullness(size: Column) -> Column:
    """0 to 1999, growing with the number of words; half way at 100."""
    return F.floor(F.lit(2000) * size / (size + 100)).cast("long")


def mix(docs: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3), tilt: str | None = None, bin_docs: int = 4096, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_cols``, source, size, source_size, target, copies, taken for every row of ``docs``.

    Defined results: null texts have size 0 and nothing is taken of them; a null source is a
    source of its own, last in order; rows that repeat are documents of their own (those with the
    same id share a rank, and which of them falls on the edge of the quota is fixed by size);
    an empty table gives no rows; other columns are ignored.  ``tilt``: a positive column that
    makes some documents likelier; null counts as 1.
    """
    lean = docs.select(*id_cols, "source", word_count(F.col("text")).alias("size"), (F.coalesce(F.col(tilt).cast("double"), F.lit(1.0)) if tilt else F.lit(1.0)).alias("tilt"), unit(F.col("doc_id"), F.col("text")).alias("u"))
    base = stored(lean, "mix")
    per = base.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("n_docs"),
        F.sum(F.col("size") * F.col("tilt")).alias("mass"),
        F.sum(F.col("size") * fullness(F.col("size"))).alias("full"),
    )
    t = targets(per, cap, weights).select(F.col("source").alias("s_"), "source_size", "target", "n_docs", "mass", "full")
    d = base.join(t, base.source.eqNullSafe(t.s_)).drop("s_")
    # copies expected, at most cap; the whole part is certain
    if tilt:
        expect = F.when(F.col("mass") > 0, F.least(F.lit(float(cap)), F.col("target") * F.col("tilt") / F.col("mass"))).otherwise(0.0)
    else:
        rate = F.col("target") / F.col("source_size")
        lean = F.least(F.lit(0.5), (cap - rate) / (2 * rate)) * (fullness(F.col("size")) / 1000 - F.col("full") / F.col("source_size") / 1000)
        expect = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), rate * (1 + lean)))).otherwise(0.0)
    d = d.withColumn("expect", expect).withColumn("whole", F.floor("expect").cast("long")).withColumn("p", F.col("expect") - F.col("whole"))
    u = F.col("u")
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    d = d.withColumn("q", F.when((F.col("size") > 0) & (F.col("p") > 0), odds))
    bins = F.ceil(F.col("n_docs") / bin_docs)
    d = d.withColumn("bin", F.when(F.col("q").isNotNull(), F.least(bins - 1, F.floor(F.col("q") / (1 + F.col("q")) * bins))).cast("long"))
    # words of each bin, those before it, and the quota left after the whole copies
    certain = d.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    b = d.filter("q is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    b = b.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    b = b.select(F.col("source").alias("bs_"), F.col("bin").alias("bb_"), "before", "words")
    certain = certain.select(F.col("source").alias("cs_"), "certain")
    b = b.join(certain, b.bs_.eqNullSafe(certain.cs_)).drop("cs_")
    d = d.join(b, d.source.eqNullSafe(b.bs_) & (d.bin == b.bb_), "left").drop("bs_", "bb_")
    quota = F.col("target") - F.col("certain")
    edge = (F.col("before") < quota) & (F.col("before") + F.col("words") > quota)
    inside = F.col("before") + F.col("words") <= quota
    d = d.withColumn("quota", quota).withColumn("edge", F.coalesce(edge, F.lit(False))).withColumn("inside", F.coalesce(inside, F.lit(False)))
    last = Window.partitionBy("source", "bin").orderBy("q", "doc_id", "size", *id_cols[1:]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(last), F.lit(0))
    on_edge = d.filter("edge").withColumn("ahead", ahead)
    # taken while that brings the sum nearer to the quota: the document across the edge counts if over half of it fits
    on_edge = on_edge.withColumn("extra", (F.col("ahead") + F.col("size") / 2 <= F.col("quota")).cast("long")).drop("ahead")
    rest = d.filter(~F.col("edge")).withColumn("extra", F.col("inside").cast("long"))
    out = rest.unionByName(on_edge)
    return out.select(
        *id_cols, "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"), ((F.col("whole") + F.col("extra")) * F.col("size")).alias("taken")
    )


def take(docs: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Of rows that repeat in id, source and text, and are therefore equal to the mix, each gets its share of their copies, the first ones one more.
    Null texts, and documents without a word, are not taken; an empty table gives no rows; other columns pass through, whatever their names.
    """
    th = F.xxhash64("text", F.lit(3))
    m = mix(docs.select("doc_id", "source", "text", th.alias("th_")), cap, weights, id_cols=("doc_id", "th_"))
    m = m.groupBy("doc_id", "source", "th_").agg(F.sum("copies").alias("copies_"), F.count("*").alias("n_")).filter("copies_ > 0")
    m = m.select(F.col("doc_id").alias("k_"), F.col("source").alias("s_"), F.col("th_").alias("t_"), "copies_", "n_")
    d = docs.select(F.struct(*docs.columns).alias("row_"), F.col("doc_id").alias("d_"), F.col("source").alias("o_"), th.alias("h_"))
    join = lambda m: d.join(m, d.d_.eqNullSafe(m.k_) & d.o_.eqNullSafe(m.s_) & (d.h_ == m.t_))
    own = join(m.filter("n_ = 1")).select("row_", F.col("copies_").alias("each_"))
    w = Window.partitionBy("k_", "s_", "t_").orderBy(F.lit(0))
    shared = join(m.filter("n_ > 1")).select("row_", F.floor((F.col("copies_") + F.col("n_") - F.row_number().over(w)) / F.col("n_")).alias("each_"))
    both = own.union(shared).filter("each_ > 0")
    return both.select("row_", F.explode(F.sequence(F.lit(1), F.col("each_").cast("int")))).select("row_.*")
