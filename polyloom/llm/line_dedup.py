"""Line dedup by a deletion-neighbourhood join (DataFrame functions only).

A line goes if an earlier line of the corpus, in (doc_id, line number) order, equals it or is within one edit of it
(insertion, deletion or substitution of a code point).  Lines are compared without surrounding white space;
those shorter than ``min_chars`` stay.

1. Lines are grouped by two 64-bit hashes; a partial minimum keeps each class's first place.
2. Halves prune: of two lines within one edit either the first half or the rest is equal, counted from the shorter
   line's length m, so a line that shares no half (for m its own length, or one less) has no partner.
3. What is left emits its deletion variants as keys: all strings with one code point removed, and the line itself.
   Keys combine hashes of (character, place) by exclusive or, so that running values give each variant's key
   in constant time; a very long line costs its length, not its square.
4. Lines that share a variant with the same place left out differ in that character alone: each is joined with the earliest of them, so
   a crowd makes no pairs.  A line is joined with those that have it for a variant.  Pairs are verified by bounded edit distance, and the later line's class is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyloom.llm.common import stored

BLANK = " \t\r\x0b\x0c"
#: Lines with partners to verify that may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, th (hash of the text), line_no, line (stripped) of every line long enough to be judged."""
    d = docs.filter("text is not null").select("doc_id", F.xxhash64("text", F.lit(3)).alias("th"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    d = d.select("doc_id", "th", "line_no", F.btrim(F.col("raw"), F.lit(BLANK)).alias("line"))
    return d.filter(F.char_length("line") >= min_chars)


def _ids(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _halves(line: Column) -> Column:
    """Four keys: for m the line's length and one less, its first m/2 code points and its last m - m/2."""
    n = F.char_length(line)
    keys = []
    for short in (0, 1):
        m = n - short
        h = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(F.lit(0), m, F.substring(line, F.lit(1), h)), F.xxhash64(F.lit(1), m, F.substring(line, n - (m - h) + 1, m - h))]
    return F.array(*keys)


def _variants(lines: DataFrame) -> DataFrame:
    """h1, key, at: the deletion variants of each line, each with the place of the character left out, and the line itself (``at`` -1)."""
    chars = lines.select("h1", F.posexplode(F.split("line", "")).alias("p", "c")).filter("c <> ''")
    chars = chars.select("h1", "p", F.xxhash64("c", "p").alias("here"), F.xxhash64("c", F.col("p") - 1).alias("moved"))
    w = Window.partitionBy("h1").orderBy("p")
    total = Window.partitionBy("h1")
    none = F.lit(0).cast("long")
    ahead = F.coalesce(F.bit_xor("here").over(w.rowsBetween(Window.unboundedPreceding, -1)), none)
    # the shifted suffix is the total less what has been seen
    moved = F.bit_xor("moved").over(total).bitwiseXOR(F.bit_xor("moved").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = chars.select("h1", (F.count("*").over(total) - 1).alias("n"), ahead.bitwiseXOR(moved).alias("s"), F.col("p").alias("at"))
    whole = chars.groupBy("h1").agg(F.count("*").alias("n"), F.bit_xor("here").alias("s"))
    whole = whole.union(lines.filter("line = ''").select("h1", none.alias("n"), none.alias("s")))
    return s.union(whole.select("h1", "n", "s", F.lit(-1).alias("at"))).select("h1", F.xxhash64("n", "s").alias("key"), "at")


def removals(docs: DataFrame, min_chars: int = 16, max_edits: int = 1) -> DataFrame:
    """doc_id, th, drop (array of line numbers) for the documents that lose lines."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    lines = _lines(docs, min_chars)
    line = F.col("line")
    place = F.struct("doc_id", "th", "line_no")
    keyed = lines.select(*_ids(line), place.alias("place"), *([_halves(line).alias("halves")] if max_edits else []))
    first = keyed.groupBy("h1", "h2").agg(F.min("place").alias("first"), *([F.any_value("halves").alias("halves")] if max_edits else []))
    first = stored(first, "lines")
    gone = _later_copies(docs, first, min_chars)
    if max_edits:
        gone = gone.union(_near(docs, first, min_chars)).distinct()
    return gone.groupBy("doc_id", "th").agg(F.collect_list("line_no").alias("drop"))


def _later_copies(docs: DataFrame, first: DataFrame, min_chars: int) -> DataFrame:
    """Places of lines that equal an earlier one."""
    at = _lines(docs, min_chars).select(*_ids(F.col("line")), F.struct("doc_id", "th", "line_no").alias("place"))
    return at.join(first.select("h1", "h2", "first"), ["h1", "h2"]).filter("place > first").select("place.*")


def _near(docs: DataFrame, first: DataFrame, min_chars: int) -> DataFrame:
    """Places of all lines of classes that have an earlier class within one edit."""
    half = first.select("h1", F.explode("halves").alias("half"))
    met = half.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("half")
    some = stored(half.join(met, "half").select("h1").distinct(), "line-candidates")
    pick = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    at = _lines(docs, min_chars).select(*_ids(F.col("line")), F.struct("doc_id", "th", "line_no").alias("place"), "line")
    text = at.join(pick, "h1", "left_semi").join(first.select("h1", "h2", "first"), ["h1", "h2"]).filter("place = first").dropDuplicates(["h1"]).select("h1", "first", "line")
    text = stored(text, "line-texts")
    variants = _variants(text.select("h1", "line"))
    met = variants.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key")
    v = stored(variants.join(met, "key").join(text.select("h1", "first"), "h1"), "line-variants")
    # lines that are equal but for one character at one place are all within one edit of the earliest of them
    left_out = v.filter("at >= 0")
    earliest = left_out.groupBy("key", "at").agg(F.min(F.struct("first", "h1")).alias("e")).select("key", "at", F.col("e.h1").alias("g1"))
    changed = left_out.join(earliest, ["key", "at"]).select("h1", "g1")
    # a line and those that are it with one character put in
    longer = v.filter("at < 0").select("key", F.col("h1").alias("g1")).join(left_out, "key").select("h1", "g1")
    pairs = changed.union(longer).filter("h1 <> g1").distinct()
    other = text.select(F.col("h1").alias("g1"), F.col("first").alias("gfirst"), F.col("line").alias("gline"))
    near = pairs.join(text, "h1").join(other, "g1").filter((F.abs(F.char_length("line") - F.char_length("gline")) <= 1) & (F.levenshtein("line", "gline", 1) >= 0))
    late = near.select(F.when(F.col("first") > F.col("gfirst"), F.col("h1")).otherwise(F.col("g1")).alias("h1")).distinct()
    few = F.broadcast(late) if late.count() <= BROADCAST_ROWS else late
    return at.select("h1", "place").join(few, "h1", "left_semi").select("place.*")


def dedup_lines(docs: DataFrame, min_chars: int = 16, max_edits: int = 1) -> DataFrame:
    """``docs`` with ``text`` less its removed lines, and n_lines, n_removed.

    Lines of fewer than ``min_chars`` characters stay (0: all are compared).  A null text stays null and has no lines; an empty text has one, which stays.  An earlier line counts even if it is
    itself removed for a still earlier one.  Rows that repeat in id and text are one document: the same lines
    go from each.  Rows with one id and different texts come in the order of a hash of their text.  Other columns pass through.
    """
    drop = removals(docs, min_chars, max_edits).select(F.col("doc_id").alias("d_"), F.col("th").alias("t_"), "drop")
    # other columns travel in a struct, so that none of their names clash
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    rest = F.struct(*[docs[c] for c in others]) if others else F.struct(F.lit(0))
    d = docs.select("doc_id", "text", F.xxhash64("text", F.lit(3)).alias("th_"), rest.alias("rest_"))
    j = d.join(drop, d.doc_id.eqNullSafe(drop.d_) & (d.th_ == drop.t_), "left").withColumn("l_", F.split("text", "\n"))
    n = F.size("l_")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("drop")), lambda i: F.get(F.col("l_"), i))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    lines = F.when(F.col("l_").isNull(), 0).otherwise(n).cast("long")
    removed = F.coalesce(F.size("drop"), F.lit(0)).cast("long")
    out = {"doc_id": F.col("doc_id"), "text": text.alias("text")} | {c: F.col("rest_").getField(c).alias(c) for c in others}
    names = [c for c in docs.columns if c in out]
    return j.select(*[out[c] for c in names], lines.alias("n_lines"), removed.alias("n_removed"))
