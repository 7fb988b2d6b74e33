"""Document fingerprints from closed syncmers (DataFrame functions only).

A text is cut into tokens by a rule that looks at most ``WORD_CHARS`` characters around: a run of Latin letters and digits that is no longer is
one; in longer ones a vowel takes up to two letters before it; any other character stands alone (so do those of scripts without
spaces), and white space separates.  Of the K-token windows those are chosen whose least inner token (by hash) stands
at an edge.  Whether a window is chosen depends on its own tokens only, so an edit changes only windows that it touches, in
text with or without spaces: the anchors of a common passage are common, at equal distances.

The fingerprint is a bottom sketch: of the ``SKETCH`` least distinct anchor hashes (their upper 32 bits) each with the token at which it
first stands, as hex digits.  Likeness matches by position: of the least hashes of both texts' union it is the share that both have
on a common diagonal, that is, moved by as many tokens (within ``BAND``) as some other common anchor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, SKETCH, BAND, WORD_CHARS = 3, 64, 16, 16
_HASH, _POS = 8, 6
# classes are written out: a regular expression tests single Latin-1 characters by a bit, ranges one after the other
_SPACE, _VOWELS = r" \t\n\x0B\f\r", "aeiouyAEIOUYàáâãäåæèéêëìíîïòóôõöøùúûüÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜ"
_LETTERS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_OTHERS = "".join(c for c in _LETTERS if c not in _VOWELS)
TOKEN = rf"(?<![{_LETTERS}])[{_LETTERS}]{{1,{WORD_CHARS}}}+(?![{_LETTERS}])|[{_OTHERS}]{{0,2}}[{_VOWELS}]|[^{_SPACE}]"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, even where the optimizer moves the expression (columns on columns would be written out again at each use)."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def _chosen(h: Column, k: int) -> Column:
    """(pos, hash) of the chosen windows, for token hashes ``h``; a text of fewer than ``k`` tokens has one, of all its tokens."""
    n = F.size(h)
    names = [str(j) for j in range(k)]
    windows = F.arrays_zip(F.sequence(F.lit(0), n - k).alias("pos"), *[F.slice(h, j + 1, n - k + 1).alias(str(j)) for j in range(k)])
    edge = lambda w: F.least(w[names[0]], w[names[-1]]) == F.least(*[w[j] for j in names])
    some = F.transform(F.filter(windows, edge), lambda w: F.struct(w["pos"].alias("pos"), F.xxhash64(*[w[j] for j in names]).alias("hash")))
    one = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h).alias("hash")))
    return F.when(n == 0, F.slice(one, 1, 0)).when(n < k, one).otherwise(some)


def anchors(docs: DataFrame, k: int = K) -> DataFrame:
    """``docs`` (with ``text``) and ``anchors``: the (pos, hash) of every closed syncmer, pos counted in tokens.

    A text of fewer than ``k`` tokens has one anchor, all its tokens; an empty or null text has none.
    """
    return docs.withColumn("anchors", _let(token_hashes(F.col("text")), lambda h: _chosen(h, k)))


def fingerprint(text: Column) -> Column:
    """The sketch of a text.  Texts of any length have the same kind of anchors; an empty or null one has an empty sketch."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")

    def cells(c: Column, a: Column) -> Column:
        place = lambda x: F.get(c, (F.array_position(a, x) - 1).cast("int"))["pos"].bitwiseAND(F.lit((1 << 4 * _POS) - 1))
        least = F.slice(F.sort_array(F.array_distinct(a)), 1, SKETCH)
        return F.array_join(F.transform(least, lambda x: F.concat(digits(x, _HASH), digits(place(x), _POS))), "")

    upper = lambda c: F.transform(c, lambda x: F.shiftrightunsigned(x["hash"], 32))
    return _let(token_hashes(text), lambda h: _let(_chosen(h, K), lambda c: _let(upper(c), lambda a: cells(c, a))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 of two fingerprints; two empty ones are alike (1), an empty and another are not (0)."""
    cells = lambda f: F.regexp_extract_all(f, F.lit(f".{{{_HASH + _POS}}}"), F.lit(0))
    hashes = lambda x: F.transform(x, lambda c: F.substring(c, 1, _HASH))
    places = lambda x: F.transform(x, lambda c: F.conv(F.substring(c, _HASH + 1, _POS), 16, 10).cast("long"))
    at = lambda p, h, x: F.get(p, (F.array_position(h, x) - 1).cast("int"))

    def held(off: Column, n: Column) -> Column:
        # in ascending order an offset has another near it if a neighbour is near
        near = lambda o, i: F.coalesce(F.abs(F.get(off, i) - o) <= BAND, F.lit(False))
        return F.size(F.filter(off, lambda o, i: (F.size(off) == 1) | near(o, i + 1) | F.when(i > 0, near(o, i - 1)).otherwise(False))) / F.greatest(n, F.lit(1))

    def matched(x: Column, hx: Column, y: Column, hy: Column) -> Column:
        least = F.slice(F.sort_array(F.array_union(hx, hy)), 1, SKETCH)
        both = lambda s: F.array_intersect(F.array_intersect(s, hx), hy)
        off = lambda s: _let(places(x), lambda px: _let(places(y), lambda py: F.sort_array(F.transform(both(s), lambda k: at(px, hx, k) - at(py, hy, k)))))
        return _let(least, lambda s: _let(off(s), lambda o: held(o, F.size(s))))

    lists = lambda x, y: _let(hashes(x), lambda hx: _let(hashes(y), lambda hy: matched(x, hx, y, hy)))
    return F.when((a == "") & (b == ""), 1.0).otherwise(_let(cells(a), lambda x: _let(cells(b), lambda y: lists(x, y))))


def _own_partitions(spark: SparkSession, wanted: int) -> list[int]:
    """Numbers that hash to different shuffle partitions as far as there are, so that no task gets several ranges while another has none."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(40 * n + 400).select(F.col("id").cast("int").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(n)).alias("p")).agg(F.min("x").alias("x")).collect()
    return [*sorted(r.x for r in rows), *range(40 * n + 400, 40 * n + 400 + wanted)][:wanted]


def with_next(docs: DataFrame, cols: tuple[str, ...], ranges: int) -> DataFrame:
    """Each row and, as ``next``, a struct of ``cols`` of the row that follows in descending doc_id; the first follows the last.

    Ids (integers; null, or what is no integer, comes last) are cut into about ``ranges`` ranges of about equal counts, an id that
    many rows share by a hash of their ``cols``.  Each range is a window partition that also gets the first row of the
    range below it, so no task sees more than a range and no row is sent to the driver.  Rows that share an id follow each other in the order of that hash.
    """
    spark: SparkSession = docs.sparkSession
    lowest = -(1 << 63)
    keyed = lambda d: d.withColumn("k_", F.coalesce(F.col("doc_id").try_cast("long"), F.lit(lowest))).withColumn("t_", F.xxhash64("text"))
    d = keyed(docs)
    keys = docs.select(F.coalesce(F.col("doc_id").try_cast("long"), F.lit(lowest)).alias("k_"))
    found = keys.agg(F.percentile_approx("k_", [i / ranges for i in range(1, ranges)] or [0.5], 10000).alias("b")).first().b or []
    # an id that is several bounds at once is cut by the hash
    bounds = [(k, (j + 1) * (1 << 64) // (found.count(k) + 1) - (1 << 63)) for k in sorted(set(found)) for j in range(found.count(k))]
    own = _own_partitions(spark, len(bounds) + 1)
    place = F.struct(F.col("k_").alias("k"), F.col("t_").alias("t"))
    kind = "array<struct<k:bigint,t:bigint>>"
    edges = F.from_json(F.lit("[" + ",".join(f'{{"k":{k},"t":{t}}}' for k, t in bounds) + "]"), kind)
    number = F.size(F.filter(edges, lambda b: b < place)) if bounds else F.lit(0)
    part = F.get(F.array(*map(F.lit, own)), number)
    d = d.withColumn("part_", part)
    tops = keyed(docs.select("doc_id", "text")).withColumn("part_", part).groupBy("part_").agg(F.max(place).alias("top")).collect()
    tops = sorted(((r.top.k, r.top.t), r.part_) for r in tops)
    if not tops:
        return docs.withColumn("next", F.struct(*cols))
    # the head of each range is what follows the last row of the range above; the highest follows the lowest
    to = {f"{k}:{t}": tops[(i + 1) % len(tops)][1] for i, ((k, t), _) in enumerate(tops)}
    name = F.concat_ws(":", "k_", "t_")
    target = F.element_at(F.map_from_arrays(F.array(*map(F.lit, to)), F.array(*map(F.lit, to.values()))), name)
    heads = d.filter(name.isin(list(to))).withColumn("part_", target).dropDuplicates(["k_", "t_"])
    both = d.withColumn("head_", F.lit(False)).unionByName(heads.withColumn("head_", F.lit(True)))
    w = Window.partitionBy("part_").orderBy("head_", F.col("k_").desc(), F.col("t_").desc())
    return both.withColumn("next", F.lead(F.struct(*cols)).over(w)).filter(~F.col("head_")).drop("k_", "t_", "part_", "head_")


def compare_edited(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for each row.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document in descending doc_id;
    the first follows the last, a single document follows itself.  Null texts are empty; very long ones are read whole.  Rows that share an id, or repeat, follow
    each other in the order of a hash of their text; a null id comes last.  An empty table gives no rows; other columns are ignored.
    """
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    lean = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = with_next(lean.withColumn("fingerprint", fingerprint(F.col("text"))), ("text", "fingerprint"), ranges or max(2, min(4096, int(n))))
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    d = d.withColumn("n_chars", size.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("next.text"), F.lit(1), half)))
    d = d.select("doc_id", "n_chars", "edited", "fingerprint", F.col("next.fingerprint").alias("next"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
