"""SimHash fingerprints and the groups they form within a few differing bits.

Search by deletion variants: a fingerprint is cut into two halves, so that of two fingerprints that differ in
at most three bits one half differs in at most one.  Each half is indexed 32 times, each time with one bit
struck out; equal keys are candidates, and whole fingerprints are compared.

A key that more than ``HOT`` distinct fingerprints share (a crowd of near copies) is not paired up.  Its members go
through midpoints instead: each names itself and its 64 neighbours at one bit.  Two fingerprints
that differ in at most two bits name a common midpoint, and any two that name one differ in
at most two bits, so a star around the least of them links exactly what has to be linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyloom.llm.common import SPACE, connected_components, cut, stored

HOT = 16
BROADCAST_ROWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = 1 << 17


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` does that for text without other letters, and faster)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def bit_majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last column: the hashes of a text's shingles; becomes the 64 bits that over half of them set."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        at = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy(zero_copy_only=False)
        n = np.diff(at)
        ones = np.zeros((len(n), 64), np.int64)
        lo = 0
        while lo < len(n):
            # as many texts as fit a block; a longer text is summed in pieces
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + _BLOCK, side="right")) - 1)
            if hi == lo + 1:
                for s in range(int(at[lo]), int(at[hi]), _BLOCK):
                    ones[lo] += np.unpackbits(flat[s : min(s + _BLOCK, at[hi])].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            else:
                bits = np.unpackbits(flat[at[lo] : at[hi]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                some = np.flatnonzero(n[lo:hi] > 0)
                if len(some):
                    ones[lo + some] = np.add.reduceat(bits, (at[lo:hi] - at[lo])[some], axis=0, dtype=np.int64)
            lo = hi
        fp = np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, k: int = 3, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_cols`` and ``fp`` (bigint, the unsigned fingerprint's bits) of every row's whole text.

    Shingles are ``k`` words joined by spaces, repeats included; fewer words: all of them; none, or a null text: 0.
    """
    w = docs.select(*id_cols, words(ascii_lower(F.col("text"))).alias("w"))
    some = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(F.col("w"), i + j) for j in range(k)])))
    h = F.when(F.size("w") == 0, F.array().cast("array<bigint>")).when(F.size("w") <= k, F.array(F.xxhash64(F.concat_ws(" ", "w")))).otherwise(some)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    return w.select(*id_cols, h.alias("h")).mapInArrow(bit_majority, f"{kinds}, fp bigint")


def _keys(fps: DataFrame) -> DataFrame:
    """One row for each of the 64 one-wildcard variants of a half."""
    half = lambda i: F.when(i < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    key = lambda i: (i.cast("long") * F.lit(1 << 32)).bitwiseOR(half(i).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 32).cast("int")))))
    return fps.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(63)), key)).alias("key"))


def _gathered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``stored`` in files of AQE's advisory size: a few rows come of many tasks, and each file that a task writes costs its executor several processes (chmod, on local folders)."""
    return stored(df.hint("rebalance", by), name)


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column ``fp``) that between them connect all that differ in <= ``bits`` (1 or 2)."""
    if bits not in (1, 2):
        raise ValueError("bits must be 1 or 2")
    # 64 rows come of each: spread them whatever the size of the fingerprints alone (by another key than theirs, or the exchange before would do)
    keys = _keys(fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp")))
    met = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    met = _gathered(met, "key", "simhash-keys")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits
    two = met.filter("n = 2").select("a", "b").filter(near("a", "b"))
    more = met.filter("n > 2").select("key", "n")
    # two bigints a row: up to BROADCAST_ROWS of them may be broadcast, more are joined by a shuffle
    members = _gathered(keys.join(F.broadcast(more) if more.count() <= BROADCAST_ROWS else more, "key"), "fp", "simhash-members")
    few = members.filter(F.col("n") <= HOT)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter("a < b").select("a", "b").filter(near("a", "b"))
    crowd = members.filter(F.col("n") > HOT).select("fp").distinct()
    mid = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    if bits == 1:
        # a common midpoint allows two bits: compare the members of a midpoint with it alone
        star = crowd.select(F.col("fp").alias("a"), F.explode(mid).alias("b")).join(crowd.select(F.col("fp").alias("b")), "b").filter("a < b").select("a", "b")
    else:
        named = crowd.select("fp", F.explode(mid).alias("m"))
        least = named.groupBy("m").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("m", "a")
        star = named.join(least, "m").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return two.union(pairs).union(star).distinct()


def groups(docs: DataFrame, k: int = 3, bits: int = 2, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_cols``, fp, component_id (least doc_id reachable over links of at most ``bits`` differing bits), a row for each row of ``docs``.

    Null or empty texts have fingerprint 0 and link like any other.  Rows may repeat: nodes are fingerprints,
    so rows with one id and different texts are judged each by its own.  Other columns are ignored.
    """
    base = _gathered(fingerprints(docs, k, id_cols), "fp", "simhash")
    fps = base.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(base.select("fp").distinct(), bits))
    named = found.join(fps, found.node == fps.fp)
    low = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = cut(named.join(low, "component").select("fp", "component_id"))
    return base.join(fps, "fp").join(of, "fp", "left").select(*id_cols, "fp", F.coalesce("component_id", "least").alias("component_id"))


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
