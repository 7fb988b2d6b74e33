"""Scalar functions whose meaning differs from Spark's built-in of the same name, or that Spark lacks.

Bad arguments give null; nothing here raises for a value.
"""

from __future__ import annotations

import secrets
import time

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = r"[\s\u0085   -     　]+"
_BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


# -- strings -----------------------------------------------------------------------------------------------------------
def trim(s: Column, side: str = "both") -> Column:
    """Unicode white space, not only blanks."""
    out = s
    if side in ("both", "left"):
        out = F.regexp_replace(out, f"^{_WHITE}", "")
    if side in ("both", "right"):
        out = F.regexp_replace(out, f"{_WHITE}$", "")
    return out


def substr(s: Column, start: int = 1, length: int | None = None) -> Column:
    """1-based characters; a start below 1 counts as 1."""
    at = max(1, start)
    return F.substring(s, at, 2**31 - 1 if length is None else max(0, length))


def concat(*cols: Column) -> Column:
    """Nulls print as nothing."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def split_part(s: Column, delimiter: str, n: int) -> Column:
    return F.split_part(s, F.lit(delimiter), F.lit(n))


# -- numbers -----------------------------------------------------------------------------------------------------------
def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def sqrt(x: Column) -> Column:
    return finite(F.sqrt(x.cast("double")))


def power(x: Column, y: Column) -> Column:
    return finite(F.pow(x.cast("double"), y.cast("double")))


def log(x: Column, base: str = "e") -> Column:
    f = {"e": F.ln, "10": F.log10, "2": F.log2}[base]
    return F.when(x > 0, f(x))


def mod(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.try_mod(a, b))


# -- kinds and identifiers ---------------------------------------------------------------------------------------------
def type_of(c: Column) -> Column:
    """null, bool, int, float, string, array or object."""
    t = F.typeof(c)
    return (
        F.when(c.isNull(), "null")
        .when(t == "boolean", "bool")
        .when(t.isin("tinyint", "smallint", "int", "bigint"), "int")
        .when(t.isin("float", "double") | t.startswith("decimal"), "float")
        .when(t.startswith("array"), "array")
        .when(t.startswith("struct") | t.startswith("map"), "object")
        .otherwise("string")
    )


def is_uuid(s: Column) -> Column:
    return s.rlike(r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")


def is_ulid(s: Column) -> Column:
    return s.rlike(r"^[0-7][0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{25}$")


def is_cuid2(s: Column) -> Column:
    return s.rlike(r"^[a-z][a-z0-9]{23}$")


def is_nanoid(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9_-]{21}$")


def id_type(s: Column) -> Column:
    return F.when(is_uuid(s), "uuid").when(is_ulid(s), "ulid").when(is_cuid2(s), "cuid2").when(is_nanoid(s), "nanoid").otherwise("unknown")


def uuid_version(s: Column) -> Column:
    return F.when(is_uuid(s), F.substring(s, 15, 1).try_cast("int"))


def ulid_timestamp(s: Column) -> Column:
    """Milliseconds in the first ten characters (Crockford base 32)."""
    digits = [F.instr(F.lit(_BASE32), F.upper(F.substring(s, i + 1, 1))) - 1 for i in range(10)]
    total = F.lit(0).cast("long")
    for d in digits:
        total = total * 32 + d
    return F.when(is_ulid(s), total)


def _generator(make) -> Column:
    """``make``: a number of rows to as many ids, a batch at once."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series(make(len(ids)), dtype=object)

    return run.asNondeterministic()(F.spark_partition_id())


def _random(n: int, width: int) -> np.ndarray:
    """Bytes of the system's generator, n rows."""
    return np.frombuffer(bytearray(secrets.token_bytes(n * width)), np.uint8).reshape(n, width)


def _letters(n: int, alphabet: str, width: int) -> np.ndarray:
    """Letters as bytes, n rows, all equally likely: bytes beyond the last multiple of the alphabet's size are drawn again."""
    b = _random(n, width)
    limit = 256 - 256 % len(alphabet)
    while len(again := np.flatnonzero(b.ravel() >= limit)):
        b.ravel()[again] = _random(len(again), 1)[:, 0]
    return np.frombuffer(alphabet.encode(), np.uint8)[b % len(alphabet)]


def _texts(letters: np.ndarray) -> list[str]:
    text, w = letters.tobytes().decode("ascii"), letters.shape[1]
    return [text[i : i + w] for i in range(0, len(text), w)]


def _timed(n: int) -> np.ndarray:
    """48 bits of milliseconds since the epoch, then 80 random ones."""
    b = _random(n, 16)
    b[:, :6] = np.frombuffer(int(time.time() * 1000).to_bytes(6, "big"), np.uint8)
    return b


def _uuid7(n: int) -> list[str]:
    b = _timed(n)
    b[:, 6] = b[:, 6] & 0x0F | 0x70
    b[:, 8] = b[:, 8] & 0x3F | 0x80
    out = np.full((n, 36), ord("-"), np.uint8)
    out[:, [i for i in range(36) if i not in (8, 13, 18, 23)]] = np.frombuffer(b"0123456789abcdef", np.uint8)[np.stack([b >> 4, b & 15], 2).reshape(n, 32)]
    return _texts(out)


def _ulid(n: int) -> list[str]:
    bits = np.unpackbits(_timed(n), axis=1)
    # 26 letters are 130 bits: two zeros lead
    five = np.concatenate([np.zeros((n, 2), np.uint8), bits], 1).reshape(n, 26, 5)
    return _texts(np.frombuffer(_BASE32.encode(), np.uint8)[five @ np.array([16, 8, 4, 2, 1], np.uint8)])


def uuid_v4() -> Column:
    return F.uuid()


def uuid_v7() -> Column:
    return _generator(_uuid7)


def ulid() -> Column:
    return _generator(_ulid)


def cuid2() -> Column:
    a, b = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789"
    return _generator(lambda n: _texts(np.concatenate([_letters(n, a, 1), _letters(n, b, 23)], 1)))


def nanoid(length: int = 21) -> Column:
    a = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
    return _generator(lambda n: _texts(_letters(n, a, length)))


def decimal(s: Column, scale: int = 10) -> Column:
    return s.cast("string").try_cast(f"decimal(38,{scale})")


# -- dates -------------------------------------------------------------------------------------------------------------
def to_datetime(x: Column, kind: str = "string") -> Column:
    """ISO-8601 text, or an integer of microseconds since the epoch."""
    return F.timestamp_micros(x) if kind in ("int", "bigint") else F.try_to_timestamp(x)


def extract(part: str, t: Column) -> Column:
    """Whole numbers; dow counts from Sunday = 0."""
    p = part.lower()
    if p == "dow":
        return F.dayofweek(t) - 1
    if p == "epoch":
        return F.unix_seconds(t)
    if p == "microsecond":
        return F.pmod(F.unix_micros(t), F.lit(1_000_000))
    if p not in ("year", "month", "day", "hour", "minute", "second"):
        return F.lit(None).cast("int")
    return getattr(F, p)(t)


def add_duration(t: Column, interval: str, sign: int = 1) -> Column:
    from polyloom.functions.timeseries import interval_ms

    return F.timestamp_micros(F.unix_micros(t) + sign * interval_ms(interval) * 1000)


def date_diff(a: Column, b: Column) -> Column:
    """a - b in seconds."""
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)


# -- JSON documents (text) ---------------------------------------------------------------------------------------------
def _path(path: str) -> str:
    p = path[1:] if path.startswith("$") else path
    out = "$"
    for part in filter(None, p.replace("[", ".").replace("]", "").split(".")):
        out += f"[{part}]" if part.isdigit() else f".{part}"
    return out


def json_get(doc: Column, path: str) -> Column:
    """``a.b.0``, ``$.a.b[0]``: the value as text, null where there is none."""
    return F.get_json_object(doc, _path(path))


def json_exists(doc: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(doc), _path(path), "variant").isNotNull(), F.lit(False))


def _fields(doc: Column) -> Column:
    """Top-level members as a map of variants."""
    return F.try_variant_get(F.try_parse_json(doc), "$", "map<string,variant>")


def _text(members: Column) -> Column:
    return F.to_json(members)


def json_set(doc: Column, key: str, value: Column) -> Column:
    one = F.create_map(F.lit(key), F.try_parse_json(F.to_json(F.struct(value.alias("v")))))
    one = F.transform_values(one, lambda _, v: F.try_variant_get(v, "$.v", "variant"))
    return _text(F.map_concat(F.map_filter(_fields(doc), lambda k, _: k != key), one))


def json_remove(doc: Column, key: str) -> Column:
    return _text(F.map_filter(_fields(doc), lambda k, _: k != key))


def json_keys(doc: Column) -> Column:
    return F.json_object_keys(doc)


def json_values(doc: Column) -> Column:
    return F.transform(F.map_values(_fields(doc)), lambda v: F.to_json(v))


def json_length(doc: Column) -> Column:
    """Elements of an array, members of an object, bytes of a string."""
    return F.coalesce(F.json_array_length(doc), F.size(F.json_object_keys(doc)), F.octet_length(F.try_variant_get(F.try_parse_json(doc), "$", "string")))


def json_type(doc: Column) -> Column:
    t = F.schema_of_variant(F.try_parse_json(doc))
    return (
        F.when(t == "VOID", "null")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "STRING", "string")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
        .when(t.isNotNull(), "number")
    )


def json_array(*cols: Column) -> Column:
    return F.to_json(F.array(*cols))


def json_object(**cols: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()]))


def json_contains(doc: Column, needle: Column) -> Column:
    """An element of an array (as text) or a member name of an object."""
    items = F.from_json(doc, "array<string>")
    return F.coalesce(F.array_contains(items, needle.cast("string")), F.array_contains(F.json_object_keys(doc), needle.cast("string")), F.lit(False))


def json_merge(a: Column, b: Column) -> Column:
    """Members of both; of a name in both the right one."""
    right = _fields(b)
    return _text(F.map_concat(F.map_filter(_fields(a), lambda k, _: ~F.map_contains_key(right, k)), right))


def array_contains_value(doc: Column, path: str, value: Column) -> Column:
    """Whether the array at ``path`` holds ``value`` (text equality, or equal numbers)."""
    items = F.from_json(json_get(doc, path), "array<string>")
    as_number = value.cast("string").try_cast("double")
    return F.coalesce(F.exists(items, lambda x: (x == value.cast("string")) | (F.abs(x.try_cast("double") - as_number) < 1e-12)), F.lit(False))
