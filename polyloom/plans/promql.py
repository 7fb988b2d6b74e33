"""PromQL compiled to DataFrames.

Samples are rows (labels map<string,string>, ts in ms, value).  A query is evaluated at every step of a grid at once: a sample is given to
the steps that can see it (an explode bounded by range / step), so ranges need no range join, and a
vector is a DataFrame (t, labels, value) with labels as a sorted array of entries, which can be grouped and joined on.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK = 300_000
_UNIT = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
AGGREGATES = ("sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "quantile", "topk", "bottomk", "count_values")
_PRECEDENCE = {"or": 1, "and": 2, "unless": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "^": 6}
_TOKEN = re.compile(
    r"\s*(?:(?P<dur>\d+(?:ms|[smhdwy])(?:\d+(?:ms|[smhdwy]))*)|(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[Ii]nf\b|[Nn]a[Nn]\b)|(?P<str>\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*')|(?P<id>:?[A-Za-z_][\w:]*)|(?P<op>=~|!~|==|!=|<=|>=|[-+*/%^<>=(){}\[\],:]))"
)


class PromQLError(ValueError):
    pass


@dataclass
class Num:
    value: float


@dataclass
class Str:
    value: str


@dataclass
class Sel:
    name: str | None
    matchers: list[tuple[str, str, str]] = field(default_factory=list)
    range: int | None = None
    offset: int = 0


@dataclass
class Sub:
    expr: object
    range: int
    step: int
    offset: int = 0


@dataclass
class Call:
    fn: str
    args: list


@dataclass
class Agg:
    op: str
    expr: object
    param: object | None
    by: list[str] | None
    without: list[str] | None


@dataclass
class Bin:
    op: str
    left: object
    right: object
    bool_: bool
    on: list[str] | None = None
    ignoring: list[str] | None = None
    side: str | None = None


@dataclass
class Neg:
    expr: object


def duration(text: str) -> int:
    return sum(int(n) * _UNIT[u] for n, u in re.findall(r"(\d+)(ms|[smhdwy])", text))


class Parser:
    def __init__(self, text: str):
        self.toks: list[tuple[str, str]] = []
        at = 0
        text = re.sub(r"#.*", "", text).strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise PromQLError(f"not understood: {text[at : at + 20]!r}")
            at = m.end()
            self.toks.append((m.lastgroup, m[m.lastgroup]))
        self.i = 0

    def peek(self) -> str | None:
        return self.toks[self.i][1] if self.i < len(self.toks) else None

    def kind(self) -> str | None:
        return self.toks[self.i][0] if self.i < len(self.toks) else None

    def next(self) -> str:
        if self.i >= len(self.toks):
            raise PromQLError("unexpected end")
        self.i += 1
        return self.toks[self.i - 1][1]

    def take(self, what: str) -> bool:
        if self.peek() == what and self.kind() != "str":
            self.i += 1
            return True
        return False

    def need(self, what: str) -> None:
        if not self.take(what):
            raise PromQLError(f"{what!r} expected, not {self.peek()!r}")

    def parse(self):
        e = self.expr(1)
        if self.peek() is not None:
            raise PromQLError(f"not understood: {self.peek()!r}")
        return e

    def expr(self, least: int):
        left = self.unary()
        while self.kind() in ("op", "id") and (p := _PRECEDENCE.get(self.peek())) and p >= least:
            op = self.next()
            bool_ = self.take("bool")
            on = ignoring = side = None
            if self.peek() in ("on", "ignoring"):
                word = self.next()
                names = self.names()
                on, ignoring = (names, None) if word == "on" else (None, names)
                if self.peek() in ("group_left", "group_right"):
                    side = self.next()
                    if self.peek() == "(":
                        self.names()
            right = self.expr(p if op == "^" else p + 1)
            left = Bin(op, left, right, bool_, on, ignoring, side)
        return left

    def unary(self):
        if self.take("-"):
            return Neg(self.expr(6))
        self.take("+")
        return self.postfix(self.primary())

    def names(self) -> list[str]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.next())
            self.take(",")
        return out

    def postfix(self, e):
        while True:
            if self.take("["):
                r = duration(self.next())
                if self.take(":"):
                    step = duration(self.next()) if self.kind() == "dur" else 60_000
                    self.need("]")
                    e = Sub(e, r, step)
                else:
                    self.need("]")
                    if not isinstance(e, Sel):
                        raise PromQLError("a range needs a selector")
                    e.range = r
            elif self.take("offset"):
                sign = -1 if self.take("-") else 1
                if not isinstance(e, Sel | Sub):
                    raise PromQLError("offset needs a selector")
                e.offset = sign * duration(self.next())
            else:
                return e

    def primary(self):
        k = self.kind()
        if k == "num":
            return Num(float(self.next()))
        if k == "str":
            return Str(self.next()[1:-1])
        if self.take("("):
            e = self.expr(1)
            self.need(")")
            return e
        if self.peek() == "{":
            return Sel(None, self.matchers())
        if k != "id":
            raise PromQLError(f"not understood: {self.peek()!r}")
        name = self.next()
        if name in AGGREGATES and self.peek() in ("(", "by", "without"):
            return self.aggregate(name)
        if self.take("("):
            args = []
            while not self.take(")"):
                args.append(self.expr(1))
                self.take(",")
            return Call(name, args)
        return Sel(name, self.matchers() if self.peek() == "{" else [])

    def aggregate(self, op: str):
        by = without = None

        def grouping() -> None:
            nonlocal by, without
            if self.take("by"):
                by = self.names()
            elif self.take("without"):
                without = self.names()

        grouping()
        self.need("(")
        args = [self.expr(1)]
        while self.take(","):
            args.append(self.expr(1))
        self.need(")")
        grouping()
        return Agg(op, args[-1], args[0] if len(args) > 1 else None, by, without)

    def matchers(self) -> list[tuple[str, str, str]]:
        self.need("{")
        out = []
        while not self.take("}"):
            name, op, value = self.next(), self.next(), self.next()[1:-1]
            if op not in ("=", "!=", "=~", "!~"):
                raise PromQLError(f"not a matcher: {op}")
            out.append((name, op, value))
            self.take(",")
        return out


def parse(text: str):
    return Parser(text).parse()


# -- labels: sorted arrays of entries ----------------------------------------------------------------------------------
def _entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def _keep(labels: Column, test) -> Column:
    return F.filter(labels, test)


def _unnamed(labels: Column) -> Column:
    return _keep(labels, lambda e: e["key"] != "__name__")


def _value(labels: Column, name: str) -> Column:
    return F.coalesce(F.get(F.filter(labels, lambda e: e["key"] == name), F.lit(0))["value"], F.lit(""))


def _with(labels: Column, name: str, value: Column) -> Column:
    rest = _keep(labels, lambda e: e["key"] != name)
    one = F.array(F.struct(F.lit(name).alias("key"), value.alias("value")))
    return F.array_sort(F.when(value == "", rest).otherwise(F.concat(rest, one)))


# -- functions of the samples in a range: a is an array of (ts, v) in order of time --------------------------------------
def _pairs(a: Column, f) -> Column:
    return F.when(F.size(a) > 1, F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: f(F.get(a, i - 1), F.get(a, i))))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def _increase(a: Column) -> Column:
    return _total(_pairs(a, lambda p, q: F.when(q["v"] >= p["v"], q["v"] - p["v"]).otherwise(q["v"])))


def _span(a: Column) -> Column:
    return (F.element_at(a, -1)["ts"] - F.get(a, 0)["ts"]) / F.lit(1000.0)


def _slope(a: Column) -> Column:
    n = F.size(a)
    t0 = F.get(a, 0)["ts"]
    xs = F.transform(a, lambda s: (s["ts"] - t0) / F.lit(1000.0))
    mx, my = _total(xs) / n, _total(F.transform(a, lambda s: s["v"])) / n
    cov = _total(F.transform(a, lambda s: ((s["ts"] - t0) / F.lit(1000.0) - mx) * (s["v"] - my)))
    var = _total(F.transform(xs, lambda x: (x - mx) * (x - mx)))
    return F.when((n > 1) & (var > 0), cov / var)


def _var(a: Column) -> Column:
    n = F.size(a)
    m = _total(F.transform(a, lambda s: s["v"])) / n
    return F.when(n > 1, _total(F.transform(a, lambda s: (s["v"] - m) * (s["v"] - m))) / n)


def _quantile(a: Column, q: float) -> Column:
    v = F.array_sort(F.transform(a, lambda s: s["v"]))
    r = min(1.0, max(0.0, q)) * (F.size(a) - 1)
    lo = F.floor(r).cast("int")
    return F.get(v, lo) + (F.get(v, F.least(lo + 1, F.size(a) - 1)) - F.get(v, lo)) * (r - lo)


def _holt_winters(a: Column, sf: float, tf: float) -> Column:
    if not (0 < sf < 1 and 0 < tf < 1):
        raise PromQLError("factors must lie between 0 and 1")
    first, second = F.get(a, 0)["v"], F.get(a, 1)["v"]
    start = F.struct(first.alias("s"), (second - first).alias("b"))

    def step(acc: Column, x: Column) -> Column:
        s = sf * x["v"] + (1 - sf) * (acc["s"] + acc["b"])
        return F.struct(s.alias("s"), (tf * (s - acc["s"]) + (1 - tf) * acc["b"]).alias("b"))

    return F.when(F.size(a) > 1, F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), start, step)["s"])


def range_function(fn: str, a: Column, params: list[float]) -> Column:
    n = F.size(a)
    last, first = F.element_at(a, -1)["v"], F.get(a, 0)["v"]
    v = F.transform(a, lambda s: s["v"])
    two = lambda e: F.when(n > 1, e)
    table = {
        "increase": lambda: _increase(a),
        "rate": lambda: F.when((n > 1) & (_span(a) > 0), _increase(a) / _span(a)),
        "irate": lambda: F.when(n > 1, range_function("rate", F.slice(a, -2, 2), [])),
        "delta": lambda: two(last - first),
        "idelta": lambda: two(last - F.element_at(a, -2)["v"]),
        "deriv": lambda: _slope(a),
        "predict_linear": lambda: last + _slope(a) * params[0],
        "avg_over_time": lambda: _total(v) / n,
        "sum_over_time": lambda: _total(v),
        "min_over_time": lambda: F.array_min(v),
        "max_over_time": lambda: F.array_max(v),
        "count_over_time": lambda: n.cast("double"),
        "last_over_time": lambda: last,
        "present_over_time": lambda: F.lit(1.0),
        "quantile_over_time": lambda: _quantile(a, params[0]),
        "stdvar_over_time": lambda: _var(a),
        "stddev_over_time": lambda: F.sqrt(_var(a)),
        "changes": lambda: F.coalesce(_total(_pairs(a, lambda p, q: F.when(p["v"] != q["v"], 1.0).otherwise(0.0))), F.lit(0.0)),
        "resets": lambda: F.coalesce(_total(_pairs(a, lambda p, q: F.when(q["v"] < p["v"], 1.0).otherwise(0.0))), F.lit(0.0)),
        "holt_winters": lambda: _holt_winters(a, params[0], params[1]),
    }
    if fn not in table:
        raise PromQLError(f"unknown function {fn}")
    return table[fn]()


RANGE = {"increase", "rate", "irate", "delta", "idelta", "deriv", "predict_linear", "changes", "resets", "holt_winters", "quantile_over_time", *(f"{x}_over_time" for x in ("avg", "sum", "min", "max", "count", "last", "present", "stdvar", "stddev"))}
_MATH = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "exp": F.exp, "sgn": F.signum, "acos": F.acos, "asin": F.asin, "atan": F.atan, "cos": F.cos, "sin": F.sin, "tan": F.tan,
    "deg": F.degrees, "rad": F.radians, "ln": lambda v: F.when(v > 0, F.ln(v)).otherwise(float("nan")), "log2": lambda v: F.when(v > 0, F.log2(v)).otherwise(float("nan")), "log10": lambda v: F.when(v > 0, F.log10(v)).otherwise(float("nan")),
}


class Engine:
    """Evaluate queries over ``samples`` (labels, ts, value) from ``start`` to ``end`` every ``step`` milliseconds."""

    def __init__(self, samples: DataFrame, start: int, end: int | None = None, step: int = 60_000, lookback: int = LOOKBACK):
        self.samples, self.start, self.end, self.step, self.lookback = samples, start, start if end is None else end, step, lookback

    def query(self, text: str) -> DataFrame:
        """(t, labels map, value)."""
        out = self.eval(parse(text))
        if isinstance(out, float):
            out = self._grid().withColumn("labels", F.array().cast("array<struct<key:string,value:string>>")).withColumn("value", F.lit(out))
        return out.select("t", F.map_from_entries("labels").alias("labels"), "value")

    def _grid(self) -> DataFrame:
        return self.samples.sparkSession.range(self.start, self.end + 1, self.step).select(F.col("id").alias("t"))

    def _select(self, s: Sel) -> DataFrame:
        d = self.samples
        for name, op, value in ([("__name__", "=", s.name)] if s.name else []) + s.matchers:
            v = F.coalesce(F.try_element_at("labels", F.lit(name)), F.lit(""))
            d = d.filter({"=": v == value, "!=": v != value, "=~": v.rlike(f"^(?:{value})$"), "!~": ~v.rlike(f"^(?:{value})$")}[op])
        return d.select(_entries(F.col("labels")).alias("labels"), (F.col("ts") + s.offset).alias("ts"), F.col("value").cast("double").alias("v"))

    def _spread(self, d: DataFrame, back: int, closed: bool) -> DataFrame:
        """Each sample at the steps t with t - back < ts <= t (or <=, if ``closed``)."""
        lo, hi = self.start - back, self.end
        d = d.filter((F.col("ts") <= hi) & ((F.col("ts") >= lo) if closed else (F.col("ts") > lo)))
        first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("ts") - self.start) / self.step))
        last = F.floor((F.col("ts") + (back if closed else back - 1) - self.start) / self.step)
        last = F.least(last, F.lit((self.end - self.start) // self.step).cast("long"))
        d = d.withColumn("k_", F.when(first <= last, F.sequence(first, last)))
        return d.withColumn("k_", F.explode("k_")).withColumn("t", F.col("k_") * self.step + self.start).drop("k_")

    def _instant(self, s: Sel) -> DataFrame:
        d = self._spread(self._select(s), self.lookback, True)
        return d.groupBy("t", "labels").agg(F.max_by("v", "ts").alias("value"))

    def _windows(self, e) -> DataFrame:
        """(t, labels, a): the samples of each range."""
        if isinstance(e, Sub):
            lo = (self.start - e.range - e.offset) // e.step * e.step
            inner = Engine(self.samples, lo, self.end - e.offset, e.step, self.lookback)
            v = inner._vector(inner.eval(e.expr))
            d = v.select("labels", (F.col("t") + e.offset).alias("ts"), F.col("value").alias("v"))
            d = self._spread(d, e.range, True)
        elif isinstance(e, Sel) and e.range:
            d = self._spread(self._select(e), e.range, False)
        else:
            raise PromQLError("a range is needed")
        return d.groupBy("t", "labels").agg(F.array_sort(F.collect_list(F.struct("ts", "v"))).alias("a"))

    def _vector(self, v) -> DataFrame:
        if isinstance(v, float):
            return self._grid().select("t", F.array().cast("array<struct<key:string,value:string>>").alias("labels"), F.lit(v).alias("value"))
        return v

    def eval(self, e):
        if isinstance(e, Num):
            return e.value
        if isinstance(e, Neg):
            v = self.eval(e.expr)
            return -v if isinstance(v, float) else v.select("t", _unnamed(F.col("labels")).alias("labels"), (-F.col("value")).alias("value"))
        if isinstance(e, Sel):
            if e.range:
                raise PromQLError("a range vector is no result")
            return self._instant(e)
        if isinstance(e, Agg):
            return self._aggregate(e)
        if isinstance(e, Bin):
            return self._binary(e)
        if isinstance(e, Call):
            return self._call(e)
        raise PromQLError(f"not a vector: {e}")

    def _number(self, e) -> float:
        v = self.eval(e)
        if not isinstance(v, float):
            raise PromQLError("a number is needed")
        return v

    def _aggregate(self, e: Agg) -> DataFrame:
        v = self._vector(self.eval(e.expr))
        if e.by is not None:
            g = _keep(F.col("labels"), lambda x: x["key"].isin(*e.by))
        elif e.without is not None:
            g = _keep(F.col("labels"), lambda x: ~x["key"].isin(*e.without, "__name__"))
        else:
            g = F.slice("labels", 1, 0)
        if e.op in ("topk", "bottomk"):
            k = int(self._number(e.param))
            order = F.desc("value") if e.op == "topk" else F.asc("value")
            v = v.withColumn("g_", g).withColumn("r_", F.row_number().over(Window.partitionBy("t", "g_").orderBy(order, "labels")))
            return v.filter(F.col("r_") <= k).select("t", "labels", "value")
        x = F.col("value")
        if e.op == "count_values":
            name = e.param.value
            text = F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
            return v.groupBy("t", g.alias("labels"), text.alias("n_")).agg(F.count("*").cast("double").alias("value")).select("t", _with(F.col("labels"), name, F.col("n_")).alias("labels"), "value")
        made = {
            "sum": lambda: F.sum(x), "avg": lambda: F.avg(x), "min": lambda: F.min(x), "max": lambda: F.max(x), "count": lambda: F.count("*").cast("double"), "group": lambda: F.max(F.lit(1.0)),
            "stddev": lambda: F.stddev_pop(x), "stdvar": lambda: F.var_pop(x), "quantile": lambda: F.percentile(x, min(1.0, max(0.0, self._number(e.param)))),
        }[e.op]()
        return v.groupBy("t", g.alias("labels")).agg(made.alias("value"))

    @staticmethod
    def _arith(op: str, a, b):
        nan = F.lit(float("nan"))
        return {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: F.pow(a, b), "atan2": lambda: F.atan2(a, b),
            "/": lambda: F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a), nan).when(a > 0, float("inf")).otherwise(float("-inf")),
            "%": lambda: F.when(b != 0, F.try_mod(a, b)).otherwise(nan),
            "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
        }[op]()

    def _match_key(self, e: Bin) -> Column:
        if e.on is not None:
            return _keep(F.col("labels"), lambda x: x["key"].isin(*e.on)) if e.on else F.slice("labels", 1, 0)
        drop = ["__name__", *(e.ignoring or [])]
        return _keep(F.col("labels"), lambda x: ~x["key"].isin(*drop))

    def _binary(self, e: Bin):
        a, b = self.eval(e.left), self.eval(e.right)
        compare = e.op in ("==", "!=", "<", "<=", ">", ">=")
        if isinstance(a, float) and isinstance(b, float):
            if compare:
                return float({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op])
            return float({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b if b else math.nan if not a else math.copysign(math.inf, a), "%": lambda: math.fmod(a, b) if b else math.nan, "^": lambda: a**b}[e.op]())
        if e.op in ("and", "or", "unless"):
            key = self._match_key(e)
            left, right = self._vector(a).withColumn("m_", key), self._vector(b).withColumn("m_", key)
            if e.op == "or":
                more = right.join(left.select("t", "m_").distinct(), ["t", "m_"], "left_anti")
                return left.select("t", "labels", "value").union(more.select("t", "labels", "value"))
            return left.join(right.select("t", "m_").distinct(), ["t", "m_"], "left_semi" if e.op == "and" else "left_anti").select("t", "labels", "value")
        if isinstance(a, float) or isinstance(b, float):
            v = b if isinstance(a, float) else a
            x, y = (F.lit(a), F.col("value")) if isinstance(a, float) else (F.col("value"), F.lit(b))
            r = self._arith(e.op, x, y)
            if compare and not e.bool_:
                return v.filter(r)
            return v.select("t", _unnamed(F.col("labels")).alias("labels"), r.cast("double").alias("value"))
        key = self._match_key(e)
        left = a.select("t", key.alias("m_"), F.col("labels").alias("l_"), F.col("value").alias("x_"))
        right = b.select("t", key.alias("m_"), F.col("labels").alias("r_"), F.col("value").alias("y_"))
        j = left.join(right, ["t", "m_"])
        r = self._arith(e.op, F.col("x_"), F.col("y_"))
        many = {"group_left": "l_", "group_right": "r_"}.get(e.side)
        out = _unnamed(F.col(many)) if many else F.col("m_")
        if compare and not e.bool_:
            return j.filter(r).select("t", F.col("l_").alias("labels"), F.col("x_").alias("value"))
        return j.select("t", out.alias("labels"), r.cast("double").alias("value"))

    def _call(self, e: Call):
        fn, args = e.fn, e.args
        if fn in RANGE:
            at = next((i for i, x in enumerate(args) if isinstance(x, Sub) or isinstance(x, Sel) and x.range), None)
            if at is None:
                raise PromQLError(f"{fn} needs a range")
            params = [self._number(x) for i, x in enumerate(args) if i != at]
            w = self._windows(args[at])
            out = w.select("t", (F.col("labels") if fn == "last_over_time" else _unnamed(F.col("labels"))).alias("labels"), range_function(fn, F.col("a"), params).alias("value"))
            return out.filter("value is not null")
        if fn == "absent_over_time" or fn == "absent":
            v = self._windows(args[0]) if fn == "absent_over_time" else self._vector(self.eval(args[0]))
            eq = [(n, x) for n, op, x in args[0].matchers if op == "="] if isinstance(args[0], Sel) else []
            labels = F.array_sort(F.array(*[F.struct(F.lit(n).alias("key"), F.lit(x).alias("value")) for n, x in eq])) if eq else F.array().cast("array<struct<key:string,value:string>>")
            return self._grid().join(v.select("t").distinct(), "t", "left_anti").select("t", labels.alias("labels"), F.lit(1.0).alias("value"))
        if fn == "time":
            return self._grid().select("t", F.array().cast("array<struct<key:string,value:string>>").alias("labels"), (F.col("t") / 1000.0).alias("value"))
        if fn == "vector":
            return self._vector(self.eval(args[0]))
        if fn == "scalar":
            v = self._vector(self.eval(args[0])).groupBy("t").agg(F.when(F.count("*") == 1, F.max("value")).otherwise(float("nan")).alias("value"))
            return self._grid().join(v, "t", "left").select("t", F.array().cast("array<struct<key:string,value:string>>").alias("labels"), F.coalesce("value", F.lit(float("nan"))).alias("value"))
        if fn == "label_replace":
            v = self._vector(self.eval(args[0]))
            dst, to, src, pattern = (x.value for x in args[1:])
            s = _value(F.col("labels"), src)
            new = F.when(s.rlike(f"^(?:{pattern})$"), F.regexp_replace(s, f"^(?:{pattern})$", to)).otherwise(_value(F.col("labels"), dst))
            return v.select("t", _with(F.col("labels"), dst, new).alias("labels"), "value")
        if fn == "label_join":
            v = self._vector(self.eval(args[0]))
            dst, sep, *srcs = (x.value for x in args[1:])
            return v.select("t", _with(F.col("labels"), dst, F.concat_ws(sep, *[_value(F.col("labels"), s) for s in srcs])).alias("labels"), "value")
        if fn == "histogram_quantile":
            return self._histogram(self._number(args[0]), self._vector(self.eval(args[1])))
        v = self.eval(args[0])
        params = [self._number(x) for x in args[1:]]
        x = F.lit(v) if isinstance(v, float) else F.col("value")
        if fn in _MATH:
            y = _MATH[fn](x)
        elif fn == "round":
            to = params[0] if params else 1.0
            y = F.floor(x / to + 0.5) * to
        elif fn == "clamp":
            y = F.greatest(F.lit(params[0]), F.least(F.lit(params[1]), x))
        elif fn == "clamp_min":
            y = F.greatest(F.lit(params[0]), x)
        elif fn == "clamp_max":
            y = F.least(F.lit(params[0]), x)
        elif fn == "atan2":
            y = F.atan2(x, F.lit(params[0]))
        else:
            raise PromQLError(f"unknown function {fn}")
        return self._vector(v).select("t", _unnamed(F.col("labels")).alias("labels"), y.cast("double").alias("value"))

    def _histogram(self, q: float, v: DataFrame) -> DataFrame:
        """Linear within the bucket that holds rank q * total; in the +Inf bucket the last finite bound."""
        le = F.coalesce(_value(F.col("labels"), "le").try_cast("double"), F.lit(float("inf")))
        d = v.select("t", _keep(F.col("labels"), lambda e: ~e["key"].isin("le", "__name__")).alias("labels"), le.alias("le"), "value")
        b = d.groupBy("t", "labels").agg(F.array_sort(F.collect_list(F.struct("le", F.col("value").alias("c")))).alias("b"))
        rank = F.lit(q) * F.element_at("b", -1)["c"]
        i = F.coalesce(F.array_position(F.transform("b", lambda x: x["c"] >= rank), True), F.size("b")).cast("int")
        here, before = F.get("b", i - 1), F.get("b", i - 2)
        lo, c0 = F.when(i > 1, before["le"]).otherwise(0.0), F.when(i > 1, before["c"]).otherwise(0.0)
        inside = F.when(here["c"] > c0, lo + (here["le"] - lo) * (rank - c0) / (here["c"] - c0)).otherwise(here["le"])
        value = F.when(F.element_at("b", -1)["c"] == 0, float("nan")).when(here["le"] == float("inf"), lo).otherwise(inside)
        return b.select("t", "labels", value.alias("value"))
