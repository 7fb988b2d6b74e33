"""Geospatial functions.  Degrees in, metres out; geometries are GeoJSON text.

Points and boxes are column arithmetic; predicates on general geometries are Arrow-batched Python behind a bounding-box test.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH = 6_371_000.0
#: Rows of one side in a block of ``dwithin_join``, about, and its tasks at most.
SIDE, TASKS = 4096, 20_000
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


# -- points, as columns ------------------------------------------------------------------------------------------------
def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """0 to 360 degrees, clockwise from north."""
    d = F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def point(lng: Column, lat: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates")))


def box(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    ring = F.array(F.array(lng1, lat1), F.array(lng2, lat1), F.array(lng2, lat2), F.array(lng1, lat2), F.array(lng1, lat1))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def x(geom: Column) -> Column:
    return F.get_json_object(geom, "$.coordinates[0]").try_cast("double")


def y(geom: Column) -> Column:
    return F.get_json_object(geom, "$.coordinates[1]").try_cast("double")


def kind(geom: Column) -> Column:
    return F.get_json_object(geom, "$.type")


def geohash(lng: Column, lat: Column, precision: int = 6) -> Column:
    """Bits of longitude and latitude, interleaved, five to a letter."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    cell = lambda v, lo, span, n: F.least(F.lit((1 << n) - 1), F.floor((v - lo) / span * (1 << n))).cast("long")
    gx, gy = cell(lng, -180.0, 360.0, nx), cell(lat, -90.0, 180.0, ny)
    letters = []
    for i in range(precision):
        value = F.lit(0)
        for b in range(5 * i, 5 * i + 5):
            src, n = (gx, nx) if b % 2 == 0 else (gy, ny)
            value = value * 2 + F.pmod(F.shiftright(src, n - 1 - b // 2), F.lit(2))
        letters.append(F.substring(F.lit(_BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


# -- geometry in Python (numbers only; each also works by itself) -------------------------------------------------------
def decode_geohash(h: str) -> tuple[float, float, float, float]:
    """West, south, east, north."""
    box_ = [-180.0, 180.0, -90.0, 90.0]
    even = True
    for c in h:
        v = _BASE32.index(c)
        for k in range(4, -1, -1):
            i = 0 if even else 2
            mid = (box_[i] + box_[i + 1]) / 2
            box_[i + (0 if v >> k & 1 else 1)] = mid
            even = not even
    return box_[0], box_[2], box_[1], box_[3]


def encode_geohash(lng: float, lat: float, precision: int) -> str:
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    gx = min((1 << nx) - 1, int((lng + 180) / 360 * (1 << nx)))
    gy = min((1 << ny) - 1, int((lat + 90) / 180 * (1 << ny)))
    out = 0
    for b in range(bits):
        out = out * 2 + ((gx >> (nx - 1 - b // 2)) if b % 2 == 0 else (gy >> (ny - 1 - b // 2))) % 2
    return "".join(_BASE32[out >> 5 * (precision - 1 - i) & 31] for i in range(precision))


def geohash_neighbors(h: str) -> list[str]:
    w, s, e, n = decode_geohash(h)
    dx, dy, cx, cy = e - w, n - s, (w + e) / 2, (s + n) / 2
    wrap = lambda v: (v + 180) % 360 - 180
    steps = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    return [encode_geohash(wrap(cx + i * dx), cy + j * dy, len(h)) for i, j in steps if -90 < cy + j * dy < 90]


def geohash_cover(west: float, south: float, east: float, north: float, precision: int) -> list[str]:
    w, s, e, n = decode_geohash(encode_geohash(west, south, precision))
    dx, dy = e - w, n - s
    out = []
    yy = s + dy / 2
    while yy - dy / 2 <= north:
        xx = w + dx / 2
        while xx - dx / 2 <= east:
            out.append(encode_geohash(xx, yy, precision))
            xx += dx
        yy += dy
    return out


def _parts(g: dict) -> tuple[list, list, list]:
    """Points, segments and rings-with-holes (polygons)."""
    t, c = g["type"], g.get("coordinates")
    if t == "Point":
        return [tuple(c[:2])], [], []
    if t == "MultiPoint":
        return [tuple(p[:2]) for p in c], [], []
    lines = [c] if t == "LineString" else c if t == "MultiLineString" else []
    polys = [c] if t == "Polygon" else c if t == "MultiPolygon" else []
    pts, seg, rings = [], [], []
    for part in lines:
        p = [tuple(q[:2]) for q in part]
        seg += list(zip(p, p[1:]))
    for poly in polys:
        r = [[tuple(q[:2]) for q in ring] for ring in poly]
        rings.append(r)
        for ring in r:
            seg += list(zip(ring, ring[1:]))
    for sub in g.get("geometries", []):
        a, b, d = _parts(sub)
        pts, seg, rings = pts + a, seg + b, rings + d
    return pts, seg, rings


def _side(a, b, p) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(a, b, p) -> bool:
    return abs(_side(a, b, p)) < 1e-12 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _cross(a, b, c, d) -> bool:
    s1, s2, s3, s4 = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
    if s1 * s2 < 0 and s3 * s4 < 0:
        return True
    return _on(a, b, c) or _on(a, b, d) or _on(c, d, a) or _on(c, d, b)


def _in_ring(ring: list, p) -> bool:
    inside = False
    for a, b in zip(ring, ring[1:]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return inside


def _in_polygon(poly: list, p, boundary: bool) -> bool:
    for ring in poly:
        if any(_on(a, b, p) for a, b in zip(ring, ring[1:])):
            return boundary
    return _in_ring(poly[0], p) and not any(_in_ring(h, p) for h in poly[1:])


def vertices(g: dict) -> list:
    pts, seg, _ = _parts(g)
    return pts + [p for s in seg for p in s]


def intersects_(a: dict, b: dict) -> bool:
    (pa, sa, ra), (pb, sb, rb) = _parts(a), _parts(b)
    if any(_cross(*s, *t) for s in sa for t in sb):
        return True
    if any(_on(*s, p) for s in sa for p in pb) or any(_on(*s, p) for s in sb for p in pa) or set(pa) & set(pb):
        return True
    return any(_in_polygon(r, p, True) for r in ra for p in vertices(b)) or any(_in_polygon(r, p, True) for r in rb for p in vertices(a))


def contains_(a: dict, b: dict) -> bool:
    """All of ``b`` in ``a``, its points not on the boundary."""
    _, sa, ra = _parts(a)
    pb, sb, _ = _parts(b)
    if not ra:
        return set(vertices(b)) <= set(vertices(a)) and not sb
    for p in vertices(b):
        if not any(_in_polygon(r, p, bool(sb)) for r in ra):
            return False
    mids = [((s[0][0] + s[1][0]) / 2, (s[0][1] + s[1][1]) / 2) for s in sb]
    if not all(any(_in_polygon(r, m, True) for r in ra) for m in mids):
        return False
    strict = lambda s, t: _side(*s, t[0]) * _side(*s, t[1]) < 0 and _side(*t, s[0]) * _side(*t, s[1]) < 0
    return not any(strict(s, t) for s in sa for t in sb) and bool(pb or sb)


def _hav(p, q) -> float:
    la, lb = math.radians(p[1]), math.radians(q[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2
    return 2 * EARTH * math.asin(min(1.0, math.sqrt(h)))


def _to_segment(p, a, b) -> float:
    """Metres on a plane that is true at p's latitude."""
    k = math.cos(math.radians(p[1]))
    m = math.radians(1) * EARTH
    ax, ay, bx, by = ((a[0] - p[0]) * k * m, (a[1] - p[1]) * m, (b[0] - p[0]) * k * m, (b[1] - p[1]) * m)
    dx, dy = bx - ax, by - ay
    t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
    return math.hypot(ax + t * dx, ay + t * dy)


def distance_(a: dict, b: dict) -> float:
    if a["type"] == b["type"] == "Point":
        return _hav(a["coordinates"], b["coordinates"])
    if intersects_(a, b):
        return 0.0
    (pa, sa, _), (pb, sb, _) = _parts(a), _parts(b)
    best = [_to_segment(p, *s) for p in vertices(a) for s in sb] + [_to_segment(p, *s) for p in vertices(b) for s in sa] + [_hav(p, q) for p in pa for q in pb]
    return min(best)


def circle_(lng: float, lat: float, metres: float, segments: int = 32) -> dict:
    ring = []
    for i in range(segments):
        t = 2 * math.pi * i / segments
        dy = math.degrees(metres * math.cos(t) / EARTH)
        ring.append([lng + math.degrees(metres * math.sin(t) / (EARTH * math.cos(math.radians(lat)))), lat + dy])
    return {"type": "Polygon", "coordinates": [[*ring, ring[0]]]}


def bounds_(g: dict) -> tuple[float, float, float, float]:
    v = vertices(g)
    return min(p[0] for p in v), min(p[1] for p in v), max(p[0] for p in v), max(p[1] for p in v)


def envelope_(g: dict) -> dict:
    w, s, e, n = bounds_(g)
    return {"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]}


def buffer_(g: dict, metres: float, segments: int = 32) -> dict:
    if g["type"] == "Point":
        return circle_(*g["coordinates"][:2], metres, segments)
    w, s, e, n = bounds_(g)
    dy = math.degrees(metres / EARTH)
    dx = dy / max(1e-9, math.cos(math.radians((s + n) / 2)))
    return {"type": "Polygon", "coordinates": [[[w - dx, s - dy], [e + dx, s - dy], [e + dx, n + dy], [w - dx, n + dy], [w - dx, s - dy]]]}


def union_(a: dict, b: dict) -> dict:
    flat = lambda g: g["geometries"] if g["type"] == "GeometryCollection" else [g]
    parts = flat(a) + flat(b)
    kinds = {p["type"] for p in parts}
    if len(kinds) == 1 and (k := kinds.pop()) in ("Point", "LineString", "Polygon"):
        return {"type": f"Multi{k}", "coordinates": [p["coordinates"] for p in parts]}
    return {"type": "GeometryCollection", "geometries": parts}


def intersection_(a: dict, b: dict) -> dict | None:
    """Of two polygons, ``b`` convex: the edges of ``b`` clip ``a``'s outer ring in turn."""
    ring = [tuple(p[:2]) for p in a["coordinates"][0]][:-1]
    clip = [tuple(p[:2]) for p in b["coordinates"][0]]
    area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(clip, clip[1:]))
    if area < 0:
        clip = clip[::-1]
    for u, v in zip(clip, clip[1:]):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            sp, sq = _side(u, v, p), _side(u, v, q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
        if not ring:
            return None
    return {"type": "Polygon", "coordinates": [[list(p) for p in [*ring, ring[0]]]]}


def length_(g: dict) -> float:
    _, seg, _ = _parts(g)
    return sum(_hav(*s) for s in seg)


def area_(g: dict) -> float:
    """Square metres of the outer rings less the holes, on a plane true at each ring's mean latitude."""
    m = math.radians(1) * EARTH
    total = 0.0
    for poly in _parts(g)[2]:
        for i, ring in enumerate(poly):
            k = math.cos(math.radians(sum(p[1] for p in ring) / len(ring)))
            a = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:]))) / 2 * k * m * m
            total += -a if i else a
    return total


def valid_(g: dict) -> bool:
    try:
        pts, seg, rings = _parts(g)
        return all(len(r) >= 4 and r[0] == r[-1] for poly in rings for r in poly) and bool(pts or seg) and all(-180 <= p[0] <= 180 and -90 <= p[1] <= 90 for p in vertices(g))
    except (KeyError, TypeError, ValueError):
        return False


def to_wkt_(g: dict) -> str:
    p = lambda c: f"{c[0]:g} {c[1]:g}"
    line = lambda c: "(" + ", ".join(map(p, c)) + ")"
    poly = lambda c: "(" + ", ".join(map(line, c)) + ")"
    t, c = g["type"], g.get("coordinates")
    if t == "GeometryCollection":
        return "GEOMETRYCOLLECTION(" + ", ".join(map(to_wkt_, g["geometries"])) + ")"
    body = {"Point": lambda: f"({p(c)})", "LineString": lambda: line(c), "Polygon": lambda: poly(c), "MultiPoint": lambda: "(" + ", ".join(f"({p(q)})" for q in c) + ")", "MultiLineString": lambda: "(" + ", ".join(map(line, c)) + ")", "MultiPolygon": lambda: "(" + ", ".join(map(poly, c)) + ")"}[t]()
    return t.upper() + body


def from_wkt_(text: str) -> dict:
    m = re.fullmatch(r"\s*([A-Za-z]+)\s*(\(.*\))\s*", text, re.S)
    names = {n.upper(): n for n in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")}
    if not m or m[1].upper() not in names:
        raise ValueError("not WKT")
    nums = re.sub(r"(-?[\d.]+(?:[eE][+-]?\d+)?)\s+(-?[\d.]+(?:[eE][+-]?\d+)?)", r"[\1,\2]", m[2])
    c = json.loads(nums.replace("(", "[").replace(")", "]"))
    kind_ = names[m[1].upper()]
    if kind_ == "Point":
        c = c[0]
    if kind_ == "MultiPoint":
        c = [q[0] if isinstance(q[0], list) else q for q in c]
    return {"type": kind_, "coordinates": c}


# -- columns over geometries -------------------------------------------------------------------------------------------
def _unary(fn, kind_: str):
    @F.pandas_udf(kind_)
    def run(g: pd.Series) -> pd.Series:
        def one(t):
            try:
                out = None if t is None else fn(json.loads(t) if fn is not from_wkt_ else t)
                return json.dumps(out) if isinstance(out, dict) else out
            except (ValueError, KeyError, TypeError, ZeroDivisionError):
                return False if kind_ == "boolean" else None

        return g.map(one)

    return run


def _binary(fn, kind_: str):
    @F.pandas_udf(kind_)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(s, t):
            try:
                out = None if s is None or t is None else fn(json.loads(s), json.loads(t))
                return json.dumps(out) if isinstance(out, dict) else out
            except (ValueError, KeyError, TypeError):
                return None

        return pd.Series([one(s, t) for s, t in zip(a, b)])

    return run


def st_contains(a: Column, b: Column) -> Column:
    return _binary(contains_, "boolean")(a, b)


def st_within(a: Column, b: Column) -> Column:
    return st_contains(b, a)


def st_intersects(a: Column, b: Column) -> Column:
    return _binary(intersects_, "boolean")(a, b)


def st_disjoint(a: Column, b: Column) -> Column:
    return ~st_intersects(a, b)


def st_distance(a: Column, b: Column) -> Column:
    """Points by column arithmetic; anything else in Python."""
    points = (kind(a) == "Point") & (kind(b) == "Point")
    return F.when(points, haversine(x(a), y(a), x(b), y(b))).otherwise(_binary(distance_, "double")(a, b))


def st_dwithin(a: Column, b: Column, metres: float) -> Column:
    return st_distance(a, b) <= metres


def st_buffer(a: Column, metres: float, segments: int = 32) -> Column:
    return _unary(lambda g: buffer_(g, metres, segments), "string")(a)


def st_envelope(a: Column) -> Column:
    return _unary(envelope_, "string")(a)


def st_union(a: Column, b: Column) -> Column:
    return _binary(union_, "string")(a, b)


def st_intersection(a: Column, b: Column) -> Column:
    return _binary(intersection_, "string")(a, b)


def geo_length(a: Column) -> Column:
    return _unary(length_, "double")(a)


def geo_area(a: Column) -> Column:
    return _unary(area_, "double")(a)


def geo_is_valid(a: Column) -> Column:
    return _unary(valid_, "boolean")(a)


def geo_num_points(a: Column) -> Column:
    return _unary(lambda g: len(_parts(g)[0]) + sum(len(r) for poly in _parts(g)[2] for r in poly) + (len(_parts(g)[1]) + 1 if g["type"] == "LineString" else 0), "int")(a)


def geo_as_wkt(a: Column) -> Column:
    return _unary(to_wkt_, "string")(a)


def geo_from_wkt(a: Column) -> Column:
    return _unary(from_wkt_, "string")(a)


def dwithin_join(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Pairs of points (lng, lat; columns of the right side end in _r) within ``metres``.

    Cells at least ``metres`` high and wide: each right point goes to its cell and the cells around it, so the join is on equal cells.  The
    width follows the latitude band, and longitudes wrap at the date line.  A cell with many points is cut into blocks of ``SIDE`` by
    ``SIDE`` rows, each compared by one task, and tasks are as many as there are pairs for, so none grows with the input.
    """
    step = math.degrees(metres / EARTH) * 1.0001
    bands = math.ceil(180 / step)
    # cells across a band, from its latitude nearest a pole and one band beyond
    edge = lambda band: F.least(F.lit(89.9), F.greatest(F.abs(band * step - 90.0 - step), F.abs((band + 1) * step - 90.0 + step)))
    across = lambda band: F.greatest(F.lit(1), F.floor(F.lit(360.0 / step) * F.cos(F.radians(edge(band)))).cast("long"))
    band = lambda lat: F.floor((lat + 90.0) / step).cast("long")
    cell = lambda lng, b: F.least(across(b) - 1, F.floor((lng + 180.0) / 360.0 * across(b)).cast("long"))
    a = left.withColumn("b_", band(F.col("lat"))).withColumn("c_", cell(F.col("lng"), F.col("b_")))
    r = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns])
    r = r.withColumn("b_", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: band(F.col("lat_r")) + d))).filter((F.col("b_") >= 0) & (F.col("b_") <= bands))
    r = r.withColumn("c_", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.pmod(cell(F.col("lng_r"), F.col("b_")) + d, across(F.col("b_")))))))
    cells = a.groupBy("b_", "c_").agg(F.count("*").alias("n_")).join(r.groupBy("b_", "c_").agg(F.count("*").alias("m_")), ["b_", "c_"])
    pairs = cells.agg(F.sum(F.col("n_").cast("double") * F.col("m_"))).first()[0] or 0.0
    tasks = max(1, min(TASKS, math.ceil(pairs / SIDE**2)))
    cells = cells.select("b_", "c_", F.ceil(F.col("n_") / SIDE).alias("p_"), F.ceil(F.col("m_") / SIDE).alias("q_"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n))
    # one key, since Spark drops those of several that are constant and would then exchange both sides again
    block = lambda df: df.withColumn("k_", F.concat_ws(" ", "b_", "c_", "i_", "j_")).drop("b_", "c_", "i_", "j_", "p_", "q_").repartition(tasks, "k_")
    a = block(a.join(cells, ["b_", "c_"]).withColumn("i_", part(a, "p_")).withColumn("j_", every("q_")))
    r = block(r.join(cells, ["b_", "c_"]).withColumn("j_", part(r, "q_")).withColumn("i_", every("p_")))
    # the difference in latitude first: it is cheap and leaves out half
    near = (F.abs(F.col("lat") - F.col("lat_r")) <= step) & (haversine(F.col("lng"), F.col("lat"), F.col("lng_r"), F.col("lat_r")) <= metres)
    return a.join(r.hint("shuffle_hash"), "k_").filter(near).drop("k_")
