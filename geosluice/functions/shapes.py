"""Shapes of any kind in one column type, as Column expressions.

A shape is struct<kind, parts>, each part struct<dim, rings>: a point is one ring of
one point (dim 0), a line one ring (dim 1), a polygon its rings, shell first and closed
(dim 2).  `kind` is the name that GeoJSON uses; collections hold parts of several
dimensions and are flat.  An empty shape has no parts.

Relations look at the pieces into which the other shape cuts a shape's segments: each
piece is inside, on the border of, or outside the other as a whole, so the place of its
middle tells.  Polygons add a point of each part's inside.  All of it is arithmetic on
arrays inside the JVM; it is meant to follow a test of envelopes, as the joins do.
Points within TOLERANCE of a segment, in proportion to its coordinates, are on it.

Null shapes: relations give false, measures -1, is_empty true, all else null.
Relations other than intersects and disjoint are not defined for collections of
several dimensions, and give null."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g

#: Kinds by name with the dimension of their parts (-1: any), their number
#: in the binary format, and the name in text.
KINDS = {
    "Point": (0, 1, "POINT"),
    "LineString": (1, 2, "LINESTRING"),
    "Polygon": (2, 3, "POLYGON"),
    "MultiPoint": (0, 4, "MULTIPOINT"),
    "MultiLineString": (1, 5, "MULTILINESTRING"),
    "MultiPolygon": (2, 6, "MULTIPOLYGON"),
    "GeometryCollection": (-1, 7, "GEOMETRYCOLLECTION"),
}
SINGLE = ("Point", "LineString", "Polygon")
PART = "struct<dim: int, rings: array<array<struct<x: double, y: double>>>>"
TYPE = f"struct<kind: string, parts: array<{PART}>>"
TOLERANCE = 1e-12

_POINTS = "array<struct<x: double, y: double>>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _shape(kind, parts: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), parts.cast(f"array<{PART}>").alias("parts"))


def _part(dim: int, rings: Column) -> Column:
    return F.struct(F.lit(dim).alias("dim"), rings.alias("rings"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _once(function):
    """Shape arguments as variables: expressions then grow with the function, not with its arguments."""

    @functools.wraps(function)
    def bound(*args, **more):
        n = 2 if len(args) > 1 and isinstance(args[1], Column) else 1
        rest = args[n:]
        if n == 1:
            return _let(args[0], lambda a: function(a, *rest, **more))
        return _let(F.struct(args[0].alias("a"), args[1].alias("b")), lambda p: function(p["a"], p["b"], *rest, **more))

    return bound


# making shapes


def of_point(p: Column) -> Column:
    """A null point, or one without a coordinate, is the empty point."""
    known = p["x"].isNotNull() & p["y"].isNotNull()
    return F.when(known, _shape("Point", F.array(_part(0, F.array(F.array(p)))))).otherwise(empty("Point"))


def of_line(line: Column) -> Column:
    return F.when(line.isNotNull(), F.when(F.size(line) == 0, empty("LineString")).otherwise(_shape("LineString", F.array(_part(1, F.array(line))))))


def of_polygon(rings: Column) -> Column:
    return F.when(rings.isNotNull(), F.when(F.size(rings) == 0, empty("Polygon")).otherwise(_shape("Polygon", F.array(_part(2, rings)))))


def of_envelope(e: Column) -> Column:
    return F.when(e.isNotNull(), of_polygon(g.polygon_of(e)))


def multi_point(points: Column) -> Column:
    return F.when(points.isNotNull(), _shape("MultiPoint", F.transform(points, lambda p: _part(0, F.array(F.array(p))))))


def multi_line(lines: Column) -> Column:
    return F.when(lines.isNotNull(), _shape("MultiLineString", F.transform(lines, lambda v: _part(1, F.array(v)))))


def multi_polygon(polygons: Column) -> Column:
    return F.when(polygons.isNotNull(), _shape("MultiPolygon", F.transform(polygons, lambda v: _part(2, v))))


def empty(kind: str = "GeometryCollection") -> Column:
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    return _shape(kind, _none(f"array<{PART}>"))


def collect(shapes: Column) -> Column:
    """An array of shapes as one collection; null and empty ones add nothing."""
    return F.when(shapes.isNotNull(), _shape("GeometryCollection", F.flatten(F.transform(shapes, lambda s: F.coalesce(s["parts"], _none(f"array<{PART}>"))))))


@_once
def add(whole: Column, item: Column) -> Column:
    """`item` appended to a collection: a multi-shape takes parts of its own dimension only, single shapes stay as they are."""
    dims = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[0])])
    own = F.get(F.transform(F.array(whole["kind"]), lambda k: dims[k]), F.lit(0))
    fits = F.filter(item["parts"], lambda p: (own == -1) | (p["dim"] == own))
    grown = _shape(whole["kind"], F.concat(whole["parts"], fits))
    return F.when(item.isNull() | whole.isNull() | whole["kind"].isin(*SINGLE), whole).otherwise(grown)


@_once
def components(s: Column) -> Column:
    """The parts of a collection as shapes of one part each; a single shape has none."""
    kind = lambda d: F.element_at(F.array(*map(F.lit, SINGLE)), d + 1)
    return F.when(s["kind"].isin(*SINGLE), _none(f"array<{TYPE}>")).otherwise(F.transform(s["parts"], lambda p: _shape(kind(p["dim"]), F.array(p))))


@_once
def typed(s: Column, kind: str) -> Column:
    """The parts of s that a collection of this kind can hold."""
    dim = KINDS[kind][0]
    if kind in SINGLE:
        raise ValueError(f"not a collection: {kind}")
    return F.when(s.isNotNull(), _shape(kind, F.filter(s["parts"], lambda p: F.lit(dim == -1) | (p["dim"] == dim))))


# what shapes are


def rings(s: Column) -> Column:
    return F.flatten(F.transform(s["parts"], lambda p: p["rings"]))


def points(s: Column) -> Column:
    return F.flatten(rings(s))


@_once
def dim(s: Column) -> Column:
    """The dimension that all parts have; null if there are several or none."""
    low, high = F.array_min(F.transform(s["parts"], lambda p: p["dim"])), F.array_max(F.transform(s["parts"], lambda p: p["dim"]))
    return F.when(low == high, low)


@_once
def is_empty(s: Column) -> Column:
    return F.coalesce(F.size(points(s)) <= 0, F.lit(True))


@_once
def component_count(s: Column) -> Column:
    """As a double; -1 for null, 1 for single shapes."""
    return F.when(s.isNull(), -1.0).when(s["kind"].isin(*SINGLE), 1.0).otherwise(F.size(s["parts"]).cast("double"))


@_once
def envelope(s: Column) -> Column:
    return g.envelope_of(points(s))


def segments(s: Column) -> Column:
    """All segments of lines and rings."""
    return F.flatten(F.transform(rings(s), g.segments))


@_once
def length(s: Column) -> Column:
    return F.coalesce(F.aggregate(rings(s), F.lit(0.0), lambda t, r: t + g.length(r)), F.lit(-1.0))


@_once
def area(s: Column) -> Column:
    return F.coalesce(F.aggregate(F.filter(s["parts"], lambda p: p["dim"] == 2), F.lit(0.0), lambda t, p: t + g.area(p["rings"])), F.lit(-1.0))


@_once
def centroid(s: Column) -> Column:
    """The centre of mass of the parts of the highest dimension, as a point; null for empty shapes."""
    top = F.array_max(F.transform(s["parts"], lambda p: p["dim"]))
    base = F.get(points(s), F.lit(0))  # sums about a point of the shape lose fewer digits, and are divided once
    weighed = lambda rows, share: F.aggregate(
        rows, F.expr("named_struct('w', 0D, 'x', 0D, 'y', 0D)"),
        lambda t, r: F.struct((t["w"] + r["w"]).alias("w"), (t["x"] + r["w"] * r["x"]).alias("x"), (t["y"] + r["w"] * r["y"]).alias("y")),
        lambda t: F.when(t["w"] != 0, g.point(base["x"] + t["x"] / (t["w"] * share), base["y"] + t["y"] / (t["w"] * share))),
    )
    mass = lambda w, x, y: F.struct(w.cast("double").alias("w"), x.alias("x"), y.alias("y"))
    off = lambda v, k: (v["a"][k] - base[k]) + (v["b"][k] - base[k])
    side = lambda v: v["a"]["x"] * 0 + g.distance(v["a"], v["b"])
    lines = F.transform(segments(s), lambda v: mass(side(v), off(v, "x"), off(v, "y")))
    cross = lambda v: (v["a"]["x"] - base["x"]) * (v["b"]["y"] - base["y"]) - (v["b"]["x"] - base["x"]) * (v["a"]["y"] - base["y"])

    def ring(r: Column, hole: Column) -> Column:
        turn = F.aggregate(g.segments(r), F.lit(0.0), lambda t, v: t + cross(v))
        sign = F.when(hole, -F.signum(turn)).otherwise(F.signum(turn))
        return F.transform(g.segments(r), lambda v: mass(cross(v) * sign, off(v, "x"), off(v, "y")))

    areas = F.flatten(F.transform(F.filter(s["parts"], lambda p: p["dim"] == 2), lambda p: F.flatten(F.transform(p["rings"], lambda r, i: ring(r, i > 0)))))
    dots = F.transform(points(s), lambda p: mass(F.lit(1.0), p["x"] - base["x"], p["y"] - base["y"]))
    return F.when(top == 2, weighed(areas, 3)).when(top == 1, weighed(lines, 2)).when(top == 0, weighed(dots, 1))


# where points lie


@_once
def _on(p: Column, v: Column) -> Column:
    a, b = v["a"], v["b"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    cross = dx * (p["y"] - a["y"]) - dy * (p["x"] - a["x"])
    scale = (F.abs(dx) + F.abs(dy)) * (F.abs(p["x"]) + F.abs(p["y"]) + F.abs(a["x"]) + F.abs(a["y"]) + 1)
    along = lambda c: p[c].between(F.least(a[c], b[c]) - (F.abs(p[c]) + 1) * TOLERANCE, F.greatest(a[c], b[c]) + (F.abs(p[c]) + 1) * TOLERANCE)
    return (F.abs(cross) <= scale * TOLERANCE) & along("x") & along("y")


def _same(p: Column, q: Column) -> Column:
    near = lambda c: F.abs(p[c] - q[c]) <= (F.abs(p[c]) + 1) * TOLERANCE
    return near("x") & near("y")


@_once
def line_ends(s: Column) -> Column:
    """The border of lines: ends that are an odd number of lines' end."""
    lines = F.filter(s["parts"], lambda p: p["dim"] == 1)
    ends = F.flatten(F.transform(lines, lambda p: F.array(F.get(F.get(p["rings"], F.lit(0)), F.lit(0)), F.element_at(F.get(p["rings"], F.lit(0)), -1))))
    return F.filter(ends, lambda p: F.size(F.filter(ends, lambda q: _same(p, q))) % 2 == 1)


@_once
def place(p: Column, s: Column) -> Column:
    """Where p lies: 'I' inside s, 'B' on its border, 'E' outside."""
    dots = F.exists(s["parts"], lambda t: (t["dim"] == 0) & F.exists(F.flatten(t["rings"]), lambda q: _same(p, q)))
    on_line = F.exists(s["parts"], lambda t: (t["dim"] == 1) & F.exists(t["rings"], lambda r: F.exists(g.segments(r), lambda v: _on(p, v))))
    on_edge = F.exists(s["parts"], lambda t: (t["dim"] == 2) & F.exists(t["rings"], lambda r: F.exists(g.segments(r), lambda v: _on(p, v))))
    within = F.exists(s["parts"], lambda t: (t["dim"] == 2) & g.inside(t["rings"], p))
    end = F.exists(line_ends(s), lambda q: _same(p, q))
    return F.when(on_edge, "B").when(within | dots, "I").when(on_line, F.when(end, "B").otherwise("I")).otherwise("E")


@_once
def _meeting(v: Column, w: Column) -> Column:
    """Shares of segment v (0..1) at which it meets w: the crossing, or the ends of a common stretch."""
    ax, ay = v["a"]["x"], v["a"]["y"]
    dx, dy = v["b"]["x"] - ax, v["b"]["y"] - ay
    ex, ey = w["b"]["x"] - w["a"]["x"], w["b"]["y"] - w["a"]["y"]
    cross = dx * ey - dy * ex
    rx, ry = w["a"]["x"] - ax, w["a"]["y"] - ay
    t, u = F.try_divide(rx * ey - ry * ex, cross), F.try_divide(rx * dy - ry * dx, cross)
    inner = lambda x: x.between(-TOLERANCE, 1 + TOLERANCE)
    share = lambda q: F.try_divide((q["x"] - ax) * dx + (q["y"] - ay) * dy, dx * dx + dy * dy)
    ends = F.transform(F.filter(F.array(w["a"], w["b"]), lambda q: _on(q, v)), share)
    parallel = F.abs(cross) <= (F.abs(dx) + F.abs(dy)) * (F.abs(ex) + F.abs(ey)) * TOLERANCE
    return F.when(parallel, ends).otherwise(F.when(inner(t) & inner(u), F.array(t)).otherwise(_none("array<double>")))


def _at(v: Column, t: Column) -> Column:
    return g.point(v["a"]["x"] + (v["b"]["x"] - v["a"]["x"]) * t, v["a"]["y"] + (v["b"]["y"] - v["a"]["y"]) * t)


@_once
def piece_middles(s: Column, other: Column) -> Column:
    """The middles of the pieces into which the segments of `other` cut the segments of s."""

    def of(v: Column) -> Column:
        cuts = F.flatten(F.transform(segments(other), lambda w: _meeting(v, w)))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(cuts, lambda t: (t > TOLERANCE) & (t < 1 - TOLERANCE)))))
        return F.get(F.transform(F.array(cuts), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: _at(v, (F.get(c, i) + F.get(c, i + 1)) / 2))), F.lit(0))

    solid = F.filter(segments(s), lambda v: ~_same(v["a"], v["b"]))
    return F.flatten(F.transform(solid, of))


@_once
def meeting_points(a: Column, b: Column) -> Column:
    """Where segments of a meet segments of b: crossings, and ends of common stretches."""
    return F.flatten(F.transform(segments(a), lambda v: F.flatten(F.transform(segments(b), lambda w: F.transform(_meeting(v, w), lambda t: _at(v, t))))))


@_once
def inner_points(s: Column) -> Column:
    """A point inside each polygon: between the first two edges that a line above its lowest corner crosses."""

    def of(rings_: Column) -> Column:
        ys = F.array_sort(F.array_distinct(F.transform(F.flatten(rings_), lambda p: p["y"])))
        y = (F.get(ys, F.lit(0)) + F.get(ys, F.lit(1))) / 2
        crossed = F.filter(F.flatten(F.transform(rings_, g.segments)), lambda v: (v["a"]["y"] > y) != (v["b"]["y"] > y))
        xs = F.array_sort(F.transform(crossed, lambda v: v["a"]["x"] + (v["b"]["x"] - v["a"]["x"]) * (y - v["a"]["y"]) / (v["b"]["y"] - v["a"]["y"])))
        return g.point((F.get(xs, F.lit(0)) + F.get(xs, F.lit(1))) / 2, y)

    found = F.transform(F.filter(s["parts"], lambda p: p["dim"] == 2), lambda p: of(p["rings"]))
    return F.filter(found, lambda p: p["x"].isNotNull())


def _places(sample: Column, s: Column) -> Column:
    return F.array_distinct(F.transform(sample, lambda p: place(p, s)))


@_once
def relation(a: Column, b: Column) -> Column:
    """struct<da, db, ab, ba, in_a, in_b, cross>: dimensions, where samples of a lie in b and of b in a, where points
    inside polygons lie, and where the meeting points of lines lie in both ('II' and so on)."""
    samples = lambda s, o: F.concat(F.flatten(F.transform(F.filter(s["parts"], lambda p: p["dim"] == 0), lambda p: F.flatten(p["rings"]))), piece_middles(s, o))
    cross = F.when((dim(a) == 1) & (dim(b) == 1), F.array_distinct(F.transform(meeting_points(a, b), lambda p: F.concat(place(p, a), place(p, b))))).otherwise(_none("array<string>"))
    return F.struct(
        dim(a).alias("da"), dim(b).alias("db"), _places(samples(a, b), b).alias("ab"), _places(samples(b, a), a).alias("ba"),
        _places(inner_points(a), b).alias("in_a"), _places(inner_points(b), a).alias("in_b"), cross.alias("cross"),
    )


def _judged(a: Column, b: Column, test) -> Column:
    """test(relation, insides meet, all of a in b, all of b in a), computed once; false for null or empty shapes."""

    def whole(r: Column) -> Column:
        has = lambda c, v: F.array_contains(r[c], v)
        area_in = has("in_a", "I") | has("in_b", "I")
        inner = F.when((r["da"] == 2) & (r["db"] == 2), has("ab", "I") | has("ba", "I") | area_in)
        inner = inner.when((r["da"] == 1) & (r["db"] == 1), has("ab", "I") | F.array_contains(r["cross"], "II"))
        inner = inner.otherwise(F.when(r["da"] <= r["db"], has("ab", "I")).otherwise(has("ba", "I")))
        a_in = ~has("ab", "E") & (r["da"] <= r["db"]) & F.when(r["da"] == 2, ~has("ba", "I") & ~has("in_a", "E") & has("in_a", "I")).otherwise(True)
        b_in = ~has("ba", "E") & (r["db"] <= r["da"]) & F.when(r["db"] == 2, ~has("ab", "I") & ~has("in_b", "E") & has("in_b", "I")).otherwise(True)
        return test(r, inner, a_in, b_in, has)

    known = ~is_empty(a) & ~is_empty(b)
    return F.when(known, F.get(F.transform(F.array(relation(a, b)), whole), F.lit(0))).otherwise(False)


@_once
def intersects(a: Column, b: Column) -> Column:
    """Whether the shapes share a point: segments that meet, or a point of one in or on the other."""
    meet = _let(segments(b), lambda others: F.exists(segments(a), lambda v: F.exists(others, lambda w: F.size(_meeting(v, w)) > 0)))
    firsts = lambda s: F.transform(s["parts"], lambda p: F.get(F.flatten(p["rings"]), F.lit(0)))
    held = lambda s, o: F.exists(firsts(s), lambda p: place(p, o) != "E")
    return F.coalesce(~is_empty(a) & ~is_empty(b) & (held(a, b) | held(b, a) | meet), F.lit(False))


#: Room for rounding within which `corners` and `edges` leave a case to the exact relations, well over TOLERANCE.
ROOM = 1e-11


@_once
def corners(s: Column) -> Column:
    """The corners, counter-clockwise, of a point, a line of two points, or a polygon of three or four corners that is
    convex and has no hole, as an array; null for all other shapes."""
    part = F.get(s["parts"], F.lit(0))

    def of(r: Column) -> Column:
        n = F.size(r) - 1
        at = lambda i: F.get(r, i % n)
        slack = lambda *ps: ROOM * F.abs(ps[0]["x"]) * 0 + ROOM * (sum((F.abs(p["x"]) + F.abs(p["y"]) for p in ps), F.lit(1.0))) * (F.abs(ps[1]["x"] - ps[0]["x"]) + F.abs(ps[1]["y"] - ps[0]["y"]))
        turns = lambda sign: F.forall(F.sequence(F.lit(0), n - 1), lambda i: _turn(at(i), at(i + 1), at(i + 2)) * sign > slack(at(i), at(i + 1), at(i + 2)))
        ring = F.slice(r, F.lit(1), F.greatest(n, F.lit(0)))
        closed = n.isin(3, 4) & (F.get(r, F.lit(0)) == F.element_at(r, -1))
        polygon = F.when(closed, F.when(turns(1), ring).when(turns(-1), F.reverse(ring)))
        known = F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        return F.when(known, F.when((part["dim"] == 0) & (n == 0), r).when((part["dim"] == 1) & (n == 1), r).when(part["dim"] == 2, polygon))

    return F.when((F.size(s["parts"]) == 1) & (F.size(part["rings"]) == 1), _let(F.get(part["rings"], F.lit(0)), of))


def fills_envelope(corners_: Column) -> Column:
    """Whether corners are those of a point or of an upright rectangle."""
    n = F.size(corners_)
    at = lambda i: F.get(corners_, F.lit(i))
    upright = lambda a, b: (a["x"] == b["x"]) | (a["y"] == b["y"])
    return F.coalesce((n == 1) | ((n == 4) & upright(at(0), at(1)) & upright(at(1), at(2)) & upright(at(2), at(3)) & upright(at(3), at(0))), F.lit(False))


@_once
def disjoint(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), False).otherwise(~intersects(a, b))


@_once
def within(a: Column, b: Column) -> Column:
    """All of a is in b, and not on its border only."""
    return _judged(a, b, lambda r, inner, a_in, b_in, has: a_in & inner)


@_once
def contains(a: Column, b: Column) -> Column:
    return within(b, a)


@_once
def equals(a: Column, b: Column) -> Column:
    """The same set of points; empty shapes are equal to empty shapes."""
    both = F.when(a.isNotNull() & b.isNotNull(), is_empty(a) & is_empty(b)).otherwise(False)
    return both | _judged(a, b, lambda r, inner, a_in, b_in, has: (r["da"] == r["db"]) & a_in & b_in)


@_once
def touches(a: Column, b: Column) -> Column:
    """Borders meet and insides do not."""
    return _judged(a, b, lambda r, inner, a_in, b_in, has: ~inner & ((r["da"] > 0) | (r["db"] > 0))) & intersects(a, b)


@_once
def crosses(a: Column, b: Column) -> Column:
    """Of two lines: insides meet at points only; otherwise the lower dimension is partly in and partly outside the higher."""

    def test(r, inner, a_in, b_in, has):
        lines = inner & ~has("ab", "I") & ~has("ba", "I")
        low, high = inner & has("ab", "E"), inner & has("ba", "E")
        return F.when((r["da"] == 1) & (r["db"] == 1), lines).when(r["da"] < r["db"], low).when(r["da"] > r["db"], high).otherwise(False)

    return _judged(a, b, test)


@_once
def overlaps(a: Column, b: Column) -> Column:
    """Of one dimension: they share some of it, and each has some of its own."""

    def test(r, inner, a_in, b_in, has):
        common = F.when(r["da"] == 1, has("ab", "I") | has("ab", "B")).otherwise(inner)
        return (r["da"] == r["db"]) & common & ~a_in & ~b_in

    return _judged(a, b, test)


# distances


@_once
def _point_segment(p: Column, v: Column) -> Column:
    dx, dy = v["b"]["x"] - v["a"]["x"], v["b"]["y"] - v["a"]["y"]
    t = F.coalesce(F.try_divide((p["x"] - v["a"]["x"]) * dx + (p["y"] - v["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    return g.distance(p, _at(v, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))))


@_once
def distance(a: Column, b: Column) -> Column:
    """Least planar distance; 0 if they meet, -1 for null, 0 if one is empty."""
    ends = lambda s, o: F.flatten(F.transform(points(s), lambda p: F.transform(segments(o), lambda v: _point_segment(p, v))))
    dots = F.flatten(F.transform(points(a), lambda p: F.transform(points(b), lambda q: g.distance(p, q))))
    apart = F.array_min(F.concat(dots, ends(a, b), ends(b, a)))
    return F.when(a.isNull() | b.isNull(), -1.0).when(is_empty(a) | is_empty(b), 0.0).when(intersects(a, b), 0.0).otherwise(apart)


@_once
def within_distance(a: Column, b: Column, d) -> Column:
    known = a.isNotNull() & b.isNotNull() & ~is_empty(a) & ~is_empty(b)
    return F.coalesce(known & (distance(a, b) <= d), F.lit(False))


# other shapes from shapes


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


@_once
def convex_hull(s: Column) -> Column:
    """The hull of all points, by two chains of sorted points: a polygon, or a line or point if they are in one."""
    dots = F.array_sort(F.array_distinct(points(s)))

    def chain(order: Column) -> Column:
        def push(acc: Column, p: Column) -> Column:
            # points that no longer turn left go: the last k for the least k that leaves a left turn
            n = F.size(acc)
            bad = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda k: (n - k >= 2) & (_turn(F.get(acc, n - k - 2), F.get(acc, n - k - 1), p) > 0))
            drop = F.coalesce(F.array_min(bad), F.greatest(n - 1, F.lit(0)))
            return F.array_append(F.slice(acc, F.lit(1), n - drop), p)

        return F.aggregate(order, _none(_POINTS), push)

    lower, upper = chain(dots), chain(F.reverse(dots))
    ring = F.concat(F.slice(lower, F.lit(1), F.greatest(F.size(lower) - 1, F.lit(0))), upper)
    hull = F.when(F.size(ring) > 3, of_polygon(F.array(ring))).otherwise(of_line(dots_ends(dots)))
    return F.when(s.isNull(), F.lit(None)).when(F.size(dots) == 0, empty()).when(F.size(dots) == 1, of_point(F.get(dots, F.lit(0)))).otherwise(hull)


def dots_ends(sorted_points: Column) -> Column:
    return F.array(F.get(sorted_points, F.lit(0)), F.element_at(sorted_points, -1))


@_once
def make_polygon(points_: Column, centre: Column | None = None) -> Column:
    """Points joined in the order of their angle about a centre (their mean), counted from the first point on; empty for none."""
    n = F.size(points_)
    mean = lambda c: F.aggregate(points_, F.lit(0.0), lambda t, p: t + p[c]) / n
    middle = centre if centre is not None else g.point(mean("x"), mean("y"))

    def joined(c: Column) -> Column:
        angle = lambda p: F.atan2(p["y"] - c["y"], p["x"] - c["x"])
        first = F.get(points_, F.lit(0))
        rows = F.array_sort(F.transform(points_, lambda p, i: F.struct(F.when(i == 0, 0.0).otherwise(F.pmod(angle(p) - angle(first), F.lit(6.283185307179586))).alias("turn"), i.alias("i"), p.alias("p"))))
        order = F.transform(rows, lambda r: r["p"])
        return F.concat(order, F.array(first))

    ring = F.get(F.transform(F.array(middle), joined), F.lit(0))
    return F.when(points_.isNull() | (n <= 0), empty("Polygon")).otherwise(of_polygon(F.array(ring)))


@_once
def remove_holes(s: Column, larger_than: float | None = None) -> Column:
    """Polygons without their holes, or with those only whose area is above a threshold."""

    def keep(p: Column) -> Column:
        shell = F.slice(p["rings"], 1, 1)
        holes = F.slice(p["rings"], 2, F.greatest(F.size(p["rings"]) - 1, F.lit(0)))
        left = F.filter(holes, lambda r: g.area(F.array(r)) > larger_than) if larger_than is not None else _none(f"array<{_POINTS}>")
        return F.when(p["dim"] == 2, F.struct(p["dim"].alias("dim"), F.concat(shell, left).alias("rings"))).otherwise(p)

    return F.when(s.isNotNull(), _shape(s["kind"], F.transform(s["parts"], keep)))


@_once
def simplify_line(line: Column, tolerance: float, turns: int = 24) -> Column:
    """Douglas-Peucker: the farthest point of each stretch stays while it is farther than the tolerance.

    Stretches are split all at once, `turns` times at most; a stretch still open then keeps all its points."""
    n = F.size(line)
    start = F.array(F.lit(0), n - 1)

    def split(kept: Column) -> Column:
        def farthest(i: Column) -> Column:
            x, y = F.get(kept, i), F.get(kept, i + 1)
            v = F.struct(F.get(line, x).alias("a"), F.get(line, y).alias("b"))
            far = F.array_max(F.transform(F.sequence(x, y), lambda j: F.struct(_point_segment(F.get(line, j), v).alias("d"), (-j).alias("j"))))
            return F.when((y - x > 1) & (far["d"] > tolerance), F.array(-far["j"])).otherwise(_none("array<int>"))

        more = F.flatten(F.transform(F.sequence(F.lit(0), F.size(kept) - 2), farthest))
        return F.array_sort(F.array_distinct(F.concat(kept, more)))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(turns)), start, lambda kept, _: split(kept))
    # what a further turn would still split stays whole
    rest = F.get(F.transform(F.array(done), lambda k: F.when(F.size(split(k)) == F.size(k), k).otherwise(F.sequence(F.lit(0), n - 1))), F.lit(0))
    return F.when(n < 3, line).otherwise(F.transform(rest, lambda i: F.get(line, i)))


@_once
def way_point(line: Column, d: Column) -> Column:
    """The point at a distance along a line, as a shape: the empty point beyond its end or before its start."""
    state = F.expr("named_struct('left', 0D, 'x', cast(null as double), 'y', cast(null as double))")
    start = F.struct(d.cast("double").alias("left"), state["x"].alias("x"), state["y"].alias("y"))

    def walk(s: Column, v: Column) -> Column:
        size = g.distance(v["a"], v["b"])
        here = s["x"].isNull() & (s["left"] <= size)
        t = F.coalesce(F.try_divide(s["left"], size), F.lit(0.0))
        q = _at(v, t)
        return F.struct(F.when(s["x"].isNull() & ~here, s["left"] - size).otherwise(s["left"]).alias("left"), F.when(here, q["x"]).otherwise(s["x"]).alias("x"), F.when(here, q["y"]).otherwise(s["y"]).alias("y"))

    found = F.aggregate(g.segments(line), start, walk)
    return F.when(line.isNotNull() & d.isNotNull(), F.when(d < 0, empty("Point")).otherwise(F.get(F.transform(F.array(found), lambda s: of_point(g.point(s["x"], s["y"]))), F.lit(0))))


def angle_between(a: Column, joint: Column, b: Column) -> Column:
    """Degrees between the lines from the joint to a and to b, 0 to 180; null if one has no length."""
    ux, uy, vx, vy = a["x"] - joint["x"], a["y"] - joint["y"], b["x"] - joint["x"], b["y"] - joint["y"]
    cosine = F.try_divide(ux * vx + uy * vy, F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def angle_360(a: Column, b: Column) -> Column:
    """Degrees of the line from a to b in [0, 360), counted from west over south: its x axis is mirrored."""
    return F.pmod(F.degrees(F.atan2(b["y"] - a["y"], a["x"] - b["x"])), F.lit(360.0))
