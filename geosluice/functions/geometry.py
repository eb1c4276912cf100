"""Planar geometry on nested columns, as Column expressions.

A point is struct<x, y>, a line array<point>, a polygon array<ring> with the
shell first and closed rings, an envelope struct<minx, miny, maxx, maxy>.
Nothing leaves the JVM, and Parquet statistics work on envelope fields."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def envelope(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((minx, "minx"), (miny, "miny"), (maxx, "maxx"), (maxy, "maxy"))])


def polygon_of(e: Column) -> Column:
    """An envelope as a polygon of five points."""
    corners = (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))
    return F.array(F.array(*[point(e[a], e[b]) for a, b in corners]))


def envelope_of(points: Column) -> Column:
    """The envelope of a line or ring; null if it has no points."""
    low = lambda k: F.array_min(F.transform(points, lambda p: p[k]))
    high = lambda k: F.array_max(F.transform(points, lambda p: p[k]))
    return F.when(F.size(points) > 0, envelope(low("x"), low("y"), high("x"), high("y")))


def expand(e: Column, d) -> Column:
    return envelope(e["minx"] - d, e["miny"] - d, e["maxx"] + d, e["maxy"] + d)


def meets(a: Column, b: Column) -> Column:
    """Envelopes with a point in common, borders included; null counts as no."""
    return F.coalesce((a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"]), F.lit(False))


def overlaps_area(a: Column, b: Column) -> Column:
    return F.coalesce((a["minx"] < b["maxx"]) & (b["minx"] < a["maxx"]) & (a["miny"] < b["maxy"]) & (b["miny"] < a["maxy"]), F.lit(False))


def covers(a: Column, b: Column) -> Column:
    return F.coalesce((a["minx"] <= b["minx"]) & (a["maxx"] >= b["maxx"]) & (a["miny"] <= b["miny"]) & (a["maxy"] >= b["maxy"]), F.lit(False))


def intersection(a: Column, b: Column) -> Column:
    """The common part of two envelopes; null if there is none."""
    return F.when(meets(a, b), envelope(F.greatest(a["minx"], b["minx"]), F.greatest(a["miny"], b["miny"]), F.least(a["maxx"], b["maxx"]), F.least(a["maxy"], b["maxy"])))


def envelope_area(e: Column) -> Column:
    return (e["maxx"] - e["minx"]) * (e["maxy"] - e["miny"])


def centre(e: Column) -> Column:
    return point((e["minx"] + e["maxx"]) / 2, (e["miny"] + e["maxy"]) / 2)


def distance(a: Column, b: Column) -> Column:
    """Of two points; -1 if either is null."""
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(-1.0))


def within_distance(a: Column, b: Column, d) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.coalesce(dx * dx + dy * dy <= d * d, F.lit(False))


def segments(line: Column) -> Column:
    """Consecutive pairs of points."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length(line: Column) -> Column:
    """-1 for null."""
    return F.coalesce(F.aggregate(segments(line), F.lit(0.0), lambda t, s: t + distance(s["a"], s["b"])), F.lit(-1.0))


def _doubled(ring: Column) -> Column:
    return F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])


def area(polygon: Column) -> Column:
    """The shell's area less its holes'; -1 for null."""
    rings = F.transform(polygon, lambda r: F.abs(_doubled(r)) / 2)
    holes = F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda t, x: t + x)
    return F.coalesce(F.get(rings, F.lit(0)) - holes, F.lit(-1.0))


def centroid(ring: Column) -> Column:
    """Centre of mass of a ring's inside; null if it has no area."""
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    total = lambda k: F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + (s["a"][k] + s["b"][k]) * cross(s))
    a = _doubled(ring)
    return F.when(a != 0, point(total("x") / (a * 3), total("y") / (a * 3)))


def _on(p: Column, s: Column) -> Column:
    a, b = s["a"], s["b"]
    cross = (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
    return (cross == 0) & p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def _crosses(p: Column, s: Column) -> Column:
    """Whether a ray to the right of p crosses the segment; each end counts for the lower side only."""
    a, b = s["a"], s["b"]
    spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
    side = (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
    return spans & F.when(b["y"] > a["y"], side > 0).otherwise(side < 0)


def on_border(polygon: Column, p: Column) -> Column:
    return F.coalesce(F.exists(polygon, lambda r: F.exists(segments(r), lambda s: _on(p, s))), F.lit(False))


def inside(polygon: Column, p: Column) -> Column:
    """Strictly inside, by the parity of ray crossings over all rings; null counts as no."""
    count = F.aggregate(polygon, F.lit(0), lambda t, r: t + F.size(F.filter(segments(r), lambda s: _crosses(p, s))))
    return F.coalesce((count % 2 == 1) & ~on_border(polygon, p), F.lit(False))


def intersects(polygon: Column, p: Column) -> Column:
    return inside(polygon, p) | on_border(polygon, p)


def closest_point(p: Column, line: Column) -> Column:
    """The point of a line nearest to p: p projected on each segment, clamped to it; first of equals."""

    def foot(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        t = F.coalesce(F.try_divide((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        q = point(s["a"]["x"] + t * dx, s["a"]["y"] + t * dy)
        return F.struct(distance(p, q).alias("d"), q.alias("q"))

    feet = F.transform(segments(line), foot)
    best = F.array_min(F.transform(feet, lambda f: f["d"]))
    return F.get(F.filter(feet, lambda f: f["d"] == best), F.lit(0))["q"]


def point_text(p: Column) -> Column:
    """WKT of a point; numbers as Spark prints doubles."""
    return F.concat(F.lit("POINT ("), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"), F.lit(")"))


def line_text(line: Column) -> Column:
    inner = F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    return F.when(F.size(line) == 0, F.lit("LINESTRING EMPTY")).otherwise(F.concat(F.lit("LINESTRING ("), inner, F.lit(")")))


def point_from_text(text: Column) -> Column:
    """A point from WKT; null for null, an empty point or other text."""
    n = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    found = F.regexp_extract(text, rf"^\s*POINT\s*\(\s*{n}\s+{n}\s*\)\s*$", 1), F.regexp_extract(text, rf"^\s*POINT\s*\(\s*{n}\s+{n}\s*\)\s*$", 2)
    return F.when(F.length(found[0]) > 0, point(*found))


def point_json(p: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(p["x"], p["y"]).alias("coordinates")))


def envelope_text(e: Column) -> Column:
    """minx;miny;maxx;maxy, empty for null."""
    return F.when(e.isNull(), F.lit("")).otherwise(F.concat_ws(";", *[e[k].cast("string") for k in ("minx", "miny", "maxx", "maxy")]))


def envelope_from_text(text: Column) -> Column:
    parts = F.split(text, ";")
    return F.when(F.length(text) > 0, envelope(*[F.get(parts, F.lit(i)) for i in range(4)]))


def bearing(a: Column, b: Column) -> Column:
    """Degrees from north, clockwise, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(b["x"] - a["x"], b["y"] - a["y"])), F.lit(360.0))


def gradient(a: Column, b: Column) -> Column:
    """Degrees in [0, 360) of the line from a to b: due south 0, east 90, north 180, west 270."""
    return F.pmod(F.degrees(F.atan2(b["x"] - a["x"], a["y"] - b["y"])), F.lit(360.0))


EARTH_RADIUS = 6_371_008.8


def geodesic_distance(a: Column, b: Column) -> Column:
    """Great-circle metres between lon/lat points on a sphere of mean radius, up to about 0.6 % off the ellipsoid's."""
    rad = math.pi / 180
    h = F.pow(F.sin((b["y"] - a["y"]) * (rad / 2)), 2) + F.cos(a["y"] * rad) * F.cos(b["y"] * rad) * F.pow(F.sin((b["x"] - a["x"]) * (rad / 2)), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * EARTH_RADIUS)


#: WGS 84, and Vincenty's steps: all but nearly antipodal points need under ten.
MAJOR_AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563
VINCENTY_STEPS = 20


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ellipsoid_distance(a: Column, b: Column) -> Column:
    """Metres between lon/lat points along the geodesic of WGS 84, by Vincenty's inverse formula.

    Null for nearly antipodal points, where it does not converge."""
    rad, f = math.pi / 180, FLATTENING
    reduced = lambda p: F.atan(F.tan(p["y"] * rad) * (1 - f))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))

    def arc(g: Column, lam: Column, body) -> Column:
        """body of sin, cos and size of the arc between the points, cos^2 of the azimuth at the equator, and cos of twice the middle."""
        s, c = g["cu"] * F.sin(lam), g["du"] * g["su"] - g["eu"] * g["cu"] * F.cos(lam)
        first = F.struct(F.sqrt(s * s + c * c).alias("sin"), (g["eu"] * g["su"] + g["du"] * g["cu"] * F.cos(lam)).alias("cos"))
        second = lambda v: F.struct(v["sin"].alias("sin"), v["cos"].alias("cos"), ratio(g["du"] * g["cu"] * F.sin(lam), v["sin"]).alias("azimuth"))
        third = lambda v: F.struct(
            v["sin"].alias("sin"), v["cos"].alias("cos"), v["azimuth"].alias("azimuth"), F.atan2(v["sin"], v["cos"]).alias("size"), (1 - v["azimuth"] * v["azimuth"]).alias("c2"),
            (v["cos"] - ratio(2 * g["eu"] * g["su"], 1 - v["azimuth"] * v["azimuth"])).alias("mid"),
        )
        return _let(first, lambda v: _let(second(v), lambda w: _let(third(w), body)))

    def step(g: Column, state: Column) -> Column:
        def turned(v: Column) -> Column:
            k = v["c2"] * (4 + f * (4 - 3 * v["c2"])) * (f / 16)
            more = v["size"] + k * v["sin"] * (v["mid"] + k * v["cos"] * (2 * v["mid"] * v["mid"] - 1))
            return F.struct((g["l"] + (1 - k) * f * v["azimuth"] * more).alias("lam"), state["lam"].alias("before"))

        return arc(g, state["lam"], turned)

    def metres(v: Column) -> Column:
        minor = MAJOR_AXIS * (1 - f)
        u = v["c2"] * ((MAJOR_AXIS**2 - minor**2) / minor**2)
        p = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        q = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m = v["mid"]
        bent = q * v["sin"] * (m + q / 4 * (v["cos"] * (2 * m * m - 1) - q / 6 * m * (4 * v["sin"] * v["sin"] - 3) * (4 * m * m - 3)))
        return minor * p * (v["size"] - bent)

    def whole(g: Column) -> Column:
        start = F.struct(g["l"].alias("lam"), F.lit(9.0).alias("before"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(VINCENTY_STEPS)), start, lambda state, _: step(g, state))
        return _let(end, lambda e: F.when((F.abs(e["lam"] - e["before"]) < 1e-12) & (F.abs(e["lam"]) <= math.pi), arc(g, e["lam"], metres)))

    u, v = reduced(a), reduced(b)
    # du, eu: cos and sin of the first reduced latitude, cu, su: of the second
    given = F.struct(
        ((F.pmod(b["x"] - a["x"] + 180, F.lit(360.0)) - 180) * rad).alias("l"), F.cos(u).alias("du"), F.sin(u).alias("eu"), F.cos(v).alias("cu"), F.sin(v).alias("su"),
    )
    return _let(given, whole)
