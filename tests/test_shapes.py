"""Shapes against the geometry library that Spark ships, and joins on envelopes of any size."""

import math

import pytest
from pyspark.sql import functions as F

from geosluice import shape_queries
from geosluice.functions import codecs as c
from geosluice.functions import geometry as g
from geosluice.functions import shapes as sh
from geosluice.plans import spatial_join as sj

TEXTS = [
    "POINT (1 1)",
    "POINT (4 4)",
    "MULTIPOINT ((0 0), (4 0), (4 4))",
    "LINESTRING (0 0, 4 4)",
    "LINESTRING (0 2, 4 2)",
    "LINESTRING (2 0, 2 4)",
    "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))",
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))",
    "POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))",
    "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))",
    "POLYGON ((0 0, 8 0, 8 8, 0 8, 0 0), (2 2, 6 2, 6 6, 2 6, 2 2))",
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))",
]
EMPTY = ["POINT EMPTY", "LINESTRING EMPTY", "POLYGON EMPTY"]
RELATIONS = {"intersects": sh.intersects, "disjoint": sh.disjoint, "touches": sh.touches, "crosses": sh.crosses, "within": sh.within, "contains": sh.contains, "overlaps": sh.overlaps, "equals": sh.equals}


@pytest.fixture(scope="module")
def shapes(spark, tmp_path_factory):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, *EMPTY, None])], "i int, t string")
    path = str(tmp_path_factory.mktemp("shapes") / "s")
    rows.select("i", "t", c.from_text(F.col("t")).alias("s")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def library(spark):
    jts = spark._jvm.org.locationtech.jts
    return [jts.io.WKTReader().read(t) for t in TEXTS]


@pytest.mark.parametrize("name", [*(n for n in RELATIONS if n not in ("disjoint", "contains")), "distance"])  # those two are others the other way round
def test_relations(spark, shapes, library, name):
    pairs = shapes.select(F.col("i").alias("x"), F.col("s").alias("a")).crossJoin(shapes.select(F.col("i").alias("y"), F.col("s").alias("b")))
    value = sh.distance(F.col("a"), F.col("b")) if name == "distance" else RELATIONS[name](F.col("a"), F.col("b"))
    got = {(r.x, r.y): r.v for r in pairs.select("x", "y", value.alias("v")).collect()}
    n = len(TEXTS)
    for (x, y), v in got.items():
        if x < n and y < n:
            want = getattr(library[x], "equalsTopo" if name == "equals" else name)(library[y])
            assert v == want if name != "distance" else abs(v - want) < 1e-12, (TEXTS[x], TEXTS[y], v, want)
        elif n + len(EMPTY) in (x, y):
            assert v == (-1.0 if name == "distance" else False), (x, y, v)
        else:  # an empty one
            assert v == {"distance": 0.0, "disjoint": True, "equals": x >= n and y >= n}.get(name, False), (x, y, v)


def test_measures_and_codecs(spark, shapes, library):
    writer = spark._jvm.org.locationtech.jts.io.WKBWriter(2, 2)
    s = F.col("s")
    both = shapes.select("i", sh.area(s).alias("area"), sh.length(s).alias("length"), sh.centroid(s).alias("m"), sh.area(sh.convex_hull(s)).alias("hull"), c.as_text(s).alias("text"), c.as_hex(s).alias("hex"))
    again = shapes.select("i", c.as_text(c.from_hex(c.as_hex(s))).alias("by_hex"), c.as_text(c.from_json(c.as_json(s))).alias("by_json"))
    for r in both.join(again, "i").collect():
        if r.i >= len(TEXTS):
            assert r.area == (0.0 if r.i < len(TEXTS) + len(EMPTY) else -1.0) and r.hex == ("" if r.i < len(TEXTS) + len(EMPTY) else None)
            continue
        own = library[r.i]
        assert (abs(r.area - own.getArea()), abs(r.length - own.getLength())) < (1e-9, 1e-9)
        assert abs(r.m.x - own.getCentroid().getX()) + abs(r.m.y - own.getCentroid().getY()) < 1e-9
        assert abs(r.hull - own.convexHull().getArea()) < 1e-9
        assert r.text == r.by_hex == r.by_json == TEXTS[r.i]
        assert r.hex == bytes(writer.write(own)).hex().upper()


def test_binary_of_any_double(spark):
    import struct

    numbers = [0.0, -0.0, 1.0, -1.5, 0.1, 1 / 3, 1e-300, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 127.0009765625, math.pi, 2.0**52 + 1, 1 - 2.0**-53]
    df = spark.createDataFrame([(x, -x) for x in numbers], "x double, y double")
    shape = sh.of_point(g.point(F.col("x"), F.col("y")))
    for r in df.select("x", "y", c.as_hex(shape).alias("h"), c.from_hex(c.as_hex(shape)).alias("s")).collect():
        assert bytes.fromhex(r.h) == b"\x01\x01\x00\x00\x00" + struct.pack("<dd", r.x, r.y), r.x
        assert (r.s.parts[0].rings[0][0].x, r.s.parts[0].rings[0][0].y) == (r.x, r.y)
    big = "00" + "00000001" + struct.pack(">dd", 2.5, -7.25).hex()
    assert spark.range(1).select(c.as_text(c.from_hex(F.lit(big)))).first()[0] == "POINT (2.5 -7.25)"


def test_broken_texts(spark):
    one = lambda x: spark.range(1).select(x.alias("v")).first()["v"]
    for t in ("{", "[]", '{"type":"Point"}', '{"type":"Point","coordinates":["a",1]}', "1"):
        assert one(c.from_json(F.lit(t))) is None, t
    for t in ("POINT 1 1", "POLYGON (1 1)", "CIRCLE (1 1)", ""):
        with pytest.raises(Exception, match="not a shape"):
            one(c.from_text(F.lit(t)))
    assert one(c.as_text(c.from_text(F.lit("geometrycollection (point (1 1), linestring(0 0,4 4))")))) == "GEOMETRYCOLLECTION (POINT (1 1), LINESTRING (0 0, 4 4))"


def boxes(spark, rows, name):
    df = spark.createDataFrame(rows, "id int, minx double, miny double, maxx double, maxy double")
    return df.select(F.col("id").alias(name), g.envelope(*map(F.col, sj.SIDES)).alias(f"{name}_box"))


def test_join_survives_boxes_of_any_size(spark):
    """One huge box with close points, tall and flat boxes, far outliers, and coordinates that are no numbers."""
    near = [(i, 5 + i * 1e-4, 5 + i * 1e-4, 5 + i * 1e-4, 5 + i * 1e-4) for i in range(100)]
    odd = [(200, 0.0, -1e6, 0.001, 1e6), (201, -1e9, 0.0, 1e9, 0.0), (202, 1e300, 1e300, 1e300, 1e300), (203, float("nan"), 0.0, 1.0, 1.0), (204, 0.0, 0.0, float("inf"), 1.0), (205, None, 0.0, 1.0, 1.0), (206, 2.0, 2.0, 1.0, 1.0)]
    big = [(300, -1000.0, -1000.0, 1000.0, 1000.0), (301, 5.0, 5.0, 5.0005, 5.0005), (302, -1e300, -1e300, 1e300, 1e300)]
    rows = [near + odd, big + odd + near[:3]]
    a, b = boxes(spark, rows[0], "l"), boxes(spark, rows[1], "r")
    sound = lambda r: all(v is not None and math.isfinite(v) for v in r[1:]) and r[1] <= r[3] and r[2] <= r[4]
    want = sorted((x[0], y[0]) for x in rows[0] for y in rows[1] if sound(x) and sound(y) and x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4])
    for cell in (None, 0.01, 7.0):
        assert sorted((r.l, r.r) for r in sj.intersects_join(a, b, "l_box", "r_box", cell).collect()) == want


def test_relation_texts():
    assert sj.parse_relation(None)[1] == sj.parse_relation(" Intersects ")[1] == 0.0 and sj.parse_relation("within_distance( 2.5 )")[1] == 2.5
    for bad in ("contains", "within_distance()", "within_distance(-1)", "within_distance(x)"):
        with pytest.raises(ValueError):
            sj.parse_relation(bad)


def test_simplify_and_way_point(spark):
    at = lambda *p: F.array(*[g.point(F.lit(float(x)), F.lit(float(y))) for x, y in p])
    line = at((0, 0), (1, 0.1), (2, -0.1), (3, 5), (4, 6), (5, 7), (6, 8.1), (7, 9), (8, 9), (9, 9))
    one = lambda x: spark.range(1).select(x.alias("v")).first()["v"]
    jts = spark._jvm.org.locationtech.jts
    own = jts.io.WKTReader().read("LINESTRING (0 0, 1 0.1, 2 -0.1, 3 5, 4 6, 5 7, 6 8.1, 7 9, 8 9, 9 9)")
    want = [(p.getX(), p.getY()) for p in jts.simplify.DouglasPeuckerSimplifier.simplify(own, 1.0).getCoordinates()]
    assert [(p.x, p.y) for p in one(sh.simplify_line(line, 1.0))] == want
    assert one(c.as_text(sh.way_point(at((0, 0), (3, 4), (3, 10)), F.lit(8.0)))) == "POINT (3 7)" and one(c.as_text(sh.way_point(at((0, 0), (3, 4)), F.lit(5.5)))) == "POINT EMPTY"


def test_centroid_of_ties(spark):
    """Centres that end in a five at the seventh digit come out whole: rounded, they went to the wrong side before."""
    z = spark.range(1, 2000).select(F.col("id").alias("zone_id"), (F.lit(126.0) + F.col("id") * 613 % 4096 / 1024).alias("cx"), (F.lit(33.0) + F.col("id") * 997 % 6144 / 1024).alias("cy"), ((F.col("id") % 7 + 1) / 16).alias("hw"), ((F.col("id") % 5 + 1) / 16).alias("hh"))
    z = z.select("cx", "cy", (F.col("cx") - F.col("hw")).alias("minx"), (F.col("cy") - F.col("hh")).alias("miny"), (F.col("cx") + F.col("hw")).alias("maxx"), (F.col("cy") + F.col("hh")).alias("maxy"))
    middle = sh.centroid(shape_queries._with_hole())
    assert z.where((middle["x"] != F.col("cx")) | (middle["y"] != F.col("cy"))).count() == 0


def _scene(spark, name, n, seed):
    """Points, lines, triangles and squares on a coarse grid, so that many touch; every shape three times."""
    at = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id") % (n // 3)), F.lit(9)).cast("double")
    p, q, r = (g.point(at(k), at(k + 1)) for k in (0, 2, 4))
    square = sh.of_envelope(g.envelope(at(0), at(1), at(0) + at(2) / 4 + 1, at(1) + at(3) / 4 + 1))
    kind = F.col("id") % (n // 3) % 4
    shape = F.when(kind == 0, sh.of_point(p)).when(kind == 1, sh.of_line(F.array(p, q))).when(kind == 2, sh.of_polygon(F.array(F.array(p, q, r, p)))).otherwise(square)
    return spark.range(n).select(F.col("id").alias(f"{name}_id"), shape.alias(f"{name}_shape"))


@pytest.mark.parametrize("relation", ["intersects", "within_distance(1.0)"])
def test_join_of_copies_in_blocks(spark, monkeypatch, tmp_path, relation):
    """Copies in several arrays, cells in several blocks and shapes told apart by their edges: the pairs of the plain relation."""
    monkeypatch.setattr(sj, "COPIES", 2)
    monkeypatch.setattr(sj, "BLOCK", 8)
    monkeypatch.setattr(sj, "TASK_PAIRS", 1000)
    for name, seed in (("a", 1), ("b", 2)):
        _scene(spark, name, 120, seed).write.parquet(str(tmp_path / name))
    a, b = (spark.read.parquet(str(tmp_path / name)) for name in "ab")
    got = sorted(tuple(r) for r in sj.shape_join(a, b, "a_shape", "b_shape", relation).select("a_id", "b_id").collect())
    test = sj.parse_relation(relation)
    exact = (lambda x, y: sh.intersects(x, y)) if relation == "intersects" else (lambda x, y: sh.within_distance(x, y, test[1]))
    want = sorted(tuple(r) for r in a.crossJoin(b).where(exact(F.col("a_shape"), F.col("b_shape"))).select("a_id", "b_id").collect())
    assert got == want and len(got) > 500


def test_copies_are_joined_once(spark, monkeypatch):
    """3000 points at 30 places beside 100 boxes: rows that meet in cells stay below those of places."""
    seen = []
    real = sj._blocks
    monkeypatch.setattr(sj, "_blocks", lambda a, b: seen.append(a.count()) or real(a, b))
    p = spark.range(3000).select(F.col("id").alias("p"), g.envelope(F.col("id") % 30, F.col("id") % 7 + F.col("id") % 30 * 0, F.col("id") % 30, F.col("id") % 7 + F.col("id") % 30 * 0).alias("p_box"))
    z = spark.range(100).select(F.col("id").alias("z"), g.envelope(F.col("id") % 25, F.lit(0), F.col("id") % 25 + 3, F.lit(4)).alias("z_box"))
    want = p.join(z, g.meets(F.col("p_box"), F.col("z_box")))
    assert sj.intersects_join(p, z, "p_box", "z_box").select("p", "z").exceptAll(want.select("p", "z")).count() == 0
    assert sj.intersects_join(p, z, "p_box", "z_box").count() == want.count()
    assert max(seen) <= 210 * 10
    counts = {r.z: r.n for r in sj.count_intersecting(p, z, "p_box", "z_box", "z", "n").collect()}
    assert counts == {r.z: r["count"] for r in want.groupBy("z").count().collect()}


def test_later_within(spark, monkeypatch):
    monkeypatch.setattr(sj, "COPIES", 4)
    place = lambda i: ((i * 7) % 10 / 4, (i * 3) % 5 / 4)
    rows = [(i % 590, place(i % 590)) for i in range(600)]
    df = spark.createDataFrame([(i, *xy) for i, xy in rows], "id long, x double, y double").select("id", g.point(F.col("x"), F.col("y")).alias("pt"))
    want = {}
    for i, (x, y) in rows:
        n = sum(j > i and (x - u) ** 2 + (y - v) ** 2 <= 0.25 for j, (u, v) in rows)
        if n:
            want[i] = want.get(i, 0) + n
    assert {r.id: r.n for r in sj.count_later_within(df, "id", "pt", 0.5, "n").collect()} == want
