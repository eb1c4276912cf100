import math

import pytest
from pyspark.sql import functions as F

from geosluice.functions import geometry as g
from geosluice.functions import scalar as s
from geosluice.functions import tiles as t
from geosluice.operators import clusters, columns, keys
from geosluice.plans import spatial_join as sj
from geosluice.sources.datasets import Catalog, normal_id
from geosluice.sources.text import read_text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_selection_language():
    schema = {"": ["a", "B", "c"]}
    assert columns.resolve("*-{b, nothing}", schema) == [("", "a", "a"), ("", "c", "c")]
    assert columns.resolve("a as x, *, A", schema)[0] == ("", "a", "x")
    assert columns.resolve("", schema) == []
    assert columns.resolve("l.{p as q}, r.*", {"l": ["p"], "r": ["z"]}) == [("l", "p", "q"), ("r", "z", "z")]
    for bad in ("a,", "a b", "x", "{a", "q.a", "a;"):
        with pytest.raises(columns.SelectionError):
            columns.resolve(bad, schema)


def test_keys_place_nulls(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "a int")
    order = lambda k: [r[0] for r in df.orderBy(*keys.ordering(k)).collect()]
    assert order("a") == [1, 2, None] and order("a:DESC") == [2, 1, None]
    assert order("a:ASC:FIRST") == [None, 1, 2] and order("a:D:L") == [None, 2, 1]
    assert keys.complement("A", ["a", "b"]) == ["b"]


def test_rounding_and_text(spark):
    assert one(spark, s.round_half_up(F.lit(-2.5), 0)) == -2.0
    assert one(spark, s.from_csv(F.lit("a\\,b,c"))) == ["a,b", "c"]
    assert one(spark, s.union_csv(F.lit(None).cast("string"), F.lit("b,a"))) == "a,b"


def test_polygon_with_hole(spark):
    ring = lambda *p: F.array(*[g.point(F.lit(x), F.lit(y)) for x, y in p])
    shape = F.array(ring((0, 0), (8, 0), (8, 8), (0, 8), (0, 0)), ring((2, 2), (6, 2), (6, 6), (2, 6), (2, 2)))
    at = lambda x, y: g.point(F.lit(x), F.lit(y))
    assert one(spark, g.area(shape)) == 48.0
    assert [one(spark, g.inside(shape, at(*p))) for p in ((1, 1), (4, 4), (0, 4), (2, 3), (9, 9))] == [True, False, False, False, False]
    assert one(spark, g.intersects(shape, at(2, 3))) and one(spark, g.area(F.lit(None).cast("array<array<struct<x:double,y:double>>>"))) == -1.0


def test_join_takes_any_coordinates(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 500.0, 500.0, 501.0, 501.0), (3, None, None, None, None)], "a int, x double, y double, u double, v double")
    b = spark.createDataFrame([(7, 1.0, 1.0, 2.0, 2.0), (8, -900.0, 400.0, 900.0, 600.0)], "b int, p double, q double, r double, t double")
    a, b = a.select("a", g.envelope(*map(F.col, "xyuv")).alias("la")), b.select("b", g.envelope(*map(F.col, "pqrt")).alias("rb"))
    for cell in (0.5, 3.0, 1000.0):
        assert sorted((r.a, r.b) for r in sj.intersects_join(a, b, "la", "rb", cell).collect()) == [(1, 7), (2, 8)]


def test_clusters_own_each_row_once(spark, tmp_path):
    boxes = spark.range(40).select("id", g.envelope(*[F.col("id") * k + o for k, o in ((3, 0), (1, 0), (3, 4), (1, 3))]).alias("box"))
    attached = clusters.attach_quadkey(boxes, "box", 6)
    assert attached.where("__owned").count() == 40 and attached.count() > 40
    clusters.store(boxes, "box", str(tmp_path / "c"), 6)
    hit = clusters.range_query(spark, str(tmp_path / "c"), 10.0, 2.0, 50.0, 20.0, 6)
    assert sorted(r.id for r in hit.collect()) == [i for i in range(40) if 3 * i <= 50 and 3 * i + 4 >= 10 and i <= 20 and i + 3 >= 2]


def test_ellipsoid_distance(spark):
    """Against the geodesic's differential equations, carried on in small steps from a point and an azimuth."""
    major, f = 6_378_137.0, 1 / 298.257223563
    e2 = f * (2 - f)

    def rate(y):
        w = 1 - e2 * math.sin(y[0]) ** 2
        across, along = major / math.sqrt(w), major * (1 - e2) / w**1.5
        return math.cos(y[2]) / along, math.sin(y[2]) / (across * math.cos(y[0])), math.sin(y[2]) * math.tan(y[0]) / across

    rows = [(127.0, 34.0, 127.0, 34.0, 0.0), (0.0, 0.0, 0.0, 90.0, 10_001_965.729), (179.5, 0.0, -179.5, 0.0, 111_319.491)]
    for lon, lat, azimuth, metres in ((127.0, 34.0, 30.0, 1e5), (127.0, 34.0, 0.0, 5e5), (-70.0, -40.0, 100.0, 4e6), (179.0, 10.0, 80.0, 9e6), (10.0, 1.0, 90.0, 1e6), (0.0, 60.0, 250.0, 200.0)):
        y, n = [math.radians(v) for v in (lat, lon, azimuth)], 2000
        h = metres / n
        for _ in range(n):
            k1 = rate(y)
            k2 = rate([v + h / 2 * k for v, k in zip(y, k1)])
            k3 = rate([v + h / 2 * k for v, k in zip(y, k2)])
            k4 = rate([v + h * k for v, k in zip(y, k3)])
            y = [v + h / 6 * (p + 2 * q + 2 * r + s) for v, p, q, r, s in zip(y, k1, k2, k3, k4)]
        rows.append((lon, lat, math.degrees(y[1]), math.degrees(y[0]), metres))
    rows += [(0.0, 0.0, 179.9, 0.1, None), (None, 0.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, want double")
    got = df.select("want", g.ellipsoid_distance(g.point(F.col("a"), F.col("b")), g.point(F.col("c"), F.col("d"))).alias("v")).collect()
    assert all(r.v is None if r.want is None else abs(r.v - r.want) < 1e-3 for r in got), got


def test_quadkey(spark):
    key = t.quadkey(t.tile_x(F.lit(127.0), 8), t.tile_y(F.lit(37.5), 8), 8)
    assert one(spark, key) == "13211032"
    assert tuple(one(spark, t.tile_of(key))) == (8, 218, 99)


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    c.create("a/b/x/", spark.range(3), codec="gz")
    assert normal_id(" a/b/x/ ") == "/a/b/x" and c.get("/a/b/x")["count"] == 3
    for bad in ("a/b/x", "/a/b", "a/b/x/y"):
        with pytest.raises(ValueError):
            c.create(bad, spark.range(1))
    assert c.folders("/") == ["a"] and c.listed("/a") == ["/a/b/x"] and c.listed("/a", recursive=False) == []
    c.save()
    assert Catalog.open(spark, str(tmp_path / "cat")).read("a/b/x").count() == 3
    assert c.delete("a/b/x") and not c.delete("a/b/x")


def test_text_source(spark, tmp_path):
    (tmp_path / "t.txt").write_text("#x\na\n")
    assert [r.text for r in read_text(spark, str(tmp_path / "t.txt"), "#").collect()] == ["a"]


def test_names_in_sql(spark):
    from geosluice.functions import names

    assert len(names.register(spark)) == len(names.FUNCTIONS)
    row = spark.sql(
        "SELECT ST_Distance(ST_Point(0, 0), ST_Point(3, 4)) a, ST_DWithin(NULL, ST_Point(0, 0), 1) b, RoundHalfUp(-2.5, 0) c, DateWeekDay(DATE'2024-01-07') d,"
        " ST_ArrayAvg(array(1, 2)) e, DateFromMillis(-1) f, ST_TRDuration(array(named_struct('x', 1, 'y', 1, 'ts', 5), named_struct('x', 1, 'y', 1, 'ts', 9))) g, ST_TRSampleCount(NULL) h"
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, str(row.f), row.g, row.h) == (5.0, False, -2.0, 7, 1.5, "1969-12-31", 4, 0)


def test_time_and_trajectory_names_in_sql(spark):
    from geosluice.functions import names

    names.register(spark)
    tr = "array(named_struct('x', 1, 'y', 2, 'ts', 1000), named_struct('x', 3, 'y', 4, 'ts', 61000))"
    row = spark.sql(
        f"SELECT DateParse('2024-02-30', 'yyyy-MM-dd') a, DateFormat(DATE'2024-02-03', 'dd/MM') b, DateTimeWeekDay(TIMESTAMP_NTZ'2024-01-07 10:11:12') c,"
        " DateTimeIsBetween(TIMESTAMP_NTZ'2024-01-07', TIMESTAMP_NTZ'2024-01-07', TIMESTAMP_NTZ'2024-01-08') d, TimeMinute(TimeFromString('10:11:12')) e,"
        " string(TimeToDateTime(DATE'2024-01-07', TimeFromString('10:11:12'))) f, TimeIsAfter(TimeFromString('10:11'), TimeFromString('10:10')) g,"
        f" ST_TREndSamplePoint({tr}).y h, string(ST_TRSampleTimeAt({tr}, 1)) i, ST_ITContainsMillis(ST_TRInterval({tr}), 61000) j, ST_ITContainsMillis(ST_TRInterval({tr}), 1000) k,"
        f" ST_ITOverlaps(ST_TRInterval({tr}), ST_ITFromDateTime(TIMESTAMP_NTZ'1970-01-01', TIMESTAMP_NTZ'1970-01-01 00:00:01')) l, size(ST_TRLineString({tr})) m, DateNow() IS NOT NULL n"
    ).first()
    assert tuple(row) == (None, "03/02", 7, True, 11, "2024-01-07 10:11:12", True, 4.0, "1970-01-01 00:01:01", False, True, False, 2, True)


def test_datetimes_are_strict(spark):
    from geosluice.functions import temporal as tm

    assert str(one(spark, tm.datetime_from_string(F.lit("2024-01-07T10:11:12.5")))) == "2024-01-07 10:11:12.500000"
    assert one(spark, tm.datetime_from_string(F.lit(None).cast("string"))) is None
    for bad in ("2024-01-07", "2024-01-07 10:11", "2024-1-7T10:11", "x", "2024-02-30T10:11"):
        with pytest.raises(Exception):
            one(spark, tm.datetime_from_string(F.lit(bad)))


def test_places_in_a_key_order(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, k int").repartition(5)
    got = {r.i: r.place for r in keys.numbered(df, "k:ASC:FIRST, i:DESC", "place", str(tmp_path / "o")).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[0]))
    assert [got[r[0]] for r in want] == list(range(1, 501))
    assert keys.numbered(df.limit(0), "i", "place", str(tmp_path / "e")).count() == 0


def test_trajectories_by_slices(spark):
    """A mover with most rows, one with a single sample, ties of time and a missing time, at several widths."""
    from geosluice.operators import trajectories

    rows = [("a", (i * 37) % 1000, i, float(i % 11), float(i % 7)) for i in range(300)] + [("b", 5, 0, 1.0, 2.0), ("b", None, 1, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "who string, ts long, n int, x double, y double")
    path = sorted((r for r in rows if r[0] == "a"), key=lambda r: (r[1], r[2]))
    length = sum(math.dist(p[3:], q[3:]) for p, q in zip(path, path[1:]))
    for slices in (None, (0, 1), (3, 7), (0, 10**6)):
        got = {r.who: r for r in trajectories.measures(df, "who", "n", slices).collect()}
        assert got["a"].n_samples == 300 and abs(got["a"].path_length - length) < 1e-9
        assert (got["a"]["first"].ts, got["a"]["last"].x) == (path[0][1], path[-1][3])
        assert (got["b"].n_samples, got["b"].path_length, got["b"]["last"].x) == (1, 0.0, 1.0)
    assert trajectories.measures(df.limit(0), "who", "n").count() == 0


def test_bound_to_the_leaf_that_holds_the_box(spark):
    boxes = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0), (2, -1.0, 1.0, 1.0, 2.0), (3, 100.0, -50.0, 101.0, -49.0), (4, 0.0, 89.0, 1.0, 89.5)], "i int, a double, b double, c double, d double")
    boxes = boxes.select("i", g.envelope(*map(F.col, "abcd")).alias("box"))
    leaves = spark.createDataFrame([("1",), ("0",), ("30",), ("31",)], "quad_key string")
    assert sorted(tuple(r) for r in clusters.bind_contained(boxes, "box", leaves).select("i", "quad_key").collect()) == [(1, "1"), (3, "31")]


def test_a_tile_with_most_rows_is_stored_whole(spark, tmp_path):
    boxes = spark.range(3000).select("id", g.envelope(*[F.when(F.col("id") < 2900, F.lit(10.1)).otherwise(F.col("id") % 100)] * 4).alias("box"))
    clusters.store(boxes, "box", str(tmp_path / "c"), 6)
    assert clusters.load(spark, str(tmp_path / "c")).where("__owned").select("id").distinct().count() == 3000
    assert clusters.range_query(spark, str(tmp_path / "c"), 10.0, 10.0, 10.5, 10.5, 6).count() == 2901


def test_keys_with_leading_zeros_are_stored_whole(spark, tmp_path):
    boxes = spark.range(50).select("id", g.envelope(*[F.col("id") * k + o for k, o in ((1, -150.0), (0.5, 30.0), (1, -149.5), (0.5, 30.4))]).alias("box"))
    clusters.store(boxes, "box", str(tmp_path / "c"), 6)
    assert clusters.load(spark, str(tmp_path / "c")).where(F.length("__quad_key") != 6).count() == 0
    assert clusters.range_query(spark, str(tmp_path / "c"), -140.2, 0.0, -130.0, 80.0, 6).count() == 11


def test_text_and_time_corners(spark):
    from geosluice.functions import temporal as tm

    assert one(spark, s.from_csv(F.lit(r"a\\,b"))) == ["a\\", "b"]
    assert one(spark, s.from_csv(F.lit(r"a\,b,,c"))) == ["a,b", "", "c"]
    assert one(spark, s.from_csv(F.lit(""))) == [""] and one(spark, s.from_csv(F.lit("a,\nb,"))) == ["a", "\nb", ""]
    assert one(spark, s.change_charset(F.lit("aé"), "ISO-8859-1", "UTF-8")) is None
    assert one(spark, s.change_charset(F.lit("aé"), "UTF-8", "ISO-8859-1")) == "aÃ©"
    assert one(spark, s.change_charset(F.lit("aé"), "US-ASCII", "UTF-8")) is None
    assert one(spark, s.change_charset(F.lit("é"), "UTF-8", "US-ASCII")) is None
    assert one(spark, s.change_charset(F.lit("abc"), "UTF-8", "UTF-16BE")) is None
    assert one(spark, s.change_charset(F.lit("abc"), "nothing", "UTF-8")) is None
    spark.conf.set("spark.sql.timeType.enabled", "true")
    text = lambda v: one(spark, tm.time_to_string(tm.time_from_string(F.lit(v))))
    assert [text(v) for v in ("12:00:00", "12:00:05", "12:00:00.5", "12:00:00.000001")] == ["12:00", "12:00:05", "12:00:00.500", "12:00:00.000001"]
    assert one(spark, tm.time_to_string(tm.time_parse(F.lit("07.30"), "HH.mm"))) == "07:30" and one(spark, tm.time_parse(F.lit("x"), "HH.mm")) is None
    assert one(spark, tm.datetime_now()) is not None and one(spark, tm.time_now()) is not None
    assert str(one(spark, tm.date_from_object(F.lit(-1).cast("long"), "long"))) == "1969-12-31"


def test_catalog_statistics_ranges_and_indexes(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    df = spark.range(20).select("id", g.envelope(F.col("id"), F.col("id"), F.col("id") + 0.5, F.col("id") + 0.5).alias("box"))
    made = cat.create("/a/b", df, "box")
    assert (made["bounds"], made["count"]) == ("0.0;0.0;19.5;19.5", 20)
    assert sorted(r.id for r in cat.range_query("/a/b", 3.5, 0, 5, 9).collect()) == [3, 4, 5]
    assert cat.create("/a/none", df.limit(0), "box")["bounds"] == "" and cat.create("/a/plain", df)["count"] == 20
    assert cat.append("/a/b", spark.range(30, 31).select("id", g.envelope(F.lit(30), F.lit(1), F.lit(31), F.lit(2)).alias("box")))["bounds"] == "0.0;0.0;31.0;19.5"
    cat.create_index("/a/b", 6)
    with pytest.raises(ValueError):
        cat.create_index("/a/b", 6)
    cat.save()
    again = Catalog.open(spark, str(tmp_path))
    assert again.index_of("/a/b")["zoom"] == 6 and again.get("/a/b")["count"] == 21
    assert clusters.load(spark, again.index_of("/a/b")["path"]).where("__owned").count() == 21
    assert again.drop_index("/a/b") and again.index_of("/a/b") is None and not again.drop_index("/a/b")
    assert again.delete_folder("/a") == ["/a/b", "/a/none", "/a/plain"] and again.listed() == []
