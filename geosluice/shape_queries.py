"""Registered queries of shapes over the zones fixture, and their SQL.

Zones are rectangles, so SQL can say each result from its definition: relations by
comparing sides, measures by arithmetic, texts by putting numbers together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from .functions import codecs as c
from .functions import geometry as g
from .functions import shapes as sh

FIXED = (127.0, 34.0, 129.0, 37.0)


def _box():
    return g.envelope(*map(F.col, ("minx", "miny", "maxx", "maxy")))


def _rect():
    return sh.of_envelope(_box())


def _fixed():
    return sh.of_envelope(g.envelope(*map(F.lit, FIXED)))


def _at(x: str, y: str):
    return g.point(F.expr(x), F.expr(y))


def _diagonal():
    return F.array(_at("minx", "miny"), _at("maxx", "maxy"))


def _dots():
    """Three points, of which the zone's number takes none, one or two."""
    return F.slice(F.array(_at("minx", "miny"), _at("maxx", "miny"), _at("maxx", "maxy")), F.lit(1), (F.col("zone_id") % 3).cast("int"))


def _with_hole():
    """The zone with a hole of a quarter of its sides about its centre."""
    near = lambda side, other: f"({side} * 5 + {other} * 3) / 8"
    x0, x1, y0, y1 = near("minx", "maxx"), near("maxx", "minx"), near("miny", "maxy"), near("maxy", "miny")
    hole = F.array(_at(x0, y0), _at(x0, y1), _at(x1, y1), _at(x1, y0), _at(x0, y0))
    return sh.of_polygon(F.concat(g.polygon_of(_box()), F.array(hole)))


def _bent():
    """Left to right with a middle point above the line by an eighth of the height."""
    return F.array(_at("minx", "miny"), _at("(minx + maxx) / 2", "miny + (maxy - miny) / 8"), _at("maxx", "miny"))


def _n(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


_CLOSED = "minx <= 129 AND maxx >= 127 AND miny <= 37 AND maxy >= 34"
_OPEN = "minx < 129 AND maxx > 127 AND miny < 37 AND maxy > 34"
_IN = "minx >= 127 AND maxx <= 129 AND miny >= 34 AND maxy <= 37"
_DX, _DY = "greatest(0, minx - 129, 127 - maxx)", "greatest(0, miny - 37, 34 - maxy)"
_RECT_TEXT = "'POLYGON ((' || " + " || ', ' || ".join(f"{_n(x)} || ' ' || {_n(y)}" for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))) + " || '))'"
_LINE_TEXT = f"'LINESTRING (' || {_n('minx')} || ' ' || {_n('miny')} || ', ' || {_n('maxx')} || ' ' || {_n('maxy')} || ')'"
_AREA = "round((maxx - minx) * (maxy - miny), 6)"
_HOLE = "(maxx - minx) * (maxy - miny) / 16"

#: name: (fixture, key, expression, SQL); the value is called `value` in both.
SCALARS: dict[str, tuple[str, str, Callable, str]] = {
    name: ("zones", "zone_id", expression, sql)
    for name, expression, sql in (
        ("shape_is_empty", lambda: sh.is_empty(sh.multi_point(_dots())), "zone_id % 3 = 0"),
        ("shape_intersects", lambda: sh.intersects(_rect(), _fixed()), _CLOSED),
        ("shape_disjoint", lambda: sh.disjoint(_rect(), _fixed()), f"NOT ({_CLOSED})"),
        ("shape_touches", lambda: sh.touches(_rect(), _fixed()), f"({_CLOSED}) AND NOT ({_OPEN})"),
        ("shape_overlaps", lambda: sh.overlaps(_rect(), _fixed()), f"({_OPEN}) AND NOT ({_IN})"),
        ("shape_within", lambda: sh.within(_rect(), _fixed()), _IN),
        ("shape_contains", lambda: sh.contains(_rect(), sh.of_line(F.array(_at("128D", "35D"), _at("128D", "35.25D")))), "minx < 128 AND maxx > 128 AND miny <= 35 AND maxy >= 35.25"),
        ("shape_equals", lambda: sh.equals(_rect(), sh.of_polygon(F.array(F.reverse(F.get(g.polygon_of(g.envelope(*map(F.expr, ("minx", "miny", "maxx", "miny + 0.5D")))), F.lit(0)))))), "maxy = miny + 0.5"),
        ("shape_crosses", lambda: sh.crosses(sh.of_line(F.array(_at("128D", "30D"), _at("128D", "45D"))), _rect()), "minx < 128 AND maxx > 128"),
        ("shape_distance", lambda: F.round(sh.distance(_rect(), _fixed()), 9), f"round(sqrt({_DX} * {_DX} + {_DY} * {_DY}), 9)"),
        ("shape_dwithin", lambda: sh.within_distance(_rect(), _fixed(), 0.5), f"{_DX} * {_DX} + {_DY} * {_DY} <= 0.25"),
        ("shape_component_count", lambda: sh.component_count(sh.multi_point(_dots())), "CAST(zone_id % 3 AS DOUBLE)"),
        ("shape_area", lambda: F.round(sh.area(_with_hole()), 6), f"round((maxx - minx) * (maxy - miny) - {_HOLE}, 6)"),
        ("shape_length", lambda: F.round(sh.length(_rect()), 6), "round(2 * (maxx - minx + maxy - miny), 6)"),
        ("shape_envelope", lambda: g.envelope_text(sh.envelope(sh.of_line(_diagonal()))), "minx || ';' || miny || ';' || maxx || ';' || maxy"),
        ("shape_centroid", lambda: F.concat_ws(" ", *[F.round(sh.centroid(_with_hole())[k], 6).cast("string") for k in "xy"]), "round((minx + maxx) / 2, 6) || ' ' || round((miny + maxy) / 2, 6)"),
        ("shape_convex_hull", lambda: F.round(sh.area(sh.convex_hull(sh.multi_point(F.concat(F.get(g.polygon_of(_box()), F.lit(0)), F.array(_at("(minx + maxx) / 2", "miny"), _at("(minx + maxx) / 2", "(miny + maxy) / 2")))))), 6), _AREA),
        ("shape_make_polygon", lambda: F.round(sh.area(sh.make_polygon(F.array(_at("minx", "miny"), _at("maxx", "maxy"), _at("maxx", "miny"), _at("minx", "maxy")))), 6), _AREA),
        ("shape_make_polygon_about", lambda: F.round(sh.area(sh.make_polygon(F.array(_at("minx", "miny"), _at("maxx", "maxy"), _at("maxx", "miny")), _at("(minx + maxx * 3) / 4", "(miny * 3 + maxy) / 4"))), 6), "round((maxx - minx) * (maxy - miny) / 2, 6)"),
        ("shape_text", lambda: c.as_text(_rect()), _RECT_TEXT),
        ("shape_from_text", lambda: c.as_text(c.from_text(F.concat(F.lit(" Polygon "), F.substring(c.as_text(_rect()), 8, 1000)))), _RECT_TEXT),
        ("shape_json", lambda: c.as_json(sh.of_line(_diagonal())), "'{\"type\":\"LineString\",\"coordinates\":[[' || minx || ',' || miny || '],[' || maxx || ',' || maxy || ']]}'"),
        ("shape_from_json", lambda: c.as_text(c.from_json(c.as_json(_rect()))), _RECT_TEXT),
        ("shape_hex", lambda: F.substring(c.as_hex(sh.of_point(_at("CAST(zone_id % 2 + 1 AS DOUBLE)", "-0.5D"))), 1, 60), "'0101000000' || CASE WHEN zone_id % 2 = 0 THEN '000000000000F03F' ELSE '0000000000000040' END || '000000000000E0BF'"),
        ("shape_from_hex", lambda: c.as_text(c.from_hex(c.as_hex(_rect()))), _RECT_TEXT),
        ("shape_binary", lambda: F.octet_length(c.as_binary(sh.multi_line(F.array(_diagonal(), _bent())))), "9 + 2 * 9 + (2 + 3) * 16"),
        ("shape_from_binary", lambda: c.as_text(c.from_binary(c.as_binary(sh.of_line(_diagonal())))), _LINE_TEXT),
        ("shape_base64", lambda: c.as_base64(sh.of_point(_at("1D", "-0.5D"))), "'AQEAAAAAAAAAAADwPwAAAAAAAOC/'"),
        ("shape_from_base64", lambda: c.as_text(c.from_base64(c.as_base64(sh.of_line(_diagonal())))), _LINE_TEXT),
        ("shape_empty", lambda: F.concat_ws("|", *[c.as_text(sh.empty(k)) for k in sh.KINDS]), "'POINT EMPTY|LINESTRING EMPTY|POLYGON EMPTY|MULTIPOINT EMPTY|MULTILINESTRING EMPTY|MULTIPOLYGON EMPTY|GEOMETRYCOLLECTION EMPTY'"),
        ("shape_add", lambda: sh.component_count(sh.add(sh.multi_line(F.array(_diagonal())), F.when(F.col("zone_id") % 2 == 0, sh.of_line(_bent())).otherwise(sh.of_point(_at("minx", "miny"))))), "CASE WHEN zone_id % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"),
        ("shape_collect", lambda: c.as_text(sh.collect(F.array(sh.of_point(_at("minx", "miny")), sh.of_line(_diagonal())))), f"'GEOMETRYCOLLECTION (POINT (' || {_n('minx')} || ' ' || {_n('miny')} || '), ' || {_LINE_TEXT} || ')'"),
        ("shape_components", lambda: F.size(sh.components(sh.multi_point(_dots()))), "CAST(zone_id % 3 AS INTEGER)"),
        ("shape_typed", lambda: c.as_text(sh.typed(sh.collect(F.array(sh.of_point(_at("minx", "miny")), sh.of_line(_diagonal()))), "MultiLineString")), f"'MULTI' || replace({_LINE_TEXT}, '(', '((') || ')'"),
        ("shape_remove_holes", lambda: F.round(sh.area(sh.remove_holes(_with_hole())), 6), _AREA),
        ("shape_remove_small_holes", lambda: F.round(sh.area(sh.remove_holes(_with_hole(), 0.01)), 6), f"round((maxx - minx) * (maxy - miny) - CASE WHEN {_HOLE} > 0.01 THEN {_HOLE} ELSE 0 END, 6)"),
        ("shape_simplify", lambda: F.size(sh.simplify_line(_bent(), 0.05)), "CASE WHEN (maxy - miny) / 8 > 0.05 THEN 3 ELSE 2 END"),
        ("shape_way_point", lambda: c.as_text(sh.way_point(F.array(_at("minx", "miny"), _at("maxx", "miny"), _at("maxx", "maxy")), F.lit(0.5))), f"CASE WHEN maxx - minx >= 0.5 THEN 'POINT (' || {_n('minx + 0.5')} || ' ' || {_n('miny')} || ')' WHEN maxx - minx + maxy - miny >= 0.5 THEN 'POINT (' || {_n('maxx')} || ' ' || {_n('miny + 0.5 - (maxx - minx)')} || ')' ELSE 'POINT EMPTY' END"),
        ("shape_angle_between", lambda: F.round(sh.angle_between(_at("maxx", "maxy"), _at("minx", "miny"), _at("maxx", "miny")), 6), "round(degrees(atan2(maxy - miny, maxx - minx)), 6)"),
        ("shape_angle_360", lambda: F.round(sh.angle_360(_at("maxx", "maxy"), _at("minx", "miny")), 6), "round(360 - degrees(atan2(maxy - miny, maxx - minx)), 6)"),
        ("geo_gradient", lambda: F.round(g.gradient(_at("minx", "miny"), _at("maxx", "maxy")), 6), "round(180 - degrees(atan2(maxx - minx, maxy - miny)), 6)"),
    )
}
