"""Web-Mercator tiles and quadkeys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..assumptions import MAX_LATITUDE


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((lon + 180.0) / 360.0 * n).cast("int")))


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    lat = F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat)))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((1.0 - F.ln(F.tan(lat) + 1.0 / F.cos(lat)) / F.pi()) / 2.0 * n).cast("int")))


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    digit = lambda i: F.shiftright(x, zoom - 1 - i).bitwiseAND(1) + F.shiftright(y, zoom - 1 - i).bitwiseAND(1) * 2
    return F.concat(*[digit(i).cast("string") for i in range(zoom)]) if zoom else F.lit("")


def tile_of(key: Column) -> Column:
    """A quadkey's tile: zoom, x and y."""
    digits = F.transform(F.split(key, ""), lambda d: d.cast("int"))
    fold = lambda bit: F.aggregate(digits, F.lit(0), lambda a, d: a * 2 + F.shiftright(d, bit).bitwiseAND(1))
    empty = F.length(key) == 0
    zero = F.lit(0)
    return F.struct(F.length(key).alias("zoom"), F.when(empty, zero).otherwise(fold(0)).alias("x"), F.when(empty, zero).otherwise(fold(1)).alias("y"))


def tile_bounds(x: Column, y: Column, zoom: int) -> Column:
    """A tile's envelope in degrees."""
    n = float(1 << zoom)
    lon = lambda i: i / n * 360.0 - 180.0
    lat = lambda j: F.degrees(F.atan(F.sinh(F.pi() * (1.0 - j * 2.0 / n))))
    return F.struct(lon(x).alias("minx"), lat(y + 1).alias("miny"), lon(x + 1).alias("maxx"), lat(y).alias("maxy"))


def bounds_of(tile: Column) -> Column:
    """The envelope of a tile of any zoom, in degrees."""
    n = F.pow(F.lit(2.0), tile["zoom"])
    lon = lambda i: i / n * 360.0 - 180.0
    lat = lambda j: F.degrees(F.atan(F.sinh(F.pi() * (1.0 - j * 2.0 / n))))
    return F.struct(lon(tile["x"]).alias("minx"), lat(tile["y"] + 1).alias("miny"), lon(tile["x"] + 1).alias("maxx"), lat(tile["y"]).alias("maxy"))


def in_range(e: Column) -> Column:
    """Whether an envelope lies where tiles are."""
    return F.coalesce((e["minx"] >= -180) & (e["maxx"] <= 180) & (e["miny"] >= -MAX_LATITUDE) & (e["maxy"] <= MAX_LATITUDE), F.lit(False))


def tiles_of(e: Column, zoom: int) -> Column:
    """All tiles that an envelope meets, as array<struct<x, y>>."""
    xs = F.sequence(tile_x(e["minx"], zoom), tile_x(e["maxx"], zoom))
    ys = F.sequence(tile_y(e["maxy"], zoom), tile_y(e["miny"], zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
