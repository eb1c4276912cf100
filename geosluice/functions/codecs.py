"""Text, GeoJSON and binary forms of shapes, as Column expressions.

Binary is the well-known form, little endian, two dimensions; both byte orders are read
for the numbers' sake of other writers.  Empty shapes have an empty hexadecimal and
base64 text.  A collection that lies in a collection comes back flat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g
from . import shapes as sh

_RING = "array<struct<x: double, y: double>>"


_let, _once = sh._let, sh._once


# text


@_once
def _number(x: Column) -> Column:
    """Whole numbers without a fraction."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def _dots(ring: Column) -> Column:
    return F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", _number(p["x"]), _number(p["y"]))), ", ")


@_once
def _body(part: Column) -> Column:
    """A part without its name, in brackets."""
    inner = F.array_join(F.transform(part["rings"], lambda r: F.concat(F.lit("("), _dots(r), F.lit(")"))), ", ")
    return F.when(part["dim"] == 2, F.concat(F.lit("("), inner, F.lit(")"))).otherwise(inner)


@_once
def as_text(s: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in sh.KINDS.items() for x in (k, v[2])])
    name = _let(s["kind"], lambda k: names[k])
    single = F.concat_ws(" ", name, _body(F.get(s["parts"], F.lit(0))))
    many = F.concat(name, F.lit(" ("), F.array_join(F.transform(s["parts"], _body), ", "), F.lit(")"))
    one = lambda d: F.element_at(F.array(*[F.lit(sh.KINDS[k][2]) for k in sh.SINGLE]), d + 1)
    mixed = F.concat(name, F.lit(" ("), F.array_join(F.transform(s["parts"], lambda p: F.concat_ws(" ", one(p["dim"]), _body(p))), ", "), F.lit(")"))
    text = F.when(sh.is_empty(s), F.concat_ws(" ", name, F.lit("EMPTY"))).when(s["kind"].isin(*sh.SINGLE), single)
    return F.when(s.isNotNull(), text.when(s["kind"] == "GeometryCollection", mixed).otherwise(many))


#: A number, and two of them, as text has them.
_N = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_XY = rf"\s*{_N}\s+{_N}\s*"
_LIST = rf"\s*\({_XY}(?:,{_XY})*\)\s*"
_RINGS = rf"\s*\({_LIST}(?:,{_LIST})*\)\s*"
_FORMS = {
    "Point": rf"\s*\({_XY}\)\s*",
    "LineString": _LIST,
    "Polygon": _RINGS,
    "MultiPoint": rf"\s*\((?:{_XY}|\s*\({_XY}\)\s*)(?:,(?:{_XY}|\s*\({_XY}\)\s*))*\)\s*",
    "MultiLineString": _RINGS,
    "MultiPolygon": rf"\s*\({_RINGS}(?:,{_RINGS})*\)\s*",
}


@_once
def _ring_of(text: Column) -> Column:
    pairs = F.regexp_extract_all(text, F.lit(rf"({_N}\s+{_N})"), F.lit(1))
    return F.transform(pairs, lambda t: _let(F.split(t, r"\s+"), lambda v: g.point(F.get(v, F.lit(0)), F.get(v, F.lit(1)))))


@_once
def _rings_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1)), _ring_of)


def _parsed(kind: str, body: Column) -> Column:
    part = lambda d, rings: F.struct(F.lit(d).alias("dim"), rings.alias("rings"))
    if kind in ("Point", "LineString"):
        parts = F.array(part(sh.KINDS[kind][0], F.array(_ring_of(body))))
    elif kind == "Polygon":
        parts = F.array(part(2, _rings_of(body)))
    elif kind == "MultiPoint":
        parts = F.transform(_ring_of(body), lambda p: part(0, F.array(F.array(p))))
    elif kind == "MultiLineString":
        parts = F.transform(_rings_of(body), lambda r: part(1, F.array(r)))
    else:
        parts = F.transform(F.regexp_extract_all(body, F.lit(r"\(((?:\s*\([^()]*\)\s*,?)+)\)"), F.lit(1)), lambda t: part(2, _rings_of(t)))
    return F.struct(F.lit(kind).alias("kind"), parts.alias("parts"))


def from_text(text: Column) -> Column:
    """A shape from well-known text; null for null, an error for text that is no shape.  The parts of a collection are read alike."""
    tag = lambda t: F.upper(F.regexp_extract(t, r"^\s*([A-Za-z]+)", 1))
    body = lambda t: F.regexp_replace(t, r"^\s*[A-Za-z]+", "")

    def simple(t: Column, otherwise: Column) -> Column:
        out = F.when(F.lit(False), sh.empty())
        for kind, form in _FORMS.items():
            own = tag(t) == sh.KINDS[kind][2]
            out = out.when(own & F.rlike(body(t), F.lit(r"^\s*(?i:EMPTY)\s*$")), sh.empty(kind)).when(own & F.rlike(body(t), F.lit(f"^{form}$")), _parsed(kind, body(t)))
        return out.otherwise(otherwise)

    broken = lambda t: F.raise_error(F.concat(F.lit("not a shape: "), t)).cast(sh.TYPE)
    inner = F.regexp_extract(body(text), r"(?s)^\s*\((.*)\)\s*$", 1)
    items = F.regexp_extract_all(inner, F.lit(r"([A-Za-z]+\s*(?:[Ee][Mm][Pp][Tt][Yy]|[^A-DF-Za-df-z]*))"), F.lit(1))
    whole = sh.collect(F.transform(items, lambda t: simple(F.regexp_replace(t, r"[\s,]+$", ""), broken(t))))
    nothing = F.rlike(body(text), F.lit(r"^\s*(?i:EMPTY)\s*$"))
    mixed = F.when(tag(text) == "GEOMETRYCOLLECTION", F.when(nothing, sh.empty()).when(F.size(items) > 0, whole).otherwise(broken(text))).otherwise(broken(text))
    return F.when(text.isNotNull(), simple(text, mixed))


from_text = _once(from_text)


# GeoJSON


def _json_ring(r: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(r, _json_dot), ","), F.lit("]"))


def _json_dot(p: Column) -> Column:
    return F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))


@_once
def _json_part(p: Column) -> Column:
    rings = F.concat(F.lit("["), F.array_join(F.transform(p["rings"], _json_ring), ","), F.lit("]"))
    first = F.get(p["rings"], F.lit(0))
    return F.when(p["dim"] == 2, rings).when(p["dim"] == 1, _json_ring(first)).otherwise(_json_dot(F.get(first, F.lit(0))))


@_once
def as_json(s: Column) -> Column:
    """GeoJSON text; numbers as Spark prints doubles."""
    named = lambda kind, inside: F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), inside, F.lit("}"))
    one = lambda d: F.element_at(F.array(*map(F.lit, sh.SINGLE)), d + 1)
    listed = lambda each: F.concat(F.lit("["), F.array_join(F.transform(s["parts"], each), ","), F.lit("]"))
    single = F.when(F.size(s["parts"]) == 0, F.lit("[]")).otherwise(_json_part(F.get(s["parts"], F.lit(0))))
    mixed = F.concat(F.lit('{"type":"GeometryCollection","geometries":'), listed(lambda p: named(one(p["dim"]), _json_part(p))), F.lit("}"))
    return F.when(s.isNotNull(), F.when(s["kind"] == "GeometryCollection", mixed).otherwise(named(s["kind"], F.when(s["kind"].isin(*sh.SINGLE), single).otherwise(listed(_json_part)))))


def _json_numbers(depth: int) -> str:
    return "array<" * depth + "double" + ">" * depth


@_once
def _json_shape(kind: Column, coordinates: Column) -> Column:
    """A shape of one kind from the JSON text of its coordinates; null if they do not fit."""
    at = lambda v: g.point(F.get(v, F.lit(0)), F.get(v, F.lit(1)))
    ring = lambda v: F.transform(v, at)
    read = lambda depth: F.from_json(coordinates, _json_numbers(depth))
    part = lambda d, rings: F.struct(F.lit(d).alias("dim"), rings.alias("rings"))
    forms = {
        "Point": lambda: F.when(F.size(read(1)) >= 2, F.array(part(0, F.array(F.array(at(read(1))))))).when(F.size(read(1)) == 0, F.expr(f"cast(array() as array<{sh.PART}>)")),
        "LineString": lambda: F.array(part(1, F.array(ring(read(2))))),
        "Polygon": lambda: F.array(part(2, F.transform(read(3), ring))),
        "MultiPoint": lambda: F.transform(read(2), lambda p: part(0, F.array(F.array(at(p))))),
        "MultiLineString": lambda: F.transform(read(3), lambda v: part(1, F.array(ring(v)))),
        "MultiPolygon": lambda: F.transform(read(4), lambda v: part(2, F.transform(v, ring))),
    }
    out = F.when(F.lit(False), F.lit(None).cast(sh.TYPE))
    for name, parts in forms.items():
        # numbers that are missing, or no numbers, make no shape
        made = F.struct(F.lit(name).alias("kind"), F.filter(parts(), lambda p: F.size(F.flatten(p["rings"])) > 0).alias("parts"))
        out = out.when(kind == name, F.when(F.forall(sh.points(made), lambda p: p["x"].isNotNull() & p["y"].isNotNull()), made))
    return out


@_once
def from_json(text: Column) -> Column:
    """A shape from GeoJSON text; null for null and for anything that is no shape."""
    top = F.from_json(text, "type string, coordinates string, geometries array<struct<type: string, coordinates: string>>")
    items = lambda t: F.transform(t["geometries"], lambda i: _json_shape(i["type"], i["coordinates"]))
    whole = lambda t: F.when(F.forall(items(t), lambda i: i.isNotNull()), sh.collect(items(t)))
    return _let(top, lambda t: F.when(t["type"] == "GeometryCollection", whole(t)).otherwise(_json_shape(t["type"], t["coordinates"])))


# binary: doubles and counts are written and read as hexadecimal text, by arithmetic on their parts


def _little(hex_text: Column, digits: int) -> Column:
    """The bytes of a hexadecimal number in reverse order."""
    padded = F.lpad(hex_text, digits, "0")
    return F.concat(*[F.substring(padded, digits - 1 - 2 * i, 2) for i in range(digits // 2)])


def _int_hex(x: Column) -> Column:
    return _little(F.hex(x.cast("long")), 8)


@_once
def _double_hex(x: Column) -> Column:
    """The eight bytes of a finite double, little endian."""
    size = F.abs(x)

    def bits(v: Column) -> Column:
        # the exponent by the logarithm, put right by one step where it is rounded
        e0 = F.greatest(F.floor(F.log2(v["m"])).cast("int"), F.lit(-1022))
        e = F.when(v["m"] < F.pow(F.lit(2.0), e0), e0 - 1).when(v["m"] / F.pow(F.lit(2.0), e0) >= 2, e0 + 1).otherwise(e0)
        e = F.greatest(e, F.lit(-1022))
        scaled = _let(e, lambda k: F.struct(k.alias("e"), (v["m"] / F.pow(F.lit(2.0), k)).alias("f")))

        def joined(s: Column) -> Column:
            small = s["f"] < 1
            fraction = F.when(small, s["f"]).otherwise(s["f"] - 1) * F.lit(float(1 << 52))
            exponent = F.when(small, 0).otherwise(s["e"] + 1023)
            return F.shiftleft(exponent.cast("long"), 52).bitwiseOR(fraction.cast("long"))

        return _let(scaled, joined)

    number = F.when(size == 0, F.lit(0).cast("long")).otherwise(_let(F.struct(size.alias("m")), bits))
    negative = (x < 0) | (x.cast("string") == "-0.0")
    return _little(F.hex(F.when(negative, number.bitwiseOR(F.lit(-(1 << 63)))).otherwise(number)), 16)


@_once
def _ring_hex(r: Column) -> Column:
    return F.concat(_int_hex(F.size(r)), F.array_join(F.transform(r, lambda p: F.concat(_double_hex(p["x"]), _double_hex(p["y"]))), ""))


def _head(number) -> Column:
    return F.concat(F.lit("01"), _int_hex(F.lit(number) if isinstance(number, int) else number))


@_once
def _part_hex(p: Column) -> Column:
    first = F.get(p["rings"], F.lit(0))
    dot = F.get(first, F.lit(0))
    rings = F.concat(_int_hex(F.size(p["rings"])), F.array_join(F.transform(p["rings"], _ring_hex), ""))
    body = F.when(p["dim"] == 0, F.concat(_double_hex(dot["x"]), _double_hex(dot["y"]))).when(p["dim"] == 1, _ring_hex(first)).otherwise(rings)
    return F.concat(_head(p["dim"] + 1), body)


@_once
def as_hex(s: Column) -> Column:
    """Upper-case hexadecimal text of the binary form; empty for empty shapes."""
    return F.when(s.isNotNull(), F.when(sh.is_empty(s), F.lit("")).otherwise(_binary_hex(s)))


@_once
def _binary_hex(s: Column) -> Column:
    numbers = F.create_map(*[F.lit(x) for k, v in sh.KINDS.items() for x in (k, v[1])])
    single = _part_hex(F.get(s["parts"], F.lit(0)))
    many = F.concat(_let(s["kind"], lambda k: _head(numbers[k])), _int_hex(F.size(s["parts"])), F.array_join(F.transform(s["parts"], _part_hex), ""))
    nothing = F.concat(_let(s["kind"], lambda k: _head(numbers[k])), F.when(s["kind"] == "Point", F.lit("000000000000F87F" * 2)).otherwise(F.lit("00000000")))
    return F.when(F.size(s["parts"]) == 0, nothing).when(s["kind"].isin(*sh.SINGLE), single).otherwise(many)


@_once
def as_binary(s: Column) -> Column:
    return F.when(s.isNotNull(), F.unhex(_binary_hex(s)))


@_once
def as_base64(s: Column) -> Column:
    """Base64 text on one line; empty for empty shapes."""
    return F.when(s.isNotNull(), F.when(sh.is_empty(s), F.lit("")).otherwise(F.regexp_replace(F.base64(as_binary(s)), r"\r\n", "")))


@_once
def _whole(h: Column, at: Column, swap: Column) -> Column:
    """The count at a place of hexadecimal text."""
    raw = F.substring(h, at + 1, F.lit(8))
    return F.least(F.conv(F.when(swap, _little(raw, 8)).otherwise(raw), 16, 10).cast("long"), F.lit((1 << 31) - 1)).cast("int")


@_once
def _real(h: Column, at: Column, swap: Column) -> Column:
    """The double at a place of hexadecimal text; null for NaN and infinite ones."""
    raw = F.substring(h, at + 1, F.lit(16))
    text = F.when(swap, _little(raw, 16)).otherwise(raw)
    high = F.conv(F.substring(text, 1, 3), 16, 10).cast("int")
    fraction = F.conv(F.substring(text, 4, 13), 16, 10).cast("long").cast("double") / float(1 << 52)
    e = high.bitwiseAND(2047)
    sign = F.when(high >= 2048, -1.0).otherwise(1.0)
    return F.when(e == 2047, F.lit(None)).when(e == 0, sign * fraction * F.pow(F.lit(2.0), F.lit(-1022.0))).otherwise(sign * (fraction + 1) * F.pow(F.lit(2.0), (e - 1023).cast("double")))


def from_hex(text: Column) -> Column:
    """A shape from the hexadecimal text of its binary form; null for null and empty text.

    Read in one pass over the numbers: a stack is not needed, as collections hold no collections here."""
    numbers = {v[1]: k for k, v in sh.KINDS.items()}
    kinds = F.create_map(*[F.lit(x) for k, v in numbers.items() for x in (k, v)])

    def rings(h: Column, at: Column, swap: Column, count: Column) -> Column:
        """struct<at, rings> after `count` rings."""
        start = F.struct(at.alias("at"), F.expr(f"cast(array() as array<{_RING}>)").alias("rings"))

        def one(s: Column, _: Column) -> Column:
            n = _whole(h, s["at"], swap)
            dots = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: g.point(_real(h, s["at"] + 8 + i * 32, swap), _real(h, s["at"] + 24 + i * 32, swap)))).otherwise(F.expr(f"cast(array() as {_RING})"))
            return F.struct((s["at"] + 8 + n * 32).alias("at"), F.array_append(s["rings"], dots).alias("rings"))

        return F.when(count > 0, F.aggregate(F.sequence(F.lit(1), count), start, one)).otherwise(start)

    def part(h: Column, at: Column) -> Column:
        """struct<at, dim, rings> of a single shape whose head is at a place."""
        swap = F.substring(h, at + 1, F.lit(2)) == "01"
        kind = _whole(h, at + 2, swap)
        dot = F.array(F.array(g.point(_real(h, at + 10, swap), _real(h, at + 26, swap))))
        many = rings(h, F.when(kind == 3, at + 18).otherwise(at + 10), swap, F.when(kind == 3, _whole(h, at + 10, swap)).when(kind == 1, 0).otherwise(1))
        return _let(many, lambda m: F.struct(F.when(kind == 1, at + 42).otherwise(m["at"]).alias("at"), (kind - 1).alias("dim"), F.when(kind == 1, dot).otherwise(m["rings"]).alias("rings")))

    def read(h: Column) -> Column:
        swap = F.substring(h, F.lit(1), F.lit(2)) == "01"
        kind = _whole(h, F.lit(2), swap)
        start = F.struct(F.lit(18).alias("at"), F.expr(f"cast(array() as array<{sh.PART}>)").alias("parts"))
        step = lambda s, _: _let(part(h, s["at"]), lambda p: F.struct(p["at"].alias("at"), F.array_append(s["parts"], F.struct(p["dim"].alias("dim"), p["rings"].alias("rings"))).alias("parts")))
        count = F.when(kind > 3, _whole(h, F.lit(10), swap)).otherwise(0)
        many = F.when(count > 0, F.aggregate(F.sequence(F.lit(1), count), start, step)).otherwise(start)
        single = _let(part(h, F.lit(0)), lambda p: F.array(F.struct(p["dim"].alias("dim"), p["rings"].alias("rings"))))
        parts = F.filter(F.when(kind > 3, many["parts"]).otherwise(single), lambda p: (F.size(F.flatten(p["rings"])) > 0) & F.forall(F.flatten(p["rings"]), lambda q: q["x"].isNotNull()))
        return F.struct(kinds[kind].alias("kind"), parts.alias("parts"))

    return F.when(F.length(text) > 0, _let(F.upper(text), read))


@_once
def from_binary(data: Column) -> Column:
    return from_hex(F.hex(data))


@_once
def from_base64(text: Column) -> Column:
    return F.when(F.length(text) > 0, from_binary(F.unbase64(text)))
