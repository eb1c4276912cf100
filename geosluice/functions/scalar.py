"""Scalar functions on strings, arrays, CSV text, JSON and numbers, as Column expressions.

All return null for null arguments unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def starts_with(value: Column, prefix: Column) -> Column:
    return F.startswith(value.cast("string"), prefix.cast("string"))


def array_sum(values: Column) -> Column:
    """Sum in double precision; an empty array gives 0."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def array_avg(values: Column) -> Column:
    """Mean in double precision; an empty array gives NaN."""
    return F.when(F.size(values) == 0, F.lit(float("nan"))).otherwise(array_sum(values) / F.size(values))


def to_csv(values: Column, delimiter: str = ",") -> Column:
    """Elements joined by the delimiter, null elements left out, nothing quoted."""
    return F.array_join(values, delimiter)


def from_csv(text: Column, delimiter: str = ",") -> Column:
    """Fields of one line; a backslash makes the next character plain."""
    d = "\\Q" + delimiter[0] + "\\E"
    # a field starts at the text's start or after a delimiter that the field before ended at
    fields = F.regexp_extract_all(F.concat(F.lit(delimiter[0]), text), F.lit(rf"\G{d}((?:\\.|(?!{d}).)*+)".replace("(?:", "(?s:")), F.lit(1))
    return F.transform(fields, lambda f: F.regexp_replace(f, r"\\(.)", "$1"))


def union_csv(a: Column, b: Column, delimiter: str = ",") -> Column:
    """Sorted set union of two CSV texts; a null side is ignored, two nulls give null."""
    d = "\\Q" + delimiter[0] + "\\E"
    none = F.expr("cast(array() as array<string>)")
    part = lambda c: F.coalesce(F.split(c, d, -1), none)
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.array_join(F.array_sort(F.array_union(part(a), part(b))), delimiter[0]))


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: halves go towards plus infinity."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)).cast("double") / F.lit(10.0**digits)


#: Character sets, each with its last character and the bytes of its shortest one.
CHARSETS = {
    "US-ASCII": (r"\x7F", 1),
    "ISO-8859-1": (r"\xFF", 1),
    "UTF-8": (r"\x{10FFFF}", 1),
    "UTF-16BE": (r"\x{10FFFF}", 2),
    "UTF-16LE": (r"\x{10FFFF}", 2),
    "UTF-16": (r"\x{10FFFF}", 2),
    "UTF-32": (r"\x{10FFFF}", 4),
}


def change_charset(text: Column, source: str, target: str) -> Column:
    """Text encoded in one character set and read in another; null where a set is unknown, cannot hold a
    character, or the bytes are malformed in the other set."""
    source, target = source.upper(), target.upper()
    if not {source, target} <= set(CHARSETS):
        return F.when(text.isNotNull(), F.lit(None).cast("string"))
    held = F.rlike(text, F.lit(f"\\A[\\x00-{CHARSETS[source][0]}]*+\\z"))
    raw = F.when(held, F.encode(text, source))
    if target == "UTF-8":
        return F.try_validate_utf8(raw.cast("string"))
    if target == "US-ASCII":
        raw = F.when(F.rlike(F.hex(raw), F.lit(r"\A([0-7].)*+\z")), raw)
    return F.when(F.octet_length(raw) % CHARSETS[target][1] == 0, F.decode(raw, target))


def avoid_null(value: Column, alternative: Column) -> Column:
    return F.coalesce(value, alternative)


def unwrap_quote(text: Column) -> Column:
    """Without the first and the last character; texts of under two characters become empty."""
    return F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))


def parse_json(text: Column) -> Column:
    """From the first brace on, an object as a map of strings; malformed text is an error."""
    return F.from_json(F.substring(text, F.instr(text, "{"), F.length(text)), "map<string,string>", {"allowUnquotedFieldNames": "true", "mode": "FAILFAST"})


def erf(x: Column) -> Column:
    """Error function by a rational approximation, good to 1.5e-7."""
    # fixed values: coefficients of Abramowitz and Stegun, formula 7.1.26
    a, p = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429), 0.3275911
    t = 1.0 / (F.abs(x) * p + 1.0)
    poly = ((((t * a[4] + a[3]) * t + a[2]) * t + a[1]) * t + a[0]) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def p_value(z: Column) -> Column:
    return 1.0 - erf(F.abs(z) / F.sqrt(F.lit(2.0)))


#: Fields of a 19-digit land-parcel code, first place and length.
PARCEL = {"sido": (1, 2), "sigungu": (3, 3), "emd": (6, 3), "ri": (9, 2), "land_type": (11, 1), "main_no": (12, 4), "sub_no": (16, 4)}


def parcel(code: Column) -> Column:
    """The parts of a parcel code; the first two are numbers."""
    part = lambda k: F.substring(code, *PARCEL[k])
    return F.struct(*[(part(k).cast("int") if k in ("sido", "sigungu") else part(k)).alias(k) for k in PARCEL])
