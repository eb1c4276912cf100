"""Functions by name for SQL, as temporary SQL functions: Catalyst inlines their bodies, nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..session import configure

POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
BOX = "STRUCT<minx: DOUBLE, miny: DOUBLE, maxx: DOUBLE, maxy: DOUBLE>"
RANGE = "STRUCT<start_ms: BIGINT, end_ms: BIGINT>"
SAMPLES = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, ts: BIGINT>>"

#: name: (parameters, result type, body)
FUNCTIONS = {
    "ST_Point": ("x DOUBLE, y DOUBLE", POINT, "named_struct('x', x, 'y', y)"),
    "ST_X": (f"p {POINT}", "DOUBLE", "p.x"),
    "ST_Y": (f"p {POINT}", "DOUBLE", "p.y"),
    "ST_GeomFromEnvelope": ("a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE", BOX, "named_struct('minx', a, 'miny', b, 'maxx', c, 'maxy', d)"),
    "ST_Distance": (f"p {POINT}, q {POINT}", "DOUBLE", "coalesce(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), -1D)"),
    "ST_DWithin": (f"p {POINT}, q {POINT}, d DOUBLE", "BOOLEAN", "coalesce((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= d * d, false)"),
    "ST_StartsWith": ("s STRING, prefix STRING", "BOOLEAN", "startswith(s, prefix)"),
    "ST_ArraySum": ("v ARRAY<DOUBLE>", "DOUBLE", "aggregate(v, 0D, (a, x) -> a + x)"),
    "ST_ArrayAvg": ("v ARRAY<DOUBLE>", "DOUBLE", "if(size(v) = 0, double('NaN'), aggregate(v, 0D, (a, x) -> a + x) / size(v))"),
    "ST_StringToCsv": ("v ARRAY<STRING>, delim STRING", "STRING", "array_join(v, delim)"),
    "Round": ("x DOUBLE, digits INT", "DOUBLE", "double(floor(x * power(10D, digits) + 0.5D)) / power(10D, digits)"),
    "DateYear": ("d DATE", "INT", "year(d)"),
    "DateMonthValue": ("d DATE", "INT", "month(d)"),
    "DateDayOfMonth": ("d DATE", "INT", "day(d)"),
    "DateWeekDay": ("d DATE", "INT", "weekday(d) + 1"),
    "DateFromMillis": ("ms BIGINT", "DATE", "date_from_unix_date(int(floor(ms / 86400000)))"),
    "DateToMillis": ("d DATE", "BIGINT", "bigint(unix_date(d)) * 86400000"),
    "DateDaysBetween": ("a DATE, b DATE", "BIGINT", "bigint(datediff(b, a))"),
    "DateIsBefore": ("a DATE, b DATE", "BOOLEAN", "a < b"),
    "DateIsAfter": ("a DATE, b DATE", "BOOLEAN", "a > b"),
    "DateTimeFromMillis": ("ms BIGINT", "TIMESTAMP_NTZ", "cast(timestamp_millis(ms) AS TIMESTAMP_NTZ)"),
    "DateTimeToMillis": ("t TIMESTAMP_NTZ", "BIGINT", "unix_millis(cast(t AS TIMESTAMP))"),
    "DateNow": ("", "DATE", "current_date()"),
    "DateFromString": ("s STRING", "DATE", "to_date(s, 'yyyy-MM-dd')"),
    "DateToString": ("d DATE", "STRING", "string(d)"),
    "DateParse": ("s STRING, pattern STRING", "DATE", "try_to_date(s, pattern)"),
    "DateFormat": ("d DATE, pattern STRING", "STRING", "date_format(d, pattern)"),
    "DateToDateTime": ("d DATE", "TIMESTAMP_NTZ", "cast(d AS TIMESTAMP_NTZ)"),
    "DateIsEqual": ("a DATE, b DATE", "BOOLEAN", "a = b"),
    "DateTimeNow": ("", "TIMESTAMP_NTZ", "cast(current_timestamp() AS TIMESTAMP_NTZ)"),
    "DateTimeGetYear": ("t TIMESTAMP_NTZ", "INT", "year(t)"),
    "DateTimeGetMonth": ("t TIMESTAMP_NTZ", "INT", "month(t)"),
    "DateTimeGetDayOfMonth": ("t TIMESTAMP_NTZ", "INT", "day(t)"),
    "DateTimeWeekDay": ("t TIMESTAMP_NTZ", "INT", "weekday(t) + 1"),
    "DateTimeGetHour": ("t TIMESTAMP_NTZ", "INT", "hour(t)"),
    "DateTimeGetMinute": ("t TIMESTAMP_NTZ", "INT", "minute(t)"),
    "DateTimeGetSecond": ("t TIMESTAMP_NTZ", "INT", "second(t)"),
    "DateTimeParse": ("s STRING, pattern STRING", "TIMESTAMP_NTZ", "cast(try_to_timestamp(s, pattern) AS TIMESTAMP_NTZ)"),
    "DateTimeFormat": ("t TIMESTAMP_NTZ, pattern STRING", "STRING", "date_format(t, pattern)"),
    "DateTimeIsEqual": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BOOLEAN", "a = b"),
    "DateTimeIsAfter": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BOOLEAN", "a > b"),
    "DateTimeIsBefore": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BOOLEAN", "a < b"),
    "DateTimeIsBetween": ("t TIMESTAMP_NTZ, a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BOOLEAN", "unix_millis(cast(t AS TIMESTAMP)) BETWEEN unix_millis(cast(a AS TIMESTAMP)) AND unix_millis(cast(b AS TIMESTAMP))"),
    "TimeHour": ("t TIME", "INT", "hour(t)"),
    "TimeMinute": ("t TIME", "INT", "minute(t)"),
    "TimeSecond": ("t TIME", "INT", "second(t)"),
    "TimeIsEqual": ("a TIME, b TIME", "BOOLEAN", "a = b"),
    "TimeIsAfter": ("a TIME, b TIME", "BOOLEAN", "a > b"),
    "TimeIsBefore": ("a TIME, b TIME", "BOOLEAN", "a < b"),
    "TimeFromString": ("s STRING", "TIME", "cast(s AS TIME)"),
    "TimeToDateTime": ("d DATE, t TIME", "TIMESTAMP_NTZ", "make_timestamp_ntz(d, t)"),
    "ST_ITFromDateTime": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", RANGE, "named_struct('start_ms', unix_millis(cast(a AS TIMESTAMP)), 'end_ms', unix_millis(cast(b AS TIMESTAMP)))"),
    "ST_ITOverlaps": (f"a {RANGE}, b {RANGE}", "BOOLEAN", "a.start_ms < b.end_ms AND b.start_ms < a.end_ms"),
    "ST_ITContainsMillis": (f"r {RANGE}, ms BIGINT", "BOOLEAN", "r.start_ms <= ms AND ms < r.end_ms"),
    "ST_TRLineString": (f"tr {SAMPLES}", f"ARRAY<{POINT}>", "transform(tr, s -> named_struct('x', s.x, 'y', s.y))"),
    "ST_TRStartSamplePoint": (f"tr {SAMPLES}", POINT, "named_struct('x', get(tr, 0).x, 'y', get(tr, 0).y)"),
    "ST_TREndSamplePoint": (f"tr {SAMPLES}", POINT, "named_struct('x', get(tr, size(tr) - 1).x, 'y', get(tr, size(tr) - 1).y)"),
    "ST_TRSamplePointAt": (f"tr {SAMPLES}, i INT", POINT, "named_struct('x', element_at(tr, i + 1).x, 'y', element_at(tr, i + 1).y)"),
    "ST_TRInterval": (f"tr {SAMPLES}", RANGE, "named_struct('start_ms', get(tr, 0).ts, 'end_ms', get(tr, size(tr) - 1).ts)"),
    "ST_TRStartSampleTime": (f"tr {SAMPLES}", "TIMESTAMP_NTZ", "cast(timestamp_millis(get(tr, 0).ts) AS TIMESTAMP_NTZ)"),
    "ST_TRSampleTimeAt": (f"tr {SAMPLES}, i INT", "TIMESTAMP_NTZ", "cast(timestamp_millis(element_at(tr, i + 1).ts) AS TIMESTAMP_NTZ)"),
    "ST_TRSampleCount": (f"tr {SAMPLES}", "INT", "if(tr IS NULL, 0, size(tr))"),
    "ST_TRDuration": (f"tr {SAMPLES}", "BIGINT", "get(tr, size(tr) - 1).ts - get(tr, 0).ts"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to spark.sql in this session; a builtin of the same name keeps its own name.

    Round is registered as RoundHalfUp, as SQL has its own round.  The session is set to UTC and the TIME type."""
    configure(spark)
    done = []
    for name, (params, result, body) in FUNCTIONS.items():
        name = "RoundHalfUp" if name == "Round" else name
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
        done.append(name)
    return done
