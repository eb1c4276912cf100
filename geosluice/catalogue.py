"""Registered queries of the library over the test tables, and their SQL.

Fixtures are SQL that both engines read alike.  Scalar functions are one query
each: a fixture, its key columns, a Column expression, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shape_queries
from .functions import geometry as g
from .functions import scalar as s
from .functions import shapes as sh
from .functions import temporal as d
from .functions import tiles as t
from .functions import trajectory as tr
from .operators import clusters, columns, keys, trajectories
from .plans import spatial_join as sj
from .session import configure, scratch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

FIXTURES = {
    "pts": """SELECT c_custkey AS pt_id,
       CAST(126 AS DOUBLE) + CAST((c_custkey * 7919) % 4096 AS DOUBLE) / CAST(1024 AS DOUBLE) AS lon,
       CAST(33 AS DOUBLE) + CAST((c_custkey * 104729) % 6144 AS DOUBLE) / CAST(1024 AS DOUBLE) AS lat FROM customer""",
    "zones": """SELECT zone_id, cx - hw AS minx, cy - hh AS miny, cx + hw AS maxx, cy + hh AS maxy
FROM (SELECT s_suppkey AS zone_id,
             CAST(126 AS DOUBLE) + CAST((s_suppkey * 613) % 4096 AS DOUBLE) / CAST(1024 AS DOUBLE) AS cx,
             CAST(33 AS DOUBLE) + CAST((s_suppkey * 997) % 6144 AS DOUBLE) / CAST(1024 AS DOUBLE) AS cy,
             CAST(s_suppkey % 7 + 1 AS DOUBLE) / CAST(16 AS DOUBLE) AS hw,
             CAST(s_suppkey % 5 + 1 AS DOUBLE) / CAST(16 AS DOUBLE) AS hh FROM supplier) z""",
    "keys_nullable": "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS k1, nullif(o_orderstatus, 'P') AS k2, o_totalprice FROM orders",
    "date_text": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'bad' WHEN o_orderkey % 10 = 1 THEN CAST(NULL AS STRING)
            ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS d FROM orders""",
    "dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 - 30 AS INT) AS e FROM orders",
    "parcels": """SELECT c_custkey, '27' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || lpad(CAST((c_custkey * 7) % 1000 AS STRING), 3, '0')
            || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || '1' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
            || lpad(CAST((c_custkey * 3) % 10000 AS STRING), 4, '0') AS pnu FROM customer""",
    "csv_pairs": "SELECT p_partkey, p_brand || ',' || p_type AS a, CASE WHEN p_partkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE p_type || ',' || p_name END AS b FROM part",
    "customer": "SELECT * FROM customer",
    "events": "SELECT event_id, user_id, ts, props FROM events",
    "embeddings": "SELECT vec_id, embedding FROM embeddings",
}

def tables(spark: SparkSession, sf_dir: str) -> None:
    configure(spark)
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables(spark, sf_dir)
    return spark.sql(FIXTURES[name])


def _box(*names: str):
    return g.envelope(*map(F.col, names or ("minx", "miny", "maxx", "maxy")))


def _pt():
    return g.point(F.col("lon"), F.col("lat"))


def _c(name: str):
    return F.col(name)



#: name: (fixture, key, expression, SQL); the value is called `value` in both.
SCALARS: dict[str, tuple[str, str, Callable, str]] = {
    # strings, arrays, CSV, JSON, numbers
    "starts_with": ("customer", "c_custkey", lambda: s.starts_with(_c("c_mktsegment"), F.lit("B")), "starts_with(c_mktsegment, 'B')"),
    "array_sum": ("embeddings", "vec_id", lambda: F.round(s.array_sum(_c("embedding")), 6), "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6)"),
    "array_avg": ("embeddings", "vec_id", lambda: F.round(s.array_avg(_c("embedding")), 6), "round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6)"),
    "to_csv": ("customer", "c_custkey", lambda: s.to_csv(F.array("c_name", "c_mktsegment"), ";"), "c_name || ';' || c_mktsegment"),
    "from_csv": ("csv_pairs", "p_partkey", lambda: F.array_join(s.from_csv(_c("b")), "|"), "array_to_string(string_split(b, ','), '|')"),
    "union_csv": ("csv_pairs", "p_partkey", lambda: s.union_csv(_c("a"), _c("b")), "array_to_string(list_sort(list_distinct(list_concat(string_split(a, ','), coalesce(string_split(b, ','), [])))), ',')"),
    "round_half_up": ("customer", "c_custkey", lambda: s.round_half_up(_c("c_acctbal"), 1), "floor(c_acctbal * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE"),
    "change_charset": ("customer", "c_custkey", lambda: s.change_charset(_c("c_name"), "UTF-8", "UTF-8"), "c_name"),
    "avoid_null": ("csv_pairs", "p_partkey", lambda: s.avoid_null(_c("b"), _c("a")), "coalesce(b, a)"),
    "unwrap_quote": ("customer", "c_custkey", lambda: s.unwrap_quote(F.concat(F.lit('"'), "c_name", F.lit('"'))), "c_name"),
    "parse_json": ("events", "event_id", lambda: F.get(F.map_values(s.parse_json(F.concat(F.lit("x "), "props"))), F.lit(0)).cast("int"), "CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS INTEGER)"),
    "p_value": ("customer", "c_custkey", lambda: F.round(s.p_value(_c("c_acctbal") / 5000.0), 6), "round(1 - (1 - ((((1.061405429::DOUBLE * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z)), 6)"),
    "parcel": ("parcels", "c_custkey", lambda: F.concat_ws("/", *[s.parcel(_c("pnu"))[k].cast("string") for k in s.PARCEL]), "concat_ws('/', CAST(CAST(substr(pnu, 1, 2) AS INT) AS VARCHAR), CAST(CAST(substr(pnu, 3, 3) AS INT) AS VARCHAR), substr(pnu, 6, 3), substr(pnu, 9, 2), substr(pnu, 11, 1), substr(pnu, 12, 4), substr(pnu, 16, 4))"),
    # dates
    "date_year": ("dates", "o_orderkey", lambda: F.year("d"), "CAST(year(d) AS INTEGER)"),
    "date_month": ("dates", "o_orderkey", lambda: F.month("d"), "CAST(month(d) AS INTEGER)"),
    "date_day_of_month": ("dates", "o_orderkey", lambda: F.dayofmonth("d"), "CAST(day(d) AS INTEGER)"),
    "date_weekday": ("dates", "o_orderkey", lambda: d.weekday(_c("d")), "CAST(isodow(d) AS INTEGER)"),
    "date_is_equal": ("dates", "o_orderkey", lambda: _c("d") == _c("e"), "d = e"),
    "date_is_after": ("dates", "o_orderkey", lambda: _c("d") > _c("e"), "d > e"),
    "date_is_before": ("dates", "o_orderkey", lambda: _c("d") < _c("e"), "d < e"),
    "date_from_millis": ("dates", "o_orderkey", lambda: d.date_from_millis(d.date_to_millis(_c("d")) + 1).cast("string"), "CAST(d AS VARCHAR)"),
    "date_to_millis": ("dates", "o_orderkey", lambda: d.date_to_millis(_c("d")), "CAST(epoch_ms(CAST(d AS TIMESTAMP)) AS BIGINT)"),
    "date_from_string": ("dates", "o_orderkey", lambda: d.date_from_string(_c("d").cast("string")).cast("string"), "CAST(d AS VARCHAR)"),
    "date_to_string": ("dates", "o_orderkey", lambda: _c("d").cast("string"), "CAST(d AS VARCHAR)"),
    "date_parse": ("date_text", "o_orderkey", lambda: d.date_parse(_c("d"), "yyyy-MM-dd").cast("string"), "CAST(CAST(try_strptime(d, '%Y-%m-%d') AS DATE) AS VARCHAR)"),
    "date_format": ("dates", "o_orderkey", lambda: d.date_format(_c("d"), "dd/MM/yyyy"), "strftime(d, '%d/%m/%Y')"),
    "date_to_datetime": ("dates", "o_orderkey", lambda: _c("d").cast("timestamp_ntz").cast("string"), "CAST(CAST(d AS TIMESTAMP) AS VARCHAR)"),
    "days_between": ("dates", "o_orderkey", lambda: d.days_between(_c("d"), _c("e")), "CAST(date_diff('day', d, e) AS BIGINT)"),
    # datetimes
    "datetime_from_millis": ("events", "event_id", lambda: F.date_format(d.datetime_from_millis(d.datetime_to_millis(_c("ts"))), "yyyy-MM-dd HH:mm:ss.SSS"), "strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%d %H:%M:%S.%g')"),
    "datetime_to_millis": ("events", "event_id", lambda: d.datetime_to_millis(_c("ts")), "CAST((epoch_us(ts) // 1000) AS BIGINT)"),
    "datetime_from_string": ("events", "event_id", lambda: d.datetime_to_millis(d.datetime_from_string(F.translate(_c("ts").cast("string"), " ", "T"))), "CAST((epoch_us(ts) // 1000) AS BIGINT)"),
    "datetime_to_string": ("dates", "o_orderkey", lambda: d.datetime_to_string(_c("d").cast("timestamp_ntz")), "strftime(d, '%Y-%m-%dT%H:%M')"),
    "datetime_year": ("events", "event_id", lambda: F.year("ts"), "CAST(year(ts) AS INTEGER)"),
    "datetime_month": ("events", "event_id", lambda: F.month("ts"), "CAST(month(ts) AS INTEGER)"),
    "datetime_day": ("events", "event_id", lambda: F.dayofmonth("ts"), "CAST(day(ts) AS INTEGER)"),
    "datetime_weekday": ("events", "event_id", lambda: d.weekday(_c("ts")), "CAST(isodow(ts) AS INTEGER)"),
    "datetime_hour": ("events", "event_id", lambda: F.hour("ts"), "CAST(hour(ts) AS INTEGER)"),
    "datetime_minute": ("events", "event_id", lambda: F.minute("ts"), "CAST(minute(ts) AS INTEGER)"),
    "datetime_second": ("events", "event_id", lambda: F.second("ts"), "CAST(second(ts) AS INTEGER)"),
    "datetime_parse": ("date_text", "o_orderkey", lambda: d.datetime_to_millis(d.datetime_parse(_c("d"), "yyyy-MM-dd")), "CAST(epoch_ms(try_strptime(d, '%Y-%m-%d')) AS BIGINT)"),
    "datetime_format": ("events", "event_id", lambda: d.date_format(_c("ts"), "yyyyMMdd-HHmmss"), "strftime(ts, '%Y%m%d-%H%M%S')"),
    "datetime_is_equal": ("events", "event_id", lambda: _c("ts") == F.date_trunc("minute", "ts").cast("timestamp_ntz"), "ts = date_trunc('minute', ts)"),
    "datetime_is_after": ("events", "event_id", lambda: _c("ts") > F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), "ts > TIMESTAMP '2024-01-15 12:00:00'"),
    "datetime_is_before": ("events", "event_id", lambda: _c("ts") < F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), "ts < TIMESTAMP '2024-01-15 12:00:00'"),
    "datetime_between": ("events", "event_id", lambda: d.datetime_between(_c("ts"), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")), "(epoch_us(ts) // 1000) BETWEEN epoch_ms(TIMESTAMP '2024-01-05') AND epoch_ms(TIMESTAMP '2024-01-20')"),
    # times of day
    "time_hour": ("events", "event_id", lambda: F.hour(d.time_from_string(F.date_format("ts", "HH:mm:ss"))), "CAST(hour(ts) AS INTEGER)"),
    "time_minute": ("events", "event_id", lambda: F.minute(d.time_from_string(F.date_format("ts", "HH:mm:ss"))), "CAST(minute(ts) AS INTEGER)"),
    "time_second": ("events", "event_id", lambda: F.second(d.time_from_string(F.date_format("ts", "HH:mm:ss"))), "CAST(second(ts) AS INTEGER)"),
    "time_is_equal": ("events", "event_id", lambda: d.time_from_string(F.date_format("ts", "HH:mm:ss")) == d.time_from_string(F.date_format("ts", "HH:mm")), "second(ts) = 0"),
    "time_is_after": ("events", "event_id", lambda: d.time_from_string(F.date_format("ts", "HH:mm:ss")) > d.time_from_string(F.lit("12:00:00")), "hour(ts) * 3600 + minute(ts) * 60 + second(ts) > 43200"),
    "time_is_before": ("events", "event_id", lambda: d.time_from_string(F.date_format("ts", "HH:mm:ss")) < d.time_from_string(F.lit("12:00:00")), "hour(ts) < 12"),
    "time_to_string": ("events", "event_id", lambda: d.time_to_string(d.time_from_string(F.date_format("ts", "HH:mm"))), "strftime(ts, '%H:%M')"),
    "time_format": ("events", "event_id", lambda: d.time_format(d.time_from_string(F.date_format("ts", "HH:mm:ss")), "HHmmss"), "strftime(ts, '%H%M%S')"),
    "time_to_datetime": ("events", "event_id", lambda: d.datetime_to_millis(d.at_time(F.to_date("ts"), d.time_from_string(F.date_format("ts", "HH:mm:ss")))), "CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT)"),
    "range_overlaps": ("dates", "o_orderkey", lambda: d.ranges_overlap(d.time_range(F.least("d", "e"), F.greatest("d", "e")), d.time_range(F.lit("1995-01-01").cast("date"), F.lit("1996-01-01").cast("date"))), "least(d, e) < DATE '1996-01-01' AND DATE '1995-01-01' < greatest(d, e)"),
    "range_contains": ("events", "event_id", lambda: d.range_contains(d.time_range(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")), d.datetime_to_millis(_c("ts"))), "(epoch_us(ts) // 1000) >= epoch_ms(TIMESTAMP '2024-01-05') AND (epoch_us(ts) // 1000) < epoch_ms(TIMESTAMP '2024-01-20')"),
    # geometry on points and rectangles
    "geo_point": ("pts", "pt_id", lambda: g.point_text(_pt()), "'POINT (' || CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')'"),
    "geo_point_from_text": ("pts", "pt_id", lambda: g.point_from_text(g.point_text(_pt()))["x"] + F.lit(0.0), "lon"),
    "geo_x": ("pts", "pt_id", lambda: _pt()["x"], "lon"),
    "geo_y": ("pts", "pt_id", lambda: _pt()["y"], "lat"),
    "geo_distance": ("pts", "pt_id", lambda: F.round(g.distance(_pt(), g.point(F.lit(128.0), F.lit(36.0))), 9), "round(sqrt((lon - 128) * (lon - 128) + (lat - 36) * (lat - 36)), 9)"),
    "geo_dwithin": ("pts", "pt_id", lambda: g.within_distance(_pt(), g.point(F.lit(128.0), F.lit(36.0)), 1.0), "(lon - 128) * (lon - 128) + (lat - 36) * (lat - 36) <= 1"),
    "geo_area": ("zones", "zone_id", lambda: F.round(g.area(g.polygon_of(_box())), 6), "round((maxx - minx) * (maxy - miny), 6)"),
    "geo_length": ("zones", "zone_id", lambda: g.length(F.get(g.polygon_of(_box()), F.lit(0))), "2 * (maxx - minx + maxy - miny)"),
    "geo_envelope": ("zones", "zone_id", lambda: g.envelope_text(g.envelope_of(F.get(g.polygon_of(_box()), F.lit(0)))), "CAST(minx AS VARCHAR) || ';' || CAST(miny AS VARCHAR) || ';' || CAST(maxx AS VARCHAR) || ';' || CAST(maxy AS VARCHAR)"),
    "geo_centroid": ("zones", "zone_id", lambda: F.concat_ws(" ", *[F.round(g.centroid(F.get(g.polygon_of(_box()), F.lit(0)))[k], 6).cast("string") for k in "xy"]), "round((minx + maxx) / 2, 6) || ' ' || round((miny + maxy) / 2, 6)"),
    "geo_contains": ("pts", "pt_id", lambda: g.inside(g.polygon_of(g.envelope(*map(F.lit, (127.0, 34.0, 129.0, 37.0)))), _pt()), "lon > 127 AND lon < 129 AND lat > 34 AND lat < 37"),
    "geo_intersects": ("pts", "pt_id", lambda: g.intersects(g.polygon_of(g.envelope(*map(F.lit, (127.0, 34.0, 129.0, 37.0)))), _pt()), "lon >= 127 AND lon <= 129 AND lat >= 34 AND lat <= 37"),
    "geo_touches": ("pts", "pt_id", lambda: g.on_border(g.polygon_of(g.envelope(*map(F.lit, (127.0, 34.0, 129.0, 37.0)))), _pt()), "(lon BETWEEN 127 AND 129 AND lat BETWEEN 34 AND 37) AND NOT (lon > 127 AND lon < 129 AND lat > 34 AND lat < 37)"),
    "geo_intersection": ("zones", "zone_id", lambda: g.envelope_area(g.intersection(_box(), g.envelope(*map(F.lit, (127.0, 34.0, 129.0, 37.0))))), "CASE WHEN minx <= 129 AND maxx >= 127 AND miny <= 37 AND maxy >= 34 THEN (least(maxx, 129) - greatest(minx, 127)) * (least(maxy, 37) - greatest(miny, 34)) END"),
    "geo_envelope_overlaps": ("zones", "zone_id", lambda: g.overlaps_area(_box(), g.envelope(*map(F.lit, (127.0, 34.0, 129.0, 37.0)))), "minx < 129 AND maxx > 127 AND miny < 37 AND maxy > 34"),
    "geo_closest_point": ("pts", "pt_id", lambda: g.closest_point(_pt(), F.array(g.point(F.lit(127.0), F.lit(34.0)), g.point(F.lit(129.0), F.lit(34.0))))["x"] + F.lit(34.0) * 1000, "greatest(127.0::DOUBLE, least(129.0::DOUBLE, lon)) + 34000"),
    "geo_bearing": ("pts", "pt_id", lambda: F.round(g.bearing(g.point(F.lit(125.0), F.lit(32.0)), _pt()), 6), "round(degrees(atan2(lon - 125, lat - 32)), 6)"),
    "geo_geodesic_distance": ("pts", "pt_id", lambda: F.round(g.geodesic_distance(g.point(F.lit(127.0), F.lit(34.0)), _pt()), 3), "round(2 * 6371008.8::DOUBLE * asin(least(1, sqrt(power(sin(radians(lat - 34) / 2), 2) + cos(radians(34)) * cos(radians(lat)) * power(sin(radians(lon - 127) / 2), 2)))), 3)"),
    "geo_json": ("pts", "pt_id", lambda: g.point_json(_pt()), "'{\"type\":\"Point\",\"coordinates\":[' || CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || ']}'"),
    "tile_x": ("pts", "pt_id", lambda: t.tile_x(_c("lon"), 9), "CAST(floor((lon + 180) / 360 * 512) AS INTEGER)"),
    "tile_y": ("pts", "pt_id", lambda: t.tile_y(_c("lat"), 9), "CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 512) AS INTEGER)"),
    "quadkey_round_trip": ("pts", "pt_id", lambda: F.concat_ws("/", *[t.tile_of(t.quadkey(t.tile_x(_c("lon"), 9), t.tile_y(_c("lat"), 9), 9))[k].cast("string") for k in ("zoom", "x", "y")]), "'9/' || CAST(floor((lon + 180) / 360 * 512) AS INTEGER) || '/' || CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 512) AS INTEGER)"),
    "catalog_id": ("customer", "c_custkey", lambda: _normal_id(F.concat(F.lit(" "), "c_name", F.lit("/ "))), "'/' || c_name"),
}


def _normal_id(c):
    from .sources.datasets import normal_id_column

    return normal_id_column(c)


SCALARS |= shape_queries.SCALARS

#: Columns that SQL needs beside the fixture's.
EXTRA = {"p_value": ", abs(c_acctbal / 5000.0::DOUBLE) / sqrt(2) AS z, 1 / (1 + 0.3275911::DOUBLE * abs(c_acctbal / 5000.0::DOUBLE) / sqrt(2)) AS t"}


def _scalar(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, key, expression, _ = SCALARS[name]
        return fixture(spark, sf_dir, source).select(key, expression().alias("value"))

    return run


def _scalar_sql(name: str) -> str:
    source, key, _, sql = SCALARS[name]
    return f"SELECT {key}, {sql} AS value FROM (SELECT *{EXTRA.get(name, '')} FROM ({FIXTURES[source]}) f) g"


def points(spark, sf_dir) -> DataFrame:
    p = fixture(spark, sf_dir, "pts")
    return p.withColumn("pt", _pt()).withColumn("pt_box", _box("lon", "lat", "lon", "lat"))


def zones(spark, sf_dir, prefix: str = "") -> DataFrame:
    z = fixture(spark, sf_dir, "zones").select(F.col("zone_id").alias(f"{prefix}zone_id"), _box().alias(f"{prefix}box"))
    return z


def ellipsoid_distance(spark, sf_dir) -> DataFrame:
    """Metres on WGS 84 from a fixed point; fn_geo_geodesic_distance is the same on a sphere."""
    p = fixture(spark, sf_dir, "pts")
    return p.select("pt_id", F.round(g.ellipsoid_distance(g.point(F.lit(127.0), F.lit(34.0)), _pt()), 3).alias("value"))


def join_points_in_zones(spark, sf_dir) -> DataFrame:
    """Number of points of each zone, borders included."""
    return sj.count_intersecting(points(spark, sf_dir), zones(spark, sf_dir), "pt_box", "box", "zone_id", "n_points")


def join_zones_with_zones(spark, sf_dir) -> DataFrame:
    j = sj.intersects_join(zones(spark, sf_dir, "l_"), zones(spark, sf_dir, "r_"), "l_box", "r_box")
    return j.select("l_zone_id", "r_zone_id")


def join_zones_contain(spark, sf_dir) -> DataFrame:
    j = sj.envelope_join(zones(spark, sf_dir, "l_"), zones(spark, sf_dir, "r_"), "l_box", "r_box", "contains")
    return j.select("l_zone_id", "r_zone_id")


def join_points_within_distance(spark, sf_dir) -> DataFrame:
    return sj.count_later_within(points(spark, sf_dir).withColumnRenamed("pt_id", "l_id"), "l_id", "pt", 1 / 4, "n_near")


def triangles(spark, sf_dir, prefix: str = "") -> DataFrame:
    """The lower left half of each zone as a polygon."""
    corner = lambda *names: F.array(*[g.point(F.col(x), F.col(y)) for x, y in names])
    ring = corner(("minx", "miny"), ("maxx", "miny"), ("minx", "maxy"), ("minx", "miny"))
    return fixture(spark, sf_dir, "zones").select(F.col("zone_id").alias(f"{prefix}zone_id"), sh.of_polygon(F.array(ring)).alias(f"{prefix}shape"))


def join_points_in_polygons(spark, sf_dir) -> DataFrame:
    p = fixture(spark, sf_dir, "pts").select("pt_id", sh.of_point(_pt()).alias("pt"))
    return sj.shape_join(p, triangles(spark, sf_dir), "pt", "shape", "intersects").select("pt_id", "zone_id")


def diagonals(spark, sf_dir) -> DataFrame:
    line = F.array(g.point(F.col("minx"), F.col("miny")), g.point(F.col("maxx"), F.col("maxy")))
    return fixture(spark, sf_dir, "zones").select(F.col("zone_id").alias("line_id"), sh.of_line(line).alias("line"))


def join_lines_with_polygons(spark, sf_dir) -> DataFrame:
    return sj.shape_join(diagonals(spark, sf_dir), triangles(spark, sf_dir), "line", "shape").select("line_id", "zone_id")


def join_shapes_within_distance(spark, sf_dir) -> DataFrame:
    """Points and zones at most an eighth apart."""
    p = fixture(spark, sf_dir, "pts").select("pt_id", sh.of_point(_pt()).alias("pt"))
    z = zones(spark, sf_dir).select("zone_id", sh.of_envelope(F.col("box")).alias("shape"))
    return sj.shape_join(p, z, "pt", "shape", "within_distance(0.125)").select("pt_id", "zone_id")


def join_matches(spark, sf_dir) -> DataFrame:
    """Each point with the zones that hold it, as a list."""
    return sj.intersecting_lists(points(spark, sf_dir), zones(spark, sf_dir), "pt_box", "box", "pt_id", "zone_id", "zones")


def join_key_matches(spark, sf_dir) -> DataFrame:
    p = points(spark, sf_dir)
    key = lambda z: t.quadkey(t.tile_x(_c("lon"), z), t.tile_y(_c("lat"), z), z)
    a, b = p.select(key(6).alias("l_key")).distinct(), p.select(key(9).alias("r_key")).distinct()
    return sj.key_matches(a, b, "l_key", "r_key").groupBy("l_key").agg(F.count("*").alias("n_keys"))


def select_columns(spark, sf_dir) -> DataFrame:
    tables(spark, sf_dir)
    return columns.select(spark.table("customer"), "*-{c_comment, c_mktsegment}, c_name as again")


def select_joined(spark, sf_dir) -> DataFrame:
    tables(spark, sf_dir)
    on = F.col("left.c_nationkey") == F.col("right.n_nationkey")
    return columns.select_joined(spark.table("customer"), spark.table("nation"), on, "left.{c_custkey, c_name as who}, right.n_name as nation")


def key_order(spark, sf_dir) -> DataFrame:
    """Each order's place in the order of a key of three columns."""
    f = fixture(spark, sf_dir, "keys_nullable").select("o_orderkey", "k1", "k2")
    return keys.numbered(f, "k1:DESC:LAST, k2:ASC:FIRST, o_orderkey", "place", scratch(spark, "order")).select("o_orderkey", "place")


def key_groups(spark, sf_dir) -> DataFrame:
    f = keys.flatten(fixture(spark, sf_dir, "keys_nullable"), "k2,k1")
    return f.groupBy("k2", "k1").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def stats_partition(spark, sf_dir) -> DataFrame:
    st = clusters.partition_stats(zones(spark, sf_dir), "box", F.lit(32))
    return st.select(*[F.col("bounds")[k].alias(k) for k in ("minx", "miny", "maxx", "maxy")], "count", "size")


def attach_quadkey(spark, sf_dir) -> DataFrame:
    a = clusters.attach_quadkey(zones(spark, sf_dir), "box", 8)
    return a.groupBy("zone_id").agg(F.count("*").alias("n_tiles"), F.count_if("__owned").alias("n_owned"))


def cluster_statistics(spark, sf_dir) -> DataFrame:
    st = clusters.cluster_stats(clusters.attach_quadkey(zones(spark, sf_dir), "box", 8))
    west = F.round(F.col("quad_bounds")["minx"], 9).alias("west")
    return st.select("quad_key", "minx", "miny", "maxx", "maxy", "count", "replica_count", west)


def sampled_space(spark, sf_dir) -> DataFrame:
    return clusters.sampled_space(points(spark, sf_dir), "pt_box", F.lit(16), 2000)


def range_query(spark, sf_dir) -> DataFrame:
    """Stores zones by quadkey in a scratch folder and queries one range."""
    path = scratch(spark, "zones")
    clusters.store(zones(spark, sf_dir), "box", path, 7)
    return clusters.range_query(spark, path, 127.0, 34.0, 128.5, 36.5, 7).select("zone_id")


def samples(spark, sf_dir) -> DataFrame:
    e = fixture(spark, sf_dir, "events")
    return e.select("user_id", "event_id", d.datetime_to_millis(F.col("ts")).alias("ts"), (F.col("event_id") % 128).cast("double").alias("x"), ((F.col("event_id") * 31) % 128).cast("double").alias("y"))


def trajectory_measures(spark, sf_dir) -> DataFrame:
    ends = F.array("first", "last")
    return trajectories.measures(samples(spark, sf_dir), "user_id", "event_id").select(
        "user_id",
        "n_samples",
        F.round("path_length", 4).alias("path_length"),
        tr.first(ends)["x"].alias("first_x"),
        tr.sample_point(tr.last(ends))["y"].alias("last_y"),
        tr.sample_at(ends, 0)["ts"].alias("first_ts"),
        tr.duration_ms(ends).alias("duration_ms"),
        d.datetime_to_millis(tr.sample_time(tr.last(ends))).alias("last_ts"),
    )


def trajectory_days(spark, sf_dir) -> DataFrame:
    """Each user's trajectory of a day: its span and its line's corners."""
    v = F.col("tr")
    corner = lambda pick, c: pick(F.transform(tr.line(v), lambda p: p[c])).alias(f"{pick.__name__[6:]}_{c}")
    return trajectories.sliced(samples(spark, sf_dir), "user_id", "event_id", 0, 86_400_000).select(
        "user_id", F.col("slice").alias("day"), tr.interval(v)["start_ms"].alias("start_ms"), tr.interval(v)["end_ms"].alias("end_ms"), corner(F.array_min, "x"), corner(F.array_max, "y")
    )


def bind_contained(spark, sf_dir) -> DataFrame:
    """Zones that lie in one tile of zoom 5, of the tiles that have points."""
    p = points(spark, sf_dir)
    leaves = p.select(t.quadkey(t.tile_x(_c("lon"), 5), t.tile_y(_c("lat"), 5), 5).alias("quad_key")).distinct()
    return clusters.bind_contained(zones(spark, sf_dir), "box", leaves).select("zone_id", "quad_key")


P, Z = FIXTURES["pts"], FIXTURES["zones"]


def _key_sql(x: str, y: str, zoom: int) -> str:
    """The quadkey of a tile: of each bit from the highest on, that of x and twice that of y."""
    return " || ".join(f"CAST((({x}) >> {i}) % 2 + 2 * ((({y}) >> {i}) % 2) AS VARCHAR)" for i in reversed(range(zoom)))


def _tile_sql(lon: str, lat: str, zoom: int) -> tuple[str, str]:
    n = 1 << zoom
    return f"CAST({_TX.format(lon=lon, n=n)} AS BIGINT)", f"CAST({_TY.format(lat=lat, n=n)} AS BIGINT)"

_TX = "floor(({lon} + 180) / 360 * {n})"
_TY = "floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * {n})"
_TILES = "({x1} - {x0} + 1) * ({y1} - {y0} + 1)".format(x1=_TX.format(lon="maxx", n=256), x0=_TX.format(lon="minx", n=256), y1=_TY.format(lat="miny", n=256), y0=_TY.format(lat="maxy", n=256))

_X8, _X0 = _tile_sql("maxx", "miny", 8), _tile_sql("minx", "maxy", 8)
_XC = _tile_sql("(minx + maxx) / 2", "(miny + maxy) / 2", 8)
_CLUSTERS = f"""WITH z AS ({Z}), t AS (
  SELECT *, unnest(generate_series({_X0[0]}, {_X8[0]})) AS x FROM z
), u AS (
  SELECT *, unnest(generate_series({_X0[1]}, {_X8[1]})) AS y FROM t
)
SELECT {_key_sql("x", "y", 8)} AS quad_key, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, count(*) AS count,
       count(*) FILTER (x <> {_XC[0]} OR y <> {_XC[1]}) AS replica_count, round(min(x) / 256.0::DOUBLE * 360 - 180, 9) AS west
FROM u GROUP BY x, y"""
_PT = _tile_sql("lon", "lat", 12)
_SPACE = f"""WITH p AS (SELECT {_key_sql(*_PT, 12)} AS k FROM ({P}) p),
l AS (SELECT k, unnest(range(13)) AS z FROM p), s AS (SELECT substr(k, 1, z) AS quad_key, CAST(16 * count(*) AS BIGINT) AS length FROM l GROUP BY ALL)
SELECT a.quad_key, a.length FROM s a LEFT JOIN s b ON len(a.quad_key) > 0 AND b.quad_key = substr(a.quad_key, 1, len(a.quad_key) - 1)
WHERE (a.length <= 2000 OR len(a.quad_key) = 12) AND (len(a.quad_key) = 0 OR b.length > 2000)"""
_P9 = _tile_sql("lon", "lat", 9)
_MATCHES = f"""WITH p AS (SELECT {_P9[0]} AS x, {_P9[1]} AS y FROM ({P}) p)
SELECT {_key_sql("x >> 3", "y >> 3", 6)} AS l_key, count(DISTINCT (x, y)) AS n_keys FROM p GROUP BY x >> 3, y >> 3"""
_TRIANGLE = "x >= minx AND y >= miny AND (x - minx) * (maxy - miny) + (y - miny) * (maxx - minx) <= (maxx - minx) * (maxy - miny)"
# the stretch of the diagonal that is right of, above, and below the three sides of the triangle
_STRETCH = """greatest(0, (b.minx - a.minx) / (a.maxx - a.minx), (b.miny - a.miny) / (a.maxy - a.miny))
   <= least(1, ((b.maxx - b.minx) * (b.maxy - b.miny) - (a.minx - b.minx) * (b.maxy - b.miny) - (a.miny - b.miny) * (b.maxx - b.minx))
              / ((a.maxx - a.minx) * (b.maxy - b.miny) + (a.maxy - a.miny) * (b.maxx - b.minx)))"""
_GAP = "greatest(0, minx - lon, lon - maxx) * greatest(0, minx - lon, lon - maxx) + greatest(0, miny - lat, lat - maxy) * greatest(0, miny - lat, lat - maxy)"

_LOW5, _HIGH5, _P5 = _tile_sql("minx", "miny", 5), _tile_sql("maxx", "maxy", 5), _tile_sql("lon", "lat", 5)
_CONTAINED = f"""WITH p AS (SELECT DISTINCT {_P5[0]} AS x, {_P5[1]} AS y FROM ({P}) p),
z AS (SELECT zone_id, {_LOW5[0]} AS x, {_LOW5[1]} AS y, {_HIGH5[0]} AS u, {_HIGH5[1]} AS v FROM ({Z}) z)
SELECT zone_id, {_key_sql("z.x", "z.y", 5)} AS quad_key FROM z JOIN p ON z.x = p.x AND z.y = p.y WHERE z.x = u AND z.y = v"""

#: name: (query, SQL)
PLANS = {
    "join_points_in_polygons": (join_points_in_polygons, f"SELECT pt_id, zone_id FROM (SELECT pt_id, lon AS x, lat AS y FROM ({P}) p) p JOIN ({Z}) z ON {_TRIANGLE}"),
    "join_lines_with_polygons": (join_lines_with_polygons, f"SELECT a.zone_id AS line_id, b.zone_id FROM ({Z}) a JOIN ({Z}) b ON {_STRETCH}"),
    "join_shapes_within_distance": (join_shapes_within_distance, f"SELECT pt_id, zone_id FROM ({P}) p JOIN ({Z}) z ON {_GAP} <= 0.125 * 0.125"),
    "join_matches": (join_matches, f"SELECT pt_id, string_agg(CAST(zone_id AS VARCHAR), ',' ORDER BY zone_id) AS zones FROM ({P}) p JOIN ({Z}) z ON lon BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy GROUP BY pt_id"),
    "geo_ellipsoid_distance": (ellipsoid_distance, None),
    "join_points_in_zones": (join_points_in_zones, f"SELECT zone_id, count(*) AS n_points FROM ({P}) p JOIN ({Z}) z ON lon BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy GROUP BY zone_id"),
    "join_zones_with_zones": (join_zones_with_zones, f"SELECT a.zone_id AS l_zone_id, b.zone_id AS r_zone_id FROM ({Z}) a JOIN ({Z}) b ON a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy"),
    "join_zones_contain": (join_zones_contain, f"SELECT a.zone_id AS l_zone_id, b.zone_id AS r_zone_id FROM ({Z}) a JOIN ({Z}) b ON a.minx <= b.minx AND b.maxx <= a.maxx AND a.miny <= b.miny AND b.maxy <= a.maxy"),
    "join_points_within_distance": (join_points_within_distance, f"SELECT a.pt_id AS l_id, count(*) AS n_near FROM ({P}) a JOIN ({P}) b ON a.pt_id < b.pt_id AND b.lon BETWEEN a.lon - 0.25 AND a.lon + 0.25 AND (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) <= 0.25 * 0.25 GROUP BY a.pt_id"),
    "join_key_matches": (join_key_matches, _MATCHES),
    "select_columns": (select_columns, "SELECT * EXCLUDE (c_mktsegment) FROM customer"),
    "select_joined": (select_joined, "SELECT c_custkey, c_name AS who, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "key_order": (key_order, f"SELECT o_orderkey, row_number() OVER (ORDER BY k1 DESC NULLS FIRST, k2 ASC NULLS FIRST, o_orderkey) AS place FROM ({FIXTURES['keys_nullable']}) f"),
    "key_groups": (key_groups, f"SELECT k2, k1, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM ({FIXTURES['keys_nullable']}) f GROUP BY k2, k1"),
    "stats_partition": (stats_partition, f"SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, count(*) AS count, CAST(32 * count(*) AS BIGINT) AS size FROM ({Z}) z"),
    "attach_quadkey": (attach_quadkey, f"SELECT zone_id, CAST({_TILES} AS BIGINT) AS n_tiles, CAST(1 AS BIGINT) AS n_owned FROM ({Z}) z"),
    "cluster_statistics": (cluster_statistics, _CLUSTERS),
    "sampled_space": (sampled_space, _SPACE),
    "range_query": (range_query, f"SELECT zone_id FROM ({Z}) z WHERE minx <= 128.5 AND maxx >= 127 AND miny <= 36.5 AND maxy >= 34"),
    "bind_contained": (bind_contained, _CONTAINED),
    "trajectory_days": (
        trajectory_days,
        """SELECT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, min(epoch_us(ts) // 1000) AS start_ms, max(epoch_us(ts) // 1000) AS end_ms,
       min(CAST(event_id % 128 AS DOUBLE)) AS min_x, max(CAST((event_id * 31) % 128 AS DOUBLE)) AS max_y FROM events GROUP BY ALL""",
    ),
    "trajectory_measures": (
        trajectory_measures,
        """WITH s AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS ms, CAST(event_id % 128 AS DOUBLE) AS x, CAST((event_id * 31) % 128 AS DOUBLE) AS y FROM events),
w AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py FROM s WINDOW o AS (PARTITION BY user_id ORDER BY ms, event_id))
SELECT user_id, count(*) AS n_samples,
       round(coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0), 4) AS path_length,
       arg_min(x, (ms, event_id)) AS first_x, arg_max(y, (ms, event_id)) AS last_y, min(ms) AS first_ts, max(ms) - min(ms) AS duration_ms, max(ms) AS last_ts
FROM w GROUP BY user_id""",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"fn_{n}": _scalar(n) for n in SCALARS} | {n: q for n, (q, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {f"fn_{n}": _scalar_sql(n) for n in SCALARS} | {n: sql for n, (_, sql) in PLANS.items() if sql}
