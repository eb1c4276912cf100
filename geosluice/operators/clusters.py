"""Quadkey clustering: planning tiles, attaching keys, storing, range queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..assumptions import OUTLIER_KEY
from ..functions import geometry as g
from ..functions import tiles as t

#: The column that names folders of stored clusters.
FOLDER = "__folder"


def partition_stats(df: DataFrame, box: str, size: Column | None = None) -> DataFrame:
    """Bounds, count and size of all rows: an associative merge."""
    b = F.col(box)
    bounds = F.struct(F.min(b["minx"]).alias("minx"), F.min(b["miny"]).alias("miny"), F.max(b["maxx"]).alias("maxx"), F.max(b["maxy"]).alias("maxy"))
    return df.agg(bounds.alias("bounds"), F.count(b).alias("count"), F.sum(size if size is not None else F.lit(0)).cast("long").alias("size"))


def sampled_space(df: DataFrame, box: str, size: Column, split_size: int, most: int = 12) -> DataFrame:
    """(quad_key, length): tiles holding at most split_size, or too deep to split.

    Sizes are summed once at the deepest zoom by each box's centre; a tile stays
    whole if its sum fits and its parent's does not, all by aggregation."""
    c = g.centre(F.col(box))
    deep = df.where(t.in_range(F.col(box))).select(t.quadkey(t.tile_x(c["x"], most), t.tile_y(c["y"], most), most).alias("key"), size.cast("long").alias("length"))
    deep = deep.groupBy("key").agg(F.sum("length").alias("length"))
    levels = deep.select("length", "key", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("z"))
    sums = levels.groupBy(F.expr("substring(key, 1, z)").alias("quad_key")).agg(F.sum("length").alias("length"))
    big = sums.where(F.col("length") > split_size).select(F.col("quad_key").alias("parent"))
    kept = sums.where((F.col("length") <= split_size) | (F.length("quad_key") == most))
    kept = kept.withColumn("parent", F.expr("substring(quad_key, 1, length(quad_key) - 1)"))
    return kept.join(big, "parent", "left_semi").select("quad_key", "length").unionByName(kept.where("quad_key = ''").select("quad_key", "length"))


def attach_quadkey(df: DataFrame, box: str, zoom: int, outliers: bool = True, owner_only: bool = False) -> DataFrame:
    """A copy of each row for every tile that its box meets (or the owner's only): __quad_key, __mbr, __owned.

    The owner is the tile of the box's centre.  Rows without a box or outside the
    tiles get the key `outliers`, or go."""
    b = F.col(box)
    c = g.centre(b)
    own = F.struct(t.tile_x(c["x"], zoom).alias("x"), t.tile_y(c["y"], zoom).alias("y"))
    tiles = F.when(t.in_range(b), F.array(own) if owner_only else t.tiles_of(b, zoom))
    out = df.drop("__quad_key", "__mbr", "__owned").withColumn("__tile", F.explode_outer(tiles))
    inside = F.col("__tile").isNotNull()
    out = out.withColumn("__quad_key", F.when(inside, t.quadkey(F.col("__tile")["x"], F.col("__tile")["y"], zoom)).otherwise(OUTLIER_KEY))
    out = out.withColumn("__mbr", F.when(inside, b)).withColumn("__owned", F.when(inside, F.col("__tile") == own).otherwise(True)).drop("__tile")
    return out if outliers else out.where(F.col("__quad_key") != OUTLIER_KEY)


def bind_contained(df: DataFrame, box: str, leaves: DataFrame, most: int = 12) -> DataFrame:
    """Rows with the quad_key of the leaf (a tile of at most `most` levels; leaves do not overlap) that holds the whole box.

    That leaf's key begins the keys of both corners.  Rows that no single leaf holds are not returned."""
    b = F.col(box)
    low, high = t.quadkey(t.tile_x(b["minx"], most), t.tile_y(b["miny"], most), most), t.quadkey(t.tile_x(b["maxx"], most), t.tile_y(b["maxy"], most), most)
    keys = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda z: F.substring(low, F.lit(1), z))
    common = F.filter(keys, lambda k: high.startswith(k))
    rows = df.where(t.in_range(b)).withColumn("quad_key", F.explode(common))
    return rows.join(leaves.select("quad_key"), "quad_key")


def cluster_stats(attached: DataFrame) -> DataFrame:
    """Per quadkey: bounds of its tile (null for outliers), data bounds, count with replicas, and replicas."""
    b = F.col("__mbr")
    bounds = [F.min(b["minx"]).alias("minx"), F.min(b["miny"]).alias("miny"), F.max(b["maxx"]).alias("maxx"), F.max(b["maxy"]).alias("maxy")]
    out = attached.groupBy(F.col("__quad_key").alias("quad_key")).agg(*bounds, F.count("*").alias("count"), F.count_if(~F.col("__owned")).alias("replica_count"))
    tile = t.tile_of(F.col("quad_key"))
    return out.withColumn("quad_bounds", F.when(F.col("quad_key") != OUTLIER_KEY, t.bounds_of(tile)))


def store(df: DataFrame, box: str, path: str, zoom: int) -> None:
    """Rows by quadkey, a folder for each key, and beside them the index of clusters.

    Tiles with very many rows are dealt to several tasks, and files, by their measured size.
    A folder's name is its key behind a letter, as keys of digits alone would be read back as numbers."""
    attached = attach_quadkey(df, box, zoom).withColumn(FOLDER, F.concat(F.lit("q"), "__quad_key"))
    dealt = attached.drop("__quad_key").hint("rebalance", F.col(FOLDER)).sortWithinPartitions(FOLDER, F.desc("__owned"))
    dealt.write.partitionBy(FOLDER).parquet(f"{path}/data")
    cluster_stats(load(df.sparkSession, path)).write.parquet(f"{path}/index")


def load(spark: SparkSession, path: str) -> DataFrame:
    """All rows with replicas; `where __owned` has each row once."""
    return _keyed(spark.read.parquet(f"{path}/data"))


def _keyed(data: DataFrame) -> DataFrame:
    return data.withColumn("__quad_key", F.expr(f"substring({FOLDER}, 2)")).drop(FOLDER)


def range_query(spark: SparkSession, path: str, minx: float, miny: float, maxx: float, maxy: float, zoom: int) -> DataFrame:
    """Rows whose box meets the range, each once: folders of tiles that meet it, a box test, then the owner of the
    reference point.  Outliers match no range."""
    rng = g.envelope(*(F.lit(v) for v in (minx, miny, maxx, maxy)))
    index = spark.read.parquet(f"{path}/index").where(F.col("quad_key") != OUTLIER_KEY)
    hits = index.where(g.meets(F.struct("minx", "miny", "maxx", "maxy"), rng)).select(F.concat(F.lit("q"), "quad_key").alias(FOLDER))
    # the index, a row for each tile, prunes the folders that are read
    data = _keyed(spark.read.parquet(f"{path}/data").join(hits, FOLDER, "left_semi"))
    b = F.col("__mbr")
    middle = lambda low, high, a, z: (F.greatest(b[low], F.lit(float(a))) + F.least(b[high], F.lit(float(z)))) / 2
    owner = t.quadkey(t.tile_x(middle("minx", "maxx", minx, maxx), zoom), t.tile_y(middle("miny", "maxy", miny, maxy), zoom), zoom)
    return data.where(g.meets(F.col("__mbr"), rng) & (owner == F.col("__quad_key")))
