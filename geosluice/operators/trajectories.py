"""Measures of trajectories of any length: a mover's samples in slices of time, and the steps between slices.

No array and no window holds more than about the square root of all rows, if times
spread evenly: there are that many slices, so a mover with a third of all rows has
that many samples in each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import trajectory as tr


def slice_width(samples: DataFrame, ts: str = "ts") -> tuple[int, int]:
    """(start, width) in milliseconds of as many equal slices as the square root of the number of rows."""
    low, high, n = samples.agg(F.min(ts), F.max(ts), F.count(ts)).first()
    return (low, max(1, math.ceil((high - low + 1) / math.ceil(n**0.5)))) if n else (0, 1)


def sliced(samples: DataFrame, by: str, tie: str, start: int, width: int) -> DataFrame:
    """(by, slice, tr): the trajectory within each slice of time; samples (x, y, ts) of one time are ordered by `tie`.

    Samples without a time are left out."""
    at = F.floor((F.col("ts") - start) / width).alias("slice")
    ordered = F.array_sort(F.collect_list(F.struct("ts", tie, "x", "y")))
    got = samples.where(F.col("ts").isNotNull()).groupBy(by, at).agg(ordered.alias("s"))
    return got.select(by, "slice", F.transform("s", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["ts"].alias("ts"))).alias("tr"))


def measures(samples: DataFrame, by: str, tie: str, slices: tuple[int, int] | None = None) -> DataFrame:
    """(by, n_samples, path_length, first, last) of each mover; first and last are samples."""
    start, width = slices or slice_width(samples)
    v = F.col("tr")
    parts = sliced(samples, by, tie, start, width).select(by, "slice", tr.sample_count(v).alias("n"), tr.length(v).alias("length"), tr.first(v).alias("first"), tr.last(v).alias("last"))
    before = F.lag("last").over(Window.partitionBy(by).orderBy("slice"))
    step = F.when(before.isNull(), 0.0).otherwise(g.distance(tr.sample_point(before), tr.sample_point(F.col("first"))))
    parts = parts.withColumn("step", step)
    total = F.sum(F.col("length") + F.col("step")).alias("path_length")
    return parts.groupBy(by).agg(F.sum("n").alias("n_samples"), total, F.min_by("first", "slice").alias("first"), F.max_by("last", "slice").alias("last"))
