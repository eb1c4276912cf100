"""Trajectories: array<struct<x, y, ts>> with ts in epoch milliseconds, in time order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g


def line(tr: Column) -> Column:
    return F.transform(tr, lambda s: g.point(s["x"], s["y"]))


def sample_count(tr: Column) -> Column:
    return F.when(tr.isNull(), 0).otherwise(F.size(tr))


def length(tr: Column) -> Column:
    return g.length(line(tr))


def sample_at(tr: Column, i: int) -> Column:
    """The sample at a place from 0; out of range is an error."""
    return F.element_at(tr, F.lit(i + 1))


def first(tr: Column) -> Column:
    return F.get(tr, F.lit(0))


def last(tr: Column) -> Column:
    return F.get(tr, F.size(tr) - 1)


def sample_point(sample: Column) -> Column:
    return g.point(sample["x"], sample["y"])


def sample_time(sample: Column) -> Column:
    return F.timestamp_millis(sample["ts"]).cast("timestamp_ntz")


def duration_ms(tr: Column) -> Column:
    return last(tr)["ts"] - first(tr)["ts"]


def interval(tr: Column) -> Column:
    return F.struct(first(tr)["ts"].alias("start_ms"), last(tr)["ts"].alias("end_ms"))
