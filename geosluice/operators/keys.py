"""Multi-column keys `name[:ASC|DESC|NONE[:FIRST|LAST]]` for grouping and order.

Without a null order, nulls come last.  For descending columns FIRST and LAST
have always meant the opposite end, which is kept: DESC:FIRST puts nulls last.
NONE is for grouping only and never sorts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDERS = {"ASC": "ASC", "A": "ASC", "DESC": "DESC", "D": "DESC", "NONE": "NONE", "N": "NONE"}
NULLS = {"FIRST": "FIRST", "F": "FIRST", "LAST": "LAST", "L": "LAST"}


@dataclass(frozen=True)
class Key:
    name: str
    order: str = "ASC"
    nulls: str = "LAST"

    @staticmethod
    def of(text: str) -> Key:
        parts = [p.strip() for p in text.split(":")]
        order = ORDERS[parts[1].upper()] if len(parts) > 1 else "ASC"
        nulls = NULLS[parts[2].upper()] if len(parts) > 2 else ("LAST" if order == "ASC" else "FIRST")
        return Key(parts[0], order, nulls)

    def column(self) -> Column | None:
        c = F.col(self.name)
        if self.order == "NONE":
            return None
        if self.order == "ASC":
            return c.asc_nulls_first() if self.nulls == "FIRST" else c.asc_nulls_last()
        return c.desc_nulls_last() if self.nulls == "FIRST" else c.desc_nulls_first()


def keys(text: str) -> list[Key]:
    return [Key.of(t) for t in text.split(",") if t.strip()]


def ordering(text: str) -> list[Column]:
    return [c for k in keys(text) if (c := k.column()) is not None]


def complement(text: str, columns: list[str]) -> list[str]:
    """The columns that are not in the key."""
    own = {k.name.lower() for k in keys(text)}
    return [c for c in columns if c.lower() not in own]


def flatten(df: DataFrame, text: str) -> DataFrame:
    """Key columns first, then the others."""
    return df.select(*[k.name for k in keys(text)], *complement(text, df.columns))


def numbered(df: DataFrame, text: str, name: str, path: str) -> DataFrame:
    """df with each row's place from 1 in the key's order over the whole table, in column `name`.

    Rows are sorted in ranges and written to `path`, so that places come from one run;
    a range's first place is the sum of the ranges before it, a row for each range."""
    part, at = f"__part_{name}", f"__at_{name}"
    df.orderBy(*ordering(text)).select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(at)).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    ranges = rows.groupBy(part).agg(F.count("*").alias("__n"), F.min(at).alias("__first"))
    before = F.sum("__n").over(Window.orderBy(part)) - F.col("__n")
    shift = ranges.select(part, (before - F.col("__first") + 1).alias(name))
    return rows.drop(name).join(F.broadcast(shift), part).withColumn(name, F.col(name) + F.col(at)).drop(part, at)


def grouped(df: DataFrame, text: str, function, schema: str) -> DataFrame:
    """A function of each group's rows; nulls of a key make one group."""
    return df.groupBy(*[k.name for k in keys(text)]).applyInPandas(function, schema)
