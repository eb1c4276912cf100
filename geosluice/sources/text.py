"""Text files as rows of one column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str, comment: str | None = None, legacy: bool = False) -> DataFrame:
    """Lines as `text`; lines that start with the comment marker are skipped.  `legacy` keeps only them."""
    lines = spark.read.text(path).select(F.col("value").alias("text"))
    if not comment:
        return lines
    marked = F.startswith("text", F.lit(comment))
    return lines.where(marked if legacy else ~marked)
