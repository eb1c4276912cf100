"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in spark.checkpoint.dir; only where that is unset and all tasks run
    in this process, as in tests, a temporary folder is made and set for the session."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-geosluice-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/geosluice-{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, per_batch: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from per_batch(batch)

    return df.mapInArrow(run, schema)


def id_or_null(name: str):
    return F.col(name).cast("long")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m"):
    """At most `rows` rows and about `size` in an Arrow batch of what runs within: long texts then need less of a worker's memory."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    if not 0 < int(before[0]) <= rows:
        spark.conf.set(keys[0], str(rows))
    spark.conf.set(keys[1], size)
    try:
        yield
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def spread(df: DataFrame) -> int:
    """A number of hash ranges that grows with the input."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())


#: Keys with more rows than this, and so many that at most MOST_HOT keys have them, are met by broadcast.
HOT_ROWS, MOST_HOT = 1000, 100_000


def with_least(rows: DataFrame, keys: list[str], ident: str, name: str) -> DataFrame:
    """rows with the least `ident` of the rows of equal keys, as `name`; keys are not null, rows are cheap to read again.

    The least is found by an aggregation with map-side combine.  Keys of very many rows are at
    most MOST_HOT, so theirs is broadcast, and only the rows of the other keys meet by a shuffle."""
    least = rows.groupBy(*keys).agg(F.min(ident).alias(name), F.count("*").alias("_n"))
    total, largest = least.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    most = max(HOT_ROWS, total // MOST_HOT)
    least, value = least.where("_n > 1"), F.coalesce(name, ident).alias(name)
    if largest <= most:
        return rows.join(least.drop("_n"), keys, "left").select(*rows.columns, value)
    hot = cut(least.where(F.col("_n") > most).drop("_n"), "hot")
    other = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    other = other.join(least.where(F.col("_n") <= most).drop("_n"), keys, "left").select(*rows.columns, value)
    return rows.join(F.broadcast(hot), keys).select(*rows.columns, name).unionByName(other)


def zipped(texts: pa.Array) -> pa.Array:
    """Each text as zstd bytes: what a shuffle carries is then about two thirds of what its own compression leaves."""
    to = zstandard.ZstdCompressor(level=1)
    return pa.array([to.compress(t.encode()) for t in texts.fill_null("").to_pylist()], pa.binary())


def unzipped(blobs: pa.Array) -> pa.Array:
    of = zstandard.ZstdDecompressor()
    return pa.array([of.decompress(b) for b in blobs.to_pylist()], pa.binary()).cast(pa.string())


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores appended where a column is called so (in any case)."""
    known, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in known:
            n += "_"
        known.add(n.lower())
        out.append(n)
    return out
