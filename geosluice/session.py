"""Session settings that the functions rely on, and scratch paths that all executors share."""

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """UTC (datetimes are UTC milliseconds) and the TIME type."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.timeType.enabled", "true")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, removed when the application ends.

    Without that setting a temporary folder serves where all tasks run in this process;
    a master that is not local is refused, as executors would write to their own disks."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-geosluice-")
    path = f"{at}/geosluice-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
