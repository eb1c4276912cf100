"""Datasets as Parquet folders, with a catalog kept as a small Parquet table.

Ids look like folders: `/a/b`.  A dataset cannot lie below another one, nor have
the id of a folder.  The catalog is metadata of a few rows per dataset."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.clusters import partition_stats, store

#: Names of compression codecs and what Parquet calls them.
CODECS = {"snappy": "snappy", "gzip": "gzip", "gz": "gzip", "zip": "gzip", "lz4": "lz4", "zstd": "zstd"}
ENTRY = "id string, folder string, path string, geom_column string, srid string, bounds string, count long, index_path string, index_zoom int, version long"
FIELDS = ("id", "folder", "path", "geom_column", "srid", "bounds", "count", "index_path", "index_zoom")
EDGES = ("minx", "miny", "maxx", "maxy")


def normal_id(text: str) -> str:
    """Trimmed, with a leading slash and without a trailing one."""
    text = "/" + text.strip().lstrip("/")
    return text[:-1] if len(text) > 1 and text.endswith("/") else text


def folder_of(ident: str) -> str:
    return normal_id(ident).rpartition("/")[0] or "/"


def normal_id_column(text: Column) -> Column:
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.trim(text), "^/+", ""), "/$", ""))


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._rows: dict[str, dict] = {}

    def _check(self, ident: str) -> None:
        if ident in self._rows:
            raise ValueError(f"dataset exists: {ident}")
        if any(ident.startswith(i + "/") for i in self._rows):
            raise ValueError(f"a dataset lies above: {ident}")
        if self.is_folder(ident):
            raise ValueError(f"id is a folder: {ident}")

    def is_folder(self, ident: str) -> bool:
        ident = normal_id(ident)
        return any(i.startswith(ident.rstrip("/") + "/") for i in self._rows)

    def create(self, ident: str, df: DataFrame, box: str | None = None, srid: str = "EPSG:4326", codec: str = "zstd", replace: bool = False) -> dict:
        """Write df as a dataset; its bounds and count are observed while it is written."""
        ident = normal_id(ident)
        if replace:
            self.delete(ident)
        self._check(ident)
        path = f"{self.root}/{uuid.uuid4().hex}"
        seen = Observation()
        edges = [F.min(F.col(box)[c] if c.startswith("min") else -F.col(box)[c]).alias(c) for c in EDGES] if box else []
        df.observe(seen, F.count(F.lit(1)).alias("count"), *edges).write.option("compression", CODECS[codec.lower()]).parquet(path)
        self._rows[ident] = {"id": ident, "folder": folder_of(ident), "path": path, "geom_column": box, "srid": srid, **self._stats(seen.get)}
        return self._rows[ident]

    @staticmethod
    def _stats(seen: dict) -> dict:
        known = seen.get("minx") is not None
        return {"bounds": ";".join(str(seen[c] if c.startswith("min") else -seen[c]) for c in EDGES) if known else "", "count": seen["count"]}

    def append(self, ident: str, df: DataFrame, codec: str = "zstd") -> dict:
        """Add rows to a dataset, in its columns' order and types; its statistics are taken anew."""
        row = self._rows[normal_id(ident)]
        old = self.spark.read.parquet(row["path"]).schema
        df.select(*[F.col(f.name).cast(f.dataType) for f in old]).write.mode("append").option("compression", CODECS[codec.lower()]).parquet(row["path"])
        return self.update_statistics(ident)

    def update_statistics(self, ident: str) -> dict:
        """Count and bounds of a dataset, read from its rows."""
        row = self._rows[normal_id(ident)]
        df = self.read(ident)
        stats = partition_stats(df, row["geom_column"]).first() if row["geom_column"] else None
        known = stats is not None and stats["bounds"]["minx"] is not None
        row["bounds"] = ";".join(str(v) for v in stats["bounds"]) if known else ""
        row["count"] = df.count()
        return row

    def range_query(self, ident: str, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
        """Rows whose box meets the range, borders included; the test on box edges reaches the Parquet scan."""
        row = self._rows[normal_id(ident)]
        if not row["geom_column"]:
            raise ValueError(f"no box column: {row['id']}")
        box = F.col(row["geom_column"])
        return self.read(ident).where((box["minx"] <= maxx) & (box["maxx"] >= minx) & (box["miny"] <= maxy) & (box["maxy"] >= miny))

    def create_index(self, ident: str, zoom: int) -> str:
        """Cluster a dataset by quadkeys of a zoom; the entry is the dataset's spatial index until it is dropped."""
        row = self._rows[normal_id(ident)]
        if row.get("index_path"):
            raise ValueError(f"index exists: {row['id']}")
        path = f"{self.root}/{uuid.uuid4().hex}"
        store(self.read(ident), row["geom_column"], path, zoom)
        row["index_path"], row["index_zoom"] = path, zoom
        return path

    def index_of(self, ident: str) -> dict | None:
        """The index entry: id, box column, srid, path and zoom."""
        row = self._rows[normal_id(ident)]
        if not row.get("index_path"):
            return None
        return {"id": row["id"], "geom_column": row["geom_column"], "srid": row["srid"], "path": row["index_path"], "zoom": row["index_zoom"]}

    def drop_index(self, ident: str) -> bool:
        row = self._rows[normal_id(ident)]
        return (row.pop("index_path", None), row.pop("index_zoom", None))[0] is not None

    def delete_folder(self, folder: str) -> list[str]:
        """Take every dataset in the folder or below it out of the catalog."""
        gone = self.listed(folder)
        for ident in gone:
            del self._rows[ident]
        return gone

    def read(self, ident: str) -> DataFrame:
        return self.spark.read.parquet(self._rows[normal_id(ident)]["path"])

    def get(self, ident: str) -> dict | None:
        return self._rows.get(normal_id(ident))

    def listed(self, folder: str = "/", recursive: bool = True) -> list[str]:
        folder = normal_id(folder)
        return sorted(i for i, r in self._rows.items() if r["folder"] == folder or recursive and (r["folder"] + "/").startswith(folder.rstrip("/") + "/"))

    def folders(self, folder: str = "/") -> list[str]:
        """Direct subfolders."""
        top = normal_id(folder).rstrip("/") + "/"
        return sorted({r["folder"][len(top) :].split("/")[0] for r in self._rows.values() if (r["folder"] + "/").startswith(top) and len(r["folder"]) > len(top) - 1} - {""})

    def delete(self, ident: str) -> bool:
        return self._rows.pop(normal_id(ident), None) is not None

    def save(self) -> None:
        """The catalog as a new version of its table; readers take the newest."""
        rows = [tuple(r.get(c) for c in FIELDS) for r in self._rows.values()]
        now = max([0, *self._versions()]) + 1
        self.spark.createDataFrame([(*r, now) for r in rows], ENTRY).write.mode("append").parquet(f"{self.root}/catalog")

    def _versions(self) -> list[int]:
        try:
            return [r[0] or 0 for r in self.spark.read.schema(ENTRY).parquet(f"{self.root}/catalog").agg(F.max("version")).collect()]
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Catalog:
        out = cls(spark, root)
        newest = max([0, *out._versions()])
        if newest:
            for r in spark.read.schema(ENTRY).parquet(f"{out.root}/catalog").where(F.col("version") == newest).collect():
                out._rows[r["id"]] = {k: r[k] for k in FIELDS}
        return out
