"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are integers floor(256 * x).  They are laid out in blocks of some
thousands, each with its ids sorted along every dimension.  For a query, lists
are read from the end that its component favours, a growing stretch at a time;
vectors met are scored in full (random access), and reading stops as soon as
the bound, the score that the values at the reading positions would make, is
below the kth result found so far.  A vector not yet met cannot beat that.

Queries meet every block of their length by an equi-join on the block number,
query blocks against vector blocks, and partial results of k rows a block are
ranked at the end.  That join is a merge of shuffled rows whatever the tables' size
on disk: packed blocks are far smaller there than in memory, and one block of
queries stands in as many rows as there are vector blocks, so a broadcast would
bring the square of the input to the driver.  Blocks are packed in the narrowest
integers that hold them.

Cases: vectors null, empty, or holding null or non-finite components take no
part, as query or candidate; vectors of different lengths do not meet; equal
scores go to the smaller vec_id; rows with equal vec_id are candidates each,
and none is a candidate for a query of its own id; a null vec_id takes no part; extra
columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

BLOCK = 8192
QUERY_BLOCK = 1024
SCALE = 256


def _usable(vectors: DataFrame) -> DataFrame:
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & sound)
    return v.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("v"))


def _packed(rows: np.ndarray) -> bytes:
    """Integers in the narrowest of 2, 4 or 8 bytes that holds them all."""
    low, high = int(rows.min(initial=0)), int(rows.max(initial=0))
    fits = [t for t in ("<i2", "<i4") if np.iinfo(t).min <= low and high <= np.iinfo(t).max]
    return rows.astype(fits[0] if fits else "<i8").tobytes()


def _unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (n * dim)}").astype("<i8").reshape(n, dim)


def _blocks(v: DataFrame, rows: int, name: str) -> DataFrame:
    """(dim, block, ids, data): rows dealt by hash into blocks, packed: ids of 8 bytes, data of 2, 4 or 8."""
    counts = v.groupBy("dim").count()
    v = v.join(F.broadcast(counts), "dim") if counts.count() <= 10_000 else v.join(counts, "dim")
    v = v.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("count") / rows)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        data = t["v"].combine_chunks()
        flat = data.flatten().to_numpy().astype("<i8")
        order = np.argsort(t["vec_id"].to_numpy(), kind="stable")
        flat = flat.reshape(len(order), -1)[order]
        return pa.table({"dim": t["dim"].slice(0, 1), "block": t["block"].slice(0, 1), "blocks": t["blocks"].slice(0, 1), "ids": pa.array([t["vec_id"].to_numpy()[order].astype("<i8").tobytes()], pa.binary()), "data": pa.array([_packed(flat)], pa.binary())})

    v = v.withColumn("blocks", F.ceil(F.col("count") / rows).cast("int")).select("dim", "block", "blocks", "vec_id", "v")
    return cut(v.groupBy("dim", "block").applyInArrow(run, "dim int, block int, blocks int, ids binary, data binary"), name)


class Lists:
    """A block with its sorted lists: order[d] has the rows by rising component d."""

    def __init__(self, ids: bytes, data: bytes, dim: int):
        self.ids = np.frombuffer(ids, "<i8")
        self.rows = _unpacked(data, len(self.ids), dim)
        big = int(np.abs(self.rows).max(initial=0))
        self.exact = dim * big * big < 1 << 53  # double products stay whole
        if self.exact:
            self.rows = self.rows.astype(np.float64)
        self.order = np.argsort(self.rows, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.rows, self.order.T, axis=0).T

    def best(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best by the threshold algorithm; rows are in id order."""
        n = len(self.ids)
        q = query.astype(self.rows.dtype)
        used = np.flatnonzero(q)
        up, low = used[q[used] > 0], used[q[used] < 0]
        seen = np.zeros(n, bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)
        depth, step = 0, max(k, 16)
        while depth < n:
            to = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.order[up, n - to : n - depth]] = True
            met[self.order[low, depth:to]] = True
            if not len(used):
                met[:] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            fresh = fresh[self.ids[fresh] != own]
            ids = np.concatenate((ids, self.ids[fresh]))
            scores = np.concatenate((scores, self.rows[fresh] @ q))
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
            bound = self.sorted[up, n - to] @ q[up] + self.sorted[low, to - 1] @ q[low]
            if seen.all() or (len(ids) == k and scores[-1] > bound):
                break
            depth, step = to, step * 4
        return [(int(s), int(i)) for s, i in zip(scores, ids)]


def top_k(vectors: DataFrame, is_query, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors for every vector that is_query holds for."""
    v = _usable(vectors)
    lists = _blocks(v, block, "lists")
    queries = _blocks(v.where(is_query), QUERY_BLOCK, "queries").select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    number = lists.groupBy("dim").agg(F.max("blocks").alias("blocks"))
    pairs = queries.join(number, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").join(lists.drop("blocks").hint("merge"), ["dim", "block"])
    pairs = pairs.sortWithinPartitions("dim", "block")

    def run(batches):
        held = None
        for batch in batches:
            for r in range(batch.num_rows):
                dim, block, q_ids, q_data, ids, data = (batch.column(c)[r].as_py() for c in range(6))
                if held is None or held[0] != (dim, block):
                    held = (dim, block), Lists(ids, data, dim)
                rows, q_ids = [], np.frombuffer(q_ids, "<i8").tolist()
                for qid, q in zip(q_ids, _unpacked(q_data, len(q_ids), dim)):
                    rows += [(qid, i, s) for s, i in held[1].best(q, qid, k)]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["query_id", "vec_id", "score"])

    part = pairs.select("dim", "block", "q_ids", "q_data", "ids", "data").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark, sf_dir) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
