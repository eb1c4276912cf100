"""Packing token sequences by first-fit decreasing with a tournament tree.

Every document becomes the ids of its text and one closing id.  Documents longer
than a sequence are cut into whole sequences and a rest.  Pieces are dealt at
random (by a hash, so reruns agree) into groups of some thousands; each group is
packed alone: pieces by falling length, each into the first open sequence with
room, which the tree of largest free capacities finds in O(log n) steps.

Ids come from the vocabulary's merge ranks through tiktoken where the text has
only characters on which both libraries split alike, else from tokenizers; tests
hold the two against each other.

Cases: null and empty texts are their closing id alone; rows with equal doc_id
are packed each; a null doc_id is packed like any other; a long text is encoded whole,
alone; extra columns are ignored whatever their names; no rows, no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, table

SEQUENCE = 2048
CLOSING = 1
GROUP_PIECES = 8192
_ODD = re.compile("[^\t\n\r -~À-ſ]|<\\|endoftext\\|>")
#: Vocabularies by path, read by a worker when a text first needs them.
_loaded: dict = {}


def vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """Paths of the public vocabulary: tokenizers file and merge ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


def _slow(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _fast(path: str):
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_ids(text: str | None, paths: tuple[str, str]) -> np.ndarray:
    if not text:
        ids = []
    elif _ODD.search(text):
        ids = _slow(paths[0]).encode(text, add_special_tokens=False).ids
    else:
        ids = _fast(paths[1]).encode_ordinary(text)
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = CLOSING
    return out


def pieces(docs: DataFrame, size: int = SEQUENCE, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each document's pieces of at most `size` ids."""
    paths = paths or vocabulary()

    def run(batches):
        pool = pa.default_memory_pool()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py(), paths)
                rows += [(doc, s, min(size, len(ids) - s), zlib.crc32(ids[s : s + size].tobytes()), len(ids)) for s in range(0, len(ids), size)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            pool.release_unused()  # a worker that is kept for later tasks gives its memory back

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class Tournament:
    """Bins in order of opening; the winner of each match is the larger free capacity."""

    def __init__(self, bins: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [0] * (2 * self.leaves)
        self.open = 0

    def _set(self, i: int, room: int) -> None:
        free, i = self.free, i + self.leaves
        free[i] = room
        i >>= 1
        while i:
            a, b = free[2 * i], free[2 * i + 1]
            free[i] = a if a > b else b
            i >>= 1

    def put(self, length: int, size: int) -> tuple[int, int]:
        """The first bin with room for `length` and the offset there, a new one if none has."""
        free, leaves = self.free, self.leaves
        if free[1] < length:
            i, room = self.open, size
            self.open += 1
        else:
            i = 1
            while i < leaves:
                i *= 2
                if free[i] < length:
                    i += 1
            i -= leaves
            room = free[i + leaves]
        self._set(i, room - length)
        return i, size - room


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; lengths must be in falling order."""
    tree, bins, offsets = Tournament(len(lengths)), [], []
    for n in lengths.tolist():
        b, o = tree.put(n, size)
        bins.append(b)
        offsets.append(o)
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def pack(docs: DataFrame, size: int = SEQUENCE, group_pieces: int = GROUP_PIECES, paths: tuple[str, str] | None = None) -> DataFrame:
    """The pieces with sequence_id and offset; a sequence belongs to one group."""
    with small_batches(docs.sparkSession):  # whole texts are in a worker's memory beside the vocabularies
        cut_up = cut(pieces(docs, size, paths), "pieces")
    groups = max(1, round(cut_up.count() / group_pieces))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(t["length"].to_numpy(), size)
        seq = t["group"].to_numpy() * (1 << 32) + bins
        return t.drop_columns("group").append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offsets))

    dealt = cut_up.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op10_packing(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
