"""Exact substring dedup with difference-cover anchors.

A window is `span` consecutive words of one document.  A word goes if a window
that covers it occurs at any other place, in the same document or another one;
windows are judged on the input.

A difference cover D modulo v has, for any two positions p and q, a shift
t < v with p + t and q + t both in D.  So two equal windows share an equal
run of `span - v + 1` words that starts, in both, at a cover position.  Only
those anchors are hashed and compared over the corpus; windows are hashed only
where an anchor of theirs repeats, and they decide.

Hashes have 64 bits: of w different windows about w * w / 2^65 pairs count as equal
(under 1e-3 for 150 million, some millions of 1e13).  They travel as packed arrays, one per slice of text and
hash range; a hash that occurs several times in a slice is sent once, so a
passage that a third of all documents hold is no large group anywhere.

Cases: null and empty texts have no words; texts shorter than a window keep all
words; places belong to a row, known by a 64-bit hash of doc_id and text, so rows
with equal or null doc_id and different texts have places of their own, and rows
equal in both share theirs; a text of any length is read whole, alone if it is long;
an empty table gives an empty result; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread, table
from .words import mix, rolling, slices, words

#: Difference covers by modulus.
COVERS = {
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    21: (3, 6, 7, 12, 14),
    31: (1, 5, 11, 24, 25, 27),
}
SENT = "bucket int, hash binary, doc binary, place binary"
PACKED = "part int, doc binary, place binary"
FOUND = "found_row long, places binary"
#: The filter of repeated anchors is broadcast up to this size; beyond it, anchors are joined.
FILTER_BYTES = 64 << 20
FILTER_BITS = 16


def cover_for(span: int) -> int:
    """The largest modulus that leaves anchors of at least a third of the window."""
    return max((v for v in COVERS if span - v + 1 >= max(2, span // 3)), default=0)


class Places:
    """Hashes of places in a slice of documents: row of the batch and word position."""

    def __init__(self, texts: pa.Array, span: int):
        w = words(texts)
        count = np.diff(w.bounds)
        self.words, self.count = w, count
        self.row = np.repeat(np.arange(len(count)), count)
        self.place = np.arange(len(w.hash)) - np.repeat(w.bounds[:-1], count)
        self.left = np.repeat(count, count) - self.place
        self.whole = rolling(w.hash, span)
        self.span = span

    def anchors(self, modulus: int) -> tuple[np.ndarray, np.ndarray]:
        length = self.span - modulus + 1
        inside = np.zeros(modulus, bool)
        inside[list(COVERS[modulus])] = True
        at = np.flatnonzero((self.left >= length) & inside[self.place % modulus])
        return at, rolling(self.words.hash, length)[at]

    def windows(self, at: np.ndarray, modulus: int) -> np.ndarray:
        """Starts of the windows in which one of the anchors `at` can be the shared one."""
        mark = np.zeros(len(self.place) + modulus + 1, np.int32)
        low = at - np.minimum(self.place[at], modulus - 1)
        np.add.at(mark, low, 1)
        np.add.at(mark, at + 1, -1)
        return np.flatnonzero((np.cumsum(mark)[: len(self.place)] > 0) & (self.left >= self.span))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _ordered(ids: np.ndarray, places: np.ndarray):
    """By document and place, each once: rows equal in id and text name the same places."""
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (places[1:] != places[:-1])
    return ids[new], places[new]


def _runs(ids: np.ndarray, places: np.ndarray):
    """One row of places for each document."""
    ids, places = _ordered(ids, places)
    new = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
    blobs = [x.astype("<i4").tobytes() for x in np.split(places, new[1:])] if len(ids) else []
    return ids[new], blobs


def _send(h, ids, place, buckets):
    """Rows for the exchange: single hashes by range; places known to repeat here go along as they are."""
    order = np.argsort(h, kind="stable")
    h, ids, place = h[order], ids[order], place[order]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    repeat = same.copy()
    repeat[:-1] |= same[1:]
    keep = ~same
    sent_h = h[keep]
    sent_doc = np.where(repeat[keep], 0, ids[keep])
    sent_place = np.where(repeat[keep], -1, place[keep])
    b = _bucket(sent_h, buckets)
    cuts = np.flatnonzero(np.diff(b)) + 1
    rows = []
    for x in np.split(np.arange(len(b)), cuts) if len(b) else []:
        rows.append((int(b[x[0]]), sent_h[x].tobytes(), sent_doc[x].astype("<i8").tobytes(), sent_place[x].astype("<i4").tobytes()))
    for i, (doc, blob) in enumerate(zip(*_runs(ids[repeat], place[repeat]))):
        rows.append((int((int(doc) ^ i) % buckets), None, doc.astype("<i8").tobytes(), blob))
    return rows


def _rows(rows) -> pa.RecordBatch:
    b, h, d, p = zip(*rows)
    return pa.record_batch([pa.array(b, pa.int32()), pa.array(h, pa.binary()), pa.array(d, pa.binary()), pa.array(p, pa.binary())], ["bucket", "hash", "doc", "place"])


def _met(parts: int):
    """Of one hash range, the places whose hash came more than once, packed by ranges of documents."""

    def run(t: pa.Table) -> pa.Table:
        hashes, docs, places, done = [], [], [], []
        for h, d, p in zip(t["hash"].to_pylist(), t["doc"].to_pylist(), t["place"].to_pylist()):
            if h is None:
                p = np.frombuffer(p, "<i4")
                done.append((np.repeat(np.frombuffer(d, "<i8"), len(p)), p))
            else:
                hashes.append(np.frombuffer(h, np.uint64))
                docs.append(np.frombuffer(d, "<i8"))
                places.append(np.frombuffer(p, "<i4"))
        if hashes:
            h, d, p = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
            order = np.argsort(h, kind="stable")
            h, d, p = h[order], d[order], p[order]
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            same[:-1] |= h[1:] == h[:-1]
            hit = same & (p != -1)
            done.append((d[hit], p[hit]))
        doc, place = _ordered(*(np.concatenate(c) for c in zip(*done))) if done else (np.zeros(0, np.int64),) * 2
        to = _bucket(mix(doc.astype(np.uint64)), parts)
        order = np.argsort(to, kind="stable")
        doc, place, to = doc[order], place[order], to[order]
        cuts = np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1) if len(to) else []
        return pa.table(
            {
                "part": pa.array([int(to[x[0]]) for x in cuts], pa.int32()),
                "doc": pa.array([doc[x].astype("<i8").tobytes() for x in cuts], pa.binary()),
                "place": pa.array([place[x].astype("<i4").tobytes() for x in cuts], pa.binary()),
            }
        )

    return run


def _gather(t: pa.Table) -> pa.Table:
    """One row of places for each document of a range."""
    doc, place = (np.concatenate([np.frombuffer(x, d) for x in t[c].to_pylist()]) for c, d in (("doc", "<i8"), ("place", "<i4")))
    ids, blobs = _runs(doc, place)
    return pa.table({"found_row": pa.array(ids, pa.int64()), "places": pa.array(blobs, pa.binary())})


def with_row(docs: DataFrame) -> DataFrame:
    """doc_id, text and what tells rows apart, as `row`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("row", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))


def _repeated(sent: DataFrame, parts: int) -> DataFrame:
    """(found_row, places) of the places whose hash occurs elsewhere, one row for a row of the input."""
    return sent.groupBy("bucket").applyInArrow(_met(parts), PACKED).groupBy("part").applyInArrow(_gather, FOUND)


class Bloom:
    """A filter of 64-bit hashes laid out by hash range, so that ranges are built apart and joined end to end."""

    def __init__(self, parts: list[bytes], buckets: int):
        self.parts, self.buckets = parts, buckets
        self.bits = np.frombuffer(b"".join(parts), np.uint8)
        self.size = len(parts[0]) * 8 if parts else 0

    @staticmethod
    def slots(h: np.ndarray, size: int):
        a, b = h & np.uint64(0xFFFFFFFF), (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        for i in range(4):
            yield ((a + b * np.uint64(i + 1)) % np.uint64(size)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        base = _bucket(h, self.buckets).astype(np.int64) * self.size
        for s in self.slots(h, self.size):
            s += base
            out &= (self.bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
        return out


def repeated_starts(docs: DataFrame, span: int = 35, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(found_row, places), found_row as with_row makes it: starts, as packed int32, of the windows that occur elsewhere too."""
    spark = docs.sparkSession
    docs = with_row(docs).select("row", "text")
    modulus = cover_for(span)
    buckets = spread(docs)  # of the input's size, as a range is met in one task

    def all_windows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b in slices(batch.column(1)):
                p = Places(batch.column(1).slice(a, b - a), span)
                at = np.flatnonzero(p.left >= span)
                if len(at):
                    yield _rows(_send(p.whole[at], ids[a:b][p.row[at]], p.place[at], buckets))

    if not modulus:  # windows too short for anchors: each is compared
        return _repeated(docs.mapInArrow(all_windows, SENT), buckets)

    def anchors(with_places: bool):
        def run(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for a, b in slices(batch.column(1)):
                    p = Places(batch.column(1).slice(a, b - a), span)
                    at, h = p.anchors(modulus)
                    if not len(at):
                        continue
                    if with_places:
                        yield _rows(_send(h, ids[a:b][p.row[at]], p.place[at], buckets))
                        continue
                    u, n = np.unique(h, return_counts=True)
                    cuts = np.searchsorted(_bucket(u, buckets), np.arange(buckets + 1))
                    rows = [(i, u[x:y], n[x:y] > 1) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
                    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([np.packbits(r[2]).tobytes() for r in rows], pa.binary())], ["bucket", "hash", "many"])

        return run

    def live(t: pa.Table) -> pa.Table:
        h = [np.frombuffer(x, np.uint64) for x in t["hash"].to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)).astype(bool) for x, y in zip(t["many"].to_pylist(), h)]
        h, many = np.concatenate(h), np.concatenate(many)
        u, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        n[inverse[many]] += 1
        u = u[n > 1]
        return pa.table({"bucket": t["bucket"].combine_chunks().slice(0, 1), "n": pa.array([len(u)], pa.int64()), "hash": pa.array([u.tobytes()], pa.binary())})

    first = docs.mapInArrow(anchors(False), "bucket int, hash binary, many binary")
    lively = cut(first.groupBy("bucket").applyInArrow(live, "bucket int, n long, hash binary"), "anchors")
    most, total = lively.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    part = max(64, most * FILTER_BITS // 8)
    if part * buckets <= filter_bytes:

        def build(batches):
            for batch in batches:
                for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    bits = np.zeros(part * 8, bool)
                    for s in Bloom.slots(np.frombuffer(blob, np.uint64), part * 8):
                        bits[s] = True
                    yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])

        parts = [bytes(part)] * buckets
        for r in lively.select("bucket", "hash").mapInArrow(build, "bucket int, bits binary").toLocalIterator():  # within filter_bytes
            parts[r.bucket] = bytes(r.bits)
        known = spark.sparkContext.broadcast(parts)

        def candidates(batches):
            bloom = Bloom(known.value, buckets)
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for a, b in slices(batch.column(1)):
                    p = Places(batch.column(1).slice(a, b - a), span)
                    at, h = p.anchors(modulus)
                    at = p.windows(at[bloom.has(h)], modulus)
                    if len(at):
                        yield _rows(_send(p.whole[at], ids[a:b][p.row[at]], p.place[at], buckets))

        return _repeated(docs.mapInArrow(candidates, SENT), buckets)

    def joined(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b in slices(batch.column(1)):
                p = Places(batch.column(1).slice(a, b - a), span)
                known = [np.frombuffer(x, "<i4").astype(np.int64) for x in batch.column(2).slice(a, b - a).to_pylist()]
                at = np.unique(np.concatenate([x[x < n] + low for x, n, low in zip(known, p.count, p.words.bounds)]))
                at = p.windows(at, modulus)
                if len(at):
                    yield _rows(_send(p.whole[at], ids[a:b][p.row[at]], p.place[at], buckets))

    found = _repeated(docs.mapInArrow(anchors(True), SENT), buckets)
    both = docs.join(found, F.col("row") == F.col("found_row"))
    return _repeated(both.select("row", "text", "places").mapInArrow(joined, SENT), buckets)


def substring_dedup(docs: DataFrame, span: int = 35, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the kept words joined by single spaces (kept_text)."""
    docs = with_row(docs)
    found = repeated_starts(docs, span, filter_bytes)
    both = docs.join(found, F.col("row") == F.col("found_row"), "left")

    def keep(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                w = words(part.column(1))
                n = np.diff(w.bounds)
                gone = np.zeros(len(w.hash) + 1, np.int32)
                for i, places in enumerate(part.column(2).to_pylist()):
                    if places:
                        s = np.unique(np.frombuffer(places, "<i4")).astype(np.int64)
                        s = s[s + span <= n[i]] + w.bounds[i]
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + span, -1)
                removed = np.cumsum(gone)[:-1] > 0
                total = np.concatenate(([0], np.cumsum(removed)))
                kept = []
                for i in range(len(n)):
                    x, y = w.bounds[i], w.bounds[i + 1]
                    mine = np.flatnonzero(~removed[x:y]) + x
                    kept.append(b" ".join([w.data[s:e].tobytes() for s, e in zip(w.start[mine].tolist(), w.end[mine].tolist())]))
                yield pa.record_batch(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(total[w.bounds[1:]] - total[w.bounds[:-1]], pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    out = both.select("doc_id", "text", "places").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept binary")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def op3_substring_dedup(spark, sf_dir) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


__all__ = ["op3_substring_dedup", "repeated_starts", "substring_dedup"]
