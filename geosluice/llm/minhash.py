"""MinHash fingerprints and near duplicates by signature bands.

A document is the set of its five-word shingles (fewer words: the whole
sequence as one).  Each of the `SIGNATURE` permutations x -> a * x + b modulo
2^32, a odd, is applied to all shingles of a slice at once in numpy, and the
smallest value per document is kept, folded to 16 bits.  The fingerprint is
their hexadecimal text, and the likeness of two is the share of equal places,
which estimates the Jaccard similarity of the sets.

Near duplicates are documents whose signatures share a band and whose sets are
found alike when compared as a whole; `component_id` is the smallest doc_id that
such links reach.  Equal sets are one document there, and of bands only those that
two different sets share leave the range of hashes that they meet in.

Texts travel as zstd bytes, once for the rows in order, and once more for each cell
in which a candidate of theirs is verified.

Cases: null counts as empty; documents without words have one fixed fingerprint
and are alike; equal texts have equal fingerprints.  Rows are ordered by doc_id,
null first, then by a hash of the text; the row after the last is the first.
Documents without words are linked with nothing, and a null doc_id has a null
component; rows with equal doc_id are fingerprinted each and are one document of
the graph.  Texts of any length are read whole; extra columns are ignored whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, spread, table, unzipped, with_least, zipped
from .ngram_join import linked_members
from .words import distinct, mix, shingles, slices, words

SIGNATURE = 64
SHINGLE = 5
_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)


def signatures(texts: pa.Array, k: int = SHINGLE, lower: bool = False) -> np.ndarray:
    """One row of SIGNATURE 16-bit values for each text; `lower` folds A-Z only."""
    out = np.full((len(texts), SIGNATURE), 0xFFFFFFFF, np.uint32)
    for x, y in slices(texts, 1 << 20):
        h, bounds = shingles(words(texts.slice(x, y - x), lower), k)
        some = np.flatnonzero(np.diff(bounds))
        if not len(some):
            continue
        v = (h >> np.uint64(32)).astype(np.uint32)
        step = np.empty_like(v)
        for i in range(SIGNATURE):
            np.multiply(v, _A[i], out=step)
            step += _B[i]
            out[x + some, i] = np.minimum.reduceat(step, bounds[some])
    return (out * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


DEALT = "doc_id long, packed binary, h long, part int, tail boolean, component long"
DEALT_COLUMNS = ["doc_id", "packed", "h", "part", "tail", "component"]
#: Rows sampled, by hash, for each bound between parts.
SAMPLED = 20


def with_next(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, packed, part, tail, component): docs (doc_id, text) in parts whose rows are in order, texts packed, each
    part followed by the row after it (tail), so that a task sees every row with its next one.

    Rows of `found` (node, component), packed null, go to the parts that have their id, before its documents.

    Parts are bounded by (doc_id, hash of the text), so the rows of one id, or of none,
    can be many parts; a bound is a row that occurs, so it is found by equality.  The
    shuffle carries every text once, and the bounds' texts twice."""
    spark = docs.sparkSession
    keyed = docs.withColumn("h", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("i"), "h")
    n, least = keyed.agg(F.count("*"), F.min(key)).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    share = F.pmod(F.xxhash64("doc_id", "h"), F.lit(1 << 30)) < min(1.0, SAMPLED * parts / max(n, 1)) * (1 << 30)
    seen = sorted({tuple(r[0]) for r in keyed.where(share).select(key).distinct().collect()})  # about SAMPLED a part
    bounds = sorted({*seen[::SAMPLED], *([tuple(least)] if least else [])})
    last = max(0, len(bounds) - 1)

    def deal(batches):
        for batch in batches:
            for x, y in slices(batch.column(1), 4 << 20):
                ids, texts, h = (batch.column(c).slice(x, y - x) for c in range(3))
                packed, keys = zipped(texts), [(i is not None, i or 0, v) for i, v in zip(ids.to_pylist(), h.to_pylist())]
                to = [bisect.bisect_right(bounds, k) - 1 for k in keys]
                yield pa.record_batch([ids, packed, h, pa.array(to, pa.int32()), pa.array([False] * len(to)), pa.nulls(len(to), pa.int64())], DEALT_COLUMNS)
                ends = pa.array([j for j, k in enumerate(keys) if bounds[to[j]] == k], pa.int64())
                before = pa.array([to[j] - 1 if to[j] else last for j in ends.to_pylist()], pa.int32())
                yield pa.record_batch([ids.take(ends), packed.take(ends), h.take(ends), before, pa.array([True] * len(ends), pa.bool_()), pa.nulls(len(ends), pa.int64())], DEALT_COLUMNS)

    def label(batches):
        low, high = -(1 << 63), 1 << 63
        for batch in batches:
            rows = [(i, p, c) for i, c in zip(*(v.to_pylist() for v in batch.columns)) for p in range(max(0, bisect.bisect_right(bounds, (True, i, low)) - 1), bisect.bisect_right(bounds, (True, i, high)))]
            if rows:
                i, p, c = zip(*rows)
                yield pa.record_batch([pa.array(i, pa.int64()), pa.nulls(len(i), pa.binary()), pa.array([0] * len(i), pa.int64()), pa.array(p, pa.int32()), pa.array([False] * len(i)), pa.array(c, pa.int64())], DEALT_COLUMNS)

    sent = keyed.mapInArrow(deal, DEALT)
    if found is not None:
        sent = sent.union(found.select("node", "component").mapInArrow(label, DEALT))
    sent = sent.repartitionById(last + 1, F.col("part"))
    return sent.sortWithinPartitions("part", "tail", "doc_id", F.col("packed").isNotNull(), "h").drop("h")


def fingerprints(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id for each
    row; component_id is by `found` (node, component), else the doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        held = None  # the last row so far: id, text, signature, part, component
        known_in: dict[int, int] = {}  # components of nodes from this one on
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                piece = batch.slice(x, 256)
                for node in piece.filter(piece.column(1).is_null()).select([0, 4]).to_pylist():
                    known_in[node["doc_id"]] = node["component"]
                piece = piece.filter(piece.column(1).is_valid())
                ids, parts, tails = (piece.column(c).to_pylist() for c in (0, 2, 3))
                unpacked = unzipped(piece.column(1))
                texts, sig = unpacked.to_pylist(), signatures(unpacked)
                rows, edits, pairs = [], [], []
                for i, text in enumerate(texts):
                    if held is not None and held[3] == parts[i]:
                        rows.append(held)
                        edits.append(_edited(held[1], text))
                        pairs.append(sig[i])
                    held = None if tails[i] else (ids[i], text, sig[i], parts[i], known_in.get(ids[i], ids[i]))
                if len(known_in) > 1000:  # rows come by id: what is behind is done with
                    known_in = {k: v for k, v in known_in.items() if ids and k >= (ids[-1] or 0)}
                if not rows:
                    continue
                own, after = np.array([r[2] for r in rows]), np.array(pairs)
                changed = signatures(pa.array(edits, pa.string()))
                yield pa.record_batch(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([len(r[1]) for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]),
                        pa.array([s.astype(">u2").tobytes().hex() for s in own]),
                        pa.array([s.astype(">u2").tobytes().hex() for s in changed]),
                        pa.array((own == changed).mean(axis=1)),
                        pa.array((own == after).mean(axis=1)),
                        pa.array([r[4] for r in rows], pa.int64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"],
                )

    return with_next(docs, found).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long")


def signed(docs: DataFrame, bands: int) -> DataFrame:
    """(doc_id, n, key_a, key_b, bands): set size, keys that are equal for equal sets, and the bands' hashes."""

    def run(batches):
        for batch in batches:
            for x, y in slices(batch.column(1), 1 << 20):
                texts = batch.column(1).slice(x, y - x)
                sig = signatures(texts, lower=True).reshape(y - x, bands, -1)
                key = np.zeros(sig.shape[:2], np.uint64)
                for i in range(sig.shape[2]):
                    key = key * np.uint64(0x100000001B3) + sig[:, :, i]
                key = mix(key * np.uint64(bands) + np.arange(bands, dtype=np.uint64))
                sets = distinct(*shingles(words(texts, lower=True), SHINGLE))
                a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                b = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                yield pa.record_batch(
                    [batch.column(0).slice(x, y - x), pa.array([len(s) for s in sets], pa.int32()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([k.tobytes() for k in key], pa.binary())],
                    ["doc_id", "n", "key_a", "key_b", "bands"],
                )

    some = docs.where("rlike(text, '[^\\\\x20\\\\x09-\\\\x0D]')")
    return some.mapInArrow(run, "doc_id long, n int, key_a long, key_b long, bands binary")


def band_members(sets: DataFrame, parts: int) -> DataFrame:
    """(key, doc_id, n) of the bands that two rows of sets (doc_id, n, bands) share at least, met by ranges of hashes."""

    def send(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
            each = len(keys) // batch.num_rows
            to = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            owner = order // each
            cols = [np.ascontiguousarray(c, d) for c, d in ((keys[order], "<u8"), (batch.column(0).to_numpy()[owner], "<i8"), (batch.column(1).to_numpy()[owner], "<i4"))]
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1, append=parts))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield pa.record_batch([pa.array([int(to[order[x]])], pa.int32()), *(pa.array([c[x:y].tobytes()], pa.binary()) for c in cols)], ["range", "h", "doc", "n"])

    def meet(t: pa.Table) -> pa.Table:
        h, doc, n = (np.concatenate([np.frombuffer(v, d) for v in t[c].to_pylist()]) for c, d in (("h", "<u8"), ("doc", "<i8"), ("n", "<i4")))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        return pa.table({"key": h[order].view(np.int64), "doc_id": doc[order], "n": n[order]})

    sent = sets.select("doc_id", "n", "bands").mapInArrow(send, "range int, h binary, doc binary, n binary")
    return sent.groupBy("range").applyInArrow(meet, "key long, doc_id long, n int")


def band_components(docs: DataFrame, percent: int = 80, bands: int = 16) -> DataFrame:
    """(node, component) of the documents that are linked with another one.

    Links are between equal sets, and between any two documents that share a band and
    whose whole shingle sets have the Jaccard similarity asked for: the members of a
    band are compared with one leader, those still apart then in pairs or blocks, as
    in ngram_join.  Sets, and signatures here, fold A-Z.  With 16 bands of 4, a pair at 0.8 shares no band once in 5000."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    equal, parts = ["n", "key_a", "key_b"], spread(docs)
    with small_batches(docs.sparkSession):
        every = cut(signed(docs, bands), "signed")
        known = cut(with_least(every.select("doc_id", *equal), equal, "doc_id", "rep").select("doc_id", "rep").distinct(), "reps")
        sets = every.groupBy(*equal).agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"))
        members = band_members(sets, parts)
        # no place in a prefix and no count of tokens: only the ratio of sizes rules a pair out unverified
        members = cut(members.select("key", "n", F.lit(-1).alias("place"), F.col("n").alias("dense"), "doc_id"), "members")
        return linked_members(docs, members, known, SHINGLE, percent)


def near_duplicates(docs: DataFrame, percent: int = 80, bands: int = 16) -> DataFrame:
    """Per row of docs with an id: doc_id and component_id, the smallest doc_id that links reach."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    joined = docs.select("doc_id").join(band_components(docs, percent, bands).withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def op9_document_fingerprints(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprints(docs, band_components(docs))
