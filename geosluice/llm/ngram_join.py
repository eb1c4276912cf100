"""Exact Jaccard self-join on word n-grams by token-combination prefixes.

A document is the set of its distinct n-word shingles, hashed to 64 bits.  In
any order of tokens that all documents share, two sets with enough in common
share at least k tokens of their first p + k - 1, where p is the usual prefix
length (set size less the smallest overlap that a partner needs, plus one).
Light tokens come first, by hash, heavy tokens (in more than `heavy_from`
texts) last.  With k = 2: either one of the shared tokens is light, and
both documents are indexed under it alone; or two shared tokens are heavy, and
both documents are indexed under that combination.  Sets of more than
`combine_up_to` tokens would make too many combinations, so they, and those
within the size ratio below that bound, are indexed under single heavy tokens.
Of equal sets only the document with the smallest id is indexed.

Candidates are then verified on whole sets.  As components are asked for, the
first pass verifies each index entry's members against one of its documents.
Of the entries whose members are not connected yet, long ones (of more than
LONG_ENTRY documents, met where a template has many variants near the threshold)
are brought together by a shared leader, their documents dealt into blocks, and
each two blocks compared in one task by a product of their token matrices, which
returns a spanning forest of the links: a block's pairs are never rows.  Short ones
have all their remaining pairs verified, but for pairs that met in a group of
blocks.  Pairs are verified in cells, by the document that brought them together, so a
text travels once for a cell, compressed, however many pairs it has there.  Pairs within a component need no look in the other passes, so groups of
copies cost their size, not its square there, and no link between different
components is lost.

Cases: null and empty texts have empty sets, linked with nothing; equal sets
are linked without a join; rows with a null doc_id take no part and come back
with a null component; rows with equal doc_id are one document of the graph;
texts of any length are read whole, a megabyte of short ones or one long one at a
time; extra columns are ignored whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, spread, table, unzipped, with_least, zipped
from .graph import components
from .words import distinct, mix, shingles, slices, words

#: Heavy tokens are at most this many, so their table to broadcast has a fixed bound (8 bytes each).
MOST_HEAVY = 4 << 20
HEAVY_FROM = 128
COMBINE_UP_TO = 64
#: Document ids are broadcast up to this many; beyond it, they are joined.
MOST_IDS = 2 << 20
#: Passes with another document of each entry as its centre, before the remaining pairs are looked at.
STAR_TURNS = 1
#: Entries with more open documents than this are compared in blocks.
LONG_ENTRY = 256
#: A block has about this many documents, and about this many shingles, whichever makes more blocks.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 19
#: Documents of a verifying cell's side; larger cells are dealt into smaller ones.
CELL_DOCS = 512
#: Columns of a token matrix at a time.
MATRIX_TOKENS = 4096
SHIFT = np.uint64(24)


def smallest_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The shingle set of each text; work arrays are of a megabyte of text at a time."""
    out: list[np.ndarray] = []
    for x, y in slices(texts, 1 << 20):
        out += distinct(*shingles(words(texts.slice(x, y - x), lower=True), k))
    return out


def _ranges(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def set_keys(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b): equal keys stand for equal sets."""

    def run(batches):
        for batch in batches:
            for x, y in slices(batch.column(1)):
                sets = _sets(batch.column(1).slice(x, y - x), k)
                a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                b = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                yield pa.record_batch(
                    [batch.column(0).slice(x, y - x), pa.array([len(s) for s in sets], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                    ["doc_id", "n_shingles", "key_a", "key_b"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key_a long, key_b long")


def heavy_tokens(docs: DataFrame, k: int, heavy_from: int, buckets: int) -> np.ndarray:
    """The first 40 bits of tokens in more than heavy_from documents.

    If more tokens qualify than MOST_HEAVY, the bound doubles until they fit: the join
    stays exact, its entries only become longer."""

    def count(batches):
        for batch in batches:
            for x, y in slices(batch.column(1), 4 << 20):
                h = np.sort(np.concatenate(_sets(batch.column(1).slice(x, y - x), k)))
                b = _ranges(h, buckets)
                h = h >> SHIFT
                cuts = np.searchsorted(b, np.arange(buckets + 1))
                rows = []
                for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if e > s:  # gaps as bytes of equal weight together: they compress well
                        gaps = np.diff(h[s:e]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                        rows.append((i, int(h[s]), np.ascontiguousarray(gaps.T).tobytes()))
                if rows:
                    i, low, gaps = zip(*rows)
                    yield pa.record_batch([pa.array(i, pa.int32()), pa.array(low, pa.int64()), pa.array(gaps, pa.binary())], ["bucket", "low", "gaps"])

    def total(t: pa.Table) -> pa.Table:
        parts = []
        for low, gaps in zip(t["low"].to_pylist(), t["gaps"].to_pylist()):
            g = np.zeros((len(gaps) // 5, 8), np.uint8)
            g[:, :5] = np.frombuffer(gaps, np.uint8).reshape(5, -1).T
            parts.append(np.cumsum(np.concatenate(([low], g.view("<u8").ravel().astype(np.int64)))))
        u, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.table({"token": u[n > heavy_from], "df": n[n > heavy_from].astype(np.int64)})

    found = cut(docs.mapInArrow(count, "bucket int, low long, gaps binary").groupBy("bucket").applyInArrow(total, "token long, df long"), "heavy")
    while found.where(F.col("df") > heavy_from).count() > MOST_HEAVY:
        heavy_from *= 2
    rows = found.where(F.col("df") > heavy_from).select("token").toArrow()
    return np.sort(rows["token"].to_numpy().astype(np.uint64))


def entries_of(s: np.ndarray, heavy: np.ndarray, percent: int, combine_up_to: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Index keys of one set, the position of each in its order (-1 for combinations), and the heavy tokens of the prefix."""
    n = len(s)
    if n < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
    most = n - int(smallest_overlap(np.int64(n), percent)) + 2
    is_heavy = np.zeros(n, bool)
    if len(heavy):
        t = s >> SHIFT
        at = np.minimum(np.searchsorted(heavy, t), len(heavy) - 1)
        is_heavy = heavy[at] == t
    light = s[~is_heavy][:most]
    keys, place = [light], [np.arange(len(light), dtype=np.int32)]
    dense = s[is_heavy][: most - len(light)]
    if len(dense):
        if n <= combine_up_to:
            i, j = np.triu_indices(len(dense), 1)
            keys.append(mix(dense[i] * np.uint64(0xA0761D6478BD642F) + dense[j]))
            place.append(np.full(len(i), -1, np.int32))
        if n * 100 >= combine_up_to * percent:
            keys.append(dense)
            place.append(np.arange(len(light), len(light) + len(dense), dtype=np.int32))
    return np.concatenate(keys), np.concatenate(place), len(dense)


def index_members(docs: DataFrame, k: int, percent: int, heavy_from: int, combine_up_to: int) -> DataFrame:
    """(key, doc_id, n, place, dense) of the index entries that have two documents at least."""
    spark = docs.sparkSession
    # ranges of hashes, each met in one task: their number grows with the input
    buckets = max(64, spread(docs))
    known = spark.sparkContext.broadcast(heavy_tokens(docs, k, heavy_from, buckets))

    def emit(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for x, y in slices(batch.column(1), 4 << 20):
                seen, keys, owner, place, size, dense = set(), [], [], [], [], []
                for doc, s in zip(ids[x:y].tolist(), _sets(batch.column(1).slice(x, y - x), k)):
                    mark = s.tobytes()
                    if mark in seen:  # a copy here; equal sets are linked elsewhere
                        continue
                    seen.add(mark)
                    e, p, d = entries_of(s, known.value, percent, combine_up_to)
                    keys.append(e)
                    place.append(p)
                    owner.append(np.full(len(e), doc, "<i8"))
                    size.append(np.full(len(e), len(s), "<i4"))
                    dense.append(np.full(len(e), d, "<i4"))
                order = np.argsort(np.concatenate(keys), kind="stable")
                h, owner, place, size, dense = (np.concatenate(c)[order] for c in (keys, owner, place, size, dense))
                later = np.zeros(len(h), bool)
                later[1:] = h[1:] == h[:-1]
                many = np.zeros(len(h), np.int8)
                many[:-1] = later[1:]
                rows = []
                b = _ranges(h, buckets)
                for take, extra in ((~later, False), (later, True)):  # of a key, one row goes to its range; the others are known to be kept
                    at = np.flatnonzero(take)
                    for at in np.array_split(at, np.flatnonzero(np.diff(b[at])) + 1) if not extra else [at]:
                        if len(at):
                            to = int(owner[at[0]] % buckets) if extra else int(b[at[0]])
                            rows.append((to, extra, h[at].tobytes(), owner[at].tobytes(), size[at].tobytes(), place[at].astype("<i4").tobytes(), dense[at].tobytes(), many[at].tobytes()))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.bool_()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["bucket", "extra", "h", "doc", "n", "place", "dense", "many"])

    def meet(t: pa.Table) -> pa.Table:
        def column(c, d):  # one at a time, so that few copies are held together
            return np.concatenate([np.frombuffer(v, d) for v in t[c].to_pylist()])

        many = column("many", np.int8) > 0
        extra = np.repeat(t["extra"].to_numpy(), [len(v) for v in t["many"].to_pylist()])
        h = column("h", np.uint64)
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[:-1] |= h[1:] == h[:-1]
        kept = same | many[order] | extra[order]
        take = order[kept]
        key = h[kept].view(np.int64)
        del h, order
        return pa.table({"key": key, "doc_id": column("doc", "<i8")[take], **{c: column(c, "<i4")[take] for c in ("n", "place", "dense")}})

    sent = docs.mapInArrow(emit, "bucket int, extra boolean, h binary, doc binary, n binary, place binary, dense binary, many binary")
    return sent.groupBy("bucket").applyInArrow(meet, "key long, doc_id long, n int, place int, dense int")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed) of the documents whose doc_id is in ids, texts as zstd bytes."""
    texts = docs.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            for x, y in slices(batch.column(1), 4 << 20):
                yield pa.record_batch([batch.column(0).slice(x, y - x), zipped(batch.column(1).slice(x, y - x))], ["doc_id", "packed"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, packed binary")


def verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b, centre), those linked: 100 * intersection >= percent * union.

    The pairs of a centre are a cell, dealt into smaller ones by hashes of a and b if it
    has many documents; some cells together are a task's share."""
    ends = lambda p, *more: p.select(*more, F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    need = cut(ends(pairs, "centre"), "need")
    size = need.groupBy("centre").agg(F.ceil(F.count("*") / CELL_DOCS).cast("int").alias("parts")).where("parts > 1")
    dealt = pairs.withColumn("cell", F.xxhash64("centre"))
    if not size.isEmpty():
        side = lambda c: F.pmod(F.xxhash64(c), F.coalesce("parts", F.lit(1)))
        dealt = pairs.join(cut(size, "cells"), "centre", "left")
        dealt = cut(dealt.select("a", "b", F.xxhash64("centre", side("a"), side("b")).alias("cell")), "dealt")
        need = cut(ends(dealt, "cell"), "need")
    else:
        need = need.withColumn("cell", F.xxhash64("centre"))
    shares = 1 + need.count() // (4 * CELL_DOCS)
    share = F.pmod("cell", F.lit(shares)).alias("share")
    dealt, need = dealt.select(share, "a", "b"), need.select(share, "doc_id").distinct()
    texts = texts_of(docs, need.select("doc_id").distinct())
    texts = texts.join(F.broadcast(need) if need.count() <= MOST_IDS else need, "doc_id")

    def check(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        own = t.filter(t["packed"].is_valid())
        ids, at = np.unique(own["a"].to_numpy(), return_inverse=True)
        sets: list[list[np.ndarray]] = [[] for _ in ids]
        for i in range(0, len(at), 256):
            for j, s in zip(at[i : i + 256].tolist(), _sets(unzipped(own["packed"].slice(i, 256)), k)):
                sets[j].append(s)
        pairs = t.filter(t["packed"].is_null())
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        ok = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(np.searchsorted(ids, a).tolist(), np.searchsorted(ids, b).tolist())):
            ok[i] = any(_linked(s, t, percent) for s in sets[x] for t in sets[y])  # several only where rows share a doc_id
        return pa.table({"a": a[ok], "b": b[ok]})

    rows = texts.select("share", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "packed")
    rows = rows.unionByName(dealt.withColumn("packed", F.lit(None).cast("binary")))
    return rows.groupBy("share").applyInArrow(check, "a long, b long").distinct()


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    shared = len(np.intersect1d(s, t, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(s) + len(t) - shared)


def shared_tokens(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at `left` with those at `right`."""
    token, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    many = count[at] > 1
    at, owner = column[at[many]], owner[many]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, MATRIX_TOKENS):
        x, y = np.searchsorted(at, (low, low + MATRIX_TOKENS))
        m = np.zeros((len(sets), MATRIX_TOKENS), np.float32)
        m[owner[x:y], at[x:y] - low] = 1
        out += (m[left] @ m[right].T).astype(np.int64)
    return out


def spanning_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest with the components of a symmetric boolean matrix."""
    open_, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        todo = [root] if open_[root] else []
        open_[root] = False
        while todo:
            v = todo.pop()
            new = np.flatnonzero(linked[v] & open_)
            open_[new] = False
            out += [(v, w) for w in new.tolist()]
            todo += new.tolist()
    return out


def block_groups(open_: DataFrame) -> DataFrame:
    """(group, doc_id, n): the documents of the long entries of open_, those of one entry in one group at least.

    An entry's group is named by one of its documents, that of the lowest hash, so
    entries with much the same members mostly share it; a group whose name is in
    a larger group joins that one."""
    long = open_.groupBy("key").agg(F.count("*").alias("size"), F.min_by("doc_id", F.xxhash64("doc_id", F.lit(STAR_TURNS))).alias("leader")).where(F.col("size") > LONG_ENTRY)
    met = cut(open_.join(long.select("key", "leader"), "key").select("leader", "doc_id", "n").distinct(), "met")
    size = met.groupBy("leader").agg(F.count("*").alias("docs"))
    larger = met.join(size, "leader").groupBy("doc_id").agg(F.max(F.struct("docs", F.col("leader").alias("group"))).alias("g"))
    named = larger.select(F.col("doc_id").alias("leader"), F.col("g.group").alias("group"))
    return cut(met.join(named, "leader").select("group", "doc_id", "n").distinct(), "groups")


def link_blocks(docs: DataFrame, met: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that connect whatever links within the groups of met connect.

    A group of b blocks sends each document to b tasks; any two of its documents
    meet in one of them."""
    blocks = met.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = met.join(blocks, "group").select("group", "doc_id", "blocks", F.pmod(F.xxhash64("doc_id", F.lit(-1)), "blocks").cast("int").alias("block"))

    def compare(t: pa.Table) -> pa.Table:
        ids = t["doc_id"].to_numpy()
        sets = [x for i in range(0, len(ids), 256) for x in _sets(unzipped(t["packed"].slice(i, 256)), k)]
        n = np.array([len(s) for s in sets])
        block = t["block"].to_numpy()
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        both = shared_tokens(sets, left, right)
        linked = np.zeros((len(ids), len(ids)), bool)
        linked[np.ix_(left, right)] = (both > 0) & (100 * both >= percent * (n[left][:, None] + n[right] - both))
        edges = np.array(spanning_forest(linked | linked.T), np.int64).reshape(-1, 2)
        return pa.table({"a": ids[edges[:, 0]], "b": ids[edges[:, 1]]})

    dealt = cut(dealt, "blocks")
    texts = texts_of(docs, dealt.select("doc_id").distinct()).join(F.broadcast(dealt) if dealt.count() <= MOST_IDS else dealt, "doc_id")
    sent = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc_id", "packed")
    return sent.groupBy("group", "low", "high").applyInArrow(compare, "a long, b long")


def ngram_components(docs: DataFrame, k: int = 4, percent: int = 85, heavy_from: int = HEAVY_FROM, combine_up_to: int = COMBINE_UP_TO) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        sets = cut(set_keys(docs, k), "sets")
        docs = docs.where("doc_id is not null")
        some = sets.where("n_shingles > 0 and doc_id is not null")
        known = cut(with_least(some, ["n_shingles", "key_a", "key_b"], "doc_id", "rep").select("doc_id", "rep").distinct(), "reps")
        members = cut(index_members(first_of_equals(docs, known), k, percent, heavy_from, combine_up_to), "members")
        members = cut(members.join(known, "doc_id").select("key", "n", "place", "dense", F.col("rep").alias("doc_id")).distinct(), "members")
        whole = linked_members(docs, members, known, k, percent).withColumnRenamed("node", "doc_id")
    return sets.join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def first_of_equals(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs without documents all of whose sets another one stands for; with more than MOST_IDS of these, all of docs."""
    copies = cut(known.groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("rep")).alias("own")).where("own = 0").select("doc_id"), "copies")
    return docs.join(F.broadcast(copies), "doc_id", "left_anti") if copies.count() <= MOST_IDS else docs


def linked_members(docs: DataFrame, members: DataFrame, known: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) by all links among documents that share an index entry of `members`, and by the equal sets of `known`.

    The result is written: what reads it runs none of the comparisons again."""
    copies = known.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links, part, open_ = copies, None, members.withColumn("c", F.col("doc_id"))
    seen = docs.sparkSession.createDataFrame([], "a long, b long")
    for turn in range(STAR_TURNS):
        first = cut(open_.groupBy("key").agg(F.min_by(F.struct("doc_id", "n", "place", "dense", "c"), F.xxhash64("doc_id", F.lit(turn))).alias("l")), "leaders")
        star = open_.join(first, "key").select("key", F.col("l")["doc_id"].alias("centre"), *_side("a", lambda c: F.col("l")[c]), *_side("b", F.col))
        star = cut(_pairs(star, percent, 4).join(seen, ["a", "b"], "left_anti"), "star")
        links = cut(links.union(verify(docs, star, k, percent)), "links")
        seen = seen.union(star.select("a", "b"))
        part = cut(components(links), "components")
        open_ = cut(_open(members, part), "open")
    own = open_.withColumn("main", F.lit(None).cast("long"))
    if open_.groupBy("key").count().where(F.col("count") > LONG_ENTRY).isEmpty():
        if open_.isEmpty():
            return part
    else:
        met = block_groups(open_)
        links = cut(links.union(link_blocks(docs, met, k, percent)), "links")
        # what one group has compared is done: entries within a document's largest group, and pairs
        main = met.join(met.groupBy("group").agg(F.count("*").alias("docs")), "group").groupBy("doc_id").agg(F.max(F.struct("docs", "group"))["group"].alias("main"))
        own = cut(open_.join(main, "doc_id", "left"), "own")
    leader = F.min_by("doc_id", F.xxhash64("doc_id", F.lit(STAR_TURNS))).alias("centre")
    entries = own.groupBy("key").agg(F.count("*").alias("size"), F.count("main").alias("dealt"), F.min("main").alias("x"), F.max("main").alias("y"), leader)
    entries = entries.where((F.col("size") <= LONG_ENTRY) & ~((F.col("dealt") == F.col("size")) & (F.col("x") == F.col("y"))))
    short = own.join(entries.select("key", "centre"), "key")
    left, right = (short.select("key", *c, *_side(s, F.col), F.col("main").alias(f"main_{s}")) for s, c in (("a", ["centre"]), ("b", [])))
    pairs = left.join(right, "key").where("a < b and coalesce(main_a <> main_b, true)")
    rest = cut(_pairs(pairs, percent, 1).join(seen, ["a", "b"], "left_anti"), "rest")
    return cut(components(links.union(verify(docs, rest, k, percent))), "components")


def _side(name: str, of) -> list:
    return [of("doc_id").alias(name), *(of(c).alias(f"{c}_{name}") for c in ("n", "place", "dense", "c"))]


def _open(members: DataFrame, part: DataFrame) -> DataFrame:
    """Members, with their component c, of the entries whose members are not all connected."""
    own = members.join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = cut(own.select("key", "n", "place", "dense", "doc_id", F.coalesce("component", "doc_id").alias("c")), "labelled")
    mixed = own.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key")
    return own.join(mixed, "key", "left_semi")


def _pairs(met: DataFrame, percent: int, ease: int) -> DataFrame:
    """Distinct (a, b, centre) of members that met at a centre, of different components, that can still be linked.

    Sizes must be within the ratio, and the first token that two sets share must
    leave room for the overlap that they need.  Then tokens are counted: the set whose
    prefix ends first in the order has at most n - m tokens after it (m long), so the
    others of the overlap are among the shared prefix tokens, heavy ones apart.
    `ease` divides that need, where not all shared tokens can be seen."""
    need = "ceil({p} * (n_a + n_b) / {q})".format(p=percent, q=100 + percent)
    after = "(n_{s} - least(n_{s}, n_{s} - cast(ceil({p} * n_{s} / 100) as int) + 2))"
    fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and c_a <> c_b"
    met = met.where(fits).select(
        F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b"),
        "centre",
        F.expr(f"place_a < 0 or least(n_a - place_a, n_b - place_b) >= {need}").alias("room"),
        F.expr(f"{need} - greatest({after.format(s='a', p=percent)}, {after.format(s='b', p=percent)}) - least(dense_a, dense_b)").alias("need"),
    )
    met = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("need").alias("need"), F.bool_or("room").alias("room"), F.min("centre").alias("centre"))
    return met.where(F.col("room") & (F.col("shared") * ease >= F.col("need"))).select("a", "b", "centre")


def op8_ngram_jaccard_join(spark, sf_dir) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))
