"""Awkward columns, rows and sizes, fallbacks beyond bounds, and the pipeline against plain Python."""

import collections
import hashlib
import re
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geosluice.llm import common, graph, language_id, line_dedup, minhash, mixing, ngram_join, packing, pii, substring_dedup, topk, warc

from .test_llm import SCHEMA, WORD, components_brute, docs, odd, texts  # noqa: F401

CLASHES = ["gone", "gone_id", "gone_row", "n_lines", "n_removed", "lang_pred", "score", "due", "mixed_id", "row", "place", "h1", "part", "tail", "component", "component_id", "range", "order", "size", "rep", "key", "a", "b", "name", "_n", "position_1", "taken"]


@pytest.fixture(scope="module")
def clashing(docs):  # noqa: F811
    out = docs.limit(60).drop("n_chars")
    for c in CLASHES:
        out = out.withColumn(c, F.concat(F.lit(c + " of "), F.col("doc_id").cast("string")))
    return out


def test_operators_take_any_columns(spark, clashing):
    n = clashing.count()
    for df in (substring_dedup.substring_dedup(clashing), mixing.mix(clashing), pii.find(clashing), ngram_join.ngram_components(clashing), minhash.fingerprints(clashing)):
        assert df.count() == n
    assert packing.pack(clashing).select("doc_id").distinct().count() == n
    out = line_dedup.line_dedup(clashing)
    assert out.columns == [*clashing.columns, "n_lines_", "n_removed_"] and out.where("gone <> concat('gone of ', doc_id) or n_lines <> concat('n_lines of ', doc_id)").count() == 0
    out = language_id.identify(clashing, F.lit(True))
    assert out.columns == [*clashing.columns, "lang_pred_", "score_"] and out.where("score <> concat('score of ', doc_id)").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_any_columns(spark, sf, clashing, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, clashing, sf)
    assert out.columns == clashing.columns
    rows = out.select("doc_id", *CLASHES).collect()
    assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in CLASHES)


def test_vectors_and_pages_take_any_columns(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), 1.0], "x", "y", "z") for i in range(20)], "vec_id long, embedding array<double>, dim string, block string, v string")
    assert topk.top_k(v, F.col("vec_id") % 10 == 0, 3).count() == 6
    p = spark.createDataFrame([(i, "u", "t" * 200, "x", "y", "z") for i in range(3)], "page_id long, url string, html string, digest string, serial string, first string")
    warc.write_archives(p, str(tmp_path / "w"))
    assert sorted(r.record_type for r in warc.resolved(warc.read_archives(spark, str(tmp_path / "w"))).collect()) == ["response", "revisit", "revisit"]


def test_empty_vectors_and_pages(spark, tmp_path):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.resolved(warc.read_archives(spark, str(tmp_path / "w"))).count() == 0


def test_fallbacks_beyond_bounds(spark, odd, docs, monkeypatch):  # noqa: F811
    """Too many heavy tokens, ids too many to broadcast, keys of many rows: the same results."""
    monkeypatch.setattr(ngram_join, "MOST_HEAVY", 40)
    monkeypatch.setattr(ngram_join, "MOST_IDS", 0)
    monkeypatch.setattr(ngram_join, "CELL_DOCS", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    df = docs.union(docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 1_000_000))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, heavy_from=2).collect()}
    assert got == components_brute(texts(df), 4, 85)


def test_pages_beyond_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MOST_KNOWN", 1)
    rows = [(i, "u", f"{i % 3} " * 100) for i in range(12)] + [(50 + i, "u", "hot " * 50) for i in range(30)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: (r.payload_bytes, r.refers_to) for r in warc.resolved(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    assert got == {i: (len(h), None if first[h] == i else first[h]) for i, _, h in rows}


def test_damaged_archives(spark, tmp_path):
    """A lost segment, and one that is short."""
    body = "".join(f"{i} " for i in range(9000))
    digest = hashlib.sha256(body.encode()).hexdigest()
    (tmp_path / "w").mkdir()
    for page, break_ in ((1, lambda r: r[:1] + r[2:]), (2, lambda r: r), (3, lambda r: [*r[:-1], r[-1].replace(b"WARC-Segment-Total-Length: ", b"WARC-Segment-Total-Length: 1")])):
        records = warc.page_records(page, page, "u", body.encode(), digest, None, 9000)
        assert len(records) > 3
        (tmp_path / "w" / f"{page}.warc").write_bytes(b"".join(r + b"\r\n" for r in break_(records)))
    got = {r.page_id: (r.record_type, r.payload is None) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {1: ("damaged", True), 2: ("response", False), 3: ("damaged", True)}


def test_shared_folder_is_needed_on_a_cluster():
    unset = types.SimpleNamespace(get=lambda *a: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(types.SimpleNamespace(conf=unset, sparkContext=types.SimpleNamespace(master=master, getConf=lambda: unset)))


def test_heavy_tokens_make_combinations(spark):
    heavy = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2))
    keys, place, dense = ngram_join.entries_of(heavy, heavy >> ngram_join.SHIFT, 85, 64)
    assert dense == 11 and (place == -1).sum() == 55
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(i, f"{text} x{i}") for i in range(6)], "doc_id long, text string")
    found = ngram_join.heavy_tokens(df, 4, 4, 16)
    assert len(found) == 197 and (found >= 1 << 39).sum() > 50  # of the whole range of hashes
    with_one = ngram_join.index_members(df, 4, 85, 4, 400)
    assert with_one.where("place = -1").count() > 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(20)] + [(39, 300), (300, 301)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(40), 300, 301]} | {i: 100 for i in range(100, 121)}


def test_positions_follow_schedules(docs):  # noqa: F811
    """A document is due when the integral of its source's weights has come to the words before it."""
    source = {r.doc_id: r.source for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in mixing.mix(docs).collect():
        if r.position_1 is not None:
            by[source[r.doc_id]].append(r)
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(set(source.values()), key=lambda s: (s is None, s or "")))}
    grid = np.linspace(0, 1, 200_001)
    for s, rows in by.items():
        w = np.interp(grid, *zip(*mixing.SCHEDULES[weights[s]]))
        whole = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2)))
        rows.sort(key=lambda r: r.position_1)
        before = 0
        for r in rows:
            assert abs(np.interp(r.position_1, grid, whole / whole[-1]) * np.floor(r.target + 0.5) - before) < 1e-3
            before += r["size"]


def test_learned_texts_have_one_bound(docs):  # noqa: F811
    twice = docs.union(docs)
    for df in (docs, twice):
        x, y, languages = language_id.sample(df, F.lit(True), 10)
        a, b, _ = language_id.sample(df.orderBy(F.desc("doc_id")), F.lit(True), 10)
        assert (x == a).all() and (y == b).all() and len(languages) > 1
    whole = {(r.lang, r.text) for r in docs.collect() if r.lang and r.text}
    per = collections.Counter(lang for lang, _ in whole)
    x, y, languages = language_id.sample(docs, F.lit(True), 10_000)
    assert len(x) == sum(-(-len(t.encode()) // language_id.WINDOW) for _, t in whole) and sorted(per) == languages


def test_trees_as_columns(spark):
    """The trees as an expression give what numpy gives."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)).round(2)
    model = pii.Boosted(rounds=8).fit(x, (x[:, 0] + x[:, 2] > 0).astype(float))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, f array<double>")
    got = [r.v for r in df.select("i", model.column(F.col("f")).alias("v")).orderBy("i").collect()]
    assert np.abs(np.array(got) - model.score(x)).max() < 1e-9


def test_fingerprints_of_repeated_and_missing_ids(spark):
    """Null and equal ids in several parts: each row meets the next one in order."""
    rows = [(None if i % 3 == 0 else i // 7, f"text {i} " + "word " * (i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minhash.fingerprints(df).collect()
    ordered = [(r.doc_id, r.text) for r in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    want = []
    for (doc, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        want.append((str(doc), len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)


def test_likeness_is_near_jaccard(spark):
    rng = np.random.default_rng(4)
    rows, true = [], []
    for i in range(60):
        w = [f"v{i}x{j}" for j in range(300)]
        z = list(w)
        for j in rng.choice(300, i, replace=False):
            z[j] = f"z{i}x{j}"
        a, b = ({tuple(t[j : j + 5]) for j in range(296)} for t in (w, z))
        true.append(len(a & b) / len(a | b))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(z))]
    got = {r.doc_id: r.near_next for r in minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    error = np.array([got[2 * i] - true[i] for i in range(60)])
    assert np.abs(error).max() < 0.26 and abs(error.mean()) < 0.03


def lines_brute(rows, least=8):
    """doc_id -> text, by the definition of boilerplate lines."""
    sites, first = collections.defaultdict(set), {}
    for doc, text, source in sorted(rows):
        for place, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                sites[line.strip(" ")].add(source)
                first.setdefault(line.strip(" "), (doc, place))
    keep = lambda doc, place, line: not line.strip(" ") or len(sites[line.strip(" ")]) < least or first[line.strip(" ")] == (doc, place)
    return {doc: "\n".join(line for place, line in enumerate(text.split("\n")) if keep(doc, place, line)) for doc, text, _ in rows}


def readings_brute(rows):
    """doc_id -> how often the mix reads it."""
    size = {doc: len(re.findall(WORD, text)) for doc, text, _ in rows}
    total = collections.Counter()
    for doc, _, source in rows:
        total[source] += size[doc]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(total.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] >= 2 * total[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
            free.remove(s)
    out = collections.Counter()
    for s in order:
        goal, at = int(target[s] + 0.5), 0
        for _ in range(2):
            for doc in sorted((doc for doc, _, x in rows if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
                out[doc] += size[doc] > 0 and at < goal
                at += size[doc]
    return out


def test_pipeline_against_plain_python(spark, sf, docs):  # noqa: F811
    from tokenizers import Tokenizer

    told = language_id.identify(docs, ~language_id.held_out()).collect()
    least = corpus_pipeline.LEAST_LEAD / docs.where("lang is not null").select("lang").distinct().count()
    rows = [(r.doc_id, r.text, r.source) for r in told if r.lang_pred != "und" and r.score >= least]
    assert len(rows) >= 0.95 * docs.where("rlike(text, '[a-z]')").count()
    left = lines_brute(rows)
    rows = [(doc, left[doc], source) for doc, _, source in rows]
    part = components_brute([(doc, text) for doc, text, _ in rows], 5, 80)
    rows = [r for r in rows if part[r[0]][1] == r[0]]
    times = readings_brute(rows)
    tk = Tokenizer.from_file(packing.vocabulary()[0])
    want = collections.Counter()
    for doc, text, _ in rows:
        n = len(tk.encode(text, add_special_tokens=False).ids) + 1
        for start in range(0, n, packing.SEQUENCE):
            want[doc, start, min(packing.SEQUENCE, n - start), n] += times[doc]
    got = collections.Counter((r.doc_id, r.start, r.length, r.doc_tokens) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).drop("h1").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
