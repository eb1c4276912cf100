"""The operators against brute force on small tables with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geosluice.llm import language_id, line_dedup, minhash, mixing, ngram_join, packing, pii, registry, substring_dedup, topk, warc
from geosluice.llm.words import rolling, shingles, words

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 int"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", 1, 0),
        (2, base + " more", "en", "b", 1, 0),
        (3, None, None, None, None, None),
        (4, "", "fr", "a", 0, 0),
        (5, " \n\t ", None, "b", 3, 0),
        (6, "one", "en", "c", 3, 0),
        (7, "one", "en", "c", 3, 0),
        (9, "x" * 50_000 + " y", "de", "a", 50_002, 0),
        (10, "é ü " * 30 + base, "fr", None, 1, 0),
        (11, "a a a a " * 40, "fr", None, 1, 0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def substring_brute(rows, span):
    toks = {i: re.findall(WORD, t or "") for i, t in rows}
    seen = collections.Counter(tuple(w[i : i + span]) for w in toks.values() for i in range(len(w) - span + 1))
    out = {}
    for k, w in toks.items():
        gone = {j for i in range(len(w) - span + 1) if seen[tuple(w[i : i + span])] > 1 for j in range(i, i + span)}
        out[k] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("span,limit", [(35, substring_dedup.FILTER_BYTES), (35, 0), (9, 1 << 20), (4, 1 << 20)])
def test_substrings(docs, odd, span, limit):
    for df in (docs, odd):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(df, span, limit).collect()}
        assert got == substring_brute(texts(df), span)


@pytest.mark.parametrize("span,limit", [(9, 1 << 20), (9, 0), (4, 1 << 20)])
def test_substrings_by_row(spark, span, limit):
    """Rows with null or equal ids and different texts: words go only where their own row repeats."""
    word = lambda i, n, at=0: " ".join(f"r{i}x{j}" for j in range(at, at + n))
    plain = [word(1, 30) + " " + word(0, 12), word(0, 12) + " " + word(2, 30), word(3, 60), word(4, 20), word(5, 10) + " " + word(0, 12) + " " + word(5, 9, 10), None, ""]
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(plain)] + [(None, t) for t in plain[2:4]] + [(8, plain[3]), (8, plain[3]), (0, word(6, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(df, span, limit).collect())
    want = substring_brute(list(enumerate(t for _, t in rows)), span)
    assert got == sorted((str(rows[i][0]), *want[i]) for i in want)


def components_brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    part = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * len(sets[a] | sets[b]) and part[a] != part[b]:
                low, high = sorted((part[a], part[b]))
                part = {i: low if p == high else p for i, p in part.items()}
    return {i: (len(s), part[i]) for i, s in sets.items()}


@pytest.mark.parametrize("heavy,combine", [(128, 400), (1, 400), (1, 40)])
def test_ngram_join(docs, odd, heavy, combine):
    for df in (docs, odd):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, heavy_from=heavy, combine_up_to=combine).collect()}
        assert got == components_brute(texts(df), 4, 85)


@pytest.mark.parametrize("long_entry", [16, 64, 256])
def test_ngram_join_blocks(spark, monkeypatch, long_entry):
    """Variants of one text on both sides of the threshold: long entries, several blocks, wrong links nowhere."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(9999)}" for _ in range(80)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4])):
            w[rnd.randrange(80)] = f"x{rnd.randrange(400)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "LONG_ENTRY", long_entry)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 64)
    monkeypatch.setattr(ngram_join, "MATRIX_TOKENS", 128)
    made = []
    plain = ngram_join.link_blocks
    monkeypatch.setattr(ngram_join, "link_blocks", lambda *a: made.append(plain(*a)) or made[0])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()}
    assert got == components_brute(rows, 4, 85)
    assert made[0].count() > 0 if long_entry < 256 else True


def test_spanning_forest():
    linked = np.zeros((6, 6), bool)
    for a, b in ((0, 1), (1, 2), (0, 2), (4, 5)):
        linked[a, b] = linked[b, a] = True
    assert sorted(ngram_join.spanning_forest(linked)) == [(0, 1), (0, 2), (4, 5)]


def test_ngram_join_without_id(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in ngram_join.ngram_components(df).collect()))) == ["(1, 2, 1)", "(1, 2, 1)", "(None, 2, None)"]


def test_fingerprints(docs, odd):
    for df in (docs, odd.union(odd.where("doc_id = 6"))):
        got = sorted(minhash.fingerprints(df).collect(), key=lambda r: r.doc_id)
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()))
        for i, (r, (doc, t)) in enumerate(zip(got, rows, strict=True)):
            after = rows[(i + 1) % len(rows)][1]
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc, len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert 0 <= r.near_edited <= 1 and (r.near_next == 1 or after != t)


def test_near_duplicates_agree_with_exact(docs):
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    want = {i: c for i, (_, c) in components_brute(texts(docs), 5, 80).items()}
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_near_duplicates_see_all_pairs_of_a_band(spark, monkeypatch):
    """Variants of one text on both sides of the threshold: each pair that shares a band counts, in pairs and in blocks."""
    import pyarrow as pa

    rnd = random.Random(3)
    base = [f"w{rnd.randrange(9999)}" for _ in range(80)]
    rows = []
    for i in range(200):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4])):
            w[rnd.randrange(80)] = f"x{rnd.randrange(400)}"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    sig = minhash.signatures(pa.array([t.lower() for _, t in rows])).reshape(len(rows), 16, 4)
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.lower().split() for _, t in rows)]
    met, exact = list(range(len(rows))), list(range(len(rows)))
    for a, b in ((a, b) for b in range(len(rows)) for a in range(b)):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            for part in (exact, met) if (sig[a] == sig[b]).all(axis=1).any() else (exact,):
                low, high = sorted((part[a], part[b]))
                part[:] = [low if p == high else p for p in part]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == dict(enumerate(met))
    monkeypatch.setattr(ngram_join, "LONG_ENTRY", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 64)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    # blocks also see pairs that share no band
    assert all(got[i] == got[met[i]] and exact[i] == exact[got[i]] for i in got)


def test_fingerprint_query_has_components(spark, sf, docs):
    got = {r.doc_id: r.component_id for r in minhash.op9_document_fingerprints(spark, sf).collect()}
    assert got == {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} and any(c != i for i, c in got.items())


def test_packing(docs, odd):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.vocabulary()[0])
    weird = odd.union(odd.sparkSession.createDataFrame([(20, "a<|endoftext|>b \u0085 日本 　x 𝄞", None, None, 1, 1)], SCHEMA))
    for df, size in ((docs, 2048), (weird, 64)):
        by, bins = collections.defaultdict(list), collections.defaultdict(list)
        for r in packing.pack(df, size).collect():
            by[r.doc_id].append(r)
            bins[r.sequence_id].append((r.offset, r.length))
        for doc, t in texts(df):
            ids, at = tk.encode(t or "", add_special_tokens=False).ids + [1], 0
            for r in sorted(by[doc], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
        for parts in bins.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= size


def test_first_fit_decreasing():
    n = np.sort(np.random.default_rng(0).integers(1, 100, 500))[::-1]
    bins, _ = packing.first_fit_decreasing(n, 100)
    room = []
    for length, b in zip(n.tolist(), bins.tolist()):
        want = next((i for i, r in enumerate(room) if r >= length), len(room))
        room += [100] * (want == len(room))
        room[want] -= length
        assert want == b


def test_top_k_blocks_are_not_broadcast(spark):
    """Query blocks, repeated for each vector block, were broadcast through the driver."""
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i)).alias("embedding"))
    plan = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block=64)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "block#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_top_k_packing():
    for rows in ([[-32768, 32767]], [[-32769, 5]], [[1 << 40, -3]]):
        assert topk._unpacked(topk._packed(np.array(rows)), 1, 2).tolist() == rows


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(300)]
    rows += [(300, None), (301, [float("nan")] * 6), (302, []), (303, [1.0, 2.0]), (304, [None] * 6), (None, [1.0] * 6), (350, [0.0] * 6), (17, rows[17][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block=64).collect())
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and len(v) == 6 and None not in v and not np.isnan(v).any()]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:5]
            want += [(q, n + 1, i, -score) for n, (score, i) in enumerate(best)]
    assert got == sorted(want)


def spans_brute(text):
    luhn = lambda x: sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(x))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20\-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m.group())]


def test_pii(spark, docs):
    hard = ["a@b.c_d@e.f", "x@y.z@w.v q@r", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1111x", "+1 (456) 555-2186 +123", None, "", "é@x.com 𝄞 +1 (456) 555-2186", "9" * 5000, "+" * 3000]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"))
    found = pii.find(df).select("doc_id", pii.listed(True).alias("base"), pii.listed(False).alias("all"))
    rows = dict(texts(df))
    for r in found.collect():
        want = spans_brute(rows[r.doc_id])
        assert r.base == ",".join(want) and set(want) <= set(r["all"].split(",")) | {""}


def test_pii_adds_secrets_only_where_there_are_some(spark):
    df = spark.createDataFrame([(1, "set password=b7db7aa4a5fcc78305 now"), (2, "the quick brown fox of 2024 jumps over 12 dogs")], "doc_id long, text string")
    got = {r.doc_id: r.added for r in pii.find(df).collect()}
    assert [a.kind for a in got[1]] == ["secret"] and got[2] == []


def test_pii_learns_from_all_candidates(spark):
    """More different candidates than LABELLED all count; coarser vectors keep their number."""
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.format_string("call +1 (4%d6) 555-%04d %s or", F.col("id") % 10, F.col("id") % 9000, F.md5(F.col("id").cast("string"))).alias("text"))
    n = pii.labelled(df).count()
    assert n > pii.LABELLED
    fine, coarse = pii.counted(df), pii.counted(df, 9)
    assert fine.agg(F.sum("n")).first()[0] == coarse.agg(F.sum("n")).first()[0] == n and coarse.count() <= 9 < fine.count()
    assert pii.Detector(df).learned == n


def test_pii_learns_from_documents(spark):
    """Labels follow from base patterns; held-out examples are found; added spans do not overlap."""
    rows = [(i, f"call +1 (4{i % 10}6) 555-{2000 + i} or a{i}@mail.example.org from 10.{10 + i % 90}.{100 + i % 100}.11 order {4111111111111 + 7 * i} end") for i in range(300)]
    df = spark.createDataFrame([*rows, (None, None), (-1, "")], "doc_id long, text string")
    got = collections.Counter((r.kind, r.label) for r in pii.labelled(df).collect())
    assert got["phone", 1] == got["email", 1] == 300 and got["phone", 0] > 0 and got["email", 0] == 0
    assert pii.labelled(df, 50).count() == 50
    det = pii.Detector(df)
    assert all(p >= 0.98 for p, _, _, _ in det.quality.values()) and all(det.quality[k][1] >= 0.9 for k in ("phone", "email", "secret"))
    some = spark.createDataFrame([(1, "tel: (212) 555-1234 or x7 [at] mail.example [dot] org, password=b7db7aa4a5fcc78305")], "doc_id long, text string")
    (r,) = pii.find(some.unionByName(df)).where("doc_id = 1 and size(email) = 0 and size(added) > 0").collect()
    spans = sorted((a.s, a.e) for a in r.added)
    assert {a.kind for a in r.added} >= {"phone", "email", "secret"} and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert pii.find(df.limit(0)).count() == 0


def test_language(docs, odd):
    out = language_id.identify(docs, ~language_id.held_out()).withColumn("held", language_id.held_out()).collect()
    held = [r for r in out if r.held]
    assert held and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    none = language_id.identify(odd, F.lit(False)).collect()
    assert len(none) == 10 and {r.lang_pred for r in none} == {"und"}
    some = {r.doc_id: r.lang_pred for r in language_id.identify(odd, F.lit(True)).collect()}
    assert some[3] == some[4] == some[5] == "und" and some[1] != "und"


def test_line_dedup(spark):
    rows = [(i, f"Licensed\nown {i}\n\n  Licensed ", f"s{i}") for i in range(10)] + [(20, None, None), (21, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(df, min_sites=8).collect()}
    assert got[0] == ("Licensed\nown 0\n", 3, 1) and got[5] == ("own 5\n", 3, 2) and got[20] == (None, 0, 0) and got[21] == ("", 0, 0)
    assert line_dedup.line_dedup(df, min_sites=11).agg(F.sum("n_removed")).first()[0] == 0


def test_line_dedup_by_row(spark):
    rows = [(i, f"Licensed\nown {i}", f"s{i}") for i in range(10)] + [(9, "first\nLicensed\nlast", "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup.line_dedup(df, min_sites=8).collect())
    assert got[0] == (0, "Licensed\nown 0", 0) and got[-2:] == [(9, "first\nlast", 1), (9, "own 9", 1)]


def test_mixing_covers_targets(odd, docs):
    for df in (odd, docs):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count() and all(r.taken <= 2 * r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - 1.5 * sum(r["size"] for r in rows)) <= 30
        assert [r.position_1 for r in rows if r.position_1 is not None] == sorted(r.position_1 for r in rows if r.position_1 is not None)


def test_warc(spark, tmp_path):
    body = "".join(f"<p>é{i}</p>\r\n\r\nWARC/1.1\r\n" for i in range(3000))
    rows = [(1, "http://a/\r\nb", body), (2, None, body), (3, "u", None), (None, "u", ""), (5, "u", "short"), (6, "u", "short")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), segment_bytes=5000, records_per_file=7)
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert bytes(got[1].payload).decode() == body and got[2].record_type == "revisit" and got[2].refers_to == 1
    assert bytes(got[3].payload) == b"" and bytes(got[None].payload) == b"" and bytes(got[6].payload) == b"short" and got[6].record_type == "response"
    flat = {r.page_id: tuple(r)[1:] for r in warc.resolved(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
    assert flat[2] == (len(body.encode()), hashlib.sha256(body.encode()).hexdigest(), "revisit", 1)


def test_queries_against_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, sf)
        cols, want = sorted(df.columns), con.sql(sql)
        at = [want.columns.index(c) for c in cols]
        plain = lambda row: tuple("%.9g" % v if isinstance(v, float) else str(v) for v in row)
        assert sorted(plain(r) for r in df.select(*cols).collect()) == sorted(plain([r[i] for i in at]) for r in want.fetchall()), name


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert substring_dedup.substring_dedup(none).count() == ngram_join.ngram_components(none).count() == minhash.fingerprints(none).count() == 0
    assert packing.pack(none).count() == mixing.mix(none).count() == line_dedup.line_dedup(none).count() == pii.find(none).count() == 0
    assert language_id.identify(none, F.lit(True)).count() == 0


def test_pipeline(spark, sf, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").distinct().collect()}


def test_hashes():
    import pyarrow as pa

    w = words(pa.array(["a b", None, "", "b a c"]))
    assert w.bounds.tolist() == [0, 2, 2, 2, 5] and w.hash[0] == w.hash[3] and w.hash[1] == w.hash[2]
    h = np.arange(50, dtype=np.uint64)
    assert all(rolling(h, k)[3] == rolling(h[3 : 3 + k], k)[0] for k in (1, 2, 15, 35))
    assert np.diff(shingles(w, 2)[1]).tolist() == [1, 0, 0, 2]
