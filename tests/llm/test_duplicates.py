"""Near-duplicates of texts and vectors against brute force, WARC archives, and the pipeline."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from histospark.llm import embedding_dups, minhash, warc


def components(links, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def near_texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    shared = [word() for _ in range(30)]
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(3, 90))] + (shared if rng.random() < 0.3 else [])
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            out.append(("\t" if rng.random() < 0.2 else " ").join(w.upper() if rng.random() < 0.05 else w for w in copy))
    return out


def shingle_set(text, k):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicate_texts(spark, k):
    texts = [*near_texts(k, 60), None, "", "  ", "É x", "é x", "one two", "ONE two", "one two", *["same text of a hot group"] * 40, "long " * 20_000, "long " * 20_001]
    df = spark.createDataFrame([(i * 3, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, node string, bands int")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, k, 80).collect()}
    sets = {i * 3: shingle_set(t, k) for i, t in enumerate(texts)}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(links, ids)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_copies_of_one_text_keep_every_link(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(60)] = f"v{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 4, 80).collect()}
    sets = [shingle_set(t, 4) for t in texts]
    links = [(a, b) for a in range(300) for b in range(a + 1, 300) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert got == components(links, range(300))


def test_a_hot_group_of_near_copies_is_exact(spark):
    """Two thousand copies with up to a fifth of their words changed or cut: many are linked with others than the hub."""
    rng = random.Random(4)
    base, other = [f"w{k}" for k in range(80)], [f"o{k}" for k in range(25)]
    texts = []
    for n in range(2000):
        copy = list(base) if n % 10 else base[:50] + other
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(40)}"
        cut = rng.choice([0, 0, 0, 8, 15])
        texts.append(" ".join(copy[cut:]))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80).collect()}
    sets = [shingle_set(t, 5) for t in texts]
    at = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(at)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [at[x] for x in s]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    links = np.argwhere(np.triu(100 * both >= 80 * (size[:, None] + size - both), 1))
    want = components([tuple(map(int, p)) for p in links], range(len(texts)))
    assert len(set(want.values())) > 50 and got == want


def test_near_duplicates_of_odd_tables(spark):
    kind = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = minhash.near_duplicates(spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "a b"), (2, "")], kind)).collect()
    assert len(rows) == 5 and all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert [r.component_id for r in rows if r.doc_id == 1] == [1, 1]


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(120):
        v = rng.standard_normal(16)
        for _ in range(rng.integers(1, 5)):
            rows.append((v + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.06])).astype(np.float32) * rng.choice([1.0, 3.0]))
    vectors = [r.tolist() for r in rows] + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1e-30] * 16, [1e-30] * 16, [1.0] * 8]
    df = spark.createDataFrame([(5 * i, v, 1, "extra") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: r for r in embedding_dups.near_duplicate_vectors(df, 0.95).collect()}
    good = {5 * i: np.array(v, dtype=np.float32).astype(float) for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    want, ids = components(links, [5 * i for i in range(len(vectors))]), [5 * i for i in range(len(vectors))]
    degree = {i: sum(i in p for p in links) for i in ids}
    found = sum(r.n_links for r in got.values()) / max(1, sum(degree.values()))
    assert found >= 0.99 and all(got[i].n_links <= degree[i] for i in ids)
    assert sum(got[i].component_id == want[i] for i in ids) >= 0.99 * len(ids)
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_vectors_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert embedding_dups.near_duplicate_vectors(spark.createDataFrame([], kind)).count() == 0
    same = embedding_dups.near_duplicate_vectors(spark.createDataFrame([(k, [1.0, 2.0]) for k in (4, 4, 9)] + [(None, [1.0, 2.0])], kind)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in same if r.vec_id) == [(4, 2, 4), (4, 2, 4), (9, 2, 4)]


def test_archives(spark):
    pages = [(k, f"https://{h}.example.com/{k}?a=b", t) for k, (h, t) in enumerate([("a", "same"), ("b", "same"), ("c", None), ("d", ""), ("e", "x" * 100_000), ("f", "é\r\n\r\nz"), ("g", "same")])]
    pages += [(100, None, "no url"), (101, "not a url\x01", "same"), (102, "http://[bad", "one")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, key string")
    for least in (0, 1):
        got = {r.page_id: r for r in warc.archive_and_read(df, least).collect()}
        assert set(got) == {p[0] for p in pages}
        for page, _, html in pages:
            raw = (html or "").encode()
            alike = [p for p, _, h in pages if (h or "") == (html or "")]
            to = max(alike) if max(alike) != page and len(raw) >= least else None
            r = got[page]
            assert (r.payload_bytes, r.payload_digest, r.refers_to, r.record_type) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), to, "response" if to is None else "revisit")
            assert bytes(r.payload) == (raw if to is None else b"")


def test_archives_of_odd_tables(spark):
    kind = "page_id long, url string, html string"
    assert warc.archive_and_read(spark.createDataFrame([], kind)).count() == 0
    twice = warc.archive_and_read(spark.createDataFrame([(1, "http://a/", "x"), (1, "http://a/", "x"), (2, "http://a/", "y")], kind)).collect()
    assert sorted((r.page_id, r.record_type) for r in twice) == [(1, "response"), (1, "response"), (2, "response")]


ODD_URLS = ["http://[bad\tx", "http://[bad\nx", "http://h:99999999/a\nb", "http://[bad x\r", "\t\n", " ", "http://h/\u2028\x85", "x" * 5000, "http://h%zz/?\x7f", None]


def test_archives_return_every_row_of_repeated_pages_and_odd_urls(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(k, u, f"t{k % 3}") for k, u in enumerate(ODD_URLS)] + [(50, "http://a/x", "five")] * 23 + [(None, "http://b/", "none")] * 16 + [(None, "http://c/", "five"), (51, "http://d/", "one")]
    got = warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id is None, r.page_id or 0) for r in got) == sorted((p is None, p or 0) for p, _, _ in rows)
    assert {r.refers_to for r in got if r.payload_digest == warc.base32_sha1(b"five")} == {None, 50}
    assert all(r.record_type == "response" for r in got if r.payload_digest == warc.base32_sha1(b"none"))


def test_index_finds_what_is_there(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 9).cast("string"), F.lit(".org/p")).alias("url"), F.lit("t").alias("html"))
    folder = warc.fresh_path(spark, "warc")
    index = warc.CaptureIndex.build(warc.write_archives(warc.mark_revisits(pages), folder))
    assert len(index.first_keys) > 5
    some = warc.keys_of(pages.where("page_id % 10 = 3")).union(spark.createDataFrame([("zz,nowhere)/",), ("",)], "key string"))
    assert sorted(r.page_id for r in warc.read_records(index.lookup(some), folder).collect()) == list(range(3, 100, 10))


def test_pipeline_keeps_what_it_should(spark, data):
    import corpus_pipeline as p

    rows = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "Some plain words in a row here.", "en", None, 3)], rows.schema)
    docs = rows.union(odd).union(rows.limit(5)).withColumns({"doc": F.lit(1), "score": F.lit("x"), "copies": F.lit(None).cast("int"), "a.b`c": F.lit(2)})
    seen = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        path = p.fresh_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "near_dedup":
            ids = [r.doc_id for r in docs.where("doc_id is not null").select("doc_id").collect()]
            assert len(ids) == len(set(ids))
    last = p.STAGES[-1][1](spark, docs, data)
    assert last.count() == docs.count() and 0 < docs.select("doc_id").distinct().count() < seen.count()
    labels = spark.read.parquet(f"{data}/labels.parquet")
    clean = p.quality_stage(spark, seen, data).select("doc_id").distinct().join(labels.where("quality = 1"), "doc_id").count()
    assert clean >= 0.95 * seen.select("doc_id").distinct().join(labels.where("quality = 1"), "doc_id").count()


def test_pipeline_of_an_empty_table(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == 0
