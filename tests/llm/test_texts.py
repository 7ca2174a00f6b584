"""Quality, language, tokens, fingerprints, chats, licences and mixing on small and odd tables."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from histospark.llm import bpe, chat, fingerprint, langid, licenses, mixing, quality
from histospark.llm.common import held_out, n_words
from histospark.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, node string, doc string"


def docs(spark, texts, **more):
    n = len(texts)
    ids, langs, sources = (more.get(k) or d for k, d in (("ids", list(range(n))), ("langs", ["en"] * n), ("sources", ["a"] * n)))
    return spark.createDataFrame([(i, t, g, s, None, "extra", "extra", "extra") for i, t, g, s in zip(ids, texts, langs, sources, strict=True)], DOCS)


ODD = [None, "", " ", "\n\n", "a", "A a", "x" * 40_000, "wörd 漢字 \U0001f600 é", "<|endoftext|> x <|endoftext|>", "tab\there  two\n\nlines \n", "a b c " * 9000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, tokenizer):
    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choice(["the", "ing", " ", "\n", "'s", "é", "1", "!?", " ", "<|endoftext|>"]) for _ in range(rng.randint(1, 50))) for _ in range(200))]
    ids = docs(spark, texts).select("doc_id", bpe.bpe_encode(F.col("text"), tokenizer_path()).alias("ids"))
    got = ids.select("doc_id", "ids", bpe.bpe_decode(F.col("ids"), tokenizer_path()).alias("back")).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        assert list(row.ids) == tokenizer.encode(text or "", add_special_tokens=False).ids
        assert row.back == tokenizer.decode(list(row.ids), skip_special_tokens=False) == (text or "")


def test_bpe_in_one_pass_equals_both_steps(spark):
    texts = [*ODD, *ODD]
    df = docs(spark, texts)
    got = df.select("doc_id", bpe.bpe_round_trip(F.col("text"), tokenizer_path()).alias("b")).select("doc_id", "b.ids", "b.decoded")
    ids = df.select("doc_id", bpe.bpe_encode(F.col("text"), tokenizer_path()).alias("ids"))
    want = ids.select("doc_id", "ids", bpe.bpe_decode(F.col("ids"), tokenizer_path()).alias("decoded"))
    assert sorted(got.collect()) == sorted(want.collect())
    assert df.where("false").select(bpe.bpe_round_trip(F.col("text"), tokenizer_path())).count() == 0


def test_bpe_of_a_million_letters_without_a_space(tokenizer):
    import time

    rng = random.Random(8)
    own = bpe.encoder(tokenizer_path())
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(10**6))
    began = time.process_time()
    ids = own.encode([text])[0].tolist()
    assert time.process_time() - began < 60
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_merges_of_one_word_equal_merges_of_many(tokenizer):
    rng = random.Random(9)
    vocabulary = bpe.encoder(tokenizer_path()).vocabulary
    words = ["".join(rng.choice("abcdetion") for _ in range(rng.randint(2, 300))).encode() for _ in range(200)]
    for w in words:
        width = 1 << (len(w) - 1).bit_length()
        many, _ = bpe.merge_rows(vocabulary, [w], np.array([len(w)]), width)
        assert bpe.merge_word(vocabulary, w, width) == many.tolist()


def test_bpe_decode_of_odd_ids(spark):
    rows = spark.createDataFrame([(None,), ([],), ([10**6, -1],)], "ids array<int>")
    assert [r[0] for r in rows.select(bpe.bpe_decode(F.col("ids"), tokenizer_path())).collect()] == ["", "", ""]


def test_bpe_cache_stays_bounded_and_right(tokenizer):
    e = bpe.Encoder(bpe.Vocabulary(tokenizer_path()), most=50)
    rng = random.Random(5)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(30)) for _ in range(5)]
        assert [x.tolist() for x in e.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(e.young) + len(e.old) < 700


def fp(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").withColumn("fp", fingerprint.fingerprint(F.col("text")))
    return rows.orderBy("i")


def test_fingerprints_are_multisets_of_paragraphs(spark):
    a, b, c, d, none, empty = [r[0] for r in fp(spark, "one\ntwo\nthree", "three\none\ntwo", "one\ntwo\ntwo\nthree", "one two three", None, "").select(fingerprint.as_text(F.col("fp"))).collect()]
    assert a == b and len({a, c, d}) == 3 and none == empty


def test_fingerprints_combine(spark):
    rows = fp(spark, "some longer paragraph\nanother one", "third", "some longer paragraph\nanother one\nthird").agg(F.collect_list("fp").alias("f"))
    plus, minus = fingerprint.combine(F.col("f")[0], F.col("f")[1]), fingerprint.combine(F.col("f")[2], F.col("f")[1], remove=True)
    got = rows.select(*[fingerprint.as_text(x) for x in (plus, F.col("f")[2], minus, F.col("f")[0])]).first()
    assert got[0] == got[1] and got[2] == got[3]


def fingerprint_in_python(text):
    """What the fingerprint of a text should be, paragraph by paragraph."""
    import re
    import struct

    import xxhash

    word = lambda p: xxhash.xxh64_intdigest(p.encode(), seed=42)
    again = lambda h, k: xxhash.xxh64_intdigest(struct.pack("<i", k), seed=h)
    exact, lanes, n = [0] * 4, [0] * 124, 0
    for paragraph in text.split("\n"):
        h = word(paragraph)
        exact = [(x + (again(h, k) & (1 << 56) - 1)) % (1 << 56) for k, x in enumerate(exact)]
        for phrase in re.split(r"(?<=[a-z]{6}) |(?<=[a-z]{6}[.,]) ", paragraph):
            h, n = word(phrase), n + 1
            for k, own in enumerate((h, again(xxhash.xxh64_intdigest(struct.pack("<Q", h), seed=42), 1))):
                for j in range(62):
                    lanes[62 * k + j] += own >> j & 1
    packed = [lanes[62 * k + j] | lanes[62 * k + 31 + j] << 31 for k in range(2) for j in range(31)]
    return "".join(f"{x:014x}" for x in exact) + f"-{n:x}-" + ".".join(f"{x:x}" for x in packed)


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ",", "."])
    texts = ["", "a", "\n", "x" * 300_000, "longer words " * 40_000] + ["\n".join(" ".join(word() for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    got = [r[0] for r in fp(spark, *texts).select(fingerprint.as_text(F.col("fp"))).collect()]
    assert got == [fingerprint_in_python(t) for t in texts]


def test_likeness_is_near_the_cosine_of_phrases(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    errors = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        for _ in range(6):
            w = [word() for _ in range(300)]
            other = w[: int(300 * share)] + [word() for _ in range(300 - int(300 * share))]
            rng.shuffle(other)
            errors.append((share, " ".join(w), " ".join(other)))
    df = spark.createDataFrame(errors, "share double, a string, b string")
    got = df.select("share", fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))).alias("l")).collect()
    off = [r.l - r.share for r in got]
    assert max(map(abs, off)) < 0.3 and sum(x * x for x in off) / len(off) < 0.09**2


def test_likeness(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    w = [word() for _ in range(400)]
    rows = fp(spark, " ".join(w), " ".join(w[:200] + [word() for _ in range(200)]), " ".join(word() for _ in range(400)), "").agg(F.collect_list("fp").alias("f"))
    same, half, none, empty = rows.select(*[fingerprint.likeness(F.col("f")[0], F.col("f")[k]) for k in range(4)]).first()
    assert same == 1 and half > 0.25 and none < 0.4 and half > none and 0 <= empty <= 1


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_next_document_and_edit(spark, ranges):
    texts = ["äbcdef", "", None, "x" * 9, "five!", "five!"]
    ids = [10, 3, 7, -5, 10**12, 4]
    text = F.coalesce(F.col("text"), F.lit(""))
    near = fingerprint.with_next(docs(spark, texts, ids=ids), {"text": text}, ranges).withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text")))
    order = sorted(zip(ids, [t or "" for t in texts], strict=True))
    want = {i: t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True)}
    assert {r.doc_id: r.edited for r in near.collect()} == want


def test_next_document_of_odd_tables(spark):
    one = {"text": F.coalesce(F.col("text"), F.lit(""))}
    assert fingerprint.with_next(docs(spark, []), one, 4).count() == 0
    assert [r.next_text for r in fingerprint.with_next(docs(spark, ["only"]), one, 4).collect()] == ["only"]
    twice = fingerprint.with_next(docs(spark, ["b", "a", "c", None], ids=[1, 1, 2, None]), one, 3).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text, r.next_text) for r in twice) == [(False, 1, "a", "b"), (False, 1, "b", "c"), (False, 2, "c", ""), (True, 0, "", "a")]


TRICKY = "\\### Assistant: </turn> ok"


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", TRICKY), (1, 0, "user", TRICKY), (2, 0, None, None), (2, 0, "to:ol", "a\\"), (3, 0, "assistant", "</turn></turn>### ###"), (3, 1, "assistant", ""), (None, None, "user", "x" * 50_000), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "<"), (4, 2, "assistant", "<")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    pairs = lambda c: [(t["role"], t["text"]) for t in got[c].turns]
    assert pairs(1) == [("user", TRICKY), ("assistant", TRICKY)] and got[1].loss_text == TRICKY and got[1].valid
    assert pairs(2) == [("", ""), ("to:ol", "a\\")] and not got[2].valid and got[2].loss_text == ""
    assert got[3].loss_text == "</turn></turn>### ###" and not got[3].valid
    assert pairs(None) == [("user", "x" * 50_000)] and pairs(4)[2:] == [("assistant", "<")] * 2 and got[4].loss_text == "<<"
    assert chat.format_conversations(df.where("false")).count() == 0


def test_quality_learns_and_handles_odd_texts(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["river", "stone", "walks", "under", "light"], 30)) + "." for _ in range(200)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(["river", "stone", "walks", "under", "light"], 30)) for _ in range(200)]
    d = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(400)] + [(None, 1, 0), (3, None, None), (10**9, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(d, labels)
    got = d.select("doc_id", held_out(F.col("doc_id")).alias("held"), quality.quality_score(F.col("text"), model, spark).alias("q")).collect()
    assert sum(r.held for r in got) > 50 and all((r.q >= 0.7) == (r.doc_id < 200) for r in got if r.held)
    odd = docs(spark, ODD).select(quality.quality_score(F.col("text"), model, spark).alias("q")).collect()
    assert len(odd) == len(ODD) and all(0 <= r.q <= 1 for r in odd)
    none = quality.fit_quality(d.where("false"), labels)
    assert [r.q for r in d.limit(2).select(quality.quality_score(F.col("text"), none, spark).alias("q")).collect()] == [0.5, 0.5]
    one_class = quality.fit_quality(d, labels.where("quality = 1"))
    assert d.limit(1).select(quality.quality_score(F.col("text"), one_class, spark).alias("q")).first().q > 0.9


def test_quality_ignores_held_out_labels(spark):
    d = docs(spark, [f"word{i}" for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    flipped = labels.select("doc_id", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    scores = [[r[0] for r in d.orderBy("doc_id").select(quality.quality_score(F.col("text"), quality.fit_quality(d, x), spark)).collect()] for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_languages(spark):
    rng = random.Random(2)
    words = {"en": "the and river with house".split(), "de": "der und fluß mit häuser".split(), "fr": "le et rivière avec maison".split()}
    texts = [(g, " ".join(rng.choice(words[g]) for _ in range(20))) for g in words for _ in range(40)]
    d = docs(spark, [t for _, t in texts], langs=[g for g, _ in texts])
    model = langid.fit_languages(d)
    got = d.select("lang", langid.language(F.col("text"), model, spark).alias("p")).collect()
    assert all(r.p.lang == r.lang and 0 <= r.p.score <= 1 for r in got)
    odd = docs(spark, [*ODD, "123 !?", "\U0001f600"]).orderBy("doc_id").select("text", langid.language(F.col("text"), model, spark).alias("p")).collect()
    assert all((r.p.lang == "und") == (not any(c.isalpha() for c in r.text or "")) for r in odd)
    empty = langid.fit_languages(d.where("false"))
    assert docs(spark, ["text"]).select(langid.language(F.col("text"), empty, spark).alias("p")).first().p.lang == "und"
    single = langid.fit_languages(d.where("lang = 'de'"))
    assert docs(spark, ["text"]).select(langid.language(F.col("text"), single, spark).alias("p")).first().p.lang == "de"


@pytest.mark.parametrize("k", [1, 2, 4, 7, 8, 40])
def test_codewords_differ(k):
    code = langid.codewords(k)
    assert code.shape[0] == k and set(np.unique(code)) <= {-1, 1}
    assert len({tuple(r) for r in code.tolist()}) == k


def mix(spark, rows):
    df = spark.createDataFrame([(*r, "extra", "extra", 1) for r in rows], "doc_id long, source string, text string, size string, rank string, copies int")
    return mixing.systematic_mix(df, n_words(F.col("text"))).collect()


def water_fill(sizes, weights, most=3):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(t for i, t in enumerate(target) if i not in open_)
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > most * sizes[i]}
        for i in over or open_:
            target[i] = most * sizes[i] if i in over else share[i]
        open_ = open_ - over if over else set()
    return target


def test_mixing_targets_and_copies(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", "d", "z", None]), " ".join("w" * rng.randint(0, 60))) for i in range(3000)]
    rows += [(5000 + i, "tiny", "one two") for i in range(3)] + [(6000, "empty", None)]
    got = mix(spark, rows)
    assert len(got) == len(rows)
    names = sorted({r.source for r in got if r.source is not None}) + [None]
    sizes = [sum(r.size for r in got if r.source == s) for s in names]
    want = water_fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])
    for name, size, target in zip(names, sizes, want, strict=True):
        own = [r for r in got if r.source == name]
        assert all(r.source_size == size and abs(r.target - target) < 1e-6 for r in own)
        assert abs(sum(r.copies * r.size for r in own) - target) <= max(130, 0.02 * target)
    assert all(0 <= r.copies <= 3 for r in got) and got and {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in mix(spark, rows[::-1])}


def test_mixing_of_odd_tables(spark):
    assert mix(spark, []) == []
    assert [r.copies for r in mix(spark, [(1, "a", None), (2, "a", "")])] == [0, 0]
    twice = mix(spark, [(1, None, "a b"), (1, None, "a b"), (None, None, "c")])
    assert len(twice) == 3 and all(abs(r.target - 5) < 1e-9 for r in twice)


def scan(spark, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "file_id long, path string, text string, score string")
    return {r.file_id: r for r in licenses.scan_licenses(df).collect()}


def test_licenses(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    got = scan(spark, [(1, "p/LICENSE", apache), (2, "p/a/b/x.py", "no licence here"), (3, "p/a/COPYING.txt", "head\n" + mit + "\ntail"), (4, "q/y.py", "code\n" + mit.upper() + "\ncode"), (5, "q/z.py", ""), (6, "r/only", mit), (7, "r/s/t", None), (8, None, apache), (9, "p/w", "x " * 30_000), (9, "p/w", "x")])
    assert got[1].license_id == "Apache-2.0" and got[1].inherited_from is None
    assert (got[2].license_id, got[2].inherited_from) == ("MIT", "p/a") and got[3].line == 1
    assert got[4].license_id == "MIT" and got[5].license_id is None
    assert (got[7].license_id, got[7].inherited_from) == ("MIT", "r") and got[8].license_id == "Apache-2.0"
    assert got[9].license_id == "Apache-2.0"
    assert scan(spark, []) == {}


def test_license_anchors_lose_nothing():
    m = licenses.Matcher(1000, {"the": 900, "license": 30})
    rng = random.Random(6)
    for _ in range(500):
        _, text = rng.choice(licenses.TEMPLATES)
        line = " ".join(w for w in text.split() if rng.random() < 0.8)
        if m.best(line)[0] >= m.alike:
            assert m.scan(line)[0] is not None


def test_sha1_names():
    from histospark.llm.warc import base32_sha1

    assert base32_sha1(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode() and len(base32_sha1(b"x")) == 32


def wrapped(text, mark="", width=70):
    import textwrap

    return "\n".join(f"{mark}{line}" for part in text.split("\n") for line in textwrap.wrap(part, width))


def test_whole_licences_headers_and_tags(spark):
    import os

    code = "\n".join(f"value_{k} = compute({k}, other_{k % 7})" for k in range(200))
    mit = "MIT License\n\nCopyright (c) 2021 Some Body\n\n" + wrapped(licenses.MIT_GRANT)
    bsd3 = "Copyright 2020 A. B.\n" + wrapped("\n".join((licenses.BSD_START, licenses.BSD_THIRD, licenses.BSD_END)))
    bsd2 = "Copyright 2020 A. B.\n" + wrapped("\n".join((licenses.BSD_START, licenses.BSD_END)))
    gpl, apache = (next(t for n, t in licenses.TEMPLATES if n == name and t.count("\n")) for name in ("GPL-3.0", "Apache-2.0"))
    files = {"MIT": [mit, "# head\n" + code + "\n" + wrapped(licenses.MIT_GRANT, "# ")], "BSD-3-Clause": [bsd3], "BSD-2-Clause": [bsd2, wrapped(bsd2, " * ") + "\n" + code], "ISC": [wrapped(licenses.ISC_TEXT, "// ") + "\n" + code]}
    files |= {"GPL-3.0": [wrapped(gpl, "# ") + "\n" + code, wrapped(gpl.split("\n")[0], "# ") + "\n" + code], "Apache-2.0": [wrapped(apache, " * ", 60) + "\n" + code], "MPL-2.0": []}
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0")):
        if os.path.exists(f"/usr/share/common-licenses/{file}"):
            files[name].append(open(f"/usr/share/common-licenses/{file}", encoding="utf-8").read())
    want = [(name, text) for name, texts in files.items() for text in texts] + [(None, code), (None, "licensed under no terms at all by the software people")]
    got = scan(spark, [(k, f"d{k}/f", text) for k, (_, text) in enumerate(want)])
    assert [got[k].license_id for k in range(len(want))] == [name for name, _ in want]


def test_tags_stand_beside_the_cosines(spark):
    code = "\n".join(f"value_{k} = compute({k})" for k in range(20))
    texts = ["// SPDX-License-Identifier: Apache-2.0\n" + code, "<!-- SPDX-License-Identifier: (MPL-2.0 OR MIT) -->", "Released under the MIT License.\n// SPDX-License-Identifier: ISC", code, None, "SPDX but no tag"]
    got = scan(spark, [(k, f"d{k}/f", text) for k, text in enumerate(texts)])
    assert [got[k].spdx_tag for k in range(len(texts))] == ["Apache-2.0", "MPL-2.0", "ISC", None, None, None]
    assert [got[k].license_id for k in range(len(texts))] == [None, None, "MIT", None, None, None] and got[0].score == 0.0


def brute_scan(texts):
    """Licence and cosine of each text: all lines, runs of lines and the whole, under exact document frequencies."""
    from collections import Counter
    from math import log, sqrt

    own = [[licenses.terms(line) for line in (t or "").split("\n")] for t in texts]
    held = Counter(w for t in own for w in {w for line in t for w in line})
    idf = lambda w: log((len(texts) + 1) / (max(held[w], 1) + 1)) + 1
    vector = lambda ws: {w: n * idf(w) for w, n in Counter(ws).items()}
    size = lambda v: sqrt(sum(x * x for x in v.values()))
    made = [(name, len(licenses.terms(t)), vector(licenses.terms(t))) for name, t in licenses.TEMPLATES]
    out = []
    for lines in own:
        best = (0.0, None)
        for name, words, v in made:
            runs = [[w for line in lines for w in line], *lines]
            runs += [r for a in range(len(lines)) for b in range(a + 2, len(lines) + 1) if licenses.SHORTEST * words <= len(r := [w for line in lines[a:b] for w in line]) <= licenses.LONGEST * words]
            for u in map(vector, runs):
                if u:
                    cosine = sum(x * v.get(w, 0) for w, x in u.items()) / size(u) / size(v)
                    best = max(best, (cosine, name), key=lambda p: (round(p[0], 9), p[1] or ""))
        out.append(best if best[0] >= licenses.ALIKE else (0.0, None))
    return out


def test_license_cosines_equal_brute_force(spark):
    rng = random.Random(21)
    filler = [f"word{k}" for k in range(40)] + ["software", "license", "the", "of", "copyright"]
    texts = [None, "", "\n\n"]
    for _ in range(60):
        _, t = rng.choice(licenses.TEMPLATES)
        kept = " ".join(w for w in t.split() if rng.random() < rng.choice([0.8, 0.95, 1.0]))
        prose = lambda: "\n".join(" ".join(rng.choice(filler) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6)))
        texts.append(f"{prose()}\n{wrapped(kept, '# ', rng.choice([30, 60]))}\n{prose()}")
    got = scan(spark, [(k, None, t) for k, t in enumerate(texts)] + [(999, None, texts[5])])
    want = brute_scan([*texts, texts[5]])
    for k in range(len(texts)):
        assert (got[k].license_id is None) == (want[k][1] is None) and abs(got[k].score - min(want[k][0], 1.0)) < 1e-6, k
        assert got[k].license_id in (want[k][1], next((n for c, n in [want[k]] if c), None))


def test_language_samples_of_any_number_of_rows(spark):
    rows = docs(spark, [f"text {i}" for i in range(3000)])
    got = langid.sampled(rows.select("doc_id", "lang", "text"), {"en": 10**10}, 10)  # as if these were few of very many
    assert got.count() == 0
    got = langid.sampled(rows.select("doc_id", "lang", "text"), {"en": 3000}, 10).collect()
    assert sorted(r["place"] for r in got) == list(range(1, 11))
    # a language named less often than it occurs never ranks more than its share
    assert langid.sampled(rows.select("doc_id", "lang", "text"), {"en": 1}, 10).count() == 10
