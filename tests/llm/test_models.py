"""Scores of the quality and language models against plain loops over dictionaries and code points."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from histospark.llm import langid, quality

ODD = [None, "", " \n", "word", "word word word Word WORD", "never seen tokens !!! 3.50 --", "é漢字 \U0001f600", "x" * 30_000, "a b " * 9000]


def texts(seed, many=120):
    rng = random.Random(seed)
    good, bad = "the of and stone River house 12 , .".split(), "BUY now!!! $$$ cheap 999 click click".split()
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(3, 60))), i % 2) for i in range(many)]
    return rows + [(many, rows[0][1], 0), (many, rows[0][1], 0)]  # repeated ids and ties


def plain_quality(model, text):
    d, tokens = quality.DIMENSIONS, (text or "").split()
    sums = [0.0] * (2 * d)
    before = None
    for token in tokens:
        low, form = token.lower(), quality.shape(token)
        word = model.words.get(low, len(model.words) + crc32(low.encode()) % quality.BUCKETS)
        own = model.shapes.get(form, len(model.shapes) + crc32(form.encode()) % quality.BUCKETS)
        key, own = (word, own), model.shapes[quality.REPEAT] if (word, own) == before else own
        before = key
        for k in range(d):
            sums[k] += float(model.word_vectors[word][k])
            sums[d + k] += float(model.shape_vectors[own][k])
    if tokens:
        sums = [(s + quality.PRIOR * float(b)) / (len(tokens) + quality.PRIOR) for s, b in zip(sums, model.base, strict=True)]
        extra = [math.sqrt(sum(s * s for s in sums[:d])), math.sqrt(sum(s * s for s in sums[d:])), math.log1p(len(tokens))]
    else:
        sums, extra = [float(b) for b in model.base], [0.0, 0.0, 0.0]
    x = [(v - float(c)) / float(s) for v, c, s in zip(sums + extra, model.centre, model.scale, strict=True)]
    w, b, v, c = model.layers
    hidden = [math.tanh(sum(x[i] * float(w[i][j]) for i in range(len(x))) + float(b[j])) for j in range(len(b))]
    logit = (sum(h * float(q) for h, q in zip(hidden, v, strict=True)) + float(c)) / model.temperature
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def test_quality_scores_equal_loops(spark):
    rows = texts(1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    seen = [t for t in [*ODD, *(t for _, t, _ in rows[:20])] if t is None or len(t) < 40_000]
    df = spark.createDataFrame(list(enumerate(seen)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", quality.quality_score(F.col("text"), model, spark).alias("s")).collect()}
    for i, text in enumerate(seen):
        assert got[i] == pytest.approx(plain_quality(model, text), abs=2e-4)
    again = quality.fit_quality(docs.repartition(3), labels.repartition(2))
    assert np.allclose(again.scores(seen), model.scores(seen))  # neither order nor partitions matter


def plain_language(model, text):
    run, codes = True, [0]
    for c in (text or "").lower():
        if c.isalpha():
            codes.append(ord(c))
            run = False
        elif not run:
            codes.append(0)
            run = True
    if len(codes) == 1:
        return langid.UNKNOWN, 0.0, True
    codes.append(0)
    counts, mask = Counter(), 0xFFFFFFFF
    for n in range(1, langid.LONGEST + 1):
        for k in range(len(codes) - n + 1):
            h = n
            for j in range(n):
                h = (((h ^ h >> 15) * int(langid.FACTORS[j])) + codes[k + j]) & mask
            h = ((h ^ h >> 13) * int(langid.FACTORS[0])) & mask
            counts[h >> 20] += 1
    total = math.sqrt(sum(counts.values()))
    signs = [sum(math.sqrt(c) / total * float(model.weights[f][b]) for f, c in counts.items()) + float(model.bias[b]) for b in range(model.code.shape[1])]
    loss = [sum(math.log1p(math.exp(-float(code[b]) * signs[b])) * float(model.trust[b]) for b in range(len(signs))) for code in model.code]
    best = min(range(len(loss)), key=lambda k: (loss[k], k))
    score = 1 / sum(math.exp(loss[best] - x) for x in loss)
    return model.languages[best], score, score < langid.AMBIGUOUS


def test_languages_equal_loops(spark):
    rng = random.Random(2)
    words = {"en": "the of and stone river house".split(), "fr": "le la rivière été maison où".split(), "ru": "дом река и не на что".split()}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(rng.randint(2, 25))), g) for i, g in enumerate(sorted(words) * 40)]
    rows += [(7, rows[7][1], rows[7][2])] * 3
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    model = langid.fit_languages(docs)
    seen = [*ODD, "...", "12 34", "a", " the of", "the!of", "Été À LA MAISON", *(t for _, t, _ in rows[:12])]
    df = spark.createDataFrame(list(enumerate(seen)), "doc_id long, text string")
    got = {r.doc_id: r.f for r in df.select("doc_id", langid.language(F.col("text"), model, spark).alias("f")).collect()}
    for i, text in enumerate(seen):
        lang, score, ambiguous = plain_language(model, text)
        assert got[i].lang == lang and got[i].score == pytest.approx(score, abs=1e-6) and got[i].ambiguous == ambiguous
