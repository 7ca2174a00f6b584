"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Words get context vectors by random indexing: each word owns a sparse vector of a few +1 and -1
entries, and a word's context vector sums those of the words beside it. The shape of a token (runs
of capitals, small letters and digits as one sign each, punctuation as it stands) is a second word; a
token that repeats the one before it has a shape of its own. A document is the mean vector of its
words and of its shapes, drawn towards the corpus where it is short, with their lengths and the log
count.
The network has one hidden layer; a temperature fitted on rows left out calibrates its probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histospark.llm.common import held_out

#: Bounds of the labelled sample that fits the model: rows, and characters, after which no further row is taken.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 9_000_000
DIMENSIONS, ENTRIES, BESIDE, LEAST_COUNT, MOST_WORDS, BUCKETS = 64, 4, 2, 3, 30_000, 1 << 15
#: Shape of a token that repeats the one before it; tokens' worth of the corpus mean in a document's mean.
REPEAT, PRIOR = "=repeat", 4
#: Longer tokens aren't remembered by a worker.
LONG = 64
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-3

CAPITALS, SMALL, DIGITS = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")


def shape(token: str) -> str:
    """'The' is 'Aa', 'NOW!!' is 'A!!', '3.50' is '9.9'."""
    return DIGITS.sub("9", SMALL.sub("a", CAPITALS.sub("A", token)))


def index_vectors(n: int, seed: int) -> np.ndarray:
    """Which entries of each index vector aren't zero, as place * 2 + (1 for -1)."""
    return np.random.default_rng(seed).integers(0, 2 * DIMENSIONS, (n, ENTRIES))


def dense(index: np.ndarray) -> np.ndarray:
    out = np.zeros((len(index), DIMENSIONS), dtype=np.float32)
    for j in range(ENTRIES):
        out[np.arange(len(index)), index[:, j] // 2] += 1 - 2 * (index[:, j] % 2)
    return out / np.float32(np.sqrt(ENTRIES))


class Seen(dict):
    """Remembers each token's word id and shape id as one number."""

    def __init__(self, words: dict[str, int], shapes: dict[str, int]):
        self.words, self.shapes = words, shapes

    def __missing__(self, token: str) -> int:
        if len(self) > 60_000:
            self.clear()
        low = token.lower()
        word = self.words.get(low)
        form = shape(token)
        own = self.shapes.get(form)
        word = len(self.words) + crc32(low.encode("utf-8", "surrogatepass")) % BUCKETS if word is None else word
        own = len(self.shapes) + crc32(form.encode("utf-8", "surrogatepass")) % BUCKETS if own is None else own
        out = word << 24 | own
        if len(token) <= LONG:
            self[token] = out
        return out


def token_ids(tokens: list[str], seen: Seen) -> np.ndarray:
    """Word id << 24 | shape id of each token."""
    both = np.fromiter(map(seen.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    again = np.concatenate(([False], both[1:] == both[:-1]))
    return np.where(again, (both >> 24 << 24) | seen.shapes[REPEAT], both)


def context_vectors(docs: list[np.ndarray], n: int, index: np.ndarray) -> np.ndarray:
    """Each word's sum of the index vectors beside it, at unit length, plus half its own."""
    total = np.zeros(n * DIMENSIONS)
    for k in range(0, len(docs), 200):
        for apart in range(1, BESIDE + 1):
            at = np.concatenate([d[:-apart] for d in docs[k : k + 200]] or [np.zeros(0, int)])
            by = np.concatenate([d[apart:] for d in docs[k : k + 200]] or [np.zeros(0, int)])
            for word, other in ((at, by), (by, at)):
                word, other = word[word < n], other[word < n]
                for j in range(ENTRIES):
                    e = index[other, j]
                    total += np.bincount(word * DIMENSIONS + e // 2, weights=1.0 - 2 * (e % 2), minlength=n * DIMENSIONS)
    total = total.reshape(n, DIMENSIONS)
    total /= np.maximum(np.sqrt((total**2).sum(axis=1, keepdims=True)), 1e-9)
    total -= total.mean(axis=0) if n else 0
    return (total + 0.5 * dense(index[:n])).astype(np.float32)


@dataclass
class QualityModel:
    """All that a score needs; about 25 megabytes, whatever the size of the corpus."""

    words: dict[str, int]
    shapes: dict[str, int]
    word_vectors: np.ndarray
    shape_vectors: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    temperature: float = 1.0
    base: np.ndarray = field(default_factory=lambda: np.zeros(2 * DIMENSIONS, dtype=np.float32))

    def __post_init__(self):
        self.seen = Seen(self.words, self.shapes)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.seen = Seen(self.words, self.shapes)

    def features(self, texts: list[str | None], step: int = 1 << 15) -> np.ndarray:
        out = np.zeros((len(texts), 2 * DIMENSIONS + 3), dtype=np.float32)
        for i, text in enumerate(texts):
            tokens = (text or "").split()
            if not tokens:
                out[i, : 2 * DIMENSIONS] = self.base
                continue
            both = token_ids(tokens, self.seen)
            for k in range(0, len(both), step):
                part = both[k : k + step]
                out[i, :DIMENSIONS] += self.word_vectors[part >> 24].sum(axis=0)
                out[i, DIMENSIONS : 2 * DIMENSIONS] += self.shape_vectors[part & 0xFFFFFF].sum(axis=0)
            out[i, : 2 * DIMENSIONS] = (out[i, : 2 * DIMENSIONS] + PRIOR * self.base) / (len(tokens) + PRIOR)
            out[i, -3] = np.linalg.norm(out[i, :DIMENSIONS])
            out[i, -2] = np.linalg.norm(out[i, DIMENSIONS : 2 * DIMENSIONS])
            out[i, -1] = np.log1p(len(tokens))
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh((x - self.centre) / self.scale @ w + b) @ v + c

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(texts)) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Adam on the log loss of a network with one hidden layer of tanh units."""
    layers = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(())]
    first, second, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            of = order[k : k + BATCH]
            w, b, v, c = layers
            h = np.tanh(x[of] @ w + b)
            d = (1 / (1 + np.exp(-np.clip(h @ v + c, -30, 30))) - y[of]) / len(of)
            dh = d[:, None] * v * (1 - h * h)
            grads = [x[of].T @ dh + DECAY * w, dh.sum(axis=0), h.T @ d + DECAY * v, d.sum()]
            t += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - rate * first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return layers


def fit_texts(texts: list[str], labels: np.ndarray) -> QualityModel:
    rng = np.random.default_rng(11)
    raw, count, forms = Counter(), Counter(), Counter()
    for text in texts:
        raw.update(text.split())
    for token, n in raw.items():
        count[token.lower()] += n
        forms[shape(token)] += n
    words = {w: i for i, (w, n) in enumerate(count.most_common(MOST_WORDS)) if n >= LEAST_COUNT}
    shapes = {w: i for i, (w, n) in enumerate(forms.most_common(MOST_WORDS // 10)) if n >= LEAST_COUNT}
    shapes = {w: i for i, w in enumerate([REPEAT, *shapes])}
    seen = Seen(words, shapes)
    both = [token_ids(text.split(), seen) if text.split() else np.zeros(0, dtype=np.int64) for text in texts]
    del raw, count, forms
    vectors = []
    for n, seed, ids in ((len(words), 1, [d >> 24 for d in both]), (len(shapes), 2, [d & 0xFFFFFF for d in both])):
        index = index_vectors(n + BUCKETS, seed)
        vectors.append(np.concatenate([context_vectors(ids, n, index), dense(index[n:])]))
    model = QualityModel(words, shapes, *vectors)
    model.base = model.features(texts)[:, : 2 * DIMENSIONS].mean(axis=0)
    x, y = model.features(texts), labels.astype(np.float64)
    model.centre, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - model.centre) / model.scale
    apart = np.arange(len(z)) % 5 == 4  # the sample is in hash order
    if 0 < y[~apart].mean() < 1 and apart.any():
        model.layers = train(z[~apart], y[~apart], rng)
        logits = model.logits(x[apart])
        grid = np.geomspace(0.5, 8, 61)
        loss = [np.logaddexp(0, -(2 * y[apart] - 1) * logits / t).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    else:  # one class only: its smoothed share
        share = (y.sum() + 1) / (len(y) + 2)
        model.layers = [np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.log(share / (1 - share))]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> QualityModel:
    """Fits on at most ``rows`` labelled documents in the order of a hash of the id, none of them held
    out; the row that brings the sample to ``chars`` characters is its last, whatever its length, so
    long texts are as likely as others. Rows without id, label or text, and ids whose labels
    contradict each other, are passed over; of texts that repeat an id, the least counts. Without any
    labelled row, every score is one half."""
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit(5))
    told = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    chosen = told.where("quality = most").select("doc_id", "quality").orderBy(order).limit(rows)
    # at most rows ids: they may be broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    sample, used = [], 0
    for row in found.orderBy(order).toLocalIterator():
        used += len(row["text"])
        sample.append((row["text"], row["quality"]))
        if used >= chars:
            break
    return fit_texts([t for t, _ in sample], np.array([q for _, q in sample] or [], dtype=np.float64)) if sample else fit_texts([""], np.array([0.5]))


def quality_score(text: Column, model: QualityModel, spark) -> Column:
    """The probability that a text is of label 1, from the whole text; null is the empty text."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = held.value
        for batch in batches:
            yield pd.Series(own.scores(list(batch)) if len(batch) else np.zeros(0))

    return score(text)
