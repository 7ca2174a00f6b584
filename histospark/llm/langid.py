"""Language identification by error-correcting output codes over hashed character n-grams.

Each language has a codeword of signs. For each bit, a binary logistic classifier over the n-grams
of letters predicts the sign; decoding adds up each bit's logistic loss against every codeword,
weighted by how reliable the bit was on rows left out, and takes the codeword of least loss. Where
the runner-up is close, the prediction is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histospark.llm.common import held_out

#: Bound of the labelled sample that fits the classifiers, over all languages; rows of each language at least.
SAMPLE_ROWS, LEAST_ROWS = 4000, 20
FEATURES, LONGEST = 4096, 3
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.5, 1e-5
UNKNOWN = "und"
#: A prediction is ambiguous where its score, the share of exp(-loss), is below this.
AMBIGUOUS = 0.5
FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)
LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not LETTERS:
        LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return LETTERS[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams of a text's letters in lower case, a run of others being
    one space, scaled to unit length after a square root; None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, np.uint32(0))
    codes = np.concatenate((np.zeros(1, np.uint32), codes[(codes > 0) | np.concatenate(([False], is_letter[:-1]))], np.zeros(1, np.uint32)))
    counts = np.zeros(FEATURES)
    for n in range(1, LONGEST + 1):
        h = np.full(len(codes) - n + 1, n, dtype=np.uint32)
        for j in range(n):
            h = (h ^ (h >> np.uint32(15))) * FACTORS[j] + codes[j : len(codes) - n + 1 + j]
        h = (h ^ (h >> np.uint32(13))) * FACTORS[0]
        counts += np.bincount(h >> np.uint32(20), minlength=FEATURES)
    root = np.sqrt(counts)
    return root / np.sqrt(counts.sum())


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """k rows of signs: all splits in two for up to 7 languages, else the best of many random codes by least distance."""
    if k <= 7:
        rows = [[1, *signs] for signs in product([1, -1], repeat=max(k - 1, 0)) if k == 1 or -1 in signs]
        return np.array(rows).T.reshape(k, -1)
    rng, length, best, most = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (k, length))
        if (np.abs(code.sum(axis=0)) == k).any():
            continue
        apart = (length - code @ code.T) // 2 + length * np.eye(k, dtype=int)
        if apart.min() > most:
            best, most = code, apart.min()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        x = gram_counts(text)
        if x is None or not self.languages:
            return UNKNOWN, 0.0, True
        signs = x @ self.weights + self.bias
        loss = np.logaddexp(0, -self.code * signs) @ self.trust
        share = np.exp(loss.min() - loss)
        best = int(np.argmin(loss))
        score = float(1 / share.sum())
        return self.languages[best], score, score < AMBIGUOUS


def fit_grams(x: np.ndarray, y: list[str]) -> LanguageModel:
    languages = sorted(set(y))
    code = codewords(len(languages))
    of = np.array([languages.index(v) for v in y])
    signs = code[of].astype(np.float64)
    apart = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    w, b = np.zeros((FEATURES, code.shape[1])), np.zeros(code.shape[1])
    share = np.bincount(of[~apart], minlength=len(languages))
    balance = (1 / np.maximum(share, 1))[of] * (~apart).sum() / max(len(languages), 1)
    rng, rows = np.random.default_rng(5), np.nonzero(~apart)[0]
    for epoch in range(EPOCHS):
        rng.shuffle(rows)
        for k in range(0, len(rows), BATCH):
            r = rows[k : k + BATCH]
            push = signs[r] / (1 + np.exp(np.clip(signs[r] * (x[r] @ w + b), -30, 30))) * balance[r, None]
            w += RATE * 20 * (x[r].T @ push / len(r) - DECAY * w)
            b += RATE * push.mean(axis=0)
    right = ((x[apart] @ w + b) * signs[apart] > 0).mean(axis=0) if apart.any() else np.full(code.shape[1], 0.9)
    trust = np.log((right * apart.sum() + 1) / ((1 - right) * apart.sum() + 1)) if apart.any() else np.ones(code.shape[1])
    trust = np.maximum(trust, 0.0)
    return LanguageModel(languages, code, w, b, trust / max(trust.mean(), 1e-9))


def sampled(labelled: DataFrame, counts: dict[str, int], share: int) -> DataFrame:
    """lang, text and place of the first ``share`` rows of each language by a hash of the id.

    Each language's count gives a bound of the hash that about twice as many rows and fifty more
    pass, so no more than these are shuffled and ranked, however frequent the language is.
    """
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit(9))
    below = F.pmod(order, F.lit(1 << 40)) < F.lit(float(2 * share + 50)) / F.col("rows") * float(1 << 40)  # in double: no count overflows it
    rows = labelled.sparkSession.createDataFrame(sorted(counts.items()), "of string, rows long")
    # the model holds a codeword for each language anyway; beyond so many, texts are shuffled for the join
    rows = F.broadcast(rows) if len(counts) <= 100_000 else rows
    few = labelled.join(rows, F.col("lang") == F.col("of")).where(below).select("doc_id", "lang", "text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", "text"))
    return few.withColumn("place", place).where(F.col("place") <= share)


def fit_languages(docs: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fits on at most ``rows`` documents with a language, as many of each, none of them held out; where
    there are many languages, on ``LEAST_ROWS`` of each. Every language of a labelled row is learned.

    Of a language, rows are taken in the order of a hash of the id; rows that repeat an id are rows
    each. Without labelled rows every prediction is ``und``.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().toLocalIterator()}
    known = len(counts)
    if not known:
        return LanguageModel([], np.zeros((0, 0)), np.zeros((FEATURES, 0)), np.zeros(0), np.zeros(0))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [gram_counts(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "x": [None if v is None else v.astype(np.float32).tobytes() for v in x]}, dtype=object)

    chosen = sampled(labelled, counts, max(LEAST_ROWS, rows // known)).select("doc_id", "lang", "text")
    order = (F.xxhash64("doc_id", F.lit(9)), F.col("doc_id"), F.xxhash64("x"))
    sample = chosen.mapInPandas(grams, "doc_id long, lang string, x binary").where("x is not null")
    # rows come to the driver a few hundred at a time
    got = sample.repartitionByRange(max(1, known * max(LEAST_ROWS, rows // known) // 250), *order).sortWithinPartitions(*order).toLocalIterator()
    x, y = np.zeros((known * max(LEAST_ROWS, rows // known), FEATURES), dtype=np.float32), []
    for row in got:
        x[len(y)] = np.frombuffer(row["x"], dtype=np.float32)
        y.append(row["lang"])
    return fit_grams(x[: len(y)], y)


def language(text: Column, model: LanguageModel, spark) -> Column:
    """struct<lang, score, ambiguous> of whole texts; texts that are null or have no letter are ``und`` with score 0."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = held.value
        for batch in batches:
            yield pd.DataFrame([own.predict(t) for t in batch], columns=["lang", "score", "ambiguous"], dtype=object)

    return predict(text)
