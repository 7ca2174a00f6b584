"""Document fingerprints by a homomorphic multiset hash of paragraphs. DataFrame operations only.

A paragraph (text between line feeds) hashes to a wide vector of two kinds of lanes:

* four equality lanes: 56 bits of the whole paragraph's hash under four seeds, added modulo 2**56;
* 124 likeness lanes, modulo 2**30: how many of the paragraph's phrases have a certain bit set in
  their hash. So paragraphs that differ in a few words have like vectors.

A document's fingerprint is the sum over its paragraphs: paragraphs may come in any order, adding or
taking away a paragraph adds or subtracts its vector (``combine``), and equal multisets of
paragraphs have equal fingerprints. As a phrase's bits are fair coins, the centred likeness lanes of
two documents have a cosine that estimates that of their phrase counts, with a standard error of
1 / sqrt(124) = 0.09 for unlike documents and less for like ones. No text that fits into a row has
2**30 phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A phrase ends after a word of six letters or more, so an edit changes only the phrases it touches.
PHRASE_END = r"\n|(?<=\p{L}{6}[.,]?) "
EQUALITY_LANES, EQUALITY_BITS, LIKENESS_BITS = 4, 56, 30
#: A long holds two likeness lanes, each with one spare bit for the carry, which is then cleared.
STEP = LIKENESS_BITS + 1
ONES = 1 | 1 << STEP
LANES = ONES * ((1 << LIKENESS_BITS) - 1)
#: Hashes of each phrase; each fills STEP longs.
HASHES = 2
EQUALITY = (1 << EQUALITY_BITS) - 1


def given(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.transform(F.array(value), use)[0]


def added(values: Column, mask: int) -> Column:
    """The sum of an array of longs, lane by lane: what a step carries beyond the mask is cleared."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: (acc + x).bitwiseAND(F.lit(mask)))


def fingerprint(text: Column) -> Column:
    """struct<exact array<long>, packed array<long>, n long>; a null text is the empty text, which is one empty paragraph."""
    text = F.coalesce(text, F.lit(""))
    exact = given(F.split(text, "\n", -1), lambda ps: F.array(*[added(F.transform(ps, lambda p: F.xxhash64(p, F.lit(k)).bitwiseAND(F.lit(EQUALITY))), EQUALITY) for k in range(EQUALITY_LANES)]))
    bits = lambda h, j: F.shiftrightunsigned(h, j).bitwiseAND(F.lit(ONES))
    phrases = F.transform(F.split(text, PHRASE_END, -1), lambda p: given(F.xxhash64(p), lambda h: F.struct(h.alias("h0"), *[F.xxhash64(h, F.lit(k)).alias(f"h{k}") for k in range(1, HASHES)])))
    count = lambda hs, k, j: F.aggregate(hs, F.lit(0).cast("long"), lambda acc, h: (acc + bits(h[f"h{k}"], j)).bitwiseAND(F.lit(LANES)))
    likeness = given(phrases, lambda hs: F.struct(F.array(*[count(hs, k, j) for k in range(HASHES) for j in range(STEP)]).alias("packed"), F.size(hs).cast("long").alias("n")))
    return given(likeness, lambda x: F.struct(exact.alias("exact"), x["packed"].alias("packed"), x["n"].alias("n")))


def combine(a: Column, b: Column, remove: bool = False) -> Column:
    """The fingerprint of a's paragraphs with b's added, or with b's taken away."""
    plus = lambda mask, spare: lambda x, y: (x + (F.lit(spare) - y if remove else y)).bitwiseAND(F.lit(mask))
    n = a["n"] - b["n"] if remove else a["n"] + b["n"]
    return F.struct(
        F.zip_with(a["exact"], b["exact"], plus(EQUALITY, EQUALITY + 1)).alias("exact"),
        F.zip_with(a["packed"], b["packed"], plus(LANES, ONES << LIKENESS_BITS)).alias("packed"),
        n.alias("n"),
    )


def as_text(fp: Column) -> Column:
    """Equality lanes, number of phrases and likeness lanes in hexadecimal."""
    return F.concat_ws("-", F.array_join(F.transform(fp["exact"], lambda x: F.lpad(F.lower(F.hex(x)), EQUALITY_BITS // 4, "0")), ""), F.lower(F.hex(fp["n"])), F.array_join(F.transform(fp["packed"], lambda x: F.lower(F.hex(x))), "."))


def centred(fp: Column) -> Column:
    one = F.lit((1 << LIKENESS_BITS) - 1)
    lanes = F.flatten(F.transform(fp["packed"], lambda p: F.array(*[F.shiftrightunsigned(p, k * STEP).bitwiseAND(one) for k in range(2)])))
    return F.transform(lanes, lambda c: (c * 2 - fp["n"]).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the centred likeness lanes, 0 where negative or undefined."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    cosine = given(F.struct(centred(a).alias("a"), centred(b).alias("b")), lambda v: given(F.struct(dot(v["a"], v["b"]).alias("ab"), (F.sqrt(dot(v["a"], v["a"])) * F.sqrt(dot(v["b"], v["b"]))).alias("norm")), lambda d: F.when(d["norm"] > 0, d["ab"] / d["norm"]).otherwise(0.0)))
    return F.when(a["exact"] == b["exact"], 1.0).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


def index_of(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are at most value, less one, by binary search."""
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(held, at + s - 1) <= value), at + s).otherwise(at)) - 1


def with_next(docs: DataFrame, values: dict[str, Column], ranges: int) -> DataFrame:
    """doc_id, the values, and ``next_<value>`` from the next document by ascending doc_id (after the last: the first).

    Documents are dealt into id ranges that begin at existing ids, one window each; the document at
    the start of a range is also sent, as a ghost row, to the end of the range before it. So all
    texts are shuffled once and no window holds more than its range. Null ids come first; equal
    ids follow each other in the order of the values.
    """
    docs = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("_id"), *[v.alias(k) for k, v in values.items()])
    found = docs.select(F.percentile_approx("_id", [i / ranges for i in range(ranges)], 100 * ranges).alias("q"), F.min("_id").alias("least")).first()
    if found["least"] is None:
        return docs.select(F.col("_id").alias("doc_id"), *values, *[F.col(k).alias(f"next_{k}") for k in values])
    bounds = sorted({found["least"], *found["q"]})
    at = index_of(bounds, F.col("_id"))
    copies = F.when(F.col("_id") == F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("range") + 1), F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("ghost")), F.struct(F.pmod(F.col("range") - 1, F.lit(len(bounds))).alias("range"), F.lit(1).alias("ghost")))).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("ghost"))))
    dealt = docs.withColumn("range", at).withColumn("copy", F.explode(copies)).select("_id", *values, "copy.range", "copy.ghost")
    order = Window.partitionBy("range").orderBy("ghost", "_id", *values)
    follow = dealt.withColumn("_next", F.lead(F.struct(*values)).over(order)).where("ghost = 0")
    return follow.select(F.when(F.col("_id") != -(2**63), F.col("_id")).alias("doc_id"), *values, *[F.col("_next")[k].alias(f"next_{k}") for k in values])


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
