"""Near-duplicate documents by min-max hashing of word shingles.

Each of ``PERMUTATIONS`` hash functions gives a document two values, the least and the greatest over
its shingles: both agree between two documents with the probability of their Jaccard similarity, so
80 evaluations a shingle fill a signature of 160 values. Bands of five values are bucketed; a pair
of similarity 0.8 meets in no bucket with a probability of 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histospark.llm.common import removed, written
from histospark.operators.iterate import connected_components

PERMUTATIONS, ROWS = 80, 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Longs in the bitmap of a member's differences.
WORDS = 8
FACTORS = np.random.default_rng(20240601).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers."""
    h = (h ^ (h >> np.uint64(31))) * MIX[3]
    h = (h ^ (h >> np.uint64(29))) * MIX[0]
    return h ^ (h >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words between U+0020 and U+0009 to U+000D, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of runs of k words; of all words where there are fewer."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(k, len(words))
    acc = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        acc = mixed(acc * MIX[1] + h[j : len(words) - size + 1 + j])
    return np.unique(acc)


def bands(hashes: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """One 64-bit key for each band of the min-max signature."""
    low = np.full(PERMUTATIONS, 2**64 - 1, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for k in range(0, len(hashes), chunk):
        values = FACTORS[:, None] * hashes[k : k + chunk]
        low, high = np.minimum(low, values.min(axis=1)), np.maximum(high, values.max(axis=1))
    signature = np.concatenate([low, high]).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mixed(key * MIX[2] + signature[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (names the shingle set), bands (null without shingles)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, k) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "bands": [bands(s) if len(s) else None for s in sets],
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["doc_id"], "shingles": [shingles(t, k).view(np.int64) for t in batch["text"]]})

    return docs.mapInPandas(sets, "node long, shingles array<long>")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where 100 * |A and B| >= percent * |A or B|.

    Copies (equal shingle sets) become one node, named by their least id. Nodes that share a bucket
    are candidates. So that a bucket of many near copies doesn't emit all its pairs, each member is
    first compared with the bucket's hub, the node that meets most others. Then members that are
    still in different components are compared by what each differs in from the hub
    (``by_differences``), whatever the bucket's size. No link between different components is lost.
    Links are confirmed on full sets of 64-bit shingle hashes.

    Null and empty texts have no shingles and link with nothing; fewer words than k are one shingle.
    Ids should be unique: rows that repeat an id with the same text share its result; rows without
    an id have no component and are kept.
    """
    spark = docs.sparkSession
    signed = written(signatures(docs, k), "signatures")
    rows = signed.where("doc_id is not null and n_shingles > 0")
    copies = written(rows.groupBy("set_key").agg(F.min("doc_id").alias("node")), "copies")
    nodes = written(rows.join(copies.select("set_key", F.col("node").alias("doc_id")), ["set_key", "doc_id"]).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands"), "nodes")
    dealt = nodes.select(F.explode("bands").alias("bucket"), "node", "n").distinct()
    shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = written(dealt.join(shared, "bucket"), "members")
    weights = met.groupBy("node").agg(F.sum("size").alias("weight"))
    hub = F.max(F.struct("weight", (-F.col("node")).alias("minus"), F.col("n").alias("hub_n")))
    hubs = met.join(weights, "node").groupBy("bucket").agg(hub.alias("h")).select("bucket", (-F.col("h.minus")).alias("hub"), "h.hub_n")
    members = written(met.join(hubs, "bucket"), "members")
    alike = lambda n, m: F.least(n, m) * 100 >= F.greatest(n, m) * percent  # noqa: E731  else the sizes alone rule a link out
    first = written(members.where((F.col("node") != F.col("hub")) & alike(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(met.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = written(shingle_sets(texts, k).dropDuplicates(["node"]), "sets")
    links = written(confirmed(first, sets, percent), "links")
    found = connected_components(links)
    placed = members.where("size > 2").join(found, "node", "left").select("bucket", "node", "hub", F.coalesce("component", "node").alias("component"))
    mixed_up = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    rest = written(placed.join(mixed_up, "bucket", "left_semi").select("hub", "node", "component").distinct(), "rest")
    ordered = rare_first(sets, rest.select("node").union(rest.select("hub")).distinct())
    pairs = written(by_differences(rest, ordered, percent).distinct(), "pairs")
    second = written(confirmed(pairs, sets, percent), "links")
    found = connected_components(links.union(second))
    named = copies.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    removed(spark, nodes, met, members, first, sets, rest, ordered, links, pairs, second)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def rare_first(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of the given nodes, each with the shingles that fewest of these nodes hold first."""
    each = written(sets.join(nodes, "node").select("node", F.explode("shingles").alias("e")), "elements")
    held = each.groupBy("e").agg(F.count(F.lit(1)).alias("held"))
    order = F.sort_array(F.collect_list(F.struct("held", "e")))
    return written(each.join(held, "e").groupBy("node").agg(F.transform(order, lambda x: x["e"]).alias("shingles")), "ordered")


def by_differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members(hub, node, component) of one hub and different components that may be linked.

    A member is what it lacks of the hub's set, A, and what it has beyond it, B; its differences D are
    both. For members x and m, |x and m| = |hub| - |Ax| - |Am| + s, where s counts the differences
    they share, so a link needs an s that sizes alone give. As one of them, x, isn't linked with the
    hub (else both would be in its component), s must exceed 100 / (100 + percent) * |Am| +
    percent / (100 + percent) * |Bm|; and whatever m is, (100 + percent) * s must reach
    100 * |Ax| + percent * |Bx| - (100 - percent) * |hub|. So x and m share one of x's first
    differences, all but so many, and of m's first, all but so many, in any order that all members
    keep: what is beyond the hub's set comes first, the rarest ahead, then what is lacking, what
    most members hold ahead, as few lack it. Members are joined on these. Bitmaps of the differences
    bound s from above.
    """
    own = members.where("hub <> node").join(sets.toDF("node", "own"), "node").join(sets.toDF("hub", "base"), "hub")
    lacks, beyond = F.array_except(F.reverse("base"), "own"), F.array_except("own", "base")
    told = own.select("hub", "node", "component", F.size("own").alias("n"), F.size("base").alias("base_n"), lacks.alias("lacks"), beyond.alias("beyond"))
    bits = [F.aggregate(F.filter(F.concat("beyond", "lacks"), lambda e: F.pmod(e, F.lit(WORDS)) == w), F.lit(0).cast("long"), lambda acc, e: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", e, F.lit(8)).bitwiseAND(F.lit(63)).cast("int")))).alias(f"w{w}") for w in range(WORDS)]
    told = written(told.select("*", *bits).select("hub", "node", "component", "n", "base_n", F.size("lacks").alias("na"), F.size("beyond").alias("nb"), F.concat("beyond", "lacks").alias("d"), *[f"w{w}" for w in range(WORDS)]), "differences")
    linked = (F.col("base_n") - F.col("na")) * 100 >= (F.col("n") + F.col("na")) * percent
    weight = F.col("na") * 100 + F.col("nb") * percent
    some = F.floor(weight / (100 + percent)).cast("int")
    need = F.greatest(F.lit(1), F.ceil((weight - F.col("base_n") * (100 - percent)) / (100 + percent))).cast("int")
    spread = lambda t, d: t.select("hub", F.explode(d).alias("e"), *[F.col(c) for c in ("node", "component", "n", "base_n", "na", "nb")], *[f"w{w}" for w in range(WORDS)])
    x = spread(told.where(~linked), F.slice("d", 1, F.size("d") - need + 1))
    m = spread(told, F.slice("d", 1, F.size("d") - some)).withColumnsRenamed({c: f"m_{c}" for c in ("node", "component", "n", "base_n", "na", "nb", *[f"w{w}" for w in range(WORDS)])})
    both = sum(F.bit_count(F.col(f"w{w}").bitwiseAND(F.col(f"m_w{w}"))) for w in range(WORDS))
    kept = sum(F.bit_count(F.col(f"m_w{w}")) for w in range(WORDS))
    least = F.least(F.least("na", "m_na") + F.least("nb", "m_nb"), both + F.col("m_na") + F.col("m_nb") - kept)
    enough = (F.col("base_n") - F.col("na") - F.col("m_na") + least) * (100 + percent) >= (F.col("n") + F.col("m_n")) * percent
    pairs = x.join(m, ["hub", "e"]).where((F.col("component") != F.col("m_component")) & enough)
    return pairs.select(F.least("node", "m_node").alias("a"), F.greatest("node", "m_node").alias("b"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    with_b = pairs.join(sets.toDF("b", "set_b"), "b")
    both = with_b.join(sets.toDF("a", "set_a"), "a")
    shared = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("i"), (F.size("set_a") + F.size("set_b")).alias("s"))
    return shared.where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("a", "b")
