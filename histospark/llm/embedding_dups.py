"""Near-duplicate vectors by collision counting over many one-dimensional projections.

Every unit vector is projected on random directions. Groups of directions, the stripes, deal the
vectors out: all but the last direction of a stripe give a grid cell, in which vectors are sorted by
the last. A window centred on each vector of the sorted run gathers its pairs; for each pair, the
directions (of all stripes) on which the two lie within the window are counted, and pairs that reach
a count calibrated for recall at the threshold are verified by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histospark.llm.common import removed, written
from histospark.operators.iterate import connected_components

#: Vectors that a cell holds on average; probability that a pair at the threshold meets in a stripe.
OCCUPANCY, RECALL = 512, 0.99
#: Chance that two unrelated unit vectors share an interval of a direction (intervals of 4 deviations).
UNRELATED = 0.4
#: Directions on which collisions are counted, and the bytes that the counting window spans.
COUNTED, SPAN = 48, 8
#: Share of the pairs at the threshold that may fall short of the collision count.
MISSED = 1e-4


class Plan:
    """Directions, cells, window and count for vectors of a given number, size and least cosine."""

    def __init__(self, n: int, cosine: float, kind: str = "<f8", seed: int = 7):
        self.cosine, self.kind, self.seed, self.held = cosine, np.dtype(kind), seed, {}
        self.deviation = sqrt(2 - 2 * cosine)  # of the difference of two projections at the threshold
        self.width, self.window = 4 * self.deviation, 3 * self.deviation
        same = 1 - 0.8 / 4  # that both lie in one interval: 1 - E|difference| / width
        self.cells = max(1, ceil(log(max(2.0, n / OCCUPANCY)) / -log(UNRELATED)))
        self.stripes = ceil(log(1 - RECALL) / log(1 - same**self.cells * 0.997))
        self.directions = self.stripes * (self.cells + 1)
        self.counted = max(1, min(COUNTED, self.directions))
        self.near = 1.5 * self.deviation
        met = 0.8664  # a normal deviate within 1.5 deviations
        short, least = 0.0, 0
        for k in range(self.counted + 1):
            short += comb(self.counted, k) * met**k * (1 - met) ** (self.counted - k)
            if short > MISSED:
                least = k
                break
        self.least = least

    def matrix(self, size: int) -> np.ndarray:
        if size not in self.held:
            self.held[size] = np.random.default_rng([self.seed, size]).standard_normal((size, max(self.directions, self.counted)))
        return self.held[size]

    def offsets(self) -> np.ndarray:
        if 0 not in self.held:
            self.held[0] = np.random.default_rng([self.seed, 0]).uniform(0, self.width, (self.stripes, self.cells))
        return self.held[0]

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """The counted projections as bytes, of which SPAN make up the window."""
        return np.clip(np.rint(unit @ self.matrix(unit.shape[1])[:, : self.counted] * (SPAN / self.near)), -120, 120).astype(np.int8)


def unit_rows(raw: list[bytes], kind: np.dtype) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors of that length, and their unit vectors in double precision."""
    found: dict[int, list[int]] = {}
    for i, r in enumerate(raw):
        found.setdefault(len(r) // kind.itemsize, []).append(i)
    out = {}
    for size, of in found.items():
        v = np.frombuffer(b"".join([raw[i] for i in of]), dtype=kind).reshape(len(of), size).astype(np.float64)
        v = v / np.abs(v).max(axis=1, keepdims=True)  # neither over- nor underflows
        out[size] = (np.array(of), v / np.sqrt((v * v).sum(axis=1, keepdims=True)))
    return out


def component_kind(vectors: DataFrame) -> tuple[str, str]:
    """Single precision stays as it is; any other type of component becomes double."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    return ("<f4", "array<float>") if single else ("<f8", "array<double>")


def normalised(vectors: DataFrame) -> DataFrame:
    """vec_id, and for vectors that can link: their components as floats (raw) and a name of them (vec_key)."""
    kind, cast = component_kind(vectors)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, keys = [], []
            for v in batch.column(1).to_pylist():
                a = None if v is None or None in v else np.array(v, dtype=kind)
                good = a is not None and a.size and np.isfinite(a).all() and a.any()
                raw.append((a + 0.0).tobytes() if good else None)
                keys.append(xxhash.xxh3_128_digest(raw[-1]) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "raw", "vec_key"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(cast)).mapInArrow(read, "vec_id long, raw binary, vec_key binary")


def dealt(nodes: DataFrame, plan: Plan) -> DataFrame:
    """node, raw, the cell of each stripe (hashed) and the place in it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            cells = np.zeros((len(raw), plan.stripes), dtype=np.int64)
            places = np.zeros((len(raw), plan.stripes))
            for size, (of, unit) in unit_rows(raw, plan.kind).items():
                on = (unit @ plan.matrix(size)[:, : plan.directions]).reshape(len(of), plan.stripes, plan.cells + 1)
                key = np.full((len(of), plan.stripes), size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(plan.stripes, dtype=np.uint64)
                for j in range(plan.cells):
                    at = np.floor((on[:, :, j] + plan.offsets()[:, j]) / plan.width).astype(np.int64).view(np.uint64)
                    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + at
                    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
                cells[of], places[of] = key.view(np.int64), on[:, :, plan.cells]
            for s in range(plan.stripes):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells[:, s]), pa.array(places[:, s])], ["node", "raw", "cell", "place"])

    return nodes.mapInArrow(deal, "node long, raw binary, cell long, place double")


def pairs_in_run(ids: np.ndarray, places: np.ndarray, unit: np.ndarray, on: np.ndarray, plan: Plan, own: int, block: int = 1 << 17) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between the first ``own`` vectors of a sorted run and those after them in their windows."""
    ends = np.searchsorted(places, places[:own] + plan.window, side="right")
    found, i = [], 0
    while i < own:
        stop, total = i, 0
        while stop < own and (stop == i or total + ends[stop] - stop <= block):
            total += ends[stop] - stop
            stop += 1
        many = ends[i:stop] - np.arange(i, stop) - 1
        a = np.repeat(np.arange(i, stop), many)
        b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + a + 1
        # rounding moves a difference by one at most, and clipping only brings places closer
        met = (np.abs(on[a].astype(np.int16) - on[b]) <= SPAN + 1).sum(axis=1)
        a, b = a[met >= plan.least], b[met >= plan.least]
        true = np.einsum("ij,ij->i", unit[a], unit[b]) >= plan.cosine
        found.append((ids[a[true]], ids[b[true]]))
        i = stop
    return found


def linked(cells: DataFrame, plan: Plan, held: int = 4096) -> DataFrame:
    """Links (a, b) of vectors in one cell. A task streams its sorted cells; it holds a window of a long one."""

    def flush(cell: list, size: int, last: bool) -> tuple[list, list]:
        ids, places, raw = (np.concatenate([c[k] for c in cell]) if k < 2 else [r for c in cell for r in c[2]] for k in range(3))
        own = len(ids) if last else int(np.searchsorted(places, places[-1] - plan.window, side="left"))
        found = []
        if own and len(ids) > 1:
            for _, (of, unit) in unit_rows(raw, plan.kind).items():  # one length only, but for hash collisions
                found += pairs_in_run(ids[of], places[of], unit, plan.sketch(unit), plan, int((of < own).sum()))
        return found, [(ids[own:], places[own:], raw[own:])]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, key, size, limit = [], None, 0, held
        for batch in batches:
            cells_at = batch.column(2).to_numpy()
            ids, places, raw = batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(1).to_pylist()
            cuts = [0, *(np.nonzero(np.diff(cells_at))[0] + 1).tolist(), len(ids)]
            found = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if cells_at[lo] != key:
                    if size > 1:
                        found += flush(cell, size, True)[0]
                    cell, key, size, limit = [], cells_at[lo], 0, held
                for k in range(lo, hi, held):
                    cell.append((ids[k : min(hi, k + held)], places[k : min(hi, k + held)], raw[k : min(hi, k + held)]))
                    size += len(cell[-1][0])
                    if size >= limit:
                        more, cell = flush(cell, size, False)
                        size = len(cell[0][0])
                        limit, found = max(held, 2 * size), found + more
            if found:
                yield as_batch(found)
        if size > 1:
            yield as_batch(flush(cell, size, True)[0])

    def as_batch(found: list) -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, dtype=np.int64)
        b = np.concatenate([x for _, x in found]) if found else np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return cells.mapInArrow(stream, "a long, b long")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors linked where their cosine is at least ``cosine``.

    Equal vectors become one node (its links count for each copy). Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing and are kept; vectors of unequal
    length don't link. Ids should be unique; rows without an id have no component and are kept.
    """
    rows = written(normalised(vectors), "vectors")
    good = rows.where("vec_key is not null and vec_id is not null")
    copies = written(good.groupBy("vec_key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "copies")
    nodes = good.join(copies.select("vec_key", F.col("node").alias("vec_id")), ["vec_key", "vec_id"]).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("node"), "raw")
    plan = Plan(copies.count(), cosine, component_kind(vectors)[0])
    cells = dealt(nodes, plan).repartition("cell").sortWithinPartitions("cell", "place")
    links = written(linked(cells, plan).distinct(), "links")
    found = connected_components(links)
    both = links.union(links.select("b", "a"))
    degree = both.join(copies.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    named = copies.join(degree, "node", "left").join(found, "node", "left")
    named = named.select("vec_key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    out = rows.select("vec_id", "vec_key").join(named, "vec_key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
