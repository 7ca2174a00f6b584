"""Bridges by Euler tours and shortest paths by buckets, against plain loops; rounds are counted."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from histospark.operators import graph, tours


def brute_bridges(edges):
    def parts(es):
        up = {n: n for e in edges for n in e}

        def root(n):
            while up[n] != n:
                n = up[n]
            return n

        for a, b in es:
            up[root(a)] = root(b)
        return len({root(n) for n in up})

    return {tuple(sorted(e)) for i, e in enumerate(edges) if e[0] != e[1] and parts(edges[:i] + edges[i + 1 :]) > parts(edges)}


def brute_paths(edges, source):
    near = {}
    for u, v, length in edges:
        near.setdefault(u, []).append((v, length))
        near.setdefault(v, []).append((u, length))
    dist, heap = {}, [(0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in dist:
            dist[n] = d
            for m, length in near.get(n, []):
                heapq.heappush(heap, (d + length, m))
    return {n: (d, min((m for m, length in near.get(n, []) if dist[m] + length == d), default=None) if n != source else None) for n, d in dist.items()}


def test_bridges_equal_brute_force(spark):
    rng = random.Random(8)
    edges = [tuple(rng.sample(range(30), 2)) for _ in range(34)] + [(40, 40), (40, 41), (50, 51), (51, 50), (60, 61), (61, 62)]
    got = tours.bridges(spark.createDataFrame([*edges, (70, None)], "u long, v long")).collect()
    assert {(r.u, r.v) for r in got} == brute_bridges(edges) and len(got) == len(set(got))


def test_a_hub_with_bridges_and_rings(spark):
    """Arcs of one node span several tasks of the sort."""
    edges = [(0, n) for n in range(1, 400)] + [(n, n + 1) for n in range(1, 200, 2)]
    got = {(r.u, r.v) for r in tours.bridges(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(0, n) for n in range(201, 400)}


def test_bridges_without_edges(spark):
    assert tours.bridges(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A path with a ring at its end: 2,000 edges take 12 rounds of jumps."""
    rounds, plain = [], tours.written
    monkeypatch.setattr(tours, "written", lambda df, what="step": (rounds.append(what), plain(df, what))[1])
    path = spark.range(2000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    ring = spark.createDataFrame([(2000, 2001), (2001, 2002), (2000, 2002)], "u long, v long")
    assert tours.bridges(path.union(ring)).count() == 2000
    assert rounds.count("jumps") <= 14


@pytest.mark.parametrize("width", [None, 1, 5, 1000])
def test_shortest_paths_equal_a_heap(spark, width):
    rng = random.Random(4)
    edges = [(*rng.sample(range(40), 2), rng.randint(1, 9)) for _ in range(60)] + [(100, 101, 3)]
    sources = [0, 7, 100, 999]
    got = graph.shortest_paths(spark.createDataFrame(edges, "u long, v long, length long"), spark.createDataFrame([(s,) for s in sources], "source long"), width).collect()
    want = {(s, n): w for s in sources for n, w in brute_paths(edges, s).items()}
    assert {(r.source, r.node): (r.dist, r.pred) for r in got} == want and len(got) == len(want)


def test_settled_rows_are_written_once(spark, monkeypatch):
    """A line of 60 edges from its end: the rows written to buckets and waiting grow with the line, not with its square."""
    rows, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, what="step": (out := plain(df, what), rows.append((what, out.count())))[0])
    line = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1).cast("long").alias("length"))
    got = graph.shortest_paths(line, spark.createDataFrame([(0,)], "source long"), 6)
    assert got.agg(F.max("dist")).first()[0] == 60 and got.count() == 61
    assert sum(n for what, n in rows if what in ("bucket", "waiting")) < 61 * 8


def test_shortest_paths_without_rows(spark):
    edges, sources = spark.createDataFrame([], "u long, v long, length long"), spark.createDataFrame([], "source long")
    assert graph.shortest_paths(edges, sources).count() == 0
    assert graph.shortest_paths(edges, spark.createDataFrame([(1,)], "source long")).count() == 1


@pytest.mark.parametrize("bits", [0, 3])
def test_bridges_with_small_blocks_or_none(spark, bits):
    rng = random.Random(bits)
    edges = [(a, b) for a, b in ((rng.randint(-10, 40), rng.randint(-10, 40)) for _ in range(55)) if a != b] + [(1, 2), (2, 1)]
    got = {(r.u, r.v) for r in tours.bridges(spark.createDataFrame(edges, "u long, v long"), bits).collect()}
    assert got == brute_bridges(edges) and got


def test_cycles_of_a_block_are_gone_before_the_rounds(spark, monkeypatch):
    grid = [(10 * y + x, 10 * y + x + d) for y in range(9) for x in range(9) for d in (1, 10) if (x if d == 1 else y) < 8]
    sizes = []
    keep = tours.spanning_tree
    monkeypatch.setattr(tours, "spanning_tree", lambda e: sizes.append(e.count()) or keep(e))
    edges = spark.createDataFrame([*grid, (0, 500), (500, 5000)], "u long, v long")
    assert {(r.u, r.v) for r in tours.bridges(edges).collect()} == {(0, 500), (500, 5000)} and sizes == [2]
