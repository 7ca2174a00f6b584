"""Pixels of lines as words of 64: drawing, counting and widening against plain Python."""

import math

from pyspark.sql import functions as F

from histospark.operators import graph

#: Lines over the borders of words and over zero, one of a single segment, one that is drawn twice.
LINES = {1: [(-70, -3), (130, 9), (5, 5), (64, 5), (63, 5)], 2: [(0, 0), (0, 40)], 3: [(0, 0), (63, 0), (0, 0)], 4: [(128, -1), (127, -2)]}


def drawn(places):
    out = set()
    for (ax, ay), (bx, by) in zip(places, places[1:], strict=False):
        steps = max(abs(bx - ax), abs(by - ay))
        out |= {(math.floor(ay + i * (by - ay) / max(steps, 1) + 0.5), math.floor(ax + i * (bx - ax) / max(steps, 1) + 0.5)) for i in range(steps + 1)}
    return out


def segs(spark):
    rows = [(line, seq, x, y) for line, places in LINES.items() for seq, (x, y) in enumerate(places)]
    return graph.segments(spark.createDataFrame(rows, "line long, seq long, px long, py long"))


def pixels(rows):
    return {(r["line"], r["y"], r["x"]) for r in rows}


def test_rasterised_holds_words_not_pixels(spark):
    want = {(line, y, x) for line, places in LINES.items() for y, x in drawn(places)}
    got = graph.rasterised(segs(spark), ["line"]).collect()
    assert pixels(got) == want and len(got) == len(want)
    words = graph.packed(segs(spark), ["line"]).collect()
    assert {(w["line"], w["y"], w["w"]) for w in words} == {(line, y, x // 64) for line, y, x in want}
    assert len(words) == len({(line, y, x // 64) for line, y, x in want}) < len(want)


def test_widened_crosses_words(spark):
    words = graph.widened(graph.packed(segs(spark), ["line"]), ["line"])
    want = {(line, y + dy, x + dx) for line, places in LINES.items() for y, x in drawn(places) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    assert pixels(graph.unpacked(words, ["line"]).collect()) == want


def test_sizes_count_each_pixel_once(spark):
    assert {r["line"]: r["size"] for r in graph.sizes(segs(spark)).collect()} == {line: len(drawn(places)) for line, places in LINES.items()}


def test_without_parallel_stores_words(spark, monkeypatch):
    stored = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, *what: stored.append(df) or keep(df, *what))
    lines = spark.createDataFrame([(e, i, 60 * i, y) for e, y in ((1, 0), (2, 1), (3, 9)) for i in range(3)], "line long, seq long, px long, py long")
    edges = spark.createDataFrame([(1, 5, 6), (2, 5, 6), (3, 5, 6)], "eid long, u long, v long")
    assert sorted(r["eid"] for r in graph.without_parallel(edges, lines).collect()) == [1, 3]
    assert "bits" in stored[0].columns and stored[0].count() == 6
