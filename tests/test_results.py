"""Rasters pasted at boxes, sampled to levels and stored, against loops over all target pixels."""

import random

import pytest

from histospark.sources import results

SHAPES = [("a", 0, 21, 17), ("a", 1, 11, 9), ("a", 3, 30, 5), ("b", 0, 7, 40), ("b", 1, 4, 20), ("c", 0, 3, 3)]


@pytest.fixture
def shapes(spark):
    return spark.createDataFrame(SHAPES, "uid string, level int, h long, w long")


def rows(df):
    return {tuple(r[:-1]): r[-1] for r in df.collect()}


def test_labels_at_boxes(spark, shapes):
    """Boxes that leave the slide are clipped; a slide without a box and labels outside the region have no rows."""
    rng = random.Random(1)
    labels = {(u, y, x): rng.randint(0, 2**40) * rng.randint(0, 1) for u, h, w in (("a", 5, 6), ("b", 9, 9), ("c", 2, 2)) for y in range(h) for x in range(w)}
    boxes = {"a": (5, 6, -2, 3, 30, 14), "b": (9, 9, 1, 30, 6, 38)}
    given = spark.createDataFrame([(*k, v) for k, v in labels.items()] + [("a", 99, 0, 5), ("a", None, 0, 5), ("a", 0, 0, None)], "uid string, y long, x long, label long")
    got = rows(results.pasted(given, spark.createDataFrame([(u, *b) for u, b in boxes.items()], "uid string, ph int, pw int, y0 int, x0 int, y1 int, x1 int"), shapes))
    want = {}
    for u, (ph, pw, y0, x0, y1, x1) in boxes.items():
        h, w = next((s[2], s[3]) for s in SHAPES if s[0] == u and s[1] == 0)
        y0, x0, y1, x1 = max(0, y0), max(0, x0), min(h, y1), min(w, x1)
        for y in range(y0, y1):
            for x in range(x0, x1):
                if v := labels[u, (y - y0) * ph // (y1 - y0), (x - x0) * pw // (x1 - x0)]:
                    want[u, y, x] = v
    assert got == want


def linear(at, size, to):
    f = max(0.0, min(size - 1.0, (at + 0.5) * size / to - 0.5))
    low = int(f)
    return [(low, 1 - (f - low)), (min(low + 1, size - 1), f - low)]


def test_levels_and_round_trip(spark, shapes, tmp_path):
    """Smaller, greater and equal levels; tiles that don't divide the sides; unknown values spread."""
    rng = random.Random(2)
    base = {s[0]: (s[2], s[3]) for s in SHAPES if s[1] == 0}
    labels = {(u, y, x): rng.randint(1, 9) for u in "ab" for y in range(base[u][0]) for x in range(base[u][1]) if rng.random() < 0.6}
    values = {(u, y, x): rng.random() for u in "ab" for y in range(base[u][0]) for x in range(base[u][1]) if rng.random() < 0.93}
    odd = [("a", 0, 0, None), ("a", 999, 0, 0.5)] if ("a", 0, 0) not in values else [("a", 999, 0, 0.5)]
    l = spark.createDataFrame([(*k, v) for k, v in labels.items()], "uid string, y long, x long, label long")
    v = spark.createDataFrame([(*k, v) for k, v in values.items()] + odd, "uid string, y long, x long, value double")
    want_labels, want_values = {}, {}
    for u, level, h, w in SHAPES:
        bh, bw = base[u]
        for y in range(h):
            for x in range(w):
                if (u, y * bh // h, x * bw // w) in labels:
                    want_labels[u, level, y, x] = labels[u, y * bh // h, x * bw // w]
                corners = [((u, sy, sx), wy * wx) for sy, wy in linear(y, bh, h) for sx, wx in linear(x, bw, w)]
                if all(k in values for k, _ in corners):
                    want_values[u, level, y, x] = sum(values[k] * weight for k, weight in corners)
    assert rows(results.labels_at_levels(l, shapes)) == want_labels
    got = rows(results.values_at_levels(v, shapes))
    assert got.keys() == want_values.keys() and all(abs(got[k] - want_values[k]) < 1e-9 for k in got)
    results.write_results(l, v, shapes, str(tmp_path / "r"), side=8)
    back = results.read_results(spark, str(tmp_path / "r")).collect()
    assert {tuple(r[:4]): r.label for r in back if r.label is not None} == want_labels
    assert {tuple(r[:4]) for r in back if r.portality is not None} == want_values.keys()
    tiles = spark.read.parquet(str(tmp_path / "r/mask"))
    assert tiles.count() == sum(-(-h // 8) * -(-w // 8) for _, _, h, w in SHAPES)  # slide c is all background
    assert results.read_results(spark, str(tmp_path / "r"), "b", 1).select("uid", "level").distinct().collect() == [("b", 1)]


def test_nothing_found(spark, shapes, tmp_path):
    l = spark.createDataFrame([], "uid string, y long, x long, label long")
    v = spark.createDataFrame([], "uid string, y long, x long, value double")
    results.write_results(l, v, shapes, str(tmp_path / "r"), side=8)
    assert results.read_results(spark, str(tmp_path / "r")).count() == 0


def test_a_slide_goes_out_and_comes_back(spark, tmp_path, monkeypatch):
    """A bright block is the region; what a stand-in for the segmentation finds there comes back at its place on every level."""
    from pyspark.sql import functions as F

    from histospark.plans import lobules
    from histospark.sources.pyramid import decimated

    px = [("s", c, y, x, 200 if 8 <= y < 28 and 12 <= x < 36 else 5) for c in range(2) for y in range(40) for x in range(48)]
    px += [("dark", c, y, x, 0) for c in range(2) for y in range(8) for x in range(8)]
    pyramid = decimated(spark.createDataFrame(px, "uid string, channel int, y long, x long, value long"), [0, 1])
    shapes = spark.createDataFrame([("s", 0, 40, 48), ("s", 1, 20, 24), ("dark", 0, 8, 8), ("dark", 1, 4, 4), ("none", 0, 5, 5), ("none", 1, 3, 3)], "uid string, level int, h long, w long")
    seen = {}

    def stand_in(pixels, frames, pp, pv, **options):
        seen.update({r.uid: (r.h, r.w) for r in frames.collect()})
        bright = pixels.where("value >= 100 and channel = 0")
        return bright.select("uid", "y", "x", F.lit(2**40).alias("label"), (F.col("y") / 100.0).alias("portality"))

    monkeypatch.setattr(lobules, "segmented", stand_in)
    regions = lobules.segmented_slides(pyramid, shapes, str(tmp_path / "r"), [0], [1], side=16)
    box = {(r.uid, r.level): (r.y0, r.x0, r.y1, r.x1) for r in regions.collect()}
    assert {u for u, _ in box} == {"s", "dark"} and box["dark", 0] == (0, 0, 8, 8)  # one value alone is tissue
    assert seen == {u: (box[u, 0][2] - box[u, 0][0], box[u, 0][3] - box[u, 0][1]) for u in ("s", "dark")}
    y0 = box["s", 0][0]
    back = results.read_results(spark, str(tmp_path / "r")).collect()
    inside = {(y, x) for y in range(8, 28) for x in range(12, 36) if y0 <= y < box["s", 0][2] and box["s", 0][1] <= x < box["s", 0][3]}
    assert len(inside) > 300
    assert {(r.y, r.x) for r in back if r.uid == "s" and r.level == 0 and r.label == 2**40} == inside
    assert all(abs(r.portality - (r.y - y0) / 100) < 1e-9 for r in back if r.level == 0 and r.portality is not None)
    assert {(r.y, r.x) for r in back if r.level == 1 and r.label == 2**40} == {(y // 2, x // 2) for y, x in inside if y % 2 == 0 and x % 2 == 0}
    assert {r.uid for r in spark.read.parquet(str(tmp_path / "r/mask")).select("uid").distinct().collect()} == {"s", "dark", "none"}


def test_many_small_slides_take_few_files_and_whole_labels(spark, tmp_path, monkeypatch):
    """A store doesn't grow by files with each slide, one slide is read without the others, and tiles of several batches are whole."""
    monkeypatch.setattr(results, "HELD", 300)
    many = spark.createDataFrame([(u, level, 40 >> level, 40 >> level) for u in range(30) for level in range(2)], "uid long, level int, h long, w long")
    label = 2**60 + 1  # no double holds it
    l = spark.range(30 * 1600).selectExpr("id div 1600 as uid", "id % 1600 div 40 as y", "id % 40 as x", f"{label} + id as label").where("x % 7 > 0")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        results.write_results(l, l.selectExpr("uid", "y", "x", "cast(x as double) as value"), many, str(tmp_path / "r"), side=16)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(list((tmp_path / "r/mask").rglob("*.parquet"))) <= 4
    back = results.read_results(spark, str(tmp_path / "r"))
    whole = {(r.uid, r.y, r.x): r.label for r in back.where("level = 0 and label is not null").collect()}
    assert whole == {(r.uid, r.y, r.x): r.label for r in l.collect()}
    one = results.read_results(spark, str(tmp_path / "r"), 17, 1)
    assert {(r.y, r.x, r.label) for r in one.collect()} == {(y, x, label + 17 * 1600 + 80 * y + 2 * x) for y in range(20) for x in range(20) if 2 * x % 7 > 0}
