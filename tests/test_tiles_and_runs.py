"""Stencils on packed tiles and regions on runs, against pixel stencils and floods in plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from histospark.operators import components, hist, runs, stencil, tiles
from histospark.plans import pipeline

MASKS = {3: (21, 34), 7: (9, 50), 8: (1, 1)}


@pytest.fixture(scope="module")
def drawn():
    rng = random.Random(3)
    return {uid: {(y, x) for y in range(h) for x in range(w) if rng.random() < 0.55} for uid, (h, w) in MASKS.items()}


@pytest.fixture(scope="module")
def mask(spark, drawn):
    return spark.createDataFrame([(u, y, x) for u, on in drawn.items() for y, x in on], "uid long, y long, x long")


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(u, h, w) for u, (h, w) in MASKS.items()], "uid long, h long, w long")


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def flooded(on, eight):
    moves, label = stencil.RING if eight else stencil.CROSS, {}
    for p in sorted(on):
        if p not in label:
            label[p], todo = p[0] * runs.WIDE + p[1], [p]
            while todo:
                y, x = todo.pop()
                for q in ((y + dy, x + dx) for dy, dx in moves):
                    if q in on and q not in label:
                        label[q] = label[p]
                        todo.append(q)
    return label


@pytest.mark.parametrize("side", [8, 16, 64])
def test_tile_stencils_equal_pixel_stencils_at_any_side(spark, mask, side):
    gray = mask.withColumn("value", (F.col("y") * 7 + F.col("x") * 13) % 50)
    values, on = tiles.packed(gray, ["uid"], side), tiles.packed(mask, ["uid"], side, None)
    assert rows(tiles.unpacked(values)) == rows(gray.withColumn("value", F.col("value").cast("double")))
    assert rows(tiles.unpacked(tiles.blurred(values, 1.5))) == rows(stencil.gaussian_blur(gray, ["uid"], 1.5).select("uid", "y", "x", "value"))
    assert rows(tiles.unpacked(tiles.medians(values, 5))) == rows(stencil.median_blur(gray, ["uid"], 5).select("uid", "y", "x", "value"))
    assert rows(tiles.unpacked(tiles.dilated(on, 3))) == rows(stencil.dilated(mask, ["uid"], 3))
    assert rows(tiles.unpacked(tiles.eroded(on, 1))) == rows(stencil.eroded(mask, ["uid"], 1))


def test_tile_thinning_equals_pixel_thinning(spark, mask):
    solid = stencil.dilated(mask, ["uid"], 2)
    thin = tiles.thinned(tiles.packed(solid, ["uid"], 16, None), per_round=2)
    assert rows(tiles.unpacked(thin)) == rows(stencil.thinned(solid, ["uid"]))


def test_only_strips_are_shuffled(spark):
    """A blur of radius 3 over tiles of 64 x 64: one exchange, above the strips, whose bytes are a fifth of the image's."""
    gray = spark.range(256 * 256).select(F.lit(1).alias("uid"), F.expr("id div 256").alias("y"), (F.col("id") % 256).alias("x"), (F.col("id") % 17).alias("value"))
    packed = tiles.packed(gray, ["uid"], 64)
    plan = tiles.haloed(packed, 3, False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    above, below = plan.split("Exchange")
    assert "MapInArrow" in below and "MapInArrow" not in above  # the exchange stands over what cuts the strips
    image = packed.frame.agg(F.sum(F.octet_length("data"))).first()[0]
    strips = tiles.strips_of(packed, 3).select(F.explode("strips").alias("s")).agg(F.sum(F.octet_length("s.strip"))).first()[0]
    # each of 16 tiles sends four sides of 64 x 3 pixels and four corners of 3 x 3
    assert image == 8 * 256 * 256 and strips == 8 * 16 * (4 * 64 * 3 + 4 * 9)


def test_tile_tables_can_be_dropped_and_be_empty(spark, mask):
    none = tiles.packed(mask.where("false"), ["uid"], 16, None)
    assert tiles.unpacked(tiles.closed(none, 2)).count() == 0 and tiles.unpacked(tiles.thinned(none)).count() == 0
    none.drop()
    assert not spark.catalog.tableExists(none.name)


def test_runs_there_and_back(spark, mask):
    found = runs.runs_of(mask.union(mask))
    assert rows(runs.pixels_of(found).select("uid", "y", "x")) == rows(mask)
    cut = tiles.packed_runs(found, ["uid"], 8)
    assert rows(tiles.unpacked(cut)) == rows(mask)
    assert rows(runs.joined_runs(tiles.runs_in(cut))) == rows(found.select("uid", "y", "x0", "x1"))


@pytest.mark.parametrize("eight", [False, True])
@pytest.mark.parametrize("tile", [4, 16, 1024])
def test_labels_equal_a_flood_at_any_tile(spark, mask, drawn, eight, tile):
    got = runs.pixels_of(runs.labelled(runs.runs_of(mask), "uid", eight, tile))
    want = sorted((u, y, x, n) for u, on in drawn.items() for (y, x), n in flooded(on, eight).items())
    assert sorted((r.uid, r.y, r.x, r.label) for r in got.collect()) == want


def test_holes_and_border_in_frames_of_different_size(spark, mask, drawn, frames):
    want_holes, want_edge, want_gaps = [], [], []
    for u, on in drawn.items():
        h, w = MASKS[u]
        edge = lambda p: p[0] in (0, h - 1) or p[1] in (0, w - 1)  # noqa: B023, E731
        off = flooded({(y, x) for y in range(h) for x in range(w)} - on, False)
        open_ = {n for p, n in off.items() if edge(p)}
        want_gaps += [(u, *p) for p in off]
        want_holes += [(u, *p, n) for p, n in off.items() if n not in open_]
        own = flooded(on, False)
        meets = {n for p, n in own.items() if edge(p)}
        want_edge += [(u, *p, n) for p, n in own.items() if n in meets]
    found = runs.runs_of(mask)
    pick = lambda df: sorted((r.uid, r.y, r.x, r.label) for r in runs.pixels_of(df).collect())
    assert rows(runs.pixels_of(runs.gaps(found, frames)).select("uid", "y", "x")) == sorted(want_gaps)
    assert pick(runs.holes(found, frames)) == sorted(want_holes)
    assert pick(runs.border_connected(found, frames)) == sorted(want_edge)
    sizes = {(u, n): sum(k[0] == u and k[3] == n for k in want_holes) for u, *_, n in want_holes}
    small = sorted((u, y, x) for u, y, x, n in want_holes if sizes[u, n] < 3)
    assert rows(runs.pixels_of(runs.without_small_holes(found, 3, frames)).select("uid", "y", "x")) == sorted(rows(mask) + small)


def test_a_frame_without_runs_is_background_all_over(spark, mask):
    frame = spark.createDataFrame([(99, 3, 5)], "uid long, h long, w long")
    assert rows(runs.gaps(runs.runs_of(mask.where("false")), frame)) == [(99, y, 0, 4) for y in range(3)]
    assert runs.holes(runs.runs_of(mask.where("false")), frame).count() == 0
    outside = runs.runs_of(spark.createDataFrame([(99, y, x) for y in (-1, 1, 3) for x in range(-2, 9)], "uid long, y long, x long"))
    assert rows(runs.clipped(outside, frame).select("uid", "y", "x0", "x1")) == [(99, 1, 0, 4)]


def test_string_keys(spark):
    ring = [("slide/é", y, x) for y in range(4) for x in range(5) if y in (0, 3) or x in (0, 4)]
    df = spark.createDataFrame(ring, "uid string, y long, x long")
    assert {(r.uid, r.y, r.x) for r in components.holes(df, (4, 5)).collect()} == {("slide/é", y, x) for y in (1, 2) for x in (1, 2, 3)}


def test_otsu_of_ten_billion_pixels(spark):
    counts = [(1, v, 10**10 if v < 100 else 10**9) for v in [*range(20, 60), *range(180, 220)]]
    big = spark.createDataFrame(counts, "uid int, value long, n long")
    low = spark.createDataFrame([(u, v, n // 10**9) for u, v, n in counts], "uid int, value long, n long")
    assert hist.otsu_of(big, ["uid"], "value").collect() == hist.otsu_of(low, ["uid"], "value").collect()
    assert hist.otsu_of(big, ["uid"], "value").first().threshold == 59


def blob(h, w, box, low, high):
    return [(y, x, high if box[0] <= y < box[2] and box[1] <= x < box[3] else low) for y in range(h) for x in range(w)]


def test_tissue_of_slides_of_different_size_and_without_tissue(spark):
    rng = np.random.default_rng(5)
    gray = [(1, *p) for p in blob(40, 60, (10, 15, 30, 40), 10, 200)] + [(2, *p) for p in blob(300, 260, (50, 60, 200, 160), 20, 180)] + [(3, y, x, 7) for y in range(30) for x in range(30)]
    df = spark.createDataFrame([(u, y, x, int(v + rng.integers(0, 3))) if u != 3 else (u, y, x, v) for u, y, x, v in gray], "uid long, y long, x long, value long")
    sizes = spark.createDataFrame([(1, 40, 60), (2, 300, 260), (3, 30, 30)], "uid long, h long, w long")
    for classes in (2, 3):
        boxes = {r.uid: (r.y0, r.x0, r.y1, r.x1) for r in pipeline.region_of_interest(df, sizes, classes=classes).collect()}
        assert boxes[1] == (10, 15, 30, 40) and boxes[2] == (50, 60, 200, 160)


def test_regions_and_crops_of_all_levels(spark):
    levels = []
    for level, scale in ((1, 2), (3, 8)):
        h, w = 160 // scale, 240 // scale
        levels += [(5, level, y, x, v) for y, x, v in blob(h, w, (40 // scale, 80 // scale, 120 // scale, 200 // scale), 5, 210)]
    pyramid = spark.createDataFrame(levels, "uid long, level long, y long, x long, value long")
    shapes = pyramid.groupBy("uid", "level").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    found = pipeline.regions_of_levels(pyramid, shapes)
    assert rows(found) == [(5, 1, 20, 40, 60, 100), (5, 3, 5, 10, 15, 25)]
    crop = pipeline.cropped_levels(pyramid, found)
    assert {(r.level, r.n, r.low) for r in crop.groupBy("level").agg(F.count("*").alias("n"), F.min("value").alias("low")).collect()} == {(1, 2400, 210), (3, 150, 210)}


def test_workers_get_few_tiles_at_once(spark):
    slides = spark.range(40).selectExpr("id as uid", "0L as y", "0L as x", "1L as value")
    spark.conf.unset(tiles.BATCH_CONF)
    packed = tiles.packed(slides, ["uid"])

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    most = packed.frame.coalesce(1).select("data").mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    assert most <= tiles.BATCH_BYTES + 8 * tiles.SIDE**2 + 4096
    packed.drop()
