"""Checks, defaults and gates that the registered queries don't reach."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from histospark.operators import features, graph, network, pixels, runs, stain, stats
from histospark.operators.iterate import written
from histospark.plans import catalog, pipeline
from histospark.sources import catalog as catalogs
from histospark.sources import pyramid


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_exactly_three_channels(spark):
    px = spark.createDataFrame([(1, c, 0, 0, c * 10) for c in range(4)] + [(2, c, 0, 0, c) for c in range(2)], "uid long, channel long, y long, x long, value long")
    assert rows(pixels.three_channels(px.where("uid = 1"), [3, 0, 1], ["uid"]).select("uid", "c3", "c0", "c1")) == [(1, 30, 0, 10)]
    with pytest.raises(ValueError):
        pixels.three_channels(px, [0, 1], ["uid"])
    with pytest.raises(ValueError):
        pixels.three_channels(px, [0, 1, 2], ["uid"])


def test_dropped_channels_and_roles(spark):
    kept = spark.createDataFrame([(0, 0.9, 0), (2, 0.8, 1), (5, 0.7, 2)], "channel long, share double, new_channel long")
    assert pixels.kept_roles(kept, {"pp": [0, 1], "pv": [5, 2]}) == {"pp": [0], "pv": [2, 1]}
    assert pixels.kept_roles(kept, {"pp": [1], "pv": [5]}) == {"pp": [], "pv": [2]}
    with pytest.raises(ValueError):
        pixels.kept_roles(kept, {"pp": [1], "pv": [3]})


def test_shapes_of_one_slide_agree(spark):
    same = spark.createDataFrame([(1, i, y, x) for i in range(2) for y in range(2) for x in range(3)], "uid long, image long, y long, x long")
    assert stats.checked_shapes(same, ["uid"]).count() == 12
    with pytest.raises(ValueError):
        stats.checked_shapes(same.union(spark.createDataFrame([(1, 1, 5, 0)], same.schema)), ["uid"])


def test_custom_stain_matrices():
    assert stain.custom_profile([[1, 4], [2, 5], [3, 6]]) == {"Stain0": (1.0, 2.0, 3.0), "Stain1": (4.0, 5.0, 6.0)}
    for wrong in ([[1, 2], [3, 4]], [[1], [2], [3]], [[1, 2], [3], [4, 5]], [[1, 2, 3, 4]] * 3):
        with pytest.raises(ValueError):
            stain.custom_profile(wrong)


def test_pyramids_of_unlike_levels_are_refused(spark):
    schema = "uid long, level int, channel int, dtype string, layout string, data array<float>"
    tile = lambda level, channel=0, dtype="uint8", layout="YX", data=(1.0,): (1, level, channel, dtype, layout, list(data))
    good = spark.createDataFrame([tile(0), tile(1)], schema)
    assert pyramid.validated(good).count() == 2
    for bad in (tile(1, dtype="uint16"), tile(1, layout="YXC"), tile(1, channel=1), tile(1, data=()), (1, None, 0, "uint8", "YX", [1.0])):
        with pytest.raises(ValueError):
            pyramid.validated(spark.createDataFrame([tile(0), bad], schema))


def test_levels_default_to_zero_and_shapes_come_from_tiles(spark):
    levels = spark.createDataFrame([(1, 2), (1, 0), (2, None)], "uid long, level int")
    assert rows(pyramid.levels_of(levels)) == [(1, [0, 2]), (2, [0])]
    tiles = pyramid.tiled(spark.createDataFrame([(1, 0, y, x, 1.0) for y in range(5) for x in range(7)], "uid long, level int, y long, x long, value double"), ["uid", "level"], 4)
    assert rows(pyramid.tile_shapes(tiles)) == [(1, 0, 5, 7)]


def test_bilinear_sampling_spreads_what_is_absent(spark):
    px = spark.createDataFrame([(1, y, x, float(y)) for y in range(4) for x in range(4) if (y, x) != (0, 0)], "uid long, y long, x long, value double")
    got = {(r.y, r.x): r.value for r in pyramid.bilinear_resampled(px, ["uid"], 4, 4, 2, 2).collect()}
    assert got == {(0, 0): None, (0, 1): 0.5, (1, 0): 2.5, (1, 1): 2.5}


def test_a_frame_stands_in_for_absent_tissue(spark):
    ring = spark.createDataFrame([(1, y, x) for y in range(1, 4) for x in range(1, 4) if (y, x) != (2, 2)] + [(1, 5, 5)], "uid long, y long, x long")
    frames = spark.createDataFrame([(1, 6, 6), (2, 2, 3)], "uid long, h long, w long")
    got = rows(runs.largest_or_frame(runs.runs_of(ring), frames))
    assert got == [(1, 1, 1, 3), (1, 2, 1, 3), (1, 3, 1, 3), (2, 0, 0, 2), (2, 1, 0, 2)]


def test_junctions_by_ends_or_directions(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (5, 5), (6, 7)], "u long, v long")
    arms = spark.createDataFrame([(5, 3), (6, 1)], "node long, arms long")
    assert {r.node for r in graph.junctions_of(edges, arms).where("junction").collect()} == {2, 5}


def test_vessels_of_both_kinds(spark):
    """Tissue with a round hole, a tiny one, and a blob at the frame that background cuts off; the zone left is PP, right PV."""
    h, w = 40, 80
    hole = lambda y, x, cy, cx, r: (y - cy) ** 2 + (x - cx) ** 2 <= r * r
    tissue = {(y, x) for y in range(2, h - 2) for x in range(2, 60) if not hole(y, x, 20, 20, 6) and not hole(y, x, 30, 45, 1)}
    blob = {(y, x) for y in range(8, 30) for x in range(66, w)}
    fore = spark.createDataFrame([(1, y, x) for y, x in tissue | blob], "uid long, y long, x long")
    zones = spark.createDataFrame([(1, y, x, "PP" if x < 40 else "PV") for y, x in tissue | blob], "uid long, y long, x long, zone string")
    found, places = pipeline.vessels_of(fore, zones, (h, w), 2, {"PP": pipeline.Gate(0.5, 20, 30, 0.1), "PV": pipeline.Gate(0.5, 20, 200, 0.1)})
    got = {r.label: (r.zone, r.area) for r in found.collect()}
    inner = [v for k, v in got.items() if k >= 0]
    cut = [v for k, v in got.items() if k < 0]
    assert inner == [("PP", sum(hole(y, x, 20, 20, 6) for y in range(h) for x in range(w)))]
    assert ("PV", len(blob)) in cut and set(places.select("label").distinct().toPandas()["label"]) == set(got)
    shrunk = places.where(F.col("label") == next(k for k, v in got.items() if v == ("PV", len(blob)))).count()
    assert 0 < shrunk < len(blob)
    strict, _ = pipeline.vessels_of(fore, zones, (h, w), 2, {"PP": pipeline.Gate(0.5, 20, 2000, 0.99), "PV": pipeline.Gate(0.5, 10_000, 30, 0.1)})
    assert strict.count() == 0


def broadcast_lists(df):
    """How many broadcasts of the executed plan hold a generator: tables whose size the optimizer doesn't know."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(re.match(r"[ :|+-]*", line).group()) for line in lines]
    found = 0
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
            found += any("Generate" in part for part in lines[i:below])
    return found


def test_resampling_equals_a_look_at_each_target(spark):
    """Odd sizes, absent pixels, nulls and a slide of no key: as by a look at each target."""
    rng = random.Random(3)
    at = {(u, y, x): None if rng.random() < 0.1 else float(rng.randrange(99)) for u in (1, 2) for y in range(7) for x in range(5) if rng.random() < 0.8}
    px = spark.createDataFrame([(*k, v) for k, v in at.items()] + [(None, 0, 0, 1.0), (1, 7, 0, 1.0), (1, 0, -1, 1.0)], "uid long, y long, x long, value double")
    for to_h, to_w in ((3, 11), (7, 5), (13, 2)):
        near = pyramid.nearest_resampled(px, ["uid"], 7, 5, to_h, to_w)
        want = {(u, ty, tx): at[u, ty * 7 // to_h, tx * 5 // to_w] for u in (1, 2) for ty in range(to_h) for tx in range(to_w) if (u, ty * 7 // to_h, tx * 5 // to_w) in at}
        assert {(r.uid, r.y, r.x): r.value for r in near.collect()} == want and near.count() == len(want)
        smooth = pyramid.bilinear_resampled(px, ["uid"], 7, 5, to_h, to_w)
        want = {}
        for u, ty, tx in ((u, ty, tx) for u in (1, 2) for ty in range(to_h) for tx in range(to_w)):
            fy, fx = (max(0.0, min(n - 1.0, (t + 0.5) * n / to - 0.5)) for t, n, to in ((ty, 7, to_h), (tx, 5, to_w)))
            four = [((u, min(int(fy) + dy, 6), min(int(fx) + dx, 4)), (fy % 1 if dy else 1 - fy % 1) * (fx % 1 if dx else 1 - fx % 1)) for dy in (0, 1) for dx in (0, 1)]
            if any(p in at for p, _ in four):
                want[u, ty, tx] = sum(at[p] * f for p, f in four) if all(at.get(p) is not None for p, _ in four) else None
        got = {(r.uid, r.y, r.x): r.value for r in smooth.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) if want[k] is not None else got[k] is None for k in want)


def test_affine_sampling_equals_a_look_at_each_target(spark):
    """Turns, shears, mirrors, singular matrices, halves that round up, and transforms that aren't finite."""
    h, w = 6, 9
    moves = [(0.9, 0.1, -0.1, 1.1, 2.0, 1.0), (0.0, 1.0, -1.0, 0.0, 0.0, 5.0), (0.5, 0.0, 0.0, 0.5, 0.5, -0.5), (3.0, 0.2, 0.1, -2.0, -4.0, 8.0), (0.0, 0.0, 0.0, 0.0, 2.5, 2.0), (1.0, 2.0, 0.5, 1.0, -3.0, 0.0), (0.3, 0.0, 0.7, 0.0, 1.0, 1.0), (float("nan"), 0.0, 0.0, 1.0, 0.0, 0.0)]
    px = [(u, y, x, 100 * y + x) for u in range(len(moves)) for y in range(h) for x in range(w) if (y + x + u) % 5]
    there = {p[:3]: p[3] for p in px}
    want = {}
    for u, (a, b, c, d, e, f) in enumerate(moves[:-1]):
        for y, x in ((y, x) for y in range(8) for x in range(7)):
            at = (u, math.floor(a * y + b * x + e + 0.5), math.floor(c * y + d * x + f + 0.5))
            if at in there:
                want[u, y, x] = there[at]
    made = spark.createDataFrame([(u, *m) for u, m in enumerate(moves)], "uid long, a00 double, a01 double, a10 double, a11 double, b0 double, b1 double")
    found = pyramid.affine_sampled(spark.createDataFrame(px, "uid long, y long, x long, value long"), made, "uid", 8, 7)
    rows_ = found.collect()
    assert {(r.uid, r.y, r.x): r.value for r in rows_} == want and len(rows_) == len(want) and {u for u, _, _ in want} == set(range(7))


@pytest.mark.parametrize("name", ["apply_affine", "bilinear_resample", "nearest_resample"])
def test_no_grid_of_targets_is_broadcast(spark, data, name):
    assert broadcast_lists(catalog.QUERIES[name](spark, data)) == 0


def test_junctions_broadcast_no_list_of_cells(spark, data):
    assert broadcast_lists(catalog.QUERIES["t_junctions"](spark, data)) == 0


def test_pixels_are_not_broadcast(spark):
    """Whether they come from runs, from neighbours or from a mask that is stored in few bytes."""
    mask = written(spark.range(6000).selectExpr("id div 3000 as uid", "id % 3000 div 60 as y", "id % 60 as x"))
    px = mask.withColumns({"channel": F.lit(0), "value": F.col("x")})
    found = [pixels.masked(px, mask.where("x > y"), ["uid"]), network.degrees_of_pixels(mask), mask.join(runs.pixels_of(written(runs.runs_of(mask))), ["uid", "y", "x"])]
    for df in found:
        assert df.count() == 6000
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_metadata_is_read_by_place_and_parsed_once(spark):
    """Namespaces, an absent attribute, ids that repeat or lack, other elements' attributes, and no document."""
    one = '<?xml version="1.0" encoding="UTF-8"?><o:OME xmlns:o="x"><!-- c --><o:Image PhysicalSizeX="9"><o:Pixels PhysicalSizeX="0.5" PhysicalSizeYUnit="micron"><o:Channel ID="a" Name="n&amp;1"/><o:Channel ID="a" Color="-1"/><o:Channel Name="" Color="x"/></o:Pixels></o:Image></o:OME>'
    two = '<a><Channel Name="z" Fluor="f"/><Pixels PhysicalSizeY="?"/><Pixels PhysicalSizeY="2" PhysicalSizeX="3"/></a>'
    docs = spark.createDataFrame([(1, one), (2, two), (3, None)], "uid long, xml string")
    got = {r.uid: r[1:] for r in catalogs.ome_records(docs, "xml").collect()}
    assert got[1] == (0.5, None, "µm", ["n&1", "", ""], [None, -1, None])
    assert got[2][:2] == (3.0, None) and got[2][3:] == ([], []) and got[3][:2] == (None, None)
    named = {(r[0], r[1]): r[2] for r in catalogs.channel_names(docs, "xml", 2).collect()}
    assert named == {(1, 0): "n&1", (1, 1): "Channel 2", (2, 0): "z", (2, 1): "Channel 2", (3, 0): "Channel 1", (3, 1): "Channel 2"}
    for df in (catalogs.ome_records(docs, "xml"), catalogs.channel_names(docs, "xml", 2)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("xpath") == 0 and plan.count("ArrowEvalPython") == 1


def test_means_that_tie_but_for_rounding_go_to_the_least_cluster(spark):
    """0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1 in doubles."""
    rising = [(1, 0, v, v) for v in (0.3, 0.2, 0.1)] + [(1, 1, v, v) for v in (0.1, 0.2, 0.3)] + [(1, 2, 0.05, 0.05)]
    px = spark.createDataFrame(rising + [(2, c, p, v) for c, p, v in ((0, 1.0, 9.0), (1, 1.0 + 1e-9, 9.0), (2, 0.5, 8.0), (3, None, None))], "uid long, cluster long, pp double, pv double").coalesce(1)
    assert rows(features.zones_by_score(px, "uid", "pp", "pv")) == [(1, 0, "PP"), (1, 1, "PV"), (1, 2, "MID"), (2, 0, "PV"), (2, 1, "PP"), (2, 2, "MID"), (2, 3, "MID")]
    falling = px.where("uid = 1").withColumn("cluster", 1 - F.col("cluster"))
    assert rows(features.zones_by_rank(falling, "uid", "pp", (2, 1, 1))) == [(1, -1, "PV"), (1, 0, "PV"), (1, 1, "MID")]


def test_ends_at_one_place_are_met_once(spark):
    """Distances are found for places, directions for ends: the join has a row for a place, however many lines end there."""
    ends = [(i, 1, 8 * (i % 2), 8 + i % 3) for i in range(3000)] + [(i, 2, 20, 10) for i in range(3000)]
    lines = spark.createDataFrame([*ends, (9000, 1, 20, 0), (9000, 2, 20, 32), (9001, 1, 0, 11), (9001, 2, 40, 11)], "line long, seq long, px long, py long")
    segs = graph.segments(lines).where("line >= 9000")
    found = graph.t_junctions(lines, segs, 2.0, digits=3)
    want = {(i, 2, 9000, 1, 0.313) for i in range(3000)}
    steep = lambda i: math.degrees(math.atan2(abs(2 - i % 3), 20 - 8 * (i % 2))) >= 20
    want |= {(i, s, 9001, 1, x) for i in range(3000) for s, x in ((1, 8 * (i % 2) / 40), (2, 0.5)) if steep(i) and 0.02 <= x <= 0.98 and (s == 2 or abs(8 + i % 3 - 11) <= 2)}
    assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(tips") < plan.index("Join Inner")


def test_shares_are_rounded_as_decimals(spark):
    shares = [(a / b,) for b in (7, 1000, 1024, 2048, 5120, 17330) for a in range(b)]
    got = spark.createDataFrame(shares, "t double").select(graph.rounded_share(F.col("t"), 9).alias("a"), F.round("t", 9).alias("b"))
    assert got.where("a <> b").count() == 0 and got.where("a = b").count() == len(shares)
