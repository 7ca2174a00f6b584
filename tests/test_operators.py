"""Operators on small images with known answers, and invariance under tiling."""

import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from histospark.operators import components, distance, features, graph, stain, stencil
from histospark.plans import pipeline
from histospark.sources import catalog, pyramid
from histospark.streaming.pixels import transformed_stream


def image(spark, rows, uid=1):
    return spark.createDataFrame([(uid, y, x, int(c)) for y, line in enumerate(rows) for x, c in enumerate(line)], "uid long, y long, x long, value long")


def mask_of(spark, rows):
    return image(spark, rows).where("value = 1").select("uid", "y", "x")


def flood(rows, eight):
    label, moves = {}, stencil.RING if eight else stencil.CROSS
    for y, line in enumerate(rows):
        for x, c in enumerate(line):
            if c == "1" and (y, x) not in label:
                todo, label[y, x] = deque([(y, x)]), y * components.WIDE + x
                while todo:
                    a, b = todo.popleft()
                    for dy, dx in moves:
                        n = (a + dy, b + dx)
                        if 0 <= n[0] < len(rows) and 0 <= n[1] < len(line) and rows[n[0]][n[1]] == "1" and n not in label:
                            label[n] = y * components.WIDE + x
                            todo.append(n)
    return label


SPIRAL = ["1111111111", "0000000001", "1111111101", "1000000101", "1011110101", "1010010101", "1010000101", "1011111101", "1000000001", "1111111111"]


@pytest.mark.parametrize("eight", [False, True])
@pytest.mark.parametrize("tile", [3, 64])
def test_labels_do_not_depend_on_tiles(spark, eight, tile):
    rng = random.Random(tile)
    noise = ["".join(rng.choice("0011") for _ in range(17)) for _ in range(13)]
    for rows in (SPIRAL, noise):
        got = {(r.y, r.x): r.label for r in components.labelled(mask_of(spark, rows), eight=eight, tile=tile).collect()}
        assert got == flood(rows, eight)


def test_holes(spark):
    rows = ["000000", "011110", "010010", "011110", "000000"]
    assert {(r.y, r.x) for r in components.holes(mask_of(spark, rows), (5, 6)).collect()} == {(2, 2), (2, 3)}
    assert components.filled(mask_of(spark, rows), (5, 6)).count() == 12


@pytest.mark.parametrize("tile", [8, 64])
def test_stencils_do_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    values = rng.integers(0, 255, (20, 23))
    df = spark.createDataFrame([(1, y, x, float(values[y, x])) for y in range(20) for x in range(23)], "uid long, y long, x long, value double")
    got = {(r.y, r.x): r.value for r in stencil.median_blur(df, ["uid"], 3, tile=tile).collect()}
    want = {(y, x): float(np.median(values[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2])) for y in range(20) for x in range(23)}
    assert got == want
    flat = stencil.gaussian_blur(df.withColumn("value", F.lit(7.0)), ["uid"], 1.5, tile=tile).collect()
    assert len(flat) == 460 and all(abs(r.value - 7) < 1e-9 for r in flat)


def test_dilation_and_erosion(spark):
    m = mask_of(spark, ["00000", "00000", "00100", "00000", "00000"])
    assert stencil.dilated(m, ["uid"], 1).count() == 5 and stencil.dilated(m, ["uid"], 2).count() == 13
    assert stencil.eroded(stencil.dilated(m, ["uid"], 2), ["uid"], 2).collect() == m.collect()
    assert stencil.eroded(m, ["uid"], 1).count() == 0


@pytest.mark.parametrize("tile", [18, 64])
def test_thinning_leaves_lines(spark, tile):
    rows = ["0" * 30] + ["0" + "1" * 28 + "0"] * 5 + ["0" * 30]
    thin = {(r.y, r.x) for r in stencil.thinned(mask_of(spark, rows), ["uid"], per_round=2, tile=tile).collect()}
    assert thin and {y for y, _ in thin} <= {2, 3, 4} and len(thin) < 40


def test_distance_is_exact(spark):
    rng = np.random.default_rng(5)
    on = rng.random((15, 40)) < 0.03
    df = spark.createDataFrame([(1, y, x, bool(on[y, x])) for y in range(15) for x in range(40)] + [(2, 0, 0, False)], "uid long, y long, x long, on boolean")
    targets = np.argwhere(on)
    for r in distance.distance_to(df, "on").collect():
        assert np.isinf(r.distance) if r.uid == 2 else abs(r.distance - np.sqrt(((targets - [r.y, r.x]) ** 2).sum(axis=1).min())) < 1e-9


def test_portality_bounds(spark):
    df = spark.createDataFrame([(1, y, x, 1 if 1 <= y <= 9 and 1 <= x <= 9 else None, y == 5 and x == 5, False) for y in range(11) for x in range(11)], "uid long, y long, x long, label long, central boolean, portal boolean")
    got = {(r.y, r.x): r.portality for r in distance.portality(df).collect()}
    assert got[5, 5] == 1 and got[1, 4] == 0 and got[0, 0] is None and 0 < got[5, 3] < got[5, 4] < 1


def test_k_means_is_settled_and_no_worse_than_loops(spark):
    """No point is nearer to another centre, and the cost isn't above that of twenty plain runs from random points."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1.0, (40, 2)) for c in ((0, 0), (6, 1), (3, 7), (12, 4))] + [rng.uniform(-3, 15, (40, 2))])
    df = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "uid string, node long, a double, b double")
    found = {r.node: r.cluster for r in features.k_means(df, "uid", ["a", "b"], k=5).collect()}
    label = np.array([found[i] for i in range(len(x))])
    centre = np.array([x[label == c].mean(axis=0) for c in range(5)])
    far = ((x[:, None] - centre) ** 2).sum(axis=2)
    assert (far.argmin(axis=1) == label).all()
    costs = []
    for _ in range(20):
        c = x[rng.choice(len(x), 5, replace=False)]
        while True:
            near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(5)])
            if np.allclose(new, c, atol=1e-12):
                break
            c = new
        costs.append(((x[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum())
    assert far.min(axis=1).sum() <= min(costs) * (1 + 1e-9) + 1e-9 or far.min(axis=1).sum() <= np.median(costs)


def test_k_means_and_smoothing(spark):
    points = spark.createDataFrame([(1, i, float(i // 10 * 100 + i % 3)) for i in range(30)], "uid long, node long, v double")
    found = features.k_means(points, "uid", ["v"], k=3, seeds=4).collect()
    assert len({r.cluster for r in found}) == 3 and all(len({r.cluster for r in found if r.node // 10 == g}) == 1 for g in range(3))
    blocks = features.k_means(points, "uid", ["v"], k=3, seeds=4, block=4).collect()
    assert sorted(found) == sorted(blocks)
    edges = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    values = spark.createDataFrame([(0, 0.0, 1), (1, 3.0, 2), (2, 6.0, 2), (3, 9.0, 5)], "node long, v double, label long")
    assert {r.node: r.v for r in features.smoothed_features(values, edges, ["v"]).collect()} == {0: 1.5, 1: 3.0, 2: 4.5, 3: 9.0}
    assert {r.node: r.label for r in features.smoothed_labels(values, edges).collect()} == {0: 1, 1: 2, 2: 2, 3: 5}


def test_trees_and_pruning(spark):
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 2), (0, 2, 3), (2, 3, 1), (3, 4, 1)], "u long, v long, length long")
    assert {(r.u, r.v) for r in graph.spanning_tree(edges).collect()} == {(0, 1), (1, 2), (2, 3), (3, 4)}
    assert {(r.u, r.v) for r in graph.pruned(edges).collect()} == {(0, 1), (1, 2), (0, 2)}
    terminals = spark.createDataFrame([(0,), (3,)], "source long")
    assert {(r.u, r.v) for r in graph.terminal_tree(edges, terminals).collect()} in ({(0, 2), (2, 3)}, {(0, 1), (1, 2), (2, 3)})
    chained = graph.chains(spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 3, 1), (2, 4, 1)], "u long, v long, length long"))
    assert {(r.u, r.v, r.length, r.pieces) for r in chained.collect()} == {(0, 2, 2, 2), (2, 3, 1, 1), (2, 4, 1, 1)}


def test_stain_basis_is_found(spark):
    rng = np.random.default_rng(2)
    m = np.array([stain.unit_length(v) for v in ((0.65, 0.70, 0.29), (0.27, 0.57, 0.78))]).T
    c = np.abs(rng.standard_normal((2, 4000))) * np.where(rng.random((2, 4000)) < 0.4, 0.02, 0.8)
    rgb = 240 * np.exp(-(m @ c)) - 1
    df = spark.createDataFrame([(1, *map(float, p)) for p in rgb.T], "uid long, c0 double, c1 double, c2 double")
    r = stain.stain_basis(df, ["uid"]).first()
    assert np.dot([r.h0, r.h1, r.h2], m[:, 0]) > 0.97 and np.dot([r.e0, r.e1, r.e2], m[:, 1]) > 0.97


def test_tissue_mask_finds_a_square(spark):
    rows = [(1, y, x, 200 if 10 <= y < 30 and 10 <= x < 30 else 10) for y in range(40) for x in range(40)]
    gray = spark.createDataFrame(rows, "uid long, y long, x long, value long")
    box = pipeline.region_of_interest(gray, (40, 40)).first()
    assert abs(box.y0 - 10) <= 1 and abs(box.x1 - 30) <= 1


def test_pyramid_round_trip(spark, tmp_path):
    tiles = pyramid.tiled(image(spark, ["0123", "4567"]).withColumns({"level": F.lit(0), "channel": F.lit(0)}), ["uid", "level", "channel"], 2)
    pyramid.write_tiles(tiles, str(tmp_path / "t"))
    back = pyramid.untiled(pyramid.read_tiles(spark, str(tmp_path / "t"), uid=1, level=0), ["uid"])
    assert sorted((r.y, r.x, r.value) for r in back.collect()) == [(i // 4, i % 4, float(i)) for i in range(8)]
    with pytest.raises(ValueError):
        pyramid.validated(tiles.union(tiles.withColumns({"level": F.lit(1), "channel": F.lit(1)})))


def test_manifest_round_trip(spark, tmp_path):
    rows = [("u1", "/a/b.czi", "/s/b.tiff", "b.czi", "b.tiff", ".czi", ".tiff", 20.0, {"x": 0.5}, "µm", "fluorescence", {0: "DAPI", 1: "FITC"}, {0: -16776961}, {"k": "v"}, 8, False)]
    slides = spark.createDataFrame(rows, catalog.SLIDES)
    catalog.write_manifest(slides, str(tmp_path / "m"))
    assert catalog.read_manifest(spark, str(tmp_path / "m")).collect() == slides.collect()


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 256), 3.0, 9.0) for i in range(100)], "uid long, c0 double, c1 double, c2 double")
    df.write.parquet(str(tmp_path / "in"))
    densities = lambda d: d.select("uid", *[stain.optical_density(F.col(f"c{k}")).alias(f"o{k}") for k in range(3)])
    transformed_stream(spark, str(tmp_path / "in"), df.schema, densities, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(densities(df).collect())


def test_nested_components_go(spark):
    big = [(1, y, x, 1) for y in range(4) for x in range(4)]
    rows = big + [(1, 0, 5, 2), (1, 5, 0, 2), (1, 9, 9, 3), (2, 0, 0, 7)]
    labels = spark.createDataFrame(rows, "uid long, y long, x long, label long")
    assert {(r.uid, r.label) for r in components.without_nested(labels).collect()} == {(1, 1), (1, 3), (2, 7)}


def test_loop_groups_and_exits(spark):
    loops = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 2), (2, 2, 3), (2, 3, 4), (2, 2, 4), (3, 10, 11), (3, 11, 12), (3, 10, 12)], "loop long, u long, v long")
    edges = loops.select("u", "v").union(spark.createDataFrame([(4, 5), (10, 20), (11, 20)], "u long, v long"))
    assert {(r.loop, r.group) for r in graph.loop_groups(loops).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert {(r.group, r.exits) for r in graph.weakly_attached_groups(loops, edges).collect()} == {(1, 1)}


def test_parallel_edges_stay_apart_when_chains_are_contracted(spark):
    edges = spark.createDataFrame([(1, 2, 3), (1, 2, 5), (1, 3, 1), (1, 4, 1), (2, 5, 1), (2, 6, 1), (6, 7, 2)], "u long, v long, length long")
    got = sorted((r.u, r.v, r.length, r.pieces) for r in graph.chains(edges).collect())
    assert got == [(1, 2, 3, 1), (1, 2, 5, 1), (1, 3, 1, 1), (1, 4, 1, 1), (2, 5, 1, 1), (2, 7, 3, 2)]


def test_arms_around_the_circle(spark):
    df = spark.createDataFrame([(1, 179.0), (1, -179.0), (2, 0.0), (2, 90.0), (2, 100.0), (3, 350.0)], "node long, angle double")
    assert {r.node: r.arms for r in graph.arms(df, "node").collect()} == {1: 1, 2: 2, 3: 1}


def test_parallel_edges_go_only_where_they_overlap(spark):
    straight = [(0, 0), (20, 0)]
    paths = {1: straight, 2: [(0, 1), (20, 1)], 3: [(0, 0), (10, 12), (20, 0)], 4: [(20, 0), (0, 0)], 5: [(0, 0), (0, 9)]}
    ends = {1: (7, 8), 2: (7, 8), 3: (7, 8), 4: (8, 7), 5: (7, 9)}
    lines = spark.createDataFrame([(e, k, x, y) for e, pts in paths.items() for k, (x, y) in enumerate(pts)], "line long, seq int, px long, py long")
    edges = spark.createDataFrame([(e, u, v) for e, (u, v) in ends.items()], "eid long, u long, v long")
    assert {r.eid for r in graph.without_parallel(edges, lines).collect()} == {1, 3, 5}
    assert graph.without_parallel(edges.where("false"), lines).count() == 0


def test_filled_polygons(spark):
    shapes = {1: [(0, 0), (6, 0), (6, 4), (0, 4)], 2: [(2, 1), (9, 8), (2, 8)], 3: [(0, 0), (8, 0), (4, 4), (8, 8), (0, 8)], 4: [(3, 3)], 5: [(0, 0), (5, 5)]}
    df = spark.createDataFrame([(k, k, i, x, y) for k, pts in shapes.items() for i, (x, y) in enumerate(pts)], "uid long, line long, seq int, px long, py long")
    got = {(r.uid, r.y, r.x) for r in graph.filled_polygons(df, ["uid"]).collect()}

    def inside(pts, y, x):
        odd = False
        for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1], strict=True):
            if (by - ay) * (x - ax) == (y - ay) * (bx - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
        return odd

    assert got == {(k, y, x) for k, pts in shapes.items() for y in range(-1, 11) for x in range(-1, 11) if inside(pts, y, x)}


def test_portality_counts_only_what_is_inside(spark):
    rows = ["0000000", "0111110", "0111110", "0111110", "0000000"]
    df = image(spark, rows).select("uid", "y", "x", F.when(F.col("value") == 1, 1).alias("label"), F.expr("(y = 2 and x = 3) or (y = 0 and x = 0)").alias("central"), F.lit(False).alias("portal"))
    got = {(r.y, r.x): r.portality for r in distance.portality(df).collect()}
    assert got[0, 0] is None and got[2, 3] == 1.0 and got[1, 1] == 0.0 and got[2, 2] == pytest.approx(0.5) and len(got) == 35


def test_border_rings(spark):
    block = [(1, 1, y, x) for y in range(12) for x in range(12)] + [(1, 2, y, x) for y in range(20, 24) for x in range(20, 24)]
    regions = spark.createDataFrame(block, "uid long, label long, y long, x long")
    beside = spark.createDataFrame([(1, y, 12) for y in range(12)], "uid long, y long, x long")
    hole, rim = stencil.border_rings(regions, beside, ["uid"], 2)
    assert {r.label for r in hole.collect()} == {1} == {r.label for r in rim.collect()}
    assert hole.count() == 16 and rim.count() == 48
    assert stencil.border_rings(regions, beside.where("false"), ["uid"], 2)[0].count() == 0


def test_instances_choose_their_radius_by_slide(spark):
    walls = [(u, y, x) for u, gap in ((1, 0), (2, 3)) for y in range(10, 31) for x in range(10, 31) if (y in (10, 30) or x in (10, 30)) and not (y == 10 and 20 <= x < 20 + gap)]
    got = pipeline.gap_closed_instances(spark.createDataFrame(walls, "uid long, y long, x long"), (41, 41))
    assert {r.uid for r in got.select("uid").distinct().collect()} == {1, 2}


def test_statistics_round_trip_as_csv(spark, tmp_path):
    from histospark.sources.reports import read_statistics, write_statistics

    raw, summary = spark.createDataFrame([("a,b", 1.5)], "stain string, value double"), spark.createDataFrame([("a", 2)], "stain string, n long")
    write_statistics(raw, summary, str(tmp_path))
    assert read_statistics(spark, str(tmp_path), "lobule_stats_raw", raw.schema.simpleString()[7:-1].replace(":", " ")).collect() == raw.collect()
    assert read_statistics(spark, str(tmp_path), "summarized_stats", "stain string, n long").collect() == summary.collect()


def test_unknown_profiles_are_errors_when_strict(spark):
    none = F.lit(None).cast("string")
    df = spark.createDataFrame([("eosin",)], "s string")
    assert df.select(catalog.stain_profile(none, F.array("s"), none, none)).first()[0] is None
    with pytest.raises(Exception, match="profile"):
        df.select(catalog.stain_profile(none, F.array("s"), none, none, strict=True)).collect()


def test_vessels_take_the_zone_around_them(spark):
    hole = spark.createDataFrame([(1, 1, y, x) for y in range(10, 14) for x in range(10, 14)], "uid long, label long, y long, x long")
    zones = spark.createDataFrame([(1, y, x, "PP" if x < 18 else "PV") for y in range(24) for x in range(24)], "uid long, y long, x long, zone string")
    assert [(r.label, r.zone) for r in pipeline.vessels(hole, zones, 2, 5, 0.4).collect()] == [(1, "PP")]
    assert pipeline.vessels(hole, zones, 2, 50, 0.4).count() == 0


def test_pruning_a_long_branch_writes_the_rest_once(spark, monkeypatch):
    sizes, real = [], graph.written

    def spied(df, *what):
        out = real(df, *what)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", spied)
    ring = [(i, (i + 1) % 200) for i in range(200)] + [(300, 300), (400, 401), (401, 400)]
    path = [(5, 500)] + [(500 + i, 501 + i) for i in range(5)] + [(600, 601)]
    got = graph.pruned(spark.createDataFrame(ring + path, "u long, v long")).collect()
    assert sorted((r.u, r.v) for r in got) == sorted(ring)
    assert sum(sizes) < 4 * len(ring + path)


def test_equalised_shuffles_in_proportion_to_pixels_not_levels(spark):
    written = lambda: sum(x.totalShuffleWrite() for x in iter_of(spark._jsc.sc().statusStore().executorList(True)))
    iter_of = lambda seq: [seq.apply(i) for i in range(seq.size())]
    image = spark.range(64 * 64).selectExpr("cast(0 as long) as uid", "id div 64 as y", "id % 64 as x", "(id * 7919) % 251 as value").localCheckpoint()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = written()
        got = {(r["y"], r["x"]): r["byte"] for r in stencil.equalised(image, ["uid"]).collect()}
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert written() - before < 1_500_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    value = {(y, x): (y * 64 + x) * 7919 % 251 for y in range(64) for x in range(64)}
    cell = lambda cy, cx: [value[y, x] for y in range(4 * cy, 4 * cy + 4) for x in range(4 * cx, 4 * cx + 4)]

    def to(cy, cx, v):
        own = [cell(cy, cx).count(u) for u in range(256)]
        spare = sum(n - min(n, 1.0) for n in own) / 256
        return sum(min(n, 1.0) + spare for n in own[: v + 1]) / 16 * 255

    near = lambda k: max(0, min(15, k))
    for y, x in [(0, 0), (63, 63), (1, 40), (17, 22), (30, 63), (33, 34)]:
        fy, fx = y / 4 - 0.5, x / 4 - 0.5
        by, bx = math.floor(fy), math.floor(fx)
        want = sum((fy - by if dy else 1 - fy + by) * (fx - bx if dx else 1 - fx + bx) * to(near(by + dy), near(bx + dx), value[y, x]) for dy in (0, 1) for dx in (0, 1))
        assert got[y, x] == math.floor(want + 0.5)
