"""Composed transforms: tissue mask, region of interest, channel filter, stack loading, zones, vessels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histospark.operators import components as comp
from histospark.operators import hist, pixels, runs, stencil, tiles
from histospark.operators.iterate import removed, written
from histospark.operators.runs import Frames
from histospark.sources.pyramid import extreme_level


def tissue_runs(gray: DataFrame, frames: Frames, classes: int = 2, blur_share: float = 0.007, close_share: float = 0.01, least_object: float = 0.01, least_hole: float = 0.05, brightfield: bool = False) -> DataFrame:
    """Runs (uid, y, x0, x1) of tissue in gray images (uid, y, x, value), each slide by its own frame.

    Thresholds come from the blurred image and part the raw one: Otsu's for two classes, or for three
    classes what ``hist.tissue_classes`` chooses for each slide. The mask is closed, all but the background
    that touches the edge is tissue, pieces of background below ``least_hole`` of the frame are filled, and pieces
    of tissue below ``least_object`` go. Blur and closing have radii by the frame's shorter side; slides of
    equal radii are run together.
    """
    spark = gray.sparkSession
    size = runs.frames_of(gray, frames)
    short = F.least("h", "w")
    radii = written(size.select("uid", F.greatest(F.lit(1), F.floor(short * blur_share)).cast("int").alias("sigma"), F.greatest(F.lit(1), F.floor(short * (close_share / 2))).cast("int").alias("reach")))
    blurred, groups = None, sorted((r["sigma"], r["reach"]) for r in radii.select("sigma", "reach").distinct().collect())
    for sigma in sorted({s for s, _ in groups}):  # as many as there are different sizes of slides
        packed = tiles.packed(gray.join(radii.where(F.col("sigma") == sigma).select("uid"), "uid", "left_semi"), ["uid"], max(tiles.SIDE, 3 * sigma))
        one = written(tiles.unpacked(tiles.blurred(packed, sigma)).withColumn("value", F.floor(F.col("value") + 0.5).cast("long")))
        blurred = one if blurred is None else blurred.unionByName(one)
    if blurred is None:
        return runs.runs_of(gray)
    two = hist.otsu(blurred, ["uid"], "value")
    if classes == 3:
        three = hist.three_classes(gray, hist.multi_otsu(blurred, ["uid"], "value"), ["uid"], "value")
        chosen = hist.tissue_classes(three, two, ["uid"], "value")
    else:
        chosen = two.select("uid", F.col("threshold").alias("lowest"), F.lit(True).alias("bimodal"))
    value, lowest = F.col("value"), F.col("lowest")
    above = value < lowest if brightfield else (value > lowest) | (~F.col("bimodal") & (value == lowest))
    first = written(runs.runs_of(gray.join(written(chosen), "uid").where(above)))
    closed = first.join(radii.where("reach < 2").select("uid"), "uid", "left_semi")
    for reach in sorted({r for _, r in groups if r >= 2}):
        mask = tiles.packed_runs(first.join(radii.where(F.col("reach") == reach).select("uid"), "uid", "left_semi"), ["uid"], max(tiles.SIDE, reach))
        closed = closed.unionByName(runs.clipped(tiles.runs_in(tiles.closed(mask, reach)), frames))
    solid = written(runs.filled(runs.joined_runs(closed), frames))
    spare = runs.of_least_area(runs.labelled(runs.gaps(solid, size)), f"greatest(1, floor({least_hole} * h * w))", "uid", size, small=True)
    even = written(runs.joined_runs(solid.unionByName(spare.drop("label"))))
    big = runs.of_least_area(runs.labelled(even), f"greatest(1, floor({least_object} * h * w))", "uid", size)
    out = written(runs.joined_runs(big))
    removed(spark, first, solid, even)
    return out


def tissue_mask(gray: DataFrame, frames: Frames, **options) -> DataFrame:
    """uid, y, x of tissue, by ``tissue_runs``."""
    return runs.pixels_of(tissue_runs(gray, frames, **options)).select("uid", "y", "x")


def region_of_interest(gray: DataFrame, frames: Frames, least_area: int = 1, **options) -> DataFrame:
    """uid and the half-open box of its tissue in pieces of at least ``least_area`` pixels; slides without tissue have none."""
    found = runs.of_least_area(runs.labelled(tissue_runs(gray, frames, **options)), least_area)
    return runs.bounding_box(found, ["uid"])


def regions_of_levels(pyramid: DataFrame, shapes: DataFrame, least_area: int = 1, **options) -> DataFrame:
    """uid, level, y0, x0, y1, x1: each slide's region at every level of a pyramid (uid, level, y, x, value) of shapes (uid, level, h, w).

    The region is found at the level of least area, scaled to the greatest level (level 0, if there is one)
    and from there to each level; corners and sides are rounded half to even and clipped. Slides without tissue have none.
    """
    small = written(extreme_level(shapes).join(shapes, ["uid", "level"]))
    full = shapes.groupBy("uid").agg(F.max(F.struct((F.col("level") == 0).alias("zero"), (F.col("h") * F.col("w")).alias("a"), "h", "w")).alias("m")).select("uid", F.col("m.h").alias("fh"), F.col("m.w").alias("fw"))
    gray = pyramid.join(small.select("uid", "level"), ["uid", "level"], "left_semi").select("uid", "y", "x", "value")
    box = region_of_interest(gray, small.select("uid", "h", "w"), least_area, **options)
    near = lambda c: F.bround(c).cast("long")
    at = box.join(small.select("uid", "h", "w"), "uid").join(full, "uid")
    fy, fx = F.col("fh") / F.col("h"), F.col("fw") / F.col("w")
    whole = at.select("uid", "fh", "fw", near(F.col("y0") * fy).alias("top"), near(F.col("x0") * fx).alias("left"), near((F.col("y1") - F.col("y0")) * fy).alias("high"), near((F.col("x1") - F.col("x0")) * fx).alias("wide"))
    each = whole.join(shapes, "uid").withColumns({"sy": F.col("h") / F.col("fh"), "sx": F.col("w") / F.col("fw")})
    y, x = near(F.col("top") * F.col("sy")), near(F.col("left") * F.col("sx"))
    zero = F.lit(0).cast("long")
    return each.select("uid", "level", F.greatest(zero, y).alias("y0"), F.greatest(zero, x).alias("x0"), F.least("h", y + near(F.col("high") * F.col("sy"))).alias("y1"), F.least("w", x + near(F.col("wide") * F.col("sx"))).alias("x1"))


def cropped_levels(pyramid: DataFrame, regions: DataFrame) -> DataFrame:
    """The pixels of every level inside its region, in coordinates of the region."""
    inside = pyramid.join(regions, ["uid", "level"]).where("y >= y0 and y < y1 and x >= x0 and x < x1")
    return inside.withColumns({"y": F.col("y") - F.col("y0"), "x": F.col("x") - F.col("x0")}).drop("y0", "x0", "y1", "x1")


def filtered_channels(pixels_: DataFrame, background: float = 10, median: int = 3, suppress: float = 5) -> DataFrame:
    """uid, channel, y, x, byte: suppression, median, CLAHE, suppression, median, and scaling by the 99th percentile of what is left."""
    keys = ["uid", "channel"]
    low = pixels_.withColumn("value", pixels.suppressed(F.col("value"), background))
    smooth = written(stencil.median_blur(low, keys, median))
    even = stencil.equalised(smooth, keys).select(*keys, "y", "x", pixels.suppressed(F.col("byte"), suppress, strict=True).alias("value"))
    return pixels.normalised_nonzero(written(stencil.median_blur(even, keys, 3)), keys).select(*keys, "y", "x", "byte")


def loaded_stack(pixels_: DataFrame, frames: Frames, invert: list[int], least_share: float) -> DataFrame:
    """uid, channel, y, x, value: stretched to bytes, masked by tissue, cropped to its box, chosen channels inverted, near-blank channels dropped."""
    keys = ["uid", "channel"]
    bytes_ = written(pixels.minmax8(pixels_, keys).select(*keys, "y", "x", F.col("byte").alias("value")))
    tissue = written(tissue_mask(bytes_.groupBy("uid", "y", "x").agg(F.max("value").alias("value")), frames))
    inside = pixels.cropped(pixels.masked(bytes_, tissue, ["uid"]), hist.bounding_box(tissue, ["uid"]), ["uid"])
    turned = written(pixels.inverted(inside, invert))
    kept = pixels.kept_channels(turned, least_share)
    return turned.join(kept.select("channel", "new_channel"), "channel").select("uid", F.col("new_channel").alias("channel"), "y", "x", "value")


def vessels(candidates: DataFrame, zones: DataFrame, radius: int, least_area: int, least_share: float) -> DataFrame:
    """uid, label, zone: labelled candidates (uid, y, x, label) classed by the majority of the zones (uid, y, x, zone) in the ring around each.

    Ring pixels of zone MID don't count; PP wins ties; candidates too small, or whose leading share is
    too low, have no class.
    """
    around = stencil.ring(candidates, ["uid", "label"], radius).join(zones.hint("merge"), ["uid", "y", "x"]).where("zone <> 'MID'")
    share = around.groupBy("uid", "label").agg(F.avg((F.col("zone") == "PP").cast("double")).alias("pp"), F.avg((F.col("zone") == "PV").cast("double")).alias("pv"))
    zone = F.when((F.col("pp") >= F.col("pv")) & (F.col("pp") >= least_share), "PP").when(F.col("pv") >= least_share, "PV")
    return comp.shapes_of(candidates).where(F.col("area") >= least_area).join(share, ["uid", "label"]).select("uid", "label", "area", "circularity", zone.alias("zone")).where("zone is not null")


@dataclass(frozen=True)
class Gate:
    """What a vessel of one class needs: a share of its ring, an area, and below ``large`` pixels a circularity."""

    share: float
    area: int = 56
    large: int = 2000
    circularity: float = 0.12


#: Vessels amid the portal zone and amid the central one.
GATES = {"PP": Gate(0.52), "PV": Gate(0.21)}


def vessel_candidates(foreground: DataFrame, frames: Frames, radius: int, least_area: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pixels (uid, label, y, x), rings (uid, label, y, x) and shapes (uid, label, area, circularity) of what may be a vessel.

    Candidates are the holes of the foreground (uid, y, x), whose rings lie along their border, and its components
    that touch the frame's edge, with their holes filled, if at least a tenth of their pixels lie within the
    radius of the background; of these, a hole is made by shrinking twice, and the ring is what the second
    time takes away. A component's label is less than 0: minus one less its least place.
    """
    found = runs.runs_of(foreground)
    holes = written(runs.pixels_of(runs.holes(found, frames)).select("uid", "label", "y", "x"))
    shapes = components_of(holes, least_area)
    closed = written(holes.join(shapes.select("uid", "label"), ["uid", "label"], "left_semi"))
    rings = stencil.ring(closed, ["uid", "label"], radius)
    labels = written(runs.labelled(found, eight=True))
    cut = written(runs.pixels_of(labels.join(runs.at_edge(labels, frames), ["uid", "label"], "left_semi")).select("uid", "label", "y", "x"))
    # the pixel above a hole's least place belongs to the component around it
    around = holes.select("uid", F.col("label").alias("hole")).distinct().select("uid", "hole", (F.floor(F.col("hole") / comp.WIDE) - 1).alias("y"), (F.col("hole") % comp.WIDE).alias("x")).join(cut, ["uid", "y", "x"]).select("uid", "hole", "label")
    inside = holes.withColumnRenamed("label", "hole").join(around, ["uid", "hole"]).select("uid", "label", "y", "x")
    blobs = written(cut.union(inside).withColumn("label", -1 - F.col("label")))
    blob_shapes = components_of(blobs, least_area)
    blobs = blobs.join(blob_shapes.select("uid", "label"), ["uid", "label"], "left_semi")
    hole, rim = stencil.border_rings(blobs, runs.pixels_of(runs.gaps(found, frames)).select("uid", "y", "x"), ["uid"], radius)
    rim = written(rim)
    names = rim.select("uid", "label").distinct()
    pixels_ = closed.unionByName(hole.select("uid", "label", "y", "x"))
    both = shapes.unionByName(blob_shapes.join(names, ["uid", "label"], "left_semi"))
    return pixels_, rings.select("uid", "label", "y", "x").unionByName(rim.select("uid", "label", "y", "x")), both


def components_of(labels: DataFrame, least_area: int) -> DataFrame:
    return written(comp.shapes_of(labels).where(F.col("area") >= least_area).select("uid", "label", "area", "circularity"))


def gated_vessels(rings: DataFrame, shapes: DataFrame, zones: DataFrame, gates: dict[str, Gate] = GATES) -> DataFrame:
    """uid, label, zone, area, circularity of the candidates that pass the gate of their class.

    Only ring pixels of the zones PP and PV count. A candidate is PP where that zone's share reaches its gate's and,
    if PV's does too, is not below it; else PV where that one's share reaches its gate's.
    """
    told = rings.join(zones.hint("merge"), ["uid", "y", "x"]).where("zone in ('PP', 'PV')").groupBy("uid", "label").agg(*[F.avg((F.col("zone") == z).cast("double")).alias(z) for z in ("PP", "PV")])
    pp, pv = (F.col(z) >= gates[z].share for z in ("PP", "PV"))
    zone = F.when(pp & (~pv | (F.col("PP") >= F.col("PV"))), "PP").when(pv, "PV")
    judged = shapes.join(told.select("uid", "label", zone.alias("zone")), ["uid", "label"]).where("zone is not null")
    passes = F.lit(False)
    for z, g in gates.items():
        passes = passes | ((F.col("zone") == z) & (F.col("area") >= g.area) & ((F.col("area") >= g.large) | (F.col("circularity") >= g.circularity)))
    return judged.where(passes).select("uid", "label", "zone", "area", "circularity")


def vessels_of(foreground: DataFrame, zones: DataFrame, frames: Frames, radius: int, gates: dict[str, Gate] = GATES) -> tuple[DataFrame, DataFrame]:
    """Vessels (uid, label, zone, area, circularity) and their pixels (uid, label, y, x): candidates that pass their
    gate, without those that lie within a larger one."""
    pixels_, rings, shapes = vessel_candidates(foreground, frames, radius, max(1, min(g.area for g in gates.values())))
    passed = written(gated_vessels(rings, shapes, zones, gates))
    own = written(pixels_.join(passed.select("uid", "label"), ["uid", "label"], "left_semi"))
    apart = comp.without_nested(own)
    return passed.join(apart, ["uid", "label"], "left_semi"), own.join(apart, ["uid", "label"], "left_semi")


def reassigned(superpixels: DataFrame, vessel_pixels: DataFrame) -> DataFrame:
    """uid, label, zone of superpixels (uid, label, y, x, zone): those under a vessel (uid, y, x, vessel_zone, area) take its zone, the smallest vessel's where several."""
    under = superpixels.join(vessel_pixels, ["uid", "y", "x"]).groupBy("uid", "label").agg(F.min(F.struct("area", "vessel_zone"))["vessel_zone"].alias("taken"))
    own = superpixels.groupBy("uid", "label").agg(F.min("zone").alias("zone"))
    return own.join(under, ["uid", "label"], "left").select("uid", "label", F.coalesce("taken", "zone").alias("zone"))


def gap_closed_instances(barriers: DataFrame, frames: Frames, most: int = 4) -> DataFrame:
    """uid, y, x, label: regions that barriers enclose, after growing and closing them by the first
    radius of 1 to ``most`` that leaves any, for each slide on its own. A slide that has none at any radius has no rows."""
    spark = barriers.sparkSession
    found, left = None, written(runs.runs_of(barriers))
    for radius in range(1, most + 1):
        grown = tiles.dilated(tiles.packed_runs(left, ["uid"]), radius)
        wall = written(runs.joined_runs(runs.clipped(tiles.runs_in(tiles.closed(grown, radius)), frames)))
        new = written(runs.holes(wall, frames))
        found = new if found is None else found.unionByName(new)
        rest = written(left.join(new.select("uid").distinct(), "uid", "left_anti"))
        removed(spark, left, wall)
        left = rest
        if not left.limit(1).count():
            break
    return runs.pixels_of(found).select("uid", "y", "x", "label")
