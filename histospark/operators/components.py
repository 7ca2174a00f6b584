"""Connected components of pixels, and what is built on them.

Pixels become runs, in which regions are found (``runs``), and the results pixels again. Labels are
the least place (y * WIDE + x) of the component, so they don't depend on how the image is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histospark.operators import runs
from histospark.operators.iterate import removed, written
from histospark.operators.runs import WIDE, Frames, pixels_of, runs_of
from histospark.operators.stencil import CROSS, neighbours

__all__ = ["WIDE", "areas", "border_connected", "filled", "frame_edge", "holes", "holes_of_largest", "inner_regions", "labelled", "largest", "shapes_of", "without_nested", "without_small", "without_small_holes"]


def labelled(mask: DataFrame, key: str = "uid", eight: bool = False, tile: int = 1024) -> DataFrame:
    """key, y, x, label for the rows (key, y, x) of a mask."""
    return pixels_of(runs.labelled(runs_of(mask, key), key, eight, tile)).select(key, "y", "x", "label")


def frame_edge(df: DataFrame, frames: Frames, key: str = "uid") -> DataFrame:
    """Rows at the edge of their slide's frame."""
    at = df.join(runs.frames_of(df, frames, key), key)
    return at.where("y = 0 or x = 0 or y = h - 1 or x = w - 1").drop("h", "w")


def border_connected(mask: DataFrame, frames: Frames, key: str = "uid", eight: bool = False) -> DataFrame:
    """Labelled pixels of the components that touch the image's edge."""
    return pixels_of(runs.border_connected(runs_of(mask, key), frames, key, eight)).select(key, "y", "x", "label")


def holes(mask: DataFrame, frames: Frames, key: str = "uid") -> DataFrame:
    """Labelled false pixels that no 4-path connects with the edge."""
    return pixels_of(runs.holes(runs_of(mask, key), frames, key)).select(key, "y", "x", "label")


def filled(mask: DataFrame, frames: Frames, key: str = "uid") -> DataFrame:
    return pixels_of(runs.filled(runs_of(mask, key), frames, key)).select(key, "y", "x")


def areas(labels: DataFrame, key: str = "uid") -> DataFrame:
    return labels.groupBy(key, "label").agg(F.count(F.lit(1)).alias("area"))


def without_small(mask: DataFrame, least: int, key: str = "uid", eight: bool = False) -> DataFrame:
    """Labelled pixels of the components of at least ``least`` pixels."""
    return pixels_of(runs.of_least_area(runs.labelled(runs_of(mask, key), key, eight), least, key)).select(key, "y", "x", "label")


def without_small_holes(mask: DataFrame, least: int, frames: Frames, key: str = "uid") -> DataFrame:
    """The mask with holes of fewer than ``least`` pixels filled."""
    return pixels_of(runs.without_small_holes(runs_of(mask, key), least, frames, key)).select(key, "y", "x")


def largest(mask: DataFrame, key: str = "uid", eight: bool = False) -> DataFrame:
    """Pixels of each image's largest component; ties go to the least label."""
    return pixels_of(runs.largest(runs_of(mask, key), key, eight)).select(key, "y", "x", "label")


def holes_of_largest(mask: DataFrame, frames: Frames, key: str = "uid") -> DataFrame:
    """Labelled holes inside the largest component's outline that the mask doesn't cover."""
    body = runs.joined_runs(runs.largest(runs_of(mask, key), key, True), key)
    return pixels_of(runs.holes(body, frames, key)).select(key, "y", "x", "label").join(mask.hint("merge"), [key, "y", "x"], "left_anti")


def shapes_of(labels: DataFrame, key: str = "uid") -> DataFrame:
    """key, label, area, perimeter (edges to other pixels), circularity, box: of each component."""
    like = neighbours(labels, CROSS).join(labels, [key, "y", "x", "label"], "left_semi").groupBy(key, "label").agg(F.count(F.lit(1)).alias("inside"))
    box = labels.groupBy(key, "label").agg(F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"))
    out = box.join(like, [key, "label"], "left").withColumn("perimeter", F.col("area") * 4 - F.coalesce("inside", F.lit(0))).drop("inside")
    return out.withColumn("circularity", 4 * 3.141592653589793 * F.col("area") / F.pow(F.col("perimeter").cast("double"), F.lit(2)))


def without_nested(labels: DataFrame, key: str = "uid") -> DataFrame:
    """key, label of components that aren't nested: in descending area, one is dropped if its centroid
    lies on a pixel of a kept larger one (ties: of lesser label). Decided in rounds: a component is
    settled once all larger ones that hold its centroid are."""
    shape = labels.groupBy(key, "label").agg(F.count(F.lit(1)).alias("area"), F.floor(F.avg("y") + 0.5).alias("y"), F.floor(F.avg("x") + 0.5).alias("x"))
    size = shape.select(key, F.col("label").alias("outer"), F.col("area").alias("outer_area"))
    at = shape.join(labels.withColumnRenamed("label", "outer"), [key, "y", "x"]).join(size, [key, "outer"])
    above = written(at.where("outer <> label and (outer_area > area or (outer_area = area and outer < label))").select(key, "label", "outer"))
    state = written(shape.select(key, "label").join(above.select(key, "label").distinct().withColumn("open", F.lit(True)), [key, "label"], "left").select(key, "label", F.when(F.col("open").isNull(), True).alias("kept")))
    while True:  # the largest unsettled component is settled in each round
        outer = state.select(key, F.col("label").alias("outer"), F.col("kept").alias("outer_kept"))
        told = above.join(outer, [key, "outer"]).groupBy(key, "label").agg(F.max(F.coalesce("outer_kept", F.lit(False)).cast("int")).alias("inside"), F.sum(F.col("outer_kept").isNull().cast("int")).alias("unsettled"))
        joined = state.join(told, [key, "label"], "left")
        new = written(joined.select(key, "label", F.coalesce("kept", F.when(F.col("inside") == 1, False).when(F.col("unsettled") == 0, True)).alias("kept")))
        removed(state.sparkSession, state)
        state = new
        if not state.where("kept is null").limit(1).count():
            break
    removed(above.sparkSession, above)
    return state.where("kept").select(key, "label")


def inner_regions(regions: DataFrame, frames: Frames, excluded: DataFrame, key: str = "uid") -> DataFrame:
    """key, label of regions (labelled pixels) that neither touch the image's edge nor are among the excluded (key, label)."""
    edge = frame_edge(regions, frames, key).select(key, "label").distinct()
    return regions.select(key, "label").distinct().join(edge, [key, "label"], "left_anti").join(excluded, [key, "label"], "left_anti")
