"""Regions as runs: rows (key, y, x0, x1) of true pixels x0 to x1, both included.

A region costs a row for each of its stretches instead of one for each pixel, and the background is
what lies between the runs of an image row. Components: runs are cut at tile columns, each tile's runs
are labelled alone by their overlaps, the labels that meet across tile borders are linked, and the links'
components are found by joins. A label is the least place (y * WIDE + x) of its component.

``frames`` gives each slide's size: a table (key, h, w), as ``pyramid.level_shapes`` makes it for one
level, or one pair (h, w) for all slides of the mask.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histospark.operators.iterate import connected_components, removed, written

#: Images are narrower than this.
WIDE = 1 << 20
Frames = DataFrame | tuple[int, int]


def runs_of(mask: DataFrame, key: str = "uid") -> DataFrame:
    """The runs of pixels (key, y, x); repeated places count once. A window holds one row of an image."""
    at = F.dense_rank().over(Window.partitionBy(key, "y").orderBy("x"))
    return mask.select(key, "y", "x").withColumn("run", F.col("x") - at).groupBy(key, "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("run")


def pixels_of(runs: DataFrame) -> DataFrame:
    """The pixels of runs: x in place of x0 and x1, other columns stay. They look as few as the runs, so joins with them are told to merge."""
    rest = [c for c in runs.columns if c not in ("y", "x0", "x1")]
    return runs.select(*rest, "y", F.explode(F.sequence("x0", "x1")).alias("x")).hint("merge")


def joined_runs(runs: DataFrame, key: str = "uid") -> DataFrame:
    """Runs that touch or overlap made one, as after cutting at tiles or a union of masks."""
    row = Window.partitionBy(key, "y").orderBy("x0", "x1")
    fresh = F.coalesce(F.col("x0") > F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)).cast("int")
    part = runs.select(key, "y", "x0", "x1").withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(key, "y", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def frames_of(rows: DataFrame, frames: Frames, key: str = "uid") -> DataFrame:
    """key, h, w of each slide: the table's, or the given pair for every slide that has a row."""
    if isinstance(frames, DataFrame):
        return frames.select(key, F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w"))
    return rows.select(key).distinct().withColumns({"h": F.lit(frames[0]).cast("long"), "w": F.lit(frames[1]).cast("long")})


def clipped(runs: DataFrame, frames: Frames, key: str = "uid") -> DataFrame:
    """The parts of runs that lie in their slide's frame."""
    at = runs.join(frames_of(runs, frames, key), key).where("y >= 0 and y < h and x1 >= 0 and x0 < w")
    return at.withColumns({"x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", F.col("w") - 1)}).drop("h", "w")


def gaps(runs: DataFrame, frames: Frames, key: str = "uid") -> DataFrame:
    """The background's runs: each slide's frame without the runs. Slides of a table of frames that have no run are background all over."""
    size = frames_of(runs, frames, key)
    inside = clipped(runs.select(key, "y", "x0", "x1"), frames, key).select(key, "y", "x0", "x1")
    # one run beyond the right edge closes each row, empty ones too
    ends = size.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("y"), F.col("w").alias("x0"), F.col("w").alias("x1"))
    row = Window.partitionBy(key, "y").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    between = inside.unionByName(ends).withColumn("from", F.coalesce(F.max("x1").over(row), F.lit(-1)) + 1)
    return between.where("from < x0").select(key, "y", F.col("from").alias("x0"), (F.col("x0") - 1).alias("x1"))


def overlap_roots(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """For runs sorted by (y, x0), the first run of each one's component: runs of neighbouring rows are linked
    where they overlap, grown by ``reach``."""
    wide = 4 * WIDE
    starts, ends, below = y * wide + x0 + 2, y * wide + x1 + 2, (y + 1) * wide + 2
    lo, hi = np.searchsorted(ends, below + x0 - reach, "left"), np.searchsorted(starts, below + x1 + reach, "right")
    many = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(y)), many)
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    root = np.arange(len(y))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def merged(parts: DataFrame, met: DataFrame, key: str = "uid") -> DataFrame:
    """parts with each label (of its key) replaced by the least of those it is linked with, met being (key, label, other)."""
    spark = parts.sparkSession
    met = written(met)
    # an id of the stored row is a node's number: no two labels share one
    ends = written(met.select(key, "label").union(met.select(key, "other")).distinct().withColumn("node", F.monotonically_increasing_id()))
    links = met.join(ends.withColumnRenamed("node", "a"), [key, "label"]).join(ends.toDF(key, "other", "b"), [key, "other"])
    found = connected_components(links)
    names = ends.join(found, "node")
    least = names.groupBy("component").agg(F.min("label").alias("least"))
    renamed = names.join(least, "component").where("least < label").select(key, "label", "least")
    out = written(parts.join(renamed, [key, "label"], "left").withColumn("label", F.coalesce("least", "label")).drop("least"))
    removed(spark, met, ends, found)
    return out


def labelled(runs: DataFrame, key: str = "uid", eight: bool = False, tile: int = 1024) -> DataFrame:
    """key, y, x0, x1, label: the runs, cut at tile columns. Runs of a row must be disjoint; a task holds one tile's runs."""
    spark, reach = runs.sparkSession, int(eight)
    kind = runs.schema[key].dataType.simpleString()
    cut = runs.select(key, "y", "x0", "x1", F.floor(F.col("y") / tile).alias("ty"), F.explode(F.sequence(F.floor(F.col("x0") / tile), F.floor(F.col("x1") / tile))).alias("tx"))
    cut = cut.withColumns({"x0": F.greatest(F.col("x0"), F.col("tx") * tile), "x1": F.least(F.col("x1"), F.col("tx") * tile + tile - 1)})

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x0"], ignore_index=True)
        y, x0 = pdf["y"].to_numpy(), pdf["x0"].to_numpy()
        root = overlap_roots(y, x0, pdf["x1"].to_numpy(), reach)
        return pdf.assign(label=y[root] * WIDE + x0[root])

    parts = written(cut.groupBy(key, "ty", "tx").applyInPandas(label, f"{key} {kind}, y long, x0 long, x1 long, ty long, tx long, label long"))
    other = parts.select(key, "y", "tx", F.col("x0").alias("o0"), F.col("x1").alias("o1"), F.col("label").alias("other"))
    last = parts.where(F.pmod("y", F.lit(tile)) == tile - 1).withColumn("y", F.col("y") + 1)
    down = last.join(other.where(F.pmod("y", F.lit(tile)) == 0), [key, "y", "tx"]).where(f"x0 <= o1 + {reach} and o0 <= x1 + {reach}")
    right = parts.where(F.pmod("x1", F.lit(tile)) == tile - 1).withColumn("tx", F.col("tx") + 1)
    right = right.withColumn("y", F.explode(F.array(*[F.col("y") + d for d in range(-reach, reach + 1)])))
    beside = right.join(other.where(F.pmod("o0", F.lit(tile)) == 0), [key, "y", "tx"])
    pair = [F.least("label", "other").alias("label"), F.greatest("label", "other").alias("other")]
    met = down.select(key, *pair).union(beside.select(key, *pair)).where("label < other").distinct()
    out = merged(parts.drop("ty", "tx"), met, key)
    removed(spark, parts)
    return out


def at_edge(labels: DataFrame, frames: Frames, key: str = "uid") -> DataFrame:
    """key, label of the components that touch their slide's edge."""
    edge = labels.join(frames_of(labels, frames, key), key).where("y = 0 or x0 = 0 or y = h - 1 or x1 = w - 1")
    return edge.select(key, "label").distinct()


def border_connected(runs: DataFrame, frames: Frames, key: str = "uid", eight: bool = False) -> DataFrame:
    """Labelled runs of the components that touch the edge."""
    labels = labelled(runs, key, eight)
    return labels.join(at_edge(labels, frames, key), [key, "label"], "left_semi")


def holes(runs: DataFrame, frames: Frames, key: str = "uid") -> DataFrame:
    """Labelled runs of the background that no 4-path connects with the edge."""
    labels = labelled(gaps(runs, frames, key), key)
    return labels.join(at_edge(labels, frames, key), [key, "label"], "left_anti")


def areas(labels: DataFrame, key: str = "uid") -> DataFrame:
    return labels.groupBy(key, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))


def of_least_area(labels: DataFrame, least: int | str, key: str = "uid", frames: Frames | None = None, small: bool = False) -> DataFrame:
    """Labelled runs of the components of at least ``least`` pixels (``small``: of fewer); an expression may name h and w of the frames."""
    size = areas(labels, key)
    size = size if frames is None else size.join(frames_of(labels, frames, key), key)
    enough = F.expr(f"area >= {least}")
    return labels.join(size.where(~enough if small else enough), [key, "label"], "left_semi")


def filled(runs: DataFrame, frames: Frames, key: str = "uid") -> DataFrame:
    """The runs with all holes filled."""
    return joined_runs(runs.select(key, "y", "x0", "x1").unionByName(holes(runs, frames, key).drop("label")), key)


def without_small_holes(runs: DataFrame, least: int | str, frames: Frames, key: str = "uid") -> DataFrame:
    """The runs with holes of fewer than ``least`` pixels filled."""
    small = of_least_area(holes(runs, frames, key), least, key, frames, small=True)
    return joined_runs(runs.select(key, "y", "x0", "x1").unionByName(small.drop("label")), key)


def largest(runs: DataFrame, key: str = "uid", eight: bool = False) -> DataFrame:
    """Labelled runs of each image's largest component; ties go to the least label."""
    labels = labelled(runs, key, eight)
    best = areas(labels, key).groupBy(key).agg(F.max_by("label", F.struct("area", -F.col("label"))).alias("label"))
    return labels.join(best, [key, "label"], "left_semi")


def largest_or_frame(runs: DataFrame, frames: Frames, key: str = "uid", eight: bool = True) -> DataFrame:
    """key, y, x0, x1: each image's largest component with its holes filled, or its whole frame where it has no run."""
    body = filled(joined_runs(largest(runs, key, eight), key), frames, key)
    size = frames_of(runs, frames, key).join(runs.select(key).distinct(), key, "left_anti")
    zero = F.lit(0).cast("long")
    whole = size.select(key, F.explode(F.sequence(zero, F.col("h") - 1)).alias("y"), zero.alias("x0"), (F.col("w") - 1).alias("x1"))
    return body.select(key, "y", "x0", "x1").unionByName(whole)


def bounding_box(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y0, x0, y1, x1 (half-open) of all runs."""
    return runs.groupBy(*keys).agg(F.min("y").alias("y0"), F.min("x0").alias("left"), (F.max("y") + 1).alias("y1"), (F.max("x1") + 1).alias("right")).select(*keys, "y0", F.col("left").alias("x0"), "y1", F.col("right").alias("x1"))
