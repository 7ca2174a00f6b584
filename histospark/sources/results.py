"""Results of a region back on the slide: rasters pasted at the region's box, sampled to every level, and stored as tiles.

Rasters are sparse: a pixel without a label is background, one without a value is unknown. Each source pixel
tells which target pixels it reaches, so sampling needs neither a grid of all target pixels nor a join with it, and
pixels that no target of a smaller level takes are gone before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from histospark.sources.pyramid import linear_targets, nearest_targets, read_tiles, write_tiles

#: How many pixels of done tiles a task passes on at once.
HELD = 1 << 20


def pasted(labels: DataFrame, boxes: DataFrame, shapes: DataFrame, base: int = 0) -> DataFrame:
    """uid, y, x, label at level ``base`` of labels (uid, y, x, label) found on a raster of ph x pw pixels, which shows
    the half-open box y0, x0, y1, x1 of that level (boxes: uid, ph, pw and the box). Boxes are clipped to the slide; labels of
    0, null or outside ph x pw, and slides without a box, have no rows."""
    full = shapes.where(F.col("level") == base).select("uid", "h", "w")
    cut = boxes.join(full, "uid").select("uid", F.col("ph").cast("long").alias("ph"), F.col("pw").cast("long").alias("pw"), F.greatest(F.lit(0), "y0").cast("long").alias("y0"), F.greatest(F.lit(0), "x0").cast("long").alias("x0"), F.least("h", "y1").cast("long").alias("y1"), F.least("w", "x1").cast("long").alias("x1"))
    sized = cut.where("y1 > y0 and x1 > x0").withColumns({"bh": F.expr("y1 - y0"), "bw": F.expr("x1 - x0")})
    at = labels.where("label <> 0").select("uid", "y", "x", "label").join(sized, "uid").where("y >= 0 and y < ph and x >= 0 and x < pw")
    rows = at.withColumn("ty", F.explode(nearest_targets("y", "ph", "bh")))
    return rows.select("uid", (F.col("y0") + F.col("ty")).alias("y"), "x0", "label", F.explode(nearest_targets("x", "pw", "bw")).alias("tx")).select("uid", "y", (F.col("x0") + F.col("tx")).alias("x"), "label")


def to_levels(rows: DataFrame, shapes: DataFrame, base: int) -> DataFrame:
    """The rows once for each level of their slide, with its size (th, tw) and that of the base level (h, w)."""
    long = lambda c, name: F.col(c).cast("long").alias(name)
    whole = shapes.where(F.col("level") == base).select("uid", long("h", "h"), long("w", "w"))
    each = shapes.select("uid", "level", long("h", "th"), long("w", "tw")).join(whole, "uid")
    return rows.join(each, "uid").where("y >= 0 and y < h and x >= 0 and x < w")


def labels_at_levels(labels: DataFrame, shapes: DataFrame, base: int = 0) -> DataFrame:
    """uid, level, y, x, value: labels (uid, y, x, label) of the base level at every level of shapes (uid, level, h, w), by nearest sampling. No shuffle of pixels."""
    at = to_levels(labels, shapes, base).withColumn("ty", F.explode(nearest_targets("y", "h", "th")))
    return at.select("uid", "level", F.col("ty").alias("y"), F.explode(nearest_targets("x", "w", "tw")).alias("x"), F.col("label").alias("value"))


def values_at_levels(values: DataFrame, shapes: DataFrame, base: int = 0) -> DataFrame:
    """uid, level, y, x, value: values (uid, y, x, value) of the base level at every level, by bilinear sampling at pixel
    centres; a target that one of its four places leaves unknown is unknown."""
    at = to_levels(values.where("value is not null and not isnan(value)").withColumn("value", F.col("value").cast("double")), shapes, base)
    both = linear_targets(linear_targets(at.select("uid", "level", "y", "x", "h", "th", "w", "tw", "value"), "y", "h", "th", "ty"), "x", "w", "tw", "tx")
    met = both.groupBy("uid", "level", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col("value") * F.col("ty_w") * F.col("tx_w")).alias("value"), F.sum(F.col("ty_n") * F.col("tx_n")).alias("n"))
    return met.where("n = 4").drop("n")


def dense_tiles(pixels: DataFrame, shapes: DataFrame, fill: float, kind: str, side: int = 1024) -> DataFrame:
    """Tiles (uid, level, channel, ty, tx, y0, x0, h, w, data, dtype, layout) that cover every level whole, from sparse
    pixels (uid, level, y, x, value); ``fill`` stands where there is none, not a number as null. A task gets its rows tile
    by tile, fills one tile at a time and passes on about ``HELD`` pixels at once, many small tiles or one large one."""
    value, tile = LongType() if kind == "int64" else pixels.schema["value"].dataType, ["uid", "level", "ty", "tx"]
    size = shapes.select("uid", "level", F.col("h").cast("long").alias("lh"), F.col("w").cast("long").alias("lw"))
    own = pixels.join(size, ["uid", "level"]).where("y >= 0 and y < lh and x >= 0 and x < lw and value is not null")
    own = own.select("uid", "level", "lh", "lw", F.expr(f"y div {side}").alias("ty"), F.expr(f"x div {side}").alias("tx"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("value").cast(value).alias("value"))
    none = F.lit(-1).cast("long")  # no place: a row that stands for its tile, so that whole numbers need no null
    grid = size.where("lh > 0 and lw > 0").withColumn("ty", F.explode(F.expr(f"sequence(0L, (lh - 1) div {side})"))).withColumn("tx", F.explode(F.expr(f"sequence(0L, (lw - 1) div {side})")))
    rows = own.unionByName(grid.select("uid", "level", "lh", "lw", "ty", "tx", none.alias("y"), none.alias("x"), F.lit(0).cast(value).alias("value")))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, held, last, data = [], 0, None, np.empty((0, 0))
        columns = [*tile, "y0", "x0", "h", "w", "data"]
        table = lambda: pd.DataFrame(done, columns=columns).assign(channel=0, dtype=kind, layout="YX")
        for pdf in parts:
            if pdf.empty:
                continue
            keys = [pdf[c].to_numpy() for c in tile]
            y, x, v = pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf["value"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
            for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
                key = tuple(k[a] for k in keys)
                if key != last:
                    last, y0, x0 = key, int(key[2]) * side, int(key[3]) * side
                    h, w = min(side, int(pdf["lh"].iat[a]) - y0), min(side, int(pdf["lw"].iat[a]) - x0)
                    if held >= HELD:
                        yield table()
                        done, held = [], 0
                    data, held = np.full((h, w), fill, dtype=kind), held + h * w
                    done.append((*key, y0, x0, h, w, data.ravel()))
                real = y[a:b] >= 0
                data[y[a:b][real] - y0, x[a:b][real] - x0] = v[a:b][real]
        if done:
            yield table()

    name = lambda c: rows.schema[c].dataType.simpleString()
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *tile).sortWithinPartitions(*tile)
    return dealt.mapInPandas(pack, f"uid {name('uid')}, level {name('level')}, ty int, tx int, y0 long, x0 long, h long, w long, data {ArrayType(value).simpleString()}, channel int, dtype string, layout string")


def write_results(labels: DataFrame, portality: DataFrame, shapes: DataFrame, folder: str, base: int = 0, side: int = 1024) -> None:
    """Writes ``folder``/mask and ``folder``/portality: pyramids of all levels from labels (uid, y, x, label) and
    portality (uid, y, x, value) at the base level. Background is 0, unknown portality null. Both are checked for
    the same channels, type and layout at all levels of a slide; labels keep their 64 bits."""
    write_tiles(dense_tiles(labels_at_levels(labels, shapes, base), shapes, 0, "int64", side), f"{folder}/mask")
    write_tiles(dense_tiles(values_at_levels(portality, shapes, base), shapes, float("nan"), "float64", side), f"{folder}/portality")


def read_results(spark: SparkSession, folder: str, uid: object = None, level: int | None = None) -> DataFrame:
    """uid, level, y, x, label, portality where one of them is known; a slide or level given here prunes the scan.
    Both pyramids have the same tiles, so they are joined tile by tile, not pixel by pixel."""
    tile = ["uid", "level", "ty", "tx", "y0", "x0", "h", "w"]
    part = lambda name, of: read_tiles(spark, f"{folder}/{of}", uid, level).select(*tile, F.col("data").alias(name))
    none = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>")).alias(name)
    both = part("label", "mask").join(part("portality", "portality").hint("merge"), tile, "full")
    both = both.select(*tile, F.arrays_zip(none("label", "bigint"), none("portality", "double")).alias("data"))
    at = both.select("uid", "level", "y0", "x0", "w", F.posexplode("data").alias("i", "p"))
    label, portality = F.when(F.col("p.label") != 0, F.col("p.label")).alias("label"), F.when(~F.isnan("p.portality"), F.col("p.portality")).alias("portality")
    return at.select("uid", "level", (F.col("y0") + F.expr("i div w")).alias("y"), (F.col("x0") + F.col("i") % F.col("w")).alias("x"), label, portality).where("label is not null or portality is not null")
