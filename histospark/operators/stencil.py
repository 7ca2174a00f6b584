"""Neighbourhood operators.

Two forms: ``stencil`` deals pixels to tiles, each with a halo of its neighbours' edge strips, and
applies a numpy kernel to one tile at a time (memory is a tile, the shuffle is the image once plus
the strips); ``neighbours`` sends each pixel to the pixels at given offsets, for joins and sums.
Absent pixels are outside the image: windows are cut there.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CROSS = [(0, 1), (1, 0), (0, -1), (-1, 0)]
RING = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def neighbours(df: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each row once for every offset: y, x are moved; from_y, from_x tell whence. As the optimizer doesn't know how many rows
    these are, joins with them are told to merge: pixels are never broadcast."""
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    out = df.withColumns({"from_y": F.col("y"), "from_x": F.col("x")}).withColumn("move", F.explode(moves))
    return out.withColumns({"y": F.col("from_y") + F.col("move.dy"), "x": F.col("from_x") + F.col("move.dx")}).drop("move").hint("merge")


def stencil(df: DataFrame, keys: list[str], radius: int, kernel: Callable[[np.ndarray], np.ndarray], tile: int = 256, value: str = "value") -> DataFrame:
    """keys, y, x, value: kernel gets a tile with its halo (NaN where no pixel is) and returns the tile; NaN gives no row."""
    if radius > tile:
        raise ValueError("the halo must not be wider than a tile")
    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-radius), F.lit(0), F.lit(radius)), lambda d: F.floor((F.col(c) + d) / tile)))
    dealt = df.select(*keys, "y", "x", F.col(value).cast("double").alias("value"), F.explode(near("y")).alias("ty"), near("x").alias("xs")).withColumn("tx", F.explode("xs")).drop("xs")

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["ty"].iloc[0]) * tile - radius, int(pdf["tx"].iloc[0]) * tile - radius
        side = tile + 2 * radius
        block = np.full((side, side), np.nan)
        block[pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0] = pdf["value"].to_numpy()
        out = kernel(block)
        ys, xs = np.nonzero(~np.isnan(out))
        made = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({"y": ys + y0 + radius, "x": xs + x0 + radius, "value": out[ys, xs]}).assign(**made)[[*keys, "y", "x", "value"]]

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return dealt.groupBy(*keys, "ty", "tx").applyInPandas(apply, f"{kinds}{', ' if keys else ''}y long, x long, value double")


def windows(block: np.ndarray, radius: int) -> np.ndarray:
    """All (2r+1) x (2r+1) windows of the inner tile."""
    return np.lib.stride_tricks.sliding_window_view(block, (2 * radius + 1, 2 * radius + 1))


def inner(block: np.ndarray, radius: int) -> np.ndarray:
    return block[radius : block.shape[0] - radius, radius : block.shape[1] - radius]


def gaussian_weights(sigma: float, radius: int) -> list[float]:
    return [exp(-d * d / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]


def gaussian_kernel(sigma: float) -> tuple[int, Callable[[np.ndarray], np.ndarray]]:
    """Radius and kernel of ``gaussian_blur``."""
    radius = max(1, round(3 * sigma))
    w = np.array(gaussian_weights(sigma, radius))

    def along(a: np.ndarray) -> np.ndarray:
        rows = np.lib.stride_tricks.sliding_window_view(a, 2 * radius + 1, axis=1) @ w
        return np.einsum("ijk,k->ij", np.lib.stride_tricks.sliding_window_view(rows, 2 * radius + 1, axis=0), w)

    def kernel(block: np.ndarray) -> np.ndarray:
        there = ~np.isnan(block)
        total, weight = along(np.where(there, block, 0.0)), along(there.astype(float))
        return np.where(inner(there, radius), total / np.maximum(weight, 1e-12), np.nan)

    return radius, kernel


def gaussian_blur(df: DataFrame, keys: list[str], sigma: float, tile: int = 256) -> DataFrame:
    """Weighted mean over the window of three deviations; weights of absent pixels are left out."""
    radius, kernel = gaussian_kernel(sigma)
    return stencil(df, keys, radius, kernel, max(tile, radius))


def median_kernel(size: int) -> tuple[int, Callable[[np.ndarray], np.ndarray]]:
    """Radius and kernel of ``median_blur``."""
    radius = size // 2

    def kernel(block: np.ndarray) -> np.ndarray:
        there = inner(~np.isnan(block), radius)
        out = np.full(there.shape, np.nan)
        out[there] = np.nanmedian(windows(block, radius)[there].reshape(int(there.sum()), -1), axis=1) if there.any() else []
        return out

    return radius, kernel


def median_blur(df: DataFrame, keys: list[str], size: int = 3, tile: int = 128) -> DataFrame:
    radius, kernel = median_kernel(size)
    return stencil(df, keys, radius, kernel, tile)


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets within the radius, the centre included."""
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


def shifted_any(block: np.ndarray, offsets: list[tuple[int, int]], radius: int) -> np.ndarray:
    side = block.shape[0] - 2 * radius
    out = np.zeros((side, side), dtype=bool)
    for dy, dx in offsets:
        out |= block[radius + dy : radius + dy + side, radius + dx : radius + dx + side]
    return out


def dilating(radius: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda b: np.where(shifted_any(~np.isnan(b), ellipse(radius), radius), 1.0, np.nan)


def eroding(radius: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda b: np.where(~shifted_any(np.isnan(b), ellipse(radius), radius), 1.0, np.nan)


def dilated(mask: DataFrame, keys: list[str], radius: int, tile: int = 256) -> DataFrame:
    """keys, y, x of all places within the radius of a true pixel (rows of mask); places outside the frame included."""
    return stencil(mask.withColumn("value", F.lit(1.0)), keys, radius, dilating(radius), tile).drop("value")


def eroded(mask: DataFrame, keys: list[str], radius: int, tile: int = 256) -> DataFrame:
    """keys, y, x of true pixels whose whole neighbourhood is true; outside the frame is false."""
    return stencil(mask.withColumn("value", F.lit(1.0)), keys, radius, eroding(radius), tile).drop("value")


def closed(mask: DataFrame, keys: list[str], radius: int) -> DataFrame:
    return eroded(dilated(mask, keys, radius), keys, radius)


def closed_zones(zones: DataFrame, keys: list[str], radius: int, zone: str = "PP", over: str = "MID") -> DataFrame:
    """keys, y, x, zone after closing one zone, which takes pixels of one other zone only."""
    grown = closed(zones.where(F.col("zone") == zone).select(*keys, "y", "x"), keys, radius).withColumn("_in", F.lit(True)).hint("merge")
    taken = F.when((F.col("zone") == over) & F.col("_in"), zone).otherwise(F.col("zone"))
    return zones.select(*keys, "y", "x", "zone").join(grown, [*keys, "y", "x"], "left").select(*keys, "y", "x", taken.alias("zone"))


def ring(mask: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """What dilation adds and erosion takes away: the annulus along the border of each keyed region."""
    return dilated(mask, keys, radius).join(eroded(mask, keys, radius).hint("merge"), [*keys, "y", "x"], "left_anti")


def border_rings(regions: DataFrame, background: DataFrame, keys: list[str], radius: int, least: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Holes and rings (keys, label, y, x) made inside regions (keys, label, y, x) that the background cuts open.

    Of a region, at least ``least`` of its pixels must lie in the background (keys, y, x) grown by the
    radius. It is shrunk once, and once more for the hole; the ring is what lies between. Regions
    whose hole or ring is empty have neither.
    """
    own = [*keys, "label"]
    grown = dilated(background, keys, radius).select(*keys, "y", "x", F.lit(1.0).alias("met")).hint("merge")
    share = regions.join(grown, [*keys, "y", "x"], "left").groupBy(*own).agg(F.avg(F.coalesce("met", F.lit(0.0))).alias("share"))
    open_ = regions.join(share.where(F.col("share") >= least), own, "left_semi").select(*own, "y", "x")
    within = eroded(open_, own, radius)
    hole = eroded(within, own, radius)
    rim = within.join(hole.hint("merge"), [*own, "y", "x"], "left_anti")
    names = rim.select(*own).distinct()
    hole = hole.join(names, own, "left_semi")
    return hole, rim.join(hole.select(*own).distinct(), own, "left_semi")


def boundary(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labelled pixels (keys, y, x, label) with an 8-neighbour of another label or none: fewer than 8 like neighbours."""
    near = neighbours(labels, RING).groupBy(*keys, "y", "x", "label").agg(F.count(F.lit(1)).alias("like"))
    return labels.join(near.where("like = 8"), [*keys, "y", "x", "label"], "left_anti")


def label_adjacency(labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b: pairs of labels a < b that meet at a horizontal or vertical border."""
    near = neighbours(labels.withColumnRenamed("label", "other"), [(0, 1), (1, 0)]).drop("from_y", "from_x")
    return labels.join(near, [*keys, "y", "x"]).where("label <> other").select(*keys, F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).distinct()


def label_borders(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels whose right or lower neighbour has another label."""
    near = neighbours(labels.withColumnRenamed("label", "other"), [(0, -1), (-1, 0)]).drop("from_y", "from_x")
    return labels.join(near, [*keys, "y", "x"]).where("label <> other").select(*keys, "y", "x", "label").distinct()


def thinning_kernel(per_round: int) -> tuple[int, Callable[[np.ndarray], np.ndarray]]:
    """Halo and kernel of a round of ``thinned``."""
    radius = 2 * per_round + 2

    def step(block: np.ndarray) -> np.ndarray:
        on = ~np.isnan(block)
        for k in range(2 * per_round):
            p = np.pad(on, 1)
            n = [p[:-2, 1:-1], p[:-2, 2:], p[1:-1, 2:], p[2:, 2:], p[2:, 1:-1], p[2:, :-2], p[1:-1, :-2], p[:-2, :-2]]
            count = sum(x.astype(np.int8) for x in n)
            turns = sum((~n[i] & n[(i + 1) % 8]).astype(np.int8) for i in range(8))
            a, b = (n[0] & n[2] & n[4], n[2] & n[4] & n[6]) if k % 2 == 0 else (n[0] & n[2] & n[6], n[0] & n[4] & n[6])
            on &= ~(on & (count >= 2) & (count <= 6) & (turns == 1) & ~a & ~b)
        return np.where(inner(on, radius), 1.0, np.nan)

    return radius, step


def thinned(mask: DataFrame, keys: list[str], per_round: int = 8, tile: int = 256) -> DataFrame:
    """The Zhang-Suen skeleton. A round runs ``per_round`` pairs of sub-iterations on each tile, whose
    halo of twice as many pixels keeps the inner tile exact, and rounds go on until no pixel goes."""
    from histospark.operators.iterate import removed, written

    radius, step = thinning_kernel(per_round)
    state = written(mask.select(*keys, "y", "x"))
    left = state.count()
    while True:
        new = written(stencil(state.withColumn("value", F.lit(1.0)), keys, radius, step, max(tile, radius)).drop("value"))
        removed(state.sparkSession, state)
        state, now = new, new.count()
        if now == left:
            return state
        left = now


def equalised(df: DataFrame, keys: list[str], grid: int = 16, clip: float = 2.0, value: str = "value", levels: int = 256) -> DataFrame:
    """CLAHE: adds ``byte``. Each image is cut into ``grid`` by ``grid`` cells (the last ones may be
    smaller or absent). A cell's histogram is clipped and what is cut off spread evenly, its cumulative
    form maps values, and a pixel blends the maps of the four nearest cells bilinearly. A map holds the values that its cell
    has, as bits, and the running counts at these: what is spread is the same for every level, so the others follow."""
    v = F.col(value).cast("int")
    cell = lambda c: F.ceil((F.max(c) + 1) / grid).cast("long")
    sizes = df.groupBy(*keys).agg(cell("y").alias("sy"), cell("x").alias("sx"), F.max("y").alias("my"), F.max("x").alias("mx"))
    sizes = sizes.withColumns({"my": F.expr("cast(my div sy as long)"), "mx": F.expr("cast(mx div sx as long)")})
    sized = df.join(sizes, keys)
    here = sized.withColumns({"cy": F.expr("cast(y div sy as long)"), "cx": F.expr("cast(x div sx as long)")}).where("cy >= 0 and cx >= 0")
    counts = here.groupBy(*keys, "cy", "cx", "my", "mx", v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys, "cy", "cx")
    known = F.col("v").between(0, levels - 1)
    counts = counts.withColumn("total", F.sum("n").over(whole)).withColumn("n", F.when(known, F.col("n")).otherwise(0).cast("double"))
    cut = counts.withColumn("kept", F.least("n", F.greatest(F.lit(1.0), F.col("total") * clip / levels)))
    run = cut.withColumn("run", F.sum("kept").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    words = range(-(-levels // 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("v").bitwiseAND(63))
    bits = [F.bit_or(F.when(known & (F.floor(F.col("v") / 64) == w), bit).otherwise(F.lit(0).cast("long"))).alias(f"b{w}") for w in words]
    maps = run.groupBy(*keys, "cy", "cx").agg(F.max("my").alias("my"), F.max("mx").alias("mx"), F.max("total").alias("total"), (F.sum(F.col("n") - F.col("kept")) / levels).alias("spare"), *bits, F.array_sort(F.collect_list(F.when(known, F.struct("v", "run")))).alias("runs"))
    maps = maps.withColumn("runs", F.transform("runs", lambda m: m["run"])).withColumn("map", F.struct("total", "spare", *[f"b{w}" for w in words], "runs"))

    # the pixels between four cells' centres blend the same four maps, so these come to them as one row; beyond the outer centres a cell stands for the absent one too
    def spread(dy: int, dx: int):
        ys, xs = (F.when(F.col(c) == (F.col(m) if d else 0), F.array(F.col(c) - d, F.col(m) if d else F.lit(-1).cast("long"))).otherwise(F.array(F.col(c) - d)) for c, m, d in (("cy", "my", dy), ("cx", "mx", dx)))
        return F.flatten(F.transform(ys, lambda by: F.transform(xs, lambda bx: F.struct(by.alias("by"), bx.alias("bx"), F.lit(2 * dy + dx).alias("slot")))))

    slots = [spread(dy, dx) for dy, dx in ((0, 0), (0, 1), (1, 0), (1, 1))]
    dealt = maps.select(*keys, "map", F.explode(F.concat(*slots)).alias("at")).select(*keys, "at.by", "at.bx", F.struct("at.slot", "map").alias("held"))
    blocks = dealt.groupBy(*keys, "by", "bx").agg(F.array_sort(F.collect_list("held")).alias("held")).where("size(held) = 4")
    placed = sized.withColumns({"fy": F.col("y") / F.col("sy") - 0.5, "fx": F.col("x") / F.col("sx") - 0.5})
    placed = placed.withColumns({"by": F.floor("fy"), "bx": F.floor("fx")}).drop("my", "mx").join(blocks, [*keys, "by", "bx"])
    ty, tx = F.col("fy") - F.col("by"), F.col("fx") - F.col("bx")
    upto = [F.when(v < 64 * w, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.greatest(F.lit(0), 63 + 64 * w - v))) for w in words]

    def to(k: int):
        m = F.col("held")[k]["map"]
        at = sum((F.bit_count(m[f"b{w}"].bitwiseAND(upto[w])) for w in words), F.lit(0))
        return (F.coalesce(F.get(m["runs"], at - 1), F.lit(0.0)) + (v + 1) * m["spare"]) / m["total"] * (levels - 1)

    mixed = (1 - ty) * (1 - tx) * to(0) + (1 - ty) * tx * to(1) + ty * (1 - tx) * to(2) + ty * tx * to(3)
    return placed.where(v.between(0, levels - 1)).withColumn("byte", F.floor(mixed + 0.5).cast("long")).select(*df.columns, "byte")
