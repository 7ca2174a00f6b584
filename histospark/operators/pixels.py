"""Pixel projections, filters and scalar maths. Keys name an image (slide, level, channel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histospark.operators.hist import percentiles


def channel_axis(sizes: Column) -> Column:
    """Index of the channel axis: the first axis of at most 64 that is smaller than all others, else the first smallest."""
    small = F.array_min(sizes)
    first = F.array_position(sizes, small) - 1
    return F.when(F.size(sizes) < 3, F.lit(-1).cast("long")).otherwise(first)


def wide(pixels: DataFrame, channels: list[int], keys: list[str]) -> DataFrame:
    """One row per pixel with a column c<channel> for each of the chosen channels."""
    return pixels.where(F.col("channel").isin(channels)).groupBy(*keys, "y", "x").pivot("channel", channels).agg(F.first("value")).withColumnsRenamed({str(c): f"c{c}" for c in channels})


def three_channels(pixels: DataFrame, channels: list[int], keys: list[str]) -> DataFrame:
    """``wide`` of exactly three channels that every image has; raises where one hasn't."""
    if len(set(channels)) != 3:
        raise ValueError(f"three channels are needed, not {len(set(channels))}")
    lacking = pixels.groupBy(*keys).agg(F.count_distinct(F.when(F.col("channel").isin(channels), F.col("channel"))).alias("n")).where("n < 3")
    if lacking.limit(1).count():
        raise ValueError("an image lacks one of the three channels")
    return wide(pixels, channels, keys)


def by_depth(value: Column, bits: Column) -> Column:
    """Integers divided by the largest value of their bit depth."""
    return value / (F.pow(F.lit(2.0), bits) - 1)


def unit_range(df: DataFrame, keys: list[str], value: str = "value", over: float = 1.5) -> DataFrame:
    """Adds ``unit``: values of images whose 99th percentile exceeds ``over`` are stretched from the 1st
    to the 99th percentile; others stand; all are clipped to [0, 1]."""
    p = percentiles(df, keys, value, [0.01, 0.99])
    v, lo, hi = F.col(value), F.col("p1"), F.col("p99")
    unit = F.when((hi > over) & (hi > lo), (v - lo) / (hi - lo)).otherwise(v)
    return df.join(p, keys).withColumn("unit", F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit))).drop("p1", "p99")


def gray8(pixels: DataFrame, keys: list[str], bits: int = 8) -> DataFrame:
    """Mean of the channels, scaled to bytes and truncated."""
    return pixels.groupBy(*keys, "y", "x").agg(F.floor(F.least(F.lit(1.0), F.avg(by_depth(F.col("value"), F.lit(bits)))) * 255 + 1e-9).cast("long").alias("gray"))


def channel_mean(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, mean: the mean of the channels in single precision; an image of one channel is itself."""
    return pixels.groupBy(*keys, "y", "x").agg(F.avg(F.col("value").cast("double")).cast("float").alias("mean"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor(r * 0.299 + g * 0.587 + b * 0.114 + 0.5).cast("long")


def minmax8(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Adds ``byte``: each image's range stretched to 0..255 and truncated; a constant image is 0."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    byte = F.when(F.col("hi") <= F.col("lo"), 0).otherwise(F.floor((F.col(value) - F.col("lo")) * 255 / (F.col("hi") - F.col("lo"))))
    return df.join(ends, keys).withColumn("byte", byte.cast("long")).drop("lo", "hi")


def max_projection(pixels: DataFrame, keys: list[str], stretch: bool = False) -> DataFrame:
    """The greatest value over channels; with ``stretch``, of each channel's range stretched to [0, 1]."""
    if not stretch:
        return pixels.groupBy(*keys, "y", "x").agg(F.max("value").alias("value"))
    ends = pixels.groupBy(*keys, "channel").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    unit = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return pixels.join(ends, [*keys, "channel"]).groupBy(*keys, "y", "x").agg(F.max(unit).alias("value"))


def stretch99(df: DataFrame, keys: list[str], value: str = "value", low: bool = False) -> DataFrame:
    """Adds ``stretched``: value over the 99th percentile (else the maximum, else 1), or the range from the 1st to it; clipped to [0, 1]."""
    p = percentiles(df, keys, value, [0.01, 0.99]).join(df.groupBy(*keys).agg(F.min(value).alias("mn"), F.max(value).alias("mx")), keys)
    v = F.col(value)
    if low:
        lo, hi = F.when(F.col("p99") > F.col("p1"), F.col("p1")).otherwise(F.col("mn")), F.when(F.col("p99") > F.col("p1"), F.col("p99")).otherwise(F.col("mx"))
        out = F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0)
    else:
        out = v / F.when(F.col("p99") > 0, F.col("p99")).when(F.col("mx") > 0, F.col("mx")).otherwise(1.0)
    return df.join(p, keys).withColumn("stretched", F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))).drop("p1", "p99", "mn", "mx")


def tinted(stretched: Column, colour: Column) -> Column:
    return F.transform(colour, lambda c: F.floor(stretched * c).cast("long"))


def inverted(pixels: DataFrame, channels: list[int], top: float = 255) -> DataFrame:
    """The chosen channels turned round: top - value."""
    return pixels.withColumn("value", F.when(F.col("channel").isin(channels), top - F.col("value")).otherwise(F.col("value")))


def masked(pixels: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """Values outside the mask (rows keys, y, x) become 0. A stored mask is a byte a pixel, too little to tell its size by, so it is merged."""
    inside = mask.select(*keys, "y", "x", F.lit(1).alias("inside")).hint("merge")
    return pixels.join(inside, [*keys, "y", "x"], "left").withColumn("value", F.col("value") * F.coalesce("inside", F.lit(0))).drop("inside")


def cropped(df: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows inside each image's half-open box (y0, x0, y1, x1); images without a box go."""
    return df.join(boxes, keys).where("y >= y0 and y < y1 and x >= x0 and x < x1").drop("y0", "x0", "y1", "x1")


def scaled_box(boxes: DataFrame, shapes: DataFrame, key: str = "uid") -> DataFrame:
    """Boxes (uid, level, y0, x0, y1, x1) mapped to every level of level_shapes(uid, level, h, w), rounded half to even and clipped."""
    own = shapes.select(key, "level", F.col("h").alias("from_h"), F.col("w").alias("from_w"))
    to = shapes.select(key, F.col("level").alias("to_level"), "h", "w")
    scale = lambda c, a, b: F.greatest(F.lit(0.0), F.least(F.col(a).cast("double"), F.rint(F.col(c) * F.col(a) / F.col(b)))).cast("long")
    joined = boxes.join(own, [key, "level"]).join(to, key)
    return joined.select(key, F.col("to_level").alias("level"), scale("y0", "h", "from_h").alias("y0"), scale("x0", "w", "from_w").alias("x0"), scale("y1", "h", "from_h").alias("y1"), scale("x1", "w", "from_w").alias("x1"))


def padded(df: DataFrame, pad: int) -> DataFrame:
    """Shifts pixels by the border's width; absent rows are the zero border."""
    return df.withColumns({"y": F.col("y") + pad, "x": F.col("x") + pad})


def common_crop(df: DataFrame, keys: list[str]) -> DataFrame:
    """Crops all images to the least height and width among them."""
    least = df.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).agg(F.min("h").alias("h"), F.min("w").alias("w"))
    return df.join(least).where("y < h and x < w").drop("h", "w")


def suppressed(value: Column, background: float, strict: bool = False) -> Column:
    """Values up to the background (or below it, if strict) become 0."""
    return F.when(value < background if strict else value <= background, 0).otherwise(value)


def normalised_nonzero(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Adds ``byte``: value over the 99th percentile of the values above 0 (255 where there is none), times 255, clipped and truncated."""
    p = df.groupBy(*keys).agg(F.coalesce(F.percentile(F.when(F.col(value) > 0, F.col(value)), 0.99), F.lit(255.0)).alias("p"))
    return df.join(p, keys).withColumn("byte", F.floor(F.least(F.lit(255.0), F.col(value) / F.col("p") * 255) + 1e-9).cast("long")).drop("p")


def without_background(pixels: DataFrame, background: DataFrame, keys: list[str], top: int = 255) -> DataFrame:
    """value less its channel's background, not below 0, clipped and truncated."""
    rest = F.floor(F.least(F.lit(float(top)), F.greatest(F.col("value") - F.col("background"), F.lit(0.0)))).cast("long")
    return pixels.join(background, keys).withColumn("value", rest).drop("background")


def kept_channels(pixels: DataFrame, least: float, blank: int = 255) -> DataFrame:
    """channel, share, new_channel of channels whose share of values other than ``blank`` is at least ``least``, numbered afresh."""
    from pyspark.sql import Window

    share = pixels.groupBy("channel").agg(F.avg((F.col("value") != blank).cast("double")).alias("share")).where(F.col("share") >= least)
    return share.withColumn("new_channel", (F.row_number().over(Window.orderBy("channel")) - 1).cast("long"))  # one row per channel


def kept_roles(kept: DataFrame, roles: dict[str, list[int]]) -> dict[str, list[int]]:
    """The channels of each role by their new numbers, without those that were dropped; raises where no role keeps any.

    kept (channel, new_channel) holds one row for each channel of an image.
    """
    new = {r["channel"]: r["new_channel"] for r in kept.select("channel", "new_channel").collect()}
    out = {role: [new[c] for c in channels if c in new] for role, channels in roles.items()}
    if not any(out.values()):
        raise ValueError("all channels of all roles were dropped")
    return out


def tile_grid(shapes: DataFrame, side: int) -> DataFrame:
    """The tiles that cover each image of (keys, h, w): adds ty, tx, y0, x0, th, tw; those at the end are cut."""
    steps = lambda c: F.explode(F.sequence(F.lit(0), F.floor((F.col(c) - 1) / side).cast("int")))
    tiles = shapes.withColumn("ty", steps("h")).withColumn("tx", steps("w"))
    return tiles.withColumns({"y0": F.col("ty") * side, "x0": F.col("tx") * side}).withColumns({"th": F.least(F.lit(side), F.col("h") - F.col("y0")), "tw": F.least(F.lit(side), F.col("w") - F.col("x0"))})


def mapped_points(df: DataFrame, scale: float, dy: float, dx: float, pad: int = 0) -> DataFrame:
    """Points of a padded region in coordinates of the base image, truncated to integers."""
    to = lambda c, d: ((F.col(c) - pad) * scale + d).cast("int").cast("long")
    return df.withColumns({"y": to("y", dy), "x": to("x", dx)})


def first_three(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, r, g, b: the first three channels; of two, their maximum is the third; one stands for all three."""
    rows = pixels.where(F.col("channel").between(0, 2)).groupBy(*keys, "y", "x").agg(*[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(n) for c, n in enumerate("rgb")])
    return rows.select(*keys, "y", "x", "r", F.coalesce("g", "r").alias("g"), F.coalesce("b", F.greatest("r", "g")).alias("b"))


def native_rgb(rgb: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """r, g and b as bytes without a stretch by channel: uint8 stands, uint16 is divided by 257, and other
    values by the image's greatest (by 1 where that isn't positive); results are cut off."""
    if kind == "uint8":
        return rgb
    clip = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("long")
    if kind == "uint16":
        return rgb.withColumns({c: clip(F.col(c) / 257) for c in "rgb"})
    greatest = rgb.groupBy(*keys).agg(F.max(F.greatest("r", "g", "b")).alias("_top"))
    top = F.when(F.col("_top") > 0, F.col("_top")).otherwise(1)
    return rgb.join(greatest, keys).withColumns({c: clip(F.col(c) / top * 255) for c in "rgb"}).drop("_top")


def mask_bytes(mask: DataFrame, keys: list[str], value: str = "value", on: int = 255) -> DataFrame:
    """Adds ``byte``: values of an image that has none above 1 times ``on``; other images stand."""
    top = mask.groupBy(*keys).agg(F.max(F.col(value).cast("long")).alias("_top"))
    v = F.col(value).cast("long")
    return mask.join(top, keys).withColumn("byte", F.when(F.col("_top") <= 1, v * on).otherwise(v)).drop("_top")
