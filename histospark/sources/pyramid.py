"""Pyramids of tiles and pixels: build, validate, write, scan, and queries over levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from histospark.operators.iterate import removed, written


def decimated(pixels: DataFrame, levels: list[int]) -> DataFrame:
    """Adds ``level``: level L keeps every 2^L-th row and column."""
    step = F.expr("cast(shiftleft(1, level) as long)")
    at = pixels.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).where((F.col("y") % step == 0) & (F.col("x") % step == 0))
    return at.withColumns({"y": F.expr("y div shiftleft(1, level)"), "x": F.expr("x div shiftleft(1, level)")})


def tiled(pixels: DataFrame, keys: list[str], side: int = 1024) -> DataFrame:
    """Rows of tiles (keys, ty, tx, y0, x0, h, w, data): row-major values of each tile, dense."""
    at = pixels.withColumns({"ty": F.expr(f"cast(y div {side} as int)"), "tx": F.expr(f"cast(x div {side} as int)")})
    got = at.groupBy(*keys, "ty", "tx").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"), F.sort_array(F.collect_list(F.struct("y", "x", "value"))).alias("p"))
    return got.withColumn("data", F.transform("p", lambda p: p["value"].cast("float"))).drop("p")


def untiled(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of dense row-major tiles."""
    at = tiles.select(*keys, "y0", "x0", "w", F.posexplode("data").alias("i", "value"))
    return at.select(*keys, (F.col("y0") + F.expr("i div w")).alias("y"), (F.col("x0") + F.col("i") % F.col("w")).alias("x"), "value")


def validated(tiles: DataFrame, key: str = "uid") -> DataFrame:
    """The tiles, if every image has data and all its levels have the same channels, data type and layout (the
    columns ``dtype`` and ``layout``, where the table has them); raises where one hasn't."""
    if isinstance(tiles.schema["level"].dataType, NullType) or tiles.where("level is null").limit(1).count():
        raise ValueError("a pyramid has a tile of no level")
    same = [c for c in ("dtype", "layout") if c in tiles.columns]
    kinds = [F.sort_array(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in ("channel", *same)]
    levels = tiles.groupBy(key, "level").agg(*kinds, F.min(F.coalesce(F.size("data"), F.lit(0))).alias("least"))
    odd = levels.groupBy(key).agg(F.count_distinct("channel", *same).alias("kinds"), F.min("least").alias("least"), *[F.max(F.size(c)).alias(f"most_{c}") for c in same])
    wrong = " or ".join(["kinds > 1", "least < 1", *[f"most_{c} > 1" for c in same]])
    if odd.where(wrong).limit(1).count():
        raise ValueError("a pyramid has an empty tile, or levels of different channels, data types or layouts")
    return tiles


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Makes the tiles once, checks them, and stores them in the order of slide, level and place: as many files as the
    bytes need, however many slides there are, and a slide's tiles in few of them."""
    made = written(tiles, "tiles")
    order = [c for c in ("uid", "level", "ty", "tx") if c in tiles.columns]
    validated(made).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    removed(tiles.sparkSession, made)


def read_tiles(spark: SparkSession, path: str, uid: object = None, level: int | None = None) -> DataFrame:
    """The stored tiles; a slide or level given here prunes files and parts of files by their least and greatest."""
    out = spark.read.parquet(path)
    out = out if uid is None else out.where(F.col("uid") == uid)
    return out if level is None else out.where(F.col("level") == level)


def levels_of(df: DataFrame, key: str = "uid") -> DataFrame:
    """key, levels in ascending order; of an image without numbered levels (0)."""
    found = F.sort_array(F.collect_set("level"))
    return df.groupBy(key).agg(F.when(F.size(found) == 0, F.array(F.lit(0).cast(df.schema["level"].dataType))).otherwise(found).alias("levels"))


def tile_shapes(tiles: DataFrame, key: str = "uid") -> DataFrame:
    """key, level, h, w from the tiles' places and sizes: a scan of a few columns of a row per tile, without their data."""
    return tiles.groupBy(key, "level").agg(F.max(F.col("y0") + F.col("h")).alias("h"), F.max(F.col("x0") + F.col("w")).alias("w"))


def common_levels(df: DataFrame, key: str = "uid") -> DataFrame:
    """Levels that every image has."""
    n = df.agg(F.count_distinct(key).alias("all"))
    return df.groupBy("level").agg(F.count_distinct(key).alias("n")).join(n).where("n = all").select("level")


def level_shapes(df: DataFrame, key: str = "uid") -> DataFrame:
    """key, level, h, w from places alone."""
    return df.groupBy(key, "level").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def preview_level(df: DataFrame, key: str = "uid") -> DataFrame:
    return df.groupBy(key).agg(F.min("level").alias("level"))


def extreme_level(shapes: DataFrame, key: str = "uid", smallest: bool = True) -> DataFrame:
    """The level of least (or greatest) area; ties go to the least level."""
    area = F.col("h") * F.col("w")
    pick = F.min(F.struct(area.alias("a"), "level")) if smallest else F.max(F.struct(area.alias("a"), (-F.col("level")).alias("level")))
    got = shapes.groupBy(key).agg(pick.alias("m"))
    return got.select(key, F.col("m.level").alias("level") if smallest else (-F.col("m.level")).alias("level"))


def level_or_place(df: DataFrame, wanted: int, key: str = "uid") -> DataFrame:
    """Rows of the wanted level; where an image lacks it, of the level at that place among its sorted levels."""
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy("level")) - 1
    names = df.select(key, "level").distinct().withColumn("rank", rank).withColumn("has", F.max((F.col("level") == wanted).cast("int")).over(Window.partitionBy(key)))
    chosen = names.where(((F.col("has") == 1) & (F.col("level") == wanted)) | ((F.col("has") == 0) & (F.col("rank") == wanted))).select(key, "level")
    return df.join(chosen, [key, "level"], "left_semi")


def nearest_targets(at: str, size: str, to: str) -> Column:
    """Places of 0 to ``to`` - 1 whose nearest place of ``size``, floor(target * size / to), is ``at``; an empty array where none is."""
    low, high = f"({at} * {to} + {size} - 1) div {size}", f"(({at} + 1) * {to} + {size} - 1) div {size} - 1"
    return F.expr(f"case when {high} >= {low} then sequence({low}, {high}) else cast(array() as array<bigint>) end")


def linear_targets(df: DataFrame, at: str, size: str, to: str, name: str) -> DataFrame:
    """The rows once for each target that takes ``at`` as one of its two places: the target as ``name``, its weight as name_w
    and the number of the places that it is as name_n: two at the border, which is repeated."""
    low = f"case when {at} = 0 then 0L else greatest(0L, cast(floor(({at} - 0.5D) * {to} / {size} - 0.5D) as bigint)) end"
    high = f"case when {at} = {size} - 1 then {to} - 1 else least({to} - 1, cast(ceil(({at} + 1.5D) * {to} / {size} - 0.5D) as bigint)) end"
    f = f"greatest(0D, least({size} - 1D, ({name} + 0.5D) * {size} / {to} - 0.5D))"
    first, second = f"(floor({f}) = {at})", f"(least(floor({f}) + 1, {size} - 1) = {at})"
    weight = f"if({first}, 1 - ({f} - floor({f})), 0D) + if({second}, {f} - floor({f}), 0D)"
    rows = df.withColumn(name, F.explode(F.expr(f"case when {high} >= {low} then sequence({low}, {high}) else cast(array() as array<bigint>) end")))
    return rows.where(f"{first} or {second}").withColumns({f"{name}_w": F.expr(weight), f"{name}_n": F.expr(f"int({first}) + int({second})")})


def nearest_resampled(pixels: DataFrame, keys: list[str], h: int, w: int, to_h: int, to_w: int) -> DataFrame:
    """Nearest sampling from h x w to to_h x to_w: target (Y, X) takes floor(Y * h / to_h), floor(X * w / to_w).

    Each source pixel tells which targets it reaches; nothing is shuffled or broadcast."""
    rows = inside(pixels, keys, h, w).withColumn("ty", F.explode(nearest_targets("y", f"{h}L", f"{to_h}L"))).withColumn("tx", F.explode(nearest_targets("x", f"{w}L", f"{to_w}L")))
    return rows.select(*keys, F.col("ty").alias("y"), F.col("tx").alias("x"), *[c for c in pixels.columns if c not in (*keys, "y", "x")])


def bilinear_resampled(pixels: DataFrame, keys: list[str], h: int, w: int, to_h: int, to_w: int) -> DataFrame:
    """Bilinear sampling at pixel centres, with the border repeated. Where one of the four pixels is absent or null, so is the value.

    Each source pixel sends its share to the targets that it reaches, where shares are added up."""
    rows = linear_targets(inside(pixels, keys, h, w).select(*keys, "y", "x", "value"), "y", f"{h}L", f"{to_h}L", "ty")
    both = linear_targets(rows, "x", f"{w}L", f"{to_w}L", "tx")
    places = F.sum(F.when(F.col("value").isNotNull(), F.col("ty_n") * F.col("tx_n")))
    met = both.groupBy(*keys, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.when(places == 4, F.sum(F.col("value") * F.col("ty_w") * F.col("tx_w"))).alias("value"))
    return met.select(*keys, "y", "x", "value")


def inside(pixels: DataFrame, keys: list[str], h: int, w: int) -> DataFrame:
    """Pixels of known keys within h x w, with long coordinates."""
    at = pixels.withColumns({"y": F.col("y").cast("long"), "x": F.col("x").cast("long")})
    return at.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1)).dropna(subset=list(keys))


def size_capped(pixels: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Area means over square blocks, so that the longest side is at most ``longest``."""
    shape = pixels.groupBy(*keys).agg(F.ceil((F.greatest(F.max("y"), F.max("x")) + 1) / longest).cast("long").alias("stride"))
    at = pixels.join(shape, keys)
    return at.groupBy(*keys, F.expr("y div stride").alias("y"), F.expr("x div stride").alias("x")).agg(F.avg("value").alias("value"))


def affine_sampled(pixels: DataFrame, transforms: DataFrame, key: str, h: int, w: int) -> DataFrame:
    """key, y, x, value: each target pixel takes the source pixel that its slide's inverse transform
    (a00, a01, a10, a11, b0, b1) maps it to, rounded half up; targets that leave the image have no row.

    Source pixels meet their slide's transform (one row) and list the targets that may take them: the rows of the
    pixel's image under the opposite transform, or all rows if there is none, and in each the columns that both
    equations leave. What is listed is a little wide and then checked exactly. Transforms that aren't finite give no rows.
    """
    names = ["a00", "a01", "a10", "a11", "b0", "b1"]
    moves = transforms.select(key, *[F.col(n).cast("double").alias(n) for n in names]).where(" and ".join(f"abs({n}) < double('infinity')" for n in names))
    at = pixels.select(key, F.col("y").cast("long").alias("sy"), F.col("x").cast("long").alias("sx"), "value").join(moves, key)
    at = at.withColumns({"det": F.expr("a00 * a11 - a01 * a10"), "py": F.col("sy") - F.col("b0"), "px": F.col("sx") - F.col("b1")})
    regular = "abs(det) > 1e-9D * (abs(a00 * a11) + abs(a01 * a10))"
    middle, reach = "(a11 * py - a01 * px) / det", "(0.5D * (abs(a11) + abs(a01)) + 1e-6D * (abs(det) + abs(a11 * py) + abs(a01 * px))) / abs(det)"
    low, high = (F.expr(f"if({regular}, {middle} {sign} {reach}, {other}D)") for sign, other in (("-", 0), ("+", h - 1)))
    rows = at.withColumn("ty", F.explode(listed(low, high, h)))

    def columns(p: str, by: str, across: str) -> tuple[Column, Column]:
        """The bounds that p - 1/2 <= by * ty + across * tx < p + 1/2 sets to tx."""
        rest, slack = f"({p} - {by} * ty)", f"(0.5D + 1e-6D * (1 + abs({p}) + abs({by} * ty)))"
        none = f"abs({rest}) > {slack}"
        ends = [f"{rest} / {across} {sign} {slack} / abs({across})" for sign in "-+"]
        return F.expr(f"if({across} = 0, if({none}, {w}D, 0D), {ends[0]})"), F.expr(f"if({across} = 0, {w - 1}D, {ends[1]})")

    (l0, h0), (l1, h1) = columns("py", "a00", "a01"), columns("px", "a10", "a11")
    both = rows.withColumn("tx", F.explode(listed(F.greatest(l0, l1), F.least(h0, h1), w)))
    exact = "floor(a00 * ty + a01 * tx + b0 + 0.5) = sy and floor(a10 * ty + a11 * tx + b1 + 0.5) = sx"
    return both.where(exact).select(key, F.col("ty").alias("y"), F.col("tx").alias("x"), "value")


def listed(low: Column, high: Column, size: int) -> Column:
    """The whole numbers from low to high among 0 to size - 1."""
    first, last = F.ceil(F.greatest(low, F.lit(0.0))), F.floor(F.least(high, F.lit(size - 1.0)))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
