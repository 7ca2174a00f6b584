"""Intensity statistics along the portality coordinate, and registration errors."""

from __future__ import annotations

import struct
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histospark.operators.quantiles import exact_quantiles

STATISTICS = ("count", "mean", "std", "min", "max", "p01", "p10", "p50", "p90", "p99")


def edges(bins: int) -> list[float]:
    """Edges of equal bins of [0, 1] in single precision."""
    return [struct.unpack("f", struct.pack("f", k / bins))[0] for k in range(bins + 1)]


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def bin_of(portality: Column, bins: int) -> Column:
    """The bin of a coordinate: edges are in single precision and belong to the right; 1 is in the last bin."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), portality)).cast("float")
    return sum(((p >= F.lit(e).cast("float")).cast("int") for e in edges(bins)[1:-1]), F.lit(0))


def stain_statistics(pixels: DataFrame, stains: list[str], bins: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, stain, bin and the ten statistics; pixels without a finite coordinate are left out, values that aren't finite count as missing."""
    kept = pixels.where(finite(F.col("portality"))).withColumn("bin", bin_of(F.col("portality"), bins))
    long = kept.select(*keys, "bin", *[F.when(finite(F.col(s)), F.col(s)).cast("double").alias(s) for s in stains]).unpivot([*keys, "bin"], stains, "stain", "intensity")
    group = [*keys, "stain", "bin"]
    p = exact_quantiles(long, group, "intensity", [0.01, 0.1, 0.5, 0.9, 0.99])
    out = long.groupBy(*keys, "stain", "bin").agg(F.count("intensity").cast("double").alias("count"), F.avg("intensity").alias("mean"), F.stddev_pop("intensity").alias("std"), F.min("intensity").alias("min"), F.max("intensity").alias("max"))
    same = [out[k].eqNullSafe(p[k]) for k in group]  # keys may be null
    out = out.join(p, same).select(*[out[c] for c in out.columns], p["p"])
    return out.select(*keys, "stain", "bin", "count", "mean", "std", "min", "max", *[F.col("p")[i].alias(n) for i, n in enumerate(STATISTICS[5:])])


def bin_table(spark, bins: int) -> DataFrame:
    e = edges(bins)
    return spark.createDataFrame([(k, e[k], e[k + 1], (e[k] + e[k + 1]) / 2) for k in range(bins)], "bin int, portality_left double, portality_right double, portality_center double")


def long_form(statistics: DataFrame, bins: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per stain, bin and statistic with the bin's left and right edge and centre."""
    long = statistics.unpivot([*keys, "stain", "bin"], list(STATISTICS), "statistic", "value")
    return long.join(bin_table(statistics.sparkSession, bins), "bin", "left")


def portality_statistics(pixels: DataFrame, stains: list[str], bins: int = 10) -> DataFrame:
    """The long summary, sorted by stain and bin."""
    return long_form(stain_statistics(pixels, stains, bins), bins).orderBy("stain", "bin", "statistic")


def mean_and_std(long: DataFrame) -> DataFrame:
    return long.groupBy("stain", "bin").pivot("statistic", ["mean", "std"]).agg(F.first("value"))


def box_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, q1, median, q3, whisker_low, whisker_high, fliers: whiskers end at the last values within 1.5 interquartile ranges."""
    q = exact_quantiles(df.where(finite(F.col(value).cast("double"))), keys, value, [0.25, 0.5, 0.75]).withColumnRenamed("p", "q")
    q = q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    near = df.where(finite(F.col(value).cast("double"))).join(q, keys)
    spread = F.col("q3") - F.col("q1")
    inside = F.col(value).between(F.col("q1") - spread * 1.5, F.col("q3") + spread * 1.5)
    return near.groupBy(*keys, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"), F.count(F.when(~inside, 1)).alias("fliers"))


def box_fliers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows beyond the whiskers, once for each time they occur; values that aren't finite are left out."""
    q = box_statistics(df, keys, value).select(*keys, (F.col("q1") - (F.col("q3") - F.col("q1")) * 1.5).alias("_low"), (F.col("q3") + (F.col("q3") - F.col("q1")) * 1.5).alias("_high"))
    at = df.where(finite(F.col(value).cast("double"))).join(q, keys)
    return at.where(~F.col(value).between(F.col("_low"), F.col("_high"))).select(*df.columns)


def checked_shapes(images: DataFrame, keys: list[str], image: str = "image") -> DataFrame:
    """The pixels (keys, image, y, x), if all images of a slide have one height and width; raises where they haven't."""
    sizes = images.groupBy(*keys, image).agg(F.max("y").alias("h"), F.max("x").alias("w"))
    if sizes.groupBy(*keys).agg(F.count_distinct("h", "w").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("images of one slide differ in shape")
    return images


def violin_density(df: DataFrame, keys: list[str], value: str, points: int = 100) -> DataFrame:
    """keys, point, at, density: a Gaussian kernel density on equal points between the least and greatest value.

    The bandwidth is Scott's. Equal values are counted first, so the kernel sum runs over distinct
    values per group and grid point; groups of fewer than two distinct values have none.
    """
    counted = df.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    weighted = lambda e: F.sum(F.col("n") * e)
    shape = counted.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"), (weighted(F.col("v")) / F.sum("n")).alias("mu"))
    spread = counted.join(shape, keys).groupBy(*keys, "lo", "hi", "total").agg((F.sum(F.col("n") * F.pow(F.col("v") - F.col("mu"), F.lit(2))) / (F.first("total") - 1)).alias("var"))
    width = F.sqrt("var") * F.pow(F.col("total").cast("double"), F.lit(-0.2))
    grid = spread.where("hi > lo").select(*keys, "total", width.alias("h"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1))).alias("point", "at"))
    kernel = F.exp(-0.5 * F.pow((F.col("at") - F.col("v")) / F.col("h"), F.lit(2))) * F.col("n")
    return counted.join(grid, keys).groupBy(*keys, "point", "at").agg((F.sum(kernel) / (F.first("total") * F.first("h") * sqrt(2 * 3.141592653589793))).alias("density"))


#: Families of error columns in the order of preference: what a name starts and ends with.
FAMILIES = (("non_rigid", "D"), ("non_rigid", "TRE"), ("rigid", "D"), ("rigid", "TRE"))


def registration_error(attempts: DataFrame, families: tuple[tuple[str, str], ...] = FAMILIES, key: str = "attempt") -> DataFrame:
    """key, error: the median of all finite values in the columns of the first family that an attempt has, by name, else infinity.

    An attempt has the columns in which one of its values isn't null; NaN and infinities are values that aren't finite.
    """
    of: dict[str, int] = {}
    for k, (start, end) in enumerate(families):
        of.update({c: k for c in attempts.columns if c != key and c not in of and c.startswith(start) and c.endswith(end)})
    every = attempts.select(key).distinct()
    if not of:
        return every.withColumn("error", F.lit(float("inf")))
    place = F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("name"))
    long = attempts.select(key, *[F.col(c).cast("double").alias(c) for c in of]).unpivot(key, list(of), "name", "error").where("error is not null").withColumn("family", place)
    first = long.groupBy(key).agg(F.min("family").alias("family"))
    pooled = long.join(first, [key, "family"]).where(finite(F.col("error")))
    median = exact_quantiles(pooled, [key], "error", [0.5]).select(key, F.col("p")[0].alias("error"))
    return every.join(median, key, "left").select(key, F.coalesce("error", F.lit(float("inf"))).alias("error"))


def attempt_sizes(first: dict[str, int], attempts: int, factor: float = 1.5) -> list[dict[str, int]]:
    """The dimensions of each attempt: the first as given, each other ``factor`` times those before, rounded down."""
    out = [dict(first)]
    while len(out) < attempts:
        out.append({k: int(v * factor) for k, v in out[-1].items()})
    return out[:attempts]


def best_attempt(errors: DataFrame, passing: float = 5.0, key: str = "attempt") -> DataFrame:
    """The one attempt that is kept: the lowest finite error among attempts up to the first that passes."""
    order = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)  # one row per attempt
    tried = errors.withColumn("passed", F.coalesce(F.max(F.col("error") <= passing).over(order), F.lit(False))).where("not passed")
    return tried.where(F.col("error") < float("inf")).agg(F.min(F.struct("error", key)).alias("b")).select(F.col(f"b.{key}").alias(key), F.col("b.error").alias("error"))
