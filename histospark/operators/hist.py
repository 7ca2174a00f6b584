"""Aggregations, histograms and thresholds, keyed by any columns (a slide, a level, a channel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histospark.operators.quantiles import exact_quantiles


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def product(a: str, b: str) -> Column:
    """The exact product of two longs."""
    return F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")


def otsu(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, threshold: the value that parts each group's histogram with the largest variance between classes.

    Pixels are counted before the shuffle. Ties go to the lowest value; a group of one value gets that
    value less one.
    """
    return otsu_of(histogram(df, keys, value), keys, value)


def otsu_of(h: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same from a histogram (keys, value, n); its windows run over one row per distinct value.

    The variance between classes is n0 * n1 * (mean0 - mean1)^2; products of counts would overflow a long
    from 3e8 pixels on, so the difference of means is taken exactly as decimals and squared in double.
    """
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = h.withColumn("w", F.sum("n").over(run)).withColumn("s", F.sum(F.col("n") * F.col(value)).over(run))
    h = h.withColumn("wt", F.sum("n").over(whole)).withColumn("st", F.sum(F.col("n") * F.col(value)).over(whole))
    parted = F.pow((product("s", "wt") - product("st", "w")).cast("double"), F.lit(2)) / (F.col("w").cast("double") * (F.col("wt") - F.col("w")))
    scored = h.withColumn("between", F.when(F.col("w") < F.col("wt"), parted))
    best = scored.groupBy(*keys).agg(F.max(F.struct(F.col("between").alias("b"), (-F.col(value)).alias("v"))).alias("best"), F.max(value).alias("top"))
    return best.select(*keys, F.when(F.col("best.b").isNotNull(), -F.col("best.v")).otherwise(F.col("top") - 1).alias("threshold"))


def multi_otsu(df: DataFrame, keys: list[str], value: str, low: int = 0, high: int = 255) -> DataFrame:
    """keys, t1, t2: the pair of thresholds that parts the histogram in three classes of largest variance between them.

    Pairs of values of one group's histogram (at most high - low + 1 rows) are joined; ties go to the least pair.
    """
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = histogram(df.where(F.col(value).between(low, high)), keys, value)
    h = h.withColumn("w", F.sum("n").over(run)).withColumn("s", F.sum(F.col("n") * F.col(value)).over(run)).withColumn("wt", F.sum("n").over(whole)).withColumn("st", F.sum(F.col("n") * F.col(value)).over(whole))
    a = h.select(*keys, F.col(value).alias("t1"), F.col("w").alias("w1"), F.col("s").alias("s1"))
    b = h.select(*keys, F.col(value).alias("t2"), F.col("w").alias("w2"), F.col("s").alias("s2"), "wt", "st")
    pairs = a.join(b, keys).where("t1 < t2 and w2 < wt")
    part = lambda s, w: F.pow(s.cast("double"), F.lit(2)) / w
    score = part(F.col("s1"), F.col("w1")) + part(F.col("s2") - F.col("s1"), F.col("w2") - F.col("w1")) + part(F.col("st") - F.col("s2"), F.col("wt") - F.col("w2"))
    best = pairs.groupBy(*keys).agg(F.max(F.struct(F.round(score, 6).alias("b"), (-F.col("t1")).alias("a"), (-F.col("t2")).alias("c"))).alias("best"))
    return best.select(*keys, (-F.col("best.a")).alias("t1"), (-F.col("best.c")).alias("t2"))


def three_classes(df: DataFrame, thresholds: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds label: how many of the group's two thresholds lie below or at the value."""
    return df.join(thresholds, keys).withColumn("label", (F.col(value) >= F.col("t1")).cast("long") + (F.col(value) >= F.col("t2")).cast("long"))


def class_means(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def bimodal(classed: DataFrame, keys: list[str], least_share: float = 0.05, least_gap: float = 0.1) -> DataFrame:
    """keys, bimodal, middle_share, gap: the middle class is small, or the thresholds lie close together."""
    out = classed.groupBy(*keys).agg(F.avg((F.col("label") == 1).cast("double")).alias("middle_share"), F.max(F.col("t2") - F.col("t1")).alias("gap"))
    return out.withColumn("bimodal", (F.col("middle_share") < least_share) | (F.col("gap") < least_gap * 255))


def tissue_classes(classed: DataFrame, two_class: DataFrame, keys: list[str], value: str, dark: float = 10.0) -> DataFrame:
    """keys, lowest, bimodal: pixels above ``lowest`` are tissue, and those at it too unless there are two
    modes. Two modes: the Otsu threshold; else all but the darkest class where that isn't black (mean
    over ``dark``), else the brightest class alone."""
    darkest = classed.groupBy(*keys).agg(F.avg(F.when(F.col("label") == 0, F.col(value))).alias("dark_mean"), F.max("t1").alias("t1"), F.max("t2").alias("t2"))
    joined = darkest.join(bimodal(classed, keys), keys).join(two_class, keys)
    return joined.select(*keys, F.when(F.col("bimodal"), F.col("threshold")).when(F.col("dark_mean") > dark, F.col("t1")).otherwise(F.col("t2")).alias("lowest"), "bimodal")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], approximate: bool = False) -> DataFrame:
    """keys and p<percent> columns, exact with linear interpolation, or approximate."""
    names = [f"p{int(round(s * 1000)) / 10:g}".replace(".", "_") for s in shares]
    got = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*map(F.lit, shares)), 10000).alias("p")) if approximate else exact_quantiles(df, keys, value, shares)
    return got.select(*keys, *[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def background_estimate(df: DataFrame, keys: list[str], value: str, bins: int = 512, least_peak: float = 0.02) -> DataFrame:
    """keys, background: the centre of the second of at least three histogram peaks, else of the first.

    The histogram has ``bins`` equal bins from the least value to the 99th percentile (or the next unit, where these
    are equal); values above are left out and the last bin is closed. Peaks are bins higher than the one before and
    not lower than the one after; the first and the last need only not be lower than their one neighbour. Of these,
    peaks of at least ``least_peak`` of the highest bin count. Without any peak it is the 5th percentile, without one that counts the median.
    """
    range_ = df.groupBy(*keys).agg(F.min(value).cast("double").alias("lo")).join(percentiles(df, keys, value, [0.05, 0.5, 0.99]), keys)
    range_ = range_.select(*keys, "lo", F.when(F.col("p99") > F.col("lo"), F.col("p99")).otherwise(F.col("lo") + 1).alias("hi"), F.col("p50").alias("mid"), "p5")
    binned = df.join(range_, keys).where(F.col(value) <= F.col("hi"))
    binned = binned.groupBy(*keys, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = range_.where("lo is not null").select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    order = Window.partitionBy(*keys).orderBy("bin")
    full = every.join(binned, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    full = full.withColumns({"before": F.lag("n").over(order), "after": F.lead("n").over(order), "top": F.max("n").over(Window.partitionBy(*keys))})
    inside = (F.col("n") > F.col("before")) & (F.col("n") >= F.col("after"))
    peaks = full.where(F.when(F.col("before").isNull(), F.col("n") >= F.col("after")).when(F.col("after").isNull(), F.col("n") >= F.col("before")).otherwise(inside))
    found = peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    peaks = peaks.where(F.col("n") >= F.col("top") * least_peak)
    peaks = peaks.withColumn("rank", F.row_number().over(order)).withColumn("peaks", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    chosen = peaks.where(F.col("rank") == F.when(F.col("peaks") >= 3, 2).otherwise(1)).select(*keys, (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("centre"))
    both = range_.join(found, keys, "left").join(chosen, keys, "left")
    return both.select(*keys, F.coalesce("centre", F.when(F.col("found") > 0, F.col("mid")).otherwise(F.col("p5")), F.lit(0.0)).alias("background"))


def equal_bins(df: DataFrame, keys: list[str], value: str, bins: int = 50) -> DataFrame:
    """keys, bin, n: counts in equal bins between each group's least and greatest value; the last bin is closed."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))))).otherwise(0)
    return df.join(ends, keys).groupBy(*keys, at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def bounding_box(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y0, x0, y1, x1 (half-open) of all rows."""
    return df.groupBy(*keys).agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"))


def signal_share(df: DataFrame, keys: list[str], value: Column, least: float) -> DataFrame:
    """keys, share of pixels with a signal, and whether the region is foreground."""
    return df.groupBy(*keys).agg(F.avg((value > 0).cast("double")).alias("share")).withColumn("foreground", F.col("share") > least)


def dark_share(df: DataFrame, keys: list[str], value: str, threshold: float, least: float, image: list[str], foreground: str = "true") -> DataFrame:
    """keys, dark_share, dark: the share of a region's pixels at or below a threshold scaled to the
    image's value range. Regions outside the ``foreground`` (an expression) are never dark.

    The 99.5th percentile of the image's foreground tells the range: up to 1.5 the threshold is
    divided by 255, above 255 it is scaled by percentile / 255; an image without foreground keeps it.
    """
    p = percentiles(df.where(foreground), image, value, [0.995]).withColumnRenamed("p99_5", "p")
    t = F.when(F.col("p") <= 1.5, F.lit(threshold) / 255).when(F.col("p") > 255, F.lit(threshold) * F.col("p") / 255).otherwise(F.lit(threshold))
    share = F.avg((F.col(value) <= t).cast("double")).alias("dark_share")
    return df.withColumn("_front", F.expr(foreground)).join(p, image, "left").groupBy(*keys).agg(share, F.bool_and("_front").alias("_front")).withColumn("dark", (F.col("dark_share") >= least) & F.col("_front")).drop("_front")


def lifted(df: DataFrame, filtered: str, raw: str) -> Column:
    """The filtered mean, or the raw one times 255 where filtering left nothing of a signal."""
    return F.when((F.col(filtered) == 0) & (F.col(raw) > 0), F.col(raw) * 255).otherwise(F.col(filtered))
