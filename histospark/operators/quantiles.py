"""Exact quantiles of many groups without a group in one task: selection by refinement.

A double's bits are brought into an order-preserving integer. Each round counts, for all groups
together, sixteen more of its high bits among the rows that can still hold a wanted rank, and keeps the
buckets that do; at most four rounds single out the two values next to each quantile. The counts combine
before the shuffle, and no task holds more than the 65,536 buckets of one group's prefix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, LongType

from histospark.operators.iterate import removed, written

STEP = 16
TOP = np.int64(0x7FFFFFFFFFFFFFFF)


@F.pandas_udf(LongType())
def ordered(value: pd.Series) -> pd.Series:
    """Integers in the order of the doubles; -0 is 0, and NaN comes after all others."""
    bits = np.where(np.isnan(value), np.nan, value.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(bits ^ ((bits >> np.int64(63)) & TOP))


@F.pandas_udf(DoubleType())
def from_bits(number: pd.Series) -> pd.Series:
    bits = number.to_numpy(np.int64)
    return pd.Series((bits ^ ((bits >> np.int64(63)) & TOP)).view(np.float64))


def restored(number: str) -> Column:
    """The double of a number that ``ordered`` gave; pandas knows no NaN beside null."""
    return F.when(F.col(number).isNotNull(), F.coalesce(from_bits(number), F.lit(float("nan"))))


def group_of(keys: list[str]) -> Column:
    """All keys as one value, which equals itself where keys are null."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def ranked_values(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """g, n, rank, v: the values at the ranks next to the shares of each group's n values that aren't null."""
    spark = df.sparkSession
    rows = written(df.where(F.col(value).isNotNull()).select(group_of(keys).alias("g"), ordered(F.col(value).cast("double")).alias("o")))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    at = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * F.lit(s)), F.ceil((F.col("n") - 1) * F.lit(s))) for s in shares])))
    wanted = written(sizes.select("g", "n", F.explode(at).alias("rank")).withColumns({"place": F.col("rank"), "prefix": F.lit(0).cast("long")}))
    done = None
    for shift in range(64 - STEP, -1, -STEP):
        above = F.shiftright("o", shift + STEP) if shift + STEP < 64 else F.lit(0).cast("long")
        counts = rows.groupBy("g", above.alias("prefix"), F.shiftright("o", shift).alias("next")).agg(F.count(F.lit(1)).alias("m"), F.min("o").alias("least"), F.max("o").alias("most"))
        run = Window.partitionBy("g", "prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, 0)
        met = wanted.select("g", "n", "rank", "place", "prefix").join(counts.withColumn("upto", F.sum("m").over(run)), ["g", "prefix"])
        met = met.where(F.col("place").between(F.col("upto") - F.col("m"), F.col("upto") - 1))
        new = written(met.select("g", "n", "rank", (F.col("place") - F.col("upto") + F.col("m")).alias("place"), F.col("next").alias("prefix"), F.col("least").alias("low"), F.col("most").alias("high")))
        found = written(new.where("low = high").select("g", "n", "rank", F.col("low").alias("o")))
        done = found if done is None else done.unionByName(found)
        rest = written(new.where("low < high"))
        removed(spark, wanted, new)
        wanted = rest
        if not rest.limit(1).count():
            break
        # only buckets with a wanted rank go on
        fewer = written(rows.withColumn("prefix", F.shiftright("o", shift)).join(rest.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi").select("g", "o"))
        removed(spark, rows)
        rows = fewer
    out = written(done.select("g", "n", "rank", restored("o").alias("v")))
    removed(spark, rows, wanted, done)
    return out


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, p: the quantiles (array<double>) of each group at the shares, with linear interpolation; null for a group
    without values. Whole numbers, as of pixels, have few distinct values and are counted in one aggregate."""
    if isinstance(df.schema[value].dataType, IntegralType):
        return df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("p"))
    held = ranked_values(df, keys, value, shares).groupBy("g").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def between(share: float) -> Column:
        place = (F.col("n") - 1) * F.lit(share)
        low, high = F.floor(place), F.ceil(place)
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)

    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    found = held.select("g", F.array(*map(between, shares)).alias("p"))
    return groups.withColumn("g", group_of(keys)).join(found, "g", "left").drop("g")
