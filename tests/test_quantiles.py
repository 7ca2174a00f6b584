"""Exact quantiles, background levels and pooled errors against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from histospark.operators import hist, quantiles, stats

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.995, 1.0]


def test_bits_keep_the_order(spark):
    values = [-math.inf, -1e308, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 3e300, math.inf, math.nan]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(quantiles.ordered("v").alias("o")).select("o", quantiles.restored("o").alias("v")).collect()
    numbers = [r.o for r in got]
    assert numbers == sorted(numbers) and numbers[4] == numbers[5] and len(set(numbers)) == len(values) - 1
    assert all(r.v == v or (math.isnan(r.v) and math.isnan(v)) for r, v in zip(got, values, strict=True))


def test_quantiles_equal_percentile(spark):
    rng = random.Random(7)
    rows = [("a", rng.gauss(0, 1)) for _ in range(501)] + [("b", math.exp(rng.gauss(0, 40)) * rng.choice([-1, 1])) for _ in range(300)]
    rows += [(None, float(k % 3)) for k in range(40)] + [("one", 2.5), ("none", None), ("none", None), ("tie", 7.0), ("tie", 7.0), ("big", 1e300), ("big", math.inf), ("c", -0.0), ("c", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.p for r in quantiles.exact_quantiles(df, ["k"], "v", SHARES).collect()}
    want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("p")).collect()}
    assert set(got) == set(want) and len(got) == 8
    for k, p in want.items():
        assert got[k] == p or np.allclose(got[k], p, rtol=1e-15, atol=0)
    whole = quantiles.exact_quantiles(df, [], "v", [0.5]).first().p[0]
    assert whole == df.agg(F.percentile("v", 0.5)).first()[0]
    assert quantiles.exact_quantiles(df.where("false"), ["k"], "v", SHARES).count() == 0


def test_no_state_above_the_buckets(spark):
    """All values of a hundred thousand differ, but no aggregate holds more than 65,536 of a group, and rounds end."""
    df = spark.range(100_000).select(F.lit("g").alias("k"), (F.col("id") * 0.1 + 1e-7).alias("v"))
    p = quantiles.exact_quantiles(df, ["k"], "v", [0.25, 0.75]).first().p
    assert np.allclose(p, [99_999 * 0.25 * 0.1 + 1e-7, 99_999 * 0.75 * 0.1 + 1e-7], rtol=1e-12)


def background(values, bins):
    lo, hi = min(values), np.percentile(values, 99)
    hi = hi if hi > lo else lo + 1.0
    n, edges = np.histogram([v for v in values if v <= hi], bins=bins, range=(lo, hi))
    centres = (edges[:-1] + edges[1:]) / 2
    peaks = [i for i in range(bins) if (n[i] >= n[1] if i == 0 else n[i] >= n[-2] if i == bins - 1 else n[i] > n[i - 1] and n[i] >= n[i + 1])]
    if not peaks:
        return float(np.percentile(values, 5))
    high = [i for i in peaks if n[i] >= 0.02 * n.max()]
    return float(np.median(values)) if not high else float(centres[high[1] if len(high) >= 3 else high[0]])


@pytest.mark.parametrize("kind", ["peaks", "constant", "rising", "plateau"])
def test_background_level(spark, kind):
    rng = np.random.default_rng(4)
    values = {"peaks": np.concatenate([np.zeros(50), rng.normal(40, 3, 400), rng.normal(120, 8, 300)]), "constant": np.full(20, 3.0), "rising": np.repeat(np.arange(32.0), np.arange(1, 33)), "plateau": np.tile(np.arange(16.0), 5)}[kind]
    df = spark.createDataFrame([(1, float(v)) for v in values], "k int, v double")
    got = hist.background_estimate(df, ["k"], "v", bins=16).first().background
    assert abs(got - background(values.tolist(), 16)) < 1e-9


def test_errors_are_pooled_over_a_family(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, 9.0, None, None, 1.0), (1, 5.0, None, None, 2.0), (2, None, 1.0, 10.0, 4.0), (2, None, 2.0, nan, 4.0), (3, None, None, None, 3.0), (3, None, None, None, inf), (4, nan, 5.0, 5.0, 5.0), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "attempt long, non_rigid_D double, rigid_D double, rigid_late_D double, rigid_TRE double")
    got = {r.attempt: r.error for r in stats.registration_error(df).collect()}
    assert got == {1: 7.0, 2: 2.0, 3: 3.0, 4: inf, 5: inf}
    assert stats.registration_error(df.select("attempt")).where("error < double('inf')").count() == 0
    assert stats.attempt_sizes({"processed": 850, "non_rigid": 3001}, 3) == [{"processed": 850, "non_rigid": 3001}, {"processed": 1275, "non_rigid": 4501}, {"processed": 1912, "non_rigid": 6751}]
