"""Queries of statistics, histograms and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from histospark.operators import hist, stats
from histospark.plans.registry import query
from histospark.sources import tables as t
from histospark.sources.tables import PIXELS, RASTER, STAT_PIXELS, sql

STAINS = ["stain_0", "stain_1", "stain_2"]
BIN = "(" + " + ".join(f"cast(cast(greatest(0.0, least(1.0, portality)) as float) >= cast({e!r} as float) as int)" for e in stats.edges(10)[1:-1]) + ")"
LONG = f"""kept as (select {BIN} as bin, * from stat_pixels where portality is not null and isfinite(portality)),
melted as (select 'stain_0' as stain, bin, stain_0 as v from kept union all select 'stain_1', bin, stain_1 from kept union all select 'stain_2', bin, stain_2 from kept),
summary as (select stain, bin, cast(count(v) as double) as "count", round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, min(v) as "min", max(v) as "max",
  quantile_cont(v, 0.01) as p01, quantile_cont(v, 0.1) as p10, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.9) as p90, quantile_cont(v, 0.99) as p99 from melted group by stain, bin)"""
BINS = "bins(bin, portality_left, portality_right, portality_center) as (values " + ", ".join(f"({k}, {a!r}::double, {b!r}::double, {(a + b) / 2!r}::double)" for k, (a, b) in enumerate(zip(stats.edges(10), stats.edges(10)[1:], strict=False))) + ")"


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def summary(spark, sf_dir):
    return rounded(stats.stain_statistics(t.stat_pixels(spark, sf_dir), STAINS), "mean", "std", "p01", "p10", "p50", "p90", "p99")


MELT = " union all ".join(f"select stain, bin, '{s}' as statistic, round(\"{s}\", 6) as value from summary" for s in stats.STATISTICS)


@query(sql(f"select m.stain, m.bin, m.statistic, m.value, b.portality_left, b.portality_right, b.portality_center from ({MELT}) m left join bins b on m.bin = b.bin", STAT_PIXELS, LONG, BINS))
def portality_stats(spark, sf_dir):
    return rounded(stats.portality_statistics(t.stat_pixels(spark, sf_dir), STAINS), "value")


@query(sql("select stain, bin, mean, std from summary", STAT_PIXELS, LONG))
def stats_pivot(spark, sf_dir):
    return rounded(stats.mean_and_std(stats.long_form(stats.stain_statistics(t.stat_pixels(spark, sf_dir), STAINS))), "mean", "std")


@query(sql("select bin, cast(count(*) as bigint) as n from kept group by bin", STAT_PIXELS, LONG))
def bin_counts(spark, sf_dir):
    kept = t.stat_pixels(spark, sf_dir).where(stats.finite(F.col("portality")))
    return kept.groupBy(stats.bin_of(F.col("portality"), 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


BOX = """q as (select bin, quantile_cont(stain_1, 0.25) as q1, quantile_cont(stain_1, 0.5) as median, quantile_cont(stain_1, 0.75) as q3 from kept group by bin)
"""


@query(sql("""select k.bin, round(any_value(q1), 6) as q1, round(any_value(median), 6) as median, round(any_value(q3), 6) as q3,
  min(stain_1) filter (stain_1 between q1 - (q3 - q1) * 1.5 and q3 + (q3 - q1) * 1.5) as whisker_low, max(stain_1) filter (stain_1 between q1 - (q3 - q1) * 1.5 and q3 + (q3 - q1) * 1.5) as whisker_high,
  cast(count(*) filter (not (stain_1 between q1 - (q3 - q1) * 1.5 and q3 + (q3 - q1) * 1.5)) as bigint) as fliers from kept k join q on k.bin = q.bin group by k.bin""", STAT_PIXELS, LONG, BOX))
def box_stats(spark, sf_dir):
    binned = t.stat_pixels(spark, sf_dir).where(stats.finite(F.col("portality"))).withColumn("bin", stats.bin_of(F.col("portality"), 10))
    return rounded(stats.box_statistics(binned, ["bin"], "stain_1"), "q1", "median", "q3")


@query(sql("""select bin, point, round(g.at_, 6) as "at", round(sum(n * exp(-0.5 * power((g.at_ - v) / h, 2))) / (any_value(total) * any_value(h) * sqrt(2 * 3.141592653589793)), 6) as density
  from (select s.bin, s.total, s.h, p.point, lo + (hi - lo) * p.point / 99 as at_ from
    (select bin, count(*) as total, min(stain_0) as lo, max(stain_0) as hi, stddev_samp(stain_0) * power(count(*), -0.2) as h from kept group by bin) s, (select unnest(range(100)) as point) p) g
  join (select bin as b, stain_0 as v, count(*) as n from kept group by all) c on c.b = g.bin group by bin, point, g.at_""", STAT_PIXELS, LONG))
def violin_density(spark, sf_dir):
    binned = t.stat_pixels(spark, sf_dir).where(stats.finite(F.col("portality"))).withColumn("bin", stats.bin_of(F.col("portality"), 10))
    return rounded(stats.violin_density(binned, ["bin"], "stain_0"), "at", "density").withColumn("point", F.col("point").cast("long"))


#: Each column's family by the start and end of its name; rigid_D and rigid_extra_D are one.
ERRORS = """told as (select attempt, 0 as family, non_rigid_D as error from attempts union all select attempt, 1, non_rigid_TRE from attempts union all select attempt, 2, rigid_D from attempts union all select attempt, 2, rigid_extra_D from attempts union all select attempt, 3, rigid_TRE from attempts),
kinds as (select attempt as f, min(family) as m from told where error is not null group by attempt),
errors as (select u.attempt, coalesce(quantile_cont(k.error, 0.5), 'inf'::double) as error from (select distinct attempt from attempts) u left join kinds on f = u.attempt left join told k on k.attempt = u.attempt and k.family = m group by u.attempt)"""


@query(sql("select attempt, round(error, 9) as error from errors", t.ATTEMPTS, ERRORS))
def registration_error(spark, sf_dir):
    return rounded(stats.registration_error(t.attempts(spark, sf_dir)), "error", digits=9)


@query(sql("""select attempt, round(error, 9) as error from errors e where not exists (select 1 from errors p where p.attempt < e.attempt and p.error <= 2.0) and isfinite(error) order by e.error, attempt limit 1""", t.ATTEMPTS, ERRORS))
def best_attempt(spark, sf_dir):
    return rounded(stats.best_attempt(stats.registration_error(t.attempts(spark, sf_dir)), passing=2.0), "error", digits=9)


@query(sql("select k.bin, value, cast(count(*) as bigint) as times from (select bin, 1000 / stain_0 as value from kept) k join (select bin, quantile_cont(1000 / stain_0, 0.25) as q1, quantile_cont(1000 / stain_0, 0.75) as q3 from kept group by bin) q on k.bin = q.bin where not (value between q1 - (q3 - q1) * 1.5 and q3 + (q3 - q1) * 1.5) group by k.bin, value", STAT_PIXELS, LONG))
def box_fliers(spark, sf_dir):
    """The values beyond the whiskers, and how often each occurs."""
    binned = t.stat_pixels(spark, sf_dir).where(stats.finite(F.col("portality"))).withColumn("bin", stats.bin_of(F.col("portality"), 10)).select("bin", (1000 / F.col("stain_0")).alias("value"))
    return stats.box_fliers(binned, ["bin"], "value").groupBy("bin", "value").agg(F.count(F.lit(1)).alias("times"))


@query(sql("select uid, y, x, round((c0 + c1 + c2) / 3.0::double, 3) as mean from raster", RASTER))
def channel_mean(spark, sf_dir):
    from histospark.operators.pixels import channel_mean as mean_of

    got = mean_of(t.pixels(spark, sf_dir), ["uid"])
    return got.select("uid", "y", "x", F.round(F.col("mean").cast("double"), 3).alias("mean"))


def otsu_sql(source: str, key: str, value: str) -> str:
    return f"""oh as (select {key} as k, {value} as v, count(*) as n from {source} group by all),
oc as (select k, v, sum(n) over w as w, sum(n * v) over w as s, sum(n) over (partition by k) as wt, sum(n * v) over (partition by k) as st, max(v) over (partition by k) as top from oh window w as (partition by k order by v rows unbounded preceding)),
otsu as (select k as {key}, coalesce(arg_max(v, (power(cast(s * wt - st * w as double), 2) / (cast(w as double) * (wt - w)), -v)) filter (w < wt), any_value(top) - 1) as threshold from oc group by k)"""


@query(sql("select uid, cast(threshold as bigint) as threshold from otsu", RASTER, otsu_sql("raster", "uid", "c2")))
def otsu(spark, sf_dir):
    return hist.otsu(t.raster(spark, sf_dir), ["uid"], "c2")


@query(sql("select uid, cast(threshold as bigint) as threshold from otsu", "lots as (select l_returnflag as uid, cast(l_quantity as bigint) as v0 from lineitem)", otsu_sql("lots", "uid", "v0")))
def otsu_quantity(spark, sf_dir):
    lots = t.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("uid"), F.col("l_quantity").cast("long").alias("v0"))
    return hist.otsu(lots, ["uid"], "v0")


MULTI = """mh as (select uid, c2 as v, count(*) as n from raster group by all),
mc as (select uid, v, sum(n) over w as w, sum(n * v) over w as s, sum(n) over (partition by uid) as wt, sum(n * v) over (partition by uid) as st from mh window w as (partition by uid order by v rows unbounded preceding)),
mp as (select a.uid, a.v as t1, b.v as t2, power(cast(a.s as double), 2) / a.w + power(cast(b.s - a.s as double), 2) / (b.w - a.w) + power(cast(b.st - b.s as double), 2) / (b.wt - b.w) as score from mc a join mc b on a.uid = b.uid and a.v < b.v where b.w < b.wt),
multi as (select uid, arg_max(t1, (round(score, 6), -t1, -t2)) as t1, arg_max(t2, (round(score, 6), -t1, -t2)) as t2 from mp group by uid),
classed as (select r.uid, r.y, r.x, c2, t1, t2, cast(c2 >= t1 as bigint) + cast(c2 >= t2 as bigint) as label from raster r join multi m on r.uid = m.uid)"""


@query(sql("select uid, t1, t2 from multi", RASTER, MULTI))
def multi_otsu(spark, sf_dir):
    return hist.multi_otsu(t.raster(spark, sf_dir), ["uid"], "c2")


def classed(spark, sf_dir):
    r = t.raster(spark, sf_dir)
    return hist.three_classes(r, hist.multi_otsu(r, ["uid"], "c2"), ["uid"], "c2")


@query(sql("select uid, label, cast(count(*) as bigint) as n, round(avg(c2), 6) as mean from classed group by uid, label", RASTER, MULTI))
def class_means(spark, sf_dir):
    return rounded(hist.class_means(classed(spark, sf_dir), ["uid"], "label", "c2"), "mean")


BIMODAL = "bimodal as (select uid, avg(cast(label = 1 as double)) as middle_share, max(t2 - t1) as gap, avg(c2) filter (label = 0) as dark_mean, any_value(t1) as t1, any_value(t2) as t2 from classed group by uid)"


@query(sql("select uid, round(middle_share, 6) as middle_share, gap, (middle_share < 0.05 or gap < 25.5) as bimodal from bimodal", RASTER, MULTI, BIMODAL))
def bimodality(spark, sf_dir):
    return rounded(hist.bimodal(classed(spark, sf_dir), ["uid"]), "middle_share")


@query(sql("select b.uid, cast(case when middle_share < 0.05 or gap < 25.5 then threshold when dark_mean > 10 then t1 else t2 end as bigint) as lowest, (middle_share < 0.05 or gap < 25.5) as bimodal from bimodal b join otsu o on b.uid = o.uid", RASTER, MULTI, BIMODAL, otsu_sql("raster", "uid", "c2")))
def tissue_classes(spark, sf_dir):
    return hist.tissue_classes(classed(spark, sf_dir), hist.otsu(t.raster(spark, sf_dir), ["uid"], "c2"), ["uid"], "c2")


@query(sql("select uid, channel, quantile_cont(value, 0.01) as p1, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.995) as p99_5 from pixels group by uid, channel", RASTER, PIXELS))
def channel_percentiles(spark, sf_dir):
    return hist.percentiles(t.pixels(spark, sf_dir), ["uid", "channel"], "value", [0.01, 0.5, 0.995])


BACKGROUND = """br as (select uid, channel, lo, case when p99 > lo then p99 else lo + 1 end as hi, mid, p5 from (select uid, channel, cast(min(value) as double) as lo, quantile_cont(value, 0.99) as p99, quantile_cont(value, 0.5) as mid, quantile_cont(value, 0.05) as p5 from pixels group by all)),
bb as (select p.uid, p.channel, least(63, cast(floor((value - lo) * 64 / (hi - lo)) as bigint)) as bin, count(*) as n from pixels p join br on p.uid = br.uid and p.channel = br.channel where value <= hi group by all),
bf as (select br.uid, br.channel, lo, hi, e.bin, coalesce(n, 0) as n from br cross join (select unnest(range(64)) as bin) e left join bb on bb.uid = br.uid and bb.channel = br.channel and bb.bin = e.bin),
bw as (select *, lag(n) over w as before, lead(n) over w as after, max(n) over (partition by uid, channel) as top from bf window w as (partition by uid, channel order by bin)),
bp as (select *, row_number() over (partition by uid, channel order by bin) as rank, count(*) over (partition by uid, channel) as peaks from bw where (case when before is null then n >= after when after is null then n >= before else n > before and n >= after end) and n >= top * 0.02),
background as (select br.uid, br.channel, coalesce(lo + (bin + 0.5) * (hi - lo) / 64, mid, 0.0) as background from (select uid, channel, mid from br) br left join (select * from bp where rank = case when peaks >= 3 then 2 else 1 end) c on c.uid = br.uid and c.channel = br.channel)"""


@query(sql("select uid, channel, round(background, 6) as background from background", RASTER, PIXELS, BACKGROUND))
def background_estimate(spark, sf_dir):
    return rounded(hist.background_estimate(t.pixels(spark, sf_dir), ["uid", "channel"], "value", bins=64), "background")


@query(sql("select p.label, case when hi > lo then least(49, cast(floor((value - lo) * 50 / (hi - lo)) as bigint)) else 0 end as bin, cast(count(*) as bigint) as n from patches p join (select label, min(value) as lo, max(value) as hi from patches group by label) r on p.label = r.label group by all", t.PATCHES))
def feature_histogram(spark, sf_dir):
    return hist.equal_bins(t.patches(spark, sf_dir), ["label"], "value", 50)


@query(sql("select uid, min(y) as y0, min(x) as x0, max(y) + 1 as y1, max(x) + 1 as x1 from mask group by uid", RASTER, t.MASK_SQL))
def bounding_box(spark, sf_dir):
    return hist.bounding_box(t.mask(spark, sf_dir), ["uid"])


CELLS = "cells as (select uid, (y // 10) * 100 + x // 10 as label, c0, c1, c2 from raster)"


@query(sql("select uid, label, round(avg(cast(c2 > 0 as double)), 6) as share, avg(cast(c2 > 0 as double)) > 0.98 as foreground from cells group by uid, label", RASTER, CELLS))
def signal_share(spark, sf_dir):
    return rounded(hist.signal_share(cells(spark, sf_dir), ["uid", "label"], F.col("c2"), 0.98), "share")


@query(sql("""select c.uid, c.label, round(avg(cast(c2 <= case when p <= 1.5 then 60 / 255.0 when p > 255 then 60 * p / 255 else 60 end as double)), 6) as dark_share, c.label >= 100 and avg(cast(c2 <= case when p <= 1.5 then 60 / 255.0 when p > 255 then 60 * p / 255 else 60 end as double)) >= 0.3 as dark
  from cells c join (select uid, quantile_cont(c2, 0.995) as p from cells where label >= 100 group by uid) q on c.uid = q.uid group by c.uid, c.label""", RASTER, CELLS))
def dark_share(spark, sf_dir):
    """The first row of cells isn't foreground."""
    return rounded(hist.dark_share(cells(spark, sf_dir), ["uid", "label"], "c2", 60.0, 0.3, ["uid"], "label >= 100"), "dark_share")


def cells(spark, sf_dir):
    return t.raster(spark, sf_dir).select("uid", (F.expr("y div 10") * 100 + F.expr("x div 10")).alias("label"), "y", "x", "c0", "c1", "c2")


@query(sql("select uid, label, round(case when f = 0 and r > 0 then r * 255 else f end, 6) as gray from (select uid, label, avg(case when c0 > 250 then c0 else 0 end) as f, avg(c0 / 255.0) as r from cells group by all)", RASTER, CELLS))
def gray_lift(spark, sf_dir):
    means = cells(spark, sf_dir).groupBy("uid", "label").agg(F.avg(F.when(F.col("c0") > 250, F.col("c0")).otherwise(0)).alias("f"), F.avg(F.col("c0") / 255.0).alias("r"))
    return means.select("uid", "label", F.round(hist.lifted(means, "f", "r"), 6).alias("gray"))
