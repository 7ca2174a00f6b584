"""Queries of pixel projections and pyramids."""

from __future__ import annotations

from pyspark.sql import functions as F

from histospark.functions import color
from histospark.operators import pixels as px
from histospark.operators.iterate import fresh_path
from histospark.plans.registry import query
from histospark.plans.statistics import BACKGROUND, rounded
from histospark.sources import pyramid, results
from histospark.sources import tables as t
from histospark.sources.tables import MASK_SQL, PATCHES, PIXELS, PYRAMID, RASTER, sql


@query(sql("select uid, y, x, cast(floor(least(1.0, (c0 / 255.0::double + c1 / 255.0::double + c2 / 255.0::double) / 3) * 255 + 1e-9) as bigint) as gray from raster", RASTER))
def gray(spark, sf_dir):
    return px.gray8(t.pixels(spark, sf_dir), ["uid"])


@query(sql("select uid, y, x, cast(floor(c0 * 0.299::double + c1 * 0.587::double + c2 * 0.114::double + 0.5) as bigint) as luma from raster", RASTER))
def luma(spark, sf_dir):
    return t.raster(spark, sf_dir).select("uid", "y", "x", px.luma(F.col("c0"), F.col("c1"), F.col("c2")).alias("luma"))


@query(sql("select uid, y, x, c2 as c0, c0 as c1 from (select uid, y, x, c2, c0 from raster)", RASTER))
def channel_stack(spark, sf_dir):
    return px.wide(t.pixels(spark, sf_dir), [2, 0], ["uid"]).select("uid", "y", "x", F.col("c2").alias("c0"), F.col("c0").alias("c1"))


@query(sql("select uid, y, x, channel, case when channel in (0, 2) then 255 - value else value end as value from pixels", RASTER, PIXELS))
def invert(spark, sf_dir):
    return px.inverted(t.pixels(spark, sf_dir), [0, 2]).withColumn("value", F.col("value").cast("long"))


@query(sql("select p.uid, p.y, p.x, cast(case when hi <= lo then 0 else floor((value - lo) * 255 / (hi - lo)) end as bigint) as byte from patches p join (select uid, min(value) as lo, max(value) as hi from patches group by uid) r on p.uid = r.uid", PATCHES))
def minmax(spark, sf_dir):
    return px.minmax8(t.patches(spark, sf_dir), ["uid"]).select("uid", "y", "x", "byte")


@query(sql("select p.uid, p.y, p.x, round(greatest(0.0, least(1.0, case when p99 > 1.5 and p99 > p1 then (value - p1) / (p99 - p1) else value end)), 9) as unit from patches p join (select uid, quantile_cont(value, 0.01) as p1, quantile_cont(value, 0.99) as p99 from patches group by uid) r on p.uid = r.uid", PATCHES))
def unit_range(spark, sf_dir):
    return rounded(px.unit_range(t.patches(spark, sf_dir), ["uid"]), "unit", digits=9).select("uid", "y", "x", "unit")


@query(sql("select p.uid, p.y, p.x, round(greatest(0.0, least(1.0, value / case when p99 > 0 then p99 when mx > 0 then mx else 1 end)), 9) as stretched from patches p join (select uid, quantile_cont(value, 0.99) as p99, max(value) as mx from patches group by uid) r on p.uid = r.uid", PATCHES))
def stretch99(spark, sf_dir):
    return rounded(px.stretch99(t.patches(spark, sf_dir), ["uid"]), "stretched", digits=9).select("uid", "y", "x", "stretched")


@query(sql("select p.uid, p.y, p.x, round(greatest(0.0, least(1.0, case when p99 > p1 then (value - p1) / (p99 - p1) when mx > mn then (value - mn) / (mx - mn) else 0 end)), 9) as stretched from patches p join (select uid, quantile_cont(value, 0.01) as p1, quantile_cont(value, 0.99) as p99, min(value) as mn, max(value) as mx from patches group by uid) r on p.uid = r.uid", PATCHES))
def stretch_range(spark, sf_dir):
    return rounded(px.stretch99(t.patches(spark, sf_dir), ["uid"], low=True), "stretched", digits=9).select("uid", "y", "x", "stretched")


@query(sql("select uid, y, x, greatest(c0, c1, c2) as value from raster", RASTER))
def max_projection(spark, sf_dir):
    return px.max_projection(t.pixels(spark, sf_dir), ["uid"])


@query(sql("select p.uid, p.y, p.x, round(max(case when hi > lo then (value - lo) / cast(hi - lo as double) else 0 end), 9) as value from pixels p join (select uid, channel, min(value) as lo, max(value) as hi from pixels group by all) r on p.uid = r.uid and p.channel = r.channel group by p.uid, p.y, p.x", RASTER, PIXELS))
def max_projection_stretched(spark, sf_dir):
    return rounded(px.max_projection(t.pixels(spark, sf_dir), ["uid"], stretch=True), "value", digits=9)


@query(sql("select uid, y, x, greatest(c0, c1) as r, c1 as g, cast(floor(c0 / 255.0::double * 170) as bigint) as tint from raster", RASTER))
def tint(spark, sf_dir):
    r = t.raster(spark, sf_dir)
    return r.select("uid", "y", "x", F.greatest("c0", "c1").alias("r"), F.col("c1").alias("g"), px.tinted(F.col("c0") / 255.0, F.array(F.lit(170)))[0].alias("tint"))


@query(sql("select p.uid, p.y, p.x, p.channel, p.value * case when m.uid is null then 0 else 1 end as value from pixels p left join mask m on p.uid = m.uid and p.y = m.y and p.x = m.x", RASTER, PIXELS, MASK_SQL))
def masked(spark, sf_dir):
    return px.masked(t.pixels(spark, sf_dir), t.mask(spark, sf_dir), ["uid"])


BOXES = "boxes as (select uid, min(y) as y0, min(x) as x0, max(y) + 1 as y1, max(x) + 1 as x1 from raster where c0 >= 200 and y between 5 and 40 and x between 7 and 50 group by uid)"


def boxes(spark, sf_dir):
    from histospark.operators.hist import bounding_box

    return bounding_box(t.raster(spark, sf_dir).where("c0 >= 200 and y between 5 and 40 and x between 7 and 50"), ["uid"])


@query(sql("select r.uid, y, x, c0 from raster r join boxes b on r.uid = b.uid where y >= y0 and y < y1 and x >= x0 and x < x1", RASTER, BOXES))
def crop_roi(spark, sf_dir):
    return px.cropped(t.raster(spark, sf_dir), boxes(spark, sf_dir), ["uid"]).select("uid", "y", "x", "c0")


SHAPES = "shapes as (select uid, level, max(y) + 1 as h, max(x) + 1 as w from pyramid group by uid, level)"


@query(sql("""select b.uid, s.level, cast(greatest(0, least(s.h, round_even(y0 * s.h / cast(o.h as double), 0))) as bigint) as y0, cast(greatest(0, least(s.w, round_even(x0 * s.w / cast(o.w as double), 0))) as bigint) as x0,
  cast(greatest(0, least(s.h, round_even(y1 * s.h / cast(o.h as double), 0))) as bigint) as y1, cast(greatest(0, least(s.w, round_even(x1 * s.w / cast(o.w as double), 0))) as bigint) as x1
  from boxes b join shapes o on b.uid = o.uid and o.level = 0 join shapes s on s.uid = b.uid""", RASTER, BOXES, PYRAMID, SHAPES))
def box_to_levels(spark, sf_dir):
    return px.scaled_box(boxes(spark, sf_dir).withColumn("level", F.lit(0)), pyramid.level_shapes(t.pyramid(spark, sf_dir)))


@query(sql("select uid, y + 3 as y, x + 3 as x from mask", RASTER, MASK_SQL))
def pad(spark, sf_dir):
    return px.padded(t.mask(spark, sf_dir), 3)


@query(sql("select uid, y, x, c0 from raster where y < (select min(h) from (select max(y) + 1 as h from raster group by uid)) and x < (select min(w) from (select max(x) + 1 as w from raster group by uid))", RASTER))
def common_crop(spark, sf_dir):
    return px.common_crop(t.raster(spark, sf_dir), ["uid"]).select("uid", "y", "x", "c0")


@query(sql("select uid, y, x, case when c0 <= 60 then 0 else c0 end as low, case when c1 < 60 then 0 else c1 end as strict from raster", RASTER))
def suppress(spark, sf_dir):
    return t.raster(spark, sf_dir).select("uid", "y", "x", px.suppressed(F.col("c0"), 60).alias("low"), px.suppressed(F.col("c1"), 60, strict=True).alias("strict"))


@query(sql("select r.uid, y, x, cast(floor(least(255.0, c2 / p * 255) + 1e-9) as bigint) as byte from raster r join (select uid, coalesce(quantile_cont(c2, 0.99) filter (c2 > 0), 255.0) as p from raster group by uid) q on r.uid = q.uid", RASTER))
def normalise_nonzero(spark, sf_dir):
    return px.normalised_nonzero(t.raster(spark, sf_dir), ["uid"], "c2").select("uid", "y", "x", "byte")


@query(sql("select p.uid, p.y, p.x, p.channel, cast(floor(least(255.0, greatest(value - background, 0.0))) as bigint) as value from pixels p join background b on p.uid = b.uid and p.channel = b.channel", RASTER, PIXELS, BACKGROUND))
def subtract_background(spark, sf_dir):
    from histospark.operators.hist import background_estimate

    p = t.pixels(spark, sf_dir)
    return px.without_background(p, background_estimate(p, ["uid", "channel"], "value", bins=64), ["uid", "channel"])


@query(sql("select channel, round(share, 9) as share, row_number() over (order by channel) - 1 as new_channel from (select channel, avg(cast(value <> 255 as double)) as share from pixels group by channel) where share >= 0.997", RASTER, PIXELS))
def kept_channels(spark, sf_dir):
    return rounded(px.kept_channels(t.pixels(spark, sf_dir), 0.997), "share", digits=9).withColumn("channel", F.col("channel").cast("int"))


@query(sql("""select uid, level, ty, tx, ty * 16 as y0, tx * 16 as x0, least(16, h - ty * 16) as th, least(16, w - tx * 16) as tw from shapes, (select unnest(range(0, 4)) as ty), (select unnest(range(0, 4)) as tx) where ty * 16 < h and tx * 16 < w""", RASTER, PYRAMID, SHAPES))
def tile_grid(spark, sf_dir):
    tiles = px.tile_grid(pyramid.level_shapes(t.pyramid(spark, sf_dir)), 16).drop("h", "w")
    return tiles.withColumns({c: F.col(c).cast("long") for c in ("ty", "tx", "y0", "x0")})


@query(sql("select uid, cast(trunc((y - 2) * 1.5::double + 10) as bigint) as y, cast(trunc((x - 2) * 1.5::double + 20) as bigint) as x from mask", RASTER, MASK_SQL))
def map_points(spark, sf_dir):
    return px.mapped_points(t.mask(spark, sf_dir), 1.5, 10, 20, pad=2)


@query(sql("select uid, y, x, case when c2 >= 200 then 255 when c2 >= 100 then 170 when c2 >= 20 then 85 else 0 end as code, cast(floor(c0 * 0.6::double + 255 * 0.4::double) as bigint) as red from raster", RASTER))
def zone_codes(spark, sf_dir):
    zone = F.when(F.col("c2") >= 200, "PV").when(F.col("c2") >= 100, "MID").when(F.col("c2") >= 20, "PP")
    return t.raster(spark, sf_dir).select("uid", "y", "x", color.gray_code(zone).alias("code"), color.blended(F.col("c0"), F.array(F.lit(255)), 0.4)[0].alias("red"))


@query(sql("select uid, level, y, x, value from pyramid", RASTER, PYRAMID))
def pyramid_decimate(spark, sf_dir):
    return t.pyramid(spark, sf_dir)


@query(sql("select uid, level, h, w from shapes", RASTER, PYRAMID, SHAPES))
def level_shapes(spark, sf_dir):
    return pyramid.level_shapes(t.pyramid(spark, sf_dir))


@query(sql("select uid, array_to_string(list_sort(list(distinct level)), ',') as levels from pyramid group by uid", RASTER, PYRAMID))
def pyramid_levels(spark, sf_dir):
    return pyramid.levels_of(t.pyramid(spark, sf_dir)).withColumn("levels", F.array_join(F.col("levels").cast("array<string>"), ","))


@query(sql("select level from pyramid where uid % 2 = 0 or level < 2 group by level having count(distinct uid) = (select count(distinct uid) from pyramid)", RASTER, PYRAMID))
def common_levels(spark, sf_dir):
    return pyramid.common_levels(t.pyramid(spark, sf_dir).where("uid % 2 = 0 or level < 2"))


@query(sql("select uid, arg_min(level, h * w) as smallest, arg_max(level, h * w) as largest, min(level) as preview from shapes group by uid", RASTER, PYRAMID, SHAPES))
def level_choice(spark, sf_dir):
    p = t.pyramid(spark, sf_dir)
    s = pyramid.level_shapes(p)
    return pyramid.extreme_level(s).withColumnRenamed("level", "smallest").join(pyramid.extreme_level(s, smallest=False).withColumnRenamed("level", "largest"), "uid").join(pyramid.preview_level(p).withColumnRenamed("level", "preview"), "uid")


@query(sql("select uid, y, x, value from pyramid where level = case when uid % 2 = 1 then 2 else 1 end", RASTER, PYRAMID))
def level_fallback(spark, sf_dir):
    odd = t.pyramid(spark, sf_dir).where("uid % 2 = 0 or level <> 1")
    return pyramid.level_or_place(odd, 1).drop("level")


@query(sql("select g.uid, ty as y, tx as x, c0 as value from (select distinct uid, ty, tx from raster, (select unnest(range(80)) as ty), (select unnest(range(45)) as tx)) g join raster r on r.uid = g.uid and r.y = floor(ty * 50 / 80.0::double) and r.x = floor(tx * 60 / 45.0::double)", RASTER))
def nearest_resample(spark, sf_dir):
    return pyramid.nearest_resampled(t.raster(spark, sf_dir).select("uid", "y", "x", F.col("c0").alias("value")), ["uid"], 50, 60, 80, 45)


@query(sql("""select uid, ty as y, tx as x, round(case when count(*) = 4 then sum(c0 * wy * wx) end, 6) as value from
  (select ty, least(cast(floor(fy) as bigint) + dy, 49) as sy, case when dy = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end as wy from (select ty, greatest(0.0::double, least(49.0::double, (ty + 0.5::double) * 50 / 20 - 0.5)) as fy from (select unnest(range(20)) as ty)), (select unnest([0, 1]) as dy)) a,
  (select tx, least(cast(floor(fx) as bigint) + dx, 59) as sx, case when dx = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end as wx from (select tx, greatest(0.0::double, least(59.0::double, (tx + 0.5::double) * 60 / 35 - 0.5)) as fx from (select unnest(range(35)) as tx)), (select unnest([0, 1]) as dx)) b
  join raster r on r.y = a.sy and r.x = b.sx group by uid, ty, tx""", RASTER))
def bilinear_resample(spark, sf_dir):
    return rounded(pyramid.bilinear_resampled(t.raster(spark, sf_dir).select("uid", "y", "x", F.col("c0").alias("value")), ["uid"], 50, 60, 20, 35), "value")


#: Sizes of the three levels; the region found on 25 x 30 pixels shows rows 5 to 44 and columns 7 to 51 of level 0.
RESULT_LEVELS = """sizes as (select unnest([0, 1, 2]) as level, unnest([50, 25, 13]) as h, unnest([60, 30, 15]) as w),
ry as (select level, h, unnest(range(h)) as ty from sizes), rx as (select level, w, unnest(range(w)) as tx from sizes),
region as (select uid, y // 2 as y, x // 2 as x, c0 as label from raster where y % 2 = 0 and x % 2 = 0 and c0 >= 60),
full_labels as (select uid, 5 + ty as y, 7 + tx as x, label from (select unnest(range(40)) as ty), (select unnest(range(45)) as tx), region r where r.y = ty * 25 // 40 and r.x = tx * 30 // 45),
at_levels as (select uid, ry.level, ty as y, tx as x, label from ry join rx using (level) join full_labels f on f.y = ty * 50 // h and f.x = tx * 60 // w),
fy as (select level, ty, greatest(0.0::double, least(49.0::double, (ty + 0.5::double) * 50 / h - 0.5)) as f from ry),
fx as (select level, tx, greatest(0.0::double, least(59.0::double, (tx + 0.5::double) * 60 / w - 0.5)) as f from rx),
cy as (select level, ty, least(cast(floor(f) as bigint) + d, 49) as sy, case when d = 1 then f - floor(f) else 1 - (f - floor(f)) end as wy from fy, (select unnest([0, 1]) as d)),
cx as (select level, tx, least(cast(floor(f) as bigint) + d, 59) as sx, case when d = 1 then f - floor(f) else 1 - (f - floor(f)) end as wx from fx, (select unnest([0, 1]) as d)),
smooth as (select uid, cy.level, ty as y, tx as x, sum(c1 / 255.0::double * wy * wx) as portality from cy join cx using (level) join raster r on r.y = sy and r.x = sx where c2 >= 64 group by uid, cy.level, ty, tx having count(*) = 4)"""


@query(sql("select uid, level, y, x, label, round(portality, 6) as portality from at_levels full join smooth using (uid, level, y, x)", RASTER, RESULT_LEVELS))
def result_pyramid(spark, sf_dir):
    """Labels of a region and a portality raster written to pyramids of three levels in tiles of 16, and read again."""
    r = t.raster(spark, sf_dir)
    each = r.select("uid").distinct()
    sizes = spark.createDataFrame([(0, 50, 60), (1, 25, 30), (2, 13, 15)], "level int, h long, w long")
    shapes = each.join(sizes)
    boxes = each.selectExpr("uid", "25 as ph", "30 as pw", "5 as y0", "7 as x0", "45 as y1", "52 as x1")
    region = r.where("y % 2 = 0 and x % 2 = 0 and c0 >= 60").select("uid", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x"), F.col("c0").alias("label"))
    folder = fresh_path(spark, "results")
    results.write_results(results.pasted(region, boxes, shapes), r.where("c2 >= 64").select("uid", "y", "x", (F.col("c1") / 255.0).alias("value")), shapes, folder, side=16)
    found = rounded(results.read_results(spark, folder), "portality")
    return found.withColumns({"uid": F.col("uid").cast("long"), "level": F.col("level").cast("int")})


@query(sql("select uid, y // 4 as y, x // 4 as x, round(avg(c0), 6) as value from raster group by uid, y // 4, x // 4", RASTER))
def size_capped(spark, sf_dir):
    return rounded(pyramid.size_capped(t.raster(spark, sf_dir).select("uid", "y", "x", F.col("c0").alias("value")), ["uid"], 15), "value")


@query(sql("""select g.uid, g.y, g.x, r.c0 as value from raster g join raster r on r.uid = g.uid and r.y = cast(floor(0.9::double * g.y + 0.1::double * g.x + 2 + 0.5) as bigint) and r.x = cast(floor(-0.1::double * g.y + 1.1::double * g.x + g.uid + 0.5) as bigint)""", RASTER))
def apply_affine(spark, sf_dir):
    r = t.raster(spark, sf_dir)
    moves = r.select("uid").distinct().select("uid", F.lit(0.9).alias("a00"), F.lit(0.1).alias("a01"), F.lit(-0.1).alias("a10"), F.lit(1.1).alias("a11"), F.lit(2.0).alias("b0"), F.col("uid").cast("double").alias("b1"))
    return pyramid.affine_sampled(r.select("uid", "y", "x", F.col("c0").alias("value")), moves, "uid", 50, 60)


@query(sql("select uid, y, x, 0 as channel, cast(c0 as float) as value from raster", RASTER))
def tile_round_trip(spark, sf_dir):
    tiles = pyramid.tiled(t.raster(spark, sf_dir).select("uid", F.lit(0).alias("channel"), "y", "x", F.col("c0").alias("value")), ["uid", "channel"], 16)
    return pyramid.untiled(tiles, ["uid", "channel"])


@query(sql("select p_partkey as uid, case when a <= b and a <= c then 0 when b <= c then 1 else 2 end as axis from (select p_partkey, p_partkey % 5 + 1 as a, p_partkey % 7 + 3 as b, p_partkey % 11 + 2 as c from part)"))
def channel_axis(spark, sf_dir):
    k = F.col("p_partkey")
    return t.table(spark, sf_dir, "part").select(k.alias("uid"), px.channel_axis(F.array(k % 5 + 1, k % 7 + 3, k % 11 + 2)).cast("int").alias("axis"))


@query(sql("select uid, y, x, cast(floor(c0 * 300 / 257.0::double) as bigint) as r, cast(floor(least(255.0::double, c1 * 300 / 257.0::double)) as bigint) as g, cast(floor(least(255.0::double, greatest(c0, c1) * 300 / 257.0::double)) as bigint) as b from (select uid, y, x, least(c0, 218) as c0, c1 from raster)", RASTER))
def native_rgb(spark, sf_dir):
    """Two channels of sixteen bits as colours; the third is their maximum."""
    r = t.raster(spark, sf_dir).withColumn("c0", F.least("c0", F.lit(218)))
    two = r.select("uid", "y", "x", F.posexplode(F.array(F.col("c0") * 300, F.col("c1") * 300)).alias("channel", "value"))
    return px.native_rgb(px.first_three(two, ["uid"]), ["uid"], "uint16")


@query(sql("select uid, y, x, cast(floor(c0 * 255.0::double / top) as bigint) as r, cast(floor(c1 * 255.0::double / top) as bigint) as g, cast(floor(c2 * 255.0::double / top) as bigint) as b from raster join (select uid, max(greatest(c0, c1, c2)) as top from raster group by uid) using (uid)", RASTER))
def native_rgb_scaled(spark, sf_dir):
    """Three channels scaled by the image's greatest value."""
    rgb = t.raster(spark, sf_dir).select("uid", "y", "x", F.col("c0").alias("r"), F.col("c1").alias("g"), F.col("c2").alias("b"))
    exact = rgb.withColumns({c: F.col(c).cast("double") for c in "rgb"})
    got = px.native_rgb(exact, ["uid"], "float")
    return got.select("uid", "y", "x", "r", "g", "b")


@query(sql("select uid, y, x, case when uid % 2 = 0 then cast(c0 >= 128 as bigint) * 255 else c0 end as byte from raster", RASTER))
def mask_bytes(spark, sf_dir):
    """Even slides are masks of 0 and 1."""
    m = t.raster(spark, sf_dir).select("uid", "y", "x", F.when(F.col("uid") % 2 == 0, (F.col("c0") >= 128).cast("long")).otherwise(F.col("c0")).alias("value"))
    return px.mask_bytes(m, ["uid"]).select("uid", "y", "x", "byte")
