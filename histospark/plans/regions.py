"""Queries of components, distances, portality, superpixel features and zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from histospark.operators import components as comp
from histospark.operators import distance, features, runs
from histospark.plans.registry import query
from histospark.plans.statistics import otsu_sql, rounded
from histospark.sources import tables as t
from histospark.sources.tables import MASK_SQL, RASTER, sql

W = comp.WIDE


def label_sql(name: str, source: str, eight: bool = False) -> str:
    """Components by repeated spreading of the least place, as a recursive view ``name`` (uid, y, x, label)."""
    near = "abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1" if eight else "abs(b.y - a.y) + abs(b.x - a.x) <= 1"
    return f"""{name}_walk(uid, y, x, label) as (select uid, y, x, y * {W} + x from {source} union
  select b.uid, b.y, b.x, a.label from {name}_walk a join {source} b on a.uid = b.uid and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 and {near} where a.label < b.y * {W} + b.x),
{name} as (select uid, y, x, min(label) as label from {name}_walk group by uid, y, x)"""


#: Pixels that a slide lacks are background, in the operators and here.
OFF = "off as (select u.uid, p.y, p.x from (select distinct uid from mask) u, (select y, x from (select unnest(range(50)) as y), (select unnest(range(60)) as x)) p where not exists (select 1 from mask m where m.uid = u.uid and m.y = p.y and m.x = p.x))"
EDGE = "(y = 0 or x = 0 or y = 49 or x = 59)"


@query(sql("select uid, y, x, label from lab", RASTER, MASK_SQL, label_sql("lab", "mask")))
def label4(spark, sf_dir):
    return comp.labelled(t.mask(spark, sf_dir), tile=16)


@query(sql("select uid, y, x, label from lab", RASTER, MASK_SQL, label_sql("lab", "mask", True)))
def label8(spark, sf_dir):
    return comp.labelled(t.mask(spark, sf_dir), eight=True, tile=16)


@query(sql(f"select uid, y, x, label from lab where (uid, label) in (select (uid, label) from lab where {EDGE})", RASTER, MASK_SQL, label_sql("lab", "mask")))
def border_connected(spark, sf_dir):
    return comp.border_connected(t.mask(spark, sf_dir), (50, 60)).select("uid", "y", "x", "label")


def holes_sql(name: str, off: str, edge: str = EDGE) -> str:
    """Labelled pixels of ``off`` that the image's edge doesn't reach, as a view ``name``: a flood from the edge, then labels of the rest."""
    return f"""{name}_reach(uid, y, x) as (select uid, y, x from {off} where {edge} union select b.uid, b.y, b.x from {name}_reach a join {off} b on b.uid = a.uid and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 and abs(b.y - a.y) + abs(b.x - a.x) = 1),
{name}_rest as (select uid, y, x from {off} except select uid, y, x from {name}_reach),
{label_sql(name, name + "_rest")}"""


HOLES = holes_sql("holes", "off")


@query(sql("select uid, y, x, label from holes", RASTER, MASK_SQL, OFF, HOLES))
def holes(spark, sf_dir):
    return comp.holes(t.mask(spark, sf_dir), (50, 60)).select("uid", "y", "x", "label")


@query(sql("select uid, y, x from mask union all select uid, y, x from holes", RASTER, MASK_SQL, OFF, HOLES))
def fill_holes(spark, sf_dir):
    return comp.filled(t.mask(spark, sf_dir), (50, 60))


#: Slides cut to frames of different sizes.
CUT = """frames as (select distinct uid, 50 - uid % 3 * 10 as h, 60 - uid % 4 * 5 as w from raster),
cut as (select m.* from mask m join frames f on f.uid = m.uid where y < h and x < w),
cutoff as (select u.uid, p.y, p.x, h, w from frames u, (select y, x from (select unnest(range(50)) as y), (select unnest(range(60)) as x)) p where p.y < h and p.x < w and not exists (select 1 from cut m where m.uid = u.uid and m.y = p.y and m.x = p.x))"""
CUT_EDGE = "(y = 0 or x = 0 or y = h - 1 or x = w - 1)"


def cut_runs(spark, sf_dir):
    """Runs of the mask in frames of different sizes, and the frames."""
    r = t.raster(spark, sf_dir)
    frames = r.select("uid").distinct().select("uid", (50 - F.col("uid") % 3 * 10).alias("h"), (60 - F.col("uid") % 4 * 5).alias("w"))
    return runs.clipped(runs.runs_of(t.mask(spark, sf_dir)), frames), frames


@query(sql("select uid, y, x, label from holes", RASTER, MASK_SQL, CUT, holes_sql("holes", "cutoff", CUT_EDGE)))
def framed_holes(spark, sf_dir):
    """Holes over runs, each slide in a frame of its own size."""
    mask, frames = cut_runs(spark, sf_dir)
    return runs.pixels_of(runs.holes(mask, frames)).select("uid", "y", "x", "label")


@query(sql(f"select distinct p.uid, p.y, p.x, p.label from lab p where (uid, label) in (select (l.uid, label) from lab l join frames f on f.uid = l.uid where {CUT_EDGE})", RASTER, MASK_SQL, CUT, label_sql("lab", "cut", True)))
def framed_border(spark, sf_dir):
    """8-connected components that touch the edge of their slide's own frame."""
    mask, frames = cut_runs(spark, sf_dir)
    return runs.pixels_of(runs.border_connected(mask, frames, eight=True)).select("uid", "y", "x", "label")


@query(sql("select uid, label, cast(count(*) as bigint) as area, min(y) as y0, min(x) as x0, max(y) + 1 as y1, max(x) + 1 as x1 from lab group by uid, label", RASTER, MASK_SQL, label_sql("lab", "mask")))
def run_regions(spark, sf_dir):
    """Area and box of each component, from runs alone."""
    labels = runs.labelled(runs.runs_of(t.mask(spark, sf_dir)), tile=32)
    return runs.areas(labels).join(runs.bounding_box(labels, ["uid", "label"]), ["uid", "label"])


@query(sql("select uid, y, x, label from lab where (uid, label) in (select (uid, label) from lab group by uid, label having count(*) >= 20)", RASTER, MASK_SQL, label_sql("lab", "mask")))
def remove_small(spark, sf_dir):
    return comp.without_small(t.mask(spark, sf_dir), 20).select("uid", "y", "x", "label")


@query(sql("select uid, y, x from mask union all select uid, y, x from holes where (uid, label) in (select (uid, label) from holes group by uid, label having count(*) < 5)", RASTER, MASK_SQL, OFF, HOLES))
def remove_small_holes(spark, sf_dir):
    return comp.without_small_holes(t.mask(spark, sf_dir), 5, (50, 60))


@query(sql("select uid, y, x, label from lab where (uid, label) in (select (uid, arg_max(label, (n, -label))) from (select uid, label, count(*) as n from lab group by all) group by uid)", RASTER, MASK_SQL, label_sql("lab", "mask")))
def largest_component(spark, sf_dir):
    return comp.largest(t.mask(spark, sf_dir)).select("uid", "y", "x", "label")


@query(sql("""select a.uid, a.label, area, perimeter, round(4 * 3.141592653589793::double * area / (perimeter * perimeter), 9) as circularity, y0, x0, y1, x1 from
  (select uid, label, count(*) as area, min(y) as y0, min(x) as x0, max(y) + 1 as y1, max(x) + 1 as x1 from lab group by all) a
  join (select p.uid, p.label, 4 * count(distinct (p.y, p.x)) - count(q.y) as perimeter from lab p left join lab q on q.uid = p.uid and q.label = p.label and abs(q.y - p.y) + abs(q.x - p.x) = 1 group by all) b on a.uid = b.uid and a.label = b.label""", RASTER, MASK_SQL, label_sql("lab", "mask")))
def component_shapes(spark, sf_dir):
    return rounded(comp.shapes_of(comp.labelled(t.mask(spark, sf_dir))), "circularity", digits=9)


BIG = "big as (select uid, y, x from lab where (uid, label) in (select (uid, arg_max(label, (n, -label))) from (select uid, label, count(*) as n from lab group by all) group by uid)), bigoff as (select u.uid, p.y, p.x from (select distinct uid from big) u, (select y, x from (select unnest(range(50)) as y), (select unnest(range(60)) as x)) p where not exists (select 1 from big m where m.uid = u.uid and m.y = p.y and m.x = p.x))"


@query(sql("select b.uid, b.y, b.x, b.label from bl b where not exists (select 1 from mask m where m.uid = b.uid and m.y = b.y and m.x = b.x)", RASTER, MASK_SQL, label_sql("lab", "mask", True), BIG, holes_sql("bl", "bigoff")))
def holes_of_largest(spark, sf_dir):
    return comp.holes_of_largest(t.mask(spark, sf_dir), (50, 60))


@query(sql("select a.uid, a.y, a.x, round(coalesce((select sqrt(min((b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x))) from raster b where b.uid = a.uid and b.c0 >= 250), 'inf'::double), 9) as distance from raster a", RASTER))
def edt(spark, sf_dir):
    return rounded(distance.distance_to(t.raster(spark, sf_dir), t.TARGET), "distance", digits=9)


#: Distances to what lies inside, over the pixels inside only; the rim has a neighbour of another label, or none.
PORT = """lobes as (select uid, y, x, c2 // 64 as label, c0 >= 252 as central, c1 <= 2 as portal from raster where c2 >= 20),
rim as (select *, portal or (select count(*) from lobes b where b.uid = a.uid and b.label = a.label and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1) < 9 as rim from lobes a),
near as (select a.uid, a.y, a.x, any_value(a.central) as central, any_value(a.rim) as rim, sqrt(min((b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x)) filter (b.rim)) as dp, sqrt(min((b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x)) filter (b.central)) as dc
  from rim a join rim b on b.uid = a.uid and (b.rim or b.central) group by a.uid, a.y, a.x)"""


@query(sql("select r.uid, r.y, r.x, round(case when n.uid is null then null when central then 1.0 when rim or dc is null then 0.0 when dp is null then 1.0 else dp / (dp + dc + 1e-8) end, 9) as portality from raster r left join near n on n.uid = r.uid and n.y = r.y and n.x = r.x", RASTER, PORT))
def portality(spark, sf_dir):
    lobes = t.raster(spark, sf_dir).select("uid", "y", "x", F.expr("case when c2 >= 20 then c2 div 64 end as label"), F.expr("c0 >= 252 as central"), F.expr("c1 <= 2 as portal"))
    return rounded(distance.portality(lobes), "portality", digits=9)


def tissue_sql(source: str, value: str, above: str, h: int, w: int) -> str:
    """The raw image against a threshold of the blurred one (deviation 1, so the closing has no effect), holes and small
    background filled, small pieces gone, as a view ``tissue``."""
    edge = f"(y = 0 or x = 0 or y = {h - 1} or x = {w - 1})"
    off = lambda name, on: f"{name} as (select u.uid, p.y, p.x from (select distinct uid from {on}) u, (select y, x from (select unnest(range({h})) as y), (select unnest(range({w})) as x)) p except select uid, y, x from {on})"
    return f"""g as (select uid, y, x, {value} as v from {source}),
blur as (select a.uid, a.y, a.x, cast(floor(sum(b.v * exp(-(power(b.y - a.y, 2) + power(b.x - a.x, 2)) / 2.0::double)) / sum(exp(-(power(b.y - a.y, 2) + power(b.x - a.x, 2)) / 2.0::double)) + 0.5) as bigint) as v
  from g a join g b on a.uid = b.uid and b.y between a.y - 3 and a.y + 3 and b.x between a.x - 3 and a.x + 3 group by a.uid, a.y, a.x),
{otsu_sql("blur", "uid", "v")},
{above},
{off("void", "above")},
{holes_sql("inner_", "void", edge)},
solid as (select uid, y, x from above union select uid, y, x from inner_),
{off("void2", "solid")},
{label_sql("spare", "void2")},
even as (select uid, y, x from solid union select uid, y, x from spare where (uid, label) in (select (uid, label) from spare group by uid, label having count(*) < {max(1, h * w // 20)})),
{label_sql("body", "even")},
tissue as (select uid, y, x from body where (uid, label) in (select (uid, label) from body group by uid, label having count(*) >= {max(1, h * w // 100)}))"""


ABOVE2 = "above as (select g.uid, y, x from g join otsu o on g.uid = o.uid where v > threshold)"


def gray2(spark, sf_dir):
    return t.raster(spark, sf_dir).select("uid", "y", "x", F.col("c2").alias("value"))


@query(sql("select uid, y, x from tissue", RASTER, tissue_sql("raster", "c2", ABOVE2, 50, 60)))
def tissue_mask(spark, sf_dir):
    """Blur, threshold, close, fill and drop small pieces."""
    from histospark.plans.pipeline import tissue_mask as run

    return run(gray2(spark, sf_dir), (50, 60))


@query(sql("select uid, min(y) as y0, min(x) as x0, max(y) + 1 as y1, max(x) + 1 as x1 from tissue group by uid", RASTER, tissue_sql("raster", "c2", ABOVE2, 50, 60)))
def roi(spark, sf_dir):
    from histospark.plans.pipeline import region_of_interest

    return region_of_interest(gray2(spark, sf_dir), (50, 60))


PYRAMID_C2 = "low as (select uid, y // 4 as y, x // 4 as x, c2 as value from raster where y % 4 = 0 and x % 4 = 0)"
#: Found at level 2, scaled to level 0 and from there to every level.
ROI_LEVELS = """select b.uid, level, greatest(0, cast(round_even(t * h / 50.0::double, 0) as bigint)) as y0, greatest(0, cast(round_even(l * w / 60.0::double, 0) as bigint)) as x0,
  least(h, cast(round_even(t * h / 50.0::double, 0) + round_even(dy * h / 50.0::double, 0) as bigint)) as y1, least(w, cast(round_even(l * w / 60.0::double, 0) + round_even(dx * w / 60.0::double, 0) as bigint)) as x1
from (select uid, round_even(min(y) * 50 / 13.0::double, 0) as t, round_even(min(x) * 60 / 15.0::double, 0) as l, round_even((max(y) + 1 - min(y)) * 50 / 13.0::double, 0) as dy, round_even((max(x) + 1 - min(x)) * 60 / 15.0::double, 0) as dx from tissue group by uid) b,
  (select unnest([0, 1, 2]) as level, unnest([50, 25, 13]) as h, unnest([60, 30, 15]) as w)"""


@query(sql(ROI_LEVELS, RASTER, PYRAMID_C2, tissue_sql("low", "value", ABOVE2, 13, 15)))
def roi_levels(spark, sf_dir):
    """The region of interest found at the smallest level and scaled to all."""
    from histospark.plans.pipeline import regions_of_levels
    from histospark.sources.pyramid import decimated

    levels = decimated(gray2(spark, sf_dir), [0, 1, 2])
    sizes = spark.createDataFrame([(0, 50, 60), (1, 25, 30), (2, 13, 15)], "level int, h long, w long")
    return regions_of_levels(levels, gray2(spark, sf_dir).select("uid").distinct().join(sizes)).withColumn("level", F.col("level").cast("int"))


#: Three classes of the blurred image decide for each slide, as hist.tissue_classes does.
ABOVE3 = """bh as (select uid, v, count(*) as n from blur group by all),
bc as (select *, sum(n) over w as w, sum(n * v) over w as s, sum(n) over (partition by uid) as wt, sum(n * v) over (partition by uid) as st from bh window w as (partition by uid order by v rows unbounded preceding)),
bt as (select a.uid, arg_max((a.v, b.v), (round(power(a.s::double, 2) / a.w + power((b.s - a.s)::double, 2) / (b.w - a.w) + power((a.st - b.s)::double, 2) / (a.wt - b.w), 6), -a.v, -b.v)) as t from bc a join bc b on a.uid = b.uid and a.v < b.v where b.w < b.wt group by a.uid),
b3 as (select g.uid, g.y, g.x, v, t[1] as t1, t[2] as t2, cast(v >= t[1] as int) + cast(v >= t[2] as int) as label from g join bt on g.uid = bt.uid),
bm as (select uid, avg(cast(label = 1 as double)) < 0.05 or max(t2 - t1) < 25.5 as two, avg(v) filter (label = 0) as dark from b3 group by uid),
above as (select b3.uid, y, x from b3 join bm on b3.uid = bm.uid join otsu o on o.uid = b3.uid where case when two then v > threshold when dark > 10 then label > 0 else label = 2 end)"""


@query(sql("select uid, y, x from tissue", RASTER, tissue_sql("raster", "c2", ABOVE3, 50, 60)))
def tissue_mask_three(spark, sf_dir):
    """The mask by three classes, with the choice among three maskings for each slide."""
    from histospark.plans.pipeline import tissue_mask as run

    return run(gray2(spark, sf_dir), (50, 60), classes=3)


@query(sql("""select r.uid, r.y, r.x, case when zone = 'MID' and g.uid is not null then 'PP' else zone end as zone from zoned r left join (
  select m.uid, m.y, m.x from zgrown m, zdisc d join zgrown n on n.uid = m.uid and n.y = m.y + dy and n.x = m.x + dx group by all having count(*) = (select count(*) from zdisc)) g on g.uid = r.uid and g.y = r.y and g.x = r.x""", RASTER, "zoned as (select uid, y, x, case when c2 >= 170 then 'PV' when c2 >= 85 then 'MID' else 'PP' end as zone from raster)", "zdisc as (select dy, dx from (select unnest(range(-2, 3)) as dy), (select unnest(range(-2, 3)) as dx) where dy * dy + dx * dx <= 4)", "zgrown as (select distinct uid, y + dy as y, x + dx as x from zoned, zdisc where zone = 'PP')"))
def close_zone(spark, sf_dir):
    """Closing of the portal zone, which takes middle pixels only."""
    from histospark.operators.stencil import closed_zones

    zone = F.when(F.col("c2") >= 170, "PV").when(F.col("c2") >= 85, "MID").otherwise("PP")
    return closed_zones(t.raster(spark, sf_dir).select("uid", "y", "x", zone.alias("zone")), ["uid"], 2)


CELLS = "cells as (select uid, (y // 5) * 12 + x // 5 as label, y, x, c0, c1, c2 from raster)"
MEANS = "means as (select uid, label, count(*) as area, avg(c0) as c0, avg(c1) as c1, avg(c2) as c2 from cells group by uid, label)"


def cells(spark, sf_dir):
    return t.raster(spark, sf_dir).select("uid", (F.expr("y div 5") * 12 + F.expr("x div 5")).alias("label"), "y", "x", "c0", "c1", "c2")


def means(spark, sf_dir):
    return features.region_means(cells(spark, sf_dir), ["uid"], ["c0", "c1", "c2"])


@query(sql("select uid, label, area, round(c0, 6) as c0, round(c1, 6) as c1, round(c2, 6) as c2 from means", RASTER, CELLS, MEANS))
def superpixel_means(spark, sf_dir):
    return rounded(means(spark, sf_dir), "c0", "c1", "c2")


@query(sql("select m.uid, label, round(case when hi - lo > 1e-6 then power((greatest(lo, least(hi, c2)) - lo) / (hi - lo), 0.7) * (hi - lo) + lo else c2 end, 6) as weighted from means m join (select uid, quantile_cont(c2, 0.01) as lo, quantile_cont(c2, 0.99) as hi from means group by uid) q on m.uid = q.uid", RASTER, CELLS, MEANS))
def gamma_weight(spark, sf_dir):
    return rounded(features.gamma_weighted(means(spark, sf_dir), ["uid"], "c2", 0.7), "weighted").select("uid", "label", "weighted")


@query(sql("select uid, label, round((rank() over (partition by uid order by c2) + (count(*) over (partition by uid, c2) - 1) / 2.0::double - 1) / (count(*) over (partition by uid) - 1), 9) as quantile from (select uid, label, round(c2, 2) as c2 from means)", RASTER, CELLS, MEANS))
def quantile_norm(spark, sf_dir):
    return rounded(features.quantile_normalised(means(spark, sf_dir).withColumn("c2", F.round("c2", 2)), ["uid"], "c2"), "quantile", digits=9).select("uid", "label", "quantile")


ADJ = "adj as (select distinct a.uid * 1000 + a.label as a, b.uid * 1000 + b.label as b from cells a join cells b on a.uid = b.uid and a.label < b.label and abs(a.y - b.y) + abs(a.x - b.x) = 1), ends as (select a as node, b as near from adj union all select b, a from adj), feats as (select uid * 1000 + label as node, c0, c2, cast(floor(c2 / 40) as bigint) as label from means)"


def adjacency(spark, sf_dir):
    from histospark.operators.stencil import label_adjacency

    return label_adjacency(cells(spark, sf_dir).select("uid", "y", "x", "label"), ["uid"]).select((F.col("uid") * 1000 + F.col("a")).alias("a"), (F.col("uid") * 1000 + F.col("b")).alias("b"))


def nodes(spark, sf_dir):
    return means(spark, sf_dir).select("uid", (F.col("uid") * 1000 + F.col("label")).alias("node"), "c0", "c2", F.floor(F.col("c2") / 40).alias("label"))


@query(sql("select f.node, cast(count(near) as bigint) as degree, round(2.0 / (2.0 + count(near)), 9) as own, round(1.0 / (2.0 + count(near)), 9) as each from feats f left join ends b on f.node = b.node group by f.node", RASTER, CELLS, MEANS, ADJ))
def adjacency_weights(spark, sf_dir):
    return rounded(features.adjacency_weights(adjacency(spark, sf_dir), nodes(spark, sf_dir), 2.0), "own", "each", digits=9)


SMOOTH1 = "s1 as (select f.node, (f.c2 * 2.0::double + coalesce(sum(g.c2), 0)) / (2.0::double + count(g.c2)) as c2 from feats f left join ends b on f.node = b.node left join feats g on g.node = b.near group by f.node, f.c2)"


@query(sql("select f.node, round((f.c2 * 2.0::double + coalesce(sum(g.c2), 0)) / (2.0::double + count(g.c2)), 6) as c2 from s1 f left join ends b on f.node = b.node left join s1 g on g.node = b.near group by f.node, f.c2", RASTER, CELLS, MEANS, ADJ, SMOOTH1))
def smooth_features(spark, sf_dir):
    return rounded(features.smoothed_features(nodes(spark, sf_dir), adjacency(spark, sf_dir), ["c2"], 2, 2.0), "c2")


@query(sql("select node, arg_max(label, (n, -label)) as label from (select node, label, count(*) as n from (select node, label from feats union all select b.node, f.label from ends b join feats f on f.node = b.near) group by all) group by node", RASTER, CELLS, MEANS, ADJ))
def smooth_labels(spark, sf_dir):
    return features.smoothed_labels(nodes(spark, sf_dir), adjacency(spark, sf_dir))


@query()
def kmeans_zones(spark, sf_dir):
    n = nodes(spark, sf_dir).drop("label")
    clustered = n.join(features.k_means(n, "uid", ["c0", "c2"], k=7), ["uid", "node"])
    return features.zones_by_rank(clustered, "uid", "c2")


RANKED = "ranked as (select uid, cluster, row_number() over (partition by uid order by mean, cluster) as r from (select uid, label % 7 as cluster, avg(c2) as mean from means group by all))"


@query(sql("select uid, cluster, case when r <= 1 then 'PV' when r <= 5 then 'MID' else 'PP' end as zone from ranked", RASTER, CELLS, MEANS, RANKED))
def zones_by_rank(spark, sf_dir):
    return features.zones_by_rank(means(spark, sf_dir).withColumn("cluster", F.col("label") % 7), "uid", "c2")


@query(sql("""select uid, cluster, case when cluster = p then 'PP' when row_number() over (partition by uid order by cast(cluster = p as int), pv desc, cluster) = 1 then 'PV' else 'MID' end as zone from
  (select uid, label % 5 as cluster, avg(c0) as pp, avg(c2) as pv from means group by all) m join (select uid as u, arg_max(cluster, (pp, -cluster)) as p from (select uid, label % 5 as cluster, avg(c0) as pp from means group by all) group by uid) b on m.uid = b.u""", RASTER, CELLS, MEANS))
def zones_by_score(spark, sf_dir):
    return features.zones_by_score(means(spark, sf_dir).withColumn("cluster", F.col("label") % 5), "uid", "c0", "c2")


@query(sql("select c.uid, c.y, c.x, m.area from cells c join means m on c.uid = m.uid and c.label = m.label", RASTER, CELLS, MEANS))
def label_lookup(spark, sf_dir):
    return cells(spark, sf_dir).join(means(spark, sf_dir).select("uid", "label", "area"), ["uid", "label"]).select("uid", "y", "x", "area")


@query()
def slic(spark, sf_dir):
    return features.superpixels(t.raster(spark, sf_dir), ["uid"], ["c0", "c2"], step=10, rounds=3)


@query(sql("select l.uid, y, x, threshold, l.c2 > threshold as tissue from raster l join otsu o on l.uid = o.uid", RASTER, otsu_sql("raster", "uid", "c2")))
def otsu_mask(spark, sf_dir):
    from histospark.operators.hist import otsu

    r = t.raster(spark, sf_dir)
    return r.join(otsu(r, ["uid"], "c2"), "uid").select("uid", "y", "x", "threshold", (F.col("c2") > F.col("threshold")).alias("tissue"))


@query()
def filter_channels(spark, sf_dir):
    from histospark.plans.pipeline import filtered_channels

    return filtered_channels(t.pixels(spark, sf_dir))


@query()
def load_stack(spark, sf_dir):
    from histospark.plans.pipeline import loaded_stack

    return loaded_stack(t.pixels(spark, sf_dir), (50, 60), [1], 0.5)


@query()
def vessels(spark, sf_dir):
    from histospark.plans.pipeline import vessels as classed

    zone = F.when(F.col("c2") >= 170, "PV").when(F.col("c2") >= 85, "MID").otherwise("PP")
    zones = t.raster(spark, sf_dir).select("uid", "y", "x", zone.alias("zone"))
    return classed(comp.holes(t.mask(spark, sf_dir), (50, 60)), zones, 2, 5, 0.4)


#: Holes of the mask with rings of one pixel on both sides of their border, the ring's shares of two zones, and the gates of both classes.
GATED = """cross_ as (select unnest([0, 0, 0, 1, -1]) as dy, unnest([0, 1, -1, 0, 0]) as dx),
ringed as (select distinct uid, label, y + dy as y, x + dx as x from holes, cross_ except select h.uid, h.label, h.y, h.x from holes h, cross_ join holes n on n.uid = h.uid and n.label = h.label and n.y = h.y + dy and n.x = h.x + dx group by all having count(*) = 5),
shares as (select r.uid, label, avg(cast(c2 < 85 as double)) as pp, avg(cast(c2 >= 170 as double)) as pv from ringed r join raster p on p.uid = r.uid and p.y = r.y and p.x = r.x where c2 < 85 or c2 >= 170 group by r.uid, label),
shaped as (select p.uid, p.label, count(distinct (p.y, p.x)) as area, 4 * count(distinct (p.y, p.x)) - count(q.y) as perimeter from holes p left join holes q on q.uid = p.uid and q.label = p.label and abs(q.y - p.y) + abs(q.x - p.x) = 1 group by all),
classed as (select s.uid, s.label, case when pp >= 0.3 and (pv < 0.2 or pp >= pv) then 'PP' when pv >= 0.2 then 'PV' end as zone, area, 4 * 3.141592653589793::double * area / (perimeter * perimeter) as circularity from shaped s join shares h on h.uid = s.uid and h.label = s.label)"""


@query(sql("select uid, label, zone, area, round(circularity, 9) as circularity from classed where zone = 'PP' and area >= 2 and (area >= 5 or circularity >= 0.6) or zone = 'PV' and area >= 1 and (area >= 4 or circularity >= 0.7)", RASTER, MASK_SQL, OFF, HOLES, GATED))
def vessel_gates(spark, sf_dir):
    """Holes of the mask as vessels of two classes by ring share, area and circularity; components cut by the frame are tested against brute force."""
    from histospark.operators.stencil import ring
    from histospark.plans import pipeline

    holes_ = comp.holes(t.mask(spark, sf_dir), (50, 60)).select("uid", "label", "y", "x")
    zone = F.when(F.col("c2") >= 170, "PV").when(F.col("c2") >= 85, "MID").otherwise("PP")
    gates = {"PP": pipeline.Gate(0.3, 2, 5, 0.6), "PV": pipeline.Gate(0.2, 1, 4, 0.7)}
    found = pipeline.gated_vessels(ring(holes_, ["uid", "label"], 1), pipeline.components_of(holes_, 1), t.raster(spark, sf_dir).select("uid", "y", "x", zone.alias("zone")), gates)
    return rounded(found, "circularity", digits=9)


@query()
def instances(spark, sf_dir):
    from histospark.plans.pipeline import gap_closed_instances

    return gap_closed_instances(t.raster(spark, sf_dir).where("c2 between 100 and 110").select("uid", "y", "x"), (50, 60))


PREVIEW = """gam as (select m.uid, label, (case when h0 - l0 > 1e-6 then power((greatest(l0, least(h0, c0)) - l0) / (h0 - l0), 0.7) * (h0 - l0) + l0 else c0 end) * 1.2::double as c0, (case when h2 - l2 > 1e-6 then power((greatest(l2, least(h2, c2)) - l2) / (h2 - l2), 0.7) * (h2 - l2) + l2 else c2 end) * 1.7::double as c2
  from means m join (select uid, quantile_cont(c0, 0.01) as l0, quantile_cont(c0, 0.99) as h0, quantile_cont(c2, 0.01) as l2, quantile_cont(c2, 0.99) as h2 from means group by uid) q on m.uid = q.uid)"""


@query(sql("select uid, label, round(case when hi > lo then ((c0 + c2) / 2 - lo) / (hi - lo) else 0 end, 6) as preview from (select *, min((c0 + c2) / 2) over (partition by uid) as lo, max((c0 + c2) / 2) over (partition by uid) as hi from gam)", RASTER, CELLS, MEANS, PREVIEW))
def weighting_preview(spark, sf_dir):
    """Gamma and polarity weighting of a portal and a central channel, and their mean."""
    out = means(spark, sf_dir)
    for c in ("c0", "c2"):
        out = features.gamma_weighted(out, ["uid"], c, 0.7).drop(c).withColumnRenamed("weighted", c)
    out = features.polarity_weighted(out, ["c0"], ["c2"], 1.2, 1.7)
    return rounded(features.preview(out, ["uid"], ["c0", "c2"]).select("uid", "label", "preview"), "preview")


@query()
def vessels_not_nested(spark, sf_dir):
    return comp.without_nested(comp.labelled(t.mask(spark, sf_dir), eight=True))


@query(sql("select distinct uid, label from cells where (uid, label) not in (select (uid, label) from cells where y = 0 or x = 0 or y = 49 or x = 59) and (uid, label) not in (select (uid, label) from means where c0 > 130)", RASTER, CELLS, MEANS))
def inner_regions(spark, sf_dir):
    return comp.inner_regions(cells(spark, sf_dir), (50, 60), means(spark, sf_dir).where("c0 > 130").select("uid", "label"))


@query(sql("""select o.uid, o.label, coalesce(taken, zone) as zone from (select uid, label, min(case when c2 >= 128 then 'PV' else 'PP' end) as zone from cells group by uid, label) o
  left join (select uid, label, arg_min(case when c1 % 2 = 0 then 'PP' else 'MID' end, (c1, case when c1 % 2 = 0 then 'PP' else 'MID' end)) as taken from cells where c0 >= 245 group by uid, label) v on v.uid = o.uid and v.label = o.label""", RASTER, CELLS))
def zones_under_vessels(spark, sf_dir):
    from histospark.plans.pipeline import reassigned

    own = cells(spark, sf_dir).select("uid", "label", "y", "x", F.when(F.col("c2") >= 128, "PV").otherwise("PP").alias("zone"))
    under = t.raster(spark, sf_dir).where("c0 >= 245").select("uid", "y", "x", F.when(F.col("c1") % 2 == 0, "PP").otherwise("MID").alias("vessel_zone"), F.col("c1").alias("area"))
    return reassigned(own, under)
