"""Queries of stain and neighbourhood operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from histospark.operators import stain, stencil, tiles
from histospark.plans.registry import SQL, query
from histospark.plans.statistics import BACKGROUND, otsu_sql, rounded
from histospark.sources import tables as t
from histospark.sources.tables import MASK_SQL, RASTER, sql

OD = "od as (select uid, y, x, c0, c1, c2, -ln((c0 + 1) / 240.0::double) as o0, -ln((c1 + 1) / 240.0::double) as o1, -ln((c2 + 1) / 240.0::double) as o2 from raster)"
#: A given basis, so that what follows the eigenvectors has exact SQL.
BASIS = (0.65, 0.70, 0.29, 0.27, 0.57, 0.78)
HH, EE, HE = sum(v * v for v in BASIS[:3]), sum(v * v for v in BASIS[3:]), sum(a * b for a, b in zip(BASIS[:3], BASIS[3:], strict=True))
H_OD = "(" + " + ".join(f"{v!r} * o{k}" for k, v in enumerate(BASIS[:3])) + ")"
E_OD = "(" + " + ".join(f"{v!r} * o{k}" for k, v in enumerate(BASIS[3:])) + ")"
CONC = f"conc as (select uid, y, x, cast(({EE!r}::double * {H_OD} - {HE!r}::double * {E_OD}) / {HH * EE - HE * HE!r}::double as double) as conc0, cast(({HH!r}::double * {E_OD} - {HE!r}::double * {H_OD}) / {HH * EE - HE * HE!r}::double as double) as conc1 from od)"
MAXC = "maxc as (select uid, quantile_cont(conc0, 0.99) as max0, quantile_cont(conc1, 0.99) as max1 from conc group by uid)"


def basis(spark, sf_dir):
    names = ["h0", "h1", "h2", "e0", "e1", "e2"]
    return t.raster(spark, sf_dir).select("uid").distinct().select("uid", *[F.lit(v).alias(n) for n, v in zip(names, BASIS, strict=True)])


@query(sql("select uid, y, x, round(o0, 9) + 0.0 as o0, round(o1, 9) + 0.0 as o1, round(-log10(greatest(c2 / 255.0::double, 1e-8)), 9) + 0.0 as o2 from od", RASTER, OD))
def optical_density(spark, sf_dir):
    r = t.raster(spark, sf_dir)
    densities = {"o0": stain.optical_density(F.col("c0")), "o1": stain.optical_density(F.col("c1")), "o2": stain.optical_density10(F.col("c2") / 255.0)}
    return r.select("uid", "y", "x", *[(F.round(d, 9) + 0.0).alias(n) for n, d in densities.items()])


@query(sql("select uid, " + ", ".join(f"round(covar_samp(o{a}, o{b}), 8) as v{a}{b}" for a in range(3) for b in range(a, 3)) + " from od group by uid", RASTER, OD))
def od_covariance(spark, sf_dir):
    return rounded(stain.od_covariance(t.raster(spark, sf_dir), ["uid"]), *[f"v{a}{b}" for a in range(3) for b in range(a, 3)], digits=8)


LUMA = "lum as (select uid, y, x, cast(floor(c0 * 0.299::double + c1 * 0.587::double + c2 * 0.114::double + 0.5) as bigint) as gray from raster)"


@query(sql("select l.uid, y, x from lum l join otsu o on l.uid = o.uid where gray < threshold and (y * 60 + x) % 10 = 0", RASTER, LUMA, otsu_sql("lum", "uid", "gray")))
def tissue_sample(spark, sf_dir):
    return stain.tissue_sample(t.raster(spark, sf_dir), ["uid"], 60).select("uid", "y", "x")


@query()
def stain_basis(spark, sf_dir):
    return stain.stain_basis(stain.tissue_sample(t.raster(spark, sf_dir), ["uid"], 60), ["uid"])


@query(sql("select uid, y, x, round(conc0, 6) as conc0, round(conc1, 6) as conc1 from conc", RASTER, OD, CONC))
def concentrations(spark, sf_dir):
    return rounded(stain.concentrations(t.raster(spark, sf_dir), basis(spark, sf_dir), ["uid"]), "conc0", "conc1").select("uid", "y", "x", "conc0", "conc1")


@query(sql("select uid, round(max0, 6) as max0, round(max1, 6) as max1 from maxc", RASTER, OD, CONC, MAXC))
def max_concentrations(spark, sf_dir):
    return rounded(stain.max_concentrations(stain.concentrations(t.raster(spark, sf_dir), basis(spark, sf_dir), ["uid"]), ["uid"]), "max0", "max1")


def clamp(e: str) -> str:
    return f"cast(floor(case when {e} > 255 then 254 else {e} end) as bigint)"


NORM = ", ".join(clamp(f"(240 * exp(-({a!r}::double * n0 + {b!r}::double * n1)))") + f" as c{k}" for k, (a, b) in enumerate(stain.REFERENCE))


@query(sql(f"select uid, y, x, {NORM} from (select c.uid, y, x, conc0 / (max0 / {stain.REFERENCE_MAX[0]}::double) as n0, conc1 / (max1 / {stain.REFERENCE_MAX[1]}::double) as n1 from conc c join maxc m on c.uid = m.uid)", RASTER, OD, CONC, MAXC))
def normalize_given_basis(spark, sf_dir):
    return stain.normalised_stain(t.raster(spark, sf_dir), basis(spark, sf_dir), ["uid"])


@query(sql(f"select c.uid, y, x, {clamp('(240 * exp(-(conc0 / max0)))')} as h, {clamp('(240 * exp(-(conc1 / max1)))')} as e from conc c join maxc m on c.uid = m.uid", RASTER, OD, CONC, MAXC))
def separate_given_basis(spark, sf_dir):
    return stain.separated_stains(t.raster(spark, sf_dir), basis(spark, sf_dir), ["uid"])


@query()
def normalize_stain(spark, sf_dir):
    r = t.raster(spark, sf_dir)
    return stain.normalised_stain(r, stain.stain_basis(stain.tissue_sample(r, ["uid"], 60), ["uid"]), ["uid"])


@query()
def separate_stains(spark, sf_dir):
    r = t.raster(spark, sf_dir)
    return stain.separated_stains(r, stain.stain_basis(stain.tissue_sample(r, ["uid"], 60), ["uid"]), ["uid"])


#: The stain vectors, written out again for the SQL, which scales and inverts them itself (by cofactors).
STAINS_SQL = "(values ('Hematoxylin', 0.650::double, 0.704::double, 0.286::double), ('Eosin', 0.072, 0.990, 0.105), ('DAB', 0.268, 0.570, 0.776)) as v(stain, r, g, b)"


def deconvolution_sql(names: tuple[str, ...], shown: tuple[str, ...] | None = None) -> str:
    """Each stain alone, under its name or the one to be shown; where two are given, the third vector is their cross product."""
    unit = f"unit as (select stain, r / sqrt(r * r + g * g + b * b) as r, g / sqrt(r * r + g * g + b * b) as g, b / sqrt(r * r + g * g + b * b) as b from {STAINS_SQL} where stain in {names})"
    a, b = (f"select * from unit where stain = '{n}'" for n in names[:2])
    crossed = f"select 'rest' as stain, p.g * q.b - p.b * q.g as r, p.b * q.r - p.r * q.b as g, p.r * q.g - p.g * q.r as b from ({a}) p, ({b}) q"
    third = f"select * from unit where stain = '{names[2]}'" if len(names) > 2 else f"select stain, r / sqrt(r * r + g * g + b * b) as r, g / sqrt(r * r + g * g + b * b) as g, b / sqrt(r * r + g * g + b * b) as b from ({crossed})"
    flat = f"flat as (select a.r as a0, a.g as a1, a.b as a2, b.r as b0, b.g as b1, b.b as b2, c.r as c0, c.g as c1, c.b as c2 from ({a}) a, ({b}) b, ({third}) c)"
    whole = "whole as (select *, a0 * (b1 * c2 - b2 * c1) - b0 * (a1 * c2 - a2 * c1) + c0 * (a1 * b2 - a2 * b1) as det from flat)"
    d = {"a": "(p0 * (b1 * c2 - b2 * c1) + p1 * (b2 * c0 - b0 * c2) + p2 * (b0 * c1 - b1 * c0)) / det", "b": "(p0 * (a2 * c1 - a1 * c2) + p1 * (a0 * c2 - a2 * c0) + p2 * (a1 * c0 - a0 * c1)) / det", "c": "(p0 * (a1 * b2 - a2 * b1) + p1 * (a2 * b0 - a0 * b2) + p2 * (a0 * b1 - a1 * b0)) / det"}
    out = []
    for n, v in zip(shown or names, "abc", strict=False):
        planes = ", ".join(f"cast(floor(255 * greatest(0.0, least(1.0, pow(10, -({d[v]}) * {v}{k}))) + 1e-9) as bigint) as {c}" for k, c in enumerate("rgb"))
        out.append(f"select uid, y, x, '{n}' as stain, {planes} from dens, whole")
    return sql(" union all ".join(out), RASTER, unit, flat, whole, "dens as (select uid, y, x, " + ", ".join(f"-log10(greatest(c{k} / 255.0::double, 1e-8)) as p{k}" for k in range(3)) + " from raster)")


@query(deconvolution_sql(("Hematoxylin", "Eosin", "DAB")))
def deconvolve_hed(spark, sf_dir):
    return stain.deconvolved(t.raster(spark, sf_dir), ["uid"], stain.PROFILES["HED"])


@query(deconvolution_sql(("Hematoxylin", "Eosin")))
def deconvolve_he(spark, sf_dir):
    return stain.deconvolved(t.raster(spark, sf_dir), ["uid"], stain.PROFILES["H&E"])


@query(deconvolution_sql(("Hematoxylin", "DAB"), ("Stain0", "Stain1")))
def deconvolve_custom(spark, sf_dir):
    """A matrix given by hand: a column for each stain."""
    matrix = [[0.650, 0.268], [0.704, 0.570], [0.286, 0.776]]
    return stain.deconvolved(t.raster(spark, sf_dir), ["uid"], stain.custom_profile(matrix))


LEVELS = "pixels as (select uid, 0 as channel, y // 4 as y, x // 4 as x, c0 as value from raster where y % 4 = 0 and x % 4 = 0 union all select uid, 1, y // 4, x // 4, c1 from raster where y % 4 = 0 and x % 4 = 0)"


@query(sql("""select r.uid, level, r.channel, y, x, cast(floor(least(255.0, greatest(value - background, 0.0))) as bigint) as value from (
  select uid, l.level, ch.channel, y // (1 << l.level) as y, x // (1 << l.level) as x, case ch.channel when 0 then c0 else c1 end as value from raster, (select unnest([0, 1, 2]) as level) l, (select unnest([0, 1]) as channel) ch where y % (1 << l.level) = 0 and x % (1 << l.level) = 0) r
  join background b on r.uid = b.uid and r.channel = b.channel""", RASTER, LEVELS, BACKGROUND.replace("64", "512").replace("63", "511")))
def separate_channels(spark, sf_dir):
    from histospark.sources.pyramid import decimated

    p = t.raster(spark, sf_dir).select("uid", "y", "x", F.posexplode(F.array("c0", "c1")).alias("channel", "value"))
    return stain.separated_channels(decimated(p, [0, 1, 2]), ["uid"])


def window_sql(radius: int) -> str:
    return f"near as (select a.uid, a.y, a.x, b.y - a.y as dy, b.x - a.x as dx, b.c0 as value from raster a join raster b on a.uid = b.uid and b.y between a.y - {radius} and a.y + {radius} and b.x between a.x - {radius} and a.x + {radius})"


def channel0(spark, sf_dir):
    return t.raster(spark, sf_dir).select("uid", "y", "x", F.col("c0").alias("value"))


@query(sql("select uid, y, x, round(sum(value * exp(-(dy * dy + dx * dx) / 2.0::double)) / sum(exp(-(dy * dy + dx * dx) / 2.0::double)), 6) as value from near group by uid, y, x", RASTER, window_sql(3)))
def gaussian(spark, sf_dir):
    return rounded(stencil.gaussian_blur(channel0(spark, sf_dir), ["uid"], 1.0, tile=32), "value")


@query(sql("select uid, y, x, quantile_cont(value, 0.5) as value from near group by uid, y, x", RASTER, window_sql(1)))
def median3(spark, sf_dir):
    return stencil.median_blur(channel0(spark, sf_dir), ["uid"], 3, tile=32)


DISC = "disc as (select dy, dx from (select unnest(range(-2, 3)) as dy), (select unnest(range(-2, 3)) as dx) where dy * dy + dx * dx <= 4)"
GROWN = "grown as (select distinct uid, y + dy as y, x + dx as x from mask, disc)"


@query(sql("select uid, y, x from grown", RASTER, MASK_SQL, DISC, GROWN))
def dilate(spark, sf_dir):
    return stencil.dilated(t.mask(spark, sf_dir), ["uid"], 2, tile=16)


@query(sql("select m.uid, m.y, m.x from mask m, disc d join mask n on n.uid = m.uid and n.y = m.y + dy and n.x = m.x + dx group by all having count(*) = (select count(*) from disc)", RASTER, MASK_SQL, DISC))
def erode(spark, sf_dir):
    return stencil.eroded(t.mask(spark, sf_dir), ["uid"], 2, tile=16)


@query(sql("select m.uid, m.y, m.x from grown m, disc d join grown n on n.uid = m.uid and n.y = m.y + dy and n.x = m.x + dx group by all having count(*) = (select count(*) from disc)", RASTER, MASK_SQL, DISC, GROWN))
def close(spark, sf_dir):
    return stencil.closed(t.mask(spark, sf_dir), ["uid"], 2)


@query(sql("""select uid, y, x from grown except select m.uid, m.y, m.x from mask m, disc d join mask n on n.uid = m.uid and n.y = m.y + dy and n.x = m.x + dx group by all having count(*) = (select count(*) from disc)""", RASTER, MASK_SQL, DISC, GROWN))
def ring(spark, sf_dir):
    return stencil.ring(t.mask(spark, sf_dir), ["uid"], 2)


LABELS = "labels as (select uid, y, x, c2 // 64 as label from raster where c2 >= 20)"


def labels(spark, sf_dir):
    return t.raster(spark, sf_dir).where("c2 >= 20").select("uid", "y", "x", F.expr("c2 div 64").alias("label"))


@query(sql("select uid, y, x, label from labels a where (select count(*) from labels b where b.uid = a.uid and b.label = a.label and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1) < 9", RASTER, LABELS))
def boundary(spark, sf_dir):
    return stencil.boundary(labels(spark, sf_dir), ["uid"])


@query(sql("select distinct a.uid, least(a.label, b.label) as a, greatest(a.label, b.label) as b from labels a join labels b on a.uid = b.uid and a.label <> b.label and ((b.y = a.y and b.x = a.x + 1) or (b.x = a.x and b.y = a.y + 1))", RASTER, LABELS))
def adjacency(spark, sf_dir):
    return stencil.label_adjacency(labels(spark, sf_dir), ["uid"])


@query(sql("select distinct a.uid, a.y, a.x, a.label from labels a join labels b on a.uid = b.uid and a.label <> b.label and ((b.y = a.y and b.x = a.x + 1) or (b.x = a.x and b.y = a.y + 1))", RASTER, LABELS))
def label_borders(spark, sf_dir):
    return stencil.label_borders(labels(spark, sf_dir), ["uid"])


@query()
def thin(spark, sf_dir):
    return stencil.thinned(t.mask(spark, sf_dir), ["uid"], tile=32)


CLAHE = """cs as (select uid, (max(y) + 16) // 16 as sy, (max(x) + 16) // 16 as sx from raster group by uid),
cz as (select r.*, sy, sx, y // sy as cy, x // sx as cx from raster r join cs using (uid)),
cc as (select uid, cy, cx, count(*) as total from cz group by all),
ch as (select uid, cy, cx, c0 as v, count(*) as n from cz group by all),
cf as (select cc.uid, cc.cy, cc.cx, total, lv.v, coalesce(n, 0)::double as n from cc cross join (select unnest(range(256)) as v) lv left join ch on ch.uid = cc.uid and ch.cy = cc.cy and ch.cx = cc.cx and ch.v = lv.v),
ck as (select *, least(n, greatest(1.0::double, total * 2.0::double / 256)) as kept, sum(n - least(n, greatest(1.0::double, total * 2.0::double / 256))) over (partition by uid, cy, cx) / 256 as spare from cf),
cm as (select uid, cy, cx, v, sum(kept + spare) over (partition by uid, cy, cx order by v rows unbounded preceding) / total * 255 as mapped from ck),
ce as (select uid, max(cy) as my, max(cx) as mx from cc group by uid),
cp as (select r.uid, r.y, r.x, c0 as v, my, mx, cast(y as double) / sy - 0.5 as fy, cast(x as double) / sx - 0.5 as fx from cz r join ce on r.uid = ce.uid),
cq as (select uid, y, x, v, greatest(0, least(my, cast(floor(fy) as bigint) + dy)) as cy, greatest(0, least(mx, cast(floor(fx) as bigint) + dx)) as cx,
  case when dy = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end * case when dx = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end as w from cp, (select unnest([0, 1]) as dy), (select unnest([0, 1]) as dx))"""


@query(sql("select q.uid, q.y, q.x, cast(floor(sum(w * mapped) + 0.5) as bigint) as byte from cq q join cm m on q.uid = m.uid and q.cy = m.cy and q.cx = m.cx and q.v = m.v group by q.uid, q.y, q.x", RASTER, CLAHE))
def clahe(spark, sf_dir):
    return stencil.equalised(channel0(spark, sf_dir), ["uid"]).select("uid", "y", "x", "byte")


def tiled(spark, sf_dir, side: int) -> tiles.TileSet:
    return tiles.packed(channel0(spark, sf_dir), ["uid"], side)


def tiled_mask(spark, sf_dir, side: int) -> tiles.TileSet:
    return tiles.packed(t.mask(spark, sf_dir), ["uid"], side, None)


@query(SQL["gaussian"])
def tile_gaussian(spark, sf_dir):
    """The blur on packed tiles, of which only strips are shuffled."""
    return rounded(tiles.unpacked(tiles.blurred(tiled(spark, sf_dir, 16), 1.0)), "value")


@query(SQL["median3"])
def tile_median3(spark, sf_dir):
    return tiles.unpacked(tiles.medians(tiled(spark, sf_dir, 16), 3))


@query(SQL["dilate"])
def tile_dilate(spark, sf_dir):
    return tiles.unpacked(tiles.dilated(tiled_mask(spark, sf_dir, 16), 2))


@query(SQL["erode"])
def tile_erode(spark, sf_dir):
    return tiles.unpacked(tiles.eroded(tiled_mask(spark, sf_dir, 16), 2))


@query(SQL["close"])
def tile_close(spark, sf_dir):
    return tiles.unpacked(tiles.closed(tiled_mask(spark, sf_dir, 32), 2))


#: One pass of the Zhang-Suen rule for one of its two sub-iterations, from a view to another.
def pass_sql(name: str, source: str, first: bool) -> str:
    at = ["b.y = a.y - 1 and b.x = a.x", "b.y = a.y - 1 and b.x = a.x + 1", "b.y = a.y and b.x = a.x + 1", "b.y = a.y + 1 and b.x = a.x + 1", "b.y = a.y + 1 and b.x = a.x", "b.y = a.y + 1 and b.x = a.x - 1", "b.y = a.y and b.x = a.x - 1", "b.y = a.y - 1 and b.x = a.x - 1"]
    n = ", ".join(f"coalesce(max(case when {w} then 1 end), 0) as n{k}" for k, w in enumerate(at))
    turns = " + ".join(f"(n{k} = 0 and n{(k + 1) % 8} = 1)::int" for k in range(8))
    spare = ("n0 * n2 * n4 = 0 and n2 * n4 * n6 = 0" if first else "n0 * n2 * n6 = 0 and n0 * n4 * n6 = 0") + f" and {' + '.join(f'n{k}' for k in range(8))} between 2 and 6 and {turns} = 1"
    return f"{name} as materialized (select uid, y, x from (select a.uid, a.y, a.x, {n} from {source} a left join {source} b on b.uid = a.uid and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 group by all) where not ({spare}))"


#: A slide of the mask is thin after fewer pairs of passes than this; later ones change nothing.
PAIRS = 12
PASSES = [pass_sql(f"z{k + 1}", f"z{k}" if k else "mask", k % 2 == 0) for k in range(2 * PAIRS)]
SQL["thin"] = sql(f"select uid, y, x from z{2 * PAIRS}", RASTER, MASK_SQL, *PASSES)


@query(SQL["thin"])
def tile_thin(spark, sf_dir):
    return tiles.unpacked(tiles.thinned(tiled_mask(spark, sf_dir, 32), per_round=4))
