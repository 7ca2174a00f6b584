"""Queries of slide catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from histospark.functions import color
from histospark.plans.registry import query
from histospark.sources import catalog as cat
from histospark.sources import tables as t
from histospark.sources.tables import MANIFEST, sql

NAME = "list_extract(string_split(path, '/'), -1)"


@query(sql(f"select uid as n, {NAME} as filename, regexp_extract({NAME}, '(\\.[^.]+)$', 1) as format, regexp_replace({NAME}, '(\\.[^.]+)+$', '') as stem, case when uid % 2 = 0 then 's' || uid else '20240229-' || left(sha256(path), 8) end as stable_uid from manifest", MANIFEST))
def record_defaults(spark, sf_dir):
    """Every second record has a uid already."""
    m = t.manifest(spark, sf_dir).select(F.col("uid").alias("n"), "path", F.when(F.col("uid") % 2 == 0, F.concat(F.lit("s"), "uid")).alias("uid"))
    return cat.with_defaults(m, on="20240229").select("n", "filename", "format", "stem", "stable_uid")


@query(sql("select uid, case when uid % 3 = 0 then 'set' else channel end as channel, case when uid % 3 = 0 and uid % 2 = 0 then 2.5::double else size_um end as size_um from manifest", MANIFEST))
def set_fields(spark, sf_dir):
    """A change sets the channel of every third record, and the size of every sixth."""
    m = t.manifest(spark, sf_dir).select("uid", "channel", "size_um")
    return cat.updated(m, m.where("uid % 3 = 0").select("uid", F.lit("set").alias("channel"), F.when(F.col("uid") % 2 == 0, 2.5).alias("size_um")))


@query(sql("select uid, version, channel from manifest where uid % 3 <> 0 or uid % 2 = 0 union all select uid, version + case when uid % 2 = 0 then -1 else 1 end, 'new' from manifest where uid % 3 = 0 and uid % 2 <> 0", MANIFEST))
def catalog_upsert(spark, sf_dir):
    m = t.manifest(spark, sf_dir).select("uid", "version", "channel")
    new = m.where("uid % 3 = 0").select("uid", (F.col("version") + F.when(F.col("uid") % 2 == 0, -1).otherwise(1)).alias("version"), F.lit("new").alias("channel"))
    return cat.upserted(m, new)


@query(sql("select uid, path from manifest where uid % 7 <> 0", MANIFEST))
def catalog_delete(spark, sf_dir):
    m = t.manifest(spark, sf_dir).select("uid", "path")
    return cat.deleted(m, m.where("uid % 7 = 0"))


@query(sql("select uid, path from manifest where uid % 5 = 1", MANIFEST))
def missing_files(spark, sf_dir):
    m = t.manifest(spark, sf_dir).select("uid", F.col("path").alias("path_storage"))
    return cat.missing_files(m, m.where("uid % 5 <> 1").select(F.col("path_storage").alias("path"))).select("uid", F.col("path_storage").alias("path"))


#: The dyes' and the palette's colours as packed integers, written out so that the SQL doesn't repeat the code.
BLUE, GREEN, RED, MAGENTA = 65535, 16711935, -16776961, -16711681
PACKED = (RED, GREEN, BLUE, MAGENTA, 16777215, -65281, -8388353, -1727987713, 11750911, -6710785)
DYES = ("DAPI", "FITC", "TRITC", "Cy5", "AF568 x", "far-red", "Alexa 488", "filter 555", "Texas Red", "none")
DYE_SQL = f"case when name in ('DAPI', 'Hoechst 33342') then {BLUE} when name in ('FITC', 'GFP', 'Alexa 488') then {GREEN} when name in ('TRITC', 'Texas Red', 'AF568 x') or name like 'Cy3%' then {RED} when name in ('Cy5', 'far-red') then {MAGENTA} when index = 0 then {RED} when index = 1 then {GREEN} when index = 2 then {BLUE} else {MAGENTA} end"


@query(sql(f"select uid, index, name, {DYE_SQL} as color from (select uid, index, case when index = 0 then channel when index = 2 then 'Cy3 ' || uid when index = 1 then {list(DYES)}[uid % 10 + 1] else 'ch' || index end as name from manifest, (select unnest(range(4)) as index))", MANIFEST))
def channel_defaults(spark, sf_dir):
    dye = F.element_at(F.array(*map(F.lit, DYES)), (F.col("uid") % 10 + 1).cast("int"))
    m = t.manifest(spark, sf_dir).withColumn("stains", F.create_map(F.lit(0), F.col("channel"), F.lit(1), dye, F.lit(2), F.concat(F.lit("Cy3 "), F.col("uid")), F.lit(3), F.lit("")))
    return cat.channel_defaults(m, 4).withColumns({"index": F.col("index").cast("long"), "color": F.col("color").cast("int")})


@query(sql(f"select uid, {list(PACKED)}[uid % 10 + 1] as color from manifest", MANIFEST))
def palette_pack(spark, sf_dir):
    return t.manifest(spark, sf_dir).select("uid", color.packed_rgba(color.palette_rgb(F.col("uid"))).alias("color"))


UNITS = ("um", " micron ", "µm", "mm", "", "Micrometer")


@query(sql(f"select uid, case trim(u) when '' then null when 'mm' then 'mm' else 'µm' end as unit, regexp_replace(channel || '/' || uid, '[^A-Za-z0-9._-]', '_', 'g') as slug from (select *, {list(UNITS)}[uid % 6 + 1] as u from manifest)", MANIFEST))
def units_and_slugs(spark, sf_dir):
    u = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("uid") % 6 + 1).cast("int"))
    return t.manifest(spark, sf_dir).select("uid", color.length_unit(u).alias("unit"), color.slug(F.concat("channel", F.lit("/"), "uid")).alias("slug"))


@query(sql("select c.uid, coalesce(c.size_um, p.size_um) as size_um, 'µm' as unit from manifest c left join manifest p on p.uid = c.uid // 10", MANIFEST))
def inherit_calibration(spark, sf_dir):
    m = t.manifest(spark, sf_dir)
    children = m.select("uid", F.expr("uid div 10").alias("parent_uid"), "size_um", F.when(F.col("uid") % 2 == 0, "um").alias("unit"))
    return cat.calibrated(children, m.select("uid", "size_um", F.lit("micron").alias("unit")))


@query(sql("select uid, case when size_um is null and s is null then 0.5::double else size_um end as x, case when size_um is null and s is null then 0.5::double else s end as y from (select *, case when uid % 3 = 0 then size_um end as s from manifest)", MANIFEST))
def inject_calibration(spark, sf_dir):
    x, y = cat.injected_calibration(F.col("size_um"), F.when(F.col("uid") % 3 == 0, F.col("size_um")), F.lit(0.5))
    return t.manifest(spark, sf_dir).select("uid", x.alias("x"), y.alias("y"))


DERIVED = f"regexp_replace(path, '[^/]*$', '') || regexp_replace({NAME}, '(\\.[^.]+)+$', '') || o || '.tiff'"


@query(sql(f"select uid || '-' || left(sha256(p), 8) as uid, uid as parent_uid, p as path from (select uid, {DERIVED} as p from manifest, (select unnest(['_cropped', '-ch_0']) as o))", MANIFEST))
def derived_records(spark, sf_dir):
    return cat.derived_records(t.manifest(spark, sf_dir), ["_cropped", "-ch 0"])


@query(sql("""select uid, case when word = 'Fluorescence' then 'fluorescence'
  when word = 'fluor H&E' then case when colour then 'brightfield' else 'fluorescence' end
  when colour then 'brightfield' when word in ('IHC', 'the other') and (channels = 1 or dims = 2) then 'brightfield' when dims = 3 and channels > 1 then 'fluorescence' else 'brightfield' end as modality
  from (select *, dims = 3 and channels = 3 and uid % 2 = 0 as colour from (select uid, ['Fluorescence', 'fluor H&E', 'IHC', 'the other', 'plain', null][uid % 6 + 1] as word, uid // 6 % 4 + 1 as channels, uid // 24 % 2 + 2 as dims from manifest))""", MANIFEST))
def modality(spark, sf_dir):
    """Six image types with one to four channels, two or three dimensions, bytes or not."""
    word = F.element_at(F.array(*map(F.lit, ("Fluorescence", "fluor H&E", "IHC", "the other", "plain", None))), (F.col("uid") % 6 + 1).cast("int"))
    return t.manifest(spark, sf_dir).select("uid", cat.modality(word, F.expr("uid div 6 % 4 + 1"), F.expr("uid div 24 % 2 + 2"), F.col("uid") % 2 == 0).alias("modality"))


@query(sql("select uid, case when uid % 11 = 0 then 'CUSTOM' else ['HED', 'H-DAB', 'H&E', 'H-DAB', null, 'H&E', null, 'H-DAB', 'H&E'][uid % 9 + 1] end as profile, case when channel = 'unknown' then 'stain_' || uid else channel end as display from manifest", MANIFEST))
def stain_profiles(spark, sf_dir):
    """By alias, by stains, by words of the type and the name; eosin alone and unknown aliases fit nothing."""
    r = F.col("uid") % 9
    stains = F.when(r == 2, F.array(F.lit(" Hematoxylin"), F.lit("eosin"))).when(r == 3, F.array(F.lit("DAB"), F.lit("hematoxylin"), F.lit("x"))).when(r == 4, F.array(F.lit("Eosin")))
    kind, name = F.when(r == 7, "IHC").when(r == 5, "H&E"), F.when(r == 8, "the_slide.tiff").otherwise("plain")
    profile = cat.stain_profile(F.when(r == 0, "HED").when(r == 1, "H_DAB").when(r == 6, "he"), stains, kind, name, custom=F.col("uid") % 11 == 0)
    return t.manifest(spark, sf_dir).select("uid", profile.alias("profile"), cat.display_name(F.when(F.col("channel") != "unknown", F.col("channel")), F.lit(" "), index=F.col("uid")).alias("display"))


@query(sql(f"""select n.s as name, coalesce(min(path) filter (base = n.s || '.ome.tif'), min(path) filter (base = n.s || '.tiff'), min(path)) as file
  from (select distinct regexp_replace({NAME}, '(\\.[^.]+)+$', '') as s from manifest union select 'ab' union select 'h') n join (select path, {NAME} as base from manifest) f on starts_with(f.base, n.s) group by n.s""", MANIFEST))
def registered_files(spark, sf_dir):
    """The stems of all slides, and two short names."""
    m = t.manifest(spark, sf_dir)
    names = m.select(color.stem(color.file_name(F.col("path"))).alias("name")).union(spark.range(2).select(F.when(F.col("id") == 0, "ab").otherwise("h"))).distinct()
    return cat.registered_files(names, m.select(F.col("path").alias("file")), [".ome.tif", ".tiff"])


@query(sql(f"select uid, path, case when uid % 2 = 0 then path || '.reg' when uid % 3 = 0 then regexp_replace({NAME}, '(\\.[^.]+)+$', '') || '.tiff.reg' end as registered from manifest", MANIFEST))
def registered_paths(spark, sf_dir):
    m = t.manifest(spark, sf_dir).select("uid", "path")
    exact = m.where("uid % 2 = 0").select("path", F.concat("path", F.lit(".reg")).alias("registered"))
    by_stem = m.where("uid % 3 = 0 and uid % 2 <> 0").select(F.concat(color.stem(color.file_name(F.col("path"))), F.lit(".tiff")).alias("path"))
    return cat.updated_paths(m, exact.union(by_stem.select("path", F.concat("path", F.lit(".reg")).alias("registered"))))


@query(sql("select uid as index, path from manifest where uid in (0, 4, 7)", MANIFEST))
def input_selection(spark, sf_dir):
    return cat.selected_inputs(t.manifest(spark, sf_dir).select(F.col("uid").alias("index"), "path"), [1, 5, 8])


OME = "<OME xmlns=\"o\"><Image><Pixels PhysicalSizeX=\"{x}\" PhysicalSizeYUnit=\"um\"><Channel ID=\"C:0\" Name=\"{n}\"/><Channel ID=\"C:1\" Name=\"second\" Color=\"65535\"/></Pixels></Image></OME>"


def xml(m):
    return m.withColumn("xml", F.concat(F.lit(OME.split("{x}")[0]), F.coalesce(F.col("size_um").cast("string"), F.lit("?")), F.lit(OME.split("{x}")[1].split("{n}")[0]), "channel", F.lit(OME.split("{n}")[1])))


@query(sql("select uid, size_um as size_x, cast(null as double) as size_y, 'µm' as unit, channel || ',second' as names, '-,65535' as colors from manifest", MANIFEST))
def ome_records(spark, sf_dir):
    return cat.ome_records(xml(t.manifest(spark, sf_dir)), "xml").withColumns({"names": F.array_join("names", ","), "colors": F.array_join(F.col("colors").cast("array<string>"), ",", "-")})


@query(sql("select uid, case when uid % 2 = 0 then 'own' else channel end as first, 'second' as other, case when uid % 2 = 0 then 7 end as color0, 65535 as color1 from manifest", MANIFEST))
def enrich_channels(spark, sf_dir):
    """Names and colours from OME XML, where the record has none of its own."""
    m = xml(t.manifest(spark, sf_dir))
    none = F.lit(None).cast("double")
    own = m.select("uid", none.alias("size_x"), none.alias("size_y"), F.lit(None).cast("string").alias("unit"), F.when(F.col("uid") % 2 == 0, F.create_map(F.lit(0), F.lit("own"), F.lit(1), F.lit(""))).alias("stains"), F.when(F.col("uid") % 2 == 0, F.create_map(F.lit(0), F.lit(7))).alias("channel_colors"))
    got = cat.enriched(own, cat.ome_records(m, "xml"))
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    return got.select("uid", at("stains", 0).alias("first"), at("stains", 1).alias("other"), at("channel_colors", 0).alias("color0"), at("channel_colors", 1).alias("color1"))


@query(sql(f"select '20240229-' || left(sha256(path), 8) as uid, path, {NAME} as filename, size_um as size_x, 'µm' as unit, channel as first, 65535 as color1 from manifest", MANIFEST))
def import_slides(spark, sf_dir):
    """Files become records: defaults, then what their OME XML says."""
    m = xml(t.manifest(spark, sf_dir))
    got = cat.import_slides(m.select("path"), m.select("path", "xml"), "20240229")
    return got.select("uid", "path", "filename", "size_x", "unit", F.try_element_at("stains", F.lit(0)).alias("first"), F.try_element_at("channel_colors", F.lit(1)).alias("color1"))


@query(sql("select uid, index, case index when 0 then channel when 1 then 'second' else 'Channel 3' end as name from manifest, (select unnest(range(3)) as index)", MANIFEST))
def channel_names(spark, sf_dir):
    return cat.channel_names(xml(t.manifest(spark, sf_dir)), "xml", 3).withColumn("index", F.col("index").cast("long"))


@query(sql("select uid, case when uid % 2 = 0 then 9.0::double else size_um end as size_x, size_um as size_y, case when uid % 2 = 0 then 'nm' else 'µm' end as unit from manifest", MANIFEST))
def enrich(spark, sf_dir):
    m = t.manifest(spark, sf_dir)
    own = m.select("uid", F.when(F.col("uid") % 2 == 0, 9.0).alias("size_x"), F.lit(None).cast("double").alias("size_y"), F.when(F.col("uid") % 2 == 0, "nm").alias("unit"))
    return cat.enriched(own, m.select("uid", F.col("size_um").alias("size_x"), F.col("size_um").alias("size_y"), F.lit("µm").alias("unit")))


@query(sql("select uid, case when uid % 3 = 0 then 20.0::double when uid % 3 = 1 then round_even(2.5::double * (uid % 7), 0) else 1.0::double end as magnification, uid % 2 = 0 and uid % 5 in (0, 1) as rgb from manifest", MANIFEST))
def magnification(spark, sf_dir):
    scales = F.when(F.col("uid") % 3 == 1, F.array(F.lit(2.5), (F.col("uid") % 7).cast("double"))).otherwise(F.array().cast("array<double>"))
    r = F.col("uid") % 5
    rgb = cat.true_rgb(F.when(F.col("uid") % 2 == 0, 1).otherwise(3), F.when(r == 0, "Bgr24").otherwise("Gray8"), F.when(r == 1, 3).otherwise(1), F.lit(1))
    return t.manifest(spark, sf_dir).select("uid", cat.magnification(F.when(F.col("uid") % 3 == 0, 20.0), scales).alias("magnification"), rgb.alias("rgb"))


@query(sql("select path, case when path like '%.czi' then null when regexp_matches(path, '\\.tiff?$') then path end as source from manifest", MANIFEST))
def ome_source(spark, sf_dir):
    return cat.ome_source(t.manifest(spark, sf_dir).select("path"))


@query(sql("select c.uid, coalesce(case when c.uid % 4 <> 0 then c.size_um end, p.size_um, case when c.uid % 3 = 0 then c.size_um end, p.size_um * 2) as size_x, coalesce(case when c.uid % 3 = 0 then c.size_um end, p.size_um * 2, case when c.uid % 4 <> 0 then c.size_um end, p.size_um) as size_y, case when c.uid % 2 = 0 or p.uid is not null then 'µm' end as unit from manifest c left join manifest p on p.uid = c.uid // 10", MANIFEST))
def inherit_sizes(spark, sf_dir):
    """Both pixel sizes and the unit, filled from the record of a tenth of the slide's number."""
    m = t.manifest(spark, sf_dir)
    children = m.select("uid", F.expr("uid div 10").alias("parent_uid"), F.when(F.col("uid") % 4 != 0, F.col("size_um")).alias("size_x"), F.when(F.col("uid") % 3 == 0, F.col("size_um")).alias("size_y"), F.when(F.col("uid") % 2 == 0, "um").alias("unit"))
    return cat.inherited_sizes(children, m.select("uid", F.col("size_um").alias("size_x"), (F.col("size_um") * 2).alias("size_y"), F.lit("micron").alias("unit")))


@query(sql("select uid, round(size_um * 1e-6 * case uid % 6 when 0 then 1e6 when 1 then 1e9 when 2 then 1e3 when 3 then 1e2 when 4 then 1.0 end, 9) as size from manifest", MANIFEST))
def display_sizes(spark, sf_dir):
    """Pixel sizes in metres, as a scanner stores them, in each slide's unit; an unknown unit has none."""
    unit = F.element_at(F.array(*map(F.lit, ("um", "nm", "mm", "cm", "m", "inch"))), (F.col("uid") % 6 + 1).cast("int"))
    return t.manifest(spark, sf_dir).select("uid", F.round(color.in_unit(F.col("size_um") * 1e-6, unit), 9).alias("size"))
