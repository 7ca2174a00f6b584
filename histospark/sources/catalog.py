"""Slide catalogs: records as a DataFrame, their enrichment, and JSON manifests."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histospark.functions.color import dye_rgb, file_name, length_unit, packed_rgba, palette_rgb, slug, stem, suffix

SLIDES = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("path_original", T.StringType()),
        T.StructField("path_storage", T.StringType()),
        T.StructField("filename_original", T.StringType()),
        T.StructField("filename_stored", T.StringType()),
        T.StructField("raw_format_original", T.StringType()),
        T.StructField("raw_format_stored", T.StringType()),
        T.StructField("magnification", T.DoubleType()),
        T.StructField("resolution", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("resolution_unit", T.StringType()),
        T.StructField("image_type", T.StringType()),
        T.StructField("stains", T.MapType(T.IntegerType(), T.StringType())),
        T.StructField("channel_colors", T.MapType(T.IntegerType(), T.IntegerType())),
        T.StructField("annotations", T.MapType(T.StringType(), T.StringType())),
        T.StructField("bit_depth", T.IntegerType()),
        T.StructField("is_float", T.BooleanType()),
    ]
)
#: Words of an image type that name the modality, and the brightfield profiles' aliases.
FLUORESCENCE, BRIGHTFIELD = ("fluor", "fluorescence"), ("brightfield", "immunohistochemistry", "ihc", "h&e", "he", "dab")
PROFILE_ALIASES = {"HE": "H&E", "H_E": "H&E", "H-E": "H&E", "H&E": "H&E", "HDAB": "H-DAB", "H-DAB": "H-DAB", "H_DAB": "H-DAB", "HED": "HED"}
#: Words of an image type or a file name that name a profile, in the order in which they are tried.
PROFILE_WORDS = (("H-DAB", ("ihc", "dab", "h-dab", "hdab")), ("H&E", ("he", "h&e")))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(text.contains(w), F.lit(False))
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One record per JSON object; map keys that are numbers in JSON text become integers."""
    raw = T.StructType([T.StructField(f.name, T.MapType(T.StringType(), f.dataType.valueType) if isinstance(f.dataType, T.MapType) else f.dataType) for f in SLIDES])
    found = spark.read.schema(raw).json(path, multiLine=False)
    whole = lambda c: F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("int"), e["value"])))
    return found.withColumns({"stains": whole("stains"), "channel_colors": whole("channel_colors")})


def write_manifest(slides: DataFrame, path: str) -> None:
    slides.write.mode("overwrite").json(path)


def missing_files(slides: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose stored path isn't among files(path)."""
    return slides.join(files.select(F.col("path").alias("path_storage")), "path_storage", "left_anti")


def with_defaults(df: DataFrame, path: str = "path", on: str = "19700101") -> DataFrame:
    """Adds file name, suffix, stem and stable_uid, which is the record's uid (where it has one) or the
    day ``on`` and eight hex digits of the path's hash."""
    name = file_name(F.col(path))
    made = F.concat(F.lit(f"{on}-"), F.substring(F.sha2(F.col(path), 256), 1, 8))
    own = F.col("uid").cast("string") if "uid" in df.columns else F.lit(None).cast("string")
    return df.withColumns({"filename": name, "format": suffix(name), "stem": stem(name), "stable_uid": F.coalesce(own, made)})


def updated(catalog: DataFrame, changes: DataFrame, key: str = "uid", overwrite: bool = True) -> DataFrame:
    """The catalog with the values that ``changes`` (key and some of its columns) sets; nulls there set
    nothing, and without ``overwrite`` only what is null in the record is set."""
    sets = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in sets])
    pick = lambda c: F.coalesce(f"_new_{c}", c) if overwrite else F.coalesce(c, f"_new_{c}")
    return catalog.join(new, key, "left").select(*[pick(c).alias(c) if c in sets else F.col(c) for c in catalog.columns])


def upserted(catalog: DataFrame, new: DataFrame, key: str = "uid", newest: str = "version") -> DataFrame:
    """Both tables' records, the newest of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(newest), F.desc("_new"))
    both = catalog.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "_new")


def deleted(catalog: DataFrame, keys: DataFrame, key: str = "uid") -> DataFrame:
    return catalog.join(keys.select(key), key, "left_anti")


def channel_defaults(slides: DataFrame, n: int, names: str = "stains") -> DataFrame:
    """uid, index, name, color for channels 0 to n - 1: given names, else ch<i>; colours by dye name, else the palette."""
    every = slides.select("uid", names, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("index"))
    given = F.when(F.try_element_at(names, F.col("index")) != "", F.try_element_at(names, F.col("index")))
    out = every.withColumn("name", F.coalesce(given, F.concat(F.lit("ch"), F.col("index"))))
    return out.select("uid", "index", "name", packed_rgba(dye_rgb(F.col("name"), palette_rgb(F.col("index")))).alias("color"))


def calibrated(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children(uid, parent_uid, size_um, unit) with what is missing taken from the parent's record."""
    p = parents.select(F.col("uid").alias("parent_uid"), F.col("size_um").alias("p_size"), F.col("unit").alias("p_unit"))
    return children.join(p, "parent_uid", "left").select("uid", F.coalesce("size_um", "p_size").alias("size_um"), length_unit(F.coalesce("unit", "p_unit")).alias("unit"))


def injected_calibration(x: Column, y: Column, own: Column) -> tuple[Column, Column]:
    """Pixel sizes for a written file: the record's own only where the caller gave neither."""
    neither = x.isNull() & y.isNull()
    return F.when(neither, own).otherwise(x), F.when(neither, own).otherwise(y)


def derived_records(slides: DataFrame, outputs: list[str]) -> DataFrame:
    """One new record per slide and output suffix: uid, parent_uid, path."""
    each = slides.select("uid", "path", F.explode(F.array(*map(F.lit, outputs))).alias("output"))
    name = F.concat(stem(file_name(F.col("path"))), slug(F.col("output")), F.lit(".tiff"))
    path = F.concat(F.regexp_replace("path", "[^/]*$", ""), name)
    return each.select(F.concat_ws("-", F.col("uid"), F.substring(F.sha2(path, 256), 1, 8)).alias("uid"), F.col("uid").alias("parent_uid"), path.alias("path"))


def modality(image_type: Column, channels: Column, dims: Column, is_bytes: Column) -> Column:
    """fluorescence or brightfield, from words of the image type and the image's form.

    An image of three dimensions with three 8-bit channels looks like colour. Fluorescence words win
    unless it looks so and brightfield words are there too; then what looks like colour is brightfield;
    then brightfield words count for one channel or fewer than three dimensions; then several
    channels mean fluorescence.
    """
    t = F.lower(F.coalesce(image_type, F.lit("")))
    fluorescent, bright = has_any(t, FLUORESCENCE), has_any(t, BRIGHTFIELD)
    colour = F.coalesce((dims == 3) & (channels == 3) & is_bytes, F.lit(False))
    out = F.when(fluorescent & ~(colour & bright), "fluorescence").when(colour, "brightfield")
    return out.when(bright & ((channels == 1) | (dims < 3)), "brightfield").when((dims == 3) & (channels > 1), "fluorescence").otherwise("brightfield")


def stain_profile(alias: Column, stains: Column, image_type: Column, name: Column, strict: bool = False, custom: Column | None = None) -> Column:
    """CUSTOM where a slide has a matrix of its own (``custom`` is true), else H&E, H-DAB or HED: by explicit alias, by stain names (hematoxylin with eosin, or with DAB), then by
    words of the image type and the file name. Where nothing fits, and for an unknown alias: null, or an error if ``strict``."""
    known = F.element_at(F.create_map(*[F.lit(x) for p in PROFILE_ALIASES.items() for x in p]), alias)
    names = F.transform(F.coalesce(stains, F.array().cast("array<string>")), lambda s: F.lower(F.trim(s)))
    has = lambda s: F.coalesce(F.array_contains(names, s), F.lit(False))
    words = F.lower(F.concat(F.coalesce(image_type, F.lit("")), F.lit(" "), F.coalesce(name, F.lit(""))))
    out = F.when(F.coalesce(alias, F.lit("")) != "", known).when(has("hematoxylin") & has("eosin"), "H&E").when(has("dab") & has("hematoxylin"), "H-DAB")
    for profile, tried in PROFILE_WORDS:
        out = out.when(has_any(words, tried), profile)
    out = out if custom is None else F.when(custom, "CUSTOM").otherwise(out)
    return F.coalesce(out, F.raise_error(F.lit("no brightfield stain profile fits; name one")).cast("string")) if strict else out


def display_name(*candidates: Column, index: Column) -> Column:
    """The first candidate that isn't null or empty, else stain_<index>."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in candidates], F.concat(F.lit("stain_"), index))


def registered_files(names: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """name, file: the first exact name + extension in the order of extensions, else the least file of that prefix.

    Each file stands for all lengths of names that there are, so a name meets only files that begin with it.
    """
    exact = F.array_position(F.array(*map(F.lit, extensions)), F.expr("substring(base, length(name) + 1)"))
    named = names.withColumn("size", F.length("name"))
    sizes = named.select("size").distinct()  # a few dozen
    listed = files.select("file", file_name(F.col("file")).alias("base"))
    heads = listed.join(sizes, F.col("size") <= F.length("base")).withColumn("name", F.expr("left(base, size)"))
    joined = named.join(heads.drop("size"), "name")
    rank = F.when(exact > 0, exact).otherwise(1000)
    return joined.groupBy("name").agg(F.min(F.struct(rank.alias("r"), "file"))["file"].alias("file"))


def updated_paths(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """catalog(uid, path) with the registered file of the same path, else of the same stem: uid, path, registered."""
    by_path = files.select("path", F.col("registered").alias("by_path"))
    by_stem = files.select(stem(file_name(F.col("path"))).alias("stem"), "registered").groupBy("stem").agg(F.min("registered").alias("by_stem"))
    joined = catalog.withColumn("stem", stem(file_name(F.col("path")))).join(by_path, "path", "left").join(by_stem, "stem", "left")
    return joined.select("uid", "path", F.coalesce("by_path", "by_stem").alias("registered"))


def selected_inputs(slides: DataFrame, indices: list[int]) -> DataFrame:
    """Slides (index from 0) by a list of indices: -1 is all; a list without 0 counts from 1; others are passed over."""
    if -1 in indices:
        return slides
    shift = 0 if 0 in indices else 1
    return slides.where(F.col("index").isin([i - shift for i in indices]))


def elements(xml: str, name: str) -> list[ElementTree.Element]:
    """All elements of a document of that local name, whatever their namespace."""
    return [e for e in ElementTree.fromstring(xml).iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == name]


SIZES = ("PhysicalSizeX", "PhysicalSizeY", "PhysicalSizeXUnit", "PhysicalSizeYUnit")
NAMING = ("ShortName", "Name", "Id", "DyeName", "Fluor")


def naming_attributes(docs: pd.Series) -> pd.Series:
    """For each attribute that may name a channel, its values at the Channel elements that have it; a document is parsed once."""
    held = (None if xml is None else elements(xml, "Channel") for xml in docs)
    return pd.Series([None if found is None else [[e.get(a) for e in found if a in e.attrib] for a in NAMING] for found in held], dtype=object)


def pixels_elements(docs: pd.Series) -> pd.DataFrame:
    """The first of each size attribute among the Pixels elements, and the channels' names and colours by place; a document is parsed once."""
    out = []
    for xml in docs:
        found = [] if xml is None else elements(xml, "Pixels")
        sizes = [next((e.get(a) for e in found if a in e.attrib), None) for a in SIZES]
        channels = [c for e in found for c in e if isinstance(c.tag, str) and c.tag.rpartition("}")[2] == "Channel"]
        lists = [None if xml is None else [c.get(a) for c in channels] for a in ("Name", "Color")]
        out.append((sizes, *lists))
    return pd.DataFrame(out, columns=["sizes", "names", "colors"], dtype=object)


def channel_names(docs: DataFrame, xml: str, n: int) -> DataFrame:
    """uid, index, name from metadata XML: the first attribute of ShortName, Name, Id, DyeName or Fluor that a Channel element has, else Channel i+1."""
    read = docs.select("uid", F.pandas_udf(naming_attributes, "array<array<string>>")(F.col(xml).cast("string")).alias("lists"))
    every = read.select("uid", "lists", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    got = [F.get(F.get("lists", F.lit(k)), F.col("i") - 1) for k in range(len(NAMING))]
    return every.select("uid", (F.col("i") - 1).alias("index"), F.coalesce(*[F.when(F.trim(v) != "", v) for v in got], F.concat(F.lit("Channel "), F.col("i"))).alias("name"))


def ome_records(docs: DataFrame, xml: str) -> DataFrame:
    """uid, size_x, size_y, unit (of X, else of Y), names and colors of OME XML documents, whatever their
    namespace; null where an attribute is absent. names and colors have one entry for each channel."""
    read = F.pandas_udf(pixels_elements, "sizes array<string>, names array<string>, colors array<string>")
    m = docs.select("uid", read(F.col(xml).cast("string")).alias("_m"))
    size = lambda k: F.get("_m.sizes", F.lit(k))
    names, colors = F.transform("_m.names", lambda n: F.coalesce(n, F.lit(""))), F.transform("_m.colors", lambda c: c.try_cast("int"))
    return m.select("uid", size(0).try_cast("double").alias("size_x"), size(1).try_cast("double").alias("size_y"), length_unit(F.coalesce(size(2), size(3))).alias("unit"), names.alias("names"), colors.alias("colors"))


def enriched(slides: DataFrame, records: DataFrame, overwrite: bool = False) -> DataFrame:
    """slides(uid, size_x, size_y, unit, and if there stains and channel_colors) completed from
    ome_records; a record wins only with ``overwrite``. Names and colours are completed by channel."""
    r = records.select("uid", *[F.col(c).alias(f"r_{c}") for c in ("size_x", "size_y", "unit")], *[m.alias(f"r_{c}") for c, m in (("stains", channel_map), ("channel_colors", colour_map)) if c in slides.columns for m in [m(F.col("names" if c == "stains" else "colors"))]])
    pick = lambda c: F.coalesce(f"r_{c}", c) if overwrite else F.coalesce(c, f"r_{c}")

    def merged(c: str) -> Column:
        own = F.map_filter(c, lambda k, v: v.isNotNull() & (v.cast("string") != ""))
        new = F.map_filter(f"r_{c}", lambda k, v: ~F.coalesce(F.map_contains_key(own, k), F.lit(False)))
        return F.coalesce(f"r_{c}", c) if overwrite else F.coalesce(F.map_concat(own, new), own, f"r_{c}")

    done = slides.join(r, "uid", "left").withColumns({c: pick(c) for c in ("size_x", "size_y", "unit")} | {c: merged(c) for c in ("stains", "channel_colors") if c in slides.columns})
    return done.select(*slides.columns)


def import_slides(files: DataFrame, docs: DataFrame, on: str = "19700101") -> DataFrame:
    """New records of files(path, source), as one transform: defaults, then size, unit and channels from
    the OME XML of docs(path, xml), where there is any. Columns: uid, path, filename, format, stem,
    size_x, size_y, unit, stains and channel_colors (maps by channel)."""
    named = with_defaults(files.select("path"), on=on).withColumnRenamed("stable_uid", "uid")
    told = ome_records(docs.withColumnRenamed("path", "uid"), "xml").withColumnRenamed("uid", "path")
    joined = named.join(told, "path", "left")
    return joined.select("uid", "path", "filename", "format", "stem", "size_x", "size_y", "unit", channel_map(F.col("names")).alias("stains"), colour_map(F.col("colors")).alias("channel_colors"))


def channel_map(names: Column) -> Column:
    """Names by channel; an empty one is ch<i>."""
    return F.map_from_entries(F.transform(names, lambda n, i: F.struct(i, F.when(n != "", n).otherwise(F.concat(F.lit("ch"), i)))))


def inherited_sizes(children: DataFrame, parents: DataFrame) -> DataFrame:
    """uid, size_x, size_y, unit of children (uid, parent_uid, size_x, size_y, unit): each of the three is taken from the
    parent's record where it is missing, and a missing size is the other one's, parents' sizes coming first."""
    p = parents.select(F.col("uid").alias("parent_uid"), F.col("size_x").alias("p_x"), F.col("size_y").alias("p_y"), F.col("unit").alias("p_unit"))
    at = children.join(p, "parent_uid", "left").withColumns({"x": F.coalesce("size_x", "p_x"), "y": F.coalesce("size_y", "p_y")})
    return at.select("uid", F.coalesce("x", "y").alias("size_x"), F.coalesce("y", "x").alias("size_y"), length_unit(F.coalesce("unit", "p_unit")).alias("unit"))


def colour_map(colors: Column) -> Column:
    """Packed colours by channel, without channels that have none; null where no channel has one."""
    entries = F.filter(F.transform(colors, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda e: e["c"].isNotNull())
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def magnification(objective: Column, scales: Column) -> Column:
    """The objective's magnification, else the rounded product of the scaling components, else 1."""
    product = F.rint(F.aggregate(scales, F.lit(1.0), lambda acc, x: acc * x))
    return F.coalesce(objective, F.when(F.size(scales) > 0, product), F.lit(1.0))


def true_rgb(channels: Column, pixel_type: Column, probe_channels: Column, probe_bytes: Column) -> Column:
    """One logical channel, and a colour pixel type or a probe of three 8-bit planes."""
    return (channels == 1) & (F.lower(pixel_type).rlike("^(bgr|rgb)") | ((probe_channels == 3) & (probe_bytes == 1)))


def ome_source(files: DataFrame) -> DataFrame:
    """path, source: a .czi with a .tiff of the same stem beside it has that as source, .tif and .tiff have themselves, others none."""
    tiffs = files.where("path like '%.tiff'").select(F.regexp_replace("path", r"\.tiff$", ".czi").alias("path"), F.col("path").alias("twin")).distinct()
    return files.join(tiffs, "path", "left").select("path", F.when(F.col("path").like("%.czi"), F.col("twin")).when(F.col("path").rlike(r"\.tiff?$"), F.col("path")).alias("source"))
