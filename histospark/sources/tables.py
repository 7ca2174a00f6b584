"""Views over the driver tables that stand in for slides: pixels, statistics, patches, graphs, catalogs.

Each view exists twice: as a DataFrame, and as SQL text of the same name for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pixel: slides of 50 x 60 pixels with three 8-bit channels."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 3000").alias("uid"),
        F.expr("(o_orderkey % 3000) div 60").alias("y"),
        (key % 60).cast("long").alias("x"),
        F.least(F.lit(255), F.floor(F.col("o_totalprice") / 500000.0 * 256)).cast("long").alias("c0"),
        ((F.col("o_custkey") * 37) % 256).cast("long").alias("c1"),
        (F.expr("power(o_orderkey % 60 - 30, 2) + power((o_orderkey % 3000) div 60 - 25, 2)").cast("long") % 256).alias("c2"),
    )


RASTER = """raster as (
  select cast(o_orderkey // 3000 as bigint) as uid, cast((o_orderkey % 3000) // 60 as bigint) as y, cast(o_orderkey % 60 as bigint) as x,
         least(255, cast(floor(o_totalprice / 500000.0 * 256) as bigint)) as c0, cast((o_custkey * 37) % 256 as bigint) as c1,
         cast((power(o_orderkey % 60 - 30, 2) + power((o_orderkey % 3000) // 60 - 25, 2)) as bigint) % 256 as c2
  from orders)"""

#: A blob-like mask on the raster and a sparse set of targets.
MASK = "c2 >= 128 and c0 >= 40"
TARGET = "c0 >= 250"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster in long form: uid, y, x, channel, value."""
    return raster(spark, sf_dir).select("uid", "y", "x", F.posexplode(F.array("c0", "c1", "c2")).alias("channel", "value"))


PIXELS = """pixels as (
  select uid, y, x, 0 as channel, c0 as value from raster union all select uid, y, x, 1, c1 from raster union all select uid, y, x, 2, c2 from raster)"""


def stat_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pixel of a statistics run: the portality coordinate and three stains."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("portality"), F.col("l_quantity").alias("stain_0"), F.col("l_extendedprice").alias("stain_1"), F.col("l_tax").alias("stain_2"), F.col("l_returnflag").alias("uid"))


STAT_PIXELS = "stat_pixels as (select l_discount * 10 as portality, l_quantity as stain_0, l_extendedprice as stain_1, l_tax as stain_2, l_returnflag as uid from lineitem)"


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floating-point patches of 8 x 8 pixels: uid, label, y, x, value."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), "label", F.posexplode("embedding").alias("pos", "value")).select("uid", "label", F.expr("cast(pos div 8 as long)").alias("y"), (F.col("pos") % 8).cast("long").alias("x"), F.col("value").cast("double").alias("value"))


PATCHES = """patches as (
  select vec_id as uid, label, cast((pos - 1) // 8 as bigint) as y, cast((pos - 1) % 8 as bigint) as x, cast(embedding[pos] as double) as value
  from embeddings, (select unnest(range(1, 65)) as pos))"""


def pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel 0 of the raster at levels 0 to 2 by decimation: uid, level, y, x, value."""
    from histospark.sources.pyramid import decimated

    return decimated(raster(spark, sf_dir).select("uid", "y", "x", F.col("c0").alias("value")), [0, 1, 2])


PYRAMID = "pyramid as (select uid, l.level, y // (1 << l.level) as y, x // (1 << l.level) as x, c0 as value from raster, (select unnest([0, 1, 2]) as level) l where y % (1 << l.level) = 0 and x % (1 << l.level) = 0)"


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true pixels of the standard mask: uid, y, x."""
    return raster(spark, sf_dir).where(MASK).select("uid", "y", "x")


MASK_SQL = f"mask as (select uid, y, x from raster where {MASK})"


def sparse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-neighbour edges of the mask, nodes numbered uid * 3000 + y * 60 + x: u < v."""
    from histospark.operators.stencil import neighbours

    m = mask(spark, sf_dir)
    near = neighbours(m, [(0, 1), (1, 0)]).join(m, ["uid", "y", "x"], "left_semi")
    node = lambda y, x: F.col("uid") * 3000 + F.col(y) * 60 + F.col(x)
    return near.select(node("from_y", "from_x").alias("u"), node("y", "x").alias("v"))


SPARSE_GRAPH = """edges as (
  select a.uid * 3000 + a.y * 60 + a.x as u, b.uid * 3000 + b.y * 60 + b.x as v from mask a join mask b
  on a.uid = b.uid and ((b.y = a.y and b.x = a.x + 1) or (b.y = a.y + 1 and b.x = a.x)))"""


def dense_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected weighted edges u < v over 500 nodes."""
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("a"), (F.col("l_partkey") % 500).alias("b")).where("a <> b")
    return e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().withColumn("length", (F.col("u") * 7 + F.col("v") * 13) % 29 + 1)


DENSE_GRAPH = """dense as (
  select distinct least(l_orderkey % 500, l_partkey % 500) as u, greatest(l_orderkey % 500, l_partkey % 500) as v
  from lineitem where l_orderkey % 500 <> l_partkey % 500), weighted as (select u, v, (u * 7 + v * 13) % 29 + 1 as length from dense)"""


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of one line for each user: uid, line, seq, px, py."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), "event_id", F.expr("event_id % 97").cast("long").alias("px"), (F.col("value").cast("int") % 89).cast("long").alias("py"))
    return e.withColumn("seq", F.row_number().over(Window.partitionBy("line").orderBy("event_id")).cast("long")).drop("event_id")


POLYLINES = "lines as (select user_id as line, row_number() over (partition by user_id order by event_id) as seq, event_id % 97 as px, cast(trunc(value) as bigint) % 89 as py from events)"


def wires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of a wavy line along each row and each column of a slide, four units a pixel: uid, line, seq, px, py."""
    r = raster(spark, sf_dir)
    along = r.select("uid", F.col("y").alias("line"), F.col("x").alias("seq"), (F.col("x") * 4).alias("px"), (F.col("y") * 4 + F.col("c1") % 7 - 3).alias("py"))
    down = r.select("uid", (F.col("x") + 1000).alias("line"), F.col("y").alias("seq"), (F.col("x") * 4 + F.col("c0") % 7 - 3).alias("px"), (F.col("y") * 4).alias("py"))
    return along.union(down)


WIRES = "lines as (select uid, y as line, x as seq, x * 4 as px, y * 4 + c1 % 7 - 3 as py from raster union all select uid, x + 1000, y, x * 4 + c0 % 7 - 3, y * 4 from raster)"


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brightest pixels of each slide as points between pixels: uid, id, x, y."""
    r = raster(spark, sf_dir).where("c0 >= 235")
    return r.select("uid", (F.col("uid") * 3000 + F.col("y") * 60 + F.col("x")).alias("id"), (F.col("x") + F.col("c1") / 256).alias("x"), (F.col("y") + F.col("c2") / 256).alias("y"))


SPOTS = "points as (select uid, uid * 3000 + y * 60 + x as id, x + c1 / 256.0::double as x, y + c2 / 256.0::double as y from raster where c0 >= 235)"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slide records: uid, path, image_type, channel, size_um."""
    p = table(spark, sf_dir, "part").withColumn("s_suppkey", (F.col("p_partkey") % 100).cast("long"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long"), "s_acctbal")
    kind = F.when(F.col("p_type").isin("STANDARD", "ECONOMY"), "brightfield").when(F.col("p_type").isin("SMALL", "MEDIUM"), "fluorescence")
    dye = F.element_at(F.array(*map(F.lit, DYES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.join(s, "s_suppkey", "left").select(F.col("p_partkey").alias("uid"), F.concat(F.lit("/slides/"), F.col("p_brand"), F.lit("/"), F.regexp_replace("p_name", " ", "_"), F.lit("-"), F.col("p_partkey"), ext).alias("path"), kind.alias("image_type"), dye.alias("channel"), F.when(F.col("p_size") >= 10, F.col("s_acctbal") / 10000).alias("size_um"), (F.col("p_partkey") % 7).alias("version"))


#: Dye names and suffixes of the synthetic catalog.
DYES = ("DAPI", "FITC", "TRITC", "Cy5", "Hoechst 33342", "GFP", "unknown", "Texas Red")
EXTENSIONS = (".ome.tif", ".czi", ".tiff", ".qptiff", "")
MANIFEST = f"""manifest as (
  select p_partkey as uid, '/slides/' || p_brand || '/' || replace(p_name, ' ', '_') || '-' || p_partkey || {list(EXTENSIONS)}[p_partkey % 5 + 1] as path,
         case when p_type in ('STANDARD', 'ECONOMY') then 'brightfield' when p_type in ('SMALL', 'MEDIUM') then 'fluorescence' end as image_type,
         {list(DYES)}[p_partkey % 8 + 1] as channel, case when p_size >= 10 then s_acctbal / 10000 end as size_um, p_partkey % 7 as version
  from part left join supplier on s_suppkey = p_partkey % 100)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration attempts: attempt, slide and error columns of four families."""
    e = F.abs("s_acctbal") / 1000
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).alias("attempt"), F.col("s_suppkey").alias("slide"), e.alias("rigid_D"), (e * 2).alias("rigid_TRE"), F.when(F.col("s_suppkey") % 5 != 0, e * 0.5).alias("non_rigid_D"), F.when(F.col("s_suppkey") % 5 > 1, e * 0.75).alias("non_rigid_TRE"), (e * 3 + 1).alias("rigid_extra_D"))


ATTEMPTS = "attempts as (select s_suppkey % 5 as attempt, s_suppkey as slide, abs(s_acctbal) / 1000 as rigid_D, abs(s_acctbal) / 1000 * 2 as rigid_TRE, case when s_suppkey % 5 <> 0 then abs(s_acctbal) / 1000 * 0.5 end as non_rigid_D, case when s_suppkey % 5 > 1 then abs(s_acctbal) / 1000 * 0.75 end as non_rigid_TRE, abs(s_acctbal) / 1000 * 3 + 1 as rigid_extra_D from supplier)"


def sql(select: str, *views: str) -> str:
    """A DuckDB query over the named views."""
    return f"with recursive {', '.join(views)} {select}" if views else select
