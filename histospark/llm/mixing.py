"""Mixing sources to target weights by systematic sampling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histospark.llm.common import quoted, written

#: Weights of the sources in code-point order, repeating; a null source comes last.
WEIGHTS = (5, 2, 1)
#: No source and no document counts more often than this.
MOST_COPIES = 3
#: The one random offset of the sample, a dyadic fraction so that sums with it are exact.
OFFSET = 0.40625
#: Documents of one source and size class are dealt by a hash of their id and salt, in so many groups that each holds
#: about this many, and at most 2**SLOT_BITS groups: no window holds a whole hot source.
GROUP_ROWS, SLOT_BITS = 1000, 20


def slot(doc_id: Column, salt: Column) -> Column:
    """The first twenty bits of the MD5 digest of the id as text, a colon and the salt."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(salt, F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, SLOT_BITS // 4), 16, 10).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Targets of sources, from one row per source (source, source_size).

    The sources share the sum of all sizes by weight. None gets more than ``most`` times its size;
    what a source can't take goes to the others by weight, again and again until all fit. That is
    the level L with sum(min(most * size, weight * L)) = sum(size): the sources are filled up in
    the order of most * size / weight, and running sums give the first at which the rest fits.
    The windows run over one row per source, which is a small table unless sources are that many.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("at", F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", share.cast("double")).withColumn("limit", F.col("source_size").cast("double") * most)
    ranked = ranked.withColumn("at", F.col("limit") / F.col("weight"))
    whole = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    # from the first source on that isn't filled up, the level stays as it is there
    first = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "source_key", "level"))).over(whole)["level"]
    return ranked.withColumn("level", level).withColumn("source_key", F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("2"))).withColumn("first", first).select("source", "source_size", F.least(F.col("limit"), F.col("weight") * F.col("first")).alias("target"))


def systematic_mix(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, offset: float = OFFSET, group_rows: int = GROUP_ROWS, carry: bool = False, salt: Column | None = None) -> DataFrame:
    """How often the mix takes each document: doc_id, source, plus
    ``size, source_size, target, copies``; with ``carry``, the whole rows come along as a struct ``doc``.

    Each document of a source is expected target / source_size times. In a source, documents stand
    in the order of size class (bits of the size), group (a hash of the id and ``salt``, the text for
    instance, so that rows of one repeated or null id are spread; the number of groups is
    the power of two that brings them to ``group_rows`` rows or less on average), size and doc_id. The
    expected copies are prefix-summed in that order, the offset is added, and a document is taken
    once for each integer that its interval crosses. As like sizes stand together, a source's taken
    words come near its target. The prefix sum has two levels: ranks within (source, class, group)
    and the counts of these groups before it, so that no task holds a source.

    Null texts have size 0; a null source is a source of its own; null ids count as 0 in the order
    and repeated rows are documents of their own; sources without words have target 0 and no copies.
    """
    doc = [F.struct(*map(quoted, docs.columns)).alias("doc")] if carry else []
    rows = docs.select("doc_id", "source", size.alias("size"), slot(F.col("doc_id"), F.lit("") if salt is None else salt).alias("slot"), *doc)
    rows = rows if carry else written(rows, "sizes")  # texts are read once
    key = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("2"))  # a null source joins itself
    rows = rows.withColumn("k", key).withColumn("cls", F.length(F.bin("size")))
    slots = written(rows.groupBy("k", "cls", "slot").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "slots")
    classes = slots.groupBy("k", "cls").agg(F.sum("n").alias("n"))
    bits = F.greatest(F.lit(0), F.least(F.lit(SLOT_BITS), F.ceil(F.log2(F.col("n") / group_rows)))).cast("int")
    classes = classes.select("k", "cls", F.pow(F.lit(2), SLOT_BITS - bits).cast("int").alias("wide"))
    classes = written(classes, "classes")  # so that its size is known where the documents are joined with it
    part = F.floor(F.col("slot") / F.col("wide")).cast("int").alias("part")
    groups = slots.join(classes, ["k", "cls"]).groupBy("k", "cls", part).agg(F.sum("n").alias("n"))
    totals = source_targets(slots.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    ahead = Window.partitionBy("k").orderBy("cls", "part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n").join(totals.withColumn("k", key).drop("source"), "k")
    order = Window.partitionBy("k", "cls", "part").orderBy("size", "doc_id")
    dealt = rows.join(classes, ["k", "cls"]).withColumn("part", part).drop("slot", "wide")
    ranked = dealt.withColumn("rank", F.row_number().over(order)).join(groups, ["k", "cls", "part"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("ahead") + F.col("rank")
    copies = F.floor(place * rate + F.lit(offset)) - F.floor((place - 1) * rate + F.lit(offset))
    return ranked.select(*(["doc"] if carry else []), "doc_id", "source", "size", "source_size", "target", F.least(copies, F.lit(most)).cast("long").alias("copies"))


#: DuckDB SQL for the taken words of a table ``documents``; {docs} is the table.
MIX_SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
             cast(cast('0x' || md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, ''))[1:5] as integer) as bigint) as slot from {docs}),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
             3.0::double * source_size as lim from s),
l as (select *, lim / weight as fills, (cast(sum(source_size) over () as double)
              - coalesce(sum(lim) over (order by lim / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0.0))
              / sum(weight) over (order by lim / weight, source asc nulls last rows between current row and unbounded following) as level from w),
t as (select *, least(lim, weight * (select z.level from l z where z.level <= z.fills order by z.fills, z.source asc nulls last limit 1)) as target from l),
e as (select *, length(bin(size)) as cls, count(*) over (partition by source, length(bin(size))) as n from d),
r as (select e.*, t.source_size, t.target,
             row_number() over (partition by e.source order by cls, floor(slot / pow(2, 20 - greatest(0, least(20, ceil(log2(n / 1000)))))), e.size, e.doc_id) as place
      from e join t on e.source is not distinct from t.source),
c as (select *, case when source_size > 0 then target / source_size else 0.0::double end as rate from r)
select doc_id, source, size, source_size, target,
       least(cast(floor(place * rate + 0.40625) - floor((place - 1) * rate + 0.40625) as bigint), 3) as copies
from c
"""
