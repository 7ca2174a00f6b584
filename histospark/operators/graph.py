"""Planar-graph operators over edge tables (u, v, length) and polylines (line, seq, px, py)."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histospark.operators.gridjoin import box_join
from histospark.operators.iterate import connected_components, fresh_path, removed, written


def both_ends(edges: DataFrame, *more: str) -> DataFrame:
    """node, other and further columns, once from each end; a self-loop counts twice."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("other"), *more).union(edges.select("v", "u", *more))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, junction: three ends or more meet there."""
    return both_ends(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree")).withColumn("junction", F.col("degree") >= 3)


def junctions_of(edges: DataFrame, arms_: DataFrame) -> DataFrame:
    """node, degree, arms, junction: three ends or more meet there, or three directions or more; arms_ (node, arms) may lack nodes."""
    both = degrees(edges).drop("junction").join(arms_, "node", "left").withColumn("arms", F.coalesce("arms", F.lit(0)))
    return both.withColumn("junction", (F.col("degree") >= 3) | (F.col("arms") >= 3))


def pruned(edges: DataFrame) -> DataFrame:
    """Takes away edges with an end of degree 1, again and again; loops stay.

    Edges and degrees are written once. A round looks up the edges of the nodes that just came to degree 1 and writes
    these alone; all that went is taken from the edges at the end."""
    spark = edges.sparkSession
    base = written(edges.select("u", "v"))
    degree = written(degrees(base).select("node", "degree"))
    tips = written(degree.where("degree = 1").select("node"))
    folder, rounds = fresh_path(spark, "gone"), 0
    gone = lambda: spark.read.schema(base.schema).parquet(*[f"{folder}/{k}" for k in range(rounds)])
    while tips.limit(1).count():
        at = lambda c: base.join(tips.withColumnRenamed("node", c), c, "left_semi").select("u", "v")  # noqa: E731, B023
        cut = at("u").union(at("v")).distinct()
        (cut.join(gone(), ["u", "v"], "left_anti") if rounds else cut).write.parquet(f"{folder}/{rounds}")
        last = spark.read.schema(base.schema).parquet(f"{folder}/{rounds}")
        rounds += 1
        lost = both_ends(gone()).join(both_ends(last).select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("lost"))
        new = written(lost.join(degree, "node").where("degree - lost = 1").select("node"))
        removed(spark, tips)
        tips = new
    out = base if not rounds else written(base.join(gone(), ["u", "v"], "left_anti").select("u", "v"))
    removed(spark, degree, tips, *([base, gone()] if rounds else []))
    return out


def segments(lines: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, line, seq, ax, ay, bx, by: consecutive distinct vertices of each line."""
    order = Window.partitionBy(*keys, "line").orderBy("seq")
    out = lines.select(*keys, "line", "seq", F.col("px").alias("ax"), F.col("py").alias("ay"), F.lead("px").over(order).alias("bx"), F.lead("py").over(order).alias("by"))
    return out.where("bx is not null and (ax <> bx or ay <> by)")


def cross(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> Column:
    return F.expr(f"({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax})")


def intersections(segs: DataFrame, cell: float = 16.0, keys: list[str] = ()) -> DataFrame:
    """Pairs keys, (line, seq), (line2, seq2) of segments of different lines that properly cross, and the place x, y."""
    box = lambda p: (F.least(f"{p}ax", f"{p}bx"), F.least(f"{p}ay", f"{p}by"), F.greatest(f"{p}ax", f"{p}bx"), F.greatest(f"{p}ay", f"{p}by"))
    other = segs.select(*keys, *[F.col(c).alias(n) for c, n in (("line", "line2"), ("seq", "seq2"), ("ax", "qax"), ("ay", "qay"), ("bx", "qbx"), ("by", "qby"))])
    d1, d2 = cross("ax", "ay", "bx", "by", "qax", "qay"), cross("ax", "ay", "bx", "by", "qbx", "qby")
    d3, d4 = cross("qax", "qay", "qbx", "qby", "ax", "ay"), cross("qax", "qay", "qbx", "qby", "bx", "by")
    met = box_join(segs, other, box(""), box("q"), [*keys], cell).where((F.col("line") < F.col("line2")) & (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0))
    t = d3 / (d3 - d4)
    return met.select(*keys, "line", "seq", "line2", "seq2", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))


def rounded_share(share: Column, digits: int) -> Column:
    """F.round of a share of 0 to 1. Only what lies next to a tie is spelled out in decimals for it."""
    up = share * float(10**digits)
    tie = F.abs(up - F.floor(up) - 0.5) <= max(1e-6, 1e-14 * 10**digits)
    return F.when(tie, F.round(share, digits)).otherwise(F.floor(up + 0.5) / float(10**digits))


def t_junctions(lines: DataFrame, segs: DataFrame, reach: float, cell: float = 8.0, least_angle: float = 20.0, digits: int | None = None) -> DataFrame:
    """Ends of lines that fall on the inside (2 to 98 %) of another line's segment within ``reach``, at an angle.

    Ends at one place are one row, which lies in one cell of a grid and meets the segments near that cell; a cell's segments are
    dealt to eight parts, which all get the cell's places. So distances and t, rounded to ``digits``, are found once for a place, and
    only directions for each of its ends. Lines in one plane give as many pairs as lie near each other."""
    order = Window.partitionBy("line").orderBy("seq")
    last = Window.partitionBy("line").orderBy(F.desc("seq"))
    with_next = lines.withColumns({"nx": F.lead("px").over(order), "ny": F.lead("py").over(order), "qx": F.lead("px").over(last), "qy": F.lead("py").over(last), "i": F.row_number().over(order), "j": F.row_number().over(last)})
    ends = with_next.where("i = 1 or j = 1").select(F.col("line").alias("end_line"), F.col("seq").alias("end_seq"), F.col("px").alias("ex"), F.col("py").alias("ey"), F.when(F.col("i") == 1, F.col("nx") - F.col("px")).otherwise(F.col("qx") - F.col("px")).alias("dx"), F.when(F.col("i") == 1, F.col("ny") - F.col("py")).otherwise(F.col("qy") - F.col("py")).alias("dy"))
    length2 = F.expr("(bx - ax) * (bx - ax) + (by - ay) * (by - ay)").cast("double")
    t = F.expr("(ex - ax) * (bx - ax) + (ey - ay) * (by - ay)") / length2
    gx, gy = F.col("ex") - F.col("ax") - t * (F.col("bx") - F.col("ax")), F.col("ey") - F.col("ay") - t * (F.col("by") - F.col("ay"))
    side = F.expr("(ex - ax) * (by - ay) - (ey - ay) * (bx - ax)")
    near = (side * side <= length2 * (reach * reach * (1 + 1e-6))) & t.between(0.02, 0.98) & (gx * gx + gy * gy <= reach * reach)  # the first, without a division, leaves few to the others
    dot, norms = F.abs(F.expr("e.dx * (bx - ax) + e.dy * (by - ay)")), F.col("_length") * F.col("e.norm")
    turn = F.degrees(F.acos(F.least(F.lit(1.0), dot / norms)))
    edge_of = cos(radians(least_angle))  # the angle itself is only looked at beside the limit
    turned_ = F.when(dot < norms * (edge_of - 1e-9), True).when(dot > norms * (edge_of + 1e-9), False).otherwise(turn >= least_angle)
    # a segment goes to the cells that what lies within reach of it touches, once for each; what is exploded looks small to the optimizer, so the join is told to merge
    parts, n = 8, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["_cx", "_cy", "_part"]
    columns = segs.withColumn("_cx", F.explode(F.sequence(F.floor((F.least("ax", "bx") - reach) / cell), F.floor((F.greatest("ax", "bx") + reach) / cell))))
    edge = lambda x: F.when(F.col("bx") == F.col("ax"), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("ax")) / (F.col("bx") - F.col("ax")))))
    at = lambda share, other: F.col("ay") + F.coalesce(share, F.lit(other)) * (F.col("by") - F.col("ay"))
    y0, y1 = at(edge(F.col("_cx") * cell - reach), 0.0), at(edge((F.col("_cx") + 1) * cell + reach), 1.0)
    rows = columns.withColumn("_cy", F.explode(F.sequence(F.floor((F.least(y0, y1) - reach - 1e-6) / cell), F.floor((F.greatest(y0, y1) + reach + 1e-6) / cell))))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("line", "seq"), F.lit(parts)).cast("int")).repartition(n, *key)
    tip = F.struct("end_line", "end_seq", "dx", "dy", F.sqrt(F.expr("dx * dx + dy * dy").cast("double")).alias("norm"))
    some = F.expr("(row_number() over (partition by ex, ey order by end_line, end_seq) - 1) div 1024")  # no row holds more ends
    places = ends.where("dx <> 0 or dy <> 0").withColumn("some", some).groupBy("ex", "ey", "some").agg(F.collect_list(tip).alias("tips"))
    tips = places.withColumns({"_cx": F.floor(F.col("ex") / cell), "_cy": F.floor(F.col("ey") / cell), "_part": F.explode(F.array(*map(F.lit, range(parts))))}).repartition(n, *key)
    met = rows.join(tips.hint("merge"), key).where(near)
    met = met.select("line", "seq", "ax", "ay", "bx", "by", F.sqrt(length2).alias("_length"), (t if digits is None else rounded_share(t, digits)).alias("t"), F.explode("tips").alias("e"))
    return met.where((F.col("line") != F.col("e.end_line")) & turned_).select("e.end_line", "e.end_seq", "line", "seq", "t")


def clustered_points(points: DataFrame, reach: float, keys: list[str] = ()) -> DataFrame:
    """keys, cluster (least id), n, x, y: points (keys, id, x, y) linked within ``reach``, transitively; the centre is the mean."""
    links = points_within(points, points.select(*keys, F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2")), reach, keys).where("id < id2")
    found = connected_components(links.select(F.col("id").alias("a"), F.col("id2").alias("b")))
    named = points.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("cluster", F.coalesce("component", "id"))
    return named.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def points_within(points: DataFrame, others: DataFrame, reach: float, keys: list[str] = ()) -> DataFrame:
    """keys, id, id2, x, y, x2, y2, d2: points (keys, id, x, y) and others (keys, id2, x2, y2) within ``reach`` of each other."""
    around = tuple(F.col(c) + d for c, d in (("x", -reach), ("y", -reach), ("x", reach), ("y", reach)))
    met = box_join(points, others, around, (F.col("x2"), F.col("y2"), F.col("x2"), F.col("y2")), [*keys], reach)
    return met.withColumn("d2", F.expr("(x - x2) * (x - x2) + (y - y2) * (y - y2)")).where(F.col("d2") <= reach * reach)


def nearest_center(points: DataFrame, centers: DataFrame, reach: float, keys: list[str] = ()) -> DataFrame:
    """id, center, d2: the nearest center (keys, center, x2, y2) within ``reach`` of each point, null where there is none; ties go to the least."""
    near = points_within(points, centers.withColumnRenamed("center", "id2"), reach, keys)
    best = near.groupBy("id").agg(F.min(F.struct("d2", F.col("id2").alias("center"))).alias("b"))
    return points.select("id").join(best, "id", "left").select("id", F.col("b.center").alias("center"), F.col("b.d2").alias("d2"))


def chains(edges: DataFrame) -> DataFrame:
    """u, v, length, pieces: maximal runs through nodes of degree 2 become one edge; rings keep one node,
    their least. Rows are edges each, so parallel edges between junctions stay apart."""
    deg = degrees(edges)
    ided = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "length").withColumn("eid", F.monotonically_increasing_id()))
    inside = deg.where("degree = 2").select("node")
    at = both_ends(ided, "eid").join(inside, "node", "left_semi")
    pairs = at.groupBy("node").agg(F.min("eid").alias("a"), F.max("eid").alias("b")).where("a <> b")
    found = connected_components(pairs)
    named = ided.join(found, ided.eid == found.node, "left").withColumn("chain", F.coalesce("component", "eid"))
    totals = named.groupBy("chain").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("pieces"), F.min(F.least("u", "v")).alias("low"))
    ends = both_ends(named, "chain").join(inside, "node", "left_anti").groupBy("chain").agg(F.min("node").alias("u"), F.max("node").alias("v"))
    return totals.join(ends, "chain", "left").select(F.coalesce("u", "low").alias("u"), F.coalesce("v", "low").alias("v"), "length", "pieces")


def shortest_paths(edges: DataFrame, sources: DataFrame, width: float | None = None) -> DataFrame:
    """source, node, dist, pred from each source (column ``source``) to all it reaches, by buckets of distances; ties go to the least pred.

    Only rows of the open bucket, of ``width`` (eight mean lengths, if not given), meet the edges; a bucket that is done is
    written once to a folder of its own and never again. A node that gets a new distance was settled
    no further back than the longest edge, so candidates are held against those buckets alone. Lengths
    aren't negative; the sources have no pred. More width means fewer rounds and more rows that are improved twice.
    """
    spark = edges.sparkSession
    near = written(both_ends(edges, "length"), "near")
    mean, longest = near.agg(F.avg("length"), F.max("length")).first()
    width = width or 8 * (mean or 0) or 1
    kind = edges.schema["length"].dataType
    least = F.min(F.struct("dist", "pred")).alias("m")
    unpack = ["source", "node", "m.dist", "m.pred"]
    waiting = written(sources.select("source", F.col("source").alias("node"), F.lit(0).cast(kind).alias("dist"), F.lit(None).cast("long").alias("pred")).distinct(), "waiting")
    schema, folder, limits = waiting.schema, fresh_path(spark, "settled"), []

    def settled(since: float | None) -> DataFrame:
        """The buckets with distances of ``since`` or more."""
        parts = [f"{folder}/{k}" for k, limit in enumerate(limits) if since is None or limit > since]
        return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)

    while (low := waiting.agg(F.min("dist")).first()[0]) is not None:
        limit, known = low + width, settled(low - longest if longest is not None else low).select("source", "node")
        reached = lambda rows: rows.join(near, "node").select("source", F.col("other").alias("node"), (F.col("dist") + F.col("length")).cast(kind).alias("dist"), F.col("node").alias("pred"))
        bucket = written(waiting.where(F.col("dist") < limit).withColumn("fresh", F.lit(True)), "bucket")
        while bucket.where("fresh").limit(1).count():
            told = reached(bucket.where("fresh")).where(F.col("dist") < limit).join(known, ["source", "node"], "left_anti")
            best = bucket.drop("fresh").unionByName(told).groupBy("source", "node").agg(least).select(*unpack)
            was = bucket.select("source", "node", F.col("dist").alias("was"))
            new = written(best.join(was, ["source", "node"], "left").select(*best.columns, (F.col("was").isNull() | (F.col("dist") < F.col("was"))).alias("fresh")), "bucket")
            removed(spark, bucket)
            bucket = new
        bucket.drop("fresh").write.parquet(f"{folder}/{len(limits)}")
        limits.append(limit)
        told = reached(bucket).where(F.col("dist") >= limit)
        late = waiting.where(F.col("dist") >= limit).unionByName(told).join(settled(low - longest if longest is not None else low).select("source", "node"), ["source", "node"], "left_anti")
        new = written(late.groupBy("source", "node").agg(least).select(*unpack), "waiting")
        removed(spark, bucket, waiting)
        waiting = new
    removed(spark, near, waiting)
    return settled(None)


def path_edges(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target, u, v: the edges of each source's path to the targets (source, target), walked back over preds."""
    at = targets.select("source", "target", F.col("target").alias("node"))
    got = None
    step = paths.select("source", "node", "pred")
    while True:
        hop = written(at.join(step, ["source", "node"]).where("pred is not null").select("source", "target", "node", "pred"))
        if not hop.limit(1).count():
            break
        own = hop.select("source", "target", F.least("node", "pred").alias("u"), F.greatest("node", "pred").alias("v"))
        got = own if got is None else got.union(own)
        at = hop.select("source", "target", F.col("pred").alias("node"))
    return got if got is not None else targets.select("source", "target", F.col("source").alias("u"), F.col("target").alias("v")).where("false")


def spanning_tree(edges: DataFrame) -> DataFrame:
    """u, v, length of the minimum spanning forest: Boruvka rounds; ties go to the least edge.

    Each round, every component picks its least edge, and components that picks join become one; edges inside one go, and
    of those between two the least stays. So components halve at least and the table shrinks with them.
    """
    spark = edges.sparkSession
    plain = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "length").where("u <> v")
    order = F.struct("length", "u", "v")
    rest = written(plain.groupBy(F.col("u").alias("a"), F.col("v").alias("b")).agg(F.min(order).alias("e")), "between")
    chosen, picks = None, []
    while rest.limit(1).count():
        ends = rest.select(F.col("a").alias("c"), "a", "b", "e").union(rest.select("b", "a", "b", "e"))
        best = written(ends.groupBy("c").agg(F.min_by(F.struct("a", "b", "e"), "e").alias("m")).select("m.*").distinct(), "picks")
        picks.append(best)
        comp = connected_components(best.select("a", "b"))
        into = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"into_{c}"))
        named = rest.join(into("a"), "a").join(into("b"), "b").where("into_a <> into_b")
        new = written(named.groupBy(F.least("into_a", "into_b").alias("a"), F.greatest("into_a", "into_b").alias("b")).agg(F.min("e").alias("e")), "between")
        removed(spark, rest, comp)
        rest = new
    for best in picks:  # as many as rounds
        chosen = best if chosen is None else chosen.unionByName(best)
    return (rest if chosen is None else chosen).select("e.u", "e.v", "e.length")


def terminal_tree(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """u, v of the edges that connect the terminals (column ``source``): the spanning tree over their shortest distances, spelled out."""
    paths = written(shortest_paths(edges, terminals))
    between = paths.join(terminals.select(F.col("source").alias("node")), "node", "left_semi").where("source < node").select(F.col("source").alias("u"), F.col("node").alias("v"), F.col("dist").alias("length"))
    tree = spanning_tree(between)
    return path_edges(paths, tree.select(F.col("u").alias("source"), F.col("v").alias("target"))).select("u", "v").distinct()


def angle_at(lines: DataFrame, most: int = 4) -> DataFrame:
    """line, angle: the direction in degrees of a chord of up to ``most`` vertices from each line's start."""
    order = Window.partitionBy("line").orderBy("seq")
    head = lines.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most)
    ends = head.groupBy("line").agg(F.min_by(F.struct("px", "py"), "i").alias("a"), F.max_by(F.struct("px", "py"), "i").alias("b"))
    return ends.select("line", F.degrees(F.atan2((F.col("b.py") - F.col("a.py")).cast("double"), (F.col("b.px") - F.col("a.px")).cast("double"))).alias("angle"))


def arms(angles: DataFrame, key: str, tolerance: float = 15.0) -> DataFrame:
    """key, arms: greedy count of directions, in ascending order from 0 to 360: one that lies more than
    the tolerance around the circle from the last counted one counts."""
    sorted_ = angles.groupBy(key).agg(F.array_sort(F.collect_list(F.pmod("angle", F.lit(360.0)))).alias("a"))
    apart = lambda x, y: F.least(F.abs(x - y), 360.0 - F.abs(x - y))
    start = F.struct(F.lit(1).alias("n"), F.element_at("a", 1).alias("last"))
    fold = F.aggregate("a", start, lambda acc, x: F.when(apart(x, acc["last"]) > tolerance, F.struct((acc["n"] + 1).alias("n"), x.alias("last"))).otherwise(acc), lambda acc: acc["n"])
    return sorted_.select(key, fold.alias("arms"))


def loops_with_few_junctions(loop_edges: DataFrame, junctions: DataFrame, most: int = 1) -> DataFrame:
    """loop, junctions: loops (loop, u, v) that touch at most ``most`` junction nodes."""
    nodes = loop_edges.select("loop", F.explode(F.array("u", "v")).alias("node")).distinct()
    counted = nodes.join(junctions.select("node", F.lit(1).alias("is_junction")), "node", "left").groupBy("loop").agg(F.coalesce(F.sum("is_junction"), F.lit(0)).alias("junctions"))
    return counted.where(F.col("junctions") <= most)


def weak_connectors(edges: DataFrame) -> DataFrame:
    """u, v of dead edges (column ``dead``) with active neighbours at one end at most."""
    active = both_ends(edges.where("not dead")).select("node").distinct().withColumn("alive", F.lit(1))
    at = lambda c: active.select(F.col("node").alias(c), F.col("alive").alias(f"at_{c}"))
    joined = edges.where("dead").join(at("u"), "u", "left").join(at("v"), "v", "left")
    return joined.where("coalesce(at_u, 0) + coalesce(at_v, 0) <= 1").select("u", "v")


def parallel_edges(edges: DataFrame) -> DataFrame:
    """Edges (eid, u, v, length) of the same node pair as a shorter one (or an equal one of lesser id)."""
    order = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v")).orderBy("length", "eid")
    return edges.withColumn("rank", F.row_number().over(order)).where("rank > 1").drop("rank")


def turned(a: Column, b: Column) -> Column:
    """The difference of two directions in degrees, at most 180."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def without_parallel(edges: DataFrame, lines: DataFrame, overlap: float = 0.5, most_turn: float = 25.0) -> DataFrame:
    """eid of the edges (eid, u, v) that stay: of edges of one node pair, in the order of their pixels,
    one goes if it runs along those that stay.

    lines holds each edge's vertices (line = eid, seq, px, py), from u to v. An edge runs along others
    where at least ``overlap`` of its pixels are among their pixels or beside one (eight
    neighbours), and its directions at both ends are within ``most_turn`` degrees of one of them.
    Edges are settled in rounds, one for each place in the order of a pair, as it depends on those
    before; all pairs go through a round together, by joins.
    """
    drawn = written(packed(segments(lines), ["line"]).withColumnRenamed("line", "eid"))
    head, tail = angle_at(lines), angle_at(lines.withColumn("seq", -F.col("seq")))
    turns = head.select(F.col("line").alias("eid"), F.col("angle").alias("start")).join(tail.select(F.col("line").alias("eid"), F.col("angle").alias("end")), "eid")
    flipped = F.col("u") > F.col("v")  # directions from the lesser node and from the greater one
    sized = edges.select("eid", "u", "v").join(drawn.groupBy("eid").agg(F.sum(F.bit_count("bits")).cast("long").alias("size")), "eid", "left").join(turns, "eid", "left")
    both = sized.select("eid", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.coalesce("size", F.lit(0)).alias("size"), F.when(flipped, F.col("end")).otherwise(F.col("start")).alias("at_a"), F.when(flipped, F.col("start")).otherwise(F.col("end")).alias("at_b"))
    ranked = written(both.withColumn("place", F.row_number().over(Window.partitionBy("a", "b").orderBy("size", "eid"))))
    last = ranked.agg(F.max("place")).first()[0] or 0
    kept = written(ranked.where("place = 1").drop("place"))
    for place in range(2, last + 1):
        now = ranked.where(F.col("place") == place)
        rival = kept.select("a", "b", F.col("eid").alias("other"), F.col("at_a").alias("o_a"), F.col("at_b").alias("o_b"))
        met = now.join(rival, ["a", "b"])
        like = met.where((turned(F.col("at_a"), F.col("o_a")) <= most_turn) & (turned(F.col("at_b"), F.col("o_b")) <= most_turn)).select("eid").distinct()
        wide = met.join(like, "eid", "left_semi").select("eid", "other").join(drawn.withColumnRenamed("eid", "other"), "other").select("eid", "y", "w", "bits")
        near = widened(wide, ["eid"]).withColumnRenamed("bits", "near")
        share = drawn.join(near, ["eid", "y", "w"]).groupBy("eid").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("near")))).alias("n")).where("n > 0")
        gone = now.join(share, "eid").where(F.col("n") >= overlap * F.col("size")).select("eid")
        more = now.join(gone, "eid", "left_anti").drop("place")
        kept = written(kept.union(more.select(*kept.columns)))
    return kept.select("eid")


def exploded_pixels(segs: DataFrame) -> DataFrame:
    """The segments (ax, ay, bx, by) once for each of their pixels, px and py, by equal steps along the longer axis, rounded half up."""
    at = segs.withColumn("_steps", steps_of()).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_steps"))))
    along = lambda a, b: F.floor(F.col(a) + F.col("_i") * (F.col(b) - F.col(a)) / F.greatest(F.col("_steps"), F.lit(1)) + 0.5)
    return at.withColumns({"px": along("ax", "bx"), "py": along("ay", "by")}).drop("_steps", "_i")


def steps_of() -> Column:
    return F.greatest(F.abs(F.expr("bx - ax")), F.abs(F.expr("`by` - ay"))).cast("int")


def packed(segs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, w, bits: the pixels of segments (ax, ay, bx, by) as words, bit x - 64 * w of the word w of a row.

    Lines are dealt to their tasks as segments, in as many parts as shuffles have, however few bytes those are: what is shuffled
    doesn't grow with the pixels, and a task holds words instead of pixels."""
    if "line" in keys:
        segs = segs.repartition(int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("px"), F.lit(64)).cast("int"))
    return exploded_pixels(segs).groupBy(*keys, F.col("py").alias("y"), F.floor(F.col("px") / 64).alias("w")).agg(F.bit_or(bit).alias("bits"))


#: The places of the bits that are set in each byte.
BITS_OF = [[i for i in range(8) if byte >> i & 1] for byte in range(256)]


def unpacked(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x of words (keys, y, w, bits): the reverse of ``packed``."""
    byte = lambda i: F.shiftrightunsigned("bits", 8 * i).bitwiseAND(F.lit(255)).cast("int")
    bytes_ = words.select(*keys, "y", "w", F.explode(F.array(*[F.struct(F.lit(8 * i).alias("at"), byte(i).alias("byte")) for i in range(8)])).alias("b")).where("b.byte <> 0")
    table = F.array(*[F.array(*map(F.lit, places)).cast("array<int>") for places in BITS_OF])
    return bytes_.select(*keys, "y", "w", "b.at", F.explode(F.get(table, F.col("b.byte"))).alias("i")).select(*keys, "y", (F.col("w") * 64 + F.col("at") + F.col("i")).alias("x"))


def widened(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, w, bits: words (keys, y, w, bits) and all pixels beside theirs (eight neighbours)."""
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(n))
    up, down = F.call_function("shiftleft", F.col("bits"), F.lit(1)), F.shiftrightunsigned("bits", 1)
    across = F.array(F.struct(F.col("w").alias("w"), F.col("bits").bitwiseOR(up).bitwiseOR(down).alias("bits")), F.struct((F.col("w") + 1).alias("w"), F.when(F.col("bits") < 0, one(0)).otherwise(F.lit(0).cast("long")).alias("bits")), F.struct((F.col("w") - 1).alias("w"), F.when(F.col("bits").bitwiseAND(F.lit(1).cast("long")) != 0, one(63)).otherwise(F.lit(0).cast("long")).alias("bits")))
    rows = words.select(*keys, "y", F.explode(across).alias("a")).where("a.bits <> 0")
    rows = rows.select(*keys, F.explode(F.array(*[F.col("y") + dy for dy in (-1, 0, 1)])).alias("y"), "a.w", "a.bits")
    return rows.groupBy(*keys, "y", "w").agg(F.bit_or("bits").alias("bits"))


def sizes(segs: DataFrame) -> DataFrame:
    """line, size: how many pixels a line's segments have. A line of one segment isn't drawn for it."""
    counted = segs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("line")))
    one = counted.where("_n = 1").select("line", (steps_of() + 1).cast("long").alias("size"))
    more = packed(counted.where("_n > 1").drop("_n"), ["line"]).groupBy("line").agg(F.sum(F.bit_count("bits")).cast("long").alias("size"))
    return one.union(more)


def rasterised(segs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x: pixels of segments (ax, ay, bx, by) by equal steps along the longer axis, rounded half up, each once."""
    return unpacked(packed(segs, keys), keys)


def filled_polygons(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x: the pixels of closed polygons (line, seq, px, py; whole numbers), edges included, each once.

    Each edge meets the image rows from its upper end to before its lower one; a polygon's meetings
    in a row, sorted, are the ends of its runs (even-odd).
    """
    order = Window.partitionBy(*keys, "line").orderBy("seq")
    back = vertices.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i").withColumn("seq", F.lit(1 << 62).cast("long"))
    sides = segments(vertices.select(*keys, "line", F.col("seq").cast("long").alias("seq"), "px", "py").union(back.select(*keys, "line", "seq", "px", "py")), keys)
    rows = sides.where("ay <> `by`").withColumn("y", F.explode(F.sequence(F.least("ay", "by"), F.greatest("ay", "by") - 1)))
    at = rows.select(*keys, "line", "y", (F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))).alias("at"))
    met = at.groupBy(*keys, "line", "y").agg(F.array_sort(F.collect_list("at")).alias("xs"))
    ends = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(F.ceil(F.get("xs", i)).alias("lo"), F.floor(F.get("xs", i + 1)).alias("hi")))
    runs = met.select(*keys, "y", F.explode(ends).alias("r")).where("r.lo <= r.hi")
    inside = runs.select(*keys, F.col("y").cast("long").alias("y"), F.explode(F.sequence("r.lo", "r.hi")).alias("x"))
    points = vertices.select(*keys, F.col("py").cast("long").alias("y"), F.col("px").cast("long").alias("x"))
    return inside.union(rasterised(sides, keys)).union(points).distinct()


def skeleton_parts(mask: DataFrame, key: str = "uid") -> tuple[DataFrame, DataFrame]:
    """Nodes (key, y, x, degree) of a skeleton, its pixels without exactly two 8-neighbours, and edges
    (key, y, x, label), the 8-connected runs of the others; closed rings are edges without a node."""
    from histospark.operators.components import labelled
    from histospark.operators.stencil import RING, neighbours

    near = neighbours(mask.select(key, "y", "x"), RING).groupBy(key, "y", "x").agg(F.count(F.lit(1)).alias("degree"))
    degree = written(mask.select(key, "y", "x").join(near, [key, "y", "x"], "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    return degree.where("degree <> 2"), labelled(degree.where("degree = 2").select(key, "y", "x"), key, eight=True)


def face_classes(faces: DataFrame, central: DataFrame, least: int, key: str = "uid") -> DataFrame:
    """key, label, area, marked: a face (labelled pixels) is marked where it is small or holds no pixel of ``central``."""
    inside = faces.join(central.select(key, "y", "x", F.lit(1).alias("c")).hint("merge"), [key, "y", "x"], "left")
    out = inside.groupBy(key, "label").agg(F.count(F.lit(1)).alias("area"), F.coalesce(F.max("c"), F.lit(0)).alias("c"))
    return out.select(key, "label", "area", ((F.col("area") < least) | (F.col("c") == 0)).alias("marked"))


def edge_faces(edge_pixels: DataFrame, face_pixels: DataFrame, least: float = 0.6, key: str = "uid") -> DataFrame:
    """key, edge, face, share: faces that at least ``least`` of an edge's pixels (key, y, x, edge) touch, themselves or by an 8-neighbour of face_pixels (key, y, x, face)."""
    from histospark.operators.stencil import RING, neighbours

    near = neighbours(edge_pixels, [(0, 0), *RING]).join(face_pixels, [key, "y", "x"])
    touching = near.select(key, "edge", "face", "from_y", "from_x").distinct().groupBy(key, "edge", "face").agg(F.count(F.lit(1)).alias("n"))
    length = edge_pixels.groupBy(key, "edge").agg(F.count(F.lit(1)).alias("length"))
    return touching.join(length, [key, "edge"]).withColumn("share", F.col("n") / F.col("length")).where(F.col("share") >= least).select(key, "edge", "face", "share")


def loop_groups(loop_edges: DataFrame, junctions: DataFrame | None = None) -> DataFrame:
    """loop, group: loops (loop, u, v) that share nodes, transitively; the group is its least loop. With junctions (node), only those link."""
    nodes = loop_edges.select("loop", F.explode(F.array("u", "v")).alias("node")).distinct()
    links = nodes if junctions is None else nodes.join(junctions, "node", "left_semi")
    least = links.groupBy("node").agg(F.min("loop").alias("b"))
    links = links.join(least, "node").where("loop <> b").select(F.col("loop").alias("a"), "b").distinct()
    found = connected_components(links)
    return nodes.select("loop").distinct().join(found.withColumnRenamed("node", "loop"), "loop", "left").select("loop", F.coalesce("component", "loop").alias("group"))


def weakly_attached_groups(loop_edges: DataFrame, edges: DataFrame, most: int = 1) -> DataFrame:
    """group, exits: loop groups that edges outside them touch at ``most`` nodes or fewer."""
    groups = written(loop_groups(loop_edges))
    own = loop_edges.join(groups, "loop").select("group", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    nodes = own.select("group", F.explode(F.array("u", "v")).alias("node")).distinct()
    outside = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(own, ["u", "v"], "left_anti")
    met = both_ends(outside).select("node").distinct().withColumn("out", F.lit(1))
    exits = nodes.join(met, "node", "left").groupBy("group").agg(F.coalesce(F.sum("out"), F.lit(0)).alias("exits"))
    return exits.where(F.col("exits") <= most)


def group_exits(own: DataFrame, loop_nodes: DataFrame, edges: DataFrame, junctions: DataFrame) -> DataFrame:
    """group, node, kind: from which junctions of a group of loops a way leads out, and the category of its first edge.

    own (group, eid) holds the groups' edges and loop_nodes (node, group) the nodes of every loop, group
    being -1 for loops in no group. A way starts with an edge that isn't the group's and goes on over marked and dead edges
    that aren't either, not through its start; it is out at a node on a loop of none or another group, or with an
    untreated edge. All ways go on together, a step a round, and those that are out, or meet only
    seen nodes, end; so only what lies between groups is walked.
    """
    spark = edges.sparkSession
    own = written(own.select("group", "eid").distinct())
    near = written(both_ends(edges, "eid", "category"))
    free = near.where("category = 'untreated'").select(F.col("node").alias("at")).distinct().withColumn("free", F.lit(True))
    on = loop_nodes.groupBy(F.col("node").alias("at")).agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
    known = written(free.join(on, "at", "full").withColumn("free", F.coalesce("free", F.lit(False))))
    nodes = own.join(edges.select("eid", F.explode(F.array("u", "v")).alias("node")), "eid").select("group", "node").distinct().join(junctions.select("node").distinct(), "node", "left_semi")
    ways = nodes.join(near, "node").join(own, ["group", "eid"], "left_anti")
    front = written(ways.select("group", "node", F.col("category").alias("kind"), F.col("other").alias("at")).distinct())
    seen, exits = front, None
    name = ["group", "node", "kind"]
    while front.limit(1).count():
        judged = front.join(known, "at", "left").withColumn("out", F.coalesce(F.col("free") | (F.col("lo") != F.col("group")) | (F.col("hi") != F.col("group")), F.lit(False)))
        found = judged.where("out").select(*name).distinct()
        new_exits = written(found if exits is None else exits.union(found).distinct())
        step = judged.where("not out").join(new_exits, name, "left_anti").select(*name, "at")
        to = step.join(near.where("category in ('marked', 'dead')").select(F.col("node").alias("at"), "eid", "other"), "at").join(own, ["group", "eid"], "left_anti")
        new = written(to.where("other <> node").select(*name, F.col("other").alias("at")).distinct().join(seen, [*name, "at"], "left_anti"))
        grown = written(seen.union(new))
        removed(spark, seen, *([] if exits is None else [exits]))
        front, seen, exits = new, grown, new_exits
    removed(spark, near, known)
    if exits is None:
        return front.select(*name)
    removed(spark, seen)
    return exits


def detached_groups(own: DataFrame, loop_nodes: DataFrame, edges: DataFrame, junctions: DataFrame) -> DataFrame:
    """group, attachments: groups that go, since one way at most leads out of them (each junction counts once for a
    category of first edges), or none but ways that start with a dead edge."""
    exits = group_exits(own, loop_nodes, edges, junctions)
    counted = exits.groupBy("group").agg(F.count(F.lit(1)).alias("attachments"), F.bool_and(F.col("kind") == "dead").alias("dead"))
    every = own.select("group").distinct().join(counted, "group", "left")
    return every.where("attachments is null or attachments <= 1 or dead").select("group", F.coalesce("attachments", F.lit(0)).alias("attachments"))
