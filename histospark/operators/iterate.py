"""What iterative operators need: a cut lineage in the shared folder, and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, an own
    one if all run on one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "step") -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what ``written`` stored, once nothing reads it any more."""
    jvm = spark._jvm
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of links(a, b) of longs.

    Each round, a node and the component it is in take the least component among its neighbours,
    and components then point to their own component, so long chains shrink in a logarithmic number
    of rounds. All steps are joins and minima that combine before the shuffle. Links of a node with
    itself, repeated links and an empty table are fine.
    """
    spark = links.sparkSession
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    state = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "components")
    while True:
        seen = edges.join(state, edges.b == state.node).groupBy("a").agg(F.min("component").alias("least"))
        hooks = seen.join(state, seen.a == state.node).select("node", "component", "least")
        told = hooks.select("node", "least").union(hooks.select("component", "least")).union(state.select("node", "component")).groupBy("node").agg(F.min("least").alias("parent"))
        up = told.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        old = state.select("node", F.col("component").alias("was"))
        new = written(told.join(up, "parent").join(old, "node").select("node", F.least("parent", "root").alias("component"), "was"), "components")
        moved = new.where("component <> was").limit(1).count()
        removed(spark, state)
        state = new
        if not moved:
            break
    removed(spark, edges)
    return state.select("node", "component")


#: How many links a task holds at once in ``keyed_components``.
HELD = 1 << 19


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links a, b and, for each, the least node that it is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, u, v)
        np.minimum.at(root, v, u)
        while (root != (up := root[root])).any():
            root = up
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    return nodes, nodes[root]


def keyed_components(links: DataFrame, keys: list[str]) -> DataFrame:
    """node, component (its smallest node) like ``connected_components``, for links (keys, a, b) that never leave their keys.

    A task gets the links of some keys and settles them by ``HELD`` at a time. Only where a node is met by several such
    lots, as of keys with more links, the lots' components are links of a second search, which is distributed."""
    if not keys:
        return connected_components(links)
    spark, n = links.sparkSession, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def settle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        found = lambda: pd.DataFrame(dict(zip(("node", "root"), least_reached(*pd.concat(held)[["a", "b"]].to_numpy().T), strict=True)))
        for pdf in parts:
            held, size = [*held, pdf], size + len(pdf)
            if size >= HELD:
                yield found()
                held, size = [], 0
        if size:
            yield found()

    lots = links.select(*keys, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").repartition(n, *keys).sortWithinPartitions(*keys)
    met = written(lots.select("a", "b").mapInPandas(settle, "node long, root long"), "lots")
    several = met.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    if not several.where("least <> most").limit(1).count():
        return met.select("node", F.col("root").alias("component")).distinct()
    more = met.join(several.where("least <> most"), "node").where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b"))
    found = connected_components(more)
    out = written(met.join(found.withColumnsRenamed({"node": "root"}), "root", "left").select("node", F.coalesce("component", "root").alias("component")).distinct(), "components")
    removed(spark, met, found)
    return out
