"""A prefix trie of conversations: double arrays in shards of neighbouring sequences, merged where shards meet.

Conversations become sequences of turn keys (hashes of role and text, 16 bytes each); equal sequences are
one row with a count. The sequences are sorted and cut into shards, so a shard holds a range of prefixes
and a hot prefix is spread over as many shards as it needs. In each shard the turns get dense ids, and
the trie is packed into two arrays: from node s, turn c leads to node BASE[s] + c if CHECK there is s.
Walking all sequences through them gives the nodes' counts, and walking the nodes backwards gives what
their subtrees sum to. Only nodes on the path to a shard's first sequence, or to its last one, can be
in other shards too; these are few, and are added up globally by a hash of their prefix.

Two neighbouring shards count the path that they share twice. Its parts that can't be added up (one
conversation is free at each node, a leaf may go on in the next shard, a child may be in both) are
taken off once for each such border, which every shard knows from the first sequence behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histospark.llm.common import removed, written

#: Turns of a shard on average, counted once for each distinct sequence.
SHARD_TURNS = 100_000
#: Ids that are hashed into one piece before a node's conversations meet.
PIECE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
#: Free places of the arrays tried for a node of several children before it goes behind all others.
TRIED = 64


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart; null role or text counts as empty."""
    role = F.coalesce(role, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, F.coalesce(text, F.lit(""))).cast("binary")))


def conversation_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turns: an array of (key, bytes of the text) by turn (nulls first, ties by key), a row for each conversation."""
    turn = F.struct(F.col("turn").alias("at"), turn_key(F.col("role"), F.col("text")).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    lists = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes"))).alias("turns"))


def with_shared_heads(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % family in place of its own first
    h ones, h being crc32(c) % most; an absent conversation has no turns."""
    head = conversations.select(F.col("conv_id").alias("family"), F.col("turns").alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    none = F.slice("turns", 1, 0)
    both = conversations.withColumn("family", F.col("conv_id") - F.col("conv_id") % family).join(head, "family", "left")
    own = F.slice("turns", h + 1, F.greatest(F.lit(0), F.size("turns") - h))
    return both.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), h), none), own).alias("turns"))


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """keys (16 bytes a turn), bytes, n, conv_id (the least), ends (SHA-256 of the ids, ascending, joined by commas): a row for each distinct sequence."""
    flat = conversations.select("conv_id", F.transform("turns", lambda t: t["key"]).alias("keys"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"))
    named = written(flat.withColumn("name", F.unhex(F.sha2(F.array_join(F.transform("keys", F.hex), "").cast("binary"), 256))), "sequences")
    pieces = named.groupBy("name", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, run = None, None
        for batch in batches:
            out = []
            for of, ids in zip(batch["name"], batch["ids"], strict=True):
                if of != name:
                    if run:
                        out.append((name, run.hexdigest()))
                    name, run = of, hashlib.sha256(ids.encode())
                else:
                    run.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["name", "ends"], dtype=object)
        if run:
            yield pd.DataFrame([(name, run.hexdigest())], columns=["name", "ends"], dtype=object)

    # a name's pieces stream through one task, which holds one piece
    ends = pieces.repartition("name").sortWithinPartitions("name", "piece").mapInPandas(digest, "name binary, ends string")
    once = named.groupBy("name").agg(F.first("keys").alias("keys"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    return once.join(ends, "name").drop("name")


class DoubleArray:
    """BASE and CHECK of a trie over dense ids; node 0 is the root, and free places have CHECK -1."""

    def __init__(self):
        self.base, self.check = np.zeros(16, np.int64), np.full(16, -1, np.int64)
        self.check[0], self.free, self.end = -2, 1, 1

    def room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.concatenate((self.base, np.zeros(more, np.int64))), np.concatenate((self.check, np.full(more, -1, np.int64)))

    def add(self, node: int, turns: np.ndarray) -> None:
        """Gives a node its children, for ascending ids of turns."""
        offsets, at = turns - turns[0], self.free
        for _ in range(TRIED):
            self.room(at + int(offsets[-1]) + 1)
            if (self.check[at + offsets] == -1).all():
                break
            at += 1
            while at < self.end and self.check[at] != -1:
                at += 1
        else:
            at = self.end
            self.room(at + int(offsets[-1]) + 1)
        self.base[node] = at - turns[0]
        self.check[at + offsets] = node
        self.end = max(self.end, at + int(offsets[-1]) + 1)
        while self.free < self.end and self.check[self.free] != -1:
            self.free += 1

    def step(self, nodes: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Where turns lead from nodes; -1 where they lead nowhere."""
        to = self.base[nodes] + turns
        inside = (to >= 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == nodes), to, -1)


def shard_nodes(keys: list[list[bytes]], sizes: list[list[int]], n: np.ndarray, conv: np.ndarray, ends: list[str], behind: list[bytes] | None, alone: bool) -> pd.DataFrame:
    """The nodes of one shard's sequences, which are distinct and sorted; ``behind`` is the first sequence of the
    next shard, ``alone`` tells that there are no other shards.

    A row for each node: its path hash if it can be in several shards (else null), its parent's path hash
    where the parent can (else the parent's conv_id), and what the contract asks of it, as far as the shard
    knows; for nodes shared with the next shard also rows of what is counted twice.
    """
    many, lengths = len(keys), np.array([len(k) for k in keys], np.int64)
    ids: dict[bytes, int] = {}
    deepest = int(lengths.max())
    for d in range(deepest):  # ids by depth, so that children of one node get neighbouring ones
        for s in np.nonzero(lengths > d)[0]:
            ids.setdefault(keys[s][d], len(ids))
    trie, at = DoubleArray(), np.zeros(many, np.int64)
    levels, parents, walks = [np.zeros(1, np.int64)], {}, []
    for d in range(deepest):
        on = np.nonzero(lengths > d)[0]
        turns = np.array([ids[keys[s][d]] for s in on], np.int64)
        order = np.lexsort((turns, at[on]))
        a, c = at[on][order], turns[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
        a, c = a[new], c[new]
        starts = np.nonzero(np.concatenate(([True], a[1:] != a[:-1])))[0]
        for lo, hi in zip(starts, np.append(starts[1:], len(a)), strict=True):
            trie.add(int(a[lo]), c[lo:hi])
        levels.append(trie.step(a, c))
        walks.append((on, turns))
        at[on] = trie.step(at[on], turns)
    size = len(trie.check)
    count, least, depth = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    text, final, children = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(size, np.int64)
    at[:] = 0
    count[0], least[0] = n.sum(), conv.min()
    for d, (on, turns) in enumerate(walks):
        at[on] = trie.step(at[on], turns)
        np.add.at(count, at[on], n[on])
        np.minimum.at(least, at[on], conv[on])
        text[at[on]] = [sizes[s][d] for s in on]
        depth[at[on]] = d + 1
    final[at] = np.arange(many)
    leaves, saved = np.zeros(size, np.int64), (count - 1) * text
    for nodes in levels[:0:-1]:
        np.add.at(children, trie.check[nodes], 1)
    for nodes in levels[::-1]:
        leaves[nodes] += children[nodes] == 0
        if nodes[0] != 0:
            np.add.at(leaves, trie.check[nodes], leaves[nodes])
            np.add.at(saved, trie.check[nodes], saved[nodes])
    path: dict[int, str] = {0: hashlib.sha256(b"").hexdigest()}  # of nodes that can be in several shards
    for s in ([0] if alone else [0, many - 1]):
        node = 0
        for key in keys[s]:
            to = int(trie.step(np.array([node]), np.array([ids[key]]))[0])
            path[to] = hashlib.sha256(bytes.fromhex(path[node]) + key).hexdigest()
            node = to
    if alone:
        path = {0: path[0]}
    every = np.concatenate(levels)
    parent = trie.check[every]
    up = [path.get(int(p)) for p in parent]
    out = pd.DataFrame({"path": [path.get(int(v)) for v in every], "up": up, "conv_id": least[every], "depth": depth[every], "up_conv": pd.Series([None if p < 0 else int(least[p]) for p in parent], dtype=object), "n_convs": count[every], "n_children": children[every], "n_leaves": leaves[every], "saved": saved[every], "ends": pd.Series([ends[s] if s >= 0 else None for s in final[every]], dtype=object)})
    if behind is None:
        return out
    shared = [0]
    for mine, other in zip(keys[-1], behind, strict=False):
        if mine != other:
            break
        shared.append(int(trie.step(np.array([shared[-1]]), np.array([ids[mine]]))[0]))
    twice = np.cumsum(text[shared][::-1])[::-1]
    leaf = int(children[shared[-1]] == 0)
    fix = pd.DataFrame({"path": [path[v] for v in shared], "up": None, "conv_id": least[shared], "depth": depth[shared], "up_conv": None, "n_convs": 0, "n_children": [-1] * (len(shared) - 1) + [0], "n_leaves": -leaf, "saved": twice, "ends": None}, dtype=object)
    return pd.concat([out.astype(object), fix])


NODE = "path string, up string, conv_id long, depth long, up_conv long, n_convs long, n_children long, n_leaves long, saved long, ends string"


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns), the textless root included: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are (key, bytes); conversations without turns end at the root; no conversations, no nodes. A
    conversation is a row of 16 bytes a turn, and a shard's sequences are held in one task.
    """
    spark = conversations.sparkSession
    sequences = written(distinct_sequences(conversations), "distinct")
    turns = sequences.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    if not turns:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    ranges = max(1, min(sequences.count(), max(-(-turns // shard_turns), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    dealt = written(sequences.repartitionByRange(ranges, "keys").withColumn("shard", F.spark_partition_id()), "dealt")
    removed(spark, sequences)
    firsts = dealt.groupBy("shard").agg(F.min("keys").alias("keys"))
    behind = firsts.select(F.lag("shard").over(Window.orderBy("shard")).alias("shard"), "keys").where("shard is not null")  # a row per shard
    alone = firsts.count() == 1
    none = F.lit(None)
    rows = dealt.unionByName(behind.select("shard", "keys", none.cast("array<bigint>").alias("bytes"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("conv_id"), none.cast("string").alias("ends")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [[bytes(k) for k in ks] for ks in pdf["keys"]]
        n = pdf["n"].to_numpy()
        own, next_ = sorted(np.nonzero(n > 0)[0].tolist(), key=keys.__getitem__), np.nonzero(n == 0)[0]
        part = pdf.iloc[own]
        return shard_nodes([keys[i] for i in own], [list(b) for b in part["bytes"]], part["n"].to_numpy(np.int64), part["conv_id"].to_numpy(np.int64), part["ends"].tolist(), keys[next_[0]] if len(next_) else None, alone)

    nodes = written(rows.groupBy("shard").applyInPandas(build, NODE), "nodes")
    merged = nodes.where("path is not null").groupBy("path").agg(F.first("up", True).alias("up"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("ends").alias("ends"))
    merged = written(merged, "merged")  # so that its size is known where the nodes are joined with it
    up = merged.select(F.col("path").alias("up"), F.col("conv_id").alias("merged_conv"))
    every = nodes.where("path is null").drop("path").unionByName(merged.drop("path").withColumn("up_conv", none.cast("long"))).join(up, "up", "left")
    return every.select("conv_id", "depth", F.coalesce("merged_conv", "up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
