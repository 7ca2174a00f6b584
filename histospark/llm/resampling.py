"""Importance resampling towards a target distribution: array-scored weights, then parallel sorting by
regular sampling.

The features of a text are its words and pairs of consecutive words, hashed to buckets. Counts of the
buckets over all source texts and all target texts give each bucket a gain, an array of 10,000 numbers,
and a text's weight is the mean gain of its features. Gumbel noise, a hash of the id, is added, and the
highest scores are drawn. Their exact ranks come from a sort in parallel: each task writes its rows as a
sorted run, rows at regular places of the runs give splitters, the rows of a segment between two splitters
meet in one task, and the counts of the segments before it turn places in a segment into ranks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histospark.llm.common import removed, written

BUCKETS = 10_000
#: Letters of ASCII in lower case, digits, and all that isn't ASCII.
TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
TO_LOWER = bytes.maketrans(UPPER, LOWER)
#: Documents of fewer words aren't drawn; percentage of the others that is.
LEAST_WORDS, PERCENT = 20, 25
#: Rows of a segment on average, and regular samples taken from the runs for each segment.
SEGMENT_ROWS, OVERSAMPLED = 250_000, 16
#: Words whose features are hashed at once, so that a long text needs no more memory than a short one.
BLOCK = 50_000


def blocks(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """How many words, and the buckets of their words and pairs, block by block of a whole text."""
    before: list[bytes] = []
    found = TOKEN.finditer((text or "").encode("utf-8", "surrogatepass").translate(TO_LOWER))
    while words := [m.group() for _, m in zip(range(BLOCK), found, strict=False)]:
        run = before + words
        pairs = map(b" ".join, zip(run, run[1:], strict=False))
        n = len(words) + len(run) - 1
        yield len(words), np.fromiter(map(crc32, chain(words, pairs)), np.int64, n) % BUCKETS
        before = words[-1:]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts of the column ``text``. Each task counts on its own; the
    driver gets one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, buckets in blocks(text.as_py()):
                    total += np.bincount(buckets, minlength=BUCKETS)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the log of its smoothed share of the target over that of the source."""
    s_all, t_all = int(source.sum()), int(target.sum())
    return np.array([floor(1000 * log(float((t + 1) * (s_all + BUCKETS)) / float((s + 1) * (t_all + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains over a text's features, 0 without any."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = features = total = 0
                for n, buckets in blocks(text.as_py()):
                    words, features, total = words + n, features + len(buckets), total + int(own[buckets].sum())
                rows.append((words, features, total // max(features, 1)))
            columns = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns.T)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def order() -> list[Column]:
    """The order of ranks; where all else is equal, the place in the runs decides, so no two rows are equal."""
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("run").asc(), F.col("place").asc()]


def sorted_runs(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, fit) written as one sorted run per task, with run and place
    in it; rows that aren't fit come last."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            places = pa.array(np.arange(at, at + batch.num_rows))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, places], [*batch.schema.names, "place"])

    run = rows.withColumn("run", F.spark_partition_id()).sortWithinPartitions(F.col("fit").desc(), *order()[:3])
    return written(run.mapInArrow(place, "doc_id long, n_features long, weight long, score long, fit boolean, run int, place long"), "runs")


def key(row) -> tuple:
    return (-row["score"], row["doc_id"] is None, row["doc_id"] or 0, row["n_features"], row["run"], row["place"])


def splitters(runs: DataFrame, segments: int) -> list[tuple]:
    """Keys that part the rows in so many segments of about equal size.

    Each run gives rows at regular places, at least one and about ``OVERSAMPLED`` for each segment in
    all, each standing for as many rows as lie between two of them; so the driver gets a row per task
    and ``OVERSAMPLED`` per segment, however many rows there are.
    """
    fit = runs.where("fit")
    sizes = fit.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    share = F.greatest(F.lit(1), F.ceil(F.col("n") * (OVERSAMPLED * segments) / F.sum("n").over(Window.partitionBy())))
    steps = sizes.select("run", F.ceil(F.col("n") / share).cast("long").alias("step"))  # the window holds a row per task
    some = fit.join(steps, "run").where(F.col("place") % F.col("step") == F.floor(F.col("step") / 2)).select("score", "doc_id", "n_features", "run", "place", "step").collect()
    some.sort(key=key)
    total, passed, out = sum(r["step"] for r in some), 0, []
    for row in some:
        if passed * segments >= total * (len(out) + 1):
            out.append(key(row))
        passed += row["step"]
    return out


def segment_of(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Adds segment: how many of the cuts aren't behind the row; -1 where it isn't fit. The cuts are a row per
    segment, so they are sent to all tasks."""
    held = rows.sparkSession.sparkContext.broadcast(cuts)
    names = rows.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        scores = np.array([c[0] for c in own], np.int64)
        for batch in batches:
            score = -batch.column(names.index("score")).to_numpy()
            low, high = np.searchsorted(scores, score, "left"), np.searchsorted(scores, score, "right")
            for i in np.nonzero(low < high)[0].tolist():  # only rows of a splitter's score need the whole key
                row = {c: batch.column(names.index(c))[i].as_py() for c in ("score", "doc_id", "n_features", "run", "place")}
                own_key = key(row)
                low[i] += sum(c <= own_key for c in own[low[i] : high[i]])
            low[~batch.column(names.index("fit")).to_numpy(zero_copy_only=False)] = -1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low.astype(np.int32))], [*names, "segment"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(deal, f"{kinds}, segment int")


def ranked(runs: DataFrame, drawn: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Adds rank to the rows that are fit: 1, 2, ... by ``ORDER`` for the first ``drawn``, null for the others.

    Only segments that hold drawn rows are exchanged and sorted.
    """
    many = runs.where("fit").count()
    segments = max(1, -(-many // segment_rows), min(many, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = written(segment_of(runs, splitters(runs, segments)), "segments")
    removed(runs.sparkSession, runs)
    counts = dealt.where("segment >= 0").groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    ahead = written(counts.select("segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "ahead")  # one row a segment
    within = F.row_number().over(Window.partitionBy("segment").orderBy(*order()))
    first = dealt.join(ahead.where(F.col("ahead") < drawn), "segment").withColumn("place", F.col("ahead") + within)
    out = ["doc_id", "n_features", "weight", "score"]
    first = first.select(*out, F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank"))
    rest = dealt.join(ahead.where(F.col("ahead") < drawn), "segment", "left_anti")
    return first.unionByName(rest.select(*out, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, seed: int = 7, least_words: int = LEAST_WORDS, percent: int = PERCENT, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn.

    Of the documents of at least ``least_words`` words, ``percent`` of a hundred (rounded down) are drawn,
    by score, ties by id. Null and empty texts have no features and weight 0; a null id takes part with
    the noise of an empty one and comes after all ids; rows that repeat an id are documents each, those
    of fewer features first. Without targets all gains follow from smoothing alone. Empty tables give no rows.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    runs = sorted_runs(rows.select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("fit")))
    many = runs.where("fit").count()
    return ranked(runs, percent * many // 100, segment_rows)
