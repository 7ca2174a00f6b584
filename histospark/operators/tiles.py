"""Stencils on rows of packed tiles, of which only the edge strips are shuffled.

A ``TileSet`` is a table of tiles, bucketed by tile, so that joins on the tile find it where it lies:
for a stencil, each tile cuts the strips that its eight neighbours need, these are shuffled to the
neighbours' buckets and joined there, and a numpy kernel gets one tile with its halo at a time. The
result is written in place as the next table. A tile is dense (``side`` x ``side``): double precision
with NaN where no pixel is, or one bit a pixel for masks. Pixels that a table lacks are outside the image.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.operators import stencil
from histospark.operators.iterate import fresh_path, removed

AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
#: A tile of doubles is half a megabyte, one of a mask 8 KB; Arrow's batches are bounded by bytes.
SIDE = 256
#: Bytes of tiles that a Python worker gets at once, whatever the number of tiles.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


@dataclass
class TileSet:
    """Tiles (keys, ty, tx, data) of a table that lies in buckets by keys, ty, tx."""

    frame: DataFrame
    keys: list[str]
    side: int
    mask: bool
    name: str

    @property
    def at(self) -> list[str]:
        return [*self.keys, "ty", "tx"]

    def drop(self) -> None:
        """Deletes the table; nothing may read it any more."""
        spark = self.frame.sparkSession
        removed(spark, self.frame)
        spark.sql(f"drop table if exists {self.name}")


def encoded(block: np.ndarray, mask: bool) -> bytes:
    return np.packbits(~np.isnan(block)).tobytes() if mask else np.ascontiguousarray(block, "<f8").tobytes()


def decoded(data: bytes, shape: tuple[int, int], mask: bool) -> np.ndarray:
    if mask:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=shape[0] * shape[1])
        return np.where(bits.reshape(shape) == 1, 1.0, np.nan)
    return np.frombuffer(data, "<f8").reshape(shape)


def kinds_of(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most ``BATCH_BYTES`` at once. The session keeps this setting, as tiles are read after their functions return."""
    held = re.fullmatch(r"(\d+)\s*([bkmgtp]?)b?", spark.conf.get(BATCH_CONF).strip().lower())
    if not held or not 0 < int(held[1]) << 10 * "bkmgtp".index(held[2] or "b") <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def bucketed(tiles: DataFrame, keys: list[str], side: int, mask: bool) -> TileSet:
    """Writes tiles as a table in the shared folder, in as many buckets as there are shuffle partitions."""
    spark, name = tiles.sparkSession, f"tiles_{uuid.uuid4().hex}"
    small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles.write.bucketBy(buckets, *keys, "ty", "tx").option("path", fresh_path(spark, "tiles")).saveAsTable(name, format="parquet")
    return TileSet(spark.table(name), keys, side, mask, name)


def packed(pixels: DataFrame, keys: list[str], side: int = SIDE, value: str | None = "value") -> TileSet:
    """Tiles of pixels (keys, y, x, value), or of a mask (keys, y, x) where value is None. This is the one
    step that shuffles pixels, once each; rows that repeat a place count once (the greatest value)."""
    mask = value is None
    shown = F.lit(1.0) if mask else F.col(value).cast("double")
    dealt = pixels.select(*keys, F.floor(F.col("y") / side).alias("ty"), F.floor(F.col("x") / side).alias("tx"), F.pmod("y", F.lit(side)).cast("int").alias("y"), F.pmod("x", F.lit(side)).cast("int").alias("x"), shown.alias("value"))

    def pack(table: pa.Table) -> pa.Table:
        block = np.full((side, side), np.nan)
        np.fmax.at(block, (table["y"].to_numpy(), table["x"].to_numpy()), table["value"].to_numpy())
        return table.select([*keys, "ty", "tx"]).slice(0, 1).append_column("data", pa.array([encoded(block, mask)], pa.binary()))

    got = dealt.groupBy(*keys, "ty", "tx").applyInArrow(pack, f"{kinds_of(pixels, keys)}ty long, tx long, data binary")
    return bucketed(got, keys, side, mask)


def unpacked(tiles: TileSet) -> DataFrame:
    """The pixels (keys, y, x, and value unless it is a mask) of all tiles."""
    keys, side, mask = tiles.keys, tiles.side, tiles.mask

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = decoded(row["data"][0].as_py(), (side, side), mask)
                ys, xs = np.nonzero(~np.isnan(block))
                same = [row[k].take(pa.array(np.zeros(len(ys), np.int64))) for k in keys]
                out = [*same, pa.array(ys + row["ty"][0].as_py() * side), pa.array(xs + row["tx"][0].as_py() * side)]
                yield pa.RecordBatch.from_arrays(out + ([] if mask else [pa.array(block[ys, xs])]), [*keys, "y", "x"] + ([] if mask else ["value"]))

    return tiles.frame.select(*tiles.at, "data").mapInArrow(unpack, f"{kinds_of(tiles.frame, keys)}y long, x long{'' if mask else ', value double'}")


def strips_of(tiles: TileSet, radius: int) -> DataFrame:
    """keys, ty, tx, strips (array of place and data): what each tile's neighbours lend to its halo. Strips without a pixel aren't sent."""
    keys, side, mask = tiles.keys, tiles.side, tiles.mask
    # what a neighbour at (dy, dx) needs: its halo's part that lies in this tile
    part = {-1: slice(0, radius), 0: slice(0, side), 1: slice(side - radius, side)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, place, data, ty, tx = [], [], [], [], []
            for i in range(batch.num_rows):
                block = decoded(batch["data"][i].as_py(), (side, side), mask)
                y, x = batch["ty"][i].as_py(), batch["tx"][i].as_py()
                for k, (dy, dx) in enumerate(AROUND):
                    strip = block[part[dy], part[dx]]
                    if not np.isnan(strip).all():
                        at.append(i), place.append(k), data.append(encoded(strip, mask)), ty.append(y + dy), tx.append(x + dx)
            take = pa.array(np.array(at, np.int64))
            columns = [batch[k].take(take) for k in keys] + [pa.array(ty, pa.int64()), pa.array(tx, pa.int64()), pa.array(place, pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "ty", "tx", "place", "strip"])

    sent = tiles.frame.select(*tiles.at, "data").mapInArrow(cut, f"{kinds_of(tiles.frame, keys)}ty long, tx long, place int, strip binary")
    return sent.groupBy(*tiles.at).agg(F.collect_list(F.struct("place", "strip")).alias("strips"))


def haloed(tiles: TileSet, radius: int, beyond: bool) -> DataFrame:
    """Tiles with their strips; ``beyond`` adds the absent tiles that get strips."""
    return tiles.frame.select(*tiles.at, "data").join(strips_of(tiles, radius).hint("shuffle_hash"), tiles.at, "full" if beyond else "left")


def applied(tiles: TileSet, radius: int, kernel: Callable[[np.ndarray], np.ndarray], beyond: bool = False) -> TileSet:
    """kernel gets each tile with its halo (NaN where no pixel is) and returns the tile; tiles of NaN alone aren't kept."""
    keys, side, mask = tiles.keys, tiles.side, tiles.mask
    if radius > side:
        raise ValueError("the halo must not be wider than a tile")
    to = {-1: slice(0, radius), 0: slice(radius, radius + side), 1: slice(radius + side, side + 2 * radius)}
    long = {-1: radius, 0: side, 1: radius}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, data = [], []
            for i in range(batch.num_rows):
                block = np.full((side + 2 * radius, side + 2 * radius), np.nan)
                own = batch["data"][i].as_py()
                if own is not None:
                    block[to[0], to[0]] = decoded(own, (side, side), mask)
                for s in batch["strips"][i].as_py() or []:
                    dy, dx = AROUND[s["place"]]
                    block[to[-dy], to[-dx]] = decoded(s["strip"], (long[dy], long[dx]), mask)
                out = kernel(block)
                if not np.isnan(out).all():
                    kept.append(i), data.append(encoded(out, mask))
            take = pa.array(np.array(kept, np.int64))
            yield pa.RecordBatch.from_arrays([batch[c].take(take) for c in (*keys, "ty", "tx")] + [pa.array(data, pa.binary())], [*keys, "ty", "tx", "data"])

    made = haloed(tiles, radius, beyond).mapInArrow(run, f"{kinds_of(tiles.frame, keys)}ty long, tx long, data binary")
    return bucketed(made, keys, side, mask)


def blurred(tiles: TileSet, sigma: float) -> TileSet:
    """Weighted mean over the window of three deviations, cut at the image's edge."""
    return applied(tiles, *stencil.gaussian_kernel(sigma))


def medians(tiles: TileSet, size: int = 3) -> TileSet:
    return applied(tiles, *stencil.median_kernel(size))


def dilated(mask: TileSet, radius: int) -> TileSet:
    """All places within the radius of a true pixel, outside the image too."""
    return applied(mask, radius, stencil.dilating(radius), True)


def eroded(mask: TileSet, radius: int) -> TileSet:
    return applied(mask, radius, stencil.eroding(radius))


def closed(mask: TileSet, radius: int) -> TileSet:
    grown = dilated(mask, radius)
    out = eroded(grown, radius)
    grown.drop()
    return out


def thinned(mask: TileSet, per_round: int = 8) -> TileSet:
    """The Zhang-Suen skeleton, in rounds of ``per_round`` pairs of sub-iterations (fewer where a tile is no
    wider than their halo) until no pixel goes."""
    radius, step = stencil.thinning_kernel(max(1, min(per_round, mask.side // 2 - 1)))
    state, left = mask, None
    while True:
        new = applied(state, radius, step)
        if state is not mask:
            state.drop()
        state = new
        now = state.frame.select(set_bits().alias("n")).agg(F.sum("n")).first()[0] or 0
        if now == left:
            return state
        left = now


def set_bits() -> Column:
    """How many pixels of a mask tile are true."""

    @F.pandas_udf("long")
    def count(data: pd.Series) -> pd.Series:
        return data.map(lambda b: int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()))

    return count("data")


def runs_in(mask: TileSet) -> DataFrame:
    """The runs (keys, y, x0, x1) of a mask's tiles; those that go over a tile's edge come in parts."""
    keys, side = mask.keys, mask.side

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                on = np.zeros((side, side + 2), np.int8)
                on[:, 1:-1] = ~np.isnan(decoded(row["data"][0].as_py(), (side, side), True))
                step = np.diff(on, axis=1)
                (ys, x0), (_, x1) = np.nonzero(step == 1), np.nonzero(step == -1)
                y, x = row["ty"][0].as_py() * side, row["tx"][0].as_py() * side
                same = [row[k].take(pa.array(np.zeros(len(ys), np.int64))) for k in keys]
                yield pa.RecordBatch.from_arrays([*same, pa.array(ys + y), pa.array(x0 + x), pa.array(x1 - 1 + x)], [*keys, "y", "x0", "x1"])

    return mask.frame.select(*mask.at, "data").mapInArrow(cut, f"{kinds_of(mask.frame, keys)}y long, x0 long, x1 long")


def packed_runs(runs: DataFrame, keys: list[str], side: int = SIDE) -> TileSet:
    """Mask tiles of runs (keys, y, x0, x1); a run is shuffled once for each tile column that it touches."""
    at = runs.select(*keys, "y", "x0", "x1", F.floor(F.col("y") / side).alias("ty"), F.explode(F.sequence(F.floor(F.col("x0") / side), F.floor(F.col("x1") / side))).alias("tx"))
    left = F.col("tx") * side
    part = at.select(*keys, "ty", "tx", F.pmod("y", F.lit(side)).cast("int").alias("y"), F.greatest(F.lit(0), F.col("x0") - left).cast("int").alias("x0"), F.least(F.lit(side - 1), F.col("x1") - left).cast("int").alias("x1"))

    def pack(table: pa.Table) -> pa.Table:
        edge = np.zeros((side, side + 1), np.int32)
        y = table["y"].to_numpy()
        np.add.at(edge, (y, table["x0"].to_numpy()), 1)
        np.add.at(edge, (y, table["x1"].to_numpy() + 1), -1)
        on = np.cumsum(edge, axis=1)[:, :side] > 0
        return table.select([*keys, "ty", "tx"]).slice(0, 1).append_column("data", pa.array([np.packbits(on).tobytes()], pa.binary()))

    got = part.groupBy(*keys, "ty", "tx").applyInArrow(pack, f"{kinds_of(runs, keys)}ty long, tx long, data binary")
    return bucketed(got, keys, side, True)
