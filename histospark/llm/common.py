"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.operators.iterate import fresh_path, removed, shared_dir, written

__all__ = ["WORD", "fresh_path", "held_out", "n_words", "quoted", "removed", "shared_dir", "small_batches", "table", "written"]

#: A word: a maximal run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of rows kept out of every fit: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quoted(name: str) -> str:
    """A column's name as F.col and the like take it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Python workers get at most so many texts at once, so that their memory stays bounded. The session
    keeps this setting, as queries run after their functions return."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
