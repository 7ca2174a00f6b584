"""CSV sinks of statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_statistics(raw: DataFrame, summary: DataFrame, folder: str) -> None:
    """Writes lobule_stats_raw and summarized_stats as folders of CSV files with headers; both tables are written where they lie."""
    raw.write.mode("overwrite").csv(f"{folder}/lobule_stats_raw", header=True)
    summary.write.mode("overwrite").csv(f"{folder}/summarized_stats", header=True)


def read_statistics(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.csv(f"{folder}/{name}", header=True, schema=schema)
