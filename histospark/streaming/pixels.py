"""Stateless operators on streams: pixel tables that arrive as files, transformed as they come.

Projections and stain operators with given constants need no state, so they run on a stream as on a
table. Fitted constants (a threshold, a stain basis) come from a batch query over earlier data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def transformed_stream(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_trigger: int = 64):
    """Reads Parquet files as they arrive, transforms them and appends Parquet; exactly once by the checkpoint.

    Returns the query, which ends when it has read what is there; start it again for what comes later.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
