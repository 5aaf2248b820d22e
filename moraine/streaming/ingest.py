"""Incremental ingest: a stream of entries becomes generations of a lake.

Each micro-batch is one generation and carries the batch's number, so a replay of a
batch that had committed does nothing, and one that had not starts over; units the
lake has already are found by hash and not stored again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.lake import Lake


def ingest(entries: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that adds all there is of `entries` (path, content, ...) to the lake at `root`, and ends."""

    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            Lake(batch.sparkSession, root).add(batch, batch=number)

    return entries.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files(spark: SparkSession, folder: str, per_batch: int = 10_000) -> DataFrame:
    """Parquet files of (path, content) that appear in a folder, as a stream."""
    return spark.readStream.schema("path string, content binary").option("maxFilesPerTrigger", per_batch).parquet(folder)
