"""Run batches as a stream: each micro-batch is one atomic run, late rows belong to a later run.

A run counts when its batch is whole, so no watermark is needed for snapshots: the
sink writes a batch under its own id and a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.history import first_per_key
from tidemark.sources.tables import replace_partitions


def write_snapshots(observations: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> StreamingQuery:
    """Appends the first row of each key in every micro-batch, as partition run_seq=<batch id> of a table."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(first_per_key(batch, list(keys), list(order)).withColumn("run_seq", F.lit(batch_id)), path, "run_seq")

    return observations.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, by: str, size: str, late: str) -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, at: str, by: str, gap: str, late: str) -> DataFrame:
    """Counts by session: a session ends after a gap without events."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))
