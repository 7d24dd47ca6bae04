"""Incremental index updates: a stream of point batches applied by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.point_table import apply_points


def stream_upserts(updates: DataFrame, path: str, checkpoint: str, key: str = "row_id", version: str | None = "version", source: str = "stream", buckets: int = 64) -> StreamingQuery:
    """Apply each micro-batch of ``updates`` to the point table at ``path``, which may exist already.

    A batch rewrites the buckets that it touches. Batches are applied under their ids,
    so one that is run again after a failure changes nothing if it was applied.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_points(batch, path, key, version, source, batch_id, buckets)

    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
