"""Structured Streaming: micro-batches as store commits, and a live latest-value view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.store import Store


def ingest(stream: DataFrame, store: Store, query_id: str, checkpoint: str, **trigger):
    """Append a stream (op, k, v, ord) to a store; a batch that was committed before a restart is not written twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # The marker is in the same manifest as the batch's files: a batch that failed leaves none and is written when it comes again.
        store.write_batch(batch, (query_id, batch_id))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_view(stream: DataFrame) -> DataFrame:
    """The newest version of each key so far, for complete or update mode; tombstones stay, so that deletions show."""
    return stream.groupBy("k").agg(F.max_by(F.struct("seq", "tomb", "v"), "seq").alias("x")).select("k", "x.*")
