"""Feeding an index from a stream: each micro-batch becomes a segment, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexispark.sources.store import IndexStore


def feed(stream: DataFrame, store: IndexStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that appends the stream's rows to the index.

    A batch that is run again after a failure first drops keys the index already holds, so a
    document is counted once. `trigger` goes to writeStream.trigger, e.g. availableNow=True.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        key = store.manifest().spec.key
        known = store.tables().docs.select(F.col("doc_key").alias(key))
        store.append(batch.join(known, key, "left_anti").select(*batch.columns))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
