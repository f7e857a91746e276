"""Streams of documents into a segmented index, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.segments import SegmentedIndex


def ingest(stream: DataFrame, path: str, checkpoint: str, upsert: bool = True, **trigger) -> StreamingQuery:
    """Start a query that puts each batch of ``stream(id, title, body)`` into the index at ``path``.

    Upserts compare contents, so a batch that comes twice after a failure changes
    nothing; plain additions would double it.
    """

    def put(batch: DataFrame, number: int) -> None:
        index = SegmentedIndex.create(batch.sparkSession, path)
        if upsert:
            index.upsert(batch)
        elif batch.head(1):
            index.add(batch)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
