"""Micro-batch inserts of a stream of triples into a store (extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def insert_stream(store, stream: DataFrame, triples: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Commits each micro-batch as one delta.

    triples turns a batch into (s, p, o) term columns.  Facts are a set, so a batch
    that is repeated after a failure changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.add(triples(batch))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
