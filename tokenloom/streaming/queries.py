"""Arriving queries against a fixed index: each micro-batch is scored like a batch of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..index import Index, Reranker


def search_stream(queries: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], k: int = 10, checkpoint: str | None = None, **options):
    """Start a streaming query over ``queries`` (query_idx, q_pos, qemb); ``sink`` gets each batch's ranked rows and its number.

    A batch must hold whole queries. The index is a static table: its scan is planned anew for each
    batch, and a batch that is tried again gives the same rows.
    """
    reranker = Reranker(index)

    def one(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            sink(reranker.search(held, k=k, **options), number)
        finally:
            held.unpersist()

    writer = queries.writeStream.foreachBatch(one)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()
