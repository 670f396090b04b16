"""Structured Streaming into a catalog table: every micro-batch is an insert, with the table's views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tesserae.sources.catalog import Catalog


def ingest(stream: DataFrame, catalog: Catalog, table: str, checkpoint: str, name: str | None = None, once: bool = False, optimize_every: int = 0) -> StreamingQuery:
    """Starts a query that feeds `table`.

    A batch and what its views make are one commit that records the batch number, so a batch that is replayed
    after a failure is not inserted twice. `optimize_every` merges parts after so many batches.
    """
    query = name or f"ingest_{table}"

    def each(batch: DataFrame, number: int) -> None:
        catalog.insert(table, batch, (query, number))
        if optimize_every and number % optimize_every == optimize_every - 1:
            catalog.optimize(table)

    writer = stream.writeStream.queryName(query).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()
