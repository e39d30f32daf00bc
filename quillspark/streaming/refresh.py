"""The same refresh as a stream of changed documents: each micro-batch is one upsert of a table, or one new state of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import Engine
from ..operators import refresh


def refresh_stream(changes: DataFrame, path: str, checkpoint: str, key: str = "doc_id", buckets: int = 64) -> StreamingQuery:
    """Apply a stream of rows (key, ..., deleted boolean) to the table at path; of one batch the last written row of a key counts by ts."""

    def apply(batch: DataFrame, _: int) -> None:
        last = refresh.latest(batch, key, F.col("ts"))
        refresh.upsert(last.where("not deleted").drop("deleted"), last.where("deleted").select(key), path, key, buckets)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(changes: DataFrame, engine: Engine, checkpoint: str) -> StreamingQuery:
    """Follow a stream of rows (columns of documents, ts, deleted) with an index: chunks, postings, vectors and statistics.

    Each batch is published whole or not at all, under its number, so a batch that is run again changes nothing; across
    batches the last write of a document by ts counts.
    """
    return changes.writeStream.foreachBatch(lambda batch, number: engine.apply(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
