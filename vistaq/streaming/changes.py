"""A change feed: streams of records and deletions applied to the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import latest_by
from ..schemas import RECORD, VECTORS
from ..sources.shared import written
from ..sources.store import Change, Store


def apply(store: Store, changes: DataFrame) -> int:
    """Applies rows of VECTORS with ``op`` (upsert or delete) and ``at`` (order of changes); the last of each id counts.

    Only the buckets of these ids are rewritten.

    Applying a batch again changes nothing, so a batch that is replayed after a
    failure does no harm.
    """
    last = written(latest_by(changes, ["id"], [F.col("at"), F.col("op")]))
    put = last.where("op = 'upsert'")
    gone = last.where("op = 'delete'").select("id")
    records = put.where("metadata is not null").select("metadata.*", F.col("at").cast("double").alias("updated_at"))
    records = records.where("media_id is not null").select(*RECORD.names, "updated_at")
    return store.snapshot().commit(vectors=Change(put.select(*VECTORS.names), gone), media=Change(records, gone))


def follow(store: Store, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that applies every micro-batch of the stream."""

    def batch(changes: DataFrame, number: int) -> None:
        if changes.limit(1).count():
            apply(store, changes)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def progress(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type; events later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("span"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
