"""Continuous ingestion of events, and its throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.measures import throughput
from tidemark.store import EventStore

# How long changes may wait for a flush, and after how many commits to compact.
FLUSH_INTERVAL = "30 seconds"
COMPACT_EVERY = 4


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(
    events: DataFrame, store: EventStore, checkpoint: str, name: str, assign_ids: bool = False, available_now: bool = True
) -> StreamingQuery:
    """Append a stream of events to a store, each micro-batch as one commit.

    A batch is tagged with the stream's name and the batch number, so one that
    is repeated after a failure is not committed twice. Late and out-of-order
    events are always taken: their place follows from their start, their
    visibility from the commit. Every few commits pending parts are compacted.
    """

    def append(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.create(batch, tag=f"{name}/{number}", assign_ids=assign_ids)
            if store.statistics()["pending_count"] >= COMPACT_EVERY:
                store.compact()

    writer = events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=FLUSH_INTERVAL)).start()


def stream_throughput(events: DataFrame, at: str, late: str = "10 seconds", seconds: int = 2) -> DataFrame:
    """Events a second in each tick of event time; a tick is final once the watermark has passed it."""
    stamped = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return throughput(stamped, F.col("__at"), seconds)
