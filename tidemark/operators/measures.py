"""Statistics of a log and of a load."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import RANGES_EACH
from tidemark.session import scratch_path, width_for
from tidemark.sources.slots import SLOT, read_slots, write_slots


def postings(events: DataFrame) -> DataFrame:
    """The inverted view: key, value, id, with a null key for tags; each tag and annotation of an event once.

    Null tags are none; an annotation with a null value is kept, as the key is there.
    """
    tags = events.select(F.lit(None).cast("string").alias("key"), F.explode(F.array_distinct("tags")).alias("value"), "id")
    notes = events.select(F.explode("annotations").alias("key", "value"), "id")
    return tags.where(F.col("value").isNotNull()).unionByName(notes)


def tag_cardinalities(events: DataFrame) -> DataFrame:
    """Events for each tag: tag, n_events. A tag repeated in one event counts once; null tags are none."""
    tags = events.select(F.explode(F.array_distinct("tags")).alias("tag")).where(F.col("tag").isNotNull())
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n_events"))


def annotation_cardinalities(events: DataFrame) -> DataFrame:
    """Events for each annotation: key, value, n_events."""
    pairs = events.select(F.explode("annotations").alias("key", "value"))
    return pairs.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n_events"))


def nearest_ranks(df: DataFrame, value: str, percents: Mapping[str, int], beside: Sequence[Column] = ()) -> DataFrame:
    """One row, after aggregates ``beside`` over each value ``v`` and its count ``n``, with a column for each name: the element at index ``n * percent / 100`` of the sorted non-null values.

    The index is a whole number, counted from 0 and not beyond the last; without
    values all are null. Values are counted, range-sorted into slots and found,
    where they lie, by prefix sums of the ranges' counts, so no task sees more
    than its ranges and one repeated value is one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    buckets, path = width_for(counts), scratch_path(df.sparkSession, "ranks")
    ranges = counts.repartitionByRange(RANGES_EACH * buckets, "v").withColumn(SLOT, F.spark_partition_id())
    write_slots(ranges, path, buckets, ["v"])
    laid = read_slots(df.sparkSession, [path], ranges.schema, buckets, ["v"])
    # one row a range, of which there are at most MAX_WIDTH: this much may stand in one window, and be broadcast
    sizes = laid.groupBy(SLOT).agg(F.sum("n").alias("__size"))
    whole = Window.partitionBy(F.lit(0))
    before = F.sum("__size").over(whole.orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select(SLOT, F.coalesce(before, F.lit(0)).alias("base"), F.sum("__size").over(whole).alias("total"))
    own = F.sum("n").over(Window.partitionBy(SLOT).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = laid.withColumn("own", own).join(F.broadcast(bases), SLOT).withColumn("upto", F.col("own") + F.col("base"))

    def at(percent: int) -> Column:
        index = F.least(F.col("total") - 1, F.floor(F.col("total") * percent / 100))
        return F.max(F.when((F.col("upto") > index) & (F.col("upto") - F.col("n") <= index), F.col("v")))

    return placed.agg(*beside, *[at(p).alias(name) for name, p in percents.items()])


LOAD_PERCENTS = {"p50": 50, "p95": 95, "p99": 99}


def load_statistics(df: DataFrame, latency: str) -> DataFrame:
    """One row: n_requests, least, mean, p50, p95, p99, greatest of a latency column, null-free."""
    n, v = F.col("n"), F.col("v")
    plain = (
        F.coalesce(F.sum(n), F.lit(0)).alias("n_requests"),
        F.min(v).alias("least"),
        (F.sum(v * n) / F.sum(n)).alias("mean"),
        F.max(v).alias("greatest"),
    )
    return nearest_ranks(df, latency, LOAD_PERCENTS, plain)


def throughput(df: DataFrame, at: Column, seconds: int = 2) -> DataFrame:
    """Rows a second in each tick of ``seconds``: tick, per_second. Works on a stream too, given a watermark."""
    ticks = df.groupBy(F.window(at, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return ticks.select(F.col("w.start").alias("tick"), (F.col("n") / seconds).alias("per_second"))


def level_statistics(log: DataFrame, level: str) -> DataFrame:
    """Versions in each segment or level, tombstones and superseded ones included."""
    return log.groupBy(level).agg(F.count(F.lit(1)).alias("n_versions"))
