"""Exactly one copy of messages that were delivered at least once.

Producers that number their messages in sequence are remembered as disjoint
ranges of seen numbers, which merge as holes are filled, so that the state of a
producer that has sent a billion messages in order is one range for each block.
Identifiers without a sequence number are remembered as exact keys.

Ranges are clipped to blocks of ``BLOCK`` numbers. A block is the unit of every
shuffle, so one producer with a third of all messages is spread over many tasks,
and no group can hold more than ``BLOCK`` numbers.

A batch adds what it has that is new, and leaves the rest of the state as it is;
state lies in buckets (see :mod:`tidemark.sources.slots`), where a batch is
brought to it and it is never moved. Every few batches the additions are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, width_for
from tidemark.sources.manifest import Part, PartStore, Version
from tidemark.sources.slots import read_slots, write_slots

BLOCK = 1024
RANGES, EXACT, VERDICTS = 0, 1, 2
STATE = {RANGES: "producer string, block bigint, lo bigint, hi bigint", EXACT: "exact string"}
PLACE = {RANGES: ("producer", "block"), EXACT: ("exact",)}


@dataclass(frozen=True)
class MessageKey:
    """How a delivery is identified.

    ``number`` is the sequence number within ``producer`` where both are
    non-null; otherwise ``exact`` is the identifier. A delivery with neither is
    no message and is left out.
    """

    producer: Column
    number: Column
    exact: Column
    delivery: Column


class SeenMessages:
    """Which messages were accepted, kept in the folder ``root`` over any number of batches.

    Batches must be given in order of delivery number: the copy with the
    smallest is kept. Within a batch any order and any number of repeats will
    do. Delivery numbers must be unique. An empty batch accepts nothing.

    The verdicts of a batch are stored with the state that follows from them and
    published together, so a batch that is given again, as after a failure on
    the way to wherever its messages go, gets the verdicts that it had. They are
    there until :meth:`forget`.

    ``buckets`` is the number of tasks over the state, fixed by the first batch,
    by default from the size of its files.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, merge_every: int = 8):
        self.spark, self.store = spark, PartStore(spark, root)
        self.buckets, self.merge_every = buckets, merge_every

    def _state(self, version: Version, kind: int) -> DataFrame | None:
        paths = [p.path for p in version.parts if p.level == kind]
        if not paths:
            return None
        schema = self.spark.createDataFrame([], STATE[kind]).schema
        return read_slots(self.spark, paths, schema, version.facts["buckets"], (), on=PLACE[kind])

    def ranges(self) -> DataFrame | None:
        """producer, block, lo, hi: disjoint, and not adjacent within a block."""
        found = self._state(self.store.current(), RANGES)
        return None if found is None else _merged(found)

    def accept(self, batch: DataFrame, key: MessageKey, tag: str) -> DataFrame:
        """Record a batch; returns delivery, kept (BOOLEAN) for its messages.

        ``tag`` names the batch, at best as ``stream/number``. One that is
        recorded is not looked at again: its verdicts are returned, or a
        ValueError raised if they were forgotten.
        """
        base = self.store.current()
        if base.holds(tag):
            return self._verdicts(base, tag)
        numbered = key.producer.isNotNull() & key.number.isNotNull()
        slim = batch.select(
            F.when(numbered, key.producer).alias("producer"),
            F.when(numbered, key.number).alias("number"),
            F.when(~numbered, key.exact).alias("exact"),
            key.delivery.alias("delivery"),
        ).where(F.col("number").isNotNull() | F.col("exact").isNotNull())
        first = slim.groupBy("producer", "number", "exact").agg(F.min("delivery").alias("delivery"))
        placed = first.withColumn("block", F.floor(F.col("number") / F.lit(BLOCK)).cast("bigint"))
        in_order, odd = placed.where(F.col("exact").isNull()), placed.where(F.col("exact").isNotNull())
        ranges, keys = self._state(base, RANGES), self._state(base, EXACT)
        if ranges is not None:
            held = ranges.groupBy("producer", "block").agg(F.collect_list(F.struct("lo", "hi")).alias("held"))
            held = held.select(F.col("producer").alias("__p"), F.col("block").alias("__b"), "held")
            same = (F.col("producer") == F.col("__p")) & (F.col("block") == F.col("__b"))
            covered = F.exists("held", lambda r: F.col("number").between(r["lo"], r["hi"]))
            in_order = in_order.join(held, same, "left").where(~F.coalesce(covered, F.lit(False))).drop("__p", "__b", "held")
        if keys is not None:
            odd = odd.join(keys.select(F.col("exact").alias("__e")), F.col("exact") == F.col("__e"), "left_anti")
        new = cut_lineage(in_order.unionByName(odd), "accepted")
        buckets = base.facts.get("buckets") or self.buckets or width_for(batch)
        points = new.where(F.col("exact").isNull()).select("producer", "block", F.col("number").alias("lo"), F.col("number").alias("hi"))
        keys_of = new.where(F.col("exact").isNotNull()).select("exact")
        parts = [
            self._written(_merged(points.repartition(buckets, *PLACE[RANGES])), RANGES, buckets),
            self._written(keys_of.repartition(buckets, *PLACE[EXACT]), EXACT, buckets),
        ]
        verdicts = Part(self.store.new_part_path(), tag, VERDICTS)
        accepted = new.select(F.col("delivery").alias("__kept"))
        judged = slim.join(accepted, F.col("delivery") == F.col("__kept"), "left")
        judged.select("delivery", F.col("__kept").isNotNull().alias("kept")).write.parquet(verdicts.path)
        published = self.store.publish(base, (*base.parts, *parts, verdicts), tag, {"buckets": buckets})
        if sum(p.level == RANGES for p in published.parts) >= self.merge_every:
            published = self.compact()
        return self._verdicts(published, tag)

    def _verdicts(self, version: Version, tag: str) -> DataFrame:
        found = tuple(p for p in version.parts if p.level == VERDICTS and p.tag == tag)
        if not found:
            raise ValueError(f"batch {tag} was accepted before and its verdicts are forgotten")
        return self.store.read(found)

    def _written(self, rows: DataFrame, kind: int, buckets: int) -> Part:
        path = self.store.new_part_path()
        write_slots(rows, path, buckets, (), on=PLACE[kind])
        return Part(path, "", kind)

    def forget(self, tag: str) -> Version:
        """Drop the verdicts of a batch whose messages have arrived where they go."""
        base = self.store.current()
        return self.store.publish(base, tuple(p for p in base.parts if p.level != VERDICTS or p.tag != tag))

    def compact(self) -> Version:
        """Merge the additions of all batches, bucket by bucket."""
        base = self.store.current()
        ranges, keys, buckets = self._state(base, RANGES), self._state(base, EXACT), base.facts.get("buckets")
        if ranges is None:
            return base
        merged = (self._written(_merged(ranges), RANGES, buckets), self._written(keys, EXACT, buckets))
        return self.store.publish(base, (*(p for p in base.parts if p.level == VERDICTS), *merged))


def _merged(points: DataFrame) -> DataFrame:
    """Ranges of any number of batches as disjoint ones; the window's groups hold one block."""
    block = ("producer", "block")
    ordered = Window.partitionBy(*block).orderBy("lo")
    fresh = F.col("lo") > F.coalesce(F.lag("hi").over(ordered), F.col("lo") - 2) + 1
    return (
        points.withColumn("__fresh", fresh.cast("int"))
        .withColumn("__island", F.sum("__fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*block, "__island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .select("producer", "block", "lo", "hi")
    )
