"""Merging overlapping intervals of an entity and listing the gaps.

Intervals are globally range-sorted by (entity, start), so that an entity with a
third of all rows is spread over many ranges. Each range is summarised by its
greatest end for each entity; the summaries are prefix-combined over the ranges,
and each range is rescanned, where it lies, with the greatest end that precedes
it. A start beyond everything before it opens a new period.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import scratch_path, width_for
from tidemark.sources.slots import SLOT, read_slots, write_slots

LO, HI = "__start", "__end"
#: Ranges to a bucket. Ranges are spread over buckets by a hash, which evens out the better the more there are.
RANGES_EACH = 4


def _sorted(df: DataFrame, entity: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Usable intervals, one for each (entity, start), range-sorted, with the number of their range as SLOT.

    Of equal starts only the greatest end can matter; reducing to it before the
    shuffle keeps a start that is repeated millions of times from filling one
    range, which cannot be split within equal keys. The layout is written, so
    that what follows finds each range whole and moves no row.
    """
    slim = df.select(*[F.col(c) for c in entity], start.alias(LO), end.alias(HI))
    usable = slim.where(F.col(LO).isNotNull() & (F.col(HI) >= F.col(LO)))
    usable = usable.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in entity]))
    one = usable.groupBy(*entity, LO).agg(F.max(HI).alias(HI))
    buckets, path, order = width_for(one), scratch_path(df.sparkSession, "intervals"), [*entity, LO]
    laid = one.repartitionByRange(RANGES_EACH * buckets, *order).withColumn(SLOT, F.spark_partition_id())
    write_slots(laid, path, buckets, order)
    return read_slots(df.sparkSession, [path], laid.schema, buckets, order)


def _with_carry(rows: DataFrame, entity: Sequence[str], value: Column, combine: Callable[[Column], Column]) -> DataFrame:
    """Rows with ``__carry``: the combined ``value`` of the entity's earlier ranges, null in its first.

    Only the first entity of a range can have earlier ones, so there is at most
    one carry for each range, and they are broadcast.
    """
    summary = rows.groupBy(SLOT, *entity).agg(value.alias("__sum"))
    before = Window.partitionBy(*entity).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(SLOT, *entity, combine(F.col("__sum")).over(before).alias("__carry")).where(F.col("__carry").isNotNull())
    return rows.join(F.broadcast(carry), [SLOT, *entity], "left")


def _upto(entity: Sequence[str], last: int) -> Window:
    """The rows of the entity in its range, up to the current one or the one before it."""
    return Window.partitionBy(SLOT, *entity).orderBy(LO).rowsBetween(Window.unboundedPreceding, last)


def open_periods(df: DataFrame, entity: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Each interval with ``__before``, the greatest end of all earlier ones of its entity (null for the first)."""
    rows = _with_carry(_sorted(df, entity, start, end), entity, F.max(HI), F.max)
    # greatest() passes over nulls
    return rows.withColumn("__before", F.greatest(F.max(HI).over(_upto(entity, -1)), F.col("__carry"))).drop("__carry")


def gaps(df: DataFrame, entity: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Gaps between the periods of each entity: entity, gap_start_us, gap_end_us.

    ``start`` and ``end`` are BIGINT columns. Intervals that overlap or touch
    are one period. Rows with a null entity column, start or end, or with end
    before start, are left out; an empty interval (end = start) counts. Gaps
    are longer than zero. Repeated rows change nothing; an empty input has no
    gaps; other columns are ignored.
    """
    opened = open_periods(df, entity, start, end).where(F.col("__before") < F.col(LO))
    return opened.select(*entity, F.col("__before").alias("gap_start_us"), F.col(LO).alias("gap_end_us"))


def periods(df: DataFrame, entity: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Merged periods of each entity: entity, period_no (from 1), start_us, end_us.

    Rows are treated as in :func:`gaps`. Periods are numbered by a second prefix
    combination: those opened in earlier ranges plus those opened so far.
    Grouping by number is pre-aggregated, so one period may hold any number of rows.
    """
    opens = F.col("__before").isNull() | (F.col("__before") < F.col(LO))
    flagged = open_periods(df, entity, start, end).withColumn("__opens", opens.cast("bigint"))
    counted = _with_carry(flagged, entity, F.sum("__opens"), F.sum)
    numbered = counted.withColumn("period_no", F.sum("__opens").over(_upto(entity, 0)) + F.coalesce("__carry", F.lit(0)))
    return numbered.groupBy(*entity, "period_no").agg(F.min(LO).alias("start_us"), F.max(HI).alias("end_us"))
