"""Resolving the version log: which versions a snapshot sees, and which one counts."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEWEST_FIRST = ("start_time", "id")


def visible(log: DataFrame, as_of: int | None) -> DataFrame:
    """Versions committed by ``as_of``; all of them for None. Pushed down to the scan."""
    return log if as_of is None else log.where(F.col("txn_ts") <= as_of)


def newest(log: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """One version for each id: the greatest txn_ts, a live one before a tombstone of the same commit.

    A move of the start writes both at one commit, hence the tie. Further ties
    go to the later start, then to the greater value of each column of ``ties``,
    nulls last; of rows alike in all of these any may win. Rows with a null id
    form no chain and are left out; a null is_deleted means live, a null txn_ts
    is older than any. The ranking keeps one row an id in each task before the
    shuffle, so an id with very many versions does not fill one task.
    """
    dead = F.coalesce(F.col("is_deleted"), F.lit(False))
    later = [F.col(c).desc_nulls_last() for c in ("start_time", *ties)]
    order = Window.partitionBy("id").orderBy(F.col("txn_ts").desc_nulls_last(), dead.asc(), *later)
    ranked = log.where(F.col("id").isNotNull()).withColumn("__rank", F.row_number().over(order))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def live(resolved: DataFrame) -> DataFrame:
    """Without tombstones. To be applied after resolution, or an older version would come back."""
    return resolved.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))


def state(log: DataFrame, as_of: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """The events that exist in a snapshot, each in its newest visible version."""
    return live(newest(visible(log, as_of), ties))


#: Ids up to this number are broadcast to what they replace; more are joined by shuffle.
BROADCAST_IDS = 200_000


@dataclass(frozen=True)
class Snapshots:
    """A log, with its state as of commit ``at`` kept beside it, one row an id, and the part of the log after that.

    Any snapshot from ``at`` on is the kept state without the ids that changed
    since, and what these are now. So filters on times and payload go to the scan
    of the kept state, where the files are laid out by start, and only the
    changes since are resolved. Older snapshots resolve the whole log.
    """

    log: DataFrame
    current: DataFrame | None = None
    at: int = 0
    since: DataFrame | None = None
    n_since: int = 0

    def state(self, as_of: int | None = None) -> DataFrame:
        """As :func:`state` of the log."""
        if self.current is None or (as_of is not None and as_of < self.at):
            return state(self.log, as_of)
        if self.since is None:
            return self.current
        changed = newest(visible(self.since, as_of))
        ids = changed.select(F.col("id").alias("__id"))
        ids = F.broadcast(ids) if self.n_since <= BROADCAST_IDS else ids
        kept = self.current.join(ids, F.col("id") == F.col("__id"), "left_anti")
        return kept.unionByName(live(changed))


def state_of(log: DataFrame | Snapshots, as_of: int | None = None) -> DataFrame:
    return log.state(as_of) if isinstance(log, Snapshots) else state(log, as_of)


def overlaps(start: datetime.datetime | None, end: datetime.datetime | None) -> Column:
    """Whether an event overlaps [start, end], both inclusive, in whole seconds; None is unbounded.

    Written so that the bounds are literals beside bare columns, which Parquet
    statistics can use. An event with a null bound fails a test of that bound,
    as the condition is then null.
    """
    test = F.lit(True)
    if end is not None:
        upper = end.replace(microsecond=0) + datetime.timedelta(seconds=1)
        test = test & (F.col("start_time") < F.lit(upper).cast("timestamp_ntz"))
    if start is not None:
        lower = start.replace(microsecond=0)
        test = test & (F.col("end_time") >= F.lit(lower).cast("timestamp_ntz"))
    return test


def newest_first(df: DataFrame) -> DataFrame:
    """The order of every listing; the resource takes no part in it."""
    return df.orderBy(*[F.col(c).desc() for c in NEWEST_FIRST])


def at_or_after(start: datetime.datetime, id_: str) -> Column:
    """Keys from (start, id) on in that order, inclusive: a token is the first key of the next page."""
    at = F.lit(start).cast("timestamp_ntz")
    return (F.col("start_time") < at) | ((F.col("start_time") == at) & (F.col("id") <= F.lit(id_)))
