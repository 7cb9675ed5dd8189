"""Create, update and delete, as functions from a log to the versions to append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import MUTABLE, VERSION
from tidemark.operators.versions import state


def _as_versions(df: DataFrame, txn_ts: int, deleted: bool) -> DataFrame:
    named = {f.name for f in VERSION} - {"txn_ts", "is_deleted"}
    kept = [F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in VERSION if f.name in named]
    return df.select(*kept, F.lit(txn_ts).cast("bigint").alias("txn_ts"), F.lit(deleted).alias("is_deleted"))


def time_ordered_id(at_ms: Column, unique: Column) -> Column:
    """A version 7 UUID of a time in milliseconds and a text that is unique within it; the same for the same input."""
    noise = F.md5(unique.cast("string"))
    when = F.lpad(F.lower(F.hex(at_ms)), 12, "0")
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(noise, 4, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(when, 1, 8), F.lit("-"), F.substring(when, 9, 4), F.lit("-7"), F.substring(noise, 1, 3),
        F.lit("-"), variant, F.substring(noise, 5, 3), F.lit("-"), F.substring(noise, 8, 12),
    )


def created(events: DataFrame, txn_ts: int, at_ms: int | None = None, salt: str = "") -> DataFrame:
    """A live version for each row, all at one commit.

    With ``at_ms`` ids are assigned, replacing those given; without, rows must
    bring theirs. Nothing else is validated, and null columns stay null.
    """
    if at_ms is not None:
        unique = F.concat_ws("/", F.lit(salt), F.lit(str(txn_ts)), F.monotonically_increasing_id().cast("string"))
        events = events.withColumn("id", time_ordered_id(F.lit(at_ms), unique))
    return _as_versions(events, txn_ts, False)


def _of(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the log whose id is in ``__id``."""
    return log.join(ids.select("__id"), F.col("id") == F.col("__id"), "left_semi")


def updated(log: DataFrame, changes: DataFrame, mask: Sequence[str], txn_ts: int) -> DataFrame:
    """New versions for the rows of ``changes``, which name existing events by id.

    Columns in ``mask`` take the new value, null included; others, and names
    that are not mutable, keep the old. The resource cannot change. An event
    whose start really moved also gets a tombstone at its old key, at the same
    commit. Changes to ids that do not exist give nothing; of several changes
    to one id, which would be ambiguous, one alone must be given.

    ``log`` may also be a state. It is reduced to the ids that change before it
    is resolved; few changes are thereby found without moving the log.
    """
    fields = [m for m in MUTABLE if m in mask]
    fresh = changes.select(F.col("id").alias("__id"), *[F.col(m).alias(f"__{m}") for m in fields])
    both = state(_of(log, fresh)).join(fresh, F.col("id") == F.col("__id"))
    there = [f.name for f in VERSION if f.name in log.columns]
    merged = both.select(*[F.col(f"__{c}").alias(c) if c in fields else F.col(c) for c in there], F.col("start_time").alias("__old"))
    live = _as_versions(merged, txn_ts, False)
    if "start_time" not in fields:
        return live
    moved = merged.where(~F.col("start_time").eqNullSafe(F.col("__old"))).select("id", "resource", F.col("__old").alias("start_time"))
    return live.unionByName(_as_versions(moved, txn_ts, True))


def deleted(log: DataFrame, ids: DataFrame, txn_ts: int) -> DataFrame:
    """A tombstone, without payload, for each existing event that ``ids`` (column id) names; repeats count once."""
    gone = ids.select(F.col("id").alias("__id"))
    found = state(_of(log, gone))
    return _as_versions(found.select("id", "resource", "start_time"), txn_ts, True)
