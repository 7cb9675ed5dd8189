"""A table rebuilt from a change feed, as a log-structured merge tree.

Each append writes one run, sorted by key and sequence. All runs of a table are
laid out alike, so that a task finds its stretch of keys in each of them: a read
merges the runs there, without moving a row, the newest sequence of a key winning
and a live change winning over a tombstone of the same sequence, and drops keys
whose winner is a tombstone. The order of arrival plays no part. When a level
holds ``fan_in`` runs they are merged, in the same way, into one of the next
level, which keeps the number of runs logarithmic in that of the appends.

Keys are placed by a hash. A key with so many changes that its place would
outgrow others is split: its changes are placed by row, every place merges its
own, and what remains, one change a place, is merged across places. Split keys
are few, as each holds a stated share of a batch, and are part of the manifest.

Tombstones and superseded changes may be forgotten up to a horizon. From then on
the table takes no change from before it, as one could bring back what a
forgotten tombstone deleted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import width_for
from tidemark.sources.manifest import Part, PartStore, Version
from tidemark.sources.slots import SLOT, read_slots, write_slots

RUN = "__run"
PLACES = 1 << 20
#: A key is split if it has so many rows in a batch, and more than one in so many of them for each bucket.
SPLIT_ROWS = 100_000
SPLIT_SHARE = 4
#: The keys that the sketch for finding these follows.
COUNTED_KEYS = 10_000


class LateChange(ValueError):
    """Changes from before the horizon, up to which tombstones are forgotten."""


class ChangeTable:
    """A change feed with ``key``, ``sequence`` and ``deleted`` columns, stored as sorted runs.

    Changes with a null key or sequence cannot be placed and are left out of
    every run. A null ``deleted`` means live. Of several live changes of one
    key and sequence with different payloads the greatest payload wins, by
    column in the given order and nulls least, so that any order of arrival
    gives the same result. Only ``key``, ``sequence``, ``deleted`` and
    ``payload`` columns are stored. Keys are texts or whole numbers. Appending
    nothing gives an empty run; reading before any append is an error.

    ``buckets`` is the number of tasks of every later read and merge, fixed by
    the first append, by default from the size of its files.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        key: str,
        sequence: str,
        deleted: str,
        payload: Sequence[str],
        fan_in: int = 4,
        buckets: int | None = None,
        split_rows: int = SPLIT_ROWS,
    ):
        self.spark, self.store = spark, PartStore(spark, root)
        self.key, self.sequence, self.deleted, self.payload = key, sequence, deleted, list(payload)
        self.fan_in, self.buckets, self.split_rows = fan_in, buckets, split_rows

    # writing

    def append(self, changes: DataFrame, tag: str) -> Version:
        """Write one run and publish it. A batch that was appended before, compacted since or not, is not appended again.

        Batches are best named ``stream/number``; see :mod:`tidemark.sources.manifest`.
        """
        return self.append_runs(changes.withColumn(RUN, F.lit(0)), RUN, tag)

    def append_runs(self, changes: DataFrame, run: str, tag: str) -> Version:
        """Write one run for each value of the integer column ``run``, in one job, and publish all at once.

        Raises LateChange if there are changes from before the horizon.
        """
        base = self.store.current()
        if base.holds(tag):
            return base
        rows = self._placeable(changes, F.col(run).cast("int").alias(RUN))
        horizon = base.facts.get("horizon")
        if horizon is not None and (late := rows.where(F.col(self.sequence) < horizon).count()):
            raise LateChange(f"{late} changes are from before {horizon}")
        buckets = base.facts.get("buckets") or self.buckets or width_for(rows)
        split = sorted({*base.facts.get("split", []), *self._large_keys(rows, buckets)})
        folder = self.store.new_part_path()
        kept = [self.key, self.sequence, self.deleted, *self.payload]
        placed = rows.withColumn(SLOT, self._slot(split)).repartition(buckets, SLOT)
        write_slots(placed.select(*kept, SLOT, RUN), folder, buckets, [self.key, self.sequence], RUN)
        path = self.store._path(folder)
        names = [s.getPath().getName() for s in self.store._fs.listStatus(path)]
        runs = sorted((n for n in names if n.startswith(f"{RUN}=")), key=lambda n: int(n.partition("=")[2]))
        new = tuple(Part(f"{folder}/{n}", f"{tag}:{n.partition('=')[2]}") for n in runs)
        facts = {"buckets": buckets, "split": split, "schema": placed.select(*kept, SLOT).schema.simpleString()}
        return self.store.publish(base, (*base.parts, *new), tag, facts)

    def _placeable(self, changes: DataFrame, *extra: Column) -> DataFrame:
        return changes.where(F.col(self.key).isNotNull() & F.col(self.sequence).isNotNull()).select(
            F.col(self.key),
            F.col(self.sequence),
            F.coalesce(F.col(self.deleted), F.lit(False)).alias(self.deleted),
            *[F.col(c) for c in self.payload],
            *extra,
        )

    def _large_keys(self, rows: DataFrame, buckets: int) -> list:
        """Keys with at least ``split_rows`` rows and more than 1 / (SPLIT_SHARE * buckets) of all, so at most SPLIT_SHARE * buckets of them.

        They come from a sketch of fixed size in each task, so no key is
        shuffled. It errs by less than 1 / COUNTED_KEYS of the rows, which
        matters to the balance of tasks only.
        """
        sketch = F.expr(f"approx_top_k(`{self.key}`, {min(COUNTED_KEYS, SPLIT_SHARE * buckets)}, {COUNTED_KEYS})")
        seen = rows.agg(sketch.alias("top"), F.count(F.lit(1)).alias("n")).first()
        return [item for item, count in seen.top or () if count >= self.split_rows and count * SPLIT_SHARE * buckets > seen.n]

    def _slot(self, split: list) -> Column:
        ordinary = F.pmod(F.xxhash64(self.key), F.lit(PLACES))
        if not split:
            return ordinary.cast("int")
        by_row = F.pmod(F.xxhash64(self.key, self.sequence, F.monotonically_increasing_id()), F.lit(PLACES))
        return F.when(F.col(self.key).isin(split), by_row).otherwise(ordinary).cast("int")

    # reading

    def _rows(self, version: Version, parts: Sequence[Part]) -> DataFrame:
        if not version.facts:
            raise LookupError("nothing was appended yet")
        schema = self.spark.createDataFrame([], version.facts["schema"]).schema
        if not parts:
            return self.spark.createDataFrame([], schema)
        return read_slots(self.spark, [p.path for p in parts], schema, version.facts["buckets"], [self.key, self.sequence])

    def _best(self) -> Column:
        """The rank of a change among those of its key."""
        return F.max(F.struct(F.col(self.sequence), (~F.col(self.deleted)).alias("__live"), *[F.col(c) for c in self.payload])).alias("__best")

    def _newest(self, rows: DataFrame, split: list, by: str | None = None) -> DataFrame:
        """The newest change of each key, with SLOT or, of a split key across its places, without."""
        ordinary, across = rows, None
        if split and by is None:
            large = F.col(self.key).isin(split)
            ordinary = rows.where(~large)
            of_place = rows.where(large).groupBy(SLOT, self.key).agg(self._best())
            across = of_place.groupBy(self.key).agg(F.max("__best").alias("__best"))
        best = ordinary.groupBy(SLOT, self.key).agg(self._best())
        if by is None:
            best = best.drop(SLOT)
        if across is not None:
            best = best.unionByName(across)
        out = {self.sequence: F.col(f"__best.{self.sequence}"), self.deleted: ~F.col("__best.__live")}
        out |= {c: F.col(f"__best.{c}") for c in self.payload}
        return best.select(F.col(self.key), *[v.alias(k) for k, v in out.items()], *([SLOT] if by else []))

    def current(self) -> DataFrame:
        """One row for each key that still exists: key, sequence, payload."""
        return self._state(None)

    def as_of(self, sequence: int) -> DataFrame:
        """The state as of ``sequence``, which must not be from before what was forgotten."""
        return self._state(sequence)

    def _state(self, sequence: int | None) -> DataFrame:
        version = self.store.current()
        rows = self._rows(version, version.parts)
        horizon = version.facts.get("horizon")
        if sequence is not None:
            if horizon is not None and sequence < horizon - 1:
                raise LookupError(f"what was before {horizon - 1} is forgotten")
            rows = rows.where(F.col(self.sequence) <= sequence)
        return self._newest(rows, version.facts["split"]).where(~F.col(self.deleted)).drop(self.deleted)

    # compaction

    def compact(self, horizon: int | None = None) -> Version:
        """Merge the runs of each level that holds at least ``fan_in`` of them into one run of the next; repeats go.

        With ``horizon`` also changes from before it go that a later one from
        before it supersedes, as far as they meet in a merge. Tombstones from
        before it go once a merge takes in every run, for no older change can
        then be there, or come: the table refuses it from now on.
        """
        version = self.store.current()
        if horizon is not None and version.facts:
            horizon = max(horizon, version.facts.get("horizon", horizon))
        level = 0
        while level <= max((p.level for p in version.parts), default=-1):
            here = [p for p in version.parts if p.level == level]
            if len(here) >= self.fan_in:
                rest = tuple(p for p in version.parts if p.level != level)
                merged = self._merged(version, here, horizon, not rest)
                folder = self.store.new_part_path()
                write_slots(merged, folder, version.facts["buckets"], [self.key, self.sequence])
                facts = {"horizon": horizon} if horizon is not None else {}
                version = self.store.publish(version, (*rest, Part(folder, f"level {level + 1}", level + 1)), facts=facts)
            level += 1
        return version

    def _merged(self, version: Version, parts: Sequence[Part], horizon: int | None, whole: bool) -> DataFrame:
        rows = self._rows(version, parts)
        if horizon is None:
            return rows.distinct()
        old = F.col(self.sequence) < horizon
        late, split = rows.where(~old).distinct(), version.facts["split"]
        # places of a split key forget on their own; its tombstones stay, as other places may hold what they delete
        kept = self._newest(rows.where(old), split, by=SLOT)
        if whole:
            ordinary = ~F.col(self.key).isin(split) if split else F.lit(True)
            kept = kept.where(~(F.col(self.deleted) & ordinary))
        return late.unionByName(kept)
