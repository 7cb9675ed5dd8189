"""An event store on an append-only version log: create, update, delete, list, statistics, compaction.

The log is Parquet parts under one root, published by numbered manifests; the
number of the manifest that publishes a commit is its timestamp, so timestamps
grow, are unique, and a snapshot is a number. New parts are pending (level 0).
Compaction folds them into level 1 and promotes a level that has outgrown its
limit into the next; all versions are kept unless told otherwise. Beside the log
the state as of a commit is kept, laid out by start, which compaction renews:
reads of later snapshots take it and resolve only what was committed since.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import EVENT, MUTABLE, VERSION
from tidemark.operators import mutations
from tidemark.operators.versions import Snapshots, newest
from tidemark.plans.listing import Page, Request, page
from tidemark.session import use_utc, width_for
from tidemark.sources.manifest import Part, PartStore, PublishConflict, Version

# The greatest number of versions of levels 1, 2 and 3; the last has no limit.
LEVEL_LIMITS = (256_000, 1_024_000, 4_096_000)
TRIES = 8
MAX_LOOKUP = 10_000
#: The kept state is written again once one in so many of its rows may have changed.
RENEW_ONE_IN = 10
#: Parts of the last level are merged with what comes in if they are at most so many times as large.
TIER = 4


class UnknownEvent(LookupError):
    """No event has this id."""


class EventStore:
    def __init__(self, spark: SparkSession, root: str, level_limits: Sequence[int] = LEVEL_LIMITS):
        self.spark, self.level_limits = use_utc(spark), tuple(level_limits)
        self.parts = PartStore(spark, root)

    # reading

    def log(self, version: Version | None = None) -> DataFrame:
        """All versions; an empty log before the first commit."""
        found = (version or self.parts.current()).parts
        if not found:
            return self.spark.createDataFrame([], VERSION)
        return self.spark.read.schema(VERSION).parquet(*[p.path for p in found])

    def snapshots(self, version: Version | None = None) -> Snapshots:
        """The log with the state that is kept beside it."""
        version = version or self.parts.current()
        kept = version.facts.get("current")
        if not kept:
            return Snapshots(self.log(version))
        later = tuple(p for p in version.parts if p.until > kept["at"])
        since = self.log(Version(parts=later)).where(F.col("txn_ts") > kept["at"]) if later else None
        current = self.spark.read.schema(VERSION).parquet(kept["path"])
        # merged parts may hold older versions too, so this is at least the number of later ones
        return Snapshots(self.log(version), current, kept["at"], since, sum(p.rows for p in later))

    def snapshot(self) -> int:
        """The timestamp of the newest commit; 0 before the first."""
        return self.parts.current().number

    def events(self, as_of: int | None = None) -> DataFrame:
        return self.snapshots().state(as_of)

    def list(self, **request: Any) -> Page:
        """One page; takes the fields of :class:`Request`, of which page_size must be given."""
        asked = Request(**request)
        if asked.as_of is None and not asked.page_token:
            asked = Request(**{**request, "as_of": self.snapshot()})
        return page(self.snapshots(), asked)

    def lookup(self, ids: Iterable[str], as_of: int | None = None) -> DataFrame:
        """Events with these ids, at most MAX_LOOKUP; the filter on the chain's key goes below the resolution, to the scan."""
        wanted = list(ids)
        if len(wanted) > MAX_LOOKUP:
            raise ValueError(f"more than {MAX_LOOKUP} ids: join with events() instead")
        return self.snapshots().state(as_of).where(F.col("id").isin(wanted))

    def statistics(self) -> dict[str, Any]:
        """Versions pending, in each pending part and in each level, from the manifest alone."""
        parts = self.parts.current().parts
        pending = [p.rows for p in parts if p.level == 0]
        levels = {n + 1: 0 for n in range(len(self.level_limits) + 1)}
        for p in parts:
            if p.level:
                levels[p.level] += p.rows
        return {
            "buffered_versions": sum(pending),
            "pending_count": len(pending),
            "pending_cardinalities": dict(enumerate(pending)),
            "level_cardinalities": levels,
        }

    def level_table(self) -> DataFrame:
        """level, part, n_versions: each pending part by itself (level 0), then each level that has any; one row a part of the manifest."""
        parts = self.parts.current().parts
        pending = [(0, i, p.rows) for i, p in enumerate(p for p in parts if p.level == 0)]
        levels = [(level, 0, n) for level, n in self.statistics()["level_cardinalities"].items() if n]
        return self.spark.createDataFrame([*pending, *levels], "level int, part int, n_versions bigint")

    # writing

    def commit(self, make, tag: str | None = None) -> int:
        """Append what ``make(state, timestamp)`` returns, and return the timestamp.

        If another writer takes that number first, the versions are made anew
        from the newer state. A tag that was committed before is not committed
        again, so a repeated batch changes nothing.
        """
        for _ in range(TRIES):
            base = self.parts.current()
            if tag and base.holds(tag):
                return base.number
            txn = base.number + 1
            path = self.parts.new_part_path()
            make(self.snapshots(base).state(), txn).write.parquet(path)
            try:
                return self.parts.publish(base, (*base.parts, self._part(path, tag or "", 0, txn)), tag).number
            except PublishConflict:
                continue
        raise PublishConflict(f"no commit after {TRIES} tries")

    def _part(self, path: str, tag: str, level: int, until: int) -> Part:
        return Part(path, tag, level, self.spark.read.parquet(path).count(), until)  # from the footers

    def create(self, events: DataFrame, tag: str | None = None, assign_ids: bool = True) -> int:
        at = int(time.time() * 1000) if assign_ids else None
        return self.commit(lambda log, txn: mutations.created(events, txn, at, self.parts.root), tag)

    def create_batch(self, events: Sequence[Mapping[str, Any]]) -> list[str]:
        """Create a few events given as mappings; returns their ids in order."""
        at = int(time.time() * 1000)
        ids = []
        for _ in events:
            noise = uuid.uuid4().int & ((1 << 74) - 1)
            ids.append(str(uuid.UUID(int=at << 80 | 7 << 76 | (noise >> 62) << 64 | 2 << 62 | noise & ((1 << 62) - 1))))
        rows = [tuple(i if f.name == "id" else e.get(f.name) for f in EVENT) for i, e in zip(ids, events)]
        self.create(self.spark.createDataFrame(rows, EVENT), assign_ids=False)
        return ids

    def update(self, event_id: str, changes: Mapping[str, Any], mask: Sequence[str]) -> int:
        """Change the masked fields of one event; names that cannot change are ignored."""
        self._must_exist(event_id)
        fields = [f for f in EVENT if f.name == "id" or f.name in MUTABLE]
        row = tuple(event_id if f.name == "id" else changes.get(f.name) for f in fields)
        one = self.spark.createDataFrame([row], type(EVENT)(fields))
        return self.commit(lambda log, txn: mutations.updated(log, one, mask, txn))

    def delete(self, event_id: str) -> int:
        self._must_exist(event_id)
        one = self.spark.createDataFrame([(event_id,)], "id string")
        return self.commit(lambda log, txn: mutations.deleted(log, one, txn))

    def _must_exist(self, event_id: str) -> None:
        if self.lookup([event_id]).isEmpty():
            raise UnknownEvent(event_id)

    # compaction

    def compact(self, forget_before: int | None = None) -> Version:
        """Fold pending parts into level 1, then promote every level beyond its limit.

        With ``forget_before`` the folded parts lose versions that no snapshot
        from there on can see: those superseded by a later one of the same fold
        that is not after ``forget_before``.
        """
        version, last = self.parts.current(), len(self.level_limits)
        for level in range(last + 1):
            fold, target = [p for p in version.parts if p.level == level], level
            full = level and sum(p.rows for p in fold) > self.level_limits[level - 1]
            if not fold or (level and not full):
                continue
            while True:
                incoming = sum(p.rows for p in fold)
                # a large part of the last level, which has no limit, is not written again for a little more
                fold += [p for p in version.parts if p.level == target + 1 and not (target == last and p.rows > TIER * incoming)]
                target += 1
                # what would be promoted at once is written in the level where it stays; what may lose versions is counted first
                if forget_before is not None or target > last or sum(p.rows for p in fold) <= self.level_limits[target - 1]:
                    break
            merged = self.log(Version(parts=tuple(fold)))
            if forget_before is not None:
                old = merged.where(F.col("txn_ts") <= forget_before)
                merged = newest(old).unionByName(merged.where(F.col("txn_ts") > forget_before))
            path = self.parts.new_part_path()
            order = [F.col("start_time").desc(), F.col("id").desc(), F.col("txn_ts").desc()]
            merged.repartitionByRange(width_for(merged), *order).sortWithinPartitions(*order).write.parquet(path)
            rest = tuple(p for p in version.parts if p not in fold)
            until = max(p.until for p in fold)
            version = self.parts.publish(version, (*rest, self._part(path, f"level {target}", target, until)))
        return self._keep_state(version)

    def _keep_state(self, version: Version) -> Version:
        """Write the newest state beside the log, from the one that is there and what came since, once that is not little."""
        newest_commit = max((p.until for p in version.parts), default=0)
        kept, found = version.facts.get("current"), self.snapshots(version)
        if not newest_commit or (kept and (kept["at"] == newest_commit or found.n_since * RENEW_ONE_IN < kept["rows"])):
            return version
        events, path = found.state(), self.parts.new_part_path()
        order = [F.col("start_time").desc(), F.col("id").desc()]
        events.repartitionByRange(width_for(events), *order).sortWithinPartitions(*order).write.parquet(path)
        rows = self._part(path, "", 0, newest_commit).rows
        return self.parts.publish(version, version.parts, facts={"current": {"path": path, "at": newest_commit, "rows": rows}})
