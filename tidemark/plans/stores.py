"""Queries of the write path: a store is written, compacted and streamed into in the shared folder, and then read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import DUMP, EVENT
from tidemark.plans.events import CLICK, END, IN_RANGE, SEG3, SHOWN, START, mapped_scalars, mapped_sql, shown
from tidemark.plans.fixture import COMMIT, LOG_SQL, state_sql, version_log
from tidemark.plans.listing import Request, all_pages, matching
from tidemark.session import scratch_path
from tidemark.sources import rows as stored
from tidemark.sources.tables import table
from tidemark.store import LEVEL_LIMITS, EventStore
from tidemark.streaming.ingest import event_stream, ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PAGE_SIZE = 500
COMMITS = sorted(set(COMMIT))


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _store(spark: SparkSession, log: DataFrame, commits=COMMITS, compact_after: int | None = None) -> EventStore:
    """The fixture's commits, each made by a commit of a store, compacted after one of them."""
    store = EventStore(spark, scratch_path(spark, "store"))
    for n in commits:
        store.commit(lambda _, txn, n=n: log.where(F.col("txn_ts") == n).withColumn("txn_ts", F.lit(txn).cast("bigint")), f"fixture/{n}")
        if n == compact_after:
            store.compact()
    return store


_VERSIONS = "id, title, start_time, end_time, array_to_string(list_sort(tags), ',') AS tags, is_deleted"


@query(f"WITH {LOG_SQL} SELECT {_VERSIONS}, CAST(txn_ts AS BIGINT) AS txn_ts FROM log")
def store_log(spark, folder):
    """Every version that was committed, read after compaction: nothing is lost, and commits are numbered in order."""
    store = _store(spark, version_log(spark, folder), compact_after=COMMITS[-1])
    return store.log().select("id", "title", "start_time", "end_time", F.array_join(F.array_sort("tags"), ",").alias("tags"), "is_deleted", "txn_ts")


_WITHOUT_TXN = SHOWN.rpartition(",")[0]


@query(f"{state_sql()} SELECT {_WITHOUT_TXN} FROM cur")
def store_events(spark, folder):
    """The newest state: what compaction kept, and two commits after it."""
    return shown(_store(spark, version_log(spark, folder), compact_after=2).events()).drop("txn_ts")


@query(f"{state_sql(2)} SELECT {_WITHOUT_TXN} FROM cur")
def store_as_of(spark, folder):
    """A snapshot from before the kept state, out of the compacted log."""
    return shown(_store(spark, version_log(spark, folder), compact_after=COMMITS[-1]).events(as_of=2)).drop("txn_ts")


@query(f"{state_sql()} SELECT {_WITHOUT_TXN} FROM cur WHERE {IN_RANGE} AND ({CLICK} OR {SEG3})")
def store_listing(spark, folder):
    """A range and a filter over the kept state and what came since."""
    store = _store(spark, version_log(spark, folder), compact_after=3)
    return shown(matching(store.snapshots(), Request('tags = "click" OR tags = "seg:3"', START, END))).drop("txn_ts")


_LEVEL = "CASE " + " ".join(f"WHEN count(*) <= {limit} THEN {n + 1}" for n, limit in enumerate(LEVEL_LIMITS)) + f" ELSE {len(LEVEL_LIMITS) + 1} END"


@query(
    f"""WITH {LOG_SQL} SELECT {_LEVEL} AS level, 0 AS part, count(*) AS n_versions FROM log WHERE txn_ts <= 2 HAVING count(*) > 0
        UNION ALL SELECT 0, CAST(txn_ts - 3 AS INTEGER), count(*) FROM log WHERE txn_ts > 2 GROUP BY ALL"""
)
def store_levels(spark, folder):
    """Versions in each pending part (level 0) and in each level, from the manifest: two commits folded, two pending."""
    return _store(spark, version_log(spark, folder), compact_after=2).level_table().where("n_versions > 0")


@query("SELECT count(*) AS n_events, count(*) AS n_ids, count(*) AS n_time_ordered FROM events")
def store_assigned_ids(spark, folder):
    """Events created without ids get different ones, all of version 7."""
    store = EventStore(spark, scratch_path(spark, "store"))
    rows = version_log(spark, folder).where(F.col("txn_ts") == 1).select(*[f.name for f in EVENT if f.name in ("title", "start_time", "end_time", "tags")])
    store.create(rows)
    seventh = F.substring("id", 15, 1) == "7"
    return store.log().agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("id").alias("n_ids"), F.count(F.when(seventh & (F.length("id") == 36), 1)).alias("n_time_ordered")
    )


@query(f"{state_sql(1)} SELECT {_WITHOUT_TXN} FROM cur")
def stream_ingest(spark, folder):
    """Events that a stream brought in micro-batches, each one commit, compacted on the way; the stream is then run again."""
    source, store = scratch_path(spark, "stream"), EventStore(spark, scratch_path(spark, "store"))
    first = version_log(spark, folder).where(F.col("txn_ts") == 1).drop("txn_ts", "is_deleted")
    first.repartition(6, "id").write.parquet(source)
    for _ in range(2):
        ingest(event_stream(spark, source, EVENT, 1), store, scratch_path(spark, "progress"), "feed").awaitTermination()
    return shown(store.events()).drop("txn_ts")


@query(f"{state_sql(4)} SELECT {SHOWN} FROM cur WHERE {IN_RANGE}")
def page_all_concat(spark, folder):
    """All pages of a listing, each cut from its token to that of the next; no event comes to the driver."""
    store = _store(spark, version_log(spark, folder), compact_after=COMMITS[-1])
    return shown(all_pages(store.snapshots(), Request("", START, END, store.snapshot(), PAGE_SIZE)))


@query("SELECT id, start_time FROM event_rows WHERE resource_external_id = (SELECT min(resource_external_id) FROM event_rows)")
def sharded_lookup(spark, folder):
    """Rows of one key, from the one shard that holds it."""
    rows, path = table(spark, folder, "event_rows").select("resource_external_id", "id", "start_time"), scratch_path(spark, "shards")
    stored.write_sharded(rows, path, "resource_external_id")
    key = rows.agg(F.min("resource_external_id")).first()[0]
    return stored.read_shard(spark, path, "resource_external_id", key or "", schema=rows.schema).select("id", "start_time")


@query(mapped_sql("event_dump"))
def etl_from_files(spark, folder):
    """The dump written as JSON lines under the column names of its tables, read and mapped."""
    dump, path = table(spark, folder, "event_dump"), scratch_path(spark, "dump")
    dump.select(*[F.col(f.name).alias(stored.prefixed(f.name)) for f in DUMP]).write.json(path)
    return mapped_scalars(stored.read_dump(spark, path, prefix=True))
