"""The data-pipeline queries of the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import OPEN_END, canonical_id, micros, month_of_micros
from tidemark.operators.eager import heavy_keys, join_states, key_states, roll_up
from tidemark.operators.incremental import IncrementalTarget, last_successful_mark
from tidemark.operators.intervals import gaps, periods
from tidemark.operators.lsm import ChangeTable
from tidemark.operators.orphans import Reference, find_orphans
from tidemark.operators.seen import MessageKey, SeenMessages
from tidemark.session import scratch_path
from tidemark.sources.tables import table

RESOURCE = ("resource_type_code", "resource_external_id")
HEAVY_ONE_IN = 50  # 2 % of all rows
RUNS_PER_LOAD = 4


# 1. A few keys holding most records


def resource_states(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables' per-resource states, joined by resource."""
    rows = key_states(table(spark, folder, "event_rows"), RESOURCE, "event", distinct="id", newest="start_time")
    index = key_states(table(spark, folder, "event_id_index"), RESOURCE, "index", distinct="id", newest="start_time")
    return join_states(rows, index, RESOURCE)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Heavy keys among the joined states, which here hold counts alone."""
    rows, index = (key_states(table(spark, folder, name), RESOURCE, prefix) for name, prefix in (("event_rows", "event"), ("event_id_index", "index")))
    states = join_states(rows, index, RESOURCE)
    heavy = heavy_keys(states, table(spark, folder, "event_rows"), "event_rows", HEAVY_ONE_IN)
    return heavy.where(F.col(RESOURCE[0]).isNotNull() & F.col(RESOURCE[1]).isNotNull()).select(*RESOURCE)


def p1_resource_stats(spark: SparkSession, folder: str) -> DataFrame:
    return resource_states(spark, folder).withColumn("pair_rows", F.col("pair_rows").cast("string"))


def p1_type_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rolled = roll_up(
        resource_states(spark, folder), RESOURCE[:1], ["event_rows", "index_rows", "pair_rows"], {"newest": "event_newest"}
    )
    return rolled.withColumn("pair_rows", F.col("pair_rows").cast("string"))


_STATES_SQL = """
WITH r AS (SELECT resource_type_code a, resource_external_id b, count(*) event_rows, count(DISTINCT id) event_distinct,
                  max(start_time) event_newest FROM event_rows GROUP BY 1, 2),
     i AS (SELECT resource_type_code a, resource_external_id b, count(*) index_rows, count(DISTINCT id) index_distinct,
                  max(start_time) index_newest FROM event_id_index GROUP BY 1, 2),
     k AS (SELECT a, b FROM r UNION SELECT a, b FROM i),
     s AS (SELECT k.a AS resource_type_code, k.b AS resource_external_id,
                  coalesce(event_rows, 0) AS event_rows, coalesce(event_distinct, 0) AS event_distinct, event_newest,
                  coalesce(index_rows, 0) AS index_rows, coalesce(index_distinct, 0) AS index_distinct, index_newest,
                  coalesce(event_rows, 0) * coalesce(index_rows, 0) AS pairs
           FROM k LEFT JOIN r ON k.a IS NOT DISTINCT FROM r.a AND k.b IS NOT DISTINCT FROM r.b
                  LEFT JOIN i ON k.a IS NOT DISTINCT FROM i.a AND k.b IS NOT DISTINCT FROM i.b)
"""

# 2. References to records that do not exist


def _standing(df: DataFrame) -> DataFrame:
    return df.where(F.col("removed_at").isNull()).select(
        canonical_id(F.col("id")).alias("id"), month_of_micros(F.col("start_time")).alias("month")
    ).where(F.col("id").isNotNull()).select("id", F.coalesce("month", F.lit("none")).alias("period"))


def _mirrored(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: _standing(table(spark, folder, name)) for name in ("event_id_index", "event_rows")}


MIRROR = (Reference("event_id_index", "id", "event_rows"), Reference("event_rows", "id", "event_id_index"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = find_orphans(_mirrored(spark, folder), MIRROR)
    return found.where(F.col("kind") == "direct").select("ref_table", "ref_month", "id").distinct()


def p2_orphan_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table and month with the change log below the rows it changes: direct and inherited."""
    tables = _mirrored(spark, folder)
    changes = table(spark, folder, "event_versions").where(~F.coalesce(F.col("is_deleted"), F.lit(False)))
    tables["event_versions"] = changes.select(
        canonical_id(F.col("id")).alias("id"), F.coalesce(month_of_micros(F.col("start_time")), F.lit("none")).alias("period")
    ).where(F.col("id").isNotNull())
    found = find_orphans(tables, (*MIRROR, Reference("event_versions", "id", "event_rows")))
    return found.groupBy("ref_table", "ref_month", "kind").agg(F.count(F.lit(1)).alias("n_ids"))


_CANON = """CASE WHEN regexp_full_match(translate(regexp_replace(lower(trim(id, ' ')), '^urn:uuid:', ''), '{}-', ''), '[0-9a-f]{32}')
 THEN regexp_replace(translate(regexp_replace(lower(trim(id, ' ')), '^urn:uuid:', ''), '{}-', ''),
      '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') ELSE lower(trim(id, ' ')) END"""
_MONTH = "coalesce(strftime(make_timestamp(start_time), '%Y-%m'), 'none')"
_STAND_SQL = f"""
WITH i AS (SELECT DISTINCT {_CANON} AS id, {_MONTH} AS m FROM event_id_index WHERE id IS NOT NULL AND removed_at IS NULL),
     r AS (SELECT DISTINCT {_CANON} AS id, {_MONTH} AS m FROM event_rows WHERE id IS NOT NULL AND removed_at IS NULL),
     v AS (SELECT DISTINCT {_CANON} AS id, {_MONTH} AS m FROM event_versions
           WHERE id IS NOT NULL AND NOT coalesce(is_deleted, false))
"""

# 3. Applying a stream of inserts, updates, deletes


def _loads(feed: DataFrame) -> DataFrame:
    """The feed with ``load_run``: its batches, in order, as RUNS_PER_LOAD + 1 runs."""
    span = feed.agg(F.min("batch_no").alias("lo"), F.max("batch_no").alias("hi")).first()
    width = max(1, ((span.hi or 0) - (span.lo or 0)) // (RUNS_PER_LOAD + 1) + 1)
    run = F.coalesce(F.floor((F.col("batch_no") - F.lit(span.lo or 0)) / F.lit(width)), F.lit(0))
    return feed.withColumn("load_run", run.cast("int"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first runs are compacted before the last one comes; the read merges what is then there."""
    feed = _loads(table(spark, folder, "event_versions"))
    log = ChangeTable(spark, scratch_path(spark, "changes"), "id", "txn_ts", "is_deleted", ["start_time"], fan_in=RUNS_PER_LOAD)
    log.append_runs(feed.where(F.col("load_run") < RUNS_PER_LOAD), "load_run", "feed/0")
    log.compact()
    log.append(feed.where(F.col("load_run") == RUNS_PER_LOAD), "feed/1")
    return log.current().select("id", "txn_ts", "start_time")


def p3_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """The same state with the event's title and end, after a compaction that forgets what is superseded."""
    feed = table(spark, folder, "event_versions")
    log = ChangeTable(
        spark, scratch_path(spark, "changes"), "id", "txn_ts", "is_deleted", ["start_time", "end_time", "title"], fan_in=RUNS_PER_LOAD
    )
    log.append_runs(feed.withColumn("load_run", F.pmod(F.coalesce("batch_no", F.lit(0)), F.lit(RUNS_PER_LOAD))), "load_run", "feed/0")
    log.compact(horizon=(feed.agg(F.max("txn_ts")).first()[0] or 0) + 1)
    return log.current().select("id", "txn_ts", "start_time", "end_time", "title")


_NEWEST_SQL = """
WITH v AS (SELECT id, txn_ts, start_time, end_time, title, coalesce(is_deleted, false) AS dead FROM event_versions
           WHERE id IS NOT NULL AND txn_ts IS NOT NULL),
     n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY txn_ts DESC, dead, start_time DESC NULLS LAST,
                  end_time DESC NULLS LAST, title DESC NULLS LAST) AS rn FROM v)
"""

# 5. Processing only new or changed records


def _states(records: DataFrame) -> DataFrame:
    change = F.greatest(micros(F.col("create_time")), micros(F.col("update_time")), micros(F.col("delete_time")))
    return records.select("id", change.alias("change_us"), "landed_at").where(F.col("change_us").isNotNull())


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    states = _states(table(spark, folder, "event_records"))
    mark = last_successful_mark(table(spark, folder, "sync_runs"))
    target = IncrementalTarget(spark, scratch_path(spark, "target"), ["id", "change_us"])
    read = states.where(F.col("landed_at") <= mark.scalar()).select("id", "change_us").distinct()
    target.publish(read, "replayed runs")
    return target.pending(states)


_STATE_SQL = """
WITH s AS (SELECT id, epoch_us(greatest(create_time, update_time, delete_time)) AS change_us, landed_at FROM event_records),
     a AS (SELECT run_no, attempt, arg_max(run_state, state_at) AS st, max(mark) AS mark FROM sync_runs GROUP BY 1, 2),
     m AS (SELECT max(mark) AS mark FROM a WHERE st = 'ok')
"""

# 6. Overlapping and gapped time intervals

ENTITY = ("type_code", "external_id")


def _resource_intervals(spark: SparkSession, folder: str) -> tuple:
    events = table(spark, folder, "event_records").select(
        F.col("resource.type_code").alias("type_code"), F.col("resource.external_id").alias("external_id"), "start_time", "end_time"
    )
    end = F.coalesce(F.col("end_time").cast("timestamp"), F.to_timestamp(F.lit(OPEN_END)))
    return events, ENTITY, micros(F.col("start_time")), micros(end)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return gaps(*_resource_intervals(spark, folder))


def p6_periods(spark: SparkSession, folder: str) -> DataFrame:
    return periods(*_resource_intervals(spark, folder))


_INTERVAL_SQL = f"""
WITH e AS (SELECT resource.type_code AS type_code, resource.external_id AS external_id, epoch_us(start_time) AS s,
                  epoch_us(coalesce(end_time, TIMESTAMP '{OPEN_END}')) AS e FROM event_records),
     u AS (SELECT DISTINCT * FROM e WHERE type_code IS NOT NULL AND external_id IS NOT NULL AND s IS NOT NULL AND e >= s),
     b AS (SELECT *, max(e) OVER (PARTITION BY type_code, external_id ORDER BY s, e
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u),
     n AS (SELECT *, sum(CASE WHEN before IS NULL OR before < s THEN 1 ELSE 0 END)
                  OVER (PARTITION BY type_code, external_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS no FROM b)
"""

# 7. Messages delivered more than once


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the initial dump carry serial ids and no update stamp: those are numbered, by the one source they come from; stamped ones have exact keys."""
    dump = table(spark, folder, "event_dump").select("id", "updated_at", "delivery_no")
    stamp = F.coalesce(F.col("updated_at"), F.lit(0))
    key = MessageKey(
        producer=F.when(stamp == 0, F.lit("initial")),
        number=F.col("id").cast("bigint"),
        exact=F.concat_ws(":", F.col("id").cast("string"), stamp.cast("string")),
        delivery=F.col("delivery_no"),
    )
    messages = dump.where(F.col("id").isNotNull())
    span = messages.agg(F.min("delivery_no").alias("lo"), F.max("delivery_no").alias("hi")).first()
    half = ((span.lo or 0) + (span.hi or 0)) // 2
    seen = SeenMessages(spark, scratch_path(spark, "seen"))
    early = seen.accept(messages.where(F.col("delivery_no") <= half), key, "dump/0")
    late = seen.accept(messages.where(F.col("delivery_no") > half), key, "dump/1")
    return early.unionByName(late).where(~F.col("kept")).select(F.col("delivery").alias("delivery_no"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_resource_stats, p1_type_rollup, p2_found, p2_orphan_report, p3_found, p3_compacted,
        p5_found, p6_found, p6_periods, p7_found,
    )
}

SQL = {
    "p1_found": f"""{_STATES_SQL} SELECT resource_type_code, resource_external_id FROM s
        WHERE resource_type_code IS NOT NULL AND resource_external_id IS NOT NULL
          AND event_rows * {HEAVY_ONE_IN} >= (SELECT count(*) FROM event_rows)""",
    "p1_resource_stats": f"""{_STATES_SQL} SELECT * EXCLUDE (pairs), CAST(pairs AS VARCHAR) AS pair_rows FROM s""",
    "p1_type_rollup": f"""{_STATES_SQL} SELECT resource_type_code, CAST(sum(event_rows) AS BIGINT) AS event_rows,
        CAST(sum(index_rows) AS BIGINT) AS index_rows, CAST(sum(pairs) AS VARCHAR) AS pair_rows, max(event_newest) AS newest
        FROM s GROUP BY 1""",
    "p2_found": f"""{_STAND_SQL} SELECT 'event_id_index' AS ref_table, m AS ref_month, id FROM i WHERE id NOT IN (SELECT id FROM r)
        UNION ALL SELECT 'event_rows', m, id FROM r WHERE id NOT IN (SELECT id FROM i)""",
    "p2_orphan_report": f"""{_STAND_SQL}, o AS (
        SELECT 'event_id_index' AS ref_table, m AS ref_month, 'direct' AS kind, id FROM i WHERE id NOT IN (SELECT id FROM r)
        UNION ALL SELECT 'event_rows', m, 'direct', id FROM r WHERE id NOT IN (SELECT id FROM i)
        UNION ALL SELECT 'event_versions', m, CASE WHEN id IN (SELECT id FROM r) THEN 'inherited' ELSE 'direct' END, id
                  FROM v WHERE id NOT IN (SELECT id FROM r SEMI JOIN i USING (id)))
        SELECT ref_table, ref_month, kind, count(*) AS n_ids FROM o GROUP BY ALL""",
    "p3_found": f"{_NEWEST_SQL} SELECT id, txn_ts, start_time FROM n WHERE rn = 1 AND NOT dead",
    "p3_compacted": f"{_NEWEST_SQL} SELECT id, txn_ts, start_time, end_time, title FROM n WHERE rn = 1 AND NOT dead",
    "p5_found": f"""{_STATE_SQL} SELECT id, change_us FROM s WHERE change_us IS NOT NULL GROUP BY 1, 2
        HAVING min(landed_at) > coalesce((SELECT mark FROM m), TIMESTAMP '0001-01-01')""",
    "p6_found": f"""{_INTERVAL_SQL} SELECT type_code, external_id, before AS gap_start_us, s AS gap_end_us FROM b WHERE before < s""",
    "p6_periods": f"""{_INTERVAL_SQL} SELECT type_code, external_id, CAST(no AS BIGINT) AS period_no, min(s) AS start_us,
        max(e) AS end_us FROM n GROUP BY 1, 2, 3""",
    "p7_found": """SELECT delivery_no FROM (SELECT delivery_no, row_number() OVER (PARTITION BY id, coalesce(updated_at, 0)
        ORDER BY delivery_no) AS rn FROM event_dump WHERE id IS NOT NULL) WHERE rn > 1""",
}
