"""A deterministic version log made from the table ``events``, in Spark and in SQL.

Every event is created at commit 1. At 2 every seventh is retagged; at 3 every
thirteenth is moved by an hour, which leaves a tombstone at the old start; at 4
every eleventh is deleted. One pass over the table makes all versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table


CREATED, RETAGGED, MOVED, LEFT, DELETED = range(5)
COMMIT = (1, 2, 3, 3, 4)


def version_log(spark: SparkSession, folder: str) -> DataFrame:
    e, kind = F.col("event_id"), F.col("kind")
    none = F.array().cast("array<int>")
    kinds = F.concat(
        F.array(F.lit(CREATED)),
        F.when(e % 7 == 0, F.array(F.lit(RETAGGED))).otherwise(none),
        F.when(e % 13 == 0, F.array(F.lit(MOVED), F.lit(LEFT))).otherwise(none),
        F.when(e % 11 == 0, F.array(F.lit(DELETED))).otherwise(none),
    )
    alive = ~kind.isin(LEFT, DELETED)
    shifted = (kind == MOVED) | ((kind == DELETED) & (e % 13 == 0))
    start = F.when(shifted, F.timestamp_add("HOUR", F.lit(1), F.col("ts"))).otherwise(F.col("ts"))
    first_tag = F.when(kind == RETAGGED, "retagged").otherwise(F.col("event_type"))
    segment = F.concat(F.lit("seg:"), (F.col("user_id") % 10).cast("string"))
    commit = F.element_at(F.array(*[F.lit(c).cast("bigint") for c in COMMIT]), kind + 1)
    return (
        table(spark, folder, "events")
        .withColumn("k", F.get_json_object("props", "$.k"))
        .withColumn("kind", F.explode(kinds))
        .select(
            F.lpad(e.cast("string"), 12, "0").alias("id"),
            F.concat(F.lit("event "), e.cast("string")).alias("title"),
            F.col("props").alias("description"),
            F.struct(F.lit("user").alias("type_code"), F.col("user_id").cast("string").alias("external_id")).alias("resource"),
            start.alias("start_time"),
            F.when(alive, F.timestamp_add("MINUTE", F.floor("value").cast("int"), start)).alias("end_time"),
            F.when(alive, F.array(first_tag, segment)).alias("tags"),
            F.when(alive, F.create_map(F.lit("k"), F.col("k"), F.lit("type"), F.col("event_type"))).alias("annotations"),
            commit.alias("txn_ts"),
            (~alive).alias("is_deleted"),
        )
    )


def _row(txn: int, where: str, start: str, tag: str | None) -> str:
    payload = (
        f"[{tag}, 'seg:' || (user_id % 10)] AS tags, MAP {{'k': k, 'type': event_type}} AS annotations, "
        f"{start} + to_minutes(CAST(floor(value) AS BIGINT)) AS end_time"
        if tag
        else "NULL AS tags, NULL AS annotations, NULL AS end_time"
    )
    return f"SELECT id, title, description, external_id, {start} AS start_time, {payload}, {txn} AS txn_ts, {tag is None} AS is_deleted FROM b WHERE {where}"


LOG_SQL = f"""
b AS (SELECT *, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, json_extract_string(props, '$.k') AS k, 'event ' || event_id AS title,
             props AS description, CAST(user_id AS VARCHAR) AS external_id FROM events),
log AS ({" UNION ALL ".join((
    _row(1, "true", "ts", "event_type"),
    _row(2, "event_id % 7 = 0", "ts", "'retagged'"),
    _row(3, "event_id % 13 = 0", "ts + INTERVAL 1 HOUR", "event_type"),
    _row(3, "event_id % 13 = 0", "ts", None),
    _row(4, "event_id % 11 = 0", "CASE WHEN event_id % 13 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END", None),
))})
"""


def state_sql(as_of: int | None = None) -> str:
    """CTEs ending in ``cur``, the resolved live events."""
    seen = f"WHERE txn_ts <= {as_of}" if as_of is not None else ""
    return f"""WITH {LOG_SQL}, cur AS (SELECT * FROM (SELECT *, row_number() OVER
        (PARTITION BY id ORDER BY txn_ts DESC, is_deleted) AS rn FROM log {seen}) WHERE rn = 1 AND NOT is_deleted)"""
