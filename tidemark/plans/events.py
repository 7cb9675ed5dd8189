"""Queries of the event engine: listing, snapshots, paging, keys, mutations, statistics, loading."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dump
from tidemark.functions.columns import micros
from tidemark.operators import measures, mutations
from tidemark.operators import versions as v
from tidemark.plans.cursor import PageToken, encode
from tidemark.plans.fixture import LOG_SQL, state_sql, version_log
from tidemark.plans.listing import Request, listed, matching
from tidemark.sources import rows as stored
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAY = lambda d, h=0: datetime.datetime(2024, 1, d, h)
START, END = DAY(10), DAY(15)
IN_RANGE = "start_time < TIMESTAMP '2024-01-15 00:00:01' AND end_time >= TIMESTAMP '2024-01-10'"
ORDER = "ORDER BY start_time DESC, id DESC"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def shown(events: DataFrame) -> DataFrame:
    """Events as scalars, so that results of both engines compare."""
    return events.select(
        "id",
        F.col("resource.external_id").alias("external_id"),
        "title",
        "start_time",
        "end_time",
        F.array_join(F.array_sort("tags"), ",").alias("tags"),
        F.element_at("annotations", F.lit("k")).alias("k"),
        "txn_ts",
    )


SHOWN = """id, external_id, title, start_time, end_time, array_to_string(list_sort(tags), ',') AS tags,
    annotations['k'] AS k, CAST(txn_ts AS BIGINT) AS txn_ts"""


def _listing(name: str, filter_text: str, sql: str, start=START, end=END, as_of=None, within: str = IN_RANGE) -> None:
    request = Request(filter_text, start, end, as_of)
    QUERIES[name] = lambda spark, folder: shown(listed(version_log(spark, folder), request))
    SQL[name] = f"{state_sql(as_of)} SELECT {SHOWN} FROM cur WHERE {within} AND ({sql}) {ORDER}"


CLICK, K42 = "list_contains(tags, 'click')", "coalesce(annotations['k'] = '42', false)"
SEG3 = "list_contains(tags, 'seg:3')"

# filters: F4 to F10, F12
_listing("list_tag", 'tags = "click"', CLICK)
_listing("list_tag_has", 'tags:"click"', CLICK)
_listing("list_annotation", 'annotations.k = "42"', K42)
_listing("list_quoted_key", 'annotations."k" = "42"', K42)
_listing("list_and", 'tags = "click" AND annotations.k = "42"', f"{CLICK} AND {K42}")
_listing("list_implicit_and", 'tags = "click" tags = "seg:3"', f"{CLICK} AND {SEG3}")
_listing("list_or", 'tags = "click" OR tags = "retagged"', f"{CLICK} OR list_contains(tags, 'retagged')")
_listing("list_not", 'NOT tags = "click"', f"NOT {CLICK}")
_listing("list_neg_dash", '-tags = "click"', f"NOT {CLICK}")
_listing("list_not_equal", 'tags != "click"', f"NOT {CLICK}")
_listing("list_not_missing_key", 'NOT annotations.zz = "v"', "NOT coalesce(annotations['zz'] = 'v', false)")
_listing("list_precedence", 'tags = "seg:3" tags = "click" OR tags = "view"', f"{SEG3} AND ({CLICK} OR list_contains(tags, 'view'))")
_listing(
    "list_group",
    '(tags = "click" AND annotations.k = "42") OR (tags = "view" AND NOT tags = "seg:3")',
    f"({CLICK} AND {K42}) OR (list_contains(tags, 'view') AND NOT {SEG3})",
)
_listing("list_empty_filter", " ", "true")
_listing("list_unescaped", r'annotations.k = "\x342"', K42)

# time range: F13
_listing("list_time_overlap", "", "true", DAY(12), DAY(12, 6), within="start_time < TIMESTAMP '2024-01-12 06:00:01' AND end_time >= TIMESTAMP '2024-01-12'")
_listing("list_overlap_instant", "", "true", DAY(12), DAY(12), within="start_time < TIMESTAMP '2024-01-12 00:00:01' AND end_time >= TIMESTAMP '2024-01-12'")
_EDGE = datetime.datetime(2024, 1, 12, 3, 4, 5, 999999)
_listing(
    "list_overlap_second_edge", "", "true", _EDGE, _EDGE,
    within="date_trunc('second', start_time) <= TIMESTAMP '2024-01-12 03:04:05' AND date_trunc('second', end_time) >= TIMESTAMP '2024-01-12 03:04:05'",
)
_listing("list_unbounded", 'tags = "signup"', "list_contains(tags, 'signup')", None, None, within="true")

# snapshots: F14 to F16
for _n in (1, 2, 3, 4):
    _listing(f"list_as_of_{_n}", '(tags = "click" OR tags = "retagged") AND tags = "seg:3"', f"({CLICK} OR list_contains(tags, 'retagged')) AND {SEG3}", as_of=_n)
_listing("list_retagged_old_filter", 'tags = "retagged"', "list_contains(tags, 'retagged')", as_of=2)


@query(
    "list_deleted_hidden",
    f"{state_sql()} SELECT id FROM log WHERE txn_ts = 4 AND id IN (SELECT id FROM cur)",
)
def list_deleted_hidden(spark, folder):
    """Ids deleted at the last commit that a listing still shows: none."""
    log = version_log(spark, folder)
    gone = log.where(F.col("txn_ts") == 4).select("id")
    return gone.join(matching(log, Request()).select("id"), "id", "left_semi")


@query(
    "list_moved_start",
    f"{state_sql(3)} SELECT {SHOWN} FROM cur WHERE txn_ts = 3",
)
def list_moved_start(spark, folder):
    return shown(matching(version_log(spark, folder), Request(as_of=3)).where(F.col("txn_ts") == 3))


# paging: O1, O4 to O7

PAGE = 25
_PAGED = f"{state_sql(4)} SELECT {SHOWN} FROM cur WHERE {IN_RANGE} AND {CLICK} {ORDER} LIMIT {PAGE}"
FIRST = Request('tags = "click"', START, END, 4, PAGE)


@query("page_first", _PAGED)
def page_first(spark, folder):
    return shown(listed(version_log(spark, folder), FIRST))


@query("page_second", f"{_PAGED} OFFSET {PAGE}")
def page_second(spark, folder):
    """The page whose token is the row after the first page."""
    log = version_log(spark, folder)
    ahead = listed(log, Request(FIRST.filter, START, END, 4, PAGE + 1)).select("id", "start_time").tail(1)
    if not ahead:
        return shown(listed(log, FIRST)).where(F.lit(False))
    us = (ahead[0].start_time - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    token = encode(PageToken("user", "", us, ahead[0].id, 4))
    return shown(listed(log, Request(FIRST.filter, START, END, None, PAGE, token)))


@query("keyset_resume", f"{state_sql(4)} SELECT {SHOWN} FROM cur WHERE start_time < TIMESTAMP '2024-01-12' OR (start_time = TIMESTAMP '2024-01-12' AND id <= 'x')")
def keyset_resume(spark, folder):
    return shown(v.state(version_log(spark, folder), 4).where(v.at_or_after(DAY(12), "x")))


# keys: S4, J2 to J5, U1, U3, P1


@query("lookup_by_ids", f"{state_sql(3)} SELECT {SHOWN} FROM cur WHERE id IN ('000000000013', '000000000026', '000000000700', 'none')")
def lookup_by_ids(spark, folder):
    log = version_log(spark, folder).where(F.col("id").isin("000000000013", "000000000026", "000000000700", "none"))
    return shown(v.state(log, 3))


@query("key_projection", f"WITH {LOG_SQL} SELECT 'user' AS type_code, external_id, epoch_us(start_time) AS start_us, id, CAST(txn_ts AS BIGINT) AS txn_ts, is_deleted FROM log")
def key_projection(spark, folder):
    return version_log(spark, folder).select(
        "resource.type_code", "resource.external_id", micros(F.col("start_time")).alias("start_us"), "id", "txn_ts", "is_deleted"
    )


def _postings(spark, folder, tag: str) -> DataFrame:
    return v.state(version_log(spark, folder)).where(F.array_contains("tags", tag)).select("id")


def _posting_sql(tag: str) -> str:
    return f"SELECT id FROM cur WHERE list_contains(tags, '{tag}')"


@query("semi_join_keys", f"{state_sql()} SELECT id FROM cur WHERE {CLICK} AND id IN ({_posting_sql('seg:3')})")
def semi_join_keys(spark, folder):
    return _postings(spark, folder, "click").join(_postings(spark, folder, "seg:3"), "id", "left_semi")


@query("anti_join_keys", f"{state_sql()} SELECT id FROM cur WHERE {CLICK} AND id NOT IN ({_posting_sql('seg:3')})")
def anti_join_keys(spark, folder):
    return _postings(spark, folder, "click").join(_postings(spark, folder, "seg:3"), "id", "left_anti")


@query("set_union_postings", f"{state_sql()} {_posting_sql('click')} UNION {_posting_sql('seg:3')}")
def set_union_postings(spark, folder):
    return _postings(spark, folder, "click").union(_postings(spark, folder, "seg:3")).distinct()


@query("set_intersect_postings", f"{state_sql()} {_posting_sql('click')} INTERSECT {_posting_sql('seg:3')}")
def set_intersect_postings(spark, folder):
    return _postings(spark, folder, "click").intersect(_postings(spark, folder, "seg:3"))


@query("set_except_postings", f"{state_sql()} {_posting_sql('click')} EXCEPT {_posting_sql('seg:3')}")
def set_except_postings(spark, folder):
    return _postings(spark, folder, "click").subtract(_postings(spark, folder, "seg:3"))


@query("payload_join", f"{state_sql()} SELECT id, description FROM cur WHERE {K42}")
def payload_join(spark, folder):
    """Keys from the filter, payload by key; keys without a payload are dropped."""
    log = version_log(spark, folder)
    keys = matching(log, Request('annotations.k = "42"')).select("id", "txn_ts")
    rows = log.where(~F.col("is_deleted")).select("id", "txn_ts", "description")
    return keys.join(rows, ["id", "txn_ts"]).select("id", "description")


@query("merge_runs", f"{state_sql()} SELECT id, CAST(txn_ts AS BIGINT) AS txn_ts FROM cur")
def merge_runs(spark, folder):
    """Runs of the log with overlapping contents, merged: each version counts once."""
    log = version_log(spark, folder)
    runs = log.where(F.col("txn_ts") <= 2).unionByName(log.where(F.col("txn_ts") >= 2)).unionByName(log.where(F.col("txn_ts") == 4))
    return v.state(runs).select("id", "txn_ts")


# mutations: M1 to M3, P4

_VERSION = "id, title, start_time, array_to_string(tags, ',') AS tags, CAST(txn_ts AS BIGINT) AS txn_ts, is_deleted"


def _version(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "start_time", F.array_join("tags", ",").alias("tags"), "txn_ts", "is_deleted")


@query("create_batch", f"WITH {LOG_SQL} SELECT id, title, start_time, array_to_string(tags, ',') AS tags, CAST(5 AS BIGINT) AS txn_ts, false AS is_deleted FROM log WHERE txn_ts = 1")
def create_batch(spark, folder):
    rows = version_log(spark, folder).where(F.col("txn_ts") == 1).drop("txn_ts", "is_deleted")
    return _version(mutations.created(rows, 5))


def _changes(spark, folder) -> DataFrame:
    picked = table(spark, folder, "events").where(F.col("event_type") == "purchase")
    return picked.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("paid "), F.col("event_id").cast("string")).alias("title"),
        (F.col("ts") + F.expr("INTERVAL 2 HOUR")).alias("start_time"),
        F.array(F.lit("paid")).alias("tags"),
    )


_CHANGED = """chg AS (SELECT id, 'paid ' || event_id AS new_title, ts + INTERVAL 2 HOUR AS new_start FROM b WHERE event_type = 'purchase')"""


@query("update_masked", f"{state_sql()}, {_CHANGED} SELECT id, new_title AS title, start_time, 'paid' AS tags, CAST(5 AS BIGINT) AS txn_ts, false AS is_deleted FROM cur JOIN chg USING (id)")
def update_masked(spark, folder):
    return _version(mutations.updated(version_log(spark, folder), _changes(spark, folder), ["title", "tags", "resource"], 5))


@query(
    "update_start_time",
    f"""{state_sql()}, {_CHANGED} SELECT id, title, new_start AS start_time, array_to_string(tags, ',') AS tags,
        CAST(5 AS BIGINT) AS txn_ts, false AS is_deleted FROM cur JOIN chg USING (id)
        UNION ALL SELECT id, NULL, start_time, NULL, 5, true FROM cur JOIN chg USING (id) WHERE start_time <> new_start""",
)
def update_start_time(spark, folder):
    return _version(mutations.updated(version_log(spark, folder), _changes(spark, folder), ["start_time"], 5))


@query("delete_events", f"{state_sql()}, {_CHANGED} SELECT id, NULL::VARCHAR AS title, start_time, NULL::VARCHAR AS tags, CAST(5 AS BIGINT) AS txn_ts, true AS is_deleted FROM cur SEMI JOIN chg USING (id)")
def delete_events(spark, folder):
    return _version(mutations.deleted(version_log(spark, folder), _changes(spark, folder).select("id"), 5))


# statistics: A9 to A12, O2


@query(
    "postings_view",
    f"""{state_sql()} SELECT DISTINCT NULL::VARCHAR AS key, tag AS value, id FROM cur, unnest(tags) AS u(tag)
        UNION ALL SELECT e.key, e.value, id FROM (SELECT id, unnest(map_entries(annotations)) AS e FROM cur)""",
)
def postings_view(spark, folder):
    return measures.postings(v.state(version_log(spark, folder)))


@query("posting_cardinality_tags", f"{state_sql()} SELECT tag, count(DISTINCT id) AS n_events FROM cur, unnest(tags) AS u(tag) GROUP BY 1")
def posting_cardinality_tags(spark, folder):
    return measures.tag_cardinalities(v.state(version_log(spark, folder)))


@query("posting_cardinality_annotations", f"{state_sql()} SELECT e.key AS key, e.value AS value, count(*) AS n_events FROM (SELECT unnest(map_entries(annotations)) AS e FROM cur) GROUP BY 1, 2")
def posting_cardinality_annotations(spark, folder):
    return measures.annotation_cardinalities(v.state(version_log(spark, folder)))


@query("segment_stats", f"WITH {LOG_SQL} SELECT CAST(txn_ts AS BIGINT) AS txn_ts, count(*) AS n_versions FROM log GROUP BY 1")
def segment_stats(spark, folder):
    return measures.level_statistics(version_log(spark, folder), "txn_ts")


@query(
    "latency_stats",
    """WITH s AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem
                  WHERE l_extendedprice IS NOT NULL)
       SELECT count(*) AS n_requests, min(x) AS least, avg(x) AS mean, max(x) AS greatest, max(x) FILTER (i = n * 50 // 100) AS p50,
              max(x) FILTER (i = n * 95 // 100) AS p95, max(x) FILTER (i = n * 99 // 100) AS p99 FROM s""",
)
def latency_stats(spark, folder):
    return measures.load_statistics(table(spark, folder, "lineitem"), "l_extendedprice")


@query("throughput_2s", "SELECT time_bucket(INTERVAL 2 SECONDS, ts) AS tick, count(*) / 2 AS per_second FROM events GROUP BY 1")
def throughput_2s(spark, folder):
    return measures.throughput(table(spark, folder, "events"), F.col("ts"))


# loading: E1 to E8, U4

_DUMP_SQL = """
SELECT coalesce(CAST(id AS VARCHAR), '<nil>') AS id, coalesce(title, '<nil>') AS title, coalesce(description, '<nil>') AS description,
    CASE resource_manager_entity.type WHEN 'application' THEN 'abc_application' WHEN 'product' THEN 'idp_product' WHEN 'team' THEN 'team' END AS type_code,
    resource_manager_entity.slug AS external_id, make_timestamp(start_time::BIGINT * 1000000) AS start_time,
    coalesce(make_timestamp(finish_time::BIGINT * 1000000), TIMESTAMP '2105-12-31 23:59:59') AS end_time,
    array_to_string(list_filter(list_concat(coalesce(components, []), list_transform(coalesce(dcs, []), lambda d: 'dc:' || d)),
        lambda t: t IS NOT NULL), ',') AS tags,
    CAST(service_id AS VARCHAR) AS service_id,
    CAST(CASE WHEN coalesce(created_at, 0) = 0 THEN TIMESTAMP '2105-12-31 23:59:59' ELSE make_timestamp(created_at) END AS VARCHAR) || ' +0000 UTC' AS created_at
FROM {} WHERE service_id IS NOT NULL"""


def mapped_sql(source: str) -> str:
    return _DUMP_SQL.format(source)


def mapped_scalars(rows: DataFrame) -> DataFrame:
    note = lambda k: F.element_at("annotations", F.lit(k)).alias(k)
    return dump.mapped(rows, strict=False).select(
        "id", "title", "description", "resource.type_code", "resource.external_id", "start_time", "end_time",
        F.array_join("tags", ",").alias("tags"), note("service_id"), note("created_at"),
    )


@query("etl_map", mapped_sql("event_dump"))
def etl_map(spark, folder):
    return mapped_scalars(table(spark, folder, "event_dump"))


@query(
    "etl_dedup_first",
    mapped_sql(
        "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY delivery_no) AS rn FROM event_dump WHERE id IS NOT NULL) WHERE rn = 1)"
    ),
)
def etl_dedup_first(spark, folder):
    return mapped_scalars(dump.first_seen(dump.with_service(table(spark, folder, "event_dump")), "id", "delivery_no"))


@query("etl_json_lists", """SELECT delivery_no, CAST(to_json(tickets) AS VARCHAR) AS tickets FROM event_dump""")
def etl_json_lists(spark, folder):
    return table(spark, folder, "event_dump").select("delivery_no", dump.as_json(F.col("tickets")).alias("tickets"))


# stored rows: S3, S10

_PAYLOAD_SQL = "CASE WHEN json_valid(decode(event)) THEN decode(event) END"


@query(
    "stored_payloads",
    f"""SELECT id, start_time, json_extract_string(p, '$.title') AS title, json_extract_string(p, '$.sev') AS sev,
        array_to_string(CAST(json_extract(p, '$.tags') AS VARCHAR[]), ',') AS tags FROM (SELECT *, {_PAYLOAD_SQL} AS p FROM event_rows)""",
)
def stored_payloads(spark, folder):
    """Payloads of all stored rows; null where it is missing or cut off."""
    rows = table(spark, folder, "event_rows").select("id", "start_time", stored.decoded(F.col("event")).alias("p"))
    return rows.select("id", "start_time", "p.title", "p.sev", F.array_join("p.tags", ",").alias("tags"))


@query("stored_roundtrip", f"SELECT id, start_time, {_PAYLOAD_SQL} AS payload FROM event_rows")
def stored_roundtrip(spark, folder):
    """Payloads decoded and encoded again, as text."""
    again = stored.encoded(stored.decoded(F.col("event"))).cast("string")
    return table(spark, folder, "event_rows").select("id", "start_time", again.alias("payload"))


@query(
    "initial_load",
    f"""SELECT id, title, start_time, tags FROM (SELECT id, json_extract_string(p, '$.title') AS title, make_timestamp(start_time) AS start_time,
        array_to_string(CAST(json_extract(p, '$.tags') AS VARCHAR[]), ',') AS tags,
        row_number() OVER (PARTITION BY id ORDER BY start_time DESC NULLS LAST, json_extract_string(p, '$.title') DESC NULLS LAST,
            CAST(json_extract(p, '$.tags') AS VARCHAR[]) DESC NULLS LAST) AS rn
        FROM (SELECT *, {_PAYLOAD_SQL} AS p FROM event_rows WHERE removed_at IS NULL AND id IS NOT NULL)) WHERE rn = 1""",
)
def initial_load(spark, folder):
    """The log of stored rows, resolved: every id that stands, at its latest start; ties go to the greater title, then tags."""
    state = v.state(stored.as_initial_log(table(spark, folder, "event_rows")), ties=("title", "tags"))
    return state.select("id", "title", "start_time", F.array_join("tags", ",").alias("tags"))
