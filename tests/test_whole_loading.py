"""No id is lost in loading, whichever of its rows disagree or lack a service."""

import datetime as dt
import json
import pathlib

import pytest
from pyspark.sql import types as T

from tests.oracle import duck, spark_rows
from tidemark.__main__ import load
from tidemark.model import DUMP
from tidemark.plans.events import QUERIES, SQL
from tidemark.store import EventStore

FOLDER = "/root/testdata/sf0.001"
STORED = "resource_type_code string, resource_external_id string, start_time bigint, id string, event binary, written_at timestamp, removed_at timestamp"


def at(us):
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)


def stored(id_, start, title, tags="[]", removed=None):
    event = bytearray(f'{{"title":"{title}","sev":null,"tags":{tags}}}' if title else '{"title":"cut', "utf-8")
    return ("t", "x", start, id_, event, None, removed)


ROWS = [
    stored("later", 1, "old"), stored("later", 2, "new"),
    stored("title", 5, "a", '["z"]'), stored("title", 5, "b"), stored("title", 4, "c"),
    stored("tags", 5, "a", '["p"]'), stored("tags", 5, "a", '["q"]'), stored("tags", 5, "a", '["p","r"]'),
    stored("cut", 5, None), stored("cut", 5, "whole"),
    stored("gone", 9, "removed", removed=at(0)), stored("gone", 3, "left"),
    stored("same", 7, "s"), stored("same", 7, "s"), stored(None, 1, "n"),
]


@pytest.mark.parametrize("rows", [ROWS, ROWS[::-1]], ids=["forward", "backward"])
@pytest.mark.parametrize("parts", [1, 5])
def test_initial_load_resolves_ids_whose_rows_disagree(spark, tmp_path, rows, parts):
    spark.createDataFrame(rows, STORED).repartition(parts).write.parquet(f"{tmp_path}/event_rows.parquet")
    got = sorted((r.id, r.title, r.start_time, r.tags) for r in QUERIES["initial_load"](spark, str(tmp_path)).collect())
    assert got == [
        ("cut", "whole", at(5), ""), ("gone", "left", at(3), ""), ("later", "new", at(2), ""), ("same", "s", at(7), ""),
        ("tags", "a", at(5), "q"), ("title", "b", at(5), ""),
    ]


WHOLE = """SELECT id, title, start_time, array_to_string(tags, ',') AS tags FROM (SELECT *, row_number() OVER
    (PARTITION BY id ORDER BY start_time DESC NULLS LAST, title DESC NULLS LAST, tags DESC NULLS LAST) AS rn
    FROM (SELECT id, make_timestamp(start_time) AS start_time, json_extract_string(p, '$.title') AS title,
        CAST(json_extract(p, '$.tags') AS VARCHAR[]) AS tags
        FROM (SELECT *, CASE WHEN json_valid(decode(event)) THEN decode(event) END AS p FROM event_rows WHERE removed_at IS NULL AND id IS NOT NULL)))
    WHERE rn = 1"""


@pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test data here")
def test_initial_load_has_every_standing_id(spark):
    columns, rows = spark_rows(QUERIES["initial_load"](spark, FOLDER))
    assert (columns, rows) == duck(FOLDER, WHOLE)
    assert len(rows) == duck(FOLDER, "SELECT count(DISTINCT id) AS n FROM event_rows WHERE removed_at IS NULL")[1][0][0]
    # of the ids whose rows agree, nothing changes
    assert set(duck(FOLDER, SQL["initial_load"])[1]) <= set(rows)


def delivered(no, id_, service, title, start=60):
    return {
        "delivery_no": no, "id": id_, "title": title, "service_id": service, "start_time": start, "finish_time": start + 60, "created_at": no,
        "components": ["prod"], "resource_manager_entity": {"type": "team", "slug": "a"},
    }


DELIVERED = [
    delivered(1, 1, None, "no service"), delivered(2, 1, 7, "first with one"), delivered(3, 1, 8, "second with one"),
    delivered(4, 2, 7, "first"), delivered(5, 2, None, "none"), delivered(6, 3, None, "never"), delivered(7, None, 7, "no id"),
]
KEPT = [("1", "first with one"), ("2", "first")]


@pytest.mark.parametrize("rows", [DELIVERED, DELIVERED[::-1]], ids=["forward", "backward"])
def test_dedup_takes_the_first_copy_with_a_service(spark, tmp_path, rows):
    schema = T.StructType([T.StructField("delivery_no", T.LongType()), *DUMP.fields])
    full = [tuple(r.get(f.name) for f in schema) for r in rows]
    spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/event_dump.parquet")
    assert sorted((r.id, r.title) for r in QUERIES["etl_dedup_first"](spark, str(tmp_path)).collect()) == KEPT


def test_load_takes_the_first_copy_with_a_service(spark, tmp_path):
    (tmp_path / "dump.json").write_text("\n".join(json.dumps({k: v for k, v in r.items() if k != "delivery_no"}) for r in DELIVERED))
    store = EventStore(spark, f"{tmp_path}/store")
    assert load(spark, store, f"{tmp_path}/dump.json", "json", 2, "load")["events"] == 2
    assert {e.title for e in store.list(page_size=10).rows} == {title for _, title in KEPT}
