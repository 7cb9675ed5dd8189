"""Every core query against DuckDB on the smallest data."""

import pathlib

import pytest

from tests.oracle import duck, spark_rows
from tidemark.plans import events, integers, problems, stores

FOLDER = "/root/testdata/sf0.001"
CORE = {name: (module.QUERIES[name], module.SQL.get(name)) for module in (events, integers, problems, stores) for name in module.QUERIES}

pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test data here")


@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    query, sql = CORE[name]
    df = query(spark, FOLDER)
    got = spark_rows(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython"))
    if sql:
        assert got == duck(FOLDER, sql)


def test_entry_lists_every_core_query(spark):
    import __spark_entry__

    assert set(CORE) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    import duckdb

    folder = tmp_path_factory.mktemp("empty")
    for path in pathlib.Path(FOLDER).glob("*.parquet"):
        duckdb.connect().execute(f"COPY (SELECT * FROM '{path}' LIMIT 0) TO '{folder}/{path.name}' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", [*problems.QUERIES, *stores.QUERIES, "list_and", "page_second", "update_start_time", "latency_stats", "int_avg", "etl_map", "initial_load"])
def test_empty_tables(spark, empty, name):
    query, sql = CORE[name]
    assert spark_rows(query(spark, empty)) == duck(empty, sql)


def scans(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]


def test_snapshot_key_and_columns_reach_the_scan(spark, tmp_path):
    from tidemark.operators.versions import state
    from tidemark.plans.fixture import version_log
    from tidemark.plans.listing import Request, matching

    version_log(spark, FOLDER).write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    (scan,) = scans(matching(log, Request('tags = "click"', as_of=3)).select("id"))
    assert "LessThanOrEqual(txn_ts,3)" in scan and "description" not in scan and "annotations" not in scan
    (scan,) = scans(state(log.where("id = 'x'"), 3))
    assert "EqualTo(id,x)" in scan
    plan = matching(log, Request())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
