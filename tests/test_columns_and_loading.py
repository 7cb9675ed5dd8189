"""Integer columns, statistics, and the mapping of dump rows."""

import datetime as dt
import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tidemark.functions import dump
from tidemark.model import DUMP
from tidemark.operators import intcolumn as ic
from tidemark.operators.measures import load_statistics, nearest_ranks, throughput


COLUMN = {row: random.Random(row).choice([None, -(2**62), 2**62, *range(-9, 10)]) for row in range(0, 120, 2)}
PICKED = [row for row in range(0, 140, 6)]


@pytest.fixture(scope="module")
def column(spark):
    return spark.createDataFrame(list(COLUMN.items()), "row bigint, value bigint").coalesce(2).cache()


@pytest.fixture(scope="module")
def picked(spark):
    return spark.createDataFrame([(row,) for row in [*PICKED, PICKED[3], None]], "row bigint").coalesce(1)


def as_dict(df):
    got = df.collect()
    assert len({r.row for r in got}) == len(got)
    return {r.row: r.value for r in got}


@pytest.mark.parametrize("bound", [-4, 0, 7, 2**62])
def test_comparisons(column, picked, bound):
    tests = {ic.LT: lambda x: x < bound, ic.LE: lambda x: x <= bound, ic.EQ: lambda x: x == bound, ic.GE: lambda x: x >= bound, ic.GT: lambda x: x > bound}
    for op, holds in tests.items():
        want = {k: x for k, x in COLUMN.items() if x is not None and holds(x)}
        assert as_dict(ic.select_rows(column, "value", op, bound)) == want
    within = ic.select_rows(column, "value", ic.RANGE, -5, bound, within=picked, key="row")
    assert as_dict(within) == {k: x for k, x in COLUMN.items() if x is not None and -5 <= x <= bound and k in PICKED}
    assert as_dict(ic.in_values(column, "value", [bound, 3])) == {k: x for k, x in COLUMN.items() if x in (bound, 3)}


def test_what_is_no_comparison(column):
    assert ic.in_values(column, "value", []).isEmpty()
    for op in ("NE", ic.RANGE):
        with pytest.raises(ValueError):
            ic.compares(F.col("value"), op, 1)


def test_aggregates(column):
    some = {k: x for k, x in COLUMN.items() if x is not None and abs(x) < 100}
    small = ic.select_rows(column, "value", ic.RANGE, -99, 99)
    assert tuple(ic.sum_and_count(small, "value").first()) == (sum(some.values()), len(some))
    assert ic.average(small, "value").first().mean == pytest.approx(sum(some.values()) / len(some))
    assert tuple(ic.min_and_max(column, "value").first()) == (-(2**62), 2**62)
    counts = {r.value: r.n_rows for r in ic.value_counts(column, "value").collect()}
    assert counts == {x: sum(y == x for y in COLUMN.values()) for x in set(COLUMN.values()) - {None}}
    assert {r.value for r in ic.distinct_values(column, "value").collect()} == set(counts)
    none = column.limit(0)
    assert tuple(ic.sum_and_count(none, "value").first()) == (None, 0) and ic.average(none, "value").first().mean is None
    assert tuple(ic.min_and_max(none, "value").first()) == (None, None)


def test_sets_of_rows(column, picked):
    assert as_dict(ic.retain(column, picked, "row")) == {k: x for k, x in COLUMN.items() if k in PICKED}
    assert as_dict(ic.clear(column, picked, "row")) == {k: x for k, x in COLUMN.items() if k not in PICKED}
    assert as_dict(ic.set_values(column, picked, "row", "value", 77)) == {**COLUMN, **dict.fromkeys(PICKED, 77)}
    odd = column.selectExpr("row + 1 AS row", "value")
    assert as_dict(ic.concatenated(column, odd)) == {**COLUMN, **{k + 1: x for k, x in COLUMN.items()}}
    for row, value in list(COLUMN.items())[:9]:
        assert [r.value for r in ic.value_of(column, "row", row, "value").collect()] == [value] * (value is not None)


def test_arithmetic(column, picked):
    filled = {k: x for k, x in COLUMN.items() if x is not None}
    small = {k: x for k, x in filled.items() if x < 5}
    sums = as_dict(ic.added(column, ic.select_rows(column, "value", ic.LT, 5), "row", "value"))
    assert sums == {k: x + small.get(k, 0) for k, x in filled.items()}
    assert as_dict(ic.incremented(column, "row", "value", by=3)) == {k: None if x is None else x + 3 for k, x in COLUMN.items()}
    assert as_dict(ic.incremented(column, "row", "value", picked)) == {k: None if x is None else x + (k in PICKED) for k, x in COLUMN.items()}


@pytest.mark.parametrize("n", [1, 2, 99, 100, 1000])
def test_nearest_ranks(spark, n):
    r = random.Random(n)
    values = [float(r.choice([1, 2, 3, r.randrange(1000)])) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    ordered = sorted(values)
    got = nearest_ranks(df, "x", {"a": 0, "b": 50, "c": 95, "d": 99, "e": 100}).first()
    assert list(got) == [ordered[min(n - 1, n * p // 100)] for p in (0, 50, 95, 99, 100)]
    assert load_statistics(df, "x").first().asDict()["mean"] == pytest.approx(sum(values) / n)
    assert load_statistics(df.limit(0), "x").first().asDict() == dict.fromkeys(("least", "mean", "greatest", "p50", "p95", "p99")) | {"n_requests": 0}


def test_throughput(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, s),) for s in (0, 1, 1, 2, 7)], "at timestamp")
    assert [r.per_second for r in throughput(df, F.col("at")).orderBy("tick").collect()] == [1.5, 0.5, 0.5]


def dump_row(**given):
    return tuple(given.get(f.name) for f in DUMP)


def test_mapping(spark):
    entity = ("application", "app")
    full = dump_row(id=1, title="t", service_id=7, start_time=60, finish_time=120, components=["c", None], dcs=["d"], created_at=1_500_000, resource_manager_entity=entity)
    bare = dump_row(service_id=8, start_time=0, created_at=0, resource_manager_entity=("team", None))
    got = dump.mapped(spark.createDataFrame([full, bare, dump_row(id=3)], DUMP)).collect()
    assert [r.id for r in got] == ["1", "<nil>"]
    assert (got[0].tags, got[0].resource.type_code, got[0].end_time) == (["c", "dc:d"], "abc_application", dt.datetime(1970, 1, 1, 0, 2))
    assert got[0].annotations == {"resource_type_code": "abc_application", "resource_external_id": "app", "service_id": "7", "created_at": "1970-01-01 00:00:01.5 +0000 UTC"}
    assert (got[1].title, got[1].tags, got[1].end_time) == ("<nil>", [], dt.datetime(2105, 12, 31, 23, 59, 59))
    assert got[1].annotations["created_at"].startswith("2105-12-31 23:59:59")


def test_an_unknown_resource_type_fails_or_is_null(spark):
    rows = spark.createDataFrame([dump_row(service_id=1, start_time=0, resource_manager_entity=("other", "x"))], DUMP)
    with pytest.raises(SparkRuntimeException, match="unknown resource type: other"):
        dump.mapped(rows).collect()
    assert dump.mapped(rows, strict=False).first().resource.type_code is None


def test_first_seen(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (None, 1, "x"), (2, 9, "c")], "id int, at int, v string")
    assert sorted((r.id, r.v) for r in dump.first_seen(df, "id", "at").collect()) == [(1, "a"), (2, "c")]
