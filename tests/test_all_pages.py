"""All pages at once are the pages that one gets from token to token, and cost no jobs of their own."""

import datetime as dt
import pathlib

import pytest

from tests.oracle import duck, spark_rows
from tests.test_versions import BASE, STEP, log, random_log
from tidemark.operators.versions import Snapshots, state
from tidemark.plans import stores
from tidemark.plans.cursor import decode
from tidemark.plans.listing import MAX_PAGE_SIZE, Request, all_pages, page
from tidemark.store import EventStore

FOLDER = "/root/testdata/sf0.001"


def walked(source, request):
    """(page, its token, ids) from token to token."""
    out, token = [], request.page_token
    while True:
        got = page(source, Request(request.filter, request.start, request.end, request.as_of, request.page_size, token))
        out.append((len(out), token, {r.id for r in got.rows}))
        token = got.next_page_token
        if not token:
            return out


def at_once(source, request):
    out = {}
    for r in all_pages(source, request).collect():
        out.setdefault((r.page, r.page_token), []).append(r.id)
    assert all(len(ids) == len(set(ids)) for ids in out.values())
    return sorted((*k, set(ids)) for k, ids in out.items())


@pytest.mark.parametrize("kept", [False, True])
def test_all_pages_are_those_of_a_walk(spark, tmp_path, kept):
    log(spark, random_log(53, n_ids=40, commits=14)).write.parquet(f"{tmp_path}/log")
    events = spark.read.parquet(f"{tmp_path}/log")
    source = Snapshots(events, state(events, 7), 7, events.where("txn_ts > 7"), 9) if kept else events
    for request in (Request(page_size=4), Request('-tags = "red"', BASE, BASE + 40 * STEP, 12, 3), Request(page_size=MAX_PAGE_SIZE)):
        assert at_once(source, request) == walked(source, request)
    third = walked(source, Request(page_size=4))[2][1]
    rest = Request(page_size=4, page_token=third)
    assert at_once(source, rest) == walked(source, rest) and decode(third).as_of == 14
    assert at_once(source, Request("", BASE - 9 * STEP, BASE - 8 * STEP, page_size=4)) == []
    for wrong in (0, MAX_PAGE_SIZE + 1, None):
        with pytest.raises(ValueError):
            all_pages(source, Request(page_size=wrong))


def test_keys_alike_in_start_and_without_one(spark):
    row = lambda id_, start: (id_, start, start, [], {}, 1, False)
    rows = [row(f"k{n:02}", BASE + dt.timedelta(microseconds=n // 9)) for n in range(27)]
    got = at_once(log(spark, [*rows, row("none", None)]), Request(page_size=4))
    assert got == walked(log(spark, rows), Request(page_size=4)) and len(got) == 7


@pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test data here")
def test_jobs_do_not_grow_with_the_pages(spark, monkeypatch):
    def jobs(size):
        monkeypatch.setattr(stores, "PAGE_SIZE", size)
        spark.sparkContext.setJobGroup(f"pages of {size}", "")
        got = spark_rows(stores.page_all_concat(spark, FOLDER))
        assert got == duck(FOLDER, stores.SQL["page_all_concat"]) and len(got[1]) > 100
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"pages of {size}"))

    try:
        assert jobs(2) <= jobs(1000) + 5
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_what_is_promoted_at_once_is_written_once(spark, tmp_path):
    store = EventStore(spark, f"{tmp_path}/s", level_limits=(3, 5, 100))
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(id as string) id", "cast(id as string) title")
    for lo, hi, levels in ((0, 2, (2, 0, 0)), (2, 9, (0, 0, 9)), (9, 12, (3, 0, 9)), (12, 13, (0, 4, 9)), (13, 17, (0, 0, 17))):
        before = store.create(rows(lo, hi), assign_ids=False)
        version = store.compact()
        assert tuple(store.statistics()["level_cardinalities"].values()) == (*levels, 0)
        assert version.number <= before + 2  # the parts folded, and the state renewed
        assert store.log().count() == store.events().count() == hi
