"""Snapshots, order, resuming and overlap on random small logs, against a plain reading of the rules."""

import datetime as dt
import random

import pytest

from tidemark.model import VERSION
from tidemark.operators import versions as v
from tidemark.operators.versions import Snapshots, state
from tidemark.plans.cursor import PageToken, encode
from tidemark.plans.listing import MAX_PAGE_SIZE, Request, listed, matching, page

BASE = dt.datetime(2031, 3, 9, 7, 30, 0, 600000)
STEP = dt.timedelta(milliseconds=400)
TAGS = ["red", "green", "blue"]


def random_log(seed, n_ids=14, commits=9):
    """(id, start, end, tags, annotations, txn, dead) as commits of creates, retags, moves and deletes."""
    r = random.Random(seed)
    rows, now = [], {}
    for txn in range(1, commits + 1):
        for id_ in r.sample([f"k{i:02}" for i in range(n_ids)], 5):
            old = now.get(id_)
            kind = r.choice(["put", "put", "move", "drop"])
            if kind == "drop" and old:
                rows.append((id_, old[0], None, None, None, txn, True))
                now.pop(id_)
                continue
            start = old[0] if old and kind == "put" else BASE + r.randrange(60) * STEP
            fresh = (start, start + r.randrange(8) * STEP, r.choices(TAGS, k=r.randrange(3)), {"size": r.choice("sml")})
            if old and old[0] != start:
                rows.append((id_, old[0], None, None, None, txn, True))
            rows.append((id_, *fresh, txn, False))
            now[id_] = fresh
    r.shuffle(rows)
    return rows


def plain_state(rows, as_of=None):
    best = {}
    for row in rows:
        if as_of is None or row[5] <= as_of:
            rank = (row[5], not row[6])
            if row[0] not in best or rank > best[row[0]][0]:
                best[row[0]] = (rank, row)
    return [row for _, row in best.values() if not row[6]]


def plain_list(rows, as_of=None, keep=lambda row: True):
    found = [row for row in plain_state(rows, as_of) if keep(row)]
    return [(row[0], row[5]) for row in sorted(found, key=lambda row: (row[1], row[0]), reverse=True)]


def log(spark, rows):
    full = [{"id": i, "resource": ("t", "x"), "start_time": s, "end_time": e, "tags": t, "annotations": a, "txn_ts": n, "is_deleted": d} for i, s, e, t, a, n, d in rows]
    return spark.createDataFrame([tuple(row.get(f.name) for f in VERSION) for row in full], VERSION).coalesce(2)


def keys(df):
    return [(r.id, r.txn_ts) for r in df.collect()]


@pytest.mark.parametrize("as_of", [None, 0, 1, 4, 9, 99])
def test_snapshots(spark, as_of):
    rows = random_log(11)
    assert keys(listed(log(spark, rows), Request(as_of=as_of))) == plain_list(rows, as_of)
    blue = lambda row: "blue" in row[3] and row[4]["size"] != "s"
    assert keys(listed(log(spark, rows), Request('tags = "blue" -annotations.size = "s"', as_of=as_of))) == plain_list(rows, as_of, blue)


@pytest.mark.parametrize("at", [0, 3, 9])
def test_a_kept_state_changes_nothing(spark, tmp_path, at):
    """The state kept as of any commit, and what came since, give what the whole log gives."""
    rows = random_log(23)
    whole = log(spark, rows)
    kept = state(whole, at)
    later = whole.where(whole.txn_ts > at)
    for n in (0, 10**9):  # changed ids broadcast, and joined by shuffle
        both = Snapshots(whole, kept, at, later, n)
        for as_of in (None, 1, at, 6):
            assert keys(listed(both, Request(as_of=as_of))) == plain_list(rows, as_of)
    assert keys(listed(Snapshots(whole, state(whole), 9), Request())) == plain_list(rows)


def test_an_old_version_does_not_answer_for_a_new_one(spark):
    first = ("one", BASE, BASE + STEP, ["red"], {}, 1, False)
    again = ("one", BASE, BASE + STEP, ["green"], {}, 2, False)
    assert keys(listed(log(spark, [first, again]), Request('tags = "red"'))) == []
    assert keys(listed(log(spark, [first, again]), Request('tags = "red"', as_of=1))) == [("one", 1)]


def test_overlap_in_whole_seconds(spark):
    rows, r = random_log(31), random.Random(5)
    second = lambda at: at.replace(microsecond=0)
    events = log(spark, rows).cache()
    for _ in range(6):
        low, high = (r.choice([None, BASE + r.randrange(70) * STEP]) for _ in range(2))
        want = plain_list(rows, None, lambda x: (high is None or second(x[1]) <= second(high)) and (low is None or second(x[2]) >= second(low)))
        assert keys(listed(events, Request("", low, high))) == want
    events.unpersist()
    hole = [("none", None, None, [], {}, 1, False)]
    assert keys(listed(log(spark, hole), Request("", BASE, None))) == keys(listed(log(spark, hole), Request("", None, BASE))) == []


def test_resuming_is_inclusive(spark):
    rows = random_log(47)
    whole = plain_list(rows, 8)
    starts = {row[0]: row[1] for row in plain_state(rows, 8)}
    for at in (0, len(whole) // 2, len(whole) - 1):
        id_ = whole[at][0]
        us = (starts[id_] - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        for gone, want in ((id_, whole[at:]), (f"{id_}-", whole[at:]), ("", [k for k in whole[at:] if starts[k[0]] < starts[id_]])):
            assert keys(listed(log(spark, rows), Request(page_token=encode(PageToken("t", "x", us, gone, 8))))) == want


@pytest.mark.parametrize("kept", [False, True])
def test_pages_join_to_the_whole_list(spark, kept):
    rows = random_log(53, n_ids=30, commits=12)
    events = log(spark, rows)
    source = Snapshots(events, state(events, 7), 7, events.where(events.txn_ts > 7), 9) if kept else events
    seen, token, sizes = [], "", []
    while True:
        got = page(source, Request(page_size=4, page_token=token))
        seen += [(r.id, r.txn_ts) for r in got.rows]
        sizes.append(len(got.rows))
        token = got.next_page_token
        if not token:
            break
    assert seen == plain_list(rows) and set(sizes[:-1]) == {4}
    only = page(source, Request(page_size=3), payload=("tags",)).rows
    assert [set(r.asDict()) for r in only] == [{"id", "tags"}] * 3
    assert page(log(spark, []), Request(page_size=3)).rows == []
    for wrong in (0, MAX_PAGE_SIZE + 1, None):
        with pytest.raises(ValueError):
            page(events, Request(page_size=wrong))


def test_nulls_in_the_log(spark):
    rows = [{"txn_ts": 1, "is_deleted": False}, {"id": "a"}, {"id": "a", "txn_ts": 3}]
    made = spark.createDataFrame([tuple(row.get(f.name) for f in VERSION) for row in rows], VERSION)
    assert keys(v.state(made)) == [("a", 3)]


def test_a_range_and_a_filter_reach_the_scan_of_the_kept_state(spark, tmp_path):
    rows = random_log(61)
    log(spark, rows).write.parquet(f"{tmp_path}/log")
    whole = spark.read.parquet(f"{tmp_path}/log")
    state(whole, 6).write.parquet(f"{tmp_path}/state")
    source = Snapshots(whole, spark.read.parquet(f"{tmp_path}/state"), 6, whole.where("txn_ts > 6"), 9)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        found = matching(source, Request('tags = "red"', BASE, BASE + 9 * STEP)).select("id", "start_time")
        plan = found._jdf.queryExecution().executedPlan().toString()
        one = matching(source, Request()).where("id = 'k01'")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    kept, *since = [line for line in plan.splitlines() if "FileScan" in line]
    assert "/state" in kept and "description" not in kept
    pushed = kept.partition("PushedFilters")[2]
    assert "GreaterThanOrEqual(end_time" in pushed and "LessThan(start_time" in pushed
    # only what came since is resolved and moved
    assert since and all("/log" in line and "GreaterThan(txn_ts,6)" in line for line in since)
    assert plan.count("hashpartitioning") == plan.count("+- Window [")
    assert all("EqualTo(id,k01)" in line for line in one.splitlines() if "FileScan" in line and "/state" in line)
