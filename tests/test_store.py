import datetime as dt
import uuid

import pytest

from tidemark.model import EVENT
from tidemark.operators.mutations import created
from tidemark.sources.manifest import PartStore, PublishConflict
from tidemark.store import EventStore, UnknownEvent
from tidemark.streaming.ingest import event_stream, ingest, stream_throughput

T0 = dt.datetime(2024, 1, 1)


def event(n, **more):
    return {"title": f"t{n}", "resource": ("user", str(n)), "start_time": T0 + dt.timedelta(hours=n), "end_time": T0 + dt.timedelta(hours=n + 1), "tags": ["a"], "annotations": {"n": str(n)}} | more


def test_life_of_events(spark, tmp_path):
    store = EventStore(spark, f"{tmp_path}/s", level_limits=(3, 100))
    assert store.events().isEmpty() and store.snapshot() == 0
    ids = store.create_batch([event(n) for n in range(4)])
    assert ids == sorted(ids) or len(set(ids)) == 4
    assert all(i[14] == "7" for i in ids)
    first = store.snapshot()
    store.update(ids[1], {"title": "new", "tags": ["b"], "resource": None}, ["title", "resource"])
    store.update(ids[2], {"start_time": T0 + dt.timedelta(days=9)}, ["start_time"])
    store.delete(ids[3])
    now = {r.id: r for r in store.events().collect()}
    assert set(now) == set(ids[:3])
    assert (now[ids[1]].title, now[ids[1]].tags, now[ids[1]].resource.type_code) == ("new", ["a"], "user")
    assert [r.id for r in store.list(page_size=9).rows] == [ids[2], ids[1], ids[0]]
    assert {r.id for r in store.events(first).collect()} == set(ids)
    assert store.statistics()["pending_count"] == 4 and store.statistics()["buffered_versions"] == 4 + 1 + 2 + 1
    store.compact()
    stats = store.statistics()
    assert stats["pending_count"] == 0 and stats["level_cardinalities"] == {1: 0, 2: 8, 3: 0}
    assert {r.id: r for r in store.events().collect()} == now
    assert {r.id for r in store.events(first).collect()} == set(ids)
    assert [r.id for r in store.lookup([ids[0], "none"]).collect()] == [ids[0]]
    for bad in (lambda: store.delete(ids[3]), lambda: store.update("none", {}, ["title"])):
        with pytest.raises(UnknownEvent):
            bad()


def test_a_kept_state_serves_later_snapshots(spark, tmp_path):
    store = EventStore(spark, f"{tmp_path}/s")
    ids = store.create_batch([event(n, created_by="me", create_time=T0) for n in range(6)])
    store.compact()
    kept = store.parts.current().facts["current"]
    store.update(ids[2], {"title": "later", "end_time": T0 + dt.timedelta(days=3)}, ["title", "end_time"])
    store.delete(ids[4])
    both = store.snapshots()
    assert both.at == kept["at"] == 1 and both.n_since == 2
    assert {r.id: (r.title, r.created_by, r.create_time) for r in store.events().collect()} == {
        i: ("later" if n == 2 else f"t{n}", "me", T0) for n, i in enumerate(ids) if n != 4
    }
    assert [r.id for r in store.list(page_size=2, start=T0 + dt.timedelta(hours=5, minutes=30)).rows] == [ids[5], ids[2]]
    assert store.events(1).count() == 6
    store.compact()
    assert store.parts.current().facts["current"]["at"] == store.log().agg({"txn_ts": "max"}).first()[0]
    before = {r.id for r in store.events().collect()}
    assert store.parts.vacuum(older_than=-5) > 0
    assert {r.id for r in store.events().collect()} == before == set(ids) - {ids[4]}
    assert store.events(1).count() == 6
    with pytest.raises(ValueError):
        store.lookup(map(str, range(20_000)))


def test_little_that_is_new_rewrites_nothing_large(spark, tmp_path):
    store = EventStore(spark, f"{tmp_path}/s", level_limits=())
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(id as string) id", "cast(id as string) title")
    for lo, hi in ((0, 100), (100, 103), (103, 106), (106, 160)):
        store.create(rows(lo, hi), assign_ids=False)
        store.compact()
        version = store.parts.current()
        if hi == 103:
            assert [p.rows for p in version.parts] == [100, 3] and version.facts["current"]["rows"] == 100
        if hi == 106:
            assert sorted(p.rows for p in version.parts) == [6, 100] and store.events().count() == 106
    assert [p.rows for p in version.parts] == [160] and version.facts["current"]["rows"] == 160
    assert store.log().count() == store.events().count() == 160


def test_assigned_ids_are_ordered_by_time_and_repeatable(spark):
    rows = spark.range(200).selectExpr("'given' as id", "cast(id as string) as title")
    at = 1_751_328_000_123
    ids = [r.id for r in created(rows, 3, at, "root").collect()]
    assert ids == [r.id for r in created(rows, 3, at, "root").collect()] and len(set(ids)) == 200
    for i in map(uuid.UUID, ids):
        assert (i.version, i.variant, i.int >> 80) == (7, uuid.RFC_4122, at)
    assert created(rows, 3).first().id == "given"


def test_forgetting_keeps_what_later_snapshots_see(spark, tmp_path):
    store = EventStore(spark, f"{tmp_path}/s")
    (one,) = store.create_batch([event(0)])
    for n in range(3):
        store.update(one, {"title": str(n)}, ["title"])
    store.compact(forget_before=store.snapshot() - 1)
    assert store.log().count() == 2
    assert store.events().first().title == "2"


def test_a_tag_is_committed_once_and_a_version_number_taken_once(spark, tmp_path):
    store = EventStore(spark, f"{tmp_path}/s")
    rows = spark.createDataFrame([tuple({**dict.fromkeys(EVENT.names), "id": "x"}[n] for n in EVENT.names)], EVENT)
    assert store.create(rows, "batch 1", assign_ids=False) == store.create(rows, "batch 1", assign_ids=False)
    store.create(rows, "batch 2")
    assert store.events().count() == 2
    raw = PartStore(spark, f"{tmp_path}/raw")
    old = raw.current()
    raw.publish(old, ())
    with pytest.raises(PublishConflict):
        raw.publish(old, ())


def test_a_writer_that_died_does_not_block_the_next(spark, tmp_path):
    store = PartStore(spark, f"{tmp_path}/raw")
    (tmp_path / "raw/versions").mkdir(parents=True)
    (tmp_path / "raw/versions/0000000001.claim0").touch()
    with pytest.raises(PublishConflict):
        store.publish(store.current(), ())
    eager = PartStore(spark, f"{tmp_path}/raw", stale_after=0)
    assert eager._claim(1) == 1  # one epoch on, and nobody else gets it
    with pytest.raises(PublishConflict):
        store.publish(store.current(), ())
    assert eager.publish(store.current(), ()).number == 1


def test_a_writer_that_was_taken_for_dead_publishes_nothing(spark, tmp_path, monkeypatch):
    slow, other = PartStore(spark, f"{tmp_path}/raw"), PartStore(spark, f"{tmp_path}/raw", stale_after=0)
    claim = slow._claim
    monkeypatch.setattr(slow, "_claim", lambda number: (claim(number), other.publish(other.current(), (), "theirs"))[0])
    with pytest.raises(PublishConflict):
        slow.publish(slow.current(), (), "ours")
    assert slow.current().marks == {"theirs": ((0, 0),)}


def test_streaming_ingest_and_throughput(spark, tmp_path):
    source, store = f"{tmp_path}/in", EventStore(spark, f"{tmp_path}/s")
    rows = [tuple({**dict.fromkeys(EVENT.names), "id": f"e{n}", "start_time": T0 + dt.timedelta(seconds=n)}[c] for c in EVENT.names) for n in range(10)]
    for n in range(5):
        spark.createDataFrame(rows[2 * n : 2 * n + 2], EVENT).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        ingest(event_stream(spark, source, EVENT, 1), store, f"{tmp_path}/c", "feed").awaitTermination(120)
        assert {r.id for r in store.events().collect()} == {f"e{n}" for n in range(10)}
    assert store.log().count() == 10 and store.statistics()["pending_count"] < 4
    ticks = stream_throughput(event_stream(spark, source, EVENT), "start_time")
    ticks.writeStream.format("memory").queryName("ticks").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert [r.per_second for r in spark.table("ticks").collect()] == [1.0] * 5
