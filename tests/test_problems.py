"""The data-pipeline operators of the core on small inputs with every kind of dirt, against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import canonical_id, item_text, month_of_micros
from tidemark.operators.eager import heavy_keys, join_states, key_states, roll_up
from tidemark.operators.incremental import IncrementalTarget, last_successful_mark
from tidemark.operators.intervals import gaps, periods
from tidemark.operators.lsm import ChangeTable, LateChange
from tidemark.operators.orphans import Reference, find_orphans
from tidemark.operators.seen import BLOCK, MessageKey, SeenMessages
from tidemark.sources.manifest import Part, PartStore


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ids_in_one_spelling(spark):
    plain = "0197c365-0f6a-7009-82c2-6a4514618701"
    cases = {
        plain: plain,
        plain.upper(): plain,
        f"  {plain} ": plain,
        "{" + plain + "}": plain,
        f"urn:uuid:{plain}": plain,
        f"URN:UUID:{plain}": plain,
        plain.replace("-", ""): plain,
        "0197-c3650f6a700982c26a4514618701": plain,
        f"{plain}\n": f"{plain}\n",
        plain[:-1]: plain[:-1],
        f"uuid:{plain}": f"uuid:{plain}",
        f"{{urn:uuid:{plain}}}": f"{{urn:uuid:{plain}}}",
        " Broken {1}-A ": "broken {1}-a",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    got = df.select("want", canonical_id(F.col("raw")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_small_functions(spark):
    df = spark.createDataFrame([(" A b ", 0), ("  ", -1), (None, None), ("\t", 1_751_328_000_000_000)], "t string, us bigint")
    got = df.select(item_text(F.col("t")), month_of_micros(F.col("us"))).collect()
    assert [tuple(r) for r in got] == [("a b", "1970-01"), (None, "1969-12"), (None, None), ("\t", "2025-07")]


# 1


def skewed(n, seed):
    r = random.Random(seed)
    return [(r.choice(["h"] * 6 + ["a", "b", None]), r.choice(["x", "y", None]), r.choice(["i1", "i2", "i3", None]), r.choice([1, 5, None]), "extra") for _ in range(n)]


LEFT = "k string, l string, id string, at bigint, n_rows string"


def test_states_joined_as_the_rows_would_be(spark):
    left, right = skewed(400, 1), skewed(300, 2)
    a = key_states(spark.createDataFrame(left, LEFT), ["k", "l"], "a", distinct="id", newest="at", total="at")
    b = key_states(spark.createDataFrame(right, LEFT), ["k", "l"], "b", distinct="id")
    got = {(r.k, r.l): r for r in join_states(a, b, ["k", "l"]).collect()}
    count = lambda data, key: sum(d[:2] == key for d in data)
    assert set(got) == {d[:2] for d in left + right}
    for key, r in got.items():
        mine = [d for d in left if d[:2] == key]
        assert r.a_rows == len(mine) and r.b_rows == count(right, key)
        assert r.pair_rows == count(left, key) * count(right, key)
        assert r.a_distinct == len({d[2] for d in mine} - {None})
        assert r.a_newest == max((d[3] for d in mine if d[3]), default=None)
        assert r.a_total == (sum(d[3] for d in mine if d[3]) or None)
    rolled = {r.k: r.pair_rows for r in roll_up(join_states(a, b, ["k", "l"]), ["k"], ["pair_rows"]).collect()}
    assert rolled == {k: sum(r.pair_rows for key, r in got.items() if key[0] == k) for k in {key[0] for key in got}}
    heavy = heavy_keys(join_states(a, b, ["k", "l"]), spark.createDataFrame(left, LEFT), "a_rows", 10)
    assert {(r.k, r.l) for r in heavy.collect()} == {k for k, n in Counter(d[:2] for d in left).items() if n * 10 >= len(left)}


def test_states_of_nothing(spark):
    none = spark.createDataFrame([], LEFT)
    some = key_states(spark.createDataFrame([("a", "b", "i", 1, "")], LEFT), ["k"], "a")
    assert key_states(none, ["k"], "b", distinct="id").isEmpty()
    assert rows(join_states(some, key_states(none, ["k"], "b"), ["k"])) == [("a", 1, 0, 0)]


# 2

NODE = "id string, period string, up string, __key string"


def test_cascade(spark):
    tables = {
        "root": [("r1", "p", None, "x")],
        "mid": [("m1", "p", "r1", "x"), ("m2", "p", "gone", "x"), ("m3", "p", "gone", "x"), ("m3", "q", "r1", "x"), ("m2", "p", "gone", "x"), (None, "p", "gone", "x")],
        "leaf": [("l1", "p", "m1", "x"), ("l2", "p", "m2", "x"), ("l3", None, "m3", "x"), ("l4", "p", None, "x"), ("l5", "p", "never", "x")],
        "tip": [("t1", "p", "l2", "x"), ("t2", "p", "l1", "x")],
    }
    refs = [Reference("mid", "up", "root"), Reference("leaf", "up", "mid"), Reference("tip", "up", "leaf")]
    found = find_orphans({t: spark.createDataFrame(r, NODE) for t, r in tables.items()}, refs)
    assert {(r.ref_table, r.id, r.kind, r.round) for r in found.collect()} == {
        ("mid", "m2", "direct", 0), ("mid", "m3", "direct", 0), ("mid", None, "direct", 0), ("leaf", "l5", "direct", 0),
        ("leaf", "l2", "inherited", 1), ("tip", "t1", "inherited", 2),
    }


def test_cascade_over_a_mirror_and_a_circle(spark):
    a = spark.createDataFrame([("1", "p"), ("2", "p"), ("2", "q"), ("3", None)] * 3, "id string, period string")
    b = spark.createDataFrame([("1", "p"), ("4", "p")], "id string, period string")
    both = [Reference("a", "id", "b"), Reference("b", "id", "a")]
    found = find_orphans({"a": a, "b": b}, both)
    assert rows(found.select("ref_table", "ref_month", "id", "kind")) == [
        ("a", "p", "2", "direct"), ("a", "q", "2", "direct"), ("a", None, "3", "direct"), ("b", "p", "4", "direct"),
    ]
    none = b.limit(0)
    assert {r.id for r in find_orphans({"a": a, "b": none}, both).collect()} == {"1", "2", "3"}
    assert find_orphans({"a": none, "b": none}, both).isEmpty()
    assert find_orphans({"a": a}, []).isEmpty()


# 3

CHANGE = "id string, ts bigint, dead boolean, payload string, run int, __best string"


def changes(seed, n=300):
    r = random.Random(seed)
    made = [(r.choice(["hot"] * 5 + ["a", "b", "c", "d", None]), r.choice([None, *range(40)]), r.choice([True, False, None]), r.choice(["x", "y", None]), r.randrange(5), "") for _ in range(n)]
    return made + made[: n // 3]


def expected_state(made, upto=10**9):
    best = {}
    for id_, ts, dead, payload, *_ in made:
        if id_ is not None and ts is not None and ts <= upto:
            rank = (ts, not dead, payload is not None, payload or "")
            best[id_] = max(best.get(id_, rank), rank)
    return sorted((i, r[0], r[3] if r[2] else None) for i, r in best.items() if r[1])


@pytest.mark.parametrize(("seed", "split_rows"), [(1, 10**9), (2, 20)])
def test_change_table(spark, tmp_path, seed, split_rows):
    made = changes(seed)
    df = spark.createDataFrame(made, CHANGE)
    log = ChangeTable(spark, f"{tmp_path}/t", "id", "ts", "dead", ["payload"], fan_in=3, buckets=5, split_rows=split_rows)
    with pytest.raises(LookupError):
        log.current()
    log.append_runs(df.where("run < 4"), "run", "feed/1")
    log.append(df.where("run = 4"), "feed/2")
    log.append(df.where("run = 4"), "feed/2")
    assert len(log.store.current().parts) == 5
    assert ("hot" in log.store.current().facts["split"]) == (split_rows == 20)
    assert rows(log.current()) == expected_state(made)
    assert rows(log.as_of(17)) == expected_state(made, 17)
    log.compact()
    assert len(log.store.current().parts) < 5
    assert rows(log.as_of(17)) == expected_state(made, 17)
    log.append(df.limit(0), "feed/3")
    log.append(spark.createDataFrame([("a", 100, True, None, 0, ""), ("new", 1, None, "n", 0, "")], CHANGE), "feed/4")
    made += [("a", 100, True, None), ("new", 1, None, "n")]
    log.compact(horizon=30)
    assert rows(log.current()) == expected_state(made)
    assert rows(log.as_of(35)) == expected_state(made, 35)


MERGES = {"history": {}, "forgetting": {"horizon": 3}, "forgetting little": {"horizon": 1}}


@pytest.mark.parametrize("merge", MERGES.values(), ids=MERGES)
@pytest.mark.parametrize("split_rows", [1, 10**9])
def test_what_was_deleted_stays_deleted(spark, tmp_path, merge, split_rows):
    """Every batch repeated, under its own name or another, before and after a merge of all runs."""
    one = lambda *r: spark.createDataFrame([(*x, "", 0, "") for x in r], CHANGE)
    batches = {"b/1": one(("x", 1, False), ("y", 1, False)), "b/2": one(("x", 2, True)), "b/3": one(("z", 0, True), ("z", 0, None))}
    log = ChangeTable(spark, f"{tmp_path}/t", "id", "ts", "dead", ["payload"], fan_in=2, buckets=3, split_rows=split_rows)
    state = [("y", 1, ""), ("z", 0, "")]
    for tag, batch in batches.items():
        log.append(batch, tag)
    for _ in range(2):
        for tag, batch in batches.items():
            log.append(batch, tag)
            assert rows(log.current()) == state
        log.compact(**merge)
        assert rows(log.current()) == state
    assert len(log.store.current().parts) == 1 and log.store.current().marks == {"b": ((1, 3),)}
    for tag, batch in batches.items():
        late = merge.get("horizon") is not None and batch.where(F.col("ts") < merge["horizon"]).count()
        if late:
            with pytest.raises(LateChange):
                log.append(batch, f"again {tag}")
        else:
            log.append(batch, f"again {tag}")
        assert rows(log.current()) == state
    log.compact(**merge)
    assert rows(log.current()) == state
    if merge.get("horizon") == 3:
        with pytest.raises(LookupError):
            log.as_of(1)
    else:
        assert rows(log.as_of(1)) == [("x", 1, ""), *state]


def test_runs_are_merged_where_they_lie(spark, tmp_path):
    log = ChangeTable(spark, f"{tmp_path}/t", "id", "ts", "dead", ["payload"], buckets=3)
    for n in range(3):
        log.append(spark.createDataFrame(changes(n), CHANGE), f"feed/{n}")
    plan = log.current()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    version = log.store.current()
    assert "Exchange" not in log._merged(version, version.parts, 9, True)._jdf.queryExecution().executedPlan().toString()


def test_marks_and_vacuum(spark, tmp_path):
    store = PartStore(spark, f"{tmp_path}/t")
    for n in (1, 2, 4, 3, 9):
        store.publish(store.current(), (), f"s/{n}")
    version = store.publish(store.current(), (), "alone")
    assert store.current() == version and version.marks == {"s": ((1, 4), (9, 9)), "alone": ((0, 0),)}
    assert version.holds("s/3") and version.holds("alone") and not version.holds("s/5") and not version.holds("s") and not version.holds("t/1")
    paths = [store.new_part_path() for _ in range(3)]
    for path in paths:
        spark.range(3).write.parquet(path)
    version = store.publish(version, (Part(paths[0], ""), Part(paths[1], "")))
    version = store.publish(version, (Part(paths[1], ""),))
    assert store.vacuum() == 0
    assert store.vacuum(keep_versions=2, older_than=-5) > 0 and store.read(version.parts).count() == 3
    assert {p.name for p in (tmp_path / "t/parts").iterdir()} == {p.rpartition("/")[2] for p in paths[:2]}
    store.vacuum(older_than=-5)
    assert [p.name for p in (tmp_path / "t/parts").iterdir()] == [paths[1].rpartition("/")[2]]
    assert store.current() == version and store.publish(version, ()).number == version.number + 1


# 5


def test_incremental_target(spark, tmp_path):
    source = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "x"), (None, 3, "x"), ("b", None, "x")], "id string, v bigint, other string")
    target = IncrementalTarget(spark, f"{tmp_path}/t", ["id", "v"])
    assert target.published() is None
    everything = [("a", 1), ("a", 2), ("b", None), (None, 3)]
    assert rows(target.pending(source)) == everything
    assert target.pending(source.limit(0)).isEmpty()
    source.where("v = 1").select("id", "v").write.parquet(target.store.new_part_path())  # a run that died before it published
    assert rows(target.pending(source)) == everything
    target.publish(target.pending(source.where("v <= 2")), "run 1")
    target.publish(target.pending(source), "run 1")  # told twice
    assert rows(target.pending(source)) == [("b", None), (None, 3)]
    target.publish(target.pending(source), "run 2")
    assert target.pending(source).isEmpty()
    target.undo("run 1")
    assert rows(target.pending(source)) == [("a", 1), ("a", 2)]


def test_states_of_every_kind(spark, tmp_path):
    source = spark.sql(
        """SELECT * FROM VALUES (1, 1.5D, true, X'00', DATE'2000-01-01', TIMESTAMP'2000-01-01 00:00:00', TIMESTAMP_NTZ'2000-01-01 00:00:00', '', 2.5BD),
        (0, 0D, false, X'', DATE'2000-01-01', TIMESTAMP'2000-01-01 00:00:00', TIMESTAMP_NTZ'2000-01-01 00:00:00', '', 0.0BD),
        (null, null, null, null, null, null, null, null, null) AS t(a, b, c, d, e, f, g, h, i)"""
    )
    target = IncrementalTarget(spark, f"{tmp_path}/t", source.columns)
    assert rows(target.pending(source)) == rows(source) and target.pending(source).dtypes == source.dtypes
    target.publish(source.where("a = 0"), "r/1")
    left = target.pending(source)
    assert rows(left) == rows(source.where("a IS NULL OR a = 1"))
    # of a key and a version, one move of each side serves both its grouping and the join
    target.state = ["a", "h"]
    source.write.parquet(f"{tmp_path}/source")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = target.pending(spark.read.parquet(f"{tmp_path}/source"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in plan
    target.publish(left, "r/2")
    assert target.pending(source).isEmpty()


def test_last_mark(spark):
    schema = "run_no int, attempt int, run_state string, state_at timestamp_ntz, mark timestamp_ntz"
    at = lambda h: f"2024-01-01 {h:02}:00:00"
    data = [(1, 1, "ok", at(2), at(1)), (1, 1, "started", at(1), at(1)), (2, 1, "ok", at(4), at(3)), (2, 1, "rolled_back", at(5), at(3)), (3, 1, "started", at(6), at(6)), (1, 1, "ok", at(2), at(1))]
    runs = spark.createDataFrame(data, "run_no int, attempt int, run_state string, a string, m string").selectExpr(
        "run_no", "attempt", "run_state", "cast(a as timestamp_ntz) state_at", "cast(m as timestamp_ntz) mark"
    )
    assert str(last_successful_mark(runs).first().mark) == at(1)
    assert last_successful_mark(spark.createDataFrame([], schema)).first().mark is None


# 6


def islands(data):
    by = defaultdict(list)
    for e, f, s, t, *_ in data:
        if None not in (e, f, s, t) and t >= s:
            by[e, f].append((s, t))
    merged, holes = [], []
    for key, spans in by.items():
        spans.sort()
        out = [list(spans[0])]
        for s, t in spans[1:]:
            if s > out[-1][1]:
                holes.append((*key, out[-1][1], s))
                out.append([s, t])
            else:
                out[-1][1] = max(out[-1][1], t)
        merged += [(*key, n + 1, *o) for n, o in enumerate(out)]
    return sorted(merged, key=repr), sorted(holes, key=repr)


@pytest.mark.parametrize(("seed", "span"), [(1, 30), (2, 2000), (3, 200)])
def test_intervals(spark, seed, span):
    r = random.Random(seed)
    data = []
    for _ in range(500):
        s = r.choice([None, *range(span)]) if r.random() < 0.05 else r.randrange(span)
        t = None if s is None or r.random() < 0.05 else s + r.choice([-3, 0, 0, 1, 2, 5, 40])
        data.append((r.choice(["hot"] * 8 + ["a", "b", None]), r.choice(["x"] * 9 + [None]), s, t, "extra"))
    data += data[:50]
    df = spark.createDataFrame(data, "e string, f string, s bigint, t bigint, __before string")
    merged, holes = islands(data)
    assert rows(gaps(df, ["e", "f"], F.col("s"), F.col("t"))) == holes
    assert rows(periods(df, ["e", "f"], F.col("s"), F.col("t"))) == merged
    assert gaps(df.limit(0), ["e", "f"], F.col("s"), F.col("t")).isEmpty()
    assert periods(df.limit(0), ["e", "f"], F.col("s"), F.col("t")).isEmpty()


# 7

def test_seen_messages(spark, tmp_path):
    key = MessageKey(F.col("producer"), F.col("number"), F.col("odd"), F.col("delivery"))
    r = random.Random(5)
    feed = []
    for d in range(900):
        kind = r.random()
        if kind < 0.4:
            feed.append((d, "p", r.randrange(3 * BLOCK), None, "x"))
        elif kind < 0.6:
            feed.append((d, "q", 7, None, "x"))
        elif kind < 0.7:
            feed.append((d, r.choice(["p", "q"]), r.randrange(BLOCK - 20, BLOCK + 20), None, None))
        elif kind < 0.8:
            feed.append((d, None, 5, f"odd {r.randrange(20)}", "x"))
        elif kind < 0.9:
            feed.append((d, "p", None, f"odd {r.randrange(20)}", "x"))
        else:
            feed.append((d, None, None, None, "x"))
    kept, seen = {}, set()
    for d, p, n, odd, _ in feed:
        message = (p, n) if p is not None and n is not None else odd
        if message is not None:
            kept[d] = message not in seen
            seen.add(message)
    df = spark.createDataFrame(feed, "delivery bigint, producer string, number bigint, odd string, hi string")
    state = SeenMessages(spark, f"{tmp_path}/s", merge_every=3)
    got, cuts = {}, [(0, 300), (300, 301), (301, 301), (301, 900)]
    part = lambda lo, hi: df.where(F.col("delivery").between(lo, hi - 1)).orderBy(F.rand(1))
    for batch, cut in enumerate(cuts):
        got |= {x.delivery: x.kept for x in state.accept(part(*cut), key, f"feed/{batch}").collect()}
    assert got == kept
    # the batches come again, as after a failure behind the operator, and get what they got
    for batch, cut in enumerate(cuts):
        again = state.accept(part(*cut), key, f"feed/{batch}")
        assert {x.delivery: x.kept for x in again.collect()} == {d: k for d, k in kept.items() if cut[0] <= d < cut[1]}
    # and under another name nothing of them is new
    assert not [x for x in state.accept(df, key, "other/0").collect() if x.kept]
    numbers = defaultdict(set)
    for x in state.ranges().collect():
        span = set(range(x.lo, x.hi + 1))
        assert not span & numbers[x.producer] and {n // BLOCK for n in span} == {x.block}
        numbers[x.producer] |= span
    want = defaultdict(set)
    for _, p, n, *_ in feed:
        if p is not None and n is not None:
            want[p].add(n)
    assert numbers == want
    assert state.ranges().count() < sum(map(len, want.values()))
    state.forget("feed/0")
    with pytest.raises(ValueError):
        state.accept(df, key, "feed/0")


def test_a_batch_that_dies_on_the_way_out_is_not_lost(spark, tmp_path, monkeypatch):
    key = MessageKey(F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.col("m"), F.col("d"))
    batch = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "d bigint, m string")
    state = SeenMessages(spark, f"{tmp_path}/s", buckets=2)
    publish = state.store.publish
    monkeypatch.setattr(state.store, "publish", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # before it was published: as if it had never come
        state.accept(batch, key, "b/1")
    monkeypatch.setattr(state.store, "publish", publish)
    state.accept(batch, key, "b/1")  # published, and the caller dies before it reads
    assert rows(SeenMessages(spark, f"{tmp_path}/s").accept(batch, key, "b/1")) == [(1, True), (2, False), (3, True)]
