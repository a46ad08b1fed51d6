"""State of streams over restarts, and tables that streams write."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from skein.streaming import state, upsert

NOW = datetime.datetime(2026, 1, 1)


def at(hours: float) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def test_patches_survive_restarts_and_keep_what_a_batch_lacks(spark):
    rows = spark.createDataFrame([("a", 1, 0, 1.0, None), ("a", 2, 0, None, "x"), ("b", 3, 0, None, None), ("a", 4, 1, 2.0, None), ("a", 9, 2, 2.0, None), ("b", 8, 2, 5.0, "y"), ("b", 7, 2, 6.0, "z")], "k string, seq long, tick long, price double, side string")
    out = state.replayed(rows, "tick", 3, lambda s: state.patched(s, ["k"], "seq", ["price", "side"]), "update")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 1.0, "x", 0), ("b", None, None, 0), ("a", 2.0, "x", 1), ("a", 2.0, "x", 2), ("b", 5.0, "y", 2)], key=str)
    changed = state.replayed(rows, "tick", 3, lambda s: state.patched(s, ["k"], "seq", ["price", "side"], changed_only=True), "update")
    assert changed.filter("k = 'a' and batch = 2").count() == 0 and changed.count() == 4


def test_a_queue_drops_the_newest_and_drains_in_quiet_ticks(spark):
    rows = spark.createDataFrame([(1, seq, 0) for seq in range(30, 0, -1)] + [(1, 100 + seq, 3) for seq in range(9)] + [(2, 50, 0)], "k long, seq long, tick long")
    subs = spark.createDataFrame([(1, 7), (1, 8), (2, 8)], "k long, subscriber long")
    out = state.replayed(rows, "tick", 4, lambda s: state.fan_out_queues(s, subs, "k", drained=2, capacity=10)).collect()
    entered = {(r.subscriber, r.tick): sorted(x.seq for x in out if x.seq is not None and (x.subscriber, x.tick) == (r.subscriber, r.tick)) for r in out}
    assert entered[(7, 0)] == list(range(1, 11)) and entered[(7, 3)] == list(range(100, 106))  # 8 wait, 4 leave in two quiet ticks
    counts = {(r.subscriber, r.tick): (r.sent, r.dropped, r.waiting) for r in out if r.seq is None}
    assert counts == {(7, 0): (10, 20, 8), (7, 3): (6, 3, 8), (8, 0): (10, 21, 8), (8, 3): (6, 3, 8)}


def test_evictions_cascade_and_late_rows_revive_nothing(spark):
    rows = [
        (1, at(0), None, None, 0), (1, at(0), "p1", 5.0, 0), (1, at(1), "p1", 6.0, 0), (1, at(0), "p2", 7.0, 0), (2, at(5), None, None, 0),
        (1, at(1), None, None, 1), (2, at(6), None, None, 1), (1, at(0.5), "p3", 1.0, 1),  # game 1 went at hour 5: these are late
        (2, at(30), None, None, 2),
        (1, at(40), None, None, 3),
    ]
    df = spark.createDataFrame(rows, "game long, ts timestamp, part string, value double, tick long")
    out = state.replayed(df, "tick", 4, lambda s: state.evicted(s, 3 * 3600)).collect()
    got = sorted(((r.game, r.part or "", r.last_seen, r.value) for r in out), key=str)
    assert got == sorted([(1, "", at(0), None), (1, "p1", at(0), 5.0), (1, "p2", at(0), 7.0), (2, "", at(30), None)], key=str)


def test_first_values_come_once(spark):
    rows = spark.createDataFrame([("a", 5, 0, None), ("a", 9, 1, 2.0), ("a", 8, 1, 3.0), ("a", 1, 2, 4.0), ("b", 2, 2, 1.0)], "k string, seq long, tick long, v double")
    out = state.replayed(rows, "tick", 3, lambda s: state.first_values(s, ["k"], "seq", "v"))
    assert sorted(map(tuple, out.collect())) == [("a", 3.0, 1), ("b", 1.0, 2)]


@pytest.fixture
def store(spark):
    return upsert.KeyedStore(spark, {"t": upsert.Table(["k"], "k string, v string, seen timestamp, changed timestamp, digest string")}, buckets=4)


def wanted(spark, rows):
    return {"t": upsert.Incoming(spark.createDataFrame(rows, "k string, v string, seq long"), ["v"], "seq")}


def did(counts):
    return {r.action: r.n for r in counts.collect()}


def test_upserts_are_gated_by_digests_and_come_once(spark, store):
    hour = datetime.timedelta(hours=1)
    assert did(store.upsert(0, NOW, wanted(spark, [("a", "1", 1), ("a", "2", 2), ("b", None, 1), (None, "n", 1)]))) == {"insert": 3}
    first = store.manifest()
    assert did(store.upsert(1, NOW + hour / 2, wanted(spark, [("a", "2", 1), ("b", None, 1), (None, "n", 1)]))) == {"unchanged": 3}
    assert store.manifest()["tables"] == first["tables"]  # nothing was rewritten
    assert did(store.upsert(2, NOW + 2 * hour, wanted(spark, [("a", "3", 1), (None, "n", 1), ("c", "1", 1)]))) == {"update": 1, "bumped": 1, "insert": 1}
    kept = store.manifest()
    assert did(store.upsert(2, NOW + 9 * hour, wanted(spark, [("a", "4", 1)]))) == {"update": 1, "bumped": 1, "insert": 1}  # the batch again: what it did
    assert store.manifest() == kept
    got = {r.k: (r.v, r.seen, r.changed) for r in store.read("t").collect()}
    assert got == {"a": ("3", NOW + 2 * hour, NOW + 2 * hour), "b": (None, NOW, NOW), None: ("n", NOW + 2 * hour, NOW), "c": ("1", NOW + 2 * hour, NOW + 2 * hour)}


def test_only_buckets_with_changes_are_rewritten(spark, store):
    store.upsert(0, NOW, wanted(spark, [(f"k{i}", "1", 1) for i in range(60)]))
    before = store.manifest()["tables"]["t"]
    store.upsert(1, NOW, wanted(spark, [("k7", "2", 1), *((f"k{i}", "1", 1) for i in range(20, 60))]))
    after = store.manifest()["tables"]["t"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.read("t").count() == 60
    assert store.vacuum() == 1 and store.read("t").filter("v = '2'").count() == 1


def test_a_failure_between_two_tables_leaves_neither_changed(spark, monkeypatch):
    s = upsert.events_and_outcomes(spark, "status string", "outcome int, price double")
    one = spark.createDataFrame([(1, "x", [(1, 0.5), (2, 0.5)])], "game long, status string, outcomes array<struct<outcome: int, price: double>>")
    upsert.upsert_events(s, 0, NOW, one, ["status"], ["outcome"], ["price"])
    two = one.select("game", F.lit("y").alias("status"), F.transform("outcomes", lambda o: F.struct(o["outcome"].alias("outcome"), (o["price"] + 1).alias("price"))).alias("outcomes"))
    real, rows = s._next, lambda: (sorted(map(tuple, s.read("events").select("game", "status").collect())), sorted(map(tuple, s.read("outcomes").select("game", "outcome", "price").collect())))

    def broken(before, name, *rest):
        if name == "outcomes":
            raise OSError("lost")
        return real(before, name, *rest)

    before = rows()
    monkeypatch.setattr(s, "_next", broken)
    with pytest.raises(OSError):
        upsert.upsert_events(s, 1, NOW, two, ["status"], ["outcome"], ["price"])
    assert rows() == before
    monkeypatch.setattr(s, "_next", real)
    upsert.upsert_events(s, 1, NOW, two, ["status"], ["outcome"], ["price"])
    assert rows() == ([(1, "y")], [(1, 1, 1.5), (1, 2, 1.5)])


def test_a_second_writer_is_refused(spark, store):
    store.upsert(0, NOW, wanted(spark, [("a", "1", 1)]))
    with pytest.raises(RuntimeError):
        store._commit({**store.manifest(), "batch": 9})
