"""Streams with state over many batches and restarts, and the keyed store under repeated, turned and broken batches."""

import collections
import datetime as dt
import itertools
import pathlib
import random

import pytest

from quarry.streaming import stateful
from quarry.streaming.store import KeyedStore

DAY = dt.datetime(2026, 1, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def test_event_numbers_over_restarts(spark):
    rng = random.Random(1)
    rows = [(f"r{rng.randint(0, 3)}", i, rng.choice(["a", "b", None]), at(rng.randint(0, 9)), rng.randint(0, 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "run_id string, event_id long, node string, at timestamp, batch int")
    got = {r.event_id: (r.run_id, r.node, r.event_seq, r.node_seq) for r in stateful.replayed(df, "batch", stateful.event_log, "append").collect()}
    seen, nodes, want = collections.Counter(), collections.Counter(), {}
    for run, i, node, _, _ in sorted(rows, key=lambda r: (r[4], r[3], r[1])):
        seen[run] += 1
        nodes[run, node or ""] += 1
        want[i] = (run, node or "", seen[run], nodes[run, node or ""])
    assert got == want


def test_near_copies_before_and_after_the_watermark(spark):
    rows = [  # asset, title, ticker, url, hours, batch; the watermark of a batch is 10 hours before the latest of all batches before
        (1, "Same title", "T", "http://x.y/1", 20, 0), (2, "same  TITLE!", "T", "http://x.y/2", 23, 0), (3, "Same title", "U", "http://x.y/1", 23, 0), (4, None, "T", None, 23, 0),
        (5, "Same title", "T", "http://x.y/1#f", 14, 1),  # late, but the watermark is 13
        (6, "Same title", "T", "http://x.y/1", 13, 1),  # too late: dropped
        (7, "Same title", "T", "http://x.y/9", 27, 1),  # 4 hours after 23: not near
        (8, "Same title", "T", "http://x.y/2", 80, 2), (9, "Same title", "T", None, 81, 3),
        (10, "Same title", "T", None, 70, 3)]  # at the watermark: dropped
    df = spark.createDataFrame([(i, t, k, u, at(h), b) for i, t, k, u, h, b in rows], "asset_id long, title string, ticker string, url string, published timestamp, batch int")
    got = {(r.asset_id, r.rule): r.is_near for r in stateful.replayed(df, "batch", lambda x: stateful.near_copies(x, "10 hours"), "append").collect()}
    assert got == {(1, "title"): False, (1, "url"): False, (2, "title"): True, (2, "url"): False, (3, "title"): False, (3, "url"): True, (5, "title"): True, (5, "url"): True,
                   (7, "title"): False, (7, "url"): False, (8, "title"): False, (8, "url"): True, (9, "title"): True}


def test_health_ring_over_batches(spark):
    """An incident shows where the ring of the last 20 reaches over two batches."""
    flags = [True] * 14 + [False] * 12 + [True] * 30
    rows = [("n", i, ok, 200, 0.0, 0 if i < 20 else 1) for i, ok in enumerate(flags)] + [("m", i, i % 2 == 0, 200, 0.0, i // 10) for i in range(19)]
    df = spark.createDataFrame(rows, "node string, seq long, ok boolean, status int, retry_after double, batch int")
    got = {r.node: (r.seen, r.ok_of_last, r.incident) for r in stateful.replayed(df, "batch", stateful.health, "update", ["node"]).collect()}
    worst = min(sum(flags[i : i + 20]) for i in range(len(flags) - 19))
    assert got == {"n": (56, 20, worst < 10), "m": (19, 10, False)} and worst < 10


def test_run_status_times_out_between_batches(spark):
    second = lambda s: DAY + dt.timedelta(seconds=s)
    rows = [("slow", 0, second(0), "start", 0), ("fine", 0, second(0), "start", 0), ("fine", 1, second(290), "end", 1), ("other", 0, second(500), "queue", 1), ("slow", 1, second(600), "end", 2),
            ("gone", 0, second(430), "start", 2), ("gone", 1, second(560), "cancel", 2)]  # the start of gone is too late: 440 is the watermark
    df = spark.createDataFrame(rows, "run_id string, seq long, at timestamp, command string, batch int")
    got = {r.run_id: (r.status, r.n) for r in stateful.replayed(df, "batch", stateful.run_status, "update", ["run_id"]).collect()}
    assert got == {"slow": ("FAILED_SYSTEM", 3), "fine": ("SUCCEEDED", 2), "other": ("QUEUED", 1), "gone": ("CANCELLED", 1)}


def test_state_store_is_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with pytest.raises(ZeroDivisionError), stateful.state_store(spark):
        assert "RocksDB" in spark.conf.get(key)
        1 / 0
    assert spark.conf.get(key, None) == before


SCHEMA = "run_id string, ticker string, status string, version long"


def test_store_in_any_order(spark, tmp_path):
    """Four batches, in some orders, by two streams, repeated, with compactions and deletions between."""
    rng = random.Random(7)
    batches = [[(f"r{rng.randint(0, 2)}", rng.choice(["A", "B", None]), rng.choice(["ok", "bad", None]), rng.choice([1, 2, 3, None])) for _ in range(12)] for _ in range(4)]
    want = {}
    least = lambda r: (r[3] is not None, r[3] or 0, r[2] is not None, r[2] or "")
    for r in itertools.chain(*batches):
        if r[:2] not in want or least(want[r[:2]]) < least(r):
            want[r[:2]] = r
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    for n, order in enumerate([(0, 1, 2, 3), (3, 1, 0, 2)]):
        store = KeyedStore(spark, str(tmp_path / str(n)), SCHEMA, ["run_id", "ticker"], "version")
        assert store.snapshot().collect() == [] and store.vacuum() == 0
        for k, b in enumerate(order):
            store.sink("one" if b % 2 else "two")(frames[b], k)
            if k == 1:
                assert store.compact() == 1
                if n:
                    assert store.vacuum() == 2
        store.sink("one" if order[0] % 2 else "two")(frames[order[0]], 0)  # a batch that the snapshot holds
        assert {tuple(r) for r in store.snapshot().collect()} == set(want.values())
        assert store.compact() == 2 and store.compact() == 2
        assert {tuple(r) for r in store.snapshot().collect()} == set(want.values())
        store.vacuum()
        assert {tuple(r) for r in store.snapshot().collect()} == set(want.values())
        wanted = spark.createDataFrame([("r0", "A"), ("r9", "A")], "run_id string, ticker string")
        done = want.get(("r0", "A"), (0, 0, None))[2] == "ok"
        assert {r.run_id for r in store.pending(wanted, "status = 'ok'").collect()} == ({"r9"} if done else {"r0", "r9"})


def test_broken_writers_leave_nothing(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), SCHEMA, ["run_id"], "version")
    store.sink("s")(spark.createDataFrame([("a", "T", "ok", 1)], SCHEMA), 0)
    store.sink("s")(spark.createDataFrame([("a", "T", "late", 2)], SCHEMA), 1)
    (tmp_path / "log/stream=s/batch=1/_SUCCESS").unlink()
    assert [r.status for r in store.snapshot().collect()] == ["ok"]
    store.compact()
    (tmp_path / "base/1/members/_SUCCESS").unlink()
    assert [r.status for r in store.snapshot().collect()] == ["ok"]
    store.sink("s")(spark.createDataFrame([("a", "T", "late", 2)], SCHEMA), 1)
    assert store.compact() == 1 and [r.status for r in store.snapshot().collect()] == ["late"]
    with pytest.raises(ValueError):
        store.sink("a/b")


def test_many_runs_in_few_buckets(spark):
    """Runs share a call and its state; ids may be null or beyond what a double holds."""
    rng = random.Random(4)
    runs = [None, 2**60, 2**60 + 1, *range(40)]
    rows = [(rng.choice(runs), i, rng.choice("ab"), at(i % 7), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "run_id long, event_id long, node string, at timestamp, batch int")
    got = {r.event_id: (r.run_id, r.node, r.event_seq, r.node_seq) for r in stateful.replayed(df, "batch", lambda x: stateful.event_log(x, buckets=2), "append").collect()}
    seen, want = collections.Counter(), {}
    for run, i, node, *_ in sorted(rows, key=lambda r: (r[4], r[3], r[1])):
        seen.update([(run,), (run, node)])
        want[i] = (run, node, seen[(run,)], seen[run, node])
    assert got == want


def test_near_copies_in_two_buckets(spark):
    """Keys share a call and its state: an address is kept, a title is forgotten after some hours."""
    rows = [(i, f"title {i % 9}", "T", f"http://x.y/{i % 11}", at(5 * (i // 9) + i % 9 / 10), i // 30) for i in range(90)]
    df = spark.createDataFrame(rows, "asset_id long, title string, ticker string, url string, published timestamp, batch int")
    got = {(r.asset_id, r.rule): r.is_near for r in stateful.replayed(df, "batch", lambda x: stateful.near_copies(x, "10 hours", buckets=2), "append").collect()}
    assert got == {(i, "title"): False for i in range(90)} | {(i, "url"): i >= 11 for i in range(90)}


def test_long_titles_are_held_as_digests(spark):
    """Titles may be whole texts; the stream's state doesn't grow with their length."""
    rng = random.Random(6)
    titles = ["".join(rng.choices("abcdefghij0123456789 ", k=20_000)) for _ in range(200)]
    rows = [(i, titles[i % 200] + ("x" if i == 399 else ""), "T", None, at(1 + i // 200), 0) for i in range(400)]
    df = spark.createDataFrame(rows, "asset_id long, title string, ticker string, url string, published timestamp, batch int")
    place = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(place.glob("stream-progress-*"))
    got = {r.asset_id: r.is_near for r in stateful.replayed(df, "batch", lambda x: stateful.near_copies(x, "10 hours", buckets=2), "append").collect()}
    assert got == {i: 200 <= i < 399 for i in range(400)}
    (progress,) = set(place.glob("stream-progress-*")) - before
    assert sum(f.stat().st_size for f in progress.rglob("*") if f.is_file()) < 1_000_000
