from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pytest

from textquarry.streaming import state
from textquarry.streaming.usage import events_stream

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
DAY = datetime(2024, 5, 1)


def at(hours: float) -> datetime:
    return DAY + timedelta(hours=hours)


def arrivals(spark, tmp_path, files):
    """A folder of events files in the order in which they arrive."""
    folder = tmp_path / "events"
    folder.mkdir()
    for k, rows in enumerate(files):
        spark.createDataFrame([(*r, None) for r in rows], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        source = next(p for p in (tmp_path / f"part{k}").iterdir() if p.name.endswith(".parquet"))
        os.rename(source, folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    return events_stream(spark, str(folder), 1)


def calls(stream):
    return stream.selectExpr("event_type AS tool", "event_id", "ts", "value AS duration_ms", "event_type <> 'error' AS success")


@pytest.mark.parametrize("most", [1, 4, 5000])
def test_last_calls_over_batches(spark, tmp_path, most):
    own = random.Random(most)
    rows = [(k, at(own.randrange(40)), 1, own.choice(["view", "error", "click"]), float(k) if k % 7 else None) for k in range(60)]
    stream = arrivals(spark, tmp_path, [rows[:20], rows[20:21], rows[21:] + [(None, at(99), 1, "view", 1.0)]])
    _, checkpoint = state.finished(state.last_calls(calls(stream), most), "t", "update")
    got = sorted((r["tool"], r["event_id"], r["ts"], r["duration_ms"], r["success"]) for r in state.kept_calls(spark, checkpoint).collect())
    want = []
    for tool in ("view", "error", "click"):
        want += sorted((r for r in rows if r[3] == tool), key=lambda r: (r[1], r[0]), reverse=True)[:most]
    assert got == sorted((r[3], r[0], r[1], r[4], r[3] != "error") for r in want)


def test_calls_go_when_their_time_is_over(spark, tmp_path):
    """With a time to live the state is empty for a batch that comes after it."""
    rows = [[(1, at(0), 1, "view", 1.0)], [(2, at(1), 1, "view", 1.0)]]
    stream = arrivals(spark, tmp_path, rows)
    kept, _ = state.finished(state.last_calls(calls(stream), 10, ttl_ms=1), "t", "update", timed=True)
    assert [r["kept"] for r in kept.orderBy("newest").collect()] == [1, 1]


def test_entries_expire_over_batches(spark, tmp_path):
    own = random.Random(3)
    rows = sorted((at(own.random() * 20), k) for k in range(80))
    events = [(k, t, k % 5, "view", 1.0) for t, k in rows]
    stream = arrivals(spark, tmp_path, [events[:30], events[30:60], events[60:]])
    asked = stream.selectExpr("event_id", "CAST(user_id AS string) AS key", "ts")
    got, _ = state.finished(state.cache_hits(asked, 3 * 3_600_000), "t")
    since, want = {}, {}
    for k, t, user, *_ in events:
        ms = int(t.timestamp() * 1000)
        want[k] = user in since and ms - since[user] <= 3 * 3_600_000
        since[user] = since[user] if want[k] else ms
    assert {r["event_id"]: r["hit"] for r in got.collect()} == want


def test_joined_streams_leave_late_rows_out(spark, tmp_path):
    files = [
        [(1, at(10), 1, "view", 0.0), (2, at(20), 9, "view", 0.0), (3, at(20), 9, "purchase", 0.0)],
        [(4, at(12), 2, "view", 0.0), (5, at(19), 3, "view", 0.0), (6, at(20.5), 9, "purchase", 0.0)],
        [(7, at(12.5), 2, "purchase", 0.0), (8, at(19.5), 3, "purchase", 0.0), (9, at(22), 3, "purchase", 0.0)],
    ]
    stream = arrivals(spark, tmp_path, files)
    got, _ = state.finished(state.followed_by(stream.where("event_type = 'view'"), stream.where("event_type = 'purchase'")), "t")
    # 4 and 7 lie behind the watermark of 18 hours
    assert sorted((r["first_id"], r["then_id"]) for r in got.collect()) == [(2, 3), (2, 6), (5, 8)]
    rows = spark.createDataFrame([(*r, None) for f in files for r in f], SCHEMA)
    batch = state.followed_by(rows.where("event_type = 'view'"), rows.where("event_type = 'purchase'"))
    assert sorted((r["first_id"], r["then_id"]) for r in batch.collect()) == [(2, 3), (2, 6), (4, 7), (5, 8)]
