"""Streams over several batches with events out of order: late rows, eviction, timers, times to live."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemill.plans.registry import table
from tidemill.sources.shared import _path
from tidemill.streaming import events, replay, timers

DATA = "/root/testdata/sf0.001"
DAY = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, DAY + timedelta(seconds=s), u, t, 1.0) for i, s, u, t in rows], SCHEMA)


def written(spark, *slices):
    """A slice for each list of (id, second, user, type)."""
    at = replay.fresh(spark, "test")
    for k, rows in enumerate(slices):
        rows_of(spark, rows).coalesce(1).write.parquet(f"{at}/slice-{k:05d}")
    return replay.as_stream(spark, replay.Arrivals(at, 1))


def test_arrivals_are_the_table_out_of_order(spark):
    e = table(spark, DATA, "events")
    got = replay.arrivals(e, ["view", "purchase"])
    back = spark.read.parquet(f"{got.path}/*")
    assert sorted(map(tuple, back.where("event_id >= 0").collect())) == sorted(map(tuple, e.collect()))
    assert {(r.event_id, r.event_type) for r in back.where("event_id < 0").collect()} == {(-1, "view"), (-2, "purchase")}
    newest = [spark.read.parquet(f"{got.path}/slice-{k:05d}").agg(F.max("ts"), F.min("ts")).first() for k in range(6)]
    assert all(newest[k + 1][1] < newest[k][0] for k in range(4)) and newest[5][1] > newest[4][0]


def test_late_rows_are_dropped_and_counted(spark):
    e = table(spark, DATA, "events")
    behind = "int(greatest(0, 7919 * event_id % 11 - 7))"
    arrived = replay.arrivals(e, ["view"], behind=behind)
    got = replay.replay(events.counted(replay.as_stream(spark, arrived), "1 hour", "3 days"))
    slices = [spark.read.parquet(f"{arrived.path}/slice-{k:05d}").select("ts", "event_type").collect() for k in range(5)]
    want, dropped, newest = Counter(), 0, [None]
    for k, rows in enumerate(slices):
        mark = max((t for t in newest[:k] if t), default=None)  # of the batch before the last
        mark = mark - timedelta(days=3) if mark else None
        late = set()
        for r in rows:
            start = r.ts.replace(minute=0, second=0, microsecond=0)
            if mark and start + timedelta(hours=1) <= mark:
                late.add((start, r.event_type))
            else:
                want[start, r.event_type] += 1
        dropped += len(late)
        newest.append(max(r.ts for r in rows))
    utc = lambda t: t.replace(tzinfo=None)
    rows = [((utc(r.s), r.event_type), r.n) for r in got.table.select(F.col("w.start").cast("timestamp_ntz").alias("s"), "event_type", "n").collect()]
    assert dict(rows) == dict(want) and len(rows) == len(want)  # each window once
    assert got.dropped() == dropped > 20
    assert sum(p["numInputRows"] > 0 for p in got.progress) == 6
    marks = [p["eventTime"]["watermark"] for p in got.progress]
    assert marks == sorted(marks) and len(set(marks)) >= 5


def test_outer_join_emits_on_eviction(spark):
    s = written(spark, [(1, 0, 1, "view"), (2, 10, 1, "purchase"), (3, 20, 1, "view"), (4, 0, 2, "view")], [(5, 9000, 3, "view"), (6, 9000, 3, "purchase")], [(7, 90000, 4, "view"), (8, 90000, 5, "purchase")], [(9, 900, 1, "purchase")])
    first, second = s.where("event_type = 'view'"), s.where("event_type = 'purchase'")
    got = replay.replay(events.followed(first, second, "1 hour", "1 hour", "leftOuter").select("first_id", "second_id"))
    rows = sorted((r.first_id, r.second_id or 0) for r in got.table.collect())
    # 3 and 4 aren't followed; 9 comes after the watermark has passed it and answers nothing; 7 is still open
    assert rows == [(1, 2), (3, 0), (4, 0), (5, 6)]


def test_timers_fire_once_it_is_certain(spark):
    hour = 3600
    slices = [
        [(1, 100, 1, "view"), (2, 200, 2, "view"), (3, 300, 3, "view"), (4, 300, 3, "view"), (10, 50, 1, "purchase"), (11, 7, None, "view")],
        [(5, 200 + hour, 2, "purchase"), (6, 301 + hour, 3, "purchase"), (12, 86_390, 4, "view")],
        [(7, 86_400 + 600, 4, "purchase"), (8, 90_000, 5, "view"), (13, 90_000, 6, "purchase")],
        [(9, 86_400 * 30, 7, "view")],
    ]
    with timers.rocksdb(spark):
        got = replay.replay(timers.unanswered(written(spark, *slices), "view", "purchase", hour, "2 days"), "append")
    rows = sorted((r.user_id, r.event_id) for r in got.table.collect())
    assert rows == [(1, 1), (3, 3), (3, 4), (5, 8)]  # user 2's answer is at the last moment, user 4's in the next slot
    assert any("rocksdb" in k.lower() for k in got.progress[0]["stateOperators"][0]["customMetrics"])
    assert sum(p["numInputRows"] > 0 for p in got.progress) == 4


def test_timers_go_by_ticks_not_events(spark):
    """Users who share a key are told apart, and state grows with buckets and ticks, not with users and events."""
    rng, hour = random.Random(4), 3600
    rows = [(i, rng.choice((rng.randrange(6 * hour), hour * rng.randrange(6))), rng.randrange(40), rng.choice(("view", "view", "purchase"))) for i in range(900)]
    parts = [[r for r in rows if r[1] // (2 * hour) == k] for k in range(3)]
    with timers.rocksdb(spark):
        got = replay.replay(timers.unanswered(written(spark, *parts, [(9999, 86_400 * 30, -1, "view")]), "view", "purchase", hour, "1 day", buckets=2))
    told = {(u, s) for _, s, u, t in rows if t == "purchase"}
    want = [(u, i, DAY + timedelta(seconds=s)) for i, s, u, t in rows if t == "view" and not any(v == u and s <= a <= s + hour for v, a in told)]
    assert len(want) > 50
    assert sorted((r.user_id, r.event_id, r.ts) for r in got.table.withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()) == sorted(want)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in got.progress) < 200


def test_state_is_given_up(spark):
    """After the closing event nothing is left but that event's own key, answers without questions too."""
    rows = [[(k * 100 + i, k * 20_000 + i, i % 7, "view" if i % 3 else "purchase") for i in range(60)] for k in range(4)] + [[(9999, 86_400 * 60, -1, "view")], [(10_000, 86_400 * 61, -1, "other")]]
    with timers.rocksdb(spark):
        got = replay.replay(timers.unanswered(written(spark, *rows), "view", "purchase", 60, "1 hour"))
    left = got.progress[-1]["stateOperators"][0]["numRowsTotal"]
    most = max(p["stateOperators"][0]["numRowsTotal"] for p in got.progress)
    assert most > 20 > 8 >= left


def test_times_to_live(spark):
    rows = [[(10 * k + i, k * 100 + i, i % 2, "view") for i in range(4)] for k in range(3)]
    with timers.rocksdb(spark):
        short = replay.replayed(timers.first_seen(written(spark, *rows), 1), idle=False)
        long = replay.replayed(timers.first_seen(written(spark, *rows), 3_600_000), idle=False)
    assert sorted((r.user_id, r.event_id) for r in short.collect()) == [(0, 0), (0, 10), (0, 20), (1, 1), (1, 11), (1, 21)]
    assert sorted((r.user_id, r.event_id) for r in long.collect()) == [(0, 0), (1, 1)]


def test_first_seen_keeps_users_of_a_key_apart(spark):
    """The least id of the first batch that has a user and type; a state row for each type and bucket, not for each user."""
    rng = random.Random(6)
    rows = [[(i, k, rng.randrange(300), rng.choice(("view", "click"))) for i in rng.sample(range(1000 * k, 1000 * k + 900), 400)] for k in range(3)]
    want = {}
    for batch in rows:
        least = {}
        for i, _, u, t in batch:
            least[u, t] = min(i, least.get((u, t), i))
        want = least | want
    with timers.rocksdb(spark):
        got = replay.replay(timers.first_seen(written(spark, *rows), 3_600_000, buckets=2), idle=False)
    found = [((r.user_id, r.event_type), r.event_id) for r in got.table.collect()]
    assert dict(found) == want and len(found) == len(want) > 400
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in got.progress) <= 20


def test_complete_mode_keeps_one_batch(spark):
    rows = [[(10 * k + i, k * 4000 + i, i, "view") for i in range(4)] for k in range(4)]
    got = replay.replayed(events.counted(written(spark, *rows), "1 hour", "1 hour"), "complete")
    assert sum(r.n for r in got.collect()) == 16
    at = got.inputFiles()[0].rsplit("/batch=", 1)[0]
    fs, path = _path(spark, at)
    assert len([f for f in fs.listStatus(path) if "batch=" in f.getPath().getName()]) == 2  # the empty one and the last
