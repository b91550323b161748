"""State by key with timers and times to live: `transformWithState` processors over RocksDB."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, MapState, StatefulProcessor, StatefulProcessorHandle, TimerValues

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have this package

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, on disk and with changelogs in the checkpoint."""
    was = {c: spark.conf.get(c, None) for c in (_PROVIDER, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")}
    for c, v in zip(was, (ROCKSDB, "true")):
        spark.conf.set(c, v)
    try:
        yield
    finally:
        for c, v in was.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def _rows(parts: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    whole = pd.concat(list(parts))
    return [whole[c].to_numpy() if c == "event_type" else whole[c].astype("int64").to_numpy() for c in columns]


def _packed(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, np.int64).tobytes()


def _unpacked(state: tuple | None, width: int) -> np.ndarray:
    return np.frombuffer(bytes(state[0]) if state else b"", np.int64).reshape(-1, width)


class Unanswered(StatefulProcessor):
    """Events of `first` that no event of `then` of the same user follows within `within_us` microseconds, each given when that is certain.

    A key has many users. Time is cut into ticks of `within_us`, and a tick has one timer and one packed row of each map: an event waits in the
    tick in which its deadline is, whose timer fires once the watermark has passed that tick's end, so no answer can come any more.
    What a tick's events may need are the answers of that tick and the one before; the latter go with the timer."""

    def __init__(self, first: str, then: str, within_us: int) -> None:
        self.first, self.then, self.within = first, then, within_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "tick long", "packed binary")
        self.answers = handle.getMapState("answers", "tick long", "packed binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        kind, user, i, us = _rows(rows, "event_type", "user_id", "event_id", "us")
        tick = -(-us // self.within)
        asked, told = kind == self.first, kind == self.then
        ticks = self.add(self.waiting, tick[asked] + 1, np.stack([user, i, us], 1)[asked])
        ticks |= {k + 1 for k in self.add(self.answers, tick[told], np.stack([user, us], 1)[told])}  # after that no event can need them
        for k in sorted(ticks):
            self.handle.registerTimer(k * self.within // 1000)
        yield from ()

    def add(self, state: MapState, tick: np.ndarray, rows: np.ndarray) -> set[int]:
        order = np.argsort(tick, kind="stable")
        found, starts = np.unique(tick[order], return_index=True)
        for k, more in zip(found, np.split(rows[order], starts[1:])):
            was = state.getValue((int(k),))
            state.updateValue((int(k),), ((bytes(was[0]) if was else b"") + _packed(more),))
        return {int(k) for k in found}

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        tick = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.within
        found = self.waiting.getValue((tick,))
        # timers fire in order: what waits still is in a later tick, and what comes is after the watermark
        before = self.answers.getValue((tick - 1,))
        if before is not None:
            self.answers.removeKey((tick - 1,))
        if found is None:
            return
        self.waiting.removeKey((tick,))
        asked = _unpacked(found, 3)
        told = np.concatenate([_unpacked(before, 2), _unpacked(self.answers.getValue((tick,)), 2)])
        # users one after another on one line of times, further apart than the two ticks are long
        codes = np.unique(np.concatenate([asked[:, 0], told[:, 0]]), return_inverse=True)[1].reshape(-1) * (4 * self.within) - (tick - 2) * self.within
        at, answers = codes[: len(asked)] + asked[:, 2], np.sort(codes[len(asked) :] + told[:, 1])
        following = np.append(answers, np.iinfo(np.int64).max)[np.searchsorted(answers, at)]
        open_ones = asked[following - at > self.within]
        if len(open_ones):
            yield pd.DataFrame(dict(zip(("user_id", "event_id", "us"), open_ones.T)))

    def close(self) -> None:
        pass


def unanswered(events: DataFrame, first: str, then: str, within_seconds: int, late: str, slot_seconds: int = 86_400, buckets: int = 1024) -> DataFrame:
    """user_id, event_id and ts of `first` events that no `then` event of the same user follows within `within_seconds`.

    State is parted by `buckets` of users and slots of time: calls, timers and state rows go by buckets and ticks, not by users and events, and no
    user's history is one key. A `first` event goes to its slot, a `then` event to its own and, near a slot's beginning, to the one
    before. Events later than `late` are dropped."""
    t = F.unix_seconds("ts")
    slot = lambda s: F.floor(s / slot_seconds)
    slots = F.when(F.col("event_type") == then, F.sequence(slot(t - within_seconds), slot(t))).otherwise(F.array(slot(t)))
    kept = events.withWatermark("ts", late).where(F.col("user_id").isNotNull() & F.col("event_type").isin(first, then))
    keyed = kept.select("ts", _bucket(buckets), "user_id", "event_id", "event_type", F.unix_micros("ts").alias("us"), F.explode(slots).alias("slot"))
    got = keyed.groupBy("bucket", "slot").transformWithStateInPandas(Unanswered(first, then, within_seconds * 1_000_000), "user_id long, event_id long, us long", "Append", "EventTime")
    return got.select("user_id", "event_id", F.timestamp_micros("us").alias("ts"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket")


class FirstSeen(StatefulProcessor):
    """The first row of each user of a type, and again the first after `ttl_ms` of processing time without one.

    A key is a type and a bucket of users, its state one packed row of users and the times of the batches that had them last. Users whose
    time is up go when the bucket is next read, the whole bucket with its own time to live."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "packed binary", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        user, i = _rows(rows, "user_id", "event_id")
        order = np.lexsort((i, user))
        users, starts = np.unique(user[order], return_index=True)
        was = _unpacked(self.seen.get(), 2)
        was = was[was[:, 1] + self.ttl > now]
        fresh = ~np.isin(users, was[:, 0])
        alive = np.stack([users, np.full(len(users), now)], 1)  # and they live on from now
        self.seen.update((_packed(np.concatenate([was[~np.isin(was[:, 0], users)], alive])),))
        if fresh.any():
            yield pd.DataFrame({"user_id": users[fresh], "event_type": str(key[0]), "event_id": i[order][starts][fresh]})

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, ttl_ms: int, buckets: int = 1024) -> DataFrame:
    """user_id, event_type, event_id: the least event id of the first batch that has the user and type, and of the first batch
    after `ttl_ms` without them. Without a watermark: what bounds the state is its time to live. State is kept by type and by `buckets` of users."""
    kept = events.where(F.col("user_id").isNotNull() & F.col("event_type").isNotNull()).select("user_id", "event_type", "event_id", _bucket(buckets))
    return kept.groupBy("event_type", "bucket").transformWithStateInPandas(FirstSeen(ttl_ms), "user_id long, event_type string, event_id long", "Append", "ProcessingTime")
