"""Streaming twins of the ordered operators: the same decisions, made as events come in.

Rows are held until the watermark has passed them and are then taken in the order of time and sequence number, so that
files or partitions that arrive in another order change nothing. Rows that come more than late_ms behind the newest one
are left out, as Spark's watermark does. State is typed and kept by Spark in RocksDB: held rows as a list, windows and
open requests as maps of which only what changes is written. It is forgotten when event time has gone on by idle_ms
without a row for its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators import sessions

DAY_MS, LATE_MS = 86_400_000, 10_000
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark passes them; then take() gets those that are due, in order."""

    def __init__(self, columns: list[str], kinds: list[str], idle_ms: int):
        self.columns, self.kinds, self.idle_ms = columns, kinds, idle_ms
        self.order = columns.index("at"), columns.index("seq")

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ", ".join(f"{c} {k}" for c, k in zip(self.columns, self.kinds, strict=True)))
        self.newest = handle.getValueState("newest", "at long")

    def take(self, key: tuple, due: list[tuple]) -> Iterator[Row]:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.columns) for r in rows]
        self.held.appendList(new)
        at = max(r[self.order[0]] for r in new)
        if not self.newest.exists() or self.newest.get()[0] < at:
            self.newest.update((at,))
        # what is due by now is taken by the same timer as what follows, so that order holds across batches
        self.handle.registerTimer(max(min(r[self.order[0]] for r in new), timerValues.getCurrentWatermarkInMs() + 1))
        self.handle.registerTimer(max(at + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        due = sorted((r for r in held if r[self.order[0]] <= now), key=lambda r: tuple(r[i] for i in self.order))
        later = [r for r in held if r[self.order[0]] > now]
        if due:
            yield from self.take(key, due)
            if later:
                self.held.put(later)
                self.handle.registerTimer(min(r[self.order[0]] for r in later))
            else:
                self.held.clear()
        if not later and self.newest.exists() and self.newest.get()[0] + self.idle_ms <= now:
            self.newest.clear()
            self.forget()

    def close(self) -> None:
        pass


class _Limits(_InOrder):
    def __init__(self, limits: tuple, idle_ms: int):
        super().__init__(["seq", "at", "client", "request", "kind"], ["long", "long", "string", "string", "string"], idle_ms)
        self.limits = limits

    def init(self, handle) -> None:
        super().init(handle)
        self.windows = handle.getMapState("windows", "name string", "n long, until long")
        self.active = handle.getMapState("active", "request string", "open boolean")

    def take(self, key, due) -> Iterator[Row]:
        windows = {k[0]: tuple(v) for k, v in self.windows.iterator()}
        active = {k[0] for k in self.active.keys()}  # noqa: SIM118 (not a dict)
        limiter = sessions.Limiter(*self.limits, {k: list(v) for k, v in windows.items()}, set(active))
        for seq, at, client, request, kind in due:
            if kind == "release":
                limiter.release(request)
            else:
                yield Row(scope=key[0], request=request, at=at, **dict(zip(("accepted", "reason", "retry_after"), limiter.acquire(at, client, request), strict=True)))
        for name in windows.keys() - limiter.windows.keys():
            self.windows.removeKey((name,))
        for name, w in limiter.windows.items():
            if windows.get(name) != tuple(w):
                self.windows.updateValue((name,), tuple(w))
        for request in active - limiter.active:
            self.active.removeKey((request,))
        for request in limiter.active - active:
            self.active.updateValue((request,), (True,))

    def forget(self) -> None:
        self.windows.clear()
        self.active.clear()


class _Progress(_InOrder):
    def __init__(self, idle_ms: int):
        super().__init__(["seq", "at", "epoch", "word"], ["long"] * 4, idle_ms)

    def init(self, handle) -> None:
        super().init(handle)
        self.place = handle.getValueState("place", "epoch long, reached long")

    def take(self, key, due) -> Iterator[Row]:
        epoch, reached = self.place.get() if self.place.exists() else (-1, -1)
        for _, at, mine, word in due:
            if mine >= epoch:
                epoch, reached = mine, max(reached, word)
                yield Row(session=key[0], at=at, reached=reached)
        self.place.update((epoch, reached))

    def forget(self) -> None:
        self.place.clear()


def _ordered(rows: DataFrame, key: str, processor: _InOrder, schema: str, late_ms: int) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    timed = rows.select(key, *(F.col(c).cast(k).alias(c) for c, k in zip(processor.columns, processor.kinds, strict=True)), F.timestamp_millis(F.col("at").cast("long")).alias("_ts"))
    return timed.withWatermark("_ts", f"{late_ms} milliseconds").groupBy(key).transformWithState(processor, schema, "append", "EventTime")


def rate_limit(log: DataFrame, max_client: int, max_global: int, window_ms: int, max_active: int, max_entries: int = 2048, late_ms: int = LATE_MS, idle_ms: int = DAY_MS) -> DataFrame:
    """sessions.rate_limit() on a stream (scope, seq, at, client, request, kind), each decision once the watermark allows it."""
    return _ordered(log, "scope", _Limits((max_client, max_global, window_ms, max_active, max_entries), idle_ms), sessions.DECISION, late_ms)


def progress(events: DataFrame, late_ms: int = LATE_MS, idle_ms: int = DAY_MS) -> DataFrame:
    """(session, at, reached) of a stream (session, seq, at, epoch, word): the furthest word, late epochs left out."""
    return _ordered(events, "session", _Progress(idle_ms), "session string, at long, reached long", late_ms)


def word_timer(events: DataFrame, wait_ms: int = 1800, late: str = "10 seconds", keep_ms: int = 60_000) -> DataFrame:
    """(utterance, at) as soon as an utterance has had no word event for wait_ms of event time.

    events: utterance, ts (a timestamp), kind (start or boundary). A watermark drives the timer; a boundary disarms it.
    Events may come up to late behind the newest one; what is older when its batch begins is left out, as Spark's
    watermark does. A disarmed utterance is forgotten keep_ms after its last event, a fired one at once.
    """

    def arm(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            due, done = state.get
            state.remove()
            if not done:
                yield pd.DataFrame({"utterance": [key[0]], "at": [due]})
            return
        due, done = state.get if state.exists else (-1, False)
        newest = 0
        for r in pd.concat(frames).sort_values("ts", kind="stable").itertuples():
            newest = int(r.ts.value // 1_000_000)
            if r.kind == "start" and not done:
                due = newest + wait_ms
            elif r.kind == "boundary" and (due < 0 or newest <= due):
                done = True
        if done or due >= 0:
            state.update((due, done))
            state.setTimeoutTimestamp(max(newest + keep_ms if done else due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"utterance": [], "at": []}).astype({"utterance": "object", "at": "int64"})

    marked = events.withWatermark("ts", late)
    return marked.groupBy("utterance").applyInPandasWithState(arm, "utterance string, at long", "due long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)
