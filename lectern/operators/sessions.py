"""Ordered event logs: rate limits, progress, epochs, transport, caches and saved state."""

from __future__ import annotations

import heapq
import math
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (requests of a client, of all clients, window in ms, at once) of the two interfaces; fixed values.
POLICIES = {"documents": (20, 80, 60_000, 4), "reconstruct": (6, 24, 60_000, 2)}


def policies(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in POLICIES.items()], "scope string, max_client int, max_global int, window_ms int, max_active int")


@dataclass
class Limiter:
    """Windows that begin at the first request they let through; a request that is turned away doesn't count."""

    max_client: int
    max_global: int
    window_ms: int
    max_active: int
    max_entries: int = 2048
    windows: dict[str, list[int]] = field(default_factory=dict)
    active: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.ends = [(w[1], name) for name, w in self.windows.items()]
        heapq.heapify(self.ends)

    def acquire(self, at: int, client: str, request: str) -> tuple[bool, str, int]:
        """(let through, reason, seconds to wait) of a request; requests come in the order of time."""
        while self.ends and self.ends[0][0] <= at:
            del self.windows[heapq.heappop(self.ends)[1]]
        keys = {"client/" + client: self.max_client, "global": self.max_global}
        for name, most in keys.items():
            if name in self.windows and self.windows[name][0] >= most:
                return False, name.partition("/")[0], self._wait(self.windows[name][1] - at)
        if len(self.active) >= self.max_active:
            return False, "active", 1
        if len(self.windows) + sum(k not in self.windows for k in keys) > self.max_entries:
            return False, "entries", self._wait(min(self.ends[0][0] if self.ends else at + self.window_ms, at + self.window_ms) - at)
        for name in keys:
            if name not in self.windows:
                self.windows[name] = [0, at + self.window_ms]
                heapq.heappush(self.ends, (at + self.window_ms, name))
            self.windows[name][0] += 1
        self.active.add(request)
        return True, "", 0

    def release(self, request: str) -> None:
        self.active.discard(request)

    @staticmethod
    def _wait(ms: int) -> int:
        return max(1, math.ceil(ms / 1000))


DECISION = "scope string, request string, at long, accepted boolean, reason string, retry_after int"


def rate_limit(log: DataFrame, max_client: int, max_global: int, window_ms: int, max_active: int, max_entries: int = 2048) -> DataFrame:
    """Decisions on a log of (scope, seq, at, client, request, kind: acquire or release), in the order of at and seq.

    The quota of a scope is shared by all its clients, so a scope is one sequence and one task; scopes run side by side,
    and a sequence is streamed through its task, which holds the open windows and requests alone.
    """

    def step(limiter: Limiter | None, row: tuple) -> tuple[Limiter, tuple | None]:
        limiter = limiter or Limiter(max_client, max_global, window_ms, max_active, max_entries)
        scope, _, at, client, request, kind = row
        if kind == "release":
            limiter.release(request)
            return limiter, None
        return limiter, (scope, request, at, *limiter.acquire(at, client, request))

    return fold(log.select("scope", "seq", "at", "client", "request", "kind"), "scope", ["at", "seq"], None, step, DECISION)


def fold(rows: DataFrame, key: str, order: list[str] | list[Column], start: object, step: Callable[[object, tuple], tuple[object, tuple | None]], schema: str) -> DataFrame:
    """A key's rows in order, one after the other: step takes the state and a row and gives the next state and a result, or None.

    Rows come sorted and are streamed, so a task holds a batch and one state, however long the sequence of a key is.
    """
    columns = [key, *(c for c in rows.columns if c != key)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, now, state = False, None, start
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                if begun is False or row[0] != now:
                    begun, now, state = True, row[0], start
                state, result = step(state, row)
                if result is not None:
                    out.append(result)
            yield pd.DataFrame(out, columns=names)

    names = [f.split()[0] for f in schema.split(", ")]
    return rows.select(*columns).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def client_windows(log: DataFrame, max_requests: int, window_us: int) -> DataFrame:
    """(client, at, seq, accepted, opened) of a log (client, at, seq): anchored windows of each client alone."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (opened, n), (client, at, seq) = state, row
        if opened is None or at >= opened + window_us:
            opened, n = at, 0
        return (opened, n + (n < max_requests)), (client, at, seq, n < max_requests, opened)

    kind = dict(log.select("client").dtypes)["client"]
    return fold(log.select("client", "at", "seq"), "client", ["at", "seq"], (None, 0), step, f"client {kind}, at long, seq long, accepted boolean, opened long")


def monotone(events: DataFrame, key: str = "session", order: str = "at", seq: str = "seq", value: str = "word") -> DataFrame:
    """events with reached: the furthest value up to each, so progress never goes back."""
    return events.withColumn("reached", F.max(value).over(W.partitionBy(key).orderBy(order, seq).rowsBetween(W.unboundedPreceding, W.currentRow)))


def fence(events: DataFrame, key: str = "doc_id", epoch: str = "epoch", order: str = "at", seq: str = "seq") -> DataFrame:
    """Events of the epoch that was the newest when they came; those of an older one are late and go."""
    newest = F.max(epoch).over(W.partitionBy(key).orderBy(order, seq).rowsBetween(W.unboundedPreceding, W.currentRow))
    return events.withColumn("_newest", newest).where(F.col(epoch) == F.col("_newest")).drop("_newest")


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row with the greatest sequence number of each key; an aggregate, so a hot key is combined before it shuffles."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), seq).alias("_row")).select("_row.*")


def pending(saves: DataFrame, current: DataFrame, key: str = "doc_id") -> DataFrame:
    """Saves whose sequence hasn't been overtaken; current has (key, seq)."""
    return saves.join(current.select(key, F.col("seq").alias("_now")), key, "left").where(F.col("_now").isNull() | (F.col("seq") >= F.col("_now"))).drop("_now")


def discovered(snapshots: DataFrame, key: str = "device", within_ms: int = 5000) -> DataFrame:
    """(key, at, voices): the first snapshot that has a Spanish voice; snapshots: key, at (ms), seq, voices (n Spanish).

    Snapshots of one time come in the order of seq.
    """
    return snapshots.where((F.col("at") <= within_ms) & (F.col("voices") > 0)).groupBy(key).agg(F.min("at").alias("at"), F.min_by("voices", F.struct("at", "seq")).alias("voices"))


def correlate(requests: DataFrame, replies: DataFrame, fatal: DataFrame) -> DataFrame:
    """requests (worker, id, at) with outcome: the first reply's, else fatal if the worker failed afterwards, else pending."""
    first = replies.groupBy("worker", "id").agg(F.min_by("status", "at").alias("status"))
    failed = fatal.groupBy("worker").agg(F.max("at").alias("failed_at"))
    both = requests.join(first, ["worker", "id"], "left").join(failed, "worker", "left")
    return both.select("worker", "id", "at", F.coalesce("status", F.when(F.col("failed_at") >= F.col("at"), "fatal"), F.lit("pending")).alias("outcome"))


def throttle(events: DataFrame, key: str, gap_ms: int = 100) -> DataFrame:
    """Progress reports at least gap_ms apart, counted from the last one let through, and always the last of a key."""
    order = [F.col("at").asc_nulls_last(), F.col("seq")]
    last = F.lead(F.lit(1)).over(W.partitionBy(key).orderBy(*order)).isNull()
    columns = [key, "at", "_last", *(c for c in events.columns if c not in (key, "at"))]

    def step(before: int | None, row: tuple) -> tuple[int | None, tuple | None]:
        name, at, is_last, *more = row
        if before is None or at - before >= gap_ms or is_last:
            return at, (name, at, *more)
        return before, None

    kept = events.withColumn("_last", last).select(*columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.drop("_last").schema)
    return fold(kept, key, order, None, step, schema).select(*events.columns)


def fallback_ticks(starts: DataFrame, boundaries: DataFrame, wait_ms: int = 1800) -> DataFrame:
    """(utterance, at): when a timer takes over, for utterances without a word event in the first wait_ms."""
    first = boundaries.groupBy("utterance").agg(F.min("at").alias("first"))
    both = starts.join(first, "utterance", "left")
    return both.where(F.col("first").isNull() | (F.col("first") > F.col("at") + wait_ms)).select("utterance", (F.col("at") + wait_ms).alias("at"))


def advance(chunks: DataFrame, ended: DataFrame) -> DataFrame:
    """(doc_id, idx, next_idx, next_word, done): where reading goes on when a chunk has ended."""
    w = W.partitionBy("doc_id").orderBy("idx")
    order = chunks.withColumn("next_idx", F.lead("idx").over(w)).withColumn("next_word", F.col("start_word") + F.col("word_count"))
    return order.join(ended, ["doc_id", "idx"]).select("doc_id", "idx", "next_idx", "next_word", F.col("next_idx").isNull().alias("done"))


TRANSPORT = "session string, seq long, command string, state string, epoch int, word long"


def transport(commands: DataFrame) -> DataFrame:
    """States of players (stopped, playing, paused) after each of (session, seq, command, word).

    Commands: play, pause, resume, stop, restart (another rate or voice), seek, boundary. What would not fit the state is
    ignored; stop, restart and seek begin a new epoch.
    """

    def step(player: tuple[str, int, int], row: tuple) -> tuple[tuple[str, int, int], tuple]:
        (state, epoch, word), (session, seq, command, to) = player, row
        if command == "play" and state == "stopped":
            state, epoch = "playing", epoch + 1
        elif command == "pause" and state == "playing":
            state = "paused"
        elif command == "resume" and state == "paused":
            state = "playing"
        elif command == "stop" and state != "stopped":
            state, epoch = "stopped", epoch + 1
        elif command == "restart" and state != "stopped":
            state, epoch = "playing", epoch + 1
        elif command == "seek":
            word, epoch = int(to), epoch + (state != "stopped")
        elif command == "boundary" and state == "playing":
            word = max(word, int(to))
        return (state, epoch, word), (session, seq, command, state, epoch, word)

    return fold(commands.select("session", "seq", "command", "word"), "session", ["seq"], ("stopped", 0, 0), step, TRANSPORT)


# -- caches ----------------------------------------------------------------------------------------------------------


class Cache:
    """Least recently used first out, within a number of bytes and of entries; what is larger than all isn't kept."""

    def __init__(self, most_bytes: int = 12 * 1024 * 1024, most_entries: int = 128):
        self.most_bytes, self.most_entries, self.used, self.entries = most_bytes, most_entries, 0, OrderedDict()

    def get(self, key: str) -> bool:
        if key not in self.entries:
            return False
        self.entries.move_to_end(key)
        return True

    def put(self, key: str, size: int) -> list[str]:
        """The keys that had to go."""
        cost, gone = size + 2 * len(key), []
        if cost > self.most_bytes:
            return gone
        self.used += cost - self.entries.pop(key, 0)
        self.entries[key] = cost
        while self.used > self.most_bytes or len(self.entries) > self.most_entries:
            old, freed = self.entries.popitem(last=False)
            self.used -= freed
            gone.append(old)
        return gone


def cache_trace(requests: DataFrame, most_bytes: int = 12 * 1024 * 1024, most_entries: int = 128) -> DataFrame:
    """(cache, seq, key, hit, evicted) of a log (cache, seq, key, size), served one after the other.

    A cache is one sequence and one task, which holds a batch of the log and what the cache keeps.
    """

    def step(cache: Cache | None, row: tuple) -> tuple[Cache, tuple]:
        cache = cache or Cache(most_bytes, most_entries)
        name, seq, key, size = row
        hit = cache.get(key)
        return cache, (name, seq, key, hit, [] if hit else cache.put(key, int(size)))

    return fold(requests.select("cache", "seq", "key", "size"), "cache", ["seq"], None, step, "cache string, seq long, key string, hit boolean, evicted array<string>")


# -- saved state -----------------------------------------------------------------------------------------------------


def compare_and_swap(writes: DataFrame) -> DataFrame:
    """(key, seq, accepted, revision) of writes (key, seq, expected): one is accepted if it names the present revision.

    Revisions count the accepted writes, so a fold over a key's ordered writes decides all of them; a write that names no
    revision is never accepted.
    """

    def step(revision: tuple, row: tuple) -> tuple[tuple, tuple]:
        key, seq, expected = row
        ok = expected == revision[0]
        now = revision[0] + ok
        return (now,), (key, seq, ok, now)

    kind = dict(writes.select("key").dtypes)["key"]
    known = writes.select("key", "seq", F.coalesce("expected", F.lit(-1)).cast("long").alias("expected"))
    return fold(known, "key", ["seq"], (0,), step, f"key {kind}, seq long, accepted boolean, revision long")


def changed(incoming: DataFrame, stored: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """Incoming rows that aren't stored as they are; only they need to be written."""
    digest = lambda d: d.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("_h"))
    own = incoming.withColumn("_h", F.sha2(F.to_json(F.struct(*columns)), 256))
    return own.join(digest(stored), [key, "_h"], "left_anti").drop("_h")


def restore(checkpoints: DataFrame, documents: DataFrame) -> DataFrame:
    """checkpoints (key, document_id, word, version) with the document they name and what they load as.

    missing: no such document; beyond: the word lies outside it; migrate: of an older version; ok.
    """
    named = documents.select(F.col("document_id").alias("_d"), "word_count")
    both = checkpoints.join(named, F.col("document_id") == F.col("_d"), "left")
    load = F.when(F.col("_d").isNull(), "missing").when((F.col("word") > F.col("word_count")) | (F.col("word") < 0), "beyond").when(F.col("version") < 2, "migrate").otherwise("ok")
    return both.select("key", "document_id", "word", "version", "word_count", load.alias("load"))


def clear(rows: DataFrame, clears: DataFrame) -> DataFrame:
    """rows (key, ..., progress, document) after clears (key, mode): reset keeps the document at word 0, all leaves a marker."""
    both = rows.join(clears.withColumnRenamed("mode", "_mode"), "key", "left")
    gone = F.coalesce(F.col("_mode") == "all", F.lit(False))
    reset = F.coalesce(F.col("_mode") == "reset", F.lit(False))
    return both.withColumn("document", F.when(~gone, F.col("document"))).withColumn("progress", F.when(gone, F.lit(None)).when(reset, F.lit(0).cast("long")).otherwise(F.col("progress"))).withColumn("erased", gone).drop("_mode")
