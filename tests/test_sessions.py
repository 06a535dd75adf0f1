"""Limits, caches, players, saved state, and their streaming twins."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lectern.operators import sessions as S
from lectern.streaming import stateful, store


def test_windows_open_at_the_first_accepted_request():
    limiter = S.Limiter(2, 3, 1000, 10)
    ask = lambda at, who, n=[0]: (n.__setitem__(0, n[0] + 1), limiter.acquire(at, who, str(n[0])))[1]  # noqa: E731, B006
    assert ask(0, "a")[0] and ask(400, "a")[0] and ask(999, "a") == (False, "client", 1)
    assert ask(999, "b")[0] and ask(999, "c") == (False, "global", 1)
    assert ask(1000, "a")[0] and ask(1000, "c")[0]  # both windows are over


def test_concurrency_and_entries():
    limiter = S.Limiter(9, 9, 60_000, 1, 3)
    assert limiter.acquire(0, "a", "1") == (True, "", 0) and limiter.acquire(0, "a", "2") == (False, "active", 1)
    limiter.release("1")
    limiter.release("1")
    assert limiter.acquire(0, "b", "3")[0]
    limiter.release("3")
    assert limiter.acquire(10_000, "c", "4") == (False, "entries", 50)


def test_cache_order_and_budget():
    cache = S.Cache(100, 2)
    assert cache.put("a", 40) == [] and cache.put("b", 40) == [] and cache.get("a")
    assert cache.put("c", 10) == ["b"] and not cache.get("b") and cache.get("a")
    assert cache.put("huge", 1000) == [] and not cache.get("huge")


def test_of_snapshots_at_one_time_the_first_counts(spark):
    rows = [(1, 82, 9, 2), (1, 82, 4, 0), (1, 82, 7, 1), (1, 90, 1, 2), (2, 5001, 1, 1)]
    for each in (rows, rows[::-1]):
        snapshots = spark.createDataFrame(each, "device long, at long, seq long, voices long").coalesce(1)
        assert [tuple(r) for r in S.discovered(snapshots).collect()] == [(1, 82, 1)]


def test_caches_players_and_throttles_hold_no_whole_log(spark):
    rows = [(f"k{i % 2}", i, f"{i * 7 % 11}", 1 + i % 5, i * 13 % 170) for i in range(200)]
    log = spark.createDataFrame(rows, "cache string, seq long, key string, size long, at long")
    commands = log.select(F.col("cache").alias("session"), "seq", F.when(F.col("seq") % 3 == 0, "play").when(F.col("seq") % 3 == 1, "boundary").otherwise("stop").alias("command"), F.col("at").alias("word"))
    frames = [S.cache_trace(log, 30, 4), S.transport(commands), S.throttle(log, "cache", 20)]
    for frame in frames:  # streamed through a task, not gathered as groups
        assert "FlatMapGroupsInPandas" not in frame._jdf.queryExecution().toString()
    whole = [sorted(map(str, f.collect())) for f in frames]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert [sorted(map(str, f.select("*").collect())) for f in frames] == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [len(x) for x in whole[:2]] == [200, 200]
    caches: dict = {}
    want = []
    for name, seq, key, size, _ in rows:
        one = caches.setdefault(name, S.Cache(30, 4))
        hit = one.get(key)
        want.append((name, seq, key, hit, [] if hit else one.put(key, size)))
    assert sorted(map(tuple, frames[0].collect())) == sorted(want)


LOG = "scope string, seq long, at long, client string, request string, kind string"


def log_rows(n=400):
    return [(f"s{i % 3}", i, i * 37 % 9000, f"c{i % 5}", str(i if i % 4 else i - 3), "acquire" if i % 4 else "release") for i in range(1, n)]


def streamed(spark, tmp_path, of, schema, files, name):
    """What a stream gives that reads these files one by one, in this order."""
    (tmp_path / name).mkdir()
    columns = [c.split()[0] for c in schema.split(", ")]
    for i, rows in enumerate(files):
        path = tmp_path / name / f"{i}.json"
        path.write_text("\n".join(json.dumps(dict(zip(columns, r, strict=True))) for r in rows))
        os.utime(path, (1_700_000_000 + 10 * i,) * 2)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
    query = of(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return sorted(map(tuple, spark.table(name).collect()))


@pytest.mark.parametrize("order", ["forward", "reversed", "mixed"])
def test_stream_of_requests_decides_like_the_batch(spark, tmp_path, order):
    rows = sorted(log_rows(), key=lambda r: (r[2], r[1]))
    batch = S.rate_limit(spark.createDataFrame(rows, LOG), 3, 8, 2000, 4).collect()
    files = {"forward": [rows[:133], rows[133:266], rows[266:]], "reversed": [rows[266:], rows[133:266], rows[:133]], "mixed": [rows[i::3] for i in (2, 0, 1)]}[order]
    end = [("end", 0, 10_000_000, "c", "last", "acquire")]  # what it holds back itself is not decided
    got = streamed(spark, tmp_path, lambda s: stateful.rate_limit(s, 3, 8, 2000, 4), LOG, [*files, end], f"decisions_{order}")
    assert got == sorted(map(tuple, batch))


def test_stream_of_requests_without_order_in_time(spark, tmp_path):
    """Equal times fall in the order of seq, whichever file brings them."""
    rows = [("s", i, 1000, f"c{i}", str(i), "acquire") for i in range(6)]
    files = [rows[3:], rows[:3], [("end", 0, 10_000_000, "c", "last", "acquire")]]
    got = streamed(spark, tmp_path, lambda s: stateful.rate_limit(s, 9, 9, 2000, 2), LOG, files, "tied")
    assert [(r[1], r[3]) for r in got] == [(str(i), i < 2) for i in range(6)]


def test_stream_leaves_out_what_is_too_late(spark, tmp_path):
    # a batch leaves out what the watermark of the one before it has passed
    files = [[("s", i, 50_000, "a", str(i), "acquire")] for i in (1, 2)] + [[("s", 0, 1_000, "a", "0", "acquire")], [("s", 3, 99_000_000, "a", "3", "acquire")]]
    got = streamed(spark, tmp_path, lambda s: stateful.rate_limit(s, 1, 9, 1000, 9, late_ms=5000), LOG, files, "too_late")
    assert [(r[1], r[3]) for r in got] == [("1", True), ("2", False)]


@pytest.mark.parametrize("turn", [1, -1])
def test_stream_of_progress(spark, tmp_path, turn):
    rows = [("a", 1, 10, 0, 5), ("a", 2, 20, 1, 3), ("a", 3, 30, 0, 9), ("a", 4, 40, 1, 8), ("b", 1, 5, 0, 1)][::turn]
    files = [[r] for r in rows] + [[("end", 0, 10_000_000, 0, 0)]]
    got = streamed(spark, tmp_path, stateful.progress, "session string, seq long, at long, epoch long, word long", files, f"reached_{turn % 5}")
    assert got == [("a", 10, 5), ("a", 20, 5), ("a", 40, 8), ("b", 5, 1)]


WRITES = "key string, seq long, expected long, body string"


def state(store):
    return sorted((r["key"], r["revision"], r["body"]) for r in store.stored().collect())


def test_store_keeps_revisions(spark, tmp_path):
    own = store.Store(spark, str(tmp_path / "store"))
    first = spark.createDataFrame([("k", 1, 0, "a"), ("k", 2, 0, "late"), ("k", 3, 1, "b"), ("m", 1, 5, "no")], WRITES)
    second = spark.createDataFrame([("k", 4, 1, "old"), ("k", 5, 2, "c")], WRITES)
    for n, batch in ((0, first), (1, second), (1, second)):  # a batch that runs again changes nothing
        own.swap(batch, n)
    assert state(own) == [("k", 1, "a"), ("k", 2, "b"), ("k", 3, "c")]


def test_store_shows_a_batch_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    own = store.Store(spark, str(tmp_path / "store"))
    own.swap(spark.createDataFrame([("k", 1, 0, "a"), ("m", 1, 0, "x")], WRITES), 0)
    batch = spark.createDataFrame([("k", 2, 1, "b"), ("m", 2, 1, None)], WRITES)
    real = store.Store._at
    monkeypatch.setattr(store.Store, "_at", lambda self, kind, n: real(self, kind, n) if (kind, n) != ("heads", 1) else 1 / 0)  # dies between rows and heads
    with pytest.raises(ZeroDivisionError):
        own.swap(batch, 1)
    monkeypatch.undo()
    assert state(own) == [("k", 1, "a"), ("m", 1, "x")]
    own.recover()
    own.swap(batch, 1)
    assert state(own) == [("k", 1, "a"), ("k", 2, "b")]
    own.swap(spark.createDataFrame([("m", 3, 2, "y"), ("k", 3, 1, "no")], WRITES), 2)
    assert state(own) == [("k", 1, "a"), ("k", 2, "b"), ("m", 3, "y")]


@pytest.mark.parametrize("dies", ["writing", "moving", "never"])
def test_clearing_survives_a_crash(spark, tmp_path, monkeypatch, dies):
    own = store.Store(spark, str(tmp_path / "store"))
    for n, rows in enumerate(([("k", 1, 0, "a"), ("m", 1, 0, "x")], [("k", 2, 1, "b")], [("k", 3, 2, None)], [("m", 2, 1, "z")])):
        own.swap(spark.createDataFrame(rows, WRITES), n)
    want = [("m", 1, "x"), ("m", 2, "z")]
    assert state(own) == want
    if dies == "moving":
        monkeypatch.setattr(store.Store, "_move", lambda self, path: self._files.delete(self._path(path), True) and 1 / 0)
        with pytest.raises(ZeroDivisionError):
            own.purge()
        monkeypatch.undo()
    if dies == "writing":
        (tmp_path / "store/rows/batch=000000000000.new").mkdir()
    own.recover()
    assert state(own) == want
    own.purge()
    assert state(own) == want and own.purge() == 0 and {r["key"] for r in own._rows().collect()} == {"m"}
    own.swap(spark.createDataFrame([("k", 9, 3, "again"), ("m", 3, 2, "zz")], WRITES), 4)
    assert state(own) == [("k", 4, "again"), *want, ("m", 3, "zz")]


def test_players(spark):
    commands = ["pause", "play", "boundary", "pause", "boundary", "resume", "restart", "stop", "stop"]
    rows = [("s", i, c, 10 * i) for i, c in enumerate(commands)]
    got = S.transport(spark.createDataFrame(rows, "session string, seq long, command string, word long")).orderBy("seq").collect()
    assert [(r["state"], r["epoch"], r["word"]) for r in got] == [("stopped", 0, 0), ("playing", 1, 0), ("playing", 1, 20), ("paused", 1, 20), ("paused", 1, 20), ("playing", 1, 20), ("playing", 2, 20), ("stopped", 3, 20), ("stopped", 3, 20)]


def test_throttle_keeps_the_last(spark):
    rows = [("k", at, i) for i, at in enumerate((0, 50, 100, 199, 200, 210))]
    got = S.throttle(spark.createDataFrame(rows, "key string, at long, seq long"), "key", 100).collect()
    assert sorted(r["at"] for r in got) == [0, 100, 200, 210]


def test_swap_needs_the_present_revision(spark):
    got = S.compare_and_swap(spark.createDataFrame([("k", 1, 0), ("k", 2, 0), ("k", 3, 1), ("k", 4, None)], "key string, seq long, expected long")).orderBy("seq").collect()
    assert [(r["accepted"], r["revision"]) for r in got] == [(True, 1), (False, 1), (True, 2), (False, 2)] or [(r["accepted"], r["revision"]) for r in got][:3] == [(True, 1), (False, 1), (True, 2)]


def test_word_timer(spark, tmp_path):
    rows = [("u", "2024-01-01T00:00:00Z", "start"), ("v", "2024-01-01T00:00:00Z", "start"), ("v", "2024-01-01T00:00:01Z", "boundary"), ("z", "2024-01-01T00:01:00Z", "boundary")]
    (tmp_path / "in").mkdir()
    for i, part in enumerate((rows[:3], rows[3:], [("z", "2024-01-01T00:02:00Z", "boundary")])):
        path = tmp_path / "in" / f"{i}.json"
        path.write_text("\n".join(json.dumps(dict(zip(("utterance", "ts", "kind"), r, strict=True))) for r in part))
        os.utime(path, (1_700_000_000 + 10 * i,) * 2)  # files are read in the order of their times
    stream = spark.readStream.schema("utterance string, ts timestamp, kind string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stateful.word_timer(stream).writeStream.format("memory").queryName("ticks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("ticks").collect()] == [("u", 1704067201800)]
