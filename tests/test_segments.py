"""Chunks of blocks against the kernel that walks through a text."""

import random

import pyarrow as pa
import pytest

from lectern.functions import cleaning
from lectern.operators import batches, documents, segments


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "bc", "Dr.", "etc.", "end.", 'said."', "U.S.", "stop!", "why?", "—", "x2", "...", "it's", "co-op", "p."]
    return [" ".join(rng.choices(words, weights=[9, 9, 1, 1, 2, 1, 1, 1, 1, 1, 9, 1, 3, 3, 1], k=rng.choice([0, 3, 30, 90, 200]))) for _ in range(n)]


def test_chunks_and_pieces(spark):
    docs = [(d, cleaning.place_blocks([("paragraph", t) for t in texts(d, 6) if t])) for d in range(5)] + [(9, cleaning.place_blocks([("paragraph", "— —"), ("paragraph", "one")]))]
    rows = [(d, i, b.text, b.start, b.word_count) for d, bs in docs for i, b in enumerate(bs)]
    blocks = spark.createDataFrame(rows, "doc_id long, idx long, text string, start long, word_count long")
    for target in (1, 7, 25, 140):
        want = sorted((d, i, at, n) for d, i, t, _, k in rows for at, n in cleaning.split_block(t, k, target) if n)
        assert sorted(map(tuple, segments.pieces(blocks, target).select("doc_id", "idx", "start", "word_count").collect())) == want
    got = sorted((r["doc_id"], r["chunk"], r["start_word"], r["word_count"]) for r in segments.chunks(blocks, 25).collect())
    want = []
    for d, bs in docs:
        clean = "\n\n".join(b.text for b in bs)
        want += [(d, i, c.start_word, c.word_count) for i, c in enumerate(cleaning.chunks(clean, bs, 25))]
    assert got == sorted(want)


def test_chunks_hold_the_text_once(spark):
    lines = spark.createDataFrame([(1, 0, "one two three. four five six"), (1, 1, "seven eight"), (2, 0, "x")], "doc_id long, idx long, text string")
    got = segments.chunks(documents.place(lines), 3).orderBy("doc_id", "chunk").collect()
    assert [(r["doc_id"], r["start"], r["end"], r["start_word"], r["word_count"]) for r in got] == [(1, 0, 15, 0, 3), (1, 15, 30, 3, 3), (1, 30, None, 6, 2), (2, 0, None, 0, 1)]


def test_no_blocks(spark):
    none = spark.createDataFrame([], "doc_id long, idx long, text string, start long, word_count long")
    assert segments.chunks(none).count() == 0 and segments.pieces(none).count() == 0


def test_chunks_take_no_rounds_of_their_own(spark, monkeypatch):
    lines = spark.createDataFrame([(1, 0, "one two three. four five six seven"), (None, 0, "x y z w")], "doc_id long, idx long, text string")
    monkeypatch.setattr(type(lines), "checkpoint", lambda *_, **__: pytest.fail("rows are kept between rounds"))
    made = segments.chunks(documents.place(lines), 3)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = made.orderBy("doc_id", "chunk").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 15, 0, 3), (1, 1, 15, 29, 3, 3), (1, 2, 29, None, 6, 1)]


def test_slices_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(batches, "ROWS", 10)
    monkeypatch.setattr(batches, "BYTES", 300)
    texts = ["x" * (i * 37 % 90) for i in range(100)] + [None, "y" * 1000]
    parts = list(batches.slices((pa.array(texts), pa.array(range(102)))))
    assert [t for a, _ in parts for t in a.to_pylist()] == texts and [i for _, b in parts for i in b.to_pylist()] == list(range(102))
    assert all(len(a) == 1 or len(a) <= 10 and a.nbytes + b.nbytes <= 300 for a, b in parts)
