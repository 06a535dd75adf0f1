"""Quality classifier by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built, from blocks of good and of bad labelled text. A text is cut into blocks, every
block is compressed with both dictionaries, and the difference of the two sizes over the length of the text says which
kind it is like. A logistic curve, fitted on labelled rows that aren't in a dictionary, makes it a calibrated score.

Only the fit is on a bounded sample: at most ROWS labelled rows of each label, chosen by a hash of their doc_id. Every
second of them gives its whole text, in blocks, to the training of a dictionary on the driver; the others are measured
whole, where they are, for the curve. Scores read whole texts.

Defined results: a null text counts as empty, and an empty text gets the share of good rows; labels other than 0 and 1
or null are left out; rows that repeat don't matter, of several texts under one doc_id the first counts; without four
texts of both labels every score is 0.5 (kept). A row without a doc_id is scored like any other; it can't have a label,
so it counts as not held out. No rows give none. Columns other than doc_id and text (documents) and doc_id and quality
(labels) are passed through, but for one that bears the score's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import cut, sample

BLOCK, DICTIONARY, LEVEL = 2048, 112_640, 3
ROWS = 2000


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def _dictionary(blocks: list[bytes], seed: int) -> bytes:
    np.random.default_rng(seed).shuffle(blocks)
    size = min(DICTIONARY, sum(map(len, blocks)) // 4)
    try:
        return zstandard.train_dictionary(size, blocks, level=LEVEL, threads=0).as_bytes()
    except zstandard.ZstdError:  # too few or too equal blocks for training: their bytes themselves
        return b"".join(blocks)[-DICTIONARY:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kept = zstandard.ZstdCompressionDict(dictionary)
    kept.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_dict_id=False)


@dataclass(frozen=True)
class Model:
    """Dictionaries and the weights of the curve; a few hundred KB whatever the input."""

    good: bytes
    bad: bytes
    weights: tuple[float, float]
    base: float

    def scorer(self):
        if not self.good:
            return lambda text: 0.5
        good, bad = _compressor(self.good), _compressor(self.bad)
        a, b = self.weights

        def score(text: str | None) -> float:
            raw = (text or "").encode("utf-8", "replace")
            if not raw:
                return self.base
            return float(1 / (1 + np.exp(-np.clip(a * difference(raw, good, bad) + b, -30, 30))))

        return score


def difference(raw: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    return sum(len(bad.compress(block)) - len(good.compress(block)) for block in _blocks(raw)) / (len(raw) + 64)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    mean, spread = x.mean(), x.std() + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * len(x) * np.eye(2)
        w -= np.linalg.solve(h, z.T @ (p - y) + 1e-3 * len(x) * w)
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """A model of the labelled rows that aren't held out.

    The labels choose: at most rows of each label, the first by a hash of their doc_id. Those few ids go to the
    documents, so only texts of the sample are shuffled. To the driver come the texts of rows labelled rows at most, and
    a number for each other text of the sample.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).distinct()
    n = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    first = [sample(marked.where(F.col("quality") == q), rows, n.get(q, 0), "id") for q in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]))  # 2 * rows pairs of numbers at most
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text")).where("octet_length(text) > 0")
    found = texts.join(chosen, "id").groupBy("quality", "id").agg(F.min("text").alias("text"))
    turn = F.row_number().over(W.partitionBy("quality").orderBy(F.xxhash64("id"), "id")) % 2  # of the sample, 2 * rows at most
    kept = cut(found.withColumn("turn", turn))

    texts = sorted(map(tuple, kept.where("turn = 1").select("quality", "id", "text").collect()))
    by = {q: [block for r in texts if r[0] == q for block in _blocks(bytes(r[2]))] for q in (0, 1)}
    sizes = {(r["quality"], r["turn"]): r["n"] for r in kept.groupBy("quality", "turn").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get((q, t), 0) for q in (0, 1) for t in (0, 1)) < 2:
        return Model(b"", b"", (0.0, 0.0), 0.5)
    good, bad = _dictionary(by[1], 1), _dictionary(by[0], 0)

    def measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pressed = _compressor(good), _compressor(bad)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([difference(t.as_py(), *pressed) for t in b.column(1)], pa.float64())], ["quality", "x"])

    rest = sorted(map(tuple, kept.where("turn = 0").select("quality", "text").mapInArrow(measured, "quality int, x double").collect()))
    base = sum(v for (q, _), v in sizes.items() if q) / sum(sizes.values())
    return Model(good, bad, _logistic(np.array([r[1] for r in rest]), np.array([float(r[0]) for r in rest])), base)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): the documents with all their columns in one, no shuffle, each row on its own."""
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].cast("string").alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t.as_py()) for t in b.column(1)], pa.float64())], ["row", "score"])

    return packed.mapInArrow(batches, f"row {packed.schema['row'].dataType.simpleString()}, score double")


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1; a column of theirs that bears its name is replaced."""
    rest = [c for c in docs.columns if c != name]
    return _scored(docs.select(*(docs[c] for c in rest)), model).select("row.*", F.col("score").alias(name))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that the classifier doesn't reject."""
    return _scored(docs, fit(docs, labels)).where(F.col("score") >= least).select("row.*")
