"""Benchmark decontamination by greedy string tiling.

A test item is in a document if tiles, runs of SHINGLE words or more that both have, cover at least COVERAGE of its words.
Greedy string tiling repeatedly marks the longest match that overlaps nothing marked before (ties: first in the item,
then first in the document). Tiles may lie in any order, so reordered passages count.

Seeds, runs of SHINGLE words, are hashed by a running Karp-Rabin hash and joined. Of an item only the seeds around a
stretch of words are needed, one word longer than what may stay uncovered: if none of these seeds is in a document, the
stretch is uncovered, and so the item isn't in it. The stretch whose seeds are rarest among the items is taken. A bitmap
of these seeds, of at most 2^BITS bits, goes to all tasks; documents without a seed in it are done after one pass,
unshuffled. The others are joined with the items that they share a seed with, by the seeds' hashes, and each different
text among them is tiled once, word by word, so that equal hashes alone never count.

The benchmark stays a table: nothing but the bitmap grows with it on the driver, and that up to its bound.

Defined results: words are runs of letters and digits, lower-cased; null and empty texts match nothing; an item with
fewer words than a seed is contained where all its words stand in a row; items without words match nothing; items that
repeat are reported under each of their ids; an empty benchmark gives no rows; repeated documents are reported as often
as they come. Columns other than doc_id and text (documents) and item_id and text (benchmark) are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SENT_BYTES, cut, sent, text_key

SHINGLE, COVERAGE = 5, 0.8
#: Bits of the bitmap for each seed, and its size at most (8 MB).
SPARSE, BITS = 256, 26
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
ITEM = "struct<item_id:long,coverage:double,tiles:int,longest:int>"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def numbers(own: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))


def karp_rabin(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k numbers, modulo 2^64: h(i) = k * base^k + sum of ids[i + j] * base^(k - 1 - j)."""
    if len(ids) < k:
        return np.empty(0, np.uint64)
    h = np.full(len(ids) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * _BASE + ids[j : len(ids) - k + 1 + j]
    return h


def needed(size: int, coverage: float) -> int:
    """Words of an item that tiles have to cover."""
    return max(1, math.ceil(coverage * size - 1e-9))


def stretch(seen: list[int], size: int, least: int, coverage: float) -> range:
    """Positions of the seeds around the stretch of words whose seeds occur least (seen, by position); the first if several."""
    k = min(least, size)
    r = size - needed(size, coverage) + 1
    total = np.r_[0, np.cumsum(seen)]
    bounds = [(max(0, a - k + 1), min(size - k, a + r - 1) + 1) for a in range(size - r + 1)]
    return range(*min(bounds, key=lambda b: (total[b[1]] - total[b[0]], b)))


def matches(item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Maximal matches of k words or more: (length, item position, document position), in time of the seeds' hits.

    Hits are taken up by item position. Of a run of hits only its beginning is kept, at the place in the document that it
    has come to, so memory grows with the document alone.
    """
    seeds, own = karp_rabin(item, k), karp_rabin(doc, k)
    order = np.argsort(own, kind="stable")
    low, high = np.searchsorted(own[order], seeds, "left"), np.searchsorted(own[order], seeds, "right")
    start, last = np.zeros(len(own) + 1, np.int64), np.full(len(own) + 1, -2)
    out: list[tuple[int, int, int]] = []

    def end(t: int, places: np.ndarray) -> None:
        begun = start[places]
        out.extend(zip((t - begun + k).tolist(), begun.tolist(), (places - (t - begun)).tolist(), strict=True))

    before = np.empty(0, np.int64)
    for t in range(len(seeds)):
        at = order[low[t] : high[t]]
        if len(at):
            at = at[(doc[at[:, None] + np.arange(k)] == item[t : t + k]).all(1)]
        begun = np.where(last[at - 1] == t - 1, start[at - 1], t)  # a place before the first is the last one, never hit
        end(t - 1, before[~np.isin(before + 1, at)])
        start[at], last[at], before = begun, t, at
    end(len(seeds) - 1, before)
    return out


def tile(found: list[tuple[int, int, int]], least: int, item: int, doc: int) -> list[tuple[int, int, int]]:
    """Tiles (length, item position, document position) from maximal matches, longest first; item and doc: their sizes."""
    heap = [(-n, t, d) for n, t, d in found if n >= least]
    heapq.heapify(heap)
    in_item, in_doc = np.zeros(item, bool), np.zeros(doc, bool)
    tiles, left = [], item
    while heap and left >= least:
        n, t, d = heapq.heappop(heap)
        n = -n
        taken = in_item[t : t + n] | in_doc[d : d + n]
        if not taken.any():
            tiles.append((n, t, d))
            in_item[t : t + n] = in_doc[d : d + n] = True
            left -= n
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))  # what is left goes back, piece by piece
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, t + a, d + a))
    return tiles


def judge(doc: list[str], item: list[str], least: int = SHINGLE, coverage: float = COVERAGE) -> tuple[float, int, int] | None:
    """(coverage, tiles, longest tile) if the document's words hold the item."""
    number: dict[str, int] = {}
    own = np.array([number.setdefault(w, len(number) + 1) for w in item], np.uint64)
    ids = np.array([number.get(w, 0) for w in doc], np.uint64)
    k, need = min(least, len(item)), needed(len(item), coverage)
    found = matches(own, ids, k)
    touched = np.zeros(len(item), bool)
    for n, t, _ in found:
        touched[t : t + n] = True
    if touched.sum() < need:  # tiles cover no more than the matches do
        return None
    tiles = tile(found, k, len(item), len(doc))
    covered = sum(n for n, _, _ in tiles)
    return (covered / len(item), len(tiles), max(n for n, _, _ in tiles)) if covered >= need else None


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, words, ids): the different word sequences of the benchmark."""

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(words(t.as_py())) for t in b.column(1)], pa.string())], ["item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    own = rows.mapInArrow(parse, "item_id long, words string").where("words <> ''").groupBy("words").agg(F.sort_array(F.collect_list(F.coalesce("item_id", F.lit(-(1 << 63))))).alias("ids"))
    ids = F.transform("ids", lambda i: F.when(i != -(1 << 63), i))  # a null id is one too
    return own.select(text_key(F.col("words")).alias("item"), "words", ids.alias("ids"))


def _seeds(items: DataFrame, least: int, coverage: float) -> DataFrame:
    """(h, item): the seeds of each item of which a document that holds it has at least one."""

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = [t.as_py().split(" ") for t in b.column(1)]
            hs = [karp_rabin(numbers(w), min(least, len(w))).view("<i8").tolist() for w in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in own], pa.int32()), pa.array(hs, pa.list_(pa.int64()))], ["item", "size", "hs"])

    def chosen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            picked = []
            for size, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                places = stretch([x["seen"] for x in own], size, least, coverage)
                picked.append(sorted({own[i]["h"] for i in places}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(picked, pa.list_(pa.int64()))], ["item", "hs"])

    key = "item struct<a:bigint,b:bigint>"
    every = cut(items.select("item", "words").mapInArrow(hashed, f"{key}, size int, hs array<long>").select("item", "size", F.posexplode("hs").alias("at", "h")))
    seen = every.groupBy("h").agg(F.count_distinct("item").alias("seen"))
    own = every.join(seen, "h").groupBy("item", "size").agg(F.sort_array(F.collect_list(F.struct("at", "seen", "h"))).alias("own"))
    return own.select("item", "size", "own").mapInArrow(chosen, f"{key}, hs array<long>").select(F.explode("hs").alias("h"), "item")


class Bitmap:
    """Which hashes may be seeds: two bits for each."""

    def __init__(self, seeds: DataFrame, n: int):
        bits = min(BITS, max(10, (SPARSE * n - 1).bit_length()))
        self.mask = (1 << bits) - 1
        places = seeds.select(F.explode(F.array(F.col("h").bitwiseAND(self.mask), F.shiftrightunsigned("h", 32).bitwiseAND(self.mask))).alias("p"))
        word = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("bits"))
        rows = word.toArrow()  # at most a row for each 64 bits of the bitmap
        self.words = np.zeros(max(1, (self.mask + 1) >> 6), np.uint64)
        self.words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)

    def filter(self, h: np.ndarray) -> np.ndarray:
        for shift in (0, 32):
            p = (h >> np.uint64(shift)) & np.uint64(self.mask)
            h = h[(self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
        return h


def _contained(docs: DataFrame, benchmark: DataFrame, least: int, coverage: float) -> tuple[DataFrame, DataFrame] | None:
    """(doc_id, key) of documents that have a seed, and (key, items) of the texts among them that hold items."""
    items = cut(_items(benchmark))
    seeds = cut(_seeds(items, least, coverage))
    n = seeds.count()
    if not n:
        return None
    bitmap = Bitmap(seeds, n)
    sizes = sorted(r[0] for r in items.select(F.least(F.size(F.split("words", " ")), F.lit(least)).alias("k")).distinct().collect())  # least of them at most

    def hit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, found = [], []
            for i, t in enumerate(b.column(1)):
                ids = numbers(words(t.as_py()))
                own = np.unique(np.concatenate([bitmap.filter(karp_rabin(ids, k)) for k in sizes]))
                if len(own):
                    at.append(i)
                    found.append(own.view("<i8"))
            if at:
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text", "hs"])

    def tiled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, out = [], []
            for key, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                doc = words(text)
                found = [(i, *x) for o in own if (x := judge(doc, o["words"].split(" "), least, coverage)) for i in o["ids"]]
                if found:
                    keys.append(key)
                    out.append([dict(zip(("item_id", "coverage", "tiles", "longest"), y, strict=True)) for y in sorted(found, key=lambda y: (y[0] is not None, y))])
            if keys:
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("longest", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(out, kind)], ["key", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = cut(texts.mapInArrow(hit, "doc_id long, text string, hs array<long>").withColumn("key", text_key(F.col("text"))))
    different = some.groupBy("key").agg(F.first("text").alias("text"), F.first("hs").alias("hs"))
    pairs = different.select("key", F.explode("hs").alias("h")).join(sent(seeds), "h").select("key", "item").distinct()
    size = items.agg(F.sum(F.octet_length("words") + F.size("ids") * 8 + 64)).first()[0]
    own = pairs.join(F.broadcast(items) if size <= SENT_BYTES else items, "item").groupBy("key").agg(F.collect_list(F.struct("words", "ids")).alias("own"))
    held = different.select("key", "text").join(own, "key").mapInArrow(tiled, f"key struct<a:bigint,b:bigint>, items array<{ITEM}>")
    return some.select("doc_id", "key"), cut(held)


def contaminations(docs: DataFrame, benchmark: DataFrame, least: int = SHINGLE, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, items): for each contaminated document an array of (item_id, coverage, tiles, longest) by item_id."""
    both = _contained(docs, benchmark, least, coverage)
    if both is None:
        return docs.sparkSession.createDataFrame([], f"doc_id long, items array<{ITEM}>")
    return both[0].join(sent(both[1], 512), "key").select("doc_id", "items")


def remove(docs: DataFrame, benchmark: DataFrame, least: int = SHINGLE, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no item; a text's key decides on all rows that have it."""
    both = _contained(docs, benchmark, least, coverage)
    if both is None:
        return docs
    packed = docs.select(text_key(F.col("text").cast("string")).alias("key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return packed.join(sent(both[1].select("key")), "key", "left_anti").select("row.*")
