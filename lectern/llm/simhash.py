"""SimHash near-duplicates, found with pigeonring filtering.

A document's fingerprint has 64 bits; bit i is set if more than half of its shingles' XXH64 values have it. Documents
link at RADIUS or fewer differing bits; linked documents form components.

Candidates. A fingerprint has four segments of 16 bits on a ring. For two fingerprints within three bits some segment
starts a chain whose first l segments differ in at most 3*l/4 bits together, for each l: 0, 1, 2, 3. The first segment
agrees, and as the second differs in one bit at most, one of its halves agrees too. So a fingerprint is filed eight
times, under 24 bits: which start, the segment there, and one half of the next. Within a file the chains prune what the
full comparison need not see. Only spanning links leave a file, not all pairs, so a group of copies costs rows in
proportion to its size; equal fingerprints are one entry from the start.

Large files. The bits outside a file's key are cut into four pieces; three differing bits leave one of them as it is, so
a file of more than DIRECT fingerprints is dealt out once for each piece, under its value, and again as long as files are
large. What a task still finds large it splits in the same way by the bits that differ in it. No link is lost at any size.

Defined results: null and blank texts have fingerprint zero; fewer words than a shingle hash as a whole; a null doc_id
is grouped but never names a component; repeated rows come out as often as they went in; no rows give none. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import components, cut, sent, text_key

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints of a file that are compared directly; larger files are split, without loss.
DIRECT = 4096
#: Bits outside the key of a file, and how many of them a piece has, as files are dealt out again and again.
PIECES = ((40, 10), (30, 8), (24, 6), (18, 5))
#: Shingles hashed at once: bounds the memory of a very long text.
_AT_ONCE = 65536


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    # bytes.lower() maps A-Z alone, bytes.split() splits at 20 and 09-0D alone: just the words asked for
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < k:
        return hashed(b" ".join(words), SEED)
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    for low in range(0, n, _AT_ONCE):
        line = b" ".join(words[low : low + _AT_ONCE + k - 1])
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
        h = np.array([hashed(line[s:e], SEED) for s, e in zip(starts, ends[k - 1 :], strict=False)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.fromiter((fingerprint(t.as_py(), k) for t in b.column(1)), "<u8", b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view("<i8"))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, "doc_id long, fp long")


def file_keys(fp: str) -> F.Column:
    """The eight files of a fingerprint: start * 2 + half in the high bits, then the 24 bits."""
    segment = lambda i: F.shiftrightunsigned(F.col(fp), 16 * (i % 4)).bitwiseAND(0xFFFF)
    keys = []
    for start in range(4):
        for half in range(2):
            rest = F.shiftrightunsigned(segment(start + 1), 8 * half).bitwiseAND(0xFF)
            keys.append(F.lit((start * 2 + half) << 24).cast("long") + F.shiftleft(segment(start), 8) + rest)
    return F.array(*keys)


def near(x: np.uint64, others: np.ndarray, start: int, radius: int = RADIUS) -> np.ndarray:
    """Which others are within radius of x, by the chain that begins at segment start; the chain only prunes."""
    d = others ^ x
    budget = lambda chain: radius * chain // 4
    total = np.zeros(len(d), np.uint8)
    alive = np.arange(len(d))
    for chain in range(1, 4):
        shift = np.uint64(16 * ((start + chain - 1) % 4))
        total[alive] += np.bitwise_count((d[alive] >> shift) & np.uint64(0xFFFF))
        alive = alive[total[alive] <= budget(chain)]
    out = np.zeros(len(d), bool)
    out[alive] = np.bitwise_count(d[alive]) <= radius
    return out


def spanning(fps: np.ndarray, start: int, radius: int = RADIUS, direct: int = DIRECT) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is linked among distinct fingerprints of one file; of a large file some come repeatedly."""
    if len(fps) > max(direct, 1 << radius):
        differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
        bits = [b for b in range(64) if differ >> b & 1]  # more than radius of them, or there were no so many numbers
        links = []
        for piece in range(radius + 1):
            # each piece holds bits that differ somewhere, so its groups are smaller than the file
            key = fps & np.uint64(sum(1 << b for b in bits[piece :: radius + 1]))
            order = np.argsort(key, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(group) > 1:
                    links += spanning(fps[group], start, radius, direct)
        return links
    links, left = [], fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left, start, radius)
            if hit.any():
                found, left = left[hit], left[~hit]
                links.append((np.full(len(found), x), found))
                queue.extend(found)
    return links


def _links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each file. The rows (key, sub, fp) come sorted by file; a file may go on in the next batch."""

    def out(links: list) -> Iterator[pa.RecordBatch]:
        if links:
            u, v = (np.concatenate(x) for x in zip(*links, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(u.view("<i8")), pa.array(v.view("<i8"))], ["u", "v"])

    def file(key: int, parts: list[np.ndarray]) -> list:
        fps = np.concatenate(parts)
        return spanning(fps, int(key >> 25)) if len(fps) > 1 else []

    held_key, held = None, []
    for b in it:
        if not b.num_rows:
            continue
        key, sub, fp = (np.asarray(b.column(i)) for i in range(3))
        fp = fp.view("<u8")
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(sub) != 0)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
        links: list = []
        if held_key == (key[0], sub[0]):
            held.append(fp[: ends[0]])
            starts, ends = starts[1:], ends[1:]
        if len(starts):
            if held_key is not None:
                links += file(held_key[0], held)
            for s, e in zip(starts[:-1], ends[:-1], strict=True):
                if e - s == 2:  # nearly all files that hold more than one
                    if int(fp[s] ^ fp[s + 1]).bit_count() <= RADIUS:
                        links.append((fp[s : s + 1], fp[s + 1 : e]))
                elif e - s > 2:
                    links += spanning(fp[s:e], int(key[s] >> 25))
            held_key, held = (key[starts[-1]], sub[starts[-1]]), [fp[starts[-1] : ends[-1]].copy()]
        yield from out(links)
    if held_key is not None:
        yield from out(file(held_key[0], held))


def _rest(key: str, fp: str) -> F.Column:
    """The 40 bits of a fingerprint that aren't in the key of its file: the other half, then the two segments after it."""
    start, half = F.shiftright(F.col(key), 25).cast("int"), F.shiftright(F.col(key), 24).bitwiseAND(1).cast("int")
    turned = F.array(*(F.shiftleft(F.col(fp), 64 - 16 * i).bitwiseOR(F.shiftrightunsigned(F.col(fp), 16 * i)) if i else F.col(fp) for i in range(4)))[start]
    other = F.shiftrightunsigned(turned, 16).bitwiseAND(0xFFFF)
    other = F.when(half == 0, F.shiftright(other, 8)).otherwise(other.bitwiseAND(0xFF))
    return other.bitwiseOR(F.shiftleft(F.shiftrightunsigned(turned, 32), 8))


def _pieces(width: int, size: int) -> F.Column:
    """For each piece of the remaining bits: the number of the file in its file, and what then remains."""
    out = []
    for p in range(4):
        low, high = p * size, min((p + 1) * size, width)
        value = F.shiftrightunsigned("rest", low).bitwiseAND((1 << (high - low)) - 1)
        rest = F.col("rest").bitwiseAND((1 << low) - 1).bitwiseOR(F.shiftleft(F.shiftrightunsigned("rest", high), low))
        out.append(F.struct((F.shiftleft("sub", size + 2) + (p << size) + value).alias("sub"), rest.alias("rest")))
    return F.array(*out)


def near_links(fps: DataFrame, direct: int = DIRECT) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that join all that is within RADIUS bits."""
    files = fps.select(F.explode(file_keys("fp")).alias("key"), F.lit(1).cast("long").alias("sub"), "fp")
    done = None
    for i, (width, size) in enumerate(PIECES):
        large = cut(files.groupBy("key", "sub").agg(F.count("*").alias("n")).where(F.col("n") > direct).select("key", "sub"))
        if large.isEmpty():
            break
        large = sent(large)
        small = files.join(large, ["key", "sub"], "left_anti").select("key", "sub", "fp")
        done = small if done is None else done.union(small)
        again = files.join(large, ["key", "sub"])
        rest = again.withColumn("rest", _rest("key", "fp")) if i == 0 else again
        files = cut(rest.select("key", "fp", F.explode(_pieces(width, size)).alias("to")).select("key", "to.sub", "to.rest", "fp"))
    files = files.select("key", "sub", "fp")
    dealt = (files if done is None else done.union(files)).repartition("key", "sub").sortWithinPartitions("key", "sub")
    return dealt.mapInArrow(_links, "u long, v long")


def _grouped(rows: DataFrame, rep: F.Column) -> DataFrame:
    """(fp, first): the first of all rep of a fingerprint's component."""
    distinct = rows.groupBy("fp").agg(F.min(rep).alias("rep"))
    found = components(near_links(distinct.select("fp")))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("first"))
    return rooted.select("fp", "root").join(named, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id among all documents that links reach."""
    rows = cut(fingerprints(docs, k))
    return rows.join(_grouped(rows, F.col("doc_id")), "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def hex_fingerprint(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _row_key(doc_id: F.Column, text: F.Column) -> F.Column:
    """Tells rows apart, in the order in which they are kept: those with a doc_id first."""
    return F.struct(doc_id.isNull().alias("nameless"), doc_id.cast("long").alias("id"), text_key(text.cast("string")).alias("text"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, one of each group of near copies: the one with the smallest doc_id.

    Rows are told apart by doc_id and text: near copies without a doc_id are one too (kept if no other has one), unrelated
    texts under one doc_id all stay, and of rows equal in both one stays. Texts aren't shuffled unless the rows that go
    are too many to be sent to all executors.
    """
    key = _row_key(F.col("doc_id"), F.col("text"))
    hashed = docs.select(key.alias("key"), F.col("doc_id"), F.col("text").cast("string").alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), "<u8", b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view("<i8"))], ["key", "fp"])

    rows = cut(hashed.select("key", "text").mapInArrow(batches, f"key {hashed.schema['key'].dataType.simpleString()}, fp long"))
    judged = rows.groupBy("fp", "key").agg(F.count("*").alias("n")).join(_grouped(rows, F.col("key")), "fp")
    # what needs a decision: rows that go, and rows of which one stays
    decided = cut(judged.where((F.col("key") != F.col("first")) | (F.col("n") > 1)).select("key", (F.col("key") == F.col("first")).alias("one")))
    packed = docs.select(key.alias("key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    single = packed.join(sent(decided.select("key"), 64), "key", "left_anti").select("row")
    repeated = cut(decided.where("one").select("key"))
    if repeated.isEmpty():
        return single.select("row.*")
    many = packed.join(sent(repeated, 64), "key").groupBy("key").agg(F.min_by("row", F.xxhash64(*(F.col("row")[c] for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()))).alias("row"))
    return single.union(many.select("row")).select("row.*")
