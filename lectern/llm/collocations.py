"""Phrase collocations: word sequences that occur far more often than their parts suggest, for each language.

Phrases are counted by pivot partitioning. Words are counted first. Then every occurrence of a word is a pivot with the
fragment around it: up to two words to either side, as far as they stand in the same piece of text and are more frequent
than the pivot. A phrase belongs to its rarest word, of equal ones to the first, so the fragments of a pivot hold all
occurrences of the phrases that it owns and no other phrase is mined there. Fragments that are equal are summed in each
chunk of texts before they are sent, words that are too rare for any phrase cut them short, and a frequent word has few
more frequent neighbours, so no pivot gathers much. Each task takes its pivots in order, a bounded number of fragments at
a time, counts with sorted keys and reduceat, and passes on what reaches the least count; a pivot whose fragments don't
fit at once passes on its partial counts, which are summed afterwards.

Words are numbered in the order of frequency by a table that all tasks get: the most frequent TABLE words of up to LONG
bytes. Words beyond it, if they may be frequent enough, count as rarer than those in it, in the order of a hash, and
travel as text. Which word is the pivot never changes a count.

Defined results: null text is empty, null lang is UNKNOWN; texts without words give nothing; rows that repeat count each;
no rows give none. Other columns aren't looked at. Scores are exact: products are decimals, counts below 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import cut, sent_by_width
from lectern.llm.slices import Slices, chunks, grouped, lookup, slices

LEAST, COVERED, TOP = 10, 50, 2000
UNKNOWN = "und"
_ENDS, _SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
WORD_BYTES, PIECE_ENDS = lookup(_ENDS + _SPACES), ~lookup(_ENDS)
#: Words in the table and their longest, in bytes: 60 MB at most. Steps of frequency to a factor of two.
TABLE, LONG, _STEPS = 1 << 20, 32, 8
#: Fragments that a task holds at once.
HELD = 1 << 20
#: Order of words: those outside the table by a hash below _FIRST, those in it by their number from there.
_FIRST, _GAP = 1 << 62, -1


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["lang"].cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def _parts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Slices, np.ndarray, np.ndarray, list[bytes]]]:
    """Of each chunk of texts: languages, words, the number of each word's language and word (pair), and the pairs' names."""
    for b in it:
        for low, high in chunks(b.column(1)):
            part = b.slice(low, high - low)
            s = slices(part.column(1), WORD_BYTES)
            if len(s.start):
                of, first = grouped(s)
                langs = part.column(0).dictionary_encode()
                code = np.asarray(langs.indices)[s.text].astype(np.int64)
                pairs, pair = np.unique(code * len(first) + of, return_inverse=True)
                own = first[pairs % len(first)]
                names = [s.raw[x:y] for x, y in zip(s.start[own].tolist(), s.end[own].tolist(), strict=True)]
                yield np.array(langs.dictionary.to_pylist(), object)[pairs // len(first)].tolist(), s, pair, np.bincount(pair, minlength=len(pairs)), names


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of all words."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, _, _, n, names in _parts(it):
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "f"])

    return _named(docs).mapInArrow(batches, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


@dataclass
class Table:
    """The most frequent words by number, from the rarest: their languages, bytes and hashes; bounded by TABLE and LONG."""

    langs: list[str]
    words: list[bytes]
    seed: int
    codes: np.ndarray
    order: np.ndarray
    complete: bool

    @staticmethod
    def of(langs: list[str], words: list[bytes], complete: bool) -> Table:
        seed = 0
        while True:  # until no two words have the same hash
            codes = np.array([Table.code(a, w, seed) for a, w in zip(langs, words, strict=True)], np.uint64)
            order = np.argsort(codes)
            if not (np.diff(codes[order]) == 0).any():
                return Table(langs, words, seed, codes[order], order, complete)
            seed += 1

    @staticmethod
    def code(lang: str, word: bytes, seed: int) -> int:
        return xxhash.xxh64_intdigest(word + b" " + lang.encode(), seed)

    def ranks(self, langs: list[str], words: list[bytes]) -> np.ndarray:
        """The place of each word in the order of frequency; _GAP for words that no phrase can have."""
        codes = np.array([self.code(a, w, self.seed) for a, w in zip(langs, words, strict=True)], np.uint64)
        at = np.searchsorted(self.codes, codes)
        number = self.order[np.minimum(at, len(self.order) - 1)] if len(self.order) else np.zeros(len(at), np.int64)
        out = (codes >> np.uint64(2)).astype(np.int64)
        for i, (lang, word, n) in enumerate(zip(langs, words, number.tolist(), strict=True)):
            if len(self.words) and self.words[n] == word and self.langs[n] == lang:
                out[i] = _FIRST + n
            elif self.complete and len(word) <= LONG:
                out[i] = _GAP
        return out


def table(words: DataFrame, least: int, size: int = TABLE) -> Table:
    """The table of the most frequent of the words (lang, word, f) of least or more occurrences."""
    short = words.where(F.octet_length("word") <= LONG).withColumn("step", F.floor(F.log2("f") * _STEPS))
    floor, total, complete = None, 0, True
    for r in short.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # 64 * _STEPS at most
        total += r["n"]
        if total > size:
            complete = False
            break
        floor = r["step"]
    rows = short.where(F.lit(False) if floor is None else F.col("step") >= floor).select("lang", F.col("word").cast("binary").alias("word"), "f").toArrow()
    own = sorted(zip(rows["f"].to_pylist(), rows["word"].to_pylist(), rows["lang"].to_pylist(), strict=True))
    return Table.of([r[2] for r in own], [r[1] for r in own], complete)


def fragments(docs: DataFrame, known) -> DataFrame:
    """(pivot, fragment, n): five numbers, the pivot in the middle, 0 for none; words outside the table follow as text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, s, pair, _, names in _parts(it):
            rank_of = known.value.ranks(langs, names)
            rank = rank_of[pair]
            ends = np.r_[0, np.cumsum(PIECE_ENDS[np.frombuffer(s.raw, np.uint8)], dtype=np.int32)]
            together = (s.text[1:] == s.text[:-1]) & (ends[s.start[1:]] == ends[s.end[:-1]]) & (rank[1:] != _GAP) & (rank[:-1] != _GAP)
            m = len(rank)
            none = np.zeros(m, bool)
            l1, l2, r1, r2 = (none.copy() for _ in range(4))
            l1[1:] = together & (rank[:-1] > rank[1:])
            l2[2:] = l1[2:] & together[:-1] & (rank[:-2] > rank[2:])
            r1[:-1] = together & (rank[1:] >= rank[:-1])
            r2[:-2] = r1[:-2] & together[1:] & (rank[2:] >= rank[:-2])
            own = np.flatnonzero(l1 | r1)
            if not len(own):
                continue
            # numbers of pairs from 1, two and three of them in one key
            bits = int(len(names)).bit_length()
            number = lambda there, by: np.where(there[own], pair[np.clip(own + by, 0, m - 1)] + 1, 0)  # noqa: B023, E731
            left = number(l2, -2) << bits | number(l1, -1)
            right = (pair[own] + 1) << 2 * bits | number(r1, 1) << bits | number(r2, 2)
            order = np.lexsort((left, right))
            left, right = left[order], right[order]
            at = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
            n = np.diff(np.r_[at, len(left)])
            mask = (1 << bits) - 1
            five = np.stack([left[at] >> bits, left[at] & mask, right[at] >> 2 * bits, right[at] >> bits & mask, right[at] & mask], 1)
            place = np.r_[0, np.where(rank_of >= _FIRST, rank_of - _FIRST + 1, -1)]
            packed = place[five].astype("<i4")
            raw = packed.tobytes()
            cells = [raw[i : i + 20] for i in range(0, len(raw), 20)]
            for i in np.flatnonzero((packed < 0).any(1)).tolist():
                cells[i] += b"".join(_text(langs[j - 1], names[j - 1]) for j in five[i].tolist() if j and place[j] < 0)
            pivot = rank_of[five[:, 2] - 1]
            yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(cells, pa.binary()), pa.array(n, pa.int64())], ["pivot", "fragment", "n"])

    return _named(docs).mapInArrow(batches, "pivot long, fragment binary, n long")


def _text(lang: str, word: bytes) -> bytes:
    """A word outside the table, with its language, lengths first."""
    own = lang.encode()
    return len(own).to_bytes(4, "little") + len(word).to_bytes(4, "little") + own + word


#: A fragment's phrases, as places in it; -1: none.
_PHRASES = ((1, 2, -1), (2, 3, -1), (0, 1, 2), (1, 2, 3), (2, 3, 4))


class _Miner:
    """Counts the phrases of fragments that come in the order of their pivots."""

    def __init__(self, known: Table, least: int):
        self.known, self.least = known, least

    def count(self, cells: list[bytes], n: np.ndarray, least: int) -> pa.RecordBatch:
        outside: dict[bytes, int] = {}
        texts: list[tuple[str, bytes]] = []
        five = np.frombuffer(b"".join(c[:20] for c in cells), "<i4").reshape(-1, 5).astype(np.int64)
        for i in np.flatnonzero((five < 0).any(1)).tolist():
            cell, at = cells[i], 20
            for j in np.flatnonzero(five[i] < 0).tolist():
                a, w = int.from_bytes(cell[at : at + 4], "little"), int.from_bytes(cell[at + 4 : at + 8], "little")
                key = cell[at : at + 8 + a + w]
                if key not in outside:
                    outside[key] = len(self.known.words) + len(outside) + 1
                    texts.append((key[8 : 8 + a].decode(), key[8 + a :]))
                five[i, j] = outside[key]
                at += len(key)
        size = len(self.known.words) + len(outside) + 1
        firsts, thirds, counts = [], [], []
        for a, b, c in _PHRASES:
            there = np.flatnonzero((five[:, a] > 0) & (five[:, b] > 0) & ((five[:, c] > 0) if c >= 0 else True))
            firsts.append(five[there, a] * size + five[there, b])
            thirds.append(five[there, c] if c >= 0 else np.zeros(len(there), np.int64))
            counts.append(n[there])
        two, three, n = np.concatenate(firsts), np.concatenate(thirds), np.concatenate(counts)
        order = np.lexsort((three, two))
        two, three, n = two[order], three[order], n[order]
        at = np.flatnonzero(np.r_[True, (two[1:] != two[:-1]) | (three[1:] != three[:-1])]) if len(two) else np.empty(0, np.int64)
        total = np.add.reduceat(n, at) if len(at) else n[:0]
        kept = at[total >= least]
        names = lambda i: texts[i - 1 - len(self.known.words)] if i > len(self.known.words) else (self.known.langs[i - 1], self.known.words[i - 1])
        x, y, z = ((two[kept] // size).tolist(), (two[kept] % size).tolist(), three[kept].tolist())
        word = lambda numbers: pa.array([names(i)[1] if i else None for i in numbers], pa.binary()).cast(pa.string())
        langs = pa.array([names(i)[0] for i in x], pa.string())
        return pa.RecordBatch.from_arrays([langs, word(x), word(y), word(z), pa.array(total[total >= least], pa.int64())], ["lang", "x", "y", "z", "a"])

    def run(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cells, counts, held, split = [], [], [], 0, False
        for b in it:
            pivots.append(np.asarray(b.column(0)))
            cells += b.column(1).to_pylist()
            counts.append(np.asarray(b.column(2)))
            held += b.num_rows
            if held < HELD:
                continue
            pivot, n = np.concatenate(pivots), np.concatenate(counts)
            last = int(np.searchsorted(pivot, pivot[-1]))  # that pivot may go on
            if last:
                # the first of these pivots may have passed on partial counts already
                begun = int(np.searchsorted(pivot, pivot[0], "right")) if split else 0
                if begun:
                    yield self.count(cells[:begun], n[:begun], 1)
                if last > begun:
                    yield self.count(cells[begun:last], n[begun:last], self.least)
                split = False
            else:
                last = len(cells)
                yield self.count(cells, n, 1)
                split = True
            pivots, cells, counts, held = [pivot[last:]], cells[last:], [n[last:]], len(cells) - last
            if not held and not split:
                pivots, counts = [], []
        if held:
            pivot, n = np.concatenate(pivots), np.concatenate(counts)
            begun = int(np.searchsorted(pivot, pivot[0], "right")) if split else 0
            if begun:
                yield self.count(cells[:begun], n[:begun], 1)
            if len(cells) > begun:
                yield self.count(cells[begun:], n[begun:], self.least)


def phrases(docs: DataFrame, words: DataFrame, least: int = LEAST, size: int = TABLE) -> DataFrame:
    """(lang, x, y, z, a): phrases of two words (z is null) and of three that occur least times or more."""
    known = docs.sparkSession.sparkContext.broadcast(table(words.where(F.col("f") >= least), least, size))
    dealt = fragments(docs, known).repartition("pivot").sortWithinPartitions("pivot")
    mined = dealt.mapInArrow(lambda it: _Miner(known.value, least).run(it), "lang string, x string, y string, z string, a long")
    return mined.groupBy("lang", "x", "y", "z").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def score(a: Column, left: Column, right: Column) -> Column:
    number = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * number(a) * number(a), number(left) * number(right))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, size: int = TABLE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words.

    A phrase is cut where it scores least. A phrase goes if a longer one that holds it has at least covered hundredths
    of its occurrences.
    """
    words = cut(word_counts(docs))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = cut(phrases(docs, words, least, size))
    often = sent_by_width(cut(words.where(F.col("f") >= least)))
    pairs = found.where("z is null").drop("z")
    pairs = pairs.join(often.withColumnsRenamed({"word": "x", "f": "fx"}), ["lang", "x"]).join(often.withColumnsRenamed({"word": "y", "f": "fy"}), ["lang", "y"])
    pairs = cut(pairs)
    threes = found.where("z is not null").join(pairs.select("lang", "x", "y", F.col("a").alias("fxy"), F.col("fx").alias("f1")), ["lang", "x", "y"])
    threes = threes.join(pairs.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("fyz"), F.col("fy").alias("f3")), ["lang", "y", "z"])
    threes = cut(threes.withColumn("s1", score(F.col("a"), F.col("f1"), F.col("fyz"))).withColumn("s2", score(F.col("a"), F.col("fxy"), F.col("f3"))))
    inside = threes.select("lang", "x", "y", "a").union(threes.select("lang", "y", "z", "a")).groupBy("lang", "x", "y").agg(F.max("a").alias("longer"))
    short = pairs.join(inside, ["lang", "x", "y"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
    two = short.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"), score(F.col("a"), F.col("fx"), F.col("fy")).alias("score"))
    first = F.col("s1") <= F.col("s2")
    three = threes.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("fxy")).alias("l"), F.when(first, F.col("fyz")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.union(three).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(sent_by_width(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
