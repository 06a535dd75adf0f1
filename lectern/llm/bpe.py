"""Byte-level BPE with the ranks of a public tokenizer's file: texts to ids and back.

A text is cut by the pattern; each piece of it, a word with the space before it, becomes its rank if it has one. The
others are arrays of bytes, and a fold in higher-order functions merges the neighbours of the lowest rank, the first of
them if several have it, until no neighbours have a rank. Ranks are a literal: a table by pairs of ids, so that the fold
works on numbers alone. Decoding puts the pieces of the ids, byte strings of a literal, one after another.

Words recur, so most are merged once: words are counted over all texts, the distinct ones that are frequent enough for a
table of HEAD rows are folded, and the table goes to all executors. What isn't in it, a word that is rarer or longer than
LONG bytes, is folded where it stands, so the outcome is the same. No text is shuffled: the words of a text, one row each
behind a row that has the document's columns, stay in order from the scan until they are put together again.

The library that results are held against knows letters and digits of a newer Unicode than a JVM may, so those that the
JVM lacks are added to the pattern's classes; the pattern's white space is that of Unicode.

Defined results: a null text is empty, and an empty text has no ids; special tokens are ordinary text; rows that repeat
give the same again, no rows give none. Work on a word without a rank grows with the square of its length. A column that
bears the result's name is replaced, others are passed through.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut

#: Rows of the table of words that are folded once, and their longest, in bytes: below 200 MB.
HEAD, LONG = 1 << 20, 24
_NONE = 2**31 - 1
#: Steps of word frequencies to a factor of two.
_STEPS = 8


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@cache
def _class(name: str) -> str:
    """All characters of a class as the library's engine has it."""
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    one = tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return bytes(one.encode_ordinary(every)).decode()


def jvm_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern for Java's engine, with the letters and digits that the JVM's Unicode lacks."""
    parts = re.split(r"(\[(?:[^\]\\]|\\.)*\])", pattern)  # classes stand at odd places
    for name in ("L", "N"):
        lacking = spark._jvm.java.util.regex.Pattern.compile(rf"\p{{{name}}}+").matcher(_class(name)).replaceAll("")
        if lacking:
            codes = np.array([ord(c) for c in lacking])
            ends = np.flatnonzero(np.diff(codes) != 1)
            ranges = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(codes[np.r_[0, ends + 1]].tolist(), codes[np.r_[ends, len(codes) - 1]].tolist(), strict=True))
            more = rf"\p{{{name}}}[\x{{{codes[0]:x}}}-\x{{{codes[-1]:x}}}&&[{ranges}]]"
            parts = [p.replace(rf"\p{{{name}}}", more if i % 2 else f"[{more}]") for i, p in enumerate(parts)]
    return "(?U)" + "".join(parts)


@cache
def _halves(path: str) -> dict[bytes, tuple[bytes, bytes] | None]:
    """The two parts that merging the bytes of a piece ends with; None if it doesn't lead to the piece."""
    known, out = ranks(path), {}
    for piece in known:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            both = [known.get(a + b, _NONE) for a, b in pairwise(parts)]
            if (least := min(both)) == _NONE:
                break
            i = both.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(piece) > 1:
            out[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
    return out


@cache
def _pairs(path: str) -> tuple[int, list[int | None], list[int], list[int]]:
    """Ranks of pairs of ids, by displaced rows: the id of no piece, cells, where the row of each id begins, ids of the bytes.

    A cell is the first id of its pair before the pair's rank. A row holds the pairs of one first id, by the second one,
    and begins where all of its cells are free; rows share the space, so a cell is of a pair only if it names its first
    id. Where merging leads to every piece, as lower ranks come first, a piece is merged from its two halves alone;
    else all ways to cut it are kept.
    """
    known, halves = ranks(path), _halves(path)
    cuts = ((piece[:i], piece[i:]) for piece in known for i in range(1, len(piece))) if None in halves.values() else halves.values()
    rows: dict[int, dict[int, int]] = {}
    for a, b in cuts:
        if a in known and b in known:
            rows.setdefault(known[a], {})[known[b]] = known[a + b]
    end = max(known.values()) + 1
    bits = end.bit_length()
    if bits > 20:
        raise ValueError("ranks have to stay below a million")
    size = 64 + 3 * sum(map(len, rows.values())) // 2
    cells: list[int | None] = [None] * (size + end + 1)
    free, begin = np.ones(len(cells), dtype=bool), [0] * (end + 1)
    for first, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        seconds = np.fromiter(row, dtype=np.int64)
        for k in range(0, size, 64):
            starts = (first * 40503 + np.arange(k, k + 64)) % size
            fits = free[starts[:, None] + seconds].all(axis=1)
            if fits.any():
                break
        else:
            raise ValueError("no room for the pairs of an id")
        begin[first] = int(starts[fits.argmax()])
        free[begin[first] + seconds] = False
        for second, rank in row.items():
            cells[begin[first] + second] = (first << bits) + rank
    return end, cells, begin, [known[bytes([i])] for i in range(256)]


def _literal(value: object, kind: str) -> Column:
    """A constant of this type; Spark folds the parsing away when it plans."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out, and standing in the plan, once."""
    return F.transform(F.array(value), then)[0]


def merged(word: Column, path: str) -> Column:
    """Ids of a word (bytes as characters, not empty): the fold over its bytes.

    Its state are the parts between two ends, each a number: from the top the rank that the part has together with the
    next one, which is the id that they merge to, its place, and its own id. So the least number is the lowest rank, and
    the first of equal ones. A cell xor the first id is the rank of a pair if the cell is the pair's, and large (or null,
    which least() leaves out) if not.
    """
    last, *tables = _pairs(path)
    bits = last.bit_length()
    above = 62 - bits  # rank and one more bit
    end, none, one = F.lit(last).cast("long"), F.lit(1 << bits).cast("long"), F.lit(1 << bits).cast("long")
    mask, places = F.lit((1 << bits) - 1).cast("long"), F.lit((1 << above - bits) - 1).cast("long")

    def fold(cells: Column, begin: Column, single: Column) -> Column:
        def part(first: Column, second: Column, place: Column) -> Column:
            rank = F.least(cells[begin[first] + second].bitwiseXOR(F.shiftleft(first, bits)), none)
            return F.shiftleft(rank, above).bitwiseOR(F.shiftleft(place, bits)).bitwiseOR(first)

        def merge(parts: Column, _: Column) -> Column:
            def at(parts: Column, least: Column) -> Column:
                i = F.shiftright(least, bits).bitwiseAND(places)  # place from 0; the end before the word has 0
                own = F.shiftright(least, above)
                before, after = parts[i - 1].bitwiseAND(mask), parts[i + 2].bitwiseAND(mask)
                new = F.array(part(before, own, i - 1), part(own, after, i))
                rest = F.transform(F.slice(parts, i.cast("int") + 3, F.size(parts)), lambda p: p - one)
                return F.when(own >= none, parts).otherwise(F.concat(F.slice(parts, F.lit(1), i.cast("int") - 1), new, rest))

            return F.aggregate(F.array(F.array_min(parts)), parts, at)

        ids = F.concat(F.array(end), F.transform(F.split(word, ""), lambda c: single[F.ascii(c)]), F.array(end, end))
        start = _let(ids, lambda ids: F.transform(F.slice(ids, F.lit(1), F.size(ids) - 1), lambda a, i: part(a, ids[i + 1], i.cast("long"))))
        steps = F.slice(F.sequence(F.lit(1), F.length(word)), 2, F.length(word))
        return F.aggregate(steps, start, merge, lambda parts: F.transform(F.slice(parts, F.lit(2), F.size(parts) - 2), lambda p: p.bitwiseAND(mask).cast("int")))

    cells, begin, single = (_literal(t, "array<bigint>") for t in tables)
    return _let(cells, lambda c: _let(begin, lambda b: _let(single, lambda s: fold(c, b, s))))


def encoded(word: Column, path: str) -> Column:
    """Ids of a word of the pattern (string, not empty): its own rank, or those of its merged parts."""
    key = F.decode(word.cast("binary"), "ISO-8859-1")
    ids = merged(key, path)
    own = {piece.decode("latin-1"): [ranks(path)[piece]] for piece, halves in _halves(path).items() if halves is None}
    return F.coalesce(F.try_element_at(_literal(own, "map<string, array<int>>"), key), ids) if own else ids


def frequent(words: DataFrame, head: int = HEAD) -> DataFrame:
    """The words (word) that occur most, at most head of them and no longer than LONG bytes.

    Whole steps of frequency from the top, as many as the table holds; a word that occurs once saves nothing.
    """
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.octet_length("word") <= LONG))
    counts = cut(counts.select("word", F.floor(F.log2("n") * _STEPS).alias("step")))
    least, total = None, 0
    for r in counts.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # 64 * _STEPS at most
        total += r["n"]
        if total > head:
            break
        least = r["step"]
    return counts.where(F.lit(False) if least is None else F.col("step") >= least).select("word")


def _together(it: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a document, its columns and then ids of word after word, to one with all its ids, also packed if so named."""
    row: pa.Array | None = None
    held: list[np.ndarray] = []

    def made(rows: pa.Array, sizes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        bounds, numbers = np.r_[0, np.cumsum(sizes)].astype("<i4"), values.astype("<i4")
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(numbers))
        raw = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(4 * bounds), pa.py_buffer(numbers)])
        return pa.RecordBatch.from_arrays([rows, lists, raw][: len(names)], names)

    for b in it:
        rows, ids = b.column(0), b.column(1)
        at, offsets, values = np.flatnonzero(np.asarray(rows.is_valid())), np.asarray(ids.offsets), np.asarray(ids.values)
        if not len(at):
            held.append(values[offsets[0] : offsets[-1]])
            continue
        begin = offsets[at]
        if row is not None:
            whole = np.concatenate([*held, values[offsets[0] : begin[0]]])
            yield made(row, np.array([len(whole)]), whole)
        if len(at) > 1:
            yield made(rows.take(pa.array(at[:-1])), np.diff(begin), values[begin[0] : begin[-1]])
        row, held = rows.take(pa.array(at[-1:])), [values[begin[-1] : offsets[-1]]]
    if row is not None:
        whole = np.concatenate(held)
        yield made(row, np.array([len(whole)]), whole)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids", packed: str | None = None, head: int = HEAD, keep: list[str] | None = None) -> DataFrame:
    """The documents, or the columns of theirs to keep, with the ids of their text (array<int>).

    packed names a further column: the same ids as unsigned numbers of 32 bits, little-endian (binary).
    """
    words = F.regexp_extract_all(F.coalesce(docs[text].cast("string"), F.lit("")), F.lit(jvm_pattern(docs.sparkSession, pattern)), F.lit(0))
    table = frequent(docs.select(F.explode(words).alias("word")), head)
    table = cut(table.select("word", encoded(F.col("word"), path).alias("own")))

    # a document's first row has its columns and no word, so that texts without words have one as well; words are
    # exploded as they are found, as Spark filters a column that it explodes and would find them once more for that
    whole = F.struct(*(docs[c] for c in keep or docs.columns if c not in (name, packed)))
    each = docs.select(whole.alias("row"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), words)).alias("at", "word"))
    each = each.select(F.when(F.col("at") == 0, F.col("row")).alias("row"), "word")
    ids = F.when(F.col("word").isNull(), F.array().cast("array<int>")).when(F.col("own").isNotNull(), F.col("own")).otherwise(encoded(F.col("word"), path))
    rows = each.join(F.broadcast(table), "word", "left").select("row", ids.alias("ids"))
    kind = rows.schema["row"].dataType.simpleString()
    names = ["row", "ids", "packed"][: 3 if packed else 2]
    done = rows.mapInArrow(lambda it: _together(it, names), f"row {kind}, ids array<int>" + (", packed binary" if packed else ""))
    return done.select("row.*", F.col("ids").alias(name), *([F.col("packed").alias(packed)] if packed else []))


def _joined(ids: Column, pieces: list[bytes]) -> Column:
    """Byte strings by number, one after another; as strings, which are joined without a look at what is in them."""
    table = _literal([base64.b64encode(p).decode() for p in pieces], "array<binary>")
    return _let(table, lambda t: F.array_join(F.transform(ids, lambda i: t[i].cast("string")), "")).cast("binary")


def decode(ids: Column, path: str) -> Column:
    """The bytes (binary) of ids; ids that the file doesn't have give nothing."""
    known = {i: piece for piece, i in ranks(path).items()}
    return _joined(ids, [known.get(i, b"") for i in range(max(known) + 1)])
