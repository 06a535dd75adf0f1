"""Source divergence audit: how far each source of a language departs from each other one, and in which terms.

Tasks find the terms of whole batches of texts in their UTF-8 buffers (slices.py), count them in a sparse matrix of
documents by terms, and send sums by language, source and term, so no text is shuffled. Terms of fewer than MIN_DOCS
documents of a language go. A group (a source of a language) gives a term that occurs count times in it the share
p = 1 + floor(SCALE * (count + 1) / (N + V)); a pair of groups diverges by the sum of floor((p - q)^2 / q) over all V
kept terms of the language, most of which neither group has. That sum is put together from three parts:

- V times what a term gives that neither has;
- for the terms of one group, what the term gives beyond this as if the other hadn't it: that depends on the count
  alone, so it is taken from a histogram of counts, not from the terms;
- for terms that both have, what is still wrong: from sparse rows (a term with its sources), cut into pieces of bounded
  size, pair by pair, summed with reduceat.

All numbers are whole: products of counts are decimals, squares stay below 2^63 since p is at most SCALE + 1. Exact up to
9e15 words a group. The sources that one term of a language occurs in are held in a task at once, as numbers; the pairs
of sources of a language are the result. Null text, lang and source are ''. Without documents there are no rows; groups
without terms have pairs alone. Repeated rows count each. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import cut, sent_by_width
from lectern.llm.slices import chunks, grouped, lookup, slices, sums, words

SCALE, MIN_DOCS, TOP = 1_000_000_000, 3, 200
#: All bytes of ASCII but letters.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalpha())
#: Pairs of sources that are worked on at once.
PAIRS = 1 << 20


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows of docs that have the term."""
    table = lookup(SEPARATORS)
    names = ["lang", "source", "term", "n", "docs"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for low, high in chunks(b.column(2)):
                part = b.slice(low, high - low)
                s = slices(part.column(2), table)
                if not len(s.start):
                    continue
                of, first = grouped(s)
                number: dict[tuple[str, str], int] = {}
                group = np.array([number.setdefault(k, len(number)) for k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)])
                # documents by terms, then groups by terms
                cell, n = np.unique(s.text * len(first) + of, return_counts=True)
                cell, n, rows = sums(group[cell // len(first)] * len(first) + cell % len(first), n, np.ones_like(n))
                g, term = cell // len(first), cell % len(first)
                langs, sources = (pa.array([k[i] for k in number], pa.string()).take(pa.array(g)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([langs, sources, words(s, first).take(pa.array(term)), pa.array(n, pa.int64()), pa.array(rows, pa.int64())], names)

    parts = _named(docs).mapInArrow(batches, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def share(n: Column, size: Column, v: Column) -> Column:
    """p of a term with n occurrences in a group of size occurrences of v terms; v is above 0."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.call_function("div", whole, (size + v).cast("decimal(19,0)")) + 1


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shared(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value) from rows (lang, term, source, p, p0): what terms that both have add to a pair.

    Rows of a term come together; p0 is the share of a term that the source hasn't.
    """

    def pairs(new: np.ndarray, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[str, str], int] = {}
        who = np.array([number.setdefault(k, len(number)) for k in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)])
        p, p0 = (np.asarray(part.column(c)) for c in ("p", "p0"))
        at = np.flatnonzero(new)  # row pointers
        size = np.diff(np.r_[at, len(who)])
        begin, width = np.repeat(at, size), np.repeat(size, size)
        until = np.cumsum(width)
        bounds = np.unique(np.r_[0, np.flatnonzero(np.diff(until // PAIRS)) + 1, len(who)])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            w = width[a:b]
            i = np.repeat(np.arange(a, b), w)
            j = np.repeat(begin[a:b], w) + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
            i, j = i[i != j], j[i != j]
            if not len(i):
                continue
            own, other, own0, other0 = p[i], p[j], p0[i], p0[j]
            value = (own - other) ** 2 // other - (own - other0) ** 2 // other0 - (own0 - other) ** 2 // other + (own0 - other0) ** 2 // other0
            key, value = sums(who[i] * len(number) + who[j], value)
            langs, names = pa.array([k[0] for k in number], pa.string()), pa.array([k[1] for k in number], pa.string())
            g, h = pa.array(key // len(number)), pa.array(key % len(number))
            yield pa.RecordBatch.from_arrays([langs.take(g), names.take(g), names.take(h), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in it:
            table = pa.Table.from_batches([*held, b]).combine_chunks()
            new = _begins(table)
            last = int(np.flatnonzero(new)[-1])  # the last term may go on in the next batch
            if last:
                yield from pairs(new[:last], table.slice(0, last).combine_chunks().to_batches()[0])
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from pairs(_begins(table), table.to_batches()[0])

    return rows.mapInArrow(batches, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _begins(table: pa.Table) -> np.ndarray:
    """Where a row's lang or term isn't that of the row before."""
    new = np.ones(table.num_rows, bool)
    for i, c in enumerate(("lang", "term")):
        column = table.column(c)
        differs = np.asarray(pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)))
        new[1:] = differs if not i else new[1:] | differs
    return new


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of all pairs of sources of a language, and of each group's top terms.

    Part pair: item is the other source. Part term: item is a term that the group uses more than its language does.
    """
    same = W.partitionBy("lang", "term")  # a row for each source
    kept = counted(docs).withColumn("total", F.sum("n").over(same)).withColumn("docs", F.sum("docs").over(same))
    kept = cut(kept.where(F.col("docs") >= min_docs).drop("docs"))
    langs = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_size"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = _named(docs).select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "v", "lang_size"])
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("size"), F.col("v")))))
    by_group = sent_by_width(groups)

    rated = kept.join(by_group, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("size"), F.col("v")))
    own = rated.withColumn("q", share(F.col("total"), F.col("lang_size"), F.col("v"))).where("p > q")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    other = by_group.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    neither = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * excess(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    # one row for each number of occurrences in a group, against each other group, in both directions
    histogram = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(by_group, ["lang", "source"])
    met = histogram.withColumn("p", share(F.col("n"), F.col("size"), F.col("v"))).select("lang", "source", "m", "p", "p0").join(other, "lang").where("source <> item")
    beyond = met.groupBy("lang", "source", "item").agg(
        F.sum(F.col("m") * (excess(F.col("p"), F.col("q0")) - excess(F.col("p0"), F.col("q0")))).alias("there"),
        F.sum(F.col("m") * (excess(F.col("q0"), F.col("p")) - excess(F.col("q0"), F.col("p0")))).alias("back"),
    )
    beyond = cut(beyond)
    one = beyond.select("lang", "source", "item", F.col("there").alias("value")).union(beyond.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    both = _shared(rated.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term"))
    pairs = neither.union(one).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.union(best)
