"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a target of words, at most `most` times what it has; what is above is reshared by weight until no source
is above. A source's documents are all taken floor(target / size) times, and once more those whose hash lies below a
threshold: the thresholds of larger targets contain those of smaller ones. The threshold is found without sorting:
words are summed by source and hash bucket, only the bucket in which the budget ends is split into finer buckets, and so
on until a bucket is one hash value. The value at the boundary is taken if that comes nearer to the target.

The first level sums into 2^12 buckets of a source; each further level reads the documents of one bucket of a source only.

A document's hash is drawn from its doc_id, its text, its other columns and a number among the rows that are equal in all
of these, so rows that repeat, with or without a doc_id, are drawn one by one.

Defined results: a null text has no words; a null source is a source of its own and comes last; weights go round by the
order of the sources' code points; a document without words is taken as often as its hash says, at most floor(most)
times; without words every target is 0. No rows give none. Sources, a row for each, are ordered in one task. Columns
other than doc_id, text and source serve the hash alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import SENT_BYTES, cut, numbered, sent

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Bits of each level of buckets; they make up the hash.
LEVELS = (12, 16, 24)
BITS = sum(LEVELS)


def words(text: Column) -> Column:
    """The number of runs of other characters than 20 and 09-0D."""
    gone = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.octet_length(F.translate(gone, " \t\n\x0b\f\r", "")).cast("long")


def _rest(docs: DataFrame) -> Column:
    """A hash of the columns that the mix doesn't look at; maps by their JSON, as they have no hash."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    flat = [F.to_json(F.struct(docs[c])) if "map<" in docs.schema[c].dataType.simpleString() else docs[c] for c in others]
    return F.xxhash64(*flat).cast("string") if flat else F.lit("")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, row, text): rows of one key are equal in all columns."""
    key = F.concat_ws("/", F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")), _rest(docs))
    return docs.select("doc_id", docs["source"].cast("string").alias("source"), key.alias("key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].cast("string").alias("text"))


def drawn(key: Column, i: Column) -> Column:
    """52 bits of an MD5 digest for the i-th row of a key."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", key, i).cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sums: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) with target: sources by code point, null last, get weights in turn.

    Sources reach their cap in the order of cap over weight. Whoever is below the level at which the rest share what is
    left by weight is capped; one pass over the sources in that order finds all of them.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = sums.withColumn("w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", (F.col("source_size") * most).cast("double"))
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = (
        weighed.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("total") - (F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("cap")))
        .withColumn("w_left", F.sum("w").over(by.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("free", F.col("w") * F.col("left") / F.col("w_left") < F.col("cap"))
        .withColumn("rank", F.row_number().over(by))
    )
    first = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = F.min_by(F.struct("left", "w_left"), F.when(F.col("free"), F.col("rank"))).over(first)
    split = filled.withColumn("at", level)
    return split.select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("at.left") / F.col("at.w_left"))).alias("target"))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size, n): all that the mix needs, equal rows counted."""
    return keyed(docs).select("doc_id", "source", "key", words(F.col("text")).alias("size")).groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("n"))


def draws(counted: DataFrame) -> DataFrame:
    """(doc_id, source, size, h), one of each row."""
    return numbered(counted, "n", "i").select("doc_id", "source", "size", drawn(F.col("key"), F.col("i")).alias("h"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with times (whole rounds) and below: documents whose hash is less than it are taken once more."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    now = goals.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")).withColumn("low", F.lit(0).cast("long"))
    now = cut(now.withColumn("more", F.col("rest") > 0))
    spread = (lambda frame: F.broadcast(frame)) if _small(now, "source") else (lambda frame: frame)
    done = 0
    for bits in LEVELS:
        done += bits
        shift = BITS - done
        bucket = F.shiftright("h", shift)
        # the first level reads all rows, the next ones only those of each source's open bucket
        inside = rows if done == bits else rows.withColumn("open", F.shiftright("h", shift + bits)).join(spread(now.select(F.col("source").alias("_s"), F.shiftright("low", shift + bits).alias("_o"))), F.col("source").eqNullSafe(F.col("_s")) & (F.col("open") == F.col("_o")))
        sums = inside.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("s"))
        run = sums.withColumn("until", F.sum("s").over(W.partitionBy("source").orderBy("b")))
        ends = run.join(now.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s")))
        # the bucket in which the rest ends: the first with more than it; none if all fit
        over = ends.where(F.col("until") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("b", (F.col("until") - F.col("s")).alias("before"), "s"), "b").alias("e"))
        joined = now.join(over.select(F.col("source").alias("_s"), "e"), F.col("source").eqNullSafe(F.col("_s")), "left")
        fits = F.lit(1 << BITS) if done == bits else F.shiftleft(F.shiftright("low", shift + bits) + 1, shift + bits)
        now = cut(joined.select("source", "source_size", "target", "times", "more", (F.col("rest") - F.coalesce("e.before", F.lit(0))).alias("rest"), F.coalesce(F.shiftleft("e.b", shift), fits).alias("low"), F.col("e.s").alias("last")))
    # the value at the boundary itself, if taking it comes nearer
    nearer = F.col("last").isNotNull() & (F.col("last") - F.col("rest") < F.col("rest"))
    return now.select("source", "source_size", "target", "times", F.when(F.col("more"), F.col("low") + nearer.cast("long")).otherwise(0).alias("below"))


def plan(counted: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(_s, source_size, target, times, below) of each source, to be joined by _s; sent to all executors if it is small."""
    sums = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    found = cut(thresholds(draws(counted), targets(sums, weights, share, most)).withColumnRenamed("source", "_s"))
    return F.broadcast(found) if _small(found, "_s") else found


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): copies is how often the mix takes the document."""
    counted = cut(digest(docs))
    copies = F.col("times") + (F.col("h") < F.col("below")).cast("long")
    both = draws(counted).join(plan(counted, weights, share, most), F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", copies)
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _small(goals: DataFrame, source: str) -> bool:
    """Whether the row for each source goes to every executor; else sources and documents meet in a shuffle."""
    n, size = goals.agg(F.count("*"), F.sum(F.octet_length(source))).first()
    return n * 64 + (size or 0) <= SENT_BYTES


def apply(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The documents as the mix takes them: a document that it takes twice is two rows.

    The thresholds, a row for each source, decide on every document by its own hash; texts aren't shuffled unless there
    are so many sources that their rows are no table to send. Of rows that are equal in all columns one stands for all,
    with their number.
    """
    counted = cut(digest(docs))
    found = plan(counted, weights, share, most)
    every = keyed(docs).select("source", "key", "row")
    repeated = cut(counted.where("n > 1").select("key", "source"))
    of = lambda i: drawn(F.col("key"), i).alias("h")
    if repeated.isEmpty():
        rows = every.select("source", "row", of(F.lit(0)))
    else:
        same = [F.col("key") == F.col("_k"), F.col("source").eqNullSafe(F.col("_source"))]
        few = sent(repeated.select(F.col("key").alias("_k"), F.col("source").alias("_source")), 128)
        many = every.join(few, same, "left_semi").groupBy("key", "source").agg(F.first("row").alias("row"), F.count("*").alias("n"))
        rows = every.join(few, same, "left_anti").select("source", "row", of(F.lit(0))).union(numbered(many, "n", "i").select("source", "row", of(F.col("i"))))
    both = rows.join(found, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", F.col("times") + (F.col("h") < F.col("below")).cast("long"))
    return both.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
