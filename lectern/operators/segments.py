"""Chunks of long texts, cut one after another.

Each cut depends on the one before it. A long block is cut where it stands, by the kernel that walks through its units; the
pieces of a document are put together by a fold over its sorted rows, so no task holds more than a slice of blocks or a
batch of pieces, however long a document is, and no word becomes a row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import cleaning
from lectern.operators.batches import by_row
from lectern.operators.sessions import fold

_PIECES = "array<struct<start:long,word_count:long>>", pa.list_(pa.struct([("start", pa.int64()), ("word_count", pa.int64())]))


def _cut(blocks: DataFrame, target: int) -> DataFrame:
    """blocks (text, word_count, ...) with p (start, word_count), a row for each piece; only long texts go through Python."""

    def one(text: str | None, words: int | None) -> list[dict] | None:
        return None if text is None else [{"start": at, "word_count": n} for at, n in cleaning.split_block(text, words, target)]

    long = F.col("word_count") > target
    pieces = by_row(one, *_PIECES)(F.when(long, F.col("text")), F.col("word_count"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("word_count").cast("long").alias("word_count")))
    # the outer form: before the other one, Spark puts a filter that runs the kernel a second time
    return blocks.withColumn("_pieces", pieces).withColumn("p", F.explode_outer(F.coalesce("_pieces", whole))).drop("_pieces").where("p.word_count > 0")


def pieces(blocks: DataFrame, target: int = cleaning.CHUNK_WORDS) -> DataFrame:
    """(doc_id, idx, start, word_count) of pieces of blocks (doc_id, idx, text, word_count) of about target words.

    A block of more words is cut at spaces: behind the word that reaches the target, unless that is an abbreviation, or
    behind the last sentence before it if half the target remains. Pieces without words are left out.
    """
    return _cut(blocks.select("doc_id", "idx", "text", "word_count"), target).select("doc_id", "idx", "p.start", "p.word_count")


def chunks(blocks: DataFrame, target: int = cleaning.CHUNK_WORDS) -> DataFrame:
    """(doc_id, chunk, start, end, start_word, word_count): pieces put together until they have target words.

    blocks has doc_id, idx, text, start (of the block in its document) and word_count; start and end are places in the
    document, end is null for the last one, which takes what is left.
    """

    def step(state: tuple[int, int, int], row: tuple) -> tuple[tuple[int, int, int], tuple | None]:
        # words of all pieces so far, words of the open chunk, its number; a row as a chunk begins and one for the last piece
        (gone, words, chunk), (doc_id, start, n, last) = state, row
        first, full = words == 0, words + n >= target
        done = (gone + n, 0 if full else words + n, chunk + full)
        return done, (doc_id, chunk, start if first else None, gone if first else None, gone + n if last else None) if first or last else None

    own = _cut(blocks.where("doc_id is not null").select("doc_id", F.col("start").alias("_block"), "text", "word_count"), target)
    placed = own.select("doc_id", (F.col("_block") + F.col("p.start")).cast("long").alias("start"), F.col("p.word_count").alias("word_count"))
    order = W.partitionBy("doc_id").orderBy("start")
    placed = placed.withColumn("last", F.lead(F.lit(1)).over(order).isNull())
    kind = dict(placed.dtypes)["doc_id"]
    begun = fold(placed, "doc_id", ["start"], (0, 0, 0), step, f"doc_id {kind}, chunk long, start long, gone long, all long")
    begun = begun.groupBy("doc_id", "chunk").agg(F.max("start").alias("start"), F.max("gone").alias("gone"), F.max("all").alias("all"))
    order = W.partitionBy("doc_id").orderBy("chunk")
    after = F.coalesce(F.lead("gone").over(order), F.col("all"))
    return begun.select("doc_id", "chunk", F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(F.col("start")).alias("start"), F.lead("start").over(order).alias("end"), F.col("gone").alias("start_word"), (after - F.col("gone")).alias("word_count"))
