"""From raw text to documents with blocks, chunks and pages, and look-ups by word.

Every operator works inside one document: joins and windows carry the document's id, so they are hash joins with a range
condition left over, never products.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import cleaning, numbers, text
from lectern.operators.batches import by_row

_PLACE = [("start_word", "int"), ("word_count", "int")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def _struct(fields: list[tuple[str, str]]) -> tuple[str, pa.DataType]:
    """A struct of plain fields, to Spark and to Arrow."""
    return f"struct<{','.join(f'{n}:{t}' for n, t in fields)}>", pa.struct([(n, _TYPES[t]) for n, t in fields])


def _array(kind: tuple[str, pa.DataType]) -> tuple[str, pa.DataType]:
    return f"array<{kind[0]}>", pa.list_(kind[1])


#: The fields of a document, each with its type to Spark and to Arrow.
FIELDS = {
    "clean_text": ("string", pa.string()),
    "blocks": _array(_struct([("kind", "string"), ("text", "string"), ("start", "int"), ("end", "int"), *_PLACE])),
    "chunks": _array(_struct([("text", "string"), *_PLACE, ("language", "string")])),
    "word_count": ("int", pa.int32()),
    "language": ("string", pa.string()),
    "score": ("double", pa.float64()),
}


def prepared(raw: Column, source_blocks: Column | None = None, target: float = cleaning.CHUNK_WORDS, fields: Iterable[str] = FIELDS) -> Column:
    """A document of a raw text, all of it from one pass through Python: take its fields from a column that holds it.

    source_blocks, an array of (kind, text), keeps the kinds that a source has already told. Only the named fields are made.
    """
    fields = tuple(fields)

    def one(raw_text: str | None, given: list | None) -> dict:
        clean, blocks = cleaning.prepare(raw_text or "", [(b["kind"], b["text"]) for b in given] if given else None)
        words = sum(b.word_count for b in blocks)  # no word spans two blocks
        made = {
            "clean_text": lambda: clean,
            "blocks": lambda: [vars(b) for b in blocks],
            "chunks": lambda: [vars(c) for c in cleaning.chunks(clean, blocks, target)],
            "word_count": lambda: words,
            "language": lambda: cleaning.language(clean),
            "score": lambda: cleaning.incoherence(clean, words),
        }
        return {f: made[f]() for f in fields}

    none = F.lit(None).cast("array<struct<kind:string,text:string>>")
    kind = pa.struct([(f, FIELDS[f][1]) for f in fields])
    return by_row(one, f"struct<{','.join(f'{f}:{FIELDS[f][0]}' for f in fields)}>", kind)(raw, none if source_blocks is None else source_blocks)


def create_documents(texts: DataFrame, doc_id: str = "doc_id", raw: str = "text", source_blocks: str | None = None, given_status: str | None = None, target: float = cleaning.CHUNK_WORDS, fields: Iterable[str] = FIELDS) -> DataFrame:
    """(doc_id, clean_text, blocks, chunks, word_count, language, score, status) of each text.

    With fewer fields only these are made; the status needs word_count and score.
    """
    fields = tuple(fields)
    one = texts.select(F.col(doc_id).alias("doc_id"), prepared(F.col(raw), F.col(source_blocks) if source_blocks else None, target, fields).alias("d"), (F.col(given_status) if given_status else F.lit(None).cast("string")).alias("g"))
    rated = [text.quality_status(F.col("d.word_count"), F.col("d.score"), F.col("g")).alias("status")] if {"word_count", "score"} <= set(fields) else []
    return one.select("doc_id", "d.*", *rated)


def tokens(docs: DataFrame, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, word_index, word) of every word."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(text.words(F.col(column))).alias("word_index", "word")).withColumn("word_index", F.col("word_index").cast("long"))


def lines(docs: DataFrame, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, idx, text, prev_blank, next_blank): lines with what their neighbours tell; outside all is blank."""
    split = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(column, "\n")).alias("idx", "text"))
    w = W.partitionBy("doc_id").orderBy("idx")
    blank = lambda c: F.coalesce(text.js_trim(c) == "", F.lit(True))
    return split.withColumn("prev_blank", blank(F.lag("text").over(w))).withColumn("next_blank", blank(F.lead("text").over(w)))


def paragraphs(rows: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text): neighbouring lines that aren't blank, joined by spaces; islands of a running count."""
    w = W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = rows.withColumn("blank", text.js_trim(F.col("text")) == "").withColumn("paragraph", F.sum(F.col("blank").cast("int")).over(w))
    joined = marked.where(~F.col("blank")).groupBy("doc_id", "paragraph").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("text"))
    order = W.partitionBy("doc_id").orderBy("paragraph")
    return joined.withColumn("paragraph", F.row_number().over(order).cast("long") - 1)


def place(blocks: DataFrame, order: str = "idx") -> DataFrame:
    """blocks (doc_id, order, text) with start, end, start_word and word_count; two characters stand between blocks."""
    before = W.partitionBy("doc_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sized = blocks.withColumn("word_count", text.word_count(F.col("text")))
    started = sized.withColumn("start", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("long")).withColumn("start_word", F.coalesce(F.sum("word_count").over(before), F.lit(0)).cast("long"))
    return started.withColumn("end", F.col("start") + F.length("text"))


def integrity(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, valid): blocks in order and apart, with texts that stand in the clean text and words that add up.

    docs has doc_id, clean_text and word_count; blocks has doc_id, idx, text, start, end, start_word and word_count.
    """
    w = W.partitionBy("doc_id").orderBy("idx")
    flagged = blocks.join(docs.select("doc_id", "clean_text"), "doc_id").select(
        "doc_id", "word_count",
        (
            (F.col("start") >= F.coalesce(F.lag("end").over(w), F.lit(0)))
            & (F.expr("substring(clean_text, start + 1, end - start)") == F.col("text"))
            & (text.word_count(F.col("text")) == F.col("word_count"))
            & (F.col("start_word") == F.coalesce(F.lag(F.col("start_word") + F.col("word_count")).over(w), F.lit(0)))
        ).alias("ok"),
    )
    sums = flagged.groupBy("doc_id").agg(F.bool_and("ok").alias("ok"), F.sum("word_count").alias("n"))
    both = docs.select("doc_id", "word_count", text.word_count(F.col("clean_text")).alias("counted")).join(sums, "doc_id", "left")
    return both.select("doc_id", (F.coalesce("ok", F.lit(True)) & (F.coalesce("n", F.lit(0)) == F.col("word_count")) & (F.col("counted") == F.col("word_count"))).alias("valid"))


def chunk_integrity(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, valid): chunks that follow each other, none empty, with texts and a total that count as they say.

    docs has doc_id and word_count; chunks has doc_id, idx, text, start_word and word_count.
    """
    w = W.partitionBy("doc_id").orderBy("idx")
    follows = F.col("start_word") == F.coalesce(F.lag(F.col("start_word") + F.col("word_count")).over(w), F.lit(0))
    flagged = chunks.select("doc_id", "word_count", (follows & (F.col("word_count") > 0) & (text.word_count(F.col("text")) == F.col("word_count"))).alias("ok"))
    sums = flagged.groupBy("doc_id").agg(F.bool_and("ok").alias("ok"), F.sum("word_count").alias("n"))
    both = docs.select("doc_id", "word_count").join(sums, "doc_id", "left")
    return both.select("doc_id", (F.coalesce("ok", F.lit(True)) & (F.coalesce("n", F.lit(0)) == F.col("word_count"))).alias("valid"))


def with_blocks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, clean_text, blocks) whose missing or empty blocks are made anew from their clean text.

    Only those texts go through Python.
    """
    none = F.col("blocks").isNull() | (F.size("blocks") == 0)
    made = prepared(F.when(none, F.col("clean_text")), fields=("blocks",))["blocks"]
    return docs.withColumn("blocks", F.when(none, made).otherwise(F.col("blocks")))


def from_answers(answers: DataFrame) -> DataFrame:
    """Documents of reconstructed texts (doc_id, answer): always to be reviewed; those without words are left out."""
    made = create_documents(answers.where(F.col("answer").isNotNull()).withColumn("given", F.lit("needs-review")), raw="answer", given_status="given")
    return made.where("word_count > 0")


def even_pages(docs: DataFrame, capacity: float = cleaning.PAGE_WORDS) -> DataFrame:
    """(doc_id, page, start_word, end_word) of documents (doc_id, word_count) without blocks."""
    size = max(cleaning.LEAST_PAGE, int(capacity // 1))
    starts = docs.where("word_count > 0").select("doc_id", "word_count", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("word_count").cast("long") - 1, F.lit(size).cast("long"))).alias("page", "start_word"))
    return starts.select("doc_id", F.col("page").cast("long").alias("page"), "start_word", F.least(F.col("start_word") + size, F.col("word_count")).cast("long").alias("end_word"))


def paginate(docs: DataFrame, capacity: float = cleaning.PAGE_WORDS) -> DataFrame:
    """(doc_id, page, start_word, end_word) of documents with doc_id, word_count and blocks (an array)."""

    def one(blocks: list | None, words: int | None) -> list[dict]:
        return [{"start_word": s, "end_word": e} for s, e in cleaning.paginate([(b["kind"], b["start_word"], b["word_count"]) for b in blocks or ()], words or 0, capacity)]

    pages = by_row(one, *_array(_struct([("start_word", "int"), ("end_word", "int")])))
    slim = F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["start_word"].alias("start_word"), b["word_count"].alias("word_count")))  # without texts
    each = docs.select("doc_id", F.posexplode(pages(slim, F.col("word_count"))).alias("page", "p"))
    return each.select("doc_id", F.col("page").cast("long").alias("page"), F.col("p.start_word").cast("long").alias("start_word"), F.col("p.end_word").cast("long").alias("end_word"))


def overlap(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page, idx) of blocks that share words with a page; both have start_word, blocks word_count, pages end_word."""
    p, b = pages.alias("p"), blocks.alias("b")
    hit = (F.col("p.doc_id") == F.col("b.doc_id")) & (F.col("b.start_word") + F.col("b.word_count") > F.col("p.start_word")) & (F.col("b.start_word") < F.col("p.end_word"))
    return p.join(b, hit).select("p.doc_id", "p.page", "b.idx")


def segments(words: DataFrame, spans: DataFrame, whole: str = "text") -> DataFrame:
    """(doc_id, idx, start, end, word): each span's words (word not null) and the gaps between, before and after them.

    words: doc_id, start, end, word. spans: doc_id, idx, start, end.
    """
    s, t = spans.alias("s"), words.alias("t")
    inside = (F.col("t.doc_id") == F.col("s.doc_id")) & (F.col("t.start") >= F.col("s.start")) & (F.col("t.end") <= F.col("s.end"))
    own = s.join(t, inside).select("s.doc_id", "s.idx", F.col("t.start").alias("start"), F.col("t.end").alias("end"), "t.word")
    edges = spans.select("doc_id", "idx", F.col("end").alias("start"), F.col("end").alias("end"), F.lit(None).cast("string").alias("word"))
    w = W.partitionBy("doc_id", "idx").orderBy("start", "end")
    gaps = own.union(edges).join(spans.select("doc_id", "idx", F.col("start").alias("from")), ["doc_id", "idx"]).select("doc_id", "idx", F.coalesce(F.lag("end").over(w), F.col("from")).alias("start"), F.col("start").alias("end"), F.lit(None).cast("string").alias("word"))
    return own.union(gaps.where("end > start"))


def at_word(words: DataFrame, spans: DataFrame, key: str = "idx") -> DataFrame:
    """words (doc_id, word) with the key of the span [start_word, start_word + word_count) that holds it, else the last."""
    s, w = spans.alias("s"), words.alias("w")
    last = spans.groupBy("doc_id").agg(F.max_by(key, "start_word").alias("last"))
    hit = (F.col("w.doc_id") == F.col("s.doc_id")) & (F.col("w.word") >= F.col("s.start_word")) & (F.col("w.word") < F.col("s.start_word") + F.col("s.word_count"))
    found = w.join(s, hit, "left").select("w.*", F.col(f"s.{key}").alias(key))
    return found.join(last, "doc_id", "left").withColumn(key, F.coalesce(key, "last")).drop("last")


def page_at(words: DataFrame, pages: DataFrame) -> DataFrame:
    """words (doc_id, word) with page: the first that ends after the word, else the last; 0 without pages.

    A document's pages are an array of ends, so each word meets one row.
    """
    ends = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list("end_word")).alias("ends"))
    after = F.size(F.filter("ends", lambda e: e <= F.col("word")))
    return words.join(ends, "doc_id", "left").withColumn("page", F.coalesce(F.least(after, F.size("ends") - 1), F.lit(0)).cast("long")).drop("ends")


def at_time(times: DataFrame, timeline: DataFrame, start_word: int = 0) -> DataFrame:
    """times (doc_id, t) with word: the last in the timeline (doc_id, starts_at, word_index) that has begun, else start_word.

    As-of join by one sort: events and questions of a document in one order, the last event seen wins (ties: the last word).
    """
    marks = timeline.select("doc_id", F.col("starts_at").cast("double").alias("t"), F.col("word_index").cast("long").alias("seen"), F.lit(0).alias("ask"), F.lit(None).cast("long").alias("row"))
    numbered = times.withColumn("row", F.monotonically_increasing_id())
    asked = numbered.select("doc_id", F.col("t").cast("double").alias("t"), F.lit(None).cast("long").alias("seen"), F.lit(1).alias("ask"), "row")
    w = W.partitionBy("doc_id").orderBy("t", "ask", "seen").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = marks.union(asked).withColumn("word", F.last("seen", ignorenulls=True).over(w)).where("ask = 1")
    return found.select("doc_id", "t", F.coalesce("word", F.lit(start_word)).cast("long").alias("word"))


def targets(blocks: DataFrame) -> DataFrame:
    """Blocks that navigation stops at: paragraphs and bullets with words, or all with words where there are none."""
    good = F.col("kind").isin("paragraph", "bullet") & (F.col("word_count") > 0)
    some = F.max(good).over(W.partitionBy("doc_id"))
    return blocks.withColumn("good", good).withColumn("some", some).where("good or (not some and word_count > 0)").drop("good", "some")


def neighbours(words: DataFrame, stops: DataFrame, restart_after: int = 2) -> DataFrame:
    """words (doc_id, word) with next_word and prev_word among the stops' start words.

    Forward: the next start, null after the last. Back: the start of the present block if more than restart_after words
    have gone by, else the one before it, else 0.
    """
    starts = stops.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.col("start_word").cast("long"))).alias("starts"))
    both = words.join(starts, "doc_id", "left").withColumn("starts", F.coalesce("starts", F.array().cast("array<bigint>")))
    past = F.filter("starts", lambda s: s <= F.col("word"))
    here = F.try_element_at(past, F.lit(-1))
    before = F.try_element_at(F.filter("starts", lambda s: s < here), F.lit(-1))
    back = F.when(here.isNull(), 0).when(F.col("word") - here > restart_after, here).otherwise(F.coalesce(before, F.lit(0)))
    return both.select("doc_id", "word", F.array_min(F.filter("starts", lambda s: s > F.col("word"))).alias("next_word"), back.cast("long").alias("prev_word"))


def spread(pages: DataFrame, current: DataFrame, size: int = 2) -> DataFrame:
    """(doc_id, page, ...) of the spread that holds each document's current page, with next_page and prev_page."""
    at = current.select("doc_id", (F.floor(F.col("page") / size) * size).cast("long").alias("first"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    shown = pages.join(at, "doc_id").where((F.col("page") >= F.col("first")) & (F.col("page") < F.col("first") + size)).join(total, "doc_id")
    turn = lambda by: F.when((F.col("first") + by >= 0) & (F.col("first") + by < F.col("pages")), F.col("first") + by)
    return shown.withColumn("next_page", turn(size)).withColumn("prev_page", turn(-size)).drop("pages")


def progress(docs: DataFrame, rate: float = 1.0) -> DataFrame:
    """docs (doc_id, word_count, current) with the word kept inside, the percentage and what is left."""
    word = numbers.clamp(F.col("current"), 0, F.greatest(F.col("word_count"), F.lit(0)))
    left = numbers.remaining_seconds(F.col("word_count"), word, rate)
    return docs.select("doc_id", word.cast("long").alias("word"), numbers.percentage(F.col("word_count"), word).alias("percent"), left.alias("seconds"), numbers.duration_text(left).alias("left"))


def reread(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, original_text, blocks) prepared anew from their blocks; those without words are left out."""
    again = create_documents(docs.withColumn("given", F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text")))), raw="original_text", source_blocks="given")
    return again.where("word_count > 0")


def timeline(words: DataFrame, frames: DataFrame, duration: str = "duration", frame_seconds: float = 0.02) -> DataFrame:
    """(doc_id, word_index, starts_at): words laid over the voiced frames in proportion to their weights.

    words: doc_id, word_index, word. frames: doc_id, duration, voiced (the numbers of the voiced frames, in order).
    """
    before = W.partitionBy("doc_id").orderBy("word_index").rowsBetween(W.unboundedPreceding, -1)
    weighed = words.withColumn("weight", numbers.word_weight(F.col("word")))
    share = F.coalesce(F.sum("weight").over(before), F.lit(0)) / F.sum("weight").over(W.partitionBy("doc_id"))
    both = weighed.withColumn("share", share).join(frames, "doc_id")
    n = F.size("voiced")
    frame = F.try_element_at("voiced", F.least(n - 1, F.floor(F.col("share") * n).cast("int")) + 1)
    at = F.when(n > 0, frame * frame_seconds).otherwise(F.col("share") * F.col(duration))
    return both.where(F.col(duration) > 0).select("doc_id", "word_index", at.alias("starts_at"))


def voiced_frames(samples: DataFrame, rate: int = 22050, frame_seconds: float = 0.02) -> DataFrame:
    """samples (doc_id, i, x) as (doc_id, duration, voiced): frames of 20 ms with enough energy against the loudest."""
    size = max(1, int(rate * frame_seconds + 0.5))
    energy = samples.groupBy("doc_id", F.floor(F.col("i") / size).alias("frame")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count("*").alias("n"))
    least = F.greatest(F.lit(0.001), F.max("rms").over(W.partitionBy("doc_id")) * 0.035)
    kept = energy.withColumn("loud", F.col("rms") >= least)
    return kept.groupBy("doc_id").agg((F.sum("n") / rate).alias("duration"), F.sort_array(F.collect_list(F.when(F.col("loud"), F.col("frame")))).alias("voiced"))
