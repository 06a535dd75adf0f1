"""Queries on files, archives, sound and page fragments that are written from the tables first, each with its SQL."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import replace
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators.batches import slices
from lectern.operators.scratch import shared_folder
from lectern.plans.catalog import query, table
from lectern.sources import audio, files, payloads
from lectern.streaming.store import Store

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
ENTRIES = files.CLIENT.entries
#: What becomes of a document, by its number modulo this many: the order of the cases in _archive() and in the SQL.
KINDS = 8


def _archive(text: str, kind: int) -> bytes:
    """A word processor's file of a text, a line a paragraph; by kind sound (1, 7 stored), cut short, with a path that
    leaves the archive, with too many entries, without content types."""
    lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if kind == 7 else zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body>{lines}</w:body></w:document>')
        for name in {3: ["../x"], 5: [f"x{i}" for i in range(ENTRIES)]}.get(kind, []) + ([] if kind == 6 else ["[Content_Types].xml"]):
            z.writestr(name, b"<a/>")
    return out.getvalue()[: -3 if kind == 2 else None]


def _written(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for kinds, texts, paths in slices(tuple(b.columns)):
            raw = [t.encode() + (b"\xe9" if k == 4 else b"") if k in (0, 4) else _archive(t, k) for k, t in zip(kinds.to_pylist(), texts.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([paths, pa.array(raw, pa.binary())], ["path", "content"])


@query(f"""
    WITH d AS (SELECT doc_id, doc_id % {KINDS} AS k, string_split(text, chr(10)) AS ls, text FROM documents), t AS (
      SELECT doc_id, k, CASE WHEN k IN (0, 4) THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) ELSE
        array_to_string(list_filter(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10) || chr(10)) END AS text FROM d
    )
    SELECT '/in/' || doc_id || CASE WHEN k IN (0, 4) THEN '.txt' ELSE '.docx' END AS path, CASE WHEN k IN (0, 4) THEN 'text' ELSE 'docx' END AS type,
      CASE WHEN k IN (2, 3, 4, 6) THEN 415 WHEN k = 5 THEN 413 WHEN k = 0 AND text = '' THEN 422 ELSE 200 END AS status,
      CASE WHEN k IN (0, 1, 7) THEN length(text) END AS chars, CASE WHEN k IN (0, 1, 7) THEN md5(text) END AS digest
    FROM t""")
def imported_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as text files and archives, sound and not, and read back."""
    k = F.col("doc_id") % KINDS
    name = F.concat(F.lit("/in/"), "doc_id", F.when(k.isin(0, 4), ".txt").otherwise(".docx"))
    written = table(spark, sf, "documents").select(k.cast("int").alias("kind"), "text", name.alias("path")).mapInArrow(_written, "path string, content binary")
    read = files.import_files(written.withColumn("mime", F.lit(None).cast("string")))
    return read.select("path", "type", "status", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


_SAMPLE = "((event_id * 37 % 4001 - 2000) / 1600.0 * (CASE WHEN user_id % 5 = 0 THEN 0.00001 ELSE 1.0 END))"
_HEX = lambda v, n: " || ".join(f"printf('%02x', ({v}) // {256**i} % 256)" for i in range(n))


@query(f"""
    WITH s AS (SELECT user_id, event_id, {_SAMPLE.replace('0.00001', '0.00001::DOUBLE').replace('1600.0', '1600.0::DOUBLE').replace('ELSE 1.0', 'ELSE 1.0::DOUBLE')} AS x FROM events), p AS (
      SELECT user_id, event_id, x, ((trunc(CASE WHEN x < 0 THEN greatest(x, -1) * 32768 ELSE least(x, 1) * 32767 END)::BIGINT + 65536) % 65536) AS v FROM s
    ), c AS (
      SELECT user_id, count(*) * 2 AS n, max(abs(x)) AS loudest, string_agg({_HEX('v', 2)}, '' ORDER BY event_id) AS pcm FROM p GROUP BY user_id
    )
    SELECT user_id, CASE WHEN loudest > 0.0001 THEN 44 + n END AS bytes, CASE WHEN loudest > 0.0001 THEN
      md5('52494646' || {_HEX('36 + n', 4)} || '57415645666d7420' || '1000000001000100' || {_HEX('22050', 4)} || {_HEX('44100', 4)} || '02001000' || '64617461' || {_HEX('n', 4)} || pcm) END AS digest
    FROM c""")
def sound_files(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as samples of a sound file; some are too quiet to be kept, some samples too loud."""
    samples = table(spark, sf, "events").select("user_id", "event_id", F.expr(_SAMPLE).cast("double").alias("x"))
    clips = samples.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "x"))), lambda e: e["x"]).alias("samples"))
    made = clips.select("user_id", audio.encode(F.col("samples")).alias("wav"))
    return made.select("user_id", F.octet_length("wav").cast("long").alias("bytes"), F.md5(F.lower(F.hex("wav")).cast("binary")).alias("digest"))


_ITEMS, _CHARS, _FAR = 30, 400, "CASE WHEN doc_id % 11 = 3 AND pos = 5 THEN 200000000.0 ELSE pos * 60.0 END"


@query(f"""
    WITH w AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM (SELECT doc_id, string_split(text, ' ')[1:doc_id % 40 + 1] AS ws FROM documents))
    SELECT doc_id AS page_id, count(*) <= {_ITEMS} AND sum(length(word)) <= {_CHARS} AND max({_FAR}) <= 1e8 AS within FROM w GROUP BY doc_id""")
def bounded_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first words of each text as a page's fragments, as many as its number says, some placed where no page is."""
    words = table(spark, sf, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", " "), F.lit(1), (F.col("doc_id") % 40 + 1).cast("int"))).alias("pos", "str"))
    x = F.expr(_FAR).cast("double")
    items = words.select(F.col("doc_id").alias("page_id"), "str", F.array(F.lit(12.0), F.lit(0.0), F.lit(0.0), F.lit(12.0), x, F.lit(700.0)).alias("transform"))
    return files.page_within(items, replace(files.CLIENT, page_items=_ITEMS, page_chars=_CHARS))


_STATE = '{"progress":{"currentWord":0,"currentTimeSeconds":0.0,"percentage":0.0,"estimatedRemainingSeconds":0.0,"updatedAt":"1970-01-01T00:00:00.000Z"},"preferences":{"voiceId":"browser-standard","rate":1.0,"theme":"warm-paper","readingMode":"standard"},"session":{"signedIn":false,"userName":""}}'


@query(f"""
    SELECT doc_id, coalesce('{{"progress":{{"currentWord":' || (quality * 7 + toxic) || ',' || split_part('{_STATE}', '"currentWord":0,', 2), '{_STATE}') AS state FROM documents LEFT JOIN labels USING (doc_id)""")
def states_or_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """A document's stored place, over the default state that a document without one has."""
    both = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", (F.col("quality") * 7 + F.col("toxic")).alias("word")), "doc_id", "left")
    state = payloads.default_state()
    progress = state["progress"].withField("currentWord", F.coalesce("word", state["progress"]["currentWord"]))
    return both.select("doc_id", F.to_json(state.withField("progress", progress)).alias("state"))


@query("""
    WITH w AS (SELECT doc_id % 50 AS k, doc_id, doc_id % 5 <> 0 AS ok, CASE WHEN doc_id % 7 <> 3 THEN md5(text) END AS body FROM documents), a AS (
      SELECT k, doc_id, body, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS revision FROM w WHERE ok
    ), c AS (
      SELECT k, max(revision) FILTER (body IS NULL) AS cleared FROM a GROUP BY k
    )
    SELECT k::VARCHAR AS key, doc_id AS seq, revision, body FROM a JOIN c USING (k) WHERE revision > coalesce(cleared, 0)""")
def published_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as revisions that three batches publish, some too late, some a clear; one batch comes twice, then a purge."""
    docs, order = table(spark, sf, "documents"), W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    ok = F.col("seq") % 5 != 0
    rows = docs.select((F.col("doc_id") % 50).cast("string").alias("key"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 7 != 3, F.md5(F.col("text").cast("binary"))).alias("body"))
    writes = rows.withColumn("expected", F.when(ok, F.coalesce(F.sum(ok.cast("long")).over(order), F.lit(0))).otherwise(-1).cast("long")).select("key", "seq", "expected", "body")
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    for n in (0, 1, 1, 2):
        store.swap(writes.where(F.least(F.floor(F.col("seq") / 100), F.lit(2)) == n), n)
    store.purge()
    return store.stored()
