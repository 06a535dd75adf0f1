"""Uploaded files: what they are, whether their archives are sound, and their text.

Tables come from spark.read.format("binaryFile") (path, content). The client profile decodes strictly and allows larger
files; the server profile replaces what it can't decode.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.batches import by_row, slices


@dataclass(frozen=True)
class Profile:
    """Limits of one side; fixed values."""

    file_bytes: int
    strict_utf8: bool
    entries: int
    expanded: int
    entry: int
    xml: int
    ratio: float
    page_items: int
    page_chars: int


MIB = 1024 * 1024
CLIENT = Profile(25 * MIB, True, 512, 32 * MIB, 8 * MIB, 4 * MIB, float("inf"), 20_000, 100_000)
SERVER = Profile(4_000_000 - 64_000, False, 2048, 25 * MIB, 8 * MIB, 8 * MIB, 200, 8_000, 300_000)
TEXT_CHARS, HTML_BYTES = 300_000, 4 * MIB


def is_pdf(content: Column, mime: Column, name: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False)) | F.coalesce(F.lower(mime).contains("pdf"), F.lit(False)) | F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def file_type(content: Column, mime: Column, name: Column) -> Column:
    """pdf, docx, text, doc or unknown: by the first bytes, then the name, then the media type."""
    low, kind = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(is_pdf(content, mime, name), "pdf")
        .when(low.endswith(".docx") | kind.contains("wordprocessingml"), "docx")
        .when(low.endswith(".doc") | (kind == "application/msword"), "doc")
        .when(low.rlike(r"\.(txt|md|markdown)$") | kind.startswith("text/"), "text")
        .otherwise("unknown")
    )


def text_of(content: Column, strict: bool = True) -> Column:
    """UTF-8 as text, line ends unified; null if strict and malformed."""
    decoded = F.try_validate_utf8(content.cast("string")) if strict else F.make_valid_utf8(content.cast("string"))
    return T.js_trim(F.regexp_replace(decoded, "\r\n?", "\n"))


class Unsound(ValueError):
    """A damaged or unsupported archive (415), or one that is too large (413)."""

    def __init__(self, status: int):
        super().__init__(str(status))
        self.status = status


def _directory(data: bytes) -> tuple[int, int, int]:
    """(offset, end, entries) of a ZIP file's directory; no ZIP64, no volumes, nothing behind it."""
    for at in range(len(data) - 22, max(-1, len(data) - 65_558), -1):
        if data[at : at + 4] == b"PK\x05\x06":
            disk, first, here, count, size, offset, comment = struct.unpack_from("<4HIIH", data, at + 4)
            if at + 22 + comment == len(data):
                if disk or first or here != count or 0xFFFF == count or 0xFFFFFFFF in (size, offset) or offset + size != at:
                    raise Unsound(415)
                return offset, at, count
    raise Unsound(415)


def _inflated(data: bytes, most: int) -> int:
    """The length that raw deflate data really expands to; stops beyond most."""
    engine, total, rest = zlib.decompressobj(-15), 0, data
    try:
        while rest and not engine.eof:
            total += len(engine.decompress(rest, 65_536))
            if total > most:
                raise Unsound(413)
            rest = engine.unconsumed_tail
        total += len(engine.flush())
    except zlib.error:
        raise Unsound(415) from None
    if not engine.eof:
        raise Unsound(415)
    return total


_unsafe = re.compile(r"\\|(?:^|/)\.\.?(?:$|/)")


def check_docx(data: bytes, limits: Profile) -> list[tuple[str, int, int]]:
    """(name, compressed, expanded) of each entry of a sound archive; sizes are counted, not believed."""
    at, end, count = _directory(data)
    offset, client = at, limits.strict_utf8
    if count > limits.entries:
        raise Unsound(413)
    if not count:
        raise Unsound(415)
    found: dict[str, tuple[int, int]] = {}
    declared = actual = 0
    for _ in range(count):
        if at + 46 > end or data[at : at + 4] != b"PK\x01\x02":
            raise Unsound(415)
        flags, method = struct.unpack_from("<2H", data, at + 8)
        packed, size, n_name, n_extra, n_note, disk = struct.unpack_from("<2I4H", data, at + 20)
        (local,) = struct.unpack_from("<I", data, at + 42)
        after = at + 46 + n_name + n_extra + n_note
        if after > end or flags & 1 or method not in (0, 8) or disk or local + 30 > offset or 0xFFFFFFFF in (packed, size, local):
            raise Unsound(415)
        if data[local : local + 4] != b"PK\x03\x04" or struct.unpack_from("<2H", data, local + 6) != (flags, method):
            raise Unsound(415)
        raw = data[at + 46 : at + 46 + n_name]
        l_name, l_extra = struct.unpack_from("<2H", data, local + 26)
        start = local + 30 + l_name + l_extra
        try:
            name = raw.decode("utf-8", "strict" if client else "replace")
        except UnicodeDecodeError:
            raise Unsound(415) from None
        odd = _unsafe.search(name) or data[local + 30 : local + 30 + l_name] != raw if client else "\0" in name
        if not name or odd or name in found or start + packed > offset or method == 0 and packed != size:
            raise Unsound(415)
        declared += size
        xml = name.lower().endswith((".xml", ".rels"))
        if size > (limits.xml if xml else limits.entry) or declared > limits.expanded or size and (not packed or size / packed > limits.ratio):
            raise Unsound(413)
        real = packed if method == 0 else _inflated(data[start : start + packed], min(size, limits.expanded - actual)) if packed else 0
        if real != size:
            raise Unsound(415)
        actual += real
        found[name] = packed, size
        at = after
    if at != end or not {"word/document.xml", "[Content_Types].xml"} <= found.keys():
        raise Unsound(415)
    return [(n, p, s) for n, (p, s) in found.items()]


def archive_entries(files: DataFrame, limits: Profile = CLIENT) -> DataFrame:
    """(path, status, entries) of files (path, content): 200 and the entries, or why the archive is turned away."""
    kind = "path string, status int, entries array<struct<name:string,compressed:long,expanded:long>>"
    entry = pa.list_(pa.struct([("name", pa.string()), ("compressed", pa.int64()), ("expanded", pa.int64())]))

    def one(data: bytes | None) -> tuple[int, list | None]:
        try:
            return 200, [dict(zip(("name", "compressed", "expanded"), e, strict=True)) for e in check_docx(data or b"", limits)]
        except Unsound as e:
            return e.status, None

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, contents in (part for b in it for part in slices(tuple(b.columns))):
            found = [one(x) for x in contents.to_pylist()]
            yield pa.RecordBatch.from_arrays([paths, pa.array([s for s, _ in found], pa.int32()), pa.array([e for _, e in found], entry)], ["path", "status", "entries"])

    return files.select("path", "content").mapInArrow(batches, kind)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(data: bytes) -> tuple[list[dict], bool]:
    """Blocks of a document by paragraph style, and whether tables or pictures need a second look."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    blocks = []
    for p in body.iter(f"{_W}p"):
        text = "".join("\n" if t.tag in (f"{_W}br", f"{_W}cr") else "\t" if t.tag == f"{_W}tab" else t.text or "" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}br", f"{_W}cr", f"{_W}tab"))
        style = next((s.get(f"{_W}val", "") for s in p.iter(f"{_W}pStyle")), "").lower().replace(" ", "")
        level = re.fullmatch(r"(?:heading|título|titulo)([1-6])|title", style)
        kind = ("heading" if (level[1] or "1") in "12" else "subheading") if level else "bullet" if next(p.iter(f"{_W}numPr"), None) is not None else "paragraph"
        if text.strip():
            blocks.append({"kind": kind, "text": text.strip()})
    odd = any(e.tag in (f"{_W}tbl", f"{_W}drawing", f"{_W}pict") for e in body.iter())
    return blocks, odd


def import_files(files: DataFrame, limits: Profile = CLIENT) -> DataFrame:
    """(path, type, status, text, blocks, needs_review, needs_ocr) of files (path, content, mime).

    Text and DOCX files are read; PDF files are recognised, their fragments come as a table of their own.
    """
    name = F.element_at(F.split("path", "/"), -1)
    size = F.octet_length("content")
    typed = files.select("path", "content", file_type(F.col("content"), F.col("mime"), name).alias("type"), ((size > 0) & (size <= limits.file_bytes)).alias("fits"))
    kind = "array<struct<kind:string,text:string>>"
    block = pa.struct([("blocks", pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))), ("odd", pa.bool_()), ("status", pa.int32())])

    def one(data: bytes | None) -> dict | None:
        if data is None:
            return None
        try:
            check_docx(data, limits)
            blocks, odd = docx_blocks(data)
            return {"blocks": blocks, "odd": odd, "status": 200}
        except Unsound as e:
            return {"blocks": None, "odd": True, "status": e.status}
        except (ElementTree.ParseError, KeyError, zipfile.BadZipFile):
            return {"blocks": None, "odd": True, "status": 415}

    docx = by_row(one, f"struct<blocks:{kind},odd:boolean,status:int>", block)
    # only what is DOCX and fits gets to Python
    read = typed.withColumn("d", docx(F.when((F.col("type") == "docx") & F.col("fits"), F.col("content")))).withColumn("t", F.when((F.col("type") == "text") & F.col("fits"), text_of(F.col("content"), limits.strict_utf8)))
    text = F.when(F.col("type") == "docx", F.array_join(F.transform("d.blocks", lambda b: b["text"]), "\n\n")).otherwise(F.col("t"))
    status = (
        F.when(~F.col("fits"), 413).when(F.col("type").isin("doc", "unknown"), 415).when(F.col("type") == "docx", F.col("d.status")).when(F.col("type") == "pdf", 200)
        .when(F.col("t").isNull(), 415).when(F.length("t") > TEXT_CHARS, 413).when(F.col("t") == "", 422).otherwise(200)
    )
    done = read.select("path", "type", status.alias("status"), text.alias("text"), F.when(F.col("type") == "docx", F.col("d.blocks")).alias("blocks"), F.coalesce("d.odd", F.lit(False)).alias("needs_review"))
    return done.withColumn("needs_ocr", (F.col("type") == "pdf") & (F.length(F.coalesce("text", F.lit(""))) < 80))


def page_within(items: DataFrame, limits: Profile = CLIENT) -> DataFrame:
    """(page_id, within) of items (page_id, str, transform): how many, how long, and numbers that can be coordinates."""
    fine = F.col("transform").isNull() | ((F.size("transform") == 6) & F.forall("transform", lambda v: v.isNotNull() & (F.abs(v) <= 1e8) & ~F.isnan(v)))
    sums = items.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("str", F.lit("")))).alias("chars"), F.bool_and(fine).alias("fine"))
    return sums.select("page_id", ((F.col("n") <= limits.page_items) & (F.col("chars") <= limits.page_chars) & F.col("fine")).alias("within"))


#: Pages of a document, items of all its pages, and fonts of a page whose names are known; fixed values.
MAX_PAGES, MAX_TOTAL_ITEMS, MAX_FONTS = 200, 100_000, 256


def document_within(items: DataFrame, limits: Profile = CLIENT, most_pages: int = MAX_PAGES, most_items: int = MAX_TOTAL_ITEMS) -> DataFrame:
    """(doc_id, page_no, fonts, status) of items (doc_id, page_no, str, font_name), the pages read in order.

    pages: the document has too many; page: this page alone exceeds its limits; items: with it the document's items do;
    ok. fonts counts the names that are kept.
    """
    per = items.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("str", F.lit("")))).alias("chars"), F.count_distinct("font_name").alias("fonts"))
    doc = W.partitionBy("doc_id")
    so_far = F.sum("n").over(doc.orderBy("page_no").rowsBetween(W.unboundedPreceding, W.currentRow))
    status = F.when(F.count("*").over(doc) > most_pages, "pages").when((F.col("n") > limits.page_items) | (F.col("chars") > limits.page_chars), "page").when(so_far > most_items, "items").otherwise("ok")
    return per.select("doc_id", "page_no", F.least("fonts", F.lit(MAX_FONTS)).alias("fonts"), status.alias("status"))


def document_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text, blocks, needs_review) from pages (doc_id, page_no, text, blocks, needs_review), in order."""
    ordered = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "text", "blocks"))).alias("p"), F.bool_or("needs_review").alias("needs_review"))
    texts = F.filter(F.transform("p", lambda x: x["text"]), lambda t: t != "")
    return ordered.select("doc_id", F.array_join(texts, "\n\n").alias("text"), F.flatten(F.transform("p", lambda x: x["blocks"])).alias("blocks"), "needs_review")
