"""Small hand-made inputs, whose results stand in SQL as values.

For operators in Python that SQL can't express: text preparation, page layout, scans, web pages, files and sound. The
values were worked out by hand from the rules, not taken from the operators' output.
"""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import documents, layout, sessions
from lectern.sources import audio, files, html, payloads, web


CASES = {}


def query(sql: str):
    """Keeps a case with its results."""

    def add(f):
        CASES[f.__name__] = f, sql
        return f

    return add


def values(columns: str, rows: list[tuple]) -> str:
    """Rows as a SQL table."""

    def literal(v: object) -> str:
        if isinstance(v, str):
            parts = ["'" + x.replace("'", "''") + "'" for x in v.split("\n")]
            return " || chr(10) || ".join(parts) if len(parts) > 1 else parts[0]
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v)

    return f"SELECT {columns} FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS t({columns})"


# -- text preparation ------------------------------------------------------------------------------------------------

TEXTS = [
    ("spaces and line ends", "el río\r\ncrece.\rMucho   más.", "el río crece. Mucho más."),
    ("compatibility forms", "ﬁn de la ｐágina ½", "fin de la página 1⁄2"),
    ("emoji and keycaps", "Una nota 😀 breve 1️⃣ aquí 👩🏽‍🔬.", "Una nota breve aquí."),
    ("emphasis marks", "Un **texto** con _marcas_ y `código` suelto.", "Un texto con marcas y código suelto."),
    ("numbered references", "Se sabe [3] y [4, 7-9] bien.", "Se sabe y bien."),
    ("author and year", "La tasa (Luna, 1998) bajó (Luna y Mora, 2003, p. 12) otra vez.", "La tasa bajó otra vez."),
    ("several authors", "Un caso (Ruiz & Paz, 2001; Vega et al., 2015) abierto.", "Un caso abierto."),
    ("same place", "Como antes (ibid.) y después (op. cit.) se dijo.", "Como antes y después se dijo."),
    ("prose in brackets", "El tren (desde 1998) llega tarde (hoy no).", "El tren (desde 1998) llega tarde (hoy no)."),
    ("half a reference", "La tasa (Luna, 1998; ver abajo) bajó.", "La tasa (Luna, 1998; ver abajo) bajó."),
    ("sums", "Son 2+5=7 en total.", "Son 2 más 5 igual a 7 en total."),
    ("powers and quotients", "Es x^2 y 9/3 ahora.", "Es x elevado a 2 y 9 dividido entre 3 ahora."),
    ("comparisons", "Si a<b o b>=c, sigue.", "Si a menor que b o b mayor o igual que c, sigue."),
    ("units and either", "A 90 km/h y/o menos.", "A 90 km/h y/o menos."),
    ("spaces before marks", "Ya vino , dijo ; y calló .", "Ya vino, dijo; y calló."),
    ("inverted marks", "¿ Cuándo viene? ¡ Ya!", "¿Cuándo viene?¡Ya!"),
    ("word wraps", "los merca-\ndos abren hoy.", "los mercados abren hoy."),
    ("short wraps", "la parte a-\nb sigue igual.", "la parte a- b sigue igual."),
    ("dividers", "Antes de eso.\n\n-----\n\nDespués de eso.", "Antes de eso.\n\nDespués de eso."),
    ("blank", " \n\t\n ", ""),
]


@query(values("case_id, clean_text", [(c, out) for c, _, out in TEXTS]))
def text_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(c, t) for c, t, _ in TEXTS], "case_id string, text string")
    return documents.create_documents(rows, "case_id").select(F.col("doc_id").alias("case_id"), "clean_text")


BLOCKS = [
    ("hashes", "# Uno dos\n\n## Tres\n\n### Cuatro", "heading:Uno dos|heading:Tres|subheading:Cuatro"),
    ("list marks", "- primero\n* segundo\n• tercero", "bullet:primero|bullet:segundo|bullet:tercero"),
    ("plus as a mark", "+ otra cosa\n\n+ a", "bullet:otra cosa|paragraph:más a"),
    ("numbered title", "\n\n1. Origen\n\n", "subheading:Origen"),
    ("numbered sentence", "\n\n1. El agua subió.\n\n", "bullet:El agua subió."),
    ("section number", "\n\n3.2 Método usado\n\n", "heading:3.2 Método usado"),
    ("capitals", "algo antes sigue\nTODO EN GRANDE\nalgo después", "paragraph:algo antes sigue|heading:TODO EN GRANDE|paragraph:algo después"),
    ("short line alone", "\n\nPlan general\n\n", "heading:Plan general"),
    ("low first letter", "\n\nplan general\n\n", "paragraph:plan general"),
    ("ends a clause", "\n\nPlan general,\n\n", "paragraph:Plan general,"),
    ("middle of a text", "Primero viene esto\nPlan general\ny luego más.", "heading:Primero viene esto|paragraph:Plan general y luego más."),
    ("quoted lines", "> una cita larga\n>> otra más", "paragraph:una cita larga otra más"),
    ("paragraphs", "una línea\notra línea\n\nsegundo párrafo", "paragraph:una línea otra línea|paragraph:segundo párrafo"),
    ("long title", "\n\nUno Dos Tres Cuatro Cinco Seis Siete Ocho Nueve Diez\n\n", "subheading:Uno Dos Tres Cuatro Cinco Seis Siete Ocho Nueve Diez"),
]


def _joined(blocks: str) -> F.Column:
    return F.array_join(F.transform(blocks, lambda b: F.concat_ws(":", b["kind"], b["text"])), "|")


@query(values("case_id, blocks", [(c, out) for c, _, out in BLOCKS]))
def block_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(c, t) for c, t, _ in BLOCKS], "case_id string, text string")
    return documents.create_documents(rows, "case_id").select(F.col("doc_id").alias("case_id"), _joined("blocks").alias("blocks"))


SOURCES = [
    ("kinds stay", [("heading", "una frase que sigue."), ("bullet", "• Plan"), ("paragraph", "Plan")], "heading:una frase que sigue.|bullet:Plan|paragraph:Plan"),
    ("cleaned", [("paragraph", "Un **texto** (Luna, 1998) con re-\nglas."), ("paragraph", " \n ")], "paragraph:Un texto con reglas."),
    ("none", [], "heading:Plan"),
]


@query(values("case_id, blocks", [(c, out) for c, _, out in SOURCES]))
def source_block_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that a source tells; without any the text itself, here `Plan`, is classified."""
    rows = spark.createDataFrame([(c, "Plan", b) for c, b, _ in SOURCES], "case_id string, text string, given array<struct<kind:string,text:string>>")
    return documents.create_documents(rows, "case_id", source_blocks="given").select(F.col("doc_id").alias("case_id"), _joined("blocks").alias("blocks"))


CHUNKS = [
    ("sentences", "Uno dos tres. Cuatro cinco seis siete ocho nueve diez once doce.", [(0, 0, 7, "Uno dos tres. Cuatro cinco seis siete"), (1, 7, 4, "ocho nueve diez once"), (2, 11, 1, "doce.")]),
    ("abbreviations", "Vino uno con el Dr. Soto ayer a la tarde.", [(0, 0, 4, "Vino uno con el"), (1, 4, 4, "Dr. Soto ayer a"), (2, 8, 2, "la tarde.")]),
    ("short", "Solo tres palabras.", [(0, 0, 3, "Solo tres palabras.")]),
    ("none", "", []),
]


@query(values("case_id, idx, start_word, word_count, text", [(c, *x) for c, _, out in CHUNKS for x in out]))
def chunk_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(c, t) for c, t, _ in CHUNKS], "case_id string, text string")
    made = documents.create_documents(rows, "case_id", target=4)
    return made.select(F.col("doc_id").alias("case_id"), F.posexplode("chunks").alias("idx", "c")).select("case_id", "idx", "c.start_word", "c.word_count", "c.text")


PAGES = [
    ("one block", "x " * 50, [(0, 0, 20), (1, 20, 40), (2, 40, 50)]),
    ("cut before a block", "# Uno\n\n" + "x " * 12 + ".\n\n" + "y " * 12 + ".", [(0, 0, 13), (1, 13, 25)]),
    ("title moves on", "z " * 17 + ".\n\n# Dos tres\n\n" + "y " * 20 + ".", [(0, 0, 17), (1, 17, 37), (2, 37, 39)]),
    ("empty", "", []),
]


@query(values("case_id, page, start_word, end_word", [(c, *x) for c, _, out in PAGES for x in out]))
def page_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of twenty words: cut before a block in their second half, never after a title."""
    rows = spark.createDataFrame([(c, t) for c, t, _ in PAGES], "case_id string, text string")
    return documents.paginate(documents.create_documents(rows, "case_id"), 20).withColumnRenamed("doc_id", "case_id")


@query(values("doc_id, clean_text, word_count", [(1, "Un título\n\nUn párrafo", 4), (2, "Solo esto", 2)]))
def reread_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Stored documents prepared anew from their blocks; the third has no words and is left out."""
    rows = [(1, "x", [("heading", "Un título"), ("paragraph", "Un **párrafo**")]), (2, "Solo esto", None), (3, " ", None)]
    return documents.reread(spark.createDataFrame(rows, "doc_id long, original_text string, blocks array<struct<kind:string,text:string>>")).select("doc_id", "clean_text", "word_count")


# -- pages -----------------------------------------------------------------------------------------------------------


def _item(text: str, x: float, y: float, size: float = 12.0, width: float | None = None, font: str = "f", paragraph: int | None = None) -> dict:
    return {"str": text, "transform": [size, 0.0, 0.0, size, float(x), float(y)], "width": float(len(text) * size * 0.45 if width is None else width), "height": size, "font_name": font, "paragraph_id": paragraph}


def _marked(mark: str | None, *items: dict, tag: str = "P") -> list[dict]:
    begin = {"event": "beginMarkedContentProps", "marked_id": mark, "tag": tag} if mark else {"event": "beginMarkedContent", "tag": tag}
    return [begin, *items, {"event": "endMarkedContent"}]


def _tree(*nodes: tuple) -> dict:
    return {"role": "Root", "children": [{"role": role, "children": [{"type": "content", "id": m} for m in marks]} for role, *marks in nodes]}


_LINES = [_item(f"renglón {c} sigue", 50, 690 - 14 * i) for i, c in enumerate("abcd")]
_PROSE = "renglón a sigue renglón b sigue renglón c sigue renglón d sigue"
LAYOUTS = [
    ("wrapped word", [_item("Un ejem-", 50, 700), _item("plo corto.", 50, 686)], None, "Un ejemplo corto.", "paragraph", False, False, None),
    ("sizes", [_item("Libro", 50, 760, 24.0), _item("Capítulo", 50, 725, 16.0), *_LINES], None, f"# Libro\n\n### Capítulo\n\n{_PROSE}", "heading,subheading,paragraph", False, False, None),
    ("bold title", [_item("Nota", 50, 730, 12.0, None, "Serif-Bold"), *_LINES], None, f"### Nota\n\n{_PROSE}", "subheading,paragraph", False, False, None),
    ("list", [*_LINES, _item("• uno", 50, 620), _item("2. dos", 50, 606), _item("y más", 65, 592)], None, f"{_PROSE}\n\n- uno\n\n2. dos y más", "paragraph,bullet,bullet", False, False, None),
    ("gap", [_item("antes", 50, 700), _item("junto", 50, 686), _item("aparte", 50, 640)], None, "antes junto\n\naparte", "paragraph,paragraph", False, False, None),
    ("known paragraphs", [_item("uno", 50, 700, paragraph=1), _item("dos", 50, 686, paragraph=2)], None, "uno\n\ndos", "paragraph,paragraph", False, False, None),
    ("two columns", [x for i in range(6) for x in (_item(f"iz {i}", 50, 700 - 14 * i, width=150), _item(f"de {i}", 300, 700 - 14 * i, width=150))], None, "iz 0 iz 1 iz 2 iz 3 iz 4 iz 5\n\nde 0 de 1 de 2 de 3 de 4 de 5", "paragraph,paragraph", True, False, None),
    ("tags", [*_marked("b", _item("segundo", 50, 700)), *_marked("a", _item("Primero", 50, 600))], _tree(("H1", "a"), ("P", "b")), "# Primero\n\nsegundo", "heading,paragraph", False, True, None),
    ("tags that miss a mark", [*_marked("a", _item("uno", 50, 700)), *_marked("b", _item("dos", 50, 500))], _tree(("P", "a")), "uno\n\ndos", "paragraph,paragraph", True, False, None),
    ("artifact", [*_marked(None, _item("pie", 50, 20), tag="Artifact"), _item("cuerpo", 50, 700)], None, "cuerpo", "paragraph", False, False, None),
    ("table", [x for i in range(4) for x in (_item(f"fila {i}", 50, 700 - 20 * i, width=40), _item(f"{i},50", 300, 700 - 20 * i, width=30))], None, "", "", False, False, "ambiguous: table"),
    ("turned", [_item("a", 50, 700), {"str": "girado", "transform": [0.0, 12.0, -12.0, 0.0, 60.0, 500.0], "width": 9.0, "height": 12.0}], None, "", "", False, False, "ambiguous: turned"),
]
_FIELDS = {"str": "string", "transform": "array<double>", "width": "double", "height": "double", "has_eol": "boolean", "font_name": "string", "paragraph_id": "int", "event": "string", "marked_id": "string", "tag": "string"}


@query(values("page_id, text, kinds, needs_review, used_tags, error", [(c, *out) for c, _, _, *out in LAYOUTS]))
def layout_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Reading order and blocks of pages: by size, weight, gaps, lists, columns, structure trees and marks."""
    rows = [(c, n, *(i.get(k) for k in _FIELDS)) for c, items, *_ in LAYOUTS for n, i in enumerate(items)]
    items = spark.createDataFrame(rows, "page_id string, idx int, " + ", ".join(f"{k} {t}" for k, t in _FIELDS.items()))
    trees = spark.createDataFrame([(c, json.dumps(t)) for c, _, t, *_ in LAYOUTS if t], "page_id string, tree string")
    done = layout.reconstruct_pages(items, trees)
    return done.select("page_id", "text", F.array_join(F.transform("blocks", lambda b: b["kind"]), ",").alias("kinds"), "needs_review", "used_tags", "error")


_SCAN = "uno dos\ntres\n\n- cuatro"
_BOXES = [(0, "uno dos", 10.0, 10.0, 300.0, 30.0), (0, "tres", 10.0, 34.0, 300.0, 54.0), (1, "- cuatro", 10.0, 120.0, 300.0, 140.0)]
SCANS = [
    ("boxes", 800.0, _BOXES, "uno dos tres\n\n- cuatro"),
    ("a line is missing", 800.0, _BOXES[:2], _SCAN),
    ("a box outside the page", 200.0, _BOXES, _SCAN),
    ("no boxes", 800.0, [], _SCAN),
]


@query(values("page_id, text, blocks, needs_review", [(c, out, "paragraph:uno dos tres|bullet:- cuatro", True) for c, _, _, out in SCANS]))
def scan_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Scanned pages by their boxes; what doesn't add up falls back to the text."""
    pages = spark.createDataFrame([(c, _SCAN, w, 800.0) for c, w, _, _ in SCANS], "page_id string, text string, width double, height double")
    lines = spark.createDataFrame([(c, n, *b) for c, _, own, _ in SCANS for n, b in enumerate(own)], "page_id string, idx int, paragraph int, text string, x0 double, y0 double, x1 double, y1 double")
    return layout.reconstruct_ocr(pages, lines).select("page_id", "text", _joined("blocks").alias("blocks"), "needs_review")


@query(values("page_id, within", [("few", True), ("many", False), ("long", False), ("far", False), ("bare", True)]))
def page_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of 3 and of 20,001 items, of 100,001 characters, of a coordinate out of range, and without positions."""
    at = F.array(*(F.lit(float(v)) for v in (12, 0, 0, 12, 50, 700)))
    one = lambda name, n, text, place: spark.range(n).select(F.lit(name).alias("page_id"), text.alias("str"), place.alias("transform"))
    pages = [one("few", 3, F.lit("a"), at), one("many", 20_001, F.lit("a"), at), one("long", 1, F.repeat(F.lit("a"), F.lit(100_001)), at)]
    pages += [one("far", 1, F.lit("a"), F.transform(at, lambda v: v * 1e9)), one("bare", 2, F.lit("a"), F.lit(None).cast("array<double>"))]
    items = pages[0]
    for p in pages[1:]:
        items = items.union(p)
    return files.page_within(items)


@query(values("doc_id, text, kinds, needs_review", [(1, "uno\n\ntres", "heading,paragraph", True), (2, "solo", "paragraph", False)]))
def merged_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, 2, "tres", [("paragraph", "tres")], True), (1, 0, "uno", [("heading", "uno")], False), (1, 1, "", [], False), (2, 0, "solo", [("paragraph", "solo")], False)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string, blocks array<struct<kind:string,text:string>>, needs_review boolean")
    return files.document_pages(pages).select("doc_id", "text", F.array_join(F.transform("blocks", lambda b: b["kind"]), ",").alias("kinds"), "needs_review")


SERVER_LINES = [
    ("near lines", [_item("dos", 100, 700), _item("uno", 50, 700.5), _item("lejos", 50, 600)], "uno dos\n\nlejos"),
    ("no positions", [{"str": "a "}, {"str": "b", "has_eol": True}, {"str": "c"}], "a b\nc"),
]


@query(values("page_id, text", [(c, out) for c, _, out in SERVER_LINES]))
def server_line_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(c, n, *(i.get(k) for k in _FIELDS)) for c, items, _ in SERVER_LINES for n, i in enumerate(items)]
    return layout.server_pages(spark.createDataFrame(rows, "page_id string, idx int, " + ", ".join(f"{k} {t}" for k, t in _FIELDS.items()))).select("page_id", "text")


# -- web pages, files, sound and state -------------------------------------------------------------------------------

WEB = [
    ("titles and lists", "<title> Una\n página </title><h1>Uno</h1><p>dos<ul><li>x<li>y</ul>", "Una página", "# Uno\n\ndos\n\n- x\n\n- y", "# Uno\n\ndos\n\n- x\n\n- y"),
    ("line breaks", "<p>uno<br>dos</p>", "", "unodos", "uno\ndos"),
    ("scripts", "<p>a</p><script>no()</script><style>p{}</style><p>b</p>", "", "a\n\nb", "a\n\nb"),
    ("article", "<body><p>fuera</p><article><p>dentro</p></article></body>", "", "dentro", "dentro"),
    ("entities", "m&aacute;s &amp; menos", "", "más & menos", "más & menos"),
    ("nothing", None, "", "", ""),
]


@query(values("case_id, title, server, client", [(c, *out) for c, _, *out in WEB]))
def html_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The two profiles of reading a web page."""
    rows = spark.createDataFrame([(c, h) for c, h, *_ in WEB], "case_id string, html string")
    both = rows.select("case_id", html.extract(F.col("html")).alias("s"), html.extract(F.col("html"), "client").alias("c"))
    return both.select("case_id", "s.title", F.col("s.text").alias("server"), F.col("c.text").alias("client"))


def _docx(**parts: bytes) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Tema</w:t></w:r></w:p><w:p><w:r><w:t>Un</w:t><w:br/><w:t>texto</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in ({"[Content_Types].xml": b"<Types/>", "word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'.encode()} | parts).items():
            z.writestr(name, data)
    return out.getvalue()


FILES = [
    ("/in/a.docx", _docx(), None, "docx", 200, "Tema\n\nUn\ntexto", False),
    ("/in/out.docx", _docx(**{"../x": b""}), None, "docx", 415, None, False),
    ("/in/cut.docx", _docx()[:-3], None, "docx", 415, None, False),
    ("/in/bomb.docx", _docx(**{"word/big.bin": b"\0" * (9 * files.MIB)}), None, "docx", 413, None, False),
    ("/in/t.txt", " Uno\r\ndos ".encode(), "text/plain", "text", 200, "Uno\ndos", False),
    ("/in/latin.txt", b"caf\xe9", "text/plain", "text", 415, None, False),
    ("/in/blank.md", b" \n ", None, "text", 422, "", False),
    ("/in/p.pdf", b"%PDF-1.7", "application/pdf", "pdf", 200, None, True),
    ("/in/old.doc", b"x", None, "doc", 415, None, False),
    ("/in/none.txt", b"", None, "text", 413, None, False),
    ("/in/z", b"\x00\x01", None, "unknown", 415, None, False),
]


@query(values("path, type, status, text, needs_ocr", [(p, *out) for p, _, _, *out in FILES]))
def file_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Files of all types: sound and unsound archives, encodings, limits."""
    frame = spark.createDataFrame([f[:3] for f in FILES], "path string, content binary, mime string")
    return files.import_files(frame).select("path", "type", "status", "text", "needs_ocr")


SOUNDS = [
    ("steps", [0.0, 1.0, -1.0, 2.0, 0.5], "524946462e00000057415645666d74201000000001000100225600" + "0044ac000002001000646174610a000000" + "0000ff7f0080ff7fff3f"),
    ("silent", [0.0, 0.00001], None),
    ("empty", [], None),
    ("not a number", [float("nan"), 1.0], None),
]


@query(values("clip, wav", [(c, out) for c, _, out in SOUNDS]))
def wav_cases(spark: SparkSession, sf: str) -> DataFrame:
    clips = spark.createDataFrame([(c, x) for c, x, _ in SOUNDS], "clip string, samples array<double>")
    return clips.select("clip", F.lower(F.hex(audio.encode(F.col("samples")))).alias("wav"))


_STATE = (
    '{"progress":{"currentWord":0,"currentTimeSeconds":0.0,"percentage":0.0,"estimatedRemainingSeconds":0.0,"updatedAt":"1970-01-01T00:00:00.000Z"},'
    '"preferences":{"voiceId":"browser-standard","rate":1.0,"theme":"warm-paper","readingMode":"standard"},"session":{"signedIn":false,"userName":""}}'
)


@query(values("state", [(_STATE,)]))
def default_states(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.to_json(payloads.default_state()).alias("state"))


ADDRESSES = [
    ("8.8.8.8", True, True), ("10.0.0.1", False, True), ("2606:4700::1111", True, True), ("2a00:1450:4001:0830:0000:0000:0000:200e", True, True),
    ("::", False, True), ("::1", False, True), ("1::", False, True), ("::ffff:8.8.8.8", False, True), ("2001:db8::5", False, True),
    ("2001:1ff::1", False, True), ("2001:200::1", True, True), ("2002:808:808::1", False, True), ("3fff:fff::1", False, True),
    ("3fff:1000::1", True, True), ("4000::1", False, True), ("fe80::1", False, True), ("64:ff9b::8.8.8.8", False, True),
    ("2a00::1%eth0", False, False), (":::::::::", False, False), ("1:2:3:4:5:6:7:8:9", False, False), ("1:2:3:4:5:6:7", False, False),
    ("2a00::1::2", False, False), ("::999.1.1.1", False, False), ("2a00:12345::1", False, False), ("2a00::1:", False, False), ("", False, False),
]


@query(values("address, is_public, is_client", ADDRESSES))
def address_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of both versions: whether they are public, and whether they name a client."""
    rows = spark.createDataFrame([(a,) for a, _, _ in ADDRESSES], "address string")
    return rows.select("address", web.is_public(F.col("address")).alias("is_public"), (web.client_key(F.col("address")) != "unidentified").alias("is_client"))


@query("SELECT 'documents' AS scope, 20 AS max_client, 80 AS max_global, 60000 AS window_ms, 4 AS max_active UNION ALL SELECT 'reconstruct', 6, 24, 60000, 2")
def limit_policies(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.policies(spark)
