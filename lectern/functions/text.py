"""Text measures and clean-up as column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import cleaning

#: Whitespace of ECMAScript, inside a Java or RE2 character class.
JS_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WORD = cleaning.WORD
LETTER_OR_DIGIT = r"[\p{L}\p{N}]"


def matches(text: Column, pattern: str) -> Column:
    """How often the pattern matches, without overlap."""
    return F.size(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def chars(text: Column, one: str) -> Column:
    """How many characters match a pattern of one character; in one pass, without an array of them."""
    return F.length(text) - F.length(F.regexp_replace(text, f"(?:{one})+", ""))


def word_count(text: Column) -> Column:
    # every letter, mark and digit belongs to a word, so no other x is left when words become one
    marked = F.regexp_replace(text, WORD, "x")
    return (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit("x"), F.lit("")))).cast("long")


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def language(text: Column) -> Column:
    """es, en or mixed by the presence of marker words between spaces."""
    lower = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    hits = {k: sum((lower.contains(f" {w} ").cast("int") for w in v), F.lit(0)) for k, v in cleaning.MARKERS.items()}
    return F.when((hits["en"] >= 2) & (hits["es"] >= 2), "mixed").when(hits["en"] > hits["es"], "en").otherwise("es")


def capital_share(text: Column) -> Column:
    letters = chars(text, r"\p{L}")
    return F.when(letters > 0, chars(text, r"\p{Lu}") / letters).otherwise(0.0)


SYMBOL = rf"[^\p{{L}}\p{{M}}\p{{N}}{JS_SPACE}.,;:!?¿¡'\"áéíóúÁÉÍÓÚñÑüÜ-]"
SHORT_TOKEN = r"(?<![A-Za-z0-9_])[A-Za-z](?![A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z])[\p{L}\p{M}](?=[A-Za-z0-9_])"


def symbol_share(text: Column) -> Column:
    """Symbols over words, the first part of the incoherence score."""
    return chars(text, SYMBOL) / F.greatest(word_count(text), F.lit(1))


def incoherence(text: Column) -> Column:
    score = symbol_share(text) + matches(text, SHORT_TOKEN) / F.greatest(word_count(text), F.lit(1))
    return F.when(js_trim(text) == "", 1.0).otherwise(F.least(F.lit(1.0), score))


def quality_status(n_words: Column, score: Column, given: Column | None = None) -> Column:
    review = F.when((n_words == 0) | (score > cleaning.INCOHERENT), "needs-review").otherwise("ready")
    return review if given is None else F.when((n_words > 0) & given.isNotNull(), given).otherwise(review)


def poor_text(text: Column) -> Column:
    """More than 2 % replacement or control characters, or less than half letters and digits, of what isn't space."""
    solid = F.regexp_replace(text, f"[{JS_SPACE}]", "")
    n = F.length(solid)
    bad = chars(solid, r"[\x{FFFD}\x00-\x08]")
    return (n > 0) & ((bad / n > 0.02) | (chars(solid, LETTER_OR_DIGIT) / n < 0.5))


def needs_ocr(text: Column) -> Column:
    return (matches(text, LETTER_OR_DIGIT) < 40) | poor_text(text)


def is_abbreviation(unit: Column) -> Column:
    bare = F.lower(F.regexp_replace(unit, r"[)\]\"'»”’]+$", ""))
    return bare.isin(*sorted(cleaning.ABBREVIATIONS)) | bare.rlike(r"^(?:\p{L}\.)+$")


def collapse_spaces(text: Column) -> Column:
    return js_trim(F.regexp_replace(text, f"[{JS_SPACE}]+", " "))


def locale(tag: Column) -> Column:
    return F.lower(F.replace(tag, F.lit("_"), F.lit("-")))


def numbered_bullet(text: Column) -> Column:
    return text.rlike(r"^(?:\d+(?:\.\d+)*|[a-zA-Z])[.)]\s+")


def divider(line: Column) -> Column:
    return line.rlike(r"^\s*(?:={3,}|-{3,}|(?:\*\s*){3,}|(?:_\s*){3,})\s*$")


def clean_marks(line: Column) -> Column:
    """A line without glyphs, inline marks and square or curly brackets, its spaces tidied (operators stay)."""
    bare = F.translate(line, cleaning.GLYPHS + cleaning.INLINE_MARKS + cleaning.BRACKETS, " " * len(cleaning.GLYPHS + cleaning.INLINE_MARKS + cleaning.BRACKETS))
    for pattern, to in ((r"\(\s+", "("), (r"\s+\)", ")"), (r"\s+([,.;:!?¿¡])", "$1"), (r"([¿¡])\s+", "$1"), (r"[ \t\f\x0B]+", " ")):
        bare = F.regexp_replace(bare, pattern, to)
    return F.when(divider(line), "").otherwise(js_trim(bare))


#: The request that goes with a text to a language model; fixed value.
PROMPT = (
    "Reconstruye este texto OCR para lectura en voz alta.",
    "No agregues datos externos ni afirmaciones nuevas.",
    "Corrige solo cortes, caracteres dañados, saltos de línea y frases rotas.",
    "Elimina citas parentéticas académicas cuando sean referencias, por ejemplo: (Autor, 2020).",
    "Conserva títulos, subtítulos, párrafos y listas cuando se puedan inferir.",
    "Devuelve únicamente el texto reconstruido.",
)


def prompt(text: Column) -> Column:
    return F.concat_ws("\n", *(F.lit(x) for x in PROMPT), F.lit(""), text)


def voice_label(name: Column) -> Column:
    """A voice's name without vendor, language and service."""
    short = F.regexp_replace(name, r"(?i)^Microsoft\s+", "")
    short = F.regexp_replace(short, r"(?iu)\s+-\s+(?:Spanish|Español)(?![A-Za-z0-9_]).*$", "")
    short = F.trim(F.regexp_replace(short, r"(?i)\s+Online\s*(?:\(Natural\))?", ""))
    return F.coalesce(F.nullif(short, F.lit("")), name)


def serialise_block(kind: Column, text: Column) -> Column:
    marked = text.rlike(r"^(?:[-*]|(?:\d+(?:\.\d+)*|[a-zA-Z])[.)])\s+")
    return F.when(kind == "heading", F.concat(F.lit("# "), text)).when(kind == "subheading", F.concat(F.lit("### "), text)).when((kind == "bullet") & ~marked, F.concat(F.lit("- "), text)).otherwise(text)


def serialise_blocks(blocks: Column) -> Column:
    """An array of (kind, text) as one marked text."""
    return F.array_join(F.transform(blocks, lambda b: serialise_block(b["kind"], b["text"])), "\n\n")


def word_start(text: Column, index: Column) -> Column:
    """Where (from 0) the word of that number begins: what the words and gaps before it are long; null beyond the last."""
    gaps, found = F.split(text, WORD), words(text)
    before = lambda n, xs: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    return F.when((index >= 0) & (index < F.size(found)), before((index + 1).cast("int"), gaps) + before(index.cast("int"), found))


def from_word(text: Column, index: Column) -> Column:
    """The text from that word on; all of it before the first, nothing after the last."""
    start = word_start(text, index)
    return F.when(index <= 0, text).when(start.isNull(), "").otherwise(F.substring(text, start + 1, F.length(text)))


def speech_text(text: Column) -> Column:
    """What is sent to a speech engine: trimmed, null if nothing is left."""
    return F.nullif(js_trim(text), F.lit(""))


def show_review(status: Column, ocr_available: Column) -> Column:
    return (status != "ready") & ocr_available
