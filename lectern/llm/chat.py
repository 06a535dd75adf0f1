"""Chat formatting with typed content parts, in DataFrame expressions only.

A turn holds an array of parts. A visitor turns each part into a piece of the formatted text: text is escaped, image,
audio and document parts become placeholders in their order, and each placeholder's reference and expanded token count
is recorded as an attachment. A formatted conversation reads

    <|turn|>ROLE<|text|>CONTENT<|end|>\n  ...one for each turn

Inside roles and texts a backslash is doubled and each control string gets a backslash after its first character, so no
control string survives and reading back is exact. Neighbouring text parts are one run of text and escaped together: a
control string that is spread over several parts doesn't survive either.

Defined results: null text or role is empty; a null or unknown part type that carries text is text; other unknown types
are documents; turns are ordered by number (null first), ties by role and content, and repeated rows are all kept; a
table without rows gives none; columns other than the named ones are ignored. One conversation is one output row, so a
single conversation has to fit a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings with a meaning in this template or in other common ones; none is a prefix of another.
CONTROL = (TURN, TEXT, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Pixels on a side of an image patch, audio tokens a second, tokens of a document page.
PATCH, PER_SECOND, PER_PAGE = 28, 25.0, 512


def _quote(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|/" else c for c in text)


#: The first character of a control string, when the rest follows; overlapping strings are all found.
_STARTS = "|".join(f"{_quote(c[0])}(?={_quote(c[1:])})" for c in CONTROL)
_ANY_PLACEHOLDER = "|".join(_quote(p) for p in PLACEHOLDERS.values())


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_STARTS})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """The parts of a turn that is a plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).alias("ref"), F.lit(None).alias("width"), F.lit(None).alias("height"), F.lit(None).alias("seconds"), F.lit(None).alias("pages"))).cast(f"array<{PART}>")


def _kind(part: Column) -> Column:
    kind = F.lower(part["type"])
    known = F.when((kind == "text") | kind.isNull(), F.lit("text")).when(kind.isin(*PLACEHOLDERS), kind)
    return known.otherwise(F.when(part["text"].isNotNull(), F.lit("text")).otherwise(F.lit("document")))


def _expanded(part: Column) -> Column:
    """Tokens that a placeholder stands for; at least one."""
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(16 * PATCH)) / PATCH)
    image = side("width") * side("height")
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND)
    pages = F.coalesce(part["pages"], F.lit(1)) * PER_PAGE
    kind = _kind(part)
    return F.greatest(F.lit(1), F.when(kind == "image", image).when(kind == "audio", audio).otherwise(pages)).cast("long")


def _placeholder(part: Column) -> Column:
    return reduce(lambda c, k: c.when(_kind(part) == k, F.lit(PLACEHOLDERS[k])), PLACEHOLDERS, F.when(F.lit(False), F.lit("")))


def _content(parts: Column) -> Column:
    """Runs of text, escaped, with the placeholders between them: one run more than there are placeholders."""
    text = lambda p: F.coalesce(p["text"], F.lit(""))

    def runs(own: Column) -> Column:
        at = F.filter(F.transform(own, lambda p, i: F.when(_kind(p) != "text", i)), lambda i: i.isNotNull())
        bounds = lambda at: F.arrays_zip(F.concat(F.array(F.lit(-1)), at).alias("after"), F.concat(at, F.array(F.size(own))).alias("until"))
        run = lambda b: escape(F.array_join(F.transform(F.slice(own, b["after"] + 2, b["until"] - b["after"] - 1), text), ""))
        mark = lambda b: F.when(b["until"] < F.size(own), _placeholder(own[b["until"]])).otherwise("")
        return F.array_join(F.flatten(F.transform(F.array(at), lambda at: F.transform(bounds(at), lambda b: F.concat(run(b), mark(b))))), "")

    # through an array of one, so that the parts are worked out once; a turn that is one text needs no runs
    return F.transform(F.array(parts), lambda own: F.when(F.exists(own, lambda p: _kind(p) != "text"), runs(own)).otherwise(escape(F.array_join(F.transform(own, text), ""))))[0]


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv, formatted, segments (text, loss), attachments (turn, ordinal, kind, ref, tokens).

    The segments in their order make up the formatted text; loss marks the contents of turns whose role is in learn.
    The k-th placeholder of the formatted text belongs to the k-th attachment.
    """
    given = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    media = F.filter(given, lambda p: _kind(p) != "text")
    flat = turns.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            _content(given).alias("content"),
            F.transform(media, lambda p, i: F.struct(i.alias("ordinal"), _kind(p).alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens"))).alias("media"),
        ).alias("t"),
    )
    one = flat.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda t: F.array(piece(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)), no), piece(t["content"], t["role"].isin(*learn)), piece(F.lit(END + "\n"), no))))
    attachments = F.flatten(F.transform("turns", lambda t, i: F.transform(t["media"], lambda m: F.struct(i.alias("turn"), m["ordinal"].alias("ordinal"), m["kind"].alias("kind"), m["ref"].alias("ref"), m["tokens"].alias("tokens")))))
    made = one.select(F.col("conv").alias(conv), segments.alias("segments"), attachments.alias("attachments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted text; placeholders are left out of the texts."""
    rows = F.split(formatted, _quote(TURN))

    def turn(row: Column) -> Column:
        both = F.split(row, _quote(TEXT))
        content = F.split(both[1], _quote(END))[0]
        return F.struct(unescape(both[0]).alias("role"), unescape(F.regexp_replace(content, _ANY_PLACEHOLDER, "")).alias("text"))

    return F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), turn)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, without placeholders."""
    own = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(own, lambda s: unescape(F.regexp_replace(s["text"], _ANY_PLACEHOLDER, ""))), "")
