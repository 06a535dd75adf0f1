"""JSON payloads, model answers and stored records: schemas and what is accepted, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import numbers
from lectern.functions import text as T

# Fixed values.
SOURCES = ("pastedText", "website", "googleDoc")
STORED_SOURCES = ("file", *SOURCES)
THEMES, MODES, LANGUAGES, SCALES = ("warm-paper", "night"), ("standard", "focus"), ("auto", "es", "en"), (0.9, 1.0, 1.1, 1.25)
KINDS = ("heading", "subheading", "paragraph", "bullet")
TITLE_CHARS, TEXT_CHARS, URL_CHARS, PROMPT_CHARS, ANSWER_CHARS = 180, 300_000, 4096, 24_000, 48_000
BODY_BYTES, ID_CHARS, TIME_CHARS = 4_000_000, 256, 64
FINISHED = ("stop", "eos", "end_turn")
DEFAULTS = {"voiceId": "browser-standard", "rate": 1.0, "theme": "warm-paper", "readingMode": "standard"}
PROGRESS_DEFAULTS = {"currentWord": 0, "currentTimeSeconds": 0.0, "percentage": 0.0, "estimatedRemainingSeconds": 0.0, "updatedAt": "1970-01-01T00:00:00.000Z"}
SESSION_DEFAULTS = {"signedIn": False, "userName": ""}

PAYLOAD = "source string, title string, text string, url string"
ANSWER = "text string, output string, finish_reason string, choices array<struct<text:string,message:struct<content:string>,finish_reason:string>>"
VOICE_CONFIG = "audio struct<sample_rate:double>, espeak struct<voice:string>, phoneme_type string, inference struct<noise_scale:double,length_scale:double,noise_w:double>"


def parse(raw: Column, schema: str) -> Column:
    """A struct, null where the text is no JSON object."""
    return F.when(F.get_json_object(raw, "$").isNotNull(), F.from_json(raw, schema, {"mode": "PERMISSIVE"}))


def body_status(raw: Column, declared: Column | None = None, most: int = BODY_BYTES) -> Column:
    """413 for a body that is or claims to be too long, 400 for one that isn't JSON, else null."""
    long_ = F.octet_length(raw) > most
    if declared is not None:
        long_ = long_ | F.coalesce(declared > most, F.lit(False))
    return F.when(long_, 413).when(F.get_json_object(raw, "$").isNull(), 400)


def payload_status(p: Column) -> Column:
    """413 if a field is too long, 400 if the source is unknown or the title empty or the url none, else null."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    long_ = (n(p["title"]) > TITLE_CHARS) | (n(p["text"]) > TEXT_CHARS) | (n(p["url"]) > URL_CHARS)
    bad = p.isNull() | ~F.coalesce(p["source"].isin(*SOURCES), F.lit(False)) | (p["title"] == "") | (p["url"].isNotNull() & ~p["url"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:.+"))
    return F.when(F.coalesce(long_, F.lit(False)), 413).when(F.coalesce(bad, F.lit(False)), 400)


def pasted_text(text: Column) -> Column:
    """Whether a text can be a document: not blank, not too long."""
    return F.coalesce((T.js_trim(text) != "") & (F.length(text) <= TEXT_CHARS), F.lit(False))


def prompt_allowed(text: Column) -> Column:
    return F.length(T.js_trim(text)).between(1, PROMPT_CHARS)


def answer(a: Column) -> Column:
    """The text of a model's answer, null unless it is finished and of an allowed length."""
    first = F.try_element_at(a["choices"], F.lit(1))
    reason = F.coalesce(first["finish_reason"], a["finish_reason"], F.lit(""))
    text = T.js_trim(F.coalesce(a["text"], a["output"], first["message"]["content"], first["text"], F.lit("")))
    return F.when(((reason == "") | reason.isin(*FINISHED)) & F.length(text).between(1, ANSWER_CHARS), text)


def client_message(status: Column, raw: Column, fallback: str) -> Column:
    """The error that a response reports, or a fallback; null for a success with a JSON body."""
    error = F.get_json_object(raw, "$.error")
    return F.when(status.between(200, 299) & F.get_json_object(raw, "$").isNotNull(), F.lit(None).cast("string")).otherwise(F.coalesce(error, F.lit(fallback)))


def bounded(record: Column, most: int = BODY_BYTES) -> Column:
    """A record as JSON, null if that is too long."""
    raw = F.to_json(record)
    return F.when(F.octet_length(raw) <= most, raw)


def voice_config_valid(c: Column) -> Column:
    positive = lambda v: v.isNotNull() & (v > 0) & (v < float("inf"))
    scales = positive(c["inference"]["noise_scale"]) & positive(c["inference"]["length_scale"]) & positive(c["inference"]["noise_w"])
    return F.coalesce((c["audio"]["sample_rate"] == 22050) & (c["espeak"]["voice"] == "es-419") & (c["phoneme_type"] == "espeak") & scales, F.lit(False))


def identifier_valid(c: Column) -> Column:
    return F.coalesce(F.length(c).between(1, ID_CHARS), F.lit(False))


def time_valid(c: Column) -> Column:
    return F.coalesce((F.length(c) <= TIME_CHARS) & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def preferences_valid(p: Column) -> Column:
    optional = lambda c, ok: c.isNull() | ok
    fine = (
        identifier_valid(p["voiceId"]) & p["rate"].isin(*numbers.RATES) & p["theme"].isin(*THEMES) & p["readingMode"].isin(*MODES)
        & optional(p["language"], p["language"].isin(*LANGUAGES)) & optional(p["textScale"], p["textScale"].isin(*SCALES))
    )
    return F.coalesce(fine, F.lit(False))


def progress_valid(p: Column) -> Column:
    fine = (p["currentWord"] >= 0) & (p["currentTimeSeconds"] >= 0) & p["percentage"].between(0, 100) & (p["estimatedRemainingSeconds"] >= 0) & time_valid(p["updatedAt"])
    return F.coalesce(fine, F.lit(False))


def with_defaults(given: Column, defaults: dict[str, object]) -> Column:
    return F.struct(*(F.coalesce(given[k], F.lit(v)).alias(k) for k, v in defaults.items()))


def default_state() -> Column:
    lit = lambda d: F.struct(*(F.lit(v).alias(k) for k, v in d.items()))
    return F.struct(lit(PROGRESS_DEFAULTS).alias("progress"), lit(DEFAULTS).alias("preferences"), lit(SESSION_DEFAULTS).alias("session"))


def pending_clear(raw: Column) -> Column:
    """private, plain or none: whether a checkpoint waits to be cleared, and whether it is an erased one."""
    pending = F.get_json_object(raw, "$.pendingClear") == "true"
    erased = (F.get_json_object(raw, "$.cleared") == "true") & (F.get_json_object(raw, "$.version") == "2") & identifier_valid(F.get_json_object(raw, "$.revision"))
    only = F.forall(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), lambda k: k.isin("version", "revision", "cleared", "pendingClear"))
    return F.when(~F.coalesce(pending, F.lit(False)), "none").when(F.coalesce(erased & only, F.lit(False)), "private").otherwise("plain")


def checkpoint_kind(raw: Column) -> Column:
    """erased, state, old or invalid, from a stored text."""
    version = F.get_json_object(raw, "$.version")
    only = F.forall(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), lambda k: k.isin("version", "revision", "cleared", "pendingClear"))
    erased = (F.get_json_object(raw, "$.cleared") == "true") & identifier_valid(F.get_json_object(raw, "$.revision")) & only
    return F.when(F.get_json_object(raw, "$").isNull(), "invalid").when((version == "2") & F.coalesce(erased, F.lit(False)), "erased").when(version == "2", "state").when(version.isNull() | (version == "1"), "old").otherwise("invalid")
