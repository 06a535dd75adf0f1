"""Voices and cached assets: distinct, ranked, verified, complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Fixed values.
FEMALE = r"(?iu)dalia|sabina|paulina|helena|monica|mónica|female|mujer"
NATURAL = r"(?i)natural|online"
MAX_ASSETS, MAX_ASSET_BYTES, MAX_ASSETS_BYTES = 128, 2_000_000, 12_000_000


def numeric_key(name: Column) -> Column:
    """A sort key of a name without case and accents in which runs of digits sort by value."""
    plain = F.translate(F.lower(name), "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
    pieces = F.regexp_extract_all(plain, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def region_rank(locale: Column) -> Column:
    return F.when(locale == "es-mx", 0).when(locale.startswith("es-") & (locale != "es-es"), 1).otherwise(2)


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row, by order, of each key."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def _distinct_spanish(voices: DataFrame) -> DataFrame:
    known = voices.withColumn("locale", T.locale(F.col("lang"))).where(F.col("locale").rlike("^es(-|$)"))
    return first_of_each(known, ["uri", "locale", "name"], "ord")


def _place() -> list[Column]:
    return [region_rank(F.col("locale")).alias("r"), numeric_key(F.col("name")).alias("n"), F.col("ord")]


def spanish_voices(voices: DataFrame) -> DataFrame:
    """Distinct Spanish voices (ord, name, lang, uri, default) with locale and place: by region, then by name.

    Rows are numbered among those whose names begin alike; only the counts of beginnings are put in one order.
    """
    begin = F.substring("_n", 1, 3)
    named = _distinct_spanish(voices).withColumn("_r", region_rank(F.col("locale"))).withColumn("_n", numeric_key(F.col("name"))).withColumn("_b", begin)
    before = W.orderBy("_r", "_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = named.groupBy("_r", "_b").agg(F.count("*").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    own = F.row_number().over(W.partitionBy("_r", "_b").orderBy("_n", "ord"))
    return named.join(offsets, ["_r", "_b"]).withColumn("place", (F.col("_before") + own).cast("int")).drop("_r", "_n", "_b", "_before")


def preferred_voice(voices: DataFrame, manual_uri: str | None = None) -> DataFrame:
    """The voice of the best of eleven tiers, first by region and name; no row without Spanish voices. One aggregate."""
    own = _distinct_spanish(voices)
    mx, latin = F.col("locale") == "es-mx", region_rank(F.col("locale")) == 1
    female, natural = F.col("name").rlike(FEMALE), F.col("name").rlike(NATURAL)
    tiers = [F.col("uri") == F.lit(manual_uri), mx & female & natural, mx & female, mx & natural, mx & F.col("default"), mx, latin & natural, latin, female, F.col("default"), F.lit(True)]
    tier = F.coalesce(*(F.when(t, F.lit(i)) for i, t in enumerate(tiers)))
    rated = own.withColumn("tier", tier)
    return rated.agg(F.min_by(F.struct(*rated.columns), F.struct("tier", *_place())).alias("_row")).where("_row is not null").select("_row.*")


def asset_kind(url: Column) -> Column:
    """shell, script, style, font, image, manifest or other, by the path."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    return (
        F.when(path == "/", "shell").when(path.rlike(r"\.m?js$"), "script").when(path.endswith(".css"), "style").when(path.rlike(r"\.(woff2?|ttf|otf)$"), "font")
        .when(path.rlike(r"\.(png|jpe?g|svg|webp|gif|ico)$"), "image").when(path.rlike(r"\.(webmanifest|json)$"), "manifest").otherwise("other")
    )


def manifest(assets: DataFrame) -> DataFrame:
    """A row for each generation: assets, bytes, version (a digest of all entries in order) and whether the limits hold.

    assets: generation, url, content. A generation of more than MAX_ASSETS is counted, not gathered: it isn't valid and
    has no version.
    """
    entries = assets.select("generation", "url", asset_kind(F.col("url")).alias("kind"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    sums = entries.groupBy("generation").agg(F.count("*").alias("assets"), F.sum("bytes").alias("bytes"), F.bool_and(F.col("bytes").between(1, MAX_ASSET_BYTES)).alias("each"))
    small = sums.where(F.col("assets") <= MAX_ASSETS).select("generation")
    listed = entries.join(small, "generation", "left_semi").groupBy("generation").agg(F.sort_array(F.collect_list(F.struct("url", "kind", "bytes", "sha256"))).alias("entries"))
    version = F.sha2(F.array_join(F.transform("entries", lambda e: F.concat_ws(" ", e["url"], e["kind"], e["bytes"].cast("string"), e["sha256"])), "\n"), 256)
    both = sums.join(listed.select("generation", version.alias("version")), "generation", "left")
    return both.select("generation", "assets", "bytes", "version", (F.col("each") & (F.col("assets") <= MAX_ASSETS) & (F.col("bytes") <= MAX_ASSETS_BYTES)).alias("valid"))


#: Media types of each kind of asset; fixed values.
MEDIA = {"shell": ("text/html",), "script": ("text/javascript", "application/javascript"), "style": ("text/css",), "manifest": ("application/manifest+json", "application/json")}


def response_usable(status: Column, redirected: Column, kind: Column, media: Column) -> Column:
    own = F.coalesce(*(F.when(kind == k, media.isin(*v)) for k, v in MEDIA.items()), F.when(kind == "font", media.startswith("font/")), F.when(kind == "image", media.startswith("image/")), F.lit(True))
    return (status == 200) & ~redirected & own


def verified(content: Column, n_bytes: Column, sha256: Column) -> Column:
    """Whether a content has just the length and the digest that were promised."""
    return F.coalesce((F.octet_length(content) == n_bytes) & (F.sha2(content, 256) == sha256), F.lit(False))


def missing(wanted: DataFrame, cached: DataFrame, key: str = "url") -> DataFrame:
    """What a cache lacks; it is complete if there are no rows."""
    return wanted.join(cached, key, "left_anti")


def known(requests: DataFrame, assets: DataFrame, key: str = "url") -> DataFrame:
    return requests.join(assets.select(key).distinct(), key, "left_semi")


def from_generations(requests: DataFrame, caches: DataFrame) -> DataFrame:
    """requests (url) with the newest generation of caches (generation, url, complete) that has it; complete ones count."""
    hits = caches.where("complete").groupBy("url").agg(F.max("generation").alias("generation"))
    return requests.join(hits, "url", "left")


def route(method: Column, own_origin: Column, path: Column, has_range: Column, is_rsc: Column, is_known: Column) -> Column:
    """network, cache or old: how a request is served offline."""
    bypass = (method != "GET") | ~own_origin | is_rsc | has_range | path.startswith("/api/")
    return F.when(bypass, "network").when(is_known, "cache").when(path.rlike("^/_next/static/"), "old").otherwise("network")


def serve_shell(status: Column, complete: Column) -> Column:
    """network unless it failed (null) or answered 500 or more; then the cached shell if complete, else error."""
    return F.when(status.isNotNull() & (status < 500), "network").when(complete, "cache").otherwise("error")


def install(assets: DataFrame, fetched: DataFrame) -> DataFrame:
    """(generation, installed): all of a generation's assets (url, n_bytes, sha256) came whole (url, content), or nothing counts."""
    both = assets.join(fetched, ["generation", "url"], "left").select("generation", verified(F.col("content"), F.col("n_bytes"), F.col("sha256")).alias("ok"))
    return both.groupBy("generation").agg(F.bool_and("ok").alias("installed"))
