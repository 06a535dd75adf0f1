"""Addresses, requests and remote responses: what is let through, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DOCUMENT_HOST = "docs.google.com"
_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def is_ipv4(address: Column) -> Column:
    return address.rlike(_V4)


def is_public_ipv4(address: Column) -> Column:
    """Not this network, private, shared, loopback, link-local, test, benchmark, multicast or reserved."""
    part = F.split(address, r"\.")
    a, b, c = (F.try_element_at(part, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    special = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b.isin(168, 0) | ((b == 88) & (c == 99)))) | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113))
    )
    return F.coalesce(is_ipv4(address) & ~special, F.lit(False))


_GROUP = "[0-9A-Fa-f]{1,4}"


def _v6_groups(address: Column) -> Column:
    """The eight groups of an IPv6 address as an array of numbers, null if it isn't one; the last two may be an IPv4 address."""
    last = F.substring_index(address, ":", -1)
    part = lambda i: F.split(last, r"\.")[i].cast("int")
    pair = lambda i: F.lower(F.hex(part(i) * 256 + part(i + 1)))
    head = F.substring(address, F.lit(1), F.length(address) - F.length(last))
    plain = F.when(is_ipv4(last), F.concat(head, pair(0), F.lit(":"), pair(2))).otherwise(address)
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")

    def filled(text: Column) -> Column:
        before, after = groups(F.substring_index(text, "::", 1)), groups(F.substring_index(text, "::", -1))
        gap = F.lit(8) - F.size(before) - F.size(after)
        short = F.when(gap >= 1, F.concat(before, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(1))), after))
        return F.when(text.contains("::"), short).otherwise(F.when(F.size(groups(text)) == 8, groups(text)))

    # at most one `::`, no colon alone at an end, nothing but groups
    shape = plain.rlike(rf"^(?:{_GROUP}(?::{_GROUP})*)?(?:::(?:{_GROUP}(?::{_GROUP})*)?)?$") & plain.contains(":")
    full = F.transform(F.array(plain), filled)[0]
    return F.when(shape, F.transform(full, lambda g: F.conv(g, 16, 10).cast("int")))


def is_ipv6(address: Column) -> Column:
    return F.coalesce(_v6_groups(address).isNotNull(), F.lit(False))


def is_public_ipv6(address: Column) -> Column:
    """Global unicast (2000::/3), without tunnels, documentation and protocol ranges."""
    groups = _v6_groups(address)
    first, second = groups[0], groups[1]
    tunnel = (first == 0x2002) | ((first == 0x2001) & ((second < 0x200) | (second == 0xDB8))) | ((first == 0x3FFF) & (second < 0x1000))
    return F.coalesce(first.between(0x2000, 0x3FFF) & ~tunnel, F.lit(False))


def is_public(address: Column) -> Column:
    return is_public_ipv4(address) | is_public_ipv6(address)


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def remote_url_allowed(url: Column) -> Column:
    """http or https, with a host, without credentials."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.coalesce(scheme.isin("http", "https") & (authority != "") & ~authority.contains("@"), F.lit(False))


def document_id(url: Column) -> Column:
    """The id in the address of a shared document, null for any other address."""
    return F.nullif(F.regexp_extract(url, r"^https://(?i:docs[.]google[.]com)/document/d/([A-Za-z0-9_-]+)(?:[/?#].*)?$", 1), F.lit(""))


def export_url(document: Column) -> Column:
    return F.concat(F.lit(f"https://{DOCUMENT_HOST}/document/d/"), document, F.lit("/export?format=txt"))


def hop_verdict(method: Column, hop: Column, location: Column, scheme: Column, next_scheme: Column, all_public: Column, most: int = 3) -> Column:
    """What becomes of a redirect: allow, or the first reason to deny it."""
    return (
        F.when(~all_public, "private")
        .when((method == "POST") | (hop >= most) | location.isNull(), "redirect")
        .when(~next_scheme.isin("http", "https"), "url")
        .when((scheme == "https") & (next_scheme != "https"), "insecure")
        .otherwise("allow")
    )


def follow(hops: DataFrame, addresses: DataFrame) -> DataFrame:
    """hops (request_id, hop, method, scheme, next_scheme, location) with their verdict.

    addresses (request_id, hop, address): one address that isn't public denies the hop, and so does none.
    """
    seen = addresses.groupBy("request_id", "hop").agg(F.bool_and(is_public(F.col("address"))).alias("all_public"))
    both = hops.join(seen, ["request_id", "hop"], "left").withColumn("all_public", F.coalesce("all_public", F.lit(False)))
    return both.withColumn("verdict", hop_verdict(F.col("method"), F.col("hop"), F.col("location"), F.col("scheme"), F.col("next_scheme"), F.col("all_public")))


def same_origin(origin: Column, scheme: Column, host: Column, fetch_site: Column) -> Column:
    """Whether a request comes from the page's own origin; forwarded headers have no say."""
    usable = host.isNotNull() & (host != "") & ~host.rlike(r"[\s,/@\\?#]")
    bare = F.when(scheme == "https", F.regexp_replace(F.lower(host), ":443$", "")).otherwise(F.regexp_replace(F.lower(host), ":80$", ""))
    return F.coalesce((F.coalesce(fetch_site, F.lit("")) != "cross-site") & scheme.isin("http", "https") & usable & (origin == F.concat(scheme, F.lit("://"), bare)), F.lit(False))


def media_type(header: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(header, F.lit("")), ";", 1)))


def policy_valid(p: Column) -> Column:
    """A policy (scope, max_client, max_global, window_ms, max_active, max_bytes): windows of 1 to 300 s, max_global may be null."""
    counts = (p["max_client"] >= 1) & (p["max_active"] >= 1) & (p["max_bytes"] >= 1) & F.coalesce(p["max_global"] >= 1, F.lit(True))
    return F.coalesce((p["scope"] != "") & counts & p["window_ms"].between(1_000, 300_000), F.lit(False))


def gate(own_origin: Column, content_type: Column, length: Column, allowed: tuple[str, ...], max_bytes: int, policy: Column | None = None, limited: Column | None = None) -> Column:
    """The status of the first check that a request fails, null if none: policy, origin, media type, size, quota."""
    too_long = length.isNotNull() & (~length.rlike(r"^\d+$") | (length.try_cast("decimal(38,0)") > max_bytes))
    no_policy = F.lit(False) if policy is None else ~policy_valid(policy)
    over_quota = F.lit(False) if limited is None else F.coalesce(limited, F.lit(False))
    return F.when(no_policy, 500).when(~own_origin, 403).when(~media_type(content_type).isin(*allowed), 415).when(too_long, 413).when(over_quota, 429)


def client_key(forwarded: Column) -> Column:
    """A digest of the address that a request names as its client, if it is one."""
    first = F.trim(F.substring_index(F.coalesce(forwarded, F.lit("")), ",", 1))
    return F.when(is_ipv4(first) | is_ipv6(first), F.sha2(first, 256)).otherwise("unidentified")


def error_status(code: Column, own: Column) -> Column:
    """The status for an error: too large, malformed, one that brings its own, or unexpected."""
    return F.when(code == "too_big", 413).when(code == "invalid", 400).when(own.isNotNull(), own).otherwise(500)


def retry_headers(retry_after: Column) -> Column:
    base = F.create_map(F.lit("cache-control"), F.lit("no-store"))
    return F.when(F.coalesce(retry_after, F.lit(0)) > 0, F.map_concat(base, F.create_map(F.lit("retry-after"), retry_after.cast("string")))).otherwise(base)


def concurrency(events: DataFrame, scope: str = "scope", at: str = "at", seq: str = "seq", change: str = "change") -> DataFrame:
    """events with active: slots in use after each acquire (+1) or release (-1)."""
    order = W.partitionBy(scope).orderBy(at, seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.withColumn("active", F.sum(change).over(order))
