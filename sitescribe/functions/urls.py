"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths that are never followed.
IGNORED_PATHS = [r"^/(api|auth|account|login|signup)(/|$)", r"^/(static|assets|cdn)/", r"\.(mp3|mp4|pdf|zip|png|jpe?g|svg|webp|ico)(\?|$)"]


def normalize_domain(domain: Column) -> Column:
    """Trimmed, lower case, without one leading ``www.``; null is empty."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(domain, F.lit("")))), r"^www\.", "")


def authority(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)


def domain_of(url: Column) -> Column:
    """Authority (port and user included), normalised."""
    return normalize_domain(authority(url))


def path_of(url: Column) -> Column:
    """Path, ``/`` where it is empty."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)


def sorted_query(url: Column) -> Column:
    """Query parameters in order, blank values kept."""
    return F.array_join(F.array_sort(F.filter(F.split(query_of(url), "&"), lambda x: x != "")), "&")


def canonical_path(url: Column) -> Column:
    """Path without trailing slashes, ``/`` for the root."""
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(path == "", F.lit("/")).otherwise(path)


def canonical_url(url: Column) -> Column:
    query = sorted_query(url)
    return F.concat(F.lit("https://"), domain_of(url), canonical_path(url), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def origin_prefix(url: Column) -> Column:
    """scheme://authority/path without trailing slashes, lower-cased up to the path."""
    head = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1))
    return F.concat(head, F.regexp_replace(path_of(url), "/+$", ""))


def without_dots(path: Column) -> Column:
    """``path`` with its ``.`` and ``..`` segments worked out."""
    parts = F.split(path, "/")
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x))))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(kept, ends), "/")


def resolved(href: Column, base: Column) -> Column:
    """``href`` against ``base`` by RFC 3986; an address with a scheme stays as it is."""
    scheme, head = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    path, tail = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    same = F.concat(head, F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(path.startswith("/"), F.concat(head, without_dots(path), tail))
        .when(path != "", F.concat(head, without_dots(F.concat(folder, path)), tail))
        .when(tail.startswith("?"), F.concat(same, tail))
        .otherwise(F.concat(same, F.when(query_of(base) == "", F.lit("")).otherwise(F.concat(F.lit("?"), query_of(base))), tail))
    )


def same_origin_prefix(url: Column, origin: Column) -> Column:
    """``url`` begins with ``origin`` and goes on with nothing or a slash."""
    rest = F.substring(url, F.length(origin) + 1, F.lit(1))
    return url.startswith(origin) & rest.isin("", "/", "?", "#")


def ignored_path(path: Column) -> Column:
    out = F.lit(False)
    for pattern in IGNORED_PATHS:
        out = out | path.rlike("(?i)" + pattern)
    return out


def ignored_domain(domain: Column, ignored: list[str]) -> Column:
    """Equal to an ignored domain or below it."""
    out = F.lit(False)
    for name in ignored:
        out = out | (domain == name) | domain.endswith("." + name)
    return out


def looks_like_domain(value: Column) -> Column:
    return F.lower(F.trim(value)).rlike(r"^[a-z0-9.\-]+\.[a-z]{2,24}$") & ~value.contains("://")


def cache_key(url: Column, params: Column) -> Column:
    """Digests of URL and parameters that name a cached page."""
    return F.concat(F.substring(F.md5(url), 1, 16), F.lit("_"), F.substring(F.md5(params), 1, 12), F.lit(".html"))


def start_url(value: Column) -> Column:
    """An address as it is, a bare domain with scheme and root."""
    return F.when(value.contains("://"), value).otherwise(F.concat(F.lit("https://"), value, F.lit("/")))


def is_homepage(url: Column) -> Column:
    """A host with or without scheme, and no path but the root."""
    return url.rlike(r"^(https?://)?[^/]*/?$")


def allowed(url: Column, domains: list[str]) -> Column:
    """Of one of the domains exactly, and not on an ignored path."""
    return domain_of(url).isin(*domains) & ~ignored_path(path_of(url))


def should_follow(url: Column, origin: Column, ignored: list[str] | None = None) -> Column:
    """An address below the origin's prefix, neither on an ignored path nor of an ignored domain."""
    inside = (F.coalesce(url, F.lit("")) != "") & same_origin_prefix(url, origin) & ~ignored_path(path_of(url))
    return F.coalesce(inside & ~ignored_domain(domain_of(url), ignored or []), F.lit(False))
