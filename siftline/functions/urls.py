"""URL functions (F1, F2, P6, P7, P12-P15), on the generic-syntax regular expression of RFC 3986."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, let, trim_space

#: Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "igshid"]
SOCIAL_HOSTS = ["x.com", "twitter.com", "facebook.com", "instagram.com", "tiktok.com", "reddit.com", "linkedin.com", "threads.net", "bsky.app"]
REFERENCE_HOSTS = ["wikipedia.org", "britannica.com"]
REFERENCE_PATHS = ["/wiki/", "/reference/", "/encyclopedia/"]
ARTICLE_PATHS = ["/news/", "/article/", "/articles/", "/blog/", "/posts/", "/2024/", "/2025/", "/2026/"]
EXTRACTOR_VERSION = "1"

#: scheme, authority, path, ?query, #fragment
PATTERN = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATTERN, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Host and port, without user information."""
    return F.regexp_replace(_part(url, 2), "^.*@", "")


def host(url: Column) -> Column:
    """Lower-cased host without port or the brackets of an IPv6 address."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), r":[0-9]*$", ""), r"^\[|\]$", ""))


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":([0-9]+)$", 1)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return F.substring(_part(url, 4), 2, 1 << 30)


def _escape(value: Column) -> Column:
    """Query escaping: space as +, and -_.~ kept."""
    return F.replace(F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _canonical_query(raw: Column) -> Column:
    pair = lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), F.try_url_decode(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("v"))
    pairs = F.transform(F.filter(F.split(raw, "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";"))), pair)
    kept = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull() & ~F.lower(p["k"]).isin(TRACKING))
    return F.array_join(F.transform(F.sort_array(kept), lambda p: F.concat(_escape(p["k"]), F.lit("="), _escape(p["v"]))), "&")


def canonical_url(url: Column) -> Column:
    """null without scheme or host; lower-cased scheme and host, no default port, no fragment, no tracking parameters, the
    others sorted by key and value and escaped anew."""
    default = ((scheme(url) == "http") & (port(url) == "80")) | ((scheme(url) == "https") & (port(url) == "443"))
    suffix = F.when((port(url) == "") | default, "").otherwise(F.concat(F.lit(":"), port(url)))
    base = F.concat(scheme(url), F.lit("://"), host(url), suffix, path(url))
    kept = let(_canonical_query(query(url)), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.when((scheme(url) != "") & (host(url) != ""), F.concat(base, kept))


def artifact_key(canonical: Column, rendered: bool = False) -> Column:
    """of the extracted page, or of the page after rendering."""
    return F.concat(F.lit(f"fa:v{EXTRACTOR_VERSION}:"), F.sha2(canonical, 256), F.lit(":r" if rendered else ""))


def format_key(canonical: Column, fmt: Column) -> Column:
    return F.concat(F.lit(f"fmt:v{EXTRACTOR_VERSION}:"), F.sha2(canonical, 256), F.lit(":"), F.lower(fmt))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def _on_hosts(h: Column, hosts: list[str]) -> Column:
    return any_of([(h == x) | h.endswith("." + x) for x in hosts])


def is_social(url: Column) -> Column:
    """P12."""
    return _on_hosts(bare_host(url), SOCIAL_HOSTS)


def is_homepage(url: Column) -> Column:
    """P13."""
    return (F.regexp_replace(path(url), "^/+|/+$", "") == "") & (query(url) == "") & (F.length(_part(url, 5)) <= 1)


def is_reference(url: Column) -> Column:
    """P14."""
    return _on_hosts(bare_host(url), REFERENCE_HOSTS) | any_of([F.contains(F.lower(path(url)), F.lit(x)) for x in REFERENCE_PATHS])


def is_article(url: Column) -> Column:
    """P15."""
    return any_of([F.contains(F.lower(path(url)), F.lit(x)) for x in ARTICLE_PATHS])


def domain_filters(items: Column) -> Column:
    """Items like ``*.example.com/docs`` as (host, path); what has no host is dropped."""
    item = lambda x: F.lower(trim_space(x))
    full = lambda x: F.when(F.contains(item(x), F.lit("://")), item(x)).otherwise(F.concat(F.lit("https://"), item(x)))
    parse = lambda x: F.struct(F.regexp_replace(F.regexp_replace(host(full(x)), r"^\*\.", ""), r"^www\.", "").alias("host"), F.regexp_replace(path(full(x)), "/+$", "").alias("path"))
    return F.filter(F.transform(F.filter(items, lambda x: item(x) != ""), parse), lambda f: f["host"] != "")


def matches_domain(url: Column, filters: Column) -> Column:
    """Any filter's host is the URL's or a parent of it, and its path is a string prefix."""
    h, p = bare_host(url), F.regexp_replace(path(url), "/+$", "")
    return F.exists(filters, lambda f: ((h == f["host"]) | F.endswith(h, F.concat(F.lit("."), f["host"]))) & F.startswith(p, f["path"]))


def domain_allowed(url: Column, include: Column, exclude: Column) -> Column:
    """P5: no include filter or any matches, and no exclude filter matches."""
    inc, exc = domain_filters(include), domain_filters(exclude)
    return ((F.size(inc) == 0) | matches_domain(url, inc)) & ~matches_domain(url, exc)
