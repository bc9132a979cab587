"""Egress, redirect and fetch rules as expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import any_of, trim_space
from .urls import host, scheme

#: Address blocks that are not public.
PRIVATE_BLOCKS = [
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]
PRIVATE_V6_BLOCKS = ["::1/128", "fc00::/7", "fe80::/10", "ff00::/8"]
#: Presets as rows of a policy table: (name, schemes, max redirects, private addresses allowed).
POLICIES = [("external", ["http", "https"], 5, False), ("internal", ["http", "https"], 5, True)]
MAX_BODY, MAX_DECOMPRESSED = 5 << 20, 20 << 20
ALLOWED_TYPES = ["text/html", "application/xhtml+xml", "text/plain"]
#: Fixed value: what counts as a script.
SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
JS_RAW_BYTES, JS_TEXT_BYTES, JS_SCRIPT_SHARE = 1024, 200, 0.5
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"


def policies(spark: SparkSession) -> DataFrame:
    """The presets as a table, to be joined by name."""
    return spark.createDataFrame(POLICIES, "policy string, schemes array<string>, max_redirects int, allow_private boolean")


def is_ipv4(address: Column) -> Column:
    return F.rlike(address, F.lit(IPV4))


def ipv4_number(address: Column) -> Column:
    octets = F.split(address, r"\.")
    return sum((F.element_at(octets, i + 1).cast("long") * (1 << 8 * (3 - i)) for i in range(1, 4)), F.element_at(octets, 1).cast("long") * (1 << 24))


def is_public_ipv4(address: Column) -> Column:
    """P22 for IPv4; null for anything else. 0.0.0.0 and link-local and multicast addresses are not public."""
    number = ipv4_number(address)
    inside = []
    for block in PRIVATE_BLOCKS:
        base, _, bits = block.partition("/")
        low = sum(int(x) << 8 * (3 - i) for i, x in enumerate(base.split(".")))
        inside.append(number.between(low, low + (1 << 32 - int(bits)) - 1))
    return F.when(is_ipv4(address), ~any_of([number == 0, *inside]))


def address_public(text: str | None) -> bool | None:
    """P22 of one address of either family; None for what is no address. Embedded IPv4 addresses are judged as such."""
    try:
        ip = ipaddress.ip_address(text or "")
    except ValueError:
        return None
    if "%" in (text or ""):
        return None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    blocks = PRIVATE_BLOCKS if ip.version == 4 else PRIVATE_V6_BLOCKS
    return int(ip) != 0 and not any(ip in ipaddress.ip_network(b) for b in blocks)


@F.pandas_udf(T.BooleanType())
def _is_public_v6(address: pd.Series) -> pd.Series:
    return address.map(address_public)


@F.pandas_udf(T.BooleanType())
def _all_public(answers: pd.Series) -> pd.Series:
    return pd.Series([None if own is None else all(address_public(a) for a in own) for own in answers], dtype=object)


def is_public_ip(address: Column) -> Column:
    """P22 for both families: IPv4 by ranges; IPv6 by an Arrow UDF. Null for no address."""
    return F.when(F.contains(address, F.lit(":")), _is_public_v6(address)).otherwise(is_public_ipv4(address))


def choose_user_agent(url: Column, override: Column, default: Column, pool: Column, respect_robots: Column) -> Column:
    """the override; the default where robots are respected or the pool is empty; else one of the pool, by the hash of the URL, so that
    reruns agree."""
    picked = F.element_at(pool, (F.pmod(F.xxhash64(url), F.greatest(F.size(pool), F.lit(1))) + 1).cast("int"))
    return F.when(F.coalesce(override, F.lit("")) != "", override).when(respect_robots | (F.size(pool) == 0), default).otherwise(picked)


def egress_reason(url: Column, schemes: Column, deny: Column, allow: Column, allow_private: Column, answers: Column) -> Column:
    """The first reason to block, or null. Literal addresses are judged themselves, other hosts by
    ``answers``, the addresses of either family that they resolve to (null if they do not)."""
    h = host(url)
    folded = lambda items: F.transform(items, F.lower)
    literal, private = is_public_ip(h), ~_all_public(answers)
    return (
        F.when(~F.array_contains(folded(schemes), scheme(url)), "scheme_not_allowed").when(h == "", "empty_host").when(F.array_contains(folded(deny), h), "host_denied")
        .when((F.size(allow) > 0) & ~F.array_contains(folded(allow), h), "host_not_allowlisted").when(allow_private, F.lit(None))
        .when(literal.isNotNull(), F.when(~literal, "private_ip_blocked")).when(answers.isNull() | (F.size(answers) == 0), "resolve_failed").when(private, "private_ip_blocked")
    )


def mime_allowed(content_type: Column, allowed: list[str] = ALLOWED_TYPES) -> Column:
    """Parameters stripped, case folded."""
    return F.lower(trim_space(F.substring_index(content_type, ";", 1))).isin(allowed)


def fetch_budget(size: Column, decompressed: Column, gzip: Column, sniffed: Column) -> Column:
    """Why a body is refused, or null."""
    return F.when(size > MAX_BODY, "too_large").when(gzip & (decompressed > MAX_DECOMPRESSED), "decompressed_too_large").when(~mime_allowed(sniffed), "non_html")


def fetch_outcome(status: Column, error: Column, reason: Column) -> Column:
    """Of the last attempt: errors, 429 and 5xx fail once retries are spent; other statuses are bodies."""
    return F.when(error.isNotNull() | (status == 429) | (status >= 500), "fetch_failed").when(reason.isNotNull(), reason).otherwise("ok")


def should_retry(status: Column, error: Column) -> Column:
    return error.isNotNull() | (status == 429) | (status >= 500)


def js_required(html: Column, text: Column) -> Column:
    """P20: 1024 raw bytes or more, under 200 bytes of trimmed text, over half of the raw bytes in scripts."""
    scripts = F.aggregate(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(0)), F.lit(0), lambda n, s: n + F.octet_length(s))
    raw = F.octet_length(html)
    return (raw >= JS_RAW_BYTES) & (F.octet_length(trim_space(F.coalesce(text, F.lit("")))) < JS_TEXT_BYTES) & (scripts / raw > JS_SCRIPT_SHARE)


def render_unwrap(content_type: Column, body: Column) -> Column:
    """A JSON reply's html, else its body, else the reply itself."""
    json = F.contains(F.lower(content_type), F.lit("application/json"))
    part = lambda name: F.nullif(F.get_json_object(body, f"$.{name}"), F.lit(""))
    return F.when(json, F.coalesce(part("html"), part("body"), body)).otherwise(body)


def provider_error_kind(status: Column, condition: Column) -> Column:
    """condition is deadline, cancelled or null."""
    return (
        F.when(condition == "deadline", "timeout").when(condition == "cancelled", "cancelled").when(status.isin(401, 403), "auth").when(status == 429, "rate_limit")
        .when(status >= 500, "upstream").when(status >= 400, "bad_request").otherwise("network")
    )


def error_status(kind: Column) -> Column:
    """(HTTP status, code) of a classified error; null kind: an unclassified one."""
    status = F.when(kind.isNull(), 500).when(kind == "rate_limit", 429).when(kind == "timeout", 504).when(kind == "cancelled", 499).otherwise(502)
    named = ["auth", "rate_limit", "upstream", "timeout", "bad_request"]
    code = F.when(kind.isNull(), "error").when(kind == "cancelled", "cancelled").when(kind.isin(named), F.concat(F.lit("provider_"), kind)).otherwise("provider_network")
    return F.struct(status.alias("status"), code.alias("code"))


def mask_key(key: Column) -> Column:
    """F32: the last four characters of a longer key."""
    return F.when(F.coalesce(key, F.lit("")) == "", "").when(F.octet_length(key) <= 4, "***").otherwise(F.concat(F.lit("***"), F.right(key, F.lit(4))))


def mask_url(url: Column) -> Column:
    """F32: credentials between :// and the first @."""
    at, start = F.instr(url, "@"), F.instr(url, "://")
    masked = F.concat(F.substr(url, F.lit(1), start + 2), F.lit("…@"), F.substr(url, at + 1))
    return F.when((at > 0) & (start > 0) & (start + 3 < at), masked).otherwise(F.coalesce(url, F.lit("")))
