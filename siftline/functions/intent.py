"""Query intent, variants and backend text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, let, rank_tokens, split_words, trim_space
from .urls import host as url_host

#: Fixed values.
RANK_FRESH_PHRASES = ["this week", "this month"]
RANK_FRESH_TOKENS = ["latest", "recent", "new", "news", "today", "2024", "2025", "2026"]
SEARCH_FRESH_WORDS = ["latest", "recent", "news", "today"]
DOCS_WORDS = ["api", "sdk", "docs", "documentation", "error", "install", "configure", "config", "golang", "python", "kotlin", "java", "javascript", "typescript", "node", "react", "cli"]
TIME_RANGES = ["", "day", "month", "year"]
DEPTHS = ["", "fast", "ultra-fast", "basic", "advanced"]


def is_fresh_for_ranking(q: Column) -> Column:
    """P17."""
    phrase = any_of([F.contains(F.lower(q), F.lit(p)) for p in RANK_FRESH_PHRASES])
    return phrase | F.arrays_overlap(rank_tokens(q), F.array(*map(F.lit, RANK_FRESH_TOKENS)))


def ascii_words(q: Column) -> Column:
    return split_words(F.lower(q), "[^a-z0-9]+")


def contains_word(q: Column, word: str) -> Column:
    """F24."""
    return F.array_contains(ascii_words(q), word)


def is_fresh_for_search(q: Column) -> Column:
    """Another rule than P17: whole ASCII words, or a year from 2000 to 2099."""
    year = F.rlike(F.lower(q), F.lit("(?<![0-9A-Za-z_])20[0-9]{2}(?![0-9A-Za-z_])"))
    return F.arrays_overlap(ascii_words(q), F.array(*map(F.lit, SEARCH_FRESH_WORDS))) | year


def is_docs_query(q: Column) -> Column:
    """P19."""
    return F.arrays_overlap(ascii_words(q), F.array(*map(F.lit, DOCS_WORDS)))


def freshness_variant(q: Column) -> Column:
    """F23."""
    return F.concat(q, F.when(~contains_word(q, "news"), " news").when(~contains_word(q, "latest"), " latest").otherwise(" recent updates"))


def docs_variant(q: Column) -> Column:
    """F23."""
    known = F.contains(F.lower(q), F.lit("official docs")) | F.contains(F.lower(q), F.lit("official documentation"))
    return F.when(known, q).otherwise(F.concat(q, F.when(contains_word(q, "documentation"), " official").otherwise(" official docs")))


def query_variants(q: Column) -> Column:
    """(label, q, exact) in order: original, exact, freshness, docs; white space collapsed, repeats of (q, exact) and empty ones
    dropped."""
    clean = lambda x: F.array_join(split_words(x, r"(?U)\s+"), " ")
    make = lambda label, x, exact: F.struct(F.lit(label).alias("label"), clean(x).alias("q"), F.lit(exact).alias("exact"))
    n_words = F.size(split_words(q, r"(?U)\s+"))
    all_ = F.array(
        make("original", q, False), F.when(n_words > 1, make("exact", q, True)),
        F.when(is_fresh_for_search(q), make("freshness", freshness_variant(q), False)), F.when(is_docs_query(q), make("docs", docs_variant(q), False)),
    )
    real = F.filter(all_, lambda v: v.isNotNull() & (v["q"] != ""))
    return let(real, lambda a: F.filter(a, lambda v, i: ~F.exists(F.slice(a, F.lit(1), i), lambda w: (w["q"] == v["q"]) & (w["exact"] == v["exact"]))))


def domain_host(domain: Column) -> Column:
    """Host of a site term: keeps ``www.``, strips ``*.``."""
    d = F.lower(trim_space(domain))
    full = F.when(F.contains(d, F.lit("://")), d).otherwise(F.concat(F.lit("https://"), d))
    return F.when(d == "", "").otherwise(F.regexp_replace(url_host(full), r"^\*\.", ""))


def _site_terms(domains: Column, prefix: str) -> Column:
    return F.transform(F.filter(F.transform(domains, domain_host), lambda h: h != ""), lambda h: F.concat(F.lit(f"{prefix}site:"), h))


def backend_query_text(q: Column, exact: Column, include: Column, exclude: Column) -> Column:
    """Exact queries are quoted once; one include term bare, several as (a OR b); exclude terms follow."""
    text = trim_space(q)
    quoted = (F.length(text) >= 2) & F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"'))
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    head = F.when(exact & ~quoted, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(text)
    inc = _site_terms(include, "")
    middle = F.when(F.size(inc) == 0, F.array().cast("array<string>")).when(F.size(inc) == 1, inc).otherwise(F.array(F.concat(F.lit("("), F.array_join(inc, " OR "), F.lit(")"))))
    return F.array_join(F.concat(F.array(head), middle, _site_terms(exclude, "-")), " ")


def candidate_budget(depth: Column, max_results: Column, results_cap: Column) -> Column:
    """1, 5 or 3 times the results, from max_results to the cap."""
    d = F.lower(trim_space(F.coalesce(depth, F.lit(""))))
    times = F.when(d.isin("fast", "ultra-fast"), 1).when(d == "advanced", 5).otherwise(3)
    return F.least(F.greatest(max_results * times, max_results), results_cap)


def normalize_domain_filter(item: Column) -> Column:
    """P10: the bare host of a filter, or empty if it is not valid: it needs a dot and no white space."""
    d = F.lower(trim_space(item))
    full = F.when(F.contains(d, F.lit("://")), d).otherwise(F.concat(F.lit("https://"), d))
    h = F.regexp_replace(F.regexp_replace(url_host(full), r"^\*\.", ""), r"^www\.", "")
    return F.when((d == "") | F.rlike(d, F.lit(r"[ \t\r\n]")) | ~F.contains(h, F.lit(".")), "").otherwise(h)


def control_error(time_range: Column, safesearch: Column, include: Column, exclude: Column, chunks: Column, depth: Column) -> Column:
    """P10: the first control that is not valid, or null."""
    bad = lambda items: F.exists(items, lambda x: normalize_domain_filter(x) == "")
    tidy = lambda c: F.lower(trim_space(F.coalesce(c, F.lit(""))))
    return (
        F.when(~tidy(time_range).isin(TIME_RANGES), "time_range").when((safesearch < 0) | (safesearch > 2), "safesearch").when(bad(include), "include_domains")
        .when(bad(exclude), "exclude_domains").when((chunks < 0) | (chunks > 3), "chunks_per_source").when(~tidy(depth).isin(DEPTHS), "search_depth")
    )
