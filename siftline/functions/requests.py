"""Gates, caps and defaults of requests as expressions (P11, P26, F20, F30, F39): each error is the first that holds, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space
from .urls import authority, scheme

#: The least thinking budget, the kinds of providers, and below the texts of the errors.
LEAST_BUDGET = 1024
KINDS = ["openai", "anthropic"]


def is_blank(text: Column) -> Column:
    return trim_space(F.coalesce(text, F.lit(""))) == ""


def option_error(admin: Column, respect_robots: Column, proxy_url: Column) -> Column:
    """Only an admin key may turn robots off or name a proxy. respect_robots is null where the request leaves it open."""
    return F.when(~admin & ~F.coalesce(respect_robots, F.lit(True)), "forbidden: respect_robots=false requires admin key").when(
        ~admin & (F.coalesce(proxy_url, F.lit("")) != ""), "forbidden: proxy_url requires admin key"
    )


def override_error(
    admin: Column, model: Column, provider: Column, thinking: Column, max_tokens: Column, timeout_ms: Column, instructions: Column, allowed: list[str], tokens_cap: int, timeout_cap_ms: int, instructions_cap: int,
) -> Column:
    """What a summary request may not override, and its caps. thinking is a struct (enabled, budget_tokens, effort) or null; ``allowed``
    names the overrides that are open to all keys; the length of instructions counts in bytes."""
    barred = lambda name: F.lit(name not in allowed) & ~admin
    tokens, timeout = F.coalesce(max_tokens, F.lit(0)), F.coalesce(timeout_ms, F.lit(0))
    return (
        F.when(~is_blank(model) & barred("model"), "model override not allowed").when(~is_blank(provider) & barred("provider"), "provider override not allowed")
        .when(thinking.isNotNull() & barred("thinking"), "thinking override not allowed").when(tokens > F.greatest(F.lit(tokens_cap), F.lit(0)), "max_tokens over cap")
        .when(thinking["budget_tokens"] > tokens_cap, "thinking budget_tokens over cap").when(timeout < 0, "timeout_ms must be >= 0")
        .when(timeout > F.greatest(F.lit(timeout_cap_ms), F.lit(0)), "timeout_ms over cap").when(F.octet_length(F.coalesce(instructions, F.lit(""))) > instructions_cap, "instructions over cap")
    )


def _budget_too_small(thinking: Column) -> Column:
    return thinking["enabled"] & (thinking["budget_tokens"] > 0) & (thinking["budget_tokens"] < LEAST_BUDGET)


def request_error(model: Column, prompt: Column, max_tokens: Column, thinking: Column) -> Column:
    """of a request to a language model."""
    small = F.concat(F.lit(f"thinking.budget_tokens must be >= {LEAST_BUDGET} (got "), thinking["budget_tokens"].cast("string"), F.lit(")"))
    return F.when(is_blank(model), "model required").when(is_blank(prompt), "user prompt required").when(max_tokens < 0, "max_tokens must be >= 0").when(_budget_too_small(thinking), small)


def provider_error(name: Column, kind: Column, model: Column, base_url: Column, timeout_ms: Column, thinking: Column) -> Column:
    """of a provider's configuration. An empty base URL is none."""
    given = F.coalesce(base_url, F.lit("")) != ""
    return (
        F.when(is_blank(name), "name required").when(~F.coalesce(kind, F.lit("")).isin(KINDS), 'kind must be "openai" or "anthropic"').when(is_blank(model), "model required")
        .when(given & ~F.coalesce(scheme(base_url), F.lit("")).isin("http", "https"), "base_url: scheme must be http or https").when(given & (F.coalesce(authority(base_url), F.lit("")) == ""), "base_url: host required")
        .when(timeout_ms < 0, "timeout must be >= 0").when(_budget_too_small(thinking), f"thinking.budget_tokens must be >= {LEAST_BUDGET}")
    )


def choose_text(requested: Column, default: Column) -> Column:
    """the request's text unless it is blank."""
    return F.when(is_blank(requested), default).otherwise(requested)


def choose_positive(requested: Column, default: Column) -> Column:
    """the request's number if it is above 0."""
    return F.when(requested > 0, requested).otherwise(default)


def merge_thinking(requested: Column, default: Column) -> Column:
    """the request's settings replace the default's as a whole."""
    return F.coalesce(requested, default)


def first_set(*values: Column) -> Column:
    """the first value that is not empty, or an empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))
