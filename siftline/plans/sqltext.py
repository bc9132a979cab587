"""DuckDB expressions of the text and URL functions."""

from __future__ import annotations

SPACE = r"[\s\x0b\x85\p{Z}]+"


def fields(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '{SPACE}'), lambda t: t <> '')"


def rank_tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{Nd}}]+'), lambda t: strlen(t) > 1)"


def chunk_tokens(x: str) -> str:
    return rf"list_transform({rank_tokens(x)}, lambda t: CASE WHEN strlen(t) > 3 AND ends_with(t, 's') THEN substr(t, 1, length(t) - 1) ELSE t END)"


def ordered_distinct(x: str) -> str:
    return rf"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def grams(x: str, n: int) -> str:
    return rf"list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string({x}[i:i + {n - 1}], ' '))"


def phrases(x: str) -> str:
    joined = f"list_concat(list_concat({grams(x, 4)}, {grams(x, 3)}), {grams(x, 2)})"
    return joined


_URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: str, i: int) -> str:
    return rf"regexp_extract({url}, '{_URL}', {i})"


def scheme(url: str) -> str:
    return f"lower({part(url, 1)})"


def authority(url: str) -> str:
    return f"regexp_replace({part(url, 2)}, '^.*@', '')"


def host(url: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({authority(url)}, ':[0-9]*$', ''), '^\[|\]$', '', 'g'))"


def port(url: str) -> str:
    return rf"regexp_extract({authority(url)}, ':([0-9]+)$', 1)"


def path(url: str) -> str:
    return part(url, 3)


def bare_host(url: str) -> str:
    return rf"regexp_replace({host(url)}, '^www\.', '')"


def _escape(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def canonical(url: str) -> str:
    from ..functions.urls import TRACKING

    tracking = ", ".join(f"'{t}'" for t in TRACKING)
    decode = lambda x: f"url_decode(replace({x}, '+', ' '))"
    pair = f"{{'k': {decode("split_part(p, '=', 1)")}, 'v': CASE WHEN contains(p, '=') THEN {decode("substr(p, instr(p, '=') + 1)")} ELSE '' END}}"
    pairs = f"list_transform(list_filter(string_split(substr({part(url, 4)}, 2), '&'), lambda p: p <> '' AND NOT contains(p, ';')), lambda p: {pair})"
    kept = f"list_sort(list_filter({pairs}, lambda x: lower(x.k) NOT IN ({tracking})))"
    query = f"array_to_string(list_transform({kept}, lambda x: {_escape('x.k')} || '=' || {_escape('x.v')}), '&')"
    p, s = port(url), scheme(url)
    shown = f"CASE WHEN {p} = '' OR ({s} = 'http' AND {p} = '80') OR ({s} = 'https' AND {p} = '443') THEN '' ELSE ':' || {p} END"
    return f"CASE WHEN {s} <> '' AND {host(url)} <> '' THEN {s} || '://' || {host(url)} || {shown} || {path(url)} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"


def any_contains(x: str, items: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{i}')" for i in items) + ")"


def on_hosts(h: str, hosts: list[str]) -> str:
    return "(" + " OR ".join(f"{h} = '{x}' OR ends_with({h}, '.{x}')" for x in hosts) + ")"


def is_social(url: str) -> str:
    from ..functions.urls import SOCIAL_HOSTS

    return on_hosts(bare_host(url), SOCIAL_HOSTS)


def is_homepage(url: str) -> str:
    return f"(regexp_replace({path(url)}, '^/+|/+$', '', 'g') = '' AND length({part(url, 4)}) <= 1 AND length({part(url, 5)}) <= 1)"


def is_reference(url: str) -> str:
    from ..functions.urls import REFERENCE_HOSTS, REFERENCE_PATHS

    return f"({on_hosts(bare_host(url), REFERENCE_HOSTS)} OR {any_contains(f'lower({path(url)})', REFERENCE_PATHS)})"


def is_article(url: str) -> str:
    from ..functions.urls import ARTICLE_PATHS

    return any_contains(f"lower({path(url)})", ARTICLE_PATHS)


def is_recent(published: str, as_of: str) -> str:
    return f"coalesce({published} <= {as_of} AND {published} >= {as_of} - INTERVAL 90 DAY, false)"


def in_list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def is_fresh_for_ranking(q: str) -> str:
    from ..functions.intent import RANK_FRESH_PHRASES, RANK_FRESH_TOKENS

    return f"({any_contains(f'lower({q})', RANK_FRESH_PHRASES)} OR list_has_any({rank_tokens(q)}, {in_list(RANK_FRESH_TOKENS)}))"


def ascii_words(q: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({q}), '[^a-z0-9]+'), lambda w: w <> '')"


def is_fresh_for_search(q: str) -> str:
    from ..functions.intent import SEARCH_FRESH_WORDS

    return rf"(list_has_any({ascii_words(q)}, {in_list(SEARCH_FRESH_WORDS)}) OR regexp_matches(lower({q}), '\b20[0-9]{{2}}\b'))"


def is_docs_query(q: str) -> str:
    from ..functions.intent import DOCS_WORDS

    return f"list_has_any({ascii_words(q)}, {in_list(DOCS_WORDS)})"
