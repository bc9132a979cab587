"""Tokens, shingles, chunks and other text functions.

Lengths that the semantics count in bytes use octet_length. Token arrays are bound once per row with ``let``: a lambda
argument is evaluated once, whereas a nested expression would be evaluated for each element.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the scoring and splitting rules.
MAX_CHUNK_BYTES = 500
CJK_RATIO = 0.3
WORD_SHINGLE = 3
CJK_SHINGLE = 2
MAX_PHRASE = 4

_UNICODE_SPACE = r"(?U)\s+"
#: The characters that trimming takes away.
SPACES = "\t\n\v\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_space(text: Column) -> Column:
    """The text without white space at either end, of any kind."""
    return F.btrim(text, F.lit(SPACES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column, separators: str) -> Column:
    return F.filter(F.split(text, separators), lambda x: x != "")


def rank_tokens(text: Column) -> Column:
    """lower-cased runs of letters and digits of more than one byte; repeats kept. Null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda x: F.octet_length(x) > 1)


def chunk_tokens(text: Column) -> Column:
    """as F3, then one trailing ``s`` is dropped from tokens of more than three bytes."""
    strip = lambda x: F.when((F.octet_length(x) > 3) & x.endswith("s"), F.substring(x, 1, F.length(x) - 1)).otherwise(x)
    return F.transform(rank_tokens(text), strip)


#: A token of more than three bytes that ends in ``s``: what stands before the s has three bytes or more.
_PLURAL = r"(?<= )([^ ]{3,}|[^\x00-\x7F ][^ ]|[^ ][^\x00-\x7F ]|[\x{0800}-\x{10FFFF}])s(?= )"


def chunk_token_string(text: Column) -> Column:
    """F4 as one string, ``"  one  two  "``: each token between spaces of its own. Counting a token or finding a run of tokens is then a
    plain substring operation, and all steps are regular expressions within generated code."""
    spaced = F.concat(F.lit("  "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+", "  "), F.lit("  "))
    longer = F.regexp_replace(F.regexp_replace(spaced, r"(?<= )[\x00-\x7F](?= )", ""), " {3,}", "  ")
    return F.regexp_replace(longer, _PLURAL, "$1")


def tokens_in(token_string: Column) -> Column:
    return ((F.length(token_string) - F.length(F.replace(token_string, F.lit("  ")))) / 2 - 1).cast("int")


def count_in(token_string: Column, token: Column) -> Column:
    own = F.concat(F.lit(" "), token, F.lit(" "))
    return ((F.length(token_string) - F.length(F.replace(token_string, own))) / F.length(own)).cast("int")


def phrase_in(token_string: Column, phrase: Column) -> Column:
    """F7."""
    return F.contains(token_string, F.concat(F.lit(" "), F.replace(phrase, F.lit(" "), F.lit("  ")), F.lit(" ")))


def fields(text: Column) -> Column:
    """Words between white space of any script."""
    return split_words(F.lower(F.coalesce(text, F.lit(""))), _UNICODE_SPACE)


def normalize_text(text: Column) -> Column:
    """F16: lower-cased, white space collapsed."""
    return F.array_join(fields(text), " ")


def word_count(text: Column) -> Column:
    """A17."""
    return F.size(split_words(F.coalesce(text, F.lit("")), _UNICODE_SPACE))


def ngrams(tokens: Column, n: int | Column) -> Column:
    """Joined runs of n tokens; none if there are fewer."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def content_characters(text: Column) -> Column:
    """The text without white space, punctuation and control characters."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\p{P}\p{Cc}]", "")


def cjk_characters(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", "")


def is_cjk_dominant(text: Column) -> Column:
    """three tenths of the content characters or more are Han, Hiragana, Katakana or Hangul."""
    total = F.length(content_characters(text))
    return (total > 0) & (F.length(cjk_characters(text)) >= F.lit(CJK_RATIO) * total)


def cjk_shingles(text: Column, n: int = CJK_SHINGLE) -> Column:
    """distinct character n-grams of the lower-cased content; a shorter text is its own shingle, an empty one has none."""
    content = F.lower(content_characters(text))
    size = F.length(content)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array(F.lit(1)))
    return F.when(size > 0, let(content, lambda c: F.array_distinct(F.transform(starts, lambda i: F.substr(c, i, F.lit(n)))))).otherwise(F.array().cast("array<string>"))


def word_shingles(text: Column, n: int = WORD_SHINGLE) -> Column:
    """Distinct word n-grams, or the distinct words of a text with fewer than n."""
    return let(fields(text), lambda t: F.array_distinct(F.when(F.size(t) >= n, ngrams(t, n)).otherwise(t)))


def shingles(text: Column) -> Column:
    """word trigrams, or character bigrams where CJK dominates."""
    return F.when(is_cjk_dominant(text), cjk_shingles(text)).otherwise(word_shingles(text))


def jaccard(a: Column, b: Column) -> Column:
    """A10: of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def phrases(tokens: Column) -> Column:
    """distinct n-grams of the distinct query tokens, the longest (up to four) first."""
    runs = [F.when(F.size(tokens) >= n, ngrams(tokens, n)).otherwise(F.array().cast("array<string>")) for n in range(MAX_PHRASE, 1, -1)]
    return F.array_distinct(F.concat(*runs))


def query_profile(query: Column) -> Column:
    """the distinct chunk tokens in order, and their phrases."""
    return let(F.array_distinct(chunk_tokens(query)), lambda t: F.struct(t.alias("terms"), phrases(t).alias("phrases")))


def phrase_boost(phrase: Column, n_terms: Column) -> Column:
    """F6."""
    n = F.size(F.split(phrase, " "))
    return F.when(n == n_terms, 0.75).otherwise(F.lit(0.18) * (n - 1))


def length_multiplier(n_tokens: Column) -> Column:
    """F8."""
    return F.when(n_tokens <= 0, 0.0).when(n_tokens < 6, 0.85).when(n_tokens <= 90, 1.0).otherwise(F.greatest(F.lit(0.72), 1 - (n_tokens - 90) / F.lit(220.0)))


def cut_chunks(text: str | None, most: int = MAX_CHUNK_BYTES) -> list[str]:
    """F9 on one text. Cuts are made in bytes; a cut inside a character leaves U+FFFD on both sides."""
    out: list[str] = []
    for paragraph in (text or "").strip().split("\n\n"):
        rest = paragraph.strip().encode()
        while len(rest) > most:
            at = max(rest.rfind(mark, 0, most) for mark in (b".", b"!", b"?", b" "))
            at = at if at >= most // 2 else most
            out.append(rest[:at].decode(errors="replace").strip())
            rest = rest[at:].decode(errors="replace").strip().encode()
        if rest:
            out.append(rest.decode())
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_chunks(text: pd.Series) -> pd.Series:
    """paragraphs, cut at the last of ``.!? `` within 500 bytes (hard at 500 if that is under 250). The cut is a loop over bytes, which
    built-in expressions lack; Arrow hands over batches."""
    return text.map(cut_chunks)


def count_of(values: Column, value: Column) -> Column:
    return F.size(F.filter(values, lambda x: x == value))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
