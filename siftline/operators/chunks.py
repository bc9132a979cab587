"""Query-focused passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_token_string, count_in, length_multiplier, let, phrase_boost, phrase_in, query_profile, split_chunks, tokens_in, trim_space

MAX_PER_SOURCE = 3
FREQUENCY_WEIGHT, CONTEXT_CAP = 0.35, 0.18


def source_text(main_text: Column, markdown: Column) -> Column:
    """the main text, or the Markdown where that is blank."""
    blank = lambda c: trim_space(F.coalesce(c, F.lit(""))) == ""
    return F.when(~blank(main_text), main_text).when(~blank(markdown), markdown).otherwise("")


def scoring_context(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def chunk_score(profile: Column, chunk: Column, context: Column) -> Column:
    """F10. profile: query_profile; chunk and context: token strings."""
    terms, phrases = profile["terms"], profile["phrases"]
    counts = F.transform(terms, lambda t: F.struct(count_in(chunk, t).alias("n"), count_in(context, t).alias("c")))

    def score(matched: Column) -> Column:
        hits = total(F.transform(matched, lambda x: x["n"].cast("double")))
        boost = total(F.transform(F.filter(phrases, lambda p: phrase_in(chunk, p)), lambda p: phrase_boost(p, F.size(terms)).cast("double")))
        known = F.least(total(F.transform(F.filter(matched, lambda x: x["c"] > 0), lambda x: 0.06 + 0.02 * F.log1p(x["c"]))), F.lit(CONTEXT_CAP))
        raw = F.size(matched) / F.size(terms) + FREQUENCY_WEIGHT * F.log1p(hits) / F.size(terms) + boost + known
        return F.when(F.size(matched) == 0, 0.0).otherwise(raw * length_multiplier(tokens_in(chunk)))

    return let(F.filter(counts, lambda x: x["n"] > 0), score)


def score_parts(parts: DataFrame, *keys: str, query: str = "q", chunk: str = "chunk", context: str = "context") -> DataFrame:
    """Scores of given chunks: the keys, chunk, score. Those of a query without terms go."""
    rows = parts.withColumns({"_p": query_profile(F.col(query)), "_s": chunk_token_string(F.col(chunk)), "_c": chunk_token_string(F.col(context))})
    return rows.filter(F.size("_p.terms") > 0).select(*keys, chunk, chunk_score(F.col("_p"), F.col("_s"), F.col("_c")).alias("score"))


def score_chunks(sources: DataFrame, *keys: str, query: str = "q", text: str = "text", context: str = "context") -> DataFrame:
    """A row per chunk of each text: the keys, chunk_no (from 0), chunk, score."""
    parts = sources.select(*keys, query, context, F.posexplode(split_chunks(text)).alias("chunk_no", "chunk"))
    return score_parts(parts, *keys, "chunk_no", query=query, context=context)


def top_chunks(scored: DataFrame, per_source: int, *keys: str) -> DataFrame:
    """The best chunks of each source with a score over 0, earlier ones first among equals; three at most. The score is tested behind
    the window, so that it is computed once; chunks without one rank last."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_no"))
    return scored.withColumn("chunk_rank", place).filter((F.col("chunk_rank") <= min(per_source, MAX_PER_SOURCE)) & (F.col("score") > 0))
