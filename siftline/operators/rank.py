"""BM25 with title weight, engine bonus and quality adjustments.

Statistics are those of a request: every aggregate is grouped by query_id. Of a document, only its length and its query
terms are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent, urls
from ..functions.text import rank_tokens
from ..session import cut

#: Fixed values.
K1, B, TITLE_WEIGHT, ENGINE_BONUS_MAX = 1.5, 0.75, 2.0, 0.25
RECENT_DAYS = 90
LOWEST, HIGHEST = -1.5, 0.5


def token_profile(candidates: DataFrame, key: str, query: str = "q", title: str = "title", body: str = "text") -> DataFrame:
    """One row per candidate: query_id, key, dl (tokens of title and body), hits (its query terms and their tf).

    Tokens are exploded from a plain split, and put together again by a map-side aggregate that keeps no more of a document than its
    length and its query terms.
    """
    weighted = lambda weight, c: F.struct(F.lit(weight).alias("w"), F.lower(F.coalesce(F.col(c), F.lit(""))).alias("s"))
    rows = candidates.select("query_id", key, F.array_distinct(rank_tokens(F.col(query))).alias("_q"), title, body)
    sides = rows.select("query_id", key, "_q", F.explode(F.array(weighted(TITLE_WEIGHT, title), weighted(1.0, body))).alias("_s"))
    tokens = sides.select("query_id", key, "_q", "_s.w", F.explode(F.split("_s.s", r"[^\p{L}\p{Nd}]+")).alias("term"))
    real = F.octet_length("term") > 1
    hit = F.when(real & F.array_contains("_q", F.col("term")), F.col("term"))
    # all tokens that are no query term fall into one group of the document, within the map task
    grouped = tokens.select("query_id", key, "w", real.alias("real"), hit.alias("term")).groupBy("query_id", key, "term").agg(F.count_if("real").alias("n"), F.sum("w").alias("tf"))
    found = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    return grouped.groupBy("query_id", key).agg(F.sum("n").cast("int").alias("dl"), F.collect_list(found).alias("hits"))


def corpus_stats(profile: DataFrame) -> DataFrame:
    """Per query the number of documents and their mean length (1 if that is 0)."""
    stats = profile.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len"))
    return stats.withColumn("avg_len", F.when(F.col("avg_len") == 0, 1.0).otherwise(F.col("avg_len")))


def query_terms(candidates: DataFrame, query: str = "q") -> DataFrame:
    """(query_id, term, repeats) of each request."""
    queries = candidates.groupBy("query_id").agg(F.min(query).alias("_q"))
    return queries.select("query_id", F.explode(rank_tokens(F.col("_q"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("int").alias("repeats"))


def term_frequencies(profile: DataFrame, key: str) -> DataFrame:
    """A row for each (document, query term) that occurs: tf counts the body once and the title twice."""
    return profile.select("query_id", key, "dl", F.explode("hits").alias("h")).select("query_id", key, "dl", "h.term", "h.tf")


def inverse_document_frequencies(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    df = frequencies.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    return df.join(stats, "query_id").withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def bm25(candidates: DataFrame, key: str) -> DataFrame:
    """(query_id, key, bm25) of every candidate; repeated query tokens count again, documents without a term score 0."""
    profile = cut(token_profile(candidates, key))  # read four times below
    frequencies = term_frequencies(profile, key)
    idf = inverse_document_frequencies(frequencies, corpus_stats(profile)).join(query_terms(candidates), ["query_id", "term"])
    part = F.col("repeats") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_len")))
    scored = frequencies.join(idf.select("query_id", "term", "repeats", "idf", "avg_len"), ["query_id", "term"])
    scores = scored.groupBy("query_id", key).agg(F.sum(part).alias("bm25"))
    return profile.select("query_id", key).join(scores, ["query_id", key], "left").select("query_id", key, F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def engine_bonus(engines: Column) -> Column:
    """by the length of the list, repeats included."""
    n = F.coalesce(F.size(engines), F.lit(0))
    return F.when(n > 1, ENGINE_BONUS_MAX * F.least((n - 1) / F.lit(2.0), F.lit(1.0))).otherwise(0.0)


def is_recent(published_at: Column, as_of: Column) -> Column:
    """Published from 90 days before to the time itself."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(published_at.cast("timestamp"))
    return F.coalesce(age.between(0, RECENT_DAYS * 86_400_000_000), F.lit(False))


def quality_adjustment(query: Column, url: Column, published_at: Column, unsupported: Column, as_of: Column) -> Column:
    """F19, within -1.5 and 0.5."""
    when = lambda c, x: F.when(c, x).otherwise(0.0)
    fresh = when(urls.is_social(url), -0.7) + when(urls.is_homepage(url), -0.45) + when(urls.is_reference(url), -0.25) + when(is_recent(published_at, as_of) & urls.is_article(url), 0.35)
    base = when(F.coalesce(unsupported, F.lit("")) != "", -1.0)
    return F.least(F.greatest(base + F.when(intent.is_fresh_for_ranking(query), fresh).otherwise(when(urls.is_reference(url), 0.15)), F.lit(LOWEST)), F.lit(HIGHEST))


def total_score(query: Column, bm25: Column, engines: Column, quality: Column) -> Column:
    """What results are sorted by. A query without tokens scores nothing, so its results keep their order."""
    return F.when(F.size(rank_tokens(query)) == 0, F.lit(0.0)).otherwise(F.round(bm25 + engine_bonus(engines) + quality, 9))


def ranked(scored: DataFrame, limit: int | None = None, score: str = "score", pos: str = "pos") -> DataFrame:
    """Rank within the query by score, earlier rows first among equals; at most ``limit`` rows a query."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), pos)))
    return out.filter(F.col("rank") <= limit) if limit else out
