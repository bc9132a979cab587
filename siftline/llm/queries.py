"""The queries of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language, mixing, simhash, token_counts, token_files, topk, toxicity, url_filter
from .common import table

#: The rules of the URL query: fixed values.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = token_counts.count_tokens(tokenizer_path("piece_bpe_32k.model"))
    return table(spark, sf_dir, "documents").select("doc_id", count("text").alias("c")).select("doc_id", "c.*")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnable = language.not_held_out(F.col("doc_id"))
    predict = language.predict_language(spark, language.fit(docs.filter(learnable)))
    held = F.coalesce(~learnable, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, files)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = found.select("row.doc_id", F.col("found").alias("f"))
    items = F.col("f.item_ids")
    return found.select("doc_id", "f.n_words", "f.n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), decontaminate.is_contaminated(F.col("f")).alias("contaminated"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    scored = scored.select("row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.parse_rules(URL_RULES), "verdict string, rule string, host string, path string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_language, op3_token_files, op4_mixing, op5_decontaminate, op6_toxicity, op7_simhash, op8_chat, op9_topk, op10_url_filter)
}
