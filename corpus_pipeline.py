"""A training corpus from raw documents: toxicity, near-duplicates, decontamination, mixing, token files.

Each stage but the last returns the columns of its input, whatever their names; an empty table stays empty; texts of any length are
read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontaminate, mixing, near_copies, token_files, toxicity
from siftline.llm.common import materialize, table
from siftline.llm.queries import tokenizer_path

#: A fitted model rejects documents, so SQL cannot express the rows.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5. Null and empty texts score by the curve at no evidence; repeated rows go or stay
    together. Without labels of both kinds nothing is dropped."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).filter("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of five-word shingles are similar to 0.8 or more: that of the smallest doc_id,
    nulls last; of equal ids the smallest text hash; of rows alike one. Null, empty and wordless texts are one group."""
    return near_copies.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in benchmark passages. Null, empty and wordless texts stay; an empty
    benchmark drops nothing; repeated rows go or stay together."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~decontaminate.is_contaminated(F.col("found"))).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null, empty and wordless texts have no size and are not taken; a null source is a
    source of its own; repeated rows are drawn one by one."""
    return mixing.repeat_documents(docs, mixing.mix(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what they hold by document. Null and empty texts are the end id alone; null ids come
    first; a document that the mix repeats has a row for each copy."""
    return token_files.read_token_files(spark, token_files.write_token_files(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
