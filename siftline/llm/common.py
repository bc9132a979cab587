"""Shared storage and table helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A cluster must name one."""
    return checkpoint_folder(spark).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused folder path under the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return it reread.

    Cuts the lineage without keeping anything on an executor: a lost executor costs no more than the tasks that
    were running on it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32(doc_id as text) mod divisor; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def take_rows(docs: DataFrame, plan: DataFrame, doc_id: Column, row_hash: Column) -> DataFrame:
    """The rows of docs, each ``copies`` times, by the plan's (id, row_hash, copies, rows).

    rows tells how many rows of docs have that id and hash; if there are several, they are alike, and one of them is taken
    ``copies`` times. The columns of docs are kept as they are, whatever their names.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(doc_id.alias("__id"), row_hash.alias("__hash"), whole.alias("__row"))
    wanted = plan.filter("copies > 0").select(F.col("id").alias("__i"), F.col("row_hash").alias("__h"), F.col("copies").alias("__copies"), F.col("rows").alias("__rows"))
    found = keyed.join(wanted, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h"))).drop("__i", "__h")
    several = found.filter("__rows > 1").groupBy("__id", "__hash").agg(F.first("__row").alias("__row"), F.first("__copies").alias("__copies"))
    out = found.filter("__rows = 1").select("__row", "__copies").unionByName(several.select("__row", "__copies"))
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).select("__row.*")
