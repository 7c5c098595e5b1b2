"""Readers of the base tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; rows with a null in a key form a key of their own.

    For narrow rows: ``max_by``-like aggregation would keep the whole row in an aggregation buffer,
    so a ranking window is used, which Spark limits per partition before the shuffle.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_documents(source_documents: DataFrame) -> DataFrame:
    """source_documents with one row per id: the furthest status, then the latest time.

    Rows are delivered again, at times with an older status; ``ready`` and ``failed`` are final.
    A null id is dropped, for nothing can refer to it.
    """
    stage = F.when(F.col("status").isin("ready", "failed"), 3).when(F.col("status") == "embedding", 2).when(F.col("status") == "parsing", 1).otherwise(0)
    return one_per_key(
        source_documents.filter(F.col("id").isNotNull()), ["id"],
        [stage.desc(), F.col("created_at").desc_nulls_last(), F.col("filename").asc_nulls_last()],
    )
