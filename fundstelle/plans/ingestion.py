"""Files or blocks to stored chunks and embeddings, idempotent and resumable: each stage appends what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.python import hash_embed
from fundstelle.operators import chunking, ingest
from fundstelle.sources.sinks import existing, insert_new


def both_strategies(blocks: DataFrame, tenant_id: str) -> DataFrame:
    """Chunks of both strategies as rows to store, each with the pages, section and boxes of its own words."""
    structural = chunking.structural_chunks(blocks).withColumn("strategy", F.lit("structural"))
    fixed = chunking.fixed_chunks(blocks).withColumn("strategy", F.lit("fixed_500"))
    return ingest.with_parents(ingest.chunk_rows(structural.unionByName(fixed).withColumn("tenant_id", F.lit(tenant_id)))).drop("parent_ordinal")


def store(blocks: DataFrame, tenant_id: str, folder: str, model: str = "hash", dim: int = 256) -> None:
    """Appends new chunks and missing embeddings below ``folder``; a second run adds nothing and embeds nothing."""
    spark = blocks.sparkSession
    rows = both_strategies(blocks, tenant_id)
    insert_new(rows, f"{folder}/chunks", ["document_id", "strategy", "chunk_hash"], [F.col("ordinal")])
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/chunks")
    schema = "chunk_id string, model string, dim int, vec array<float>"
    embedded = existing(spark, f"{folder}/embeddings", schema)
    missing = ingest.missing_embeddings(stored.select("id", "content_norm"), embedded, model).dropDuplicates(["id"])
    vectors = missing.select(F.col("id").alias("chunk_id"), F.lit(model).alias("model"), F.lit(dim).alias("dim"), hash_embed(dim)("content_norm").alias("vec"))
    vectors.write.mode("append").parquet(f"{folder}/embeddings")
