"""What searches need of the chunks, made once: postings of stems and trigrams, and embeddings, each with tenant and strategy.

Tables are stored below one folder and joined on stem or trigram and tenant, so a search reads no text but that of its candidates. ``update`` adds
what is missing; ``temporary`` makes them for one session.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundstelle.functions.python import hash_embed
from fundstelle.operators import ingest, lexical
from fundstelle.session import cut_lineage
from fundstelle.sources.sinks import existing

SCOPE = ["tenant_id", "strategy"]
_POSTINGS = "stem string, chunk_id string, tenant_id string, strategy string, places array<int>"
_TRIGRAMS = "trigram string, chunk_id string, tenant_id string, strategy string"
_VECTORS = "chunk_id string, tenant_id string, strategy string, model string, dim int, vec array<float>"


@dataclass
class Embedder:
    """A model's name and dimension and its functions for passages and questions, which may differ."""

    model: str
    dim: int
    passage: Callable[[Column], Column]
    question: Callable[[Column], Column]


def hashed(dim: int = 256) -> Embedder:
    """Counts of hashed words; passages and questions alike."""
    return Embedder("hash", dim, hash_embed(dim), hash_embed(dim))


@dataclass
class Index:
    postings: DataFrame
    trigrams: DataFrame
    vectors: DataFrame


def _vectors(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    return chunks.select(F.col("id").alias("chunk_id"), *SCOPE, F.lit(embedder.model).alias("model"), F.lit(embedder.dim).alias("dim"), embedder.passage(F.col("content_norm")).alias("vec"))


def temporary(chunks: DataFrame, embedder: Embedder) -> Index:
    """For one session: each table is written once to the shared folder."""
    own = chunks.select("id", *SCOPE, "content_norm")
    return Index(cut_lineage(lexical.german_postings(own, scope=SCOPE)), cut_lineage(lexical.trigram_postings(own, scope=SCOPE)), cut_lineage(_vectors(own, embedder)))


def update(chunks: DataFrame, folder: str, embedder: Embedder) -> None:
    """Appends what the stored tables don't have of ``chunks``; a second run adds nothing and stems and embeds nothing."""
    own = chunks.select("id", *SCOPE, "content_norm").dropDuplicates(["id"])
    parts = {
        "postings": (_POSTINGS, lambda new: lexical.german_postings(new, scope=SCOPE).select("stem", "chunk_id", *SCOPE, "places")),
        "trigrams": (_TRIGRAMS, lambda new: lexical.trigram_postings(new, scope=SCOPE)),
    }
    for name, (schema, make) in parts.items():
        seen = existing(chunks.sparkSession, f"{folder}/{name}", schema).select(F.col("chunk_id").alias("id")).distinct()
        key = schema.split()[0]
        make(own.join(seen, "id", "left_anti")).repartitionByRange(key).sortWithinPartitions(key).write.mode("append").parquet(f"{folder}/{name}")
    stored = existing(chunks.sparkSession, f"{folder}/vectors", _VECTORS)
    _vectors(ingest.missing_embeddings(own, stored, embedder.model), embedder).write.mode("append").parquet(f"{folder}/vectors")


def load(spark: SparkSession, folder: str) -> Index:
    return Index(*(existing(spark, f"{folder}/{name}", schema) for name, schema in (("postings", _POSTINGS), ("trigrams", _TRIGRAMS), ("vectors", _VECTORS))))
