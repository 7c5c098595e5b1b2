"""Keyed writes as anti joins and rewrites: idempotent inserts, get-or-create, parents, backfills, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundstelle.functions import text as T
from fundstelle.functions.python import compose_rows


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``incoming`` to append: one per key, and none whose key exists. With ``order``, the first in it is taken."""
    if order:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        once = incoming.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    else:
        once = incoming.dropDuplicates(keys)
    return once.join(existing.select(*keys), keys, "left_anti")


def get_or_create(uploads: DataFrame, existing: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``document_id, outcome`` to ``uploads(tenant_id, content_hash, ...)``: created, duplicate, in_progress or retrying.

    The first upload (in ``order``) of a tenant's content creates its document, under an id made of both; an existing failed one is retried.
    """
    known = existing.groupBy("tenant_id", "content_hash").agg(F.min(F.struct("id", "status")).alias("d")).select("tenant_id", "content_hash", F.col("d.id").alias("_id"), F.col("d.status").alias("_status"))
    first = F.row_number().over(Window.partitionBy("tenant_id", "content_hash").orderBy(*order))
    out = uploads.join(known, ["tenant_id", "content_hash"], "left").withColumn("_n", first)
    outcome = F.when(F.col("_id").isNull(), F.when(F.col("_n") == 1, "created").otherwise("in_progress")).when(F.col("_status") == "ready", "duplicate").when(F.col("_status") == "failed", "retrying").otherwise("in_progress")
    made = F.sha2(F.concat_ws("\x00", "tenant_id", "content_hash"), 256)
    return out.withColumn("document_id", F.coalesce("_id", made)).withColumn("outcome", outcome).drop("_id", "_status", "_n")


def chunk_rows(chunks: DataFrame, ocr_pages: DataFrame | None = None) -> DataFrame:
    """Rows to store from chunks (document_id, tenant_id, strategy, ordinal, content, page_from, page_to, ...): normal text, hash, id, OCR flag."""
    out = compose_rows(chunks.withColumn("content_norm", F.col("content")), "content_norm").withColumn("content_norm", T.normalize_codes(F.col("content_norm"))).withColumn("chunk_hash", content_hash(F.col("content")))
    out = out.withColumn("id", F.sha2(F.concat_ws("\x00", "document_id", "strategy", "chunk_hash"), 256))
    if ocr_pages is None:
        return out.withColumn("ocr", F.lit(False))
    pages = ocr_pages.groupBy("document_id").agg(F.collect_set("page").alias("_pages"))
    flag = F.exists(F.sequence("page_from", "page_to"), lambda p: F.array_contains("_pages", p))
    return out.join(pages, "document_id", "left").withColumn("ocr", F.coalesce(flag, F.lit(False))).drop("_pages")


def with_parents(chunks: DataFrame) -> DataFrame:
    """Adds ``parent_id``: the id of the chunk with ``parent_ordinal`` in the same document and strategy."""
    parents = chunks.groupBy("document_id", "strategy", F.col("ordinal").alias("parent_ordinal")).agg(F.min("id").alias("parent_id"))
    return chunks.drop("parent_id").join(parents, ["document_id", "strategy", "parent_ordinal"], "left")


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    return chunks.join(embeddings.filter(F.col("model") == model).select(F.col("chunk_id").alias("id")), "id", "left_anti")


def backfill_regions(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """``regions`` where they are null, from ``found(document_id, chunk_hash, regions)``."""
    new = found.groupBy("document_id", "chunk_hash").agg(F.first("regions").alias("_new"))
    return chunks.join(new, ["document_id", "chunk_hash"], "left").withColumn("regions", F.coalesce("regions", "_new")).drop("_new")


def delete_cascade(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents of ``gone(id)`` and all that depends on them."""
    dead = chunks.join(gone.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("id").distinct()
    return documents.join(gone.select("id"), "id", "left_anti"), chunks.join(dead, "id", "left_anti"), embeddings.join(dead.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")


def document_states(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, failures: DataFrame) -> DataFrame:
    """``id, status, error_code`` derived from what the stages have written: failed, ready, embedding, parsing, pending."""
    made = chunks.join(embeddings.select(F.col("chunk_id").alias("id"), F.lit(1).alias("_e")).distinct(), "id", "left").groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count("_e").alias("e"))
    bad = failures.groupBy(F.col("document_id").alias("id")).agg(F.min("error_code").alias("error_code"))
    status = F.when(F.col("error_code").isNotNull(), "failed").when(F.col("n") == F.col("e"), "ready").when(F.col("n") > 0, "embedding").otherwise("pending")
    return documents.select("id").distinct().join(made, "id", "left").join(bad, "id", "left").select("id", status.alias("status"), "error_code")
