"""A batch of questions as one plan: branches, fusion, reranking, context, answer, citations, each question within its tenant."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundstelle.functions import text as T
from fundstelle.functions.python import composed
from fundstelle.operators import context, lexical, ranking, vectors
from fundstelle.plans.index import Embedder, Index, hashed
from fundstelle.session import cut_lineage

HIT = ["chunk_id", "document_id", "filename", "content", "page_from", "page_to", "section_path", "heading", "version_label", "ocr"]


def hydrate(ranked: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Ranked ids with what is shown of chunks and documents. The ranked side is small (k per query), so chunks are joined to it."""
    c = chunks.select(F.col("id").alias("chunk_id"), "document_id", "content", "page_from", "page_to", "section_path", "heading", "ocr")
    d = documents.select(F.col("id").alias("document_id"), "filename", "version_label")
    return ranked.join(c, "chunk_id").join(d, "document_id", "left")


def search(
    index: Index, chunks: DataFrame, documents: DataFrame, queries: DataFrame, strategy: str, embedder: Embedder | None = None, mode: str = "hybrid", k: int = 10, candidates: int = 40,
    every: bool = False, threshold: float = 0.5, weights: list[float] | None = None, ef_search: int | None = None,
) -> DataFrame:
    """``queries(query_id, tenant_id, question)`` in one of the modes vector, fts, hybrid: hits with score and rank.

    A question finds only chunks of its own tenant and of the chunking ``strategy``, in every branch, and vectors only of the embedder's model. One
    without a tenant finds nothing. A question of only stop words or without a code simply has fewer branches.
    """
    if mode not in ("vector", "fts", "hybrid"):
        raise ValueError(mode)
    embedder = embedder or hashed()
    q = queries.filter("tenant_id IS NOT NULL").select("query_id", "tenant_id", "question")
    own = chunks.filter(F.col("strategy") == strategy)
    branches = []
    if mode != "fts":
        stored = index.vectors.filter((F.col("strategy") == strategy) & (F.col("model") == embedder.model) & (F.col("dim") == embedder.dim))
        asked = q.select("query_id", "tenant_id", embedder.question(T.normalize_codes(composed(F.col("question")))).alias("vec"))
        branches.append(vectors.nearest(stored, asked, candidates, ["tenant_id"], ef_search))
    if mode != "vector":
        branches.append(lexical.search_postings(index.postings.filter(F.col("strategy") == strategy), q, candidates, every, ["tenant_id"]))
        branches.append(lexical.search_trigrams(own, q, candidates, threshold, postings=index.trigrams.filter(F.col("strategy") == strategy).drop("strategy"), scope=["tenant_id"]))
    if mode == "vector":
        ranked = branches[0].filter(F.col("rank") <= k)
    elif mode == "fts":
        ranked = ranking.concat_ranked(branches, k).withColumn("score", 1.0 / F.col("rank"))
    else:
        ranked = ranking.rrf(branches, weights=weights, top=k)
    return hydrate(ranked, own, documents)


#: Added to the instructions where sources of a question disagree on a code's version.
CONFLICT = "Die Quellen nennen verschiedene Fassungen; nenne alle und ihre Fassung."


def answer(
    index: Index, chunks: DataFrame, documents: DataFrame, queries: DataFrame, strategy: str, embedder: Embedder | None = None, mode: str = "hybrid", k: int = 8, budget: int = 4000,
    threshold: float | None = None, model: Column | None = None, prices: tuple[float, float] | None = None,
) -> DataFrame:
    """From questions to checked answers: one row per context source of each question, or one row with nulls where it abstains.

    Columns: query_id, answer, abstained, truncated, conflict, prompt_tokens, completion_tokens, cost_usd, retrieval_ms, generation_ms, n_sources, place, marker, chunk_id, filename, score,
    cited, snippet. ``conflict`` is the instruction that goes with sources of several versions, else null. ``model`` gives an answer from the column
    ``context``; the offline default cites every source. Tokens are blank-separated words; the cost is null without ``prices`` (per million, in and out).
    Phases are timed for the batch, from plan to written table, as a lazy plan has no times per question.
    """
    began = time.monotonic()
    hits = search(index, chunks, documents, queries, strategy, embedder, mode, k=40)
    scored = hits.join(queries.select("query_id", "question"), "query_id").withColumn("score", ranking.token_overlap(F.col("question"), F.col("content")))
    chosen = context.select_context(ranking.rerank(scored, k), budget)
    if threshold is not None:
        top = chosen.filter("place = 1").filter(~context.gate(F.col("score"), True, threshold)).select("query_id")
        chosen = chosen.join(top, "query_id", "left_semi")
    chosen = cut_lineage(chosen)
    retrieved = time.monotonic()
    disputed = context.version_conflicts(chosen).select("query_id", F.lit(CONFLICT).alias("conflict")).distinct()
    blocks = context.context_block(chosen).join(disputed, "query_id", "left")
    known = F.transform(F.sequence(F.lit(1), F.col("n_sources").cast("int")), lambda n: F.concat(F.lit("S"), n))
    said = context.fake_answer(F.col("context")) if model is None else model
    asked = blocks.withColumn("prompt", F.concat_ws("\n\n", "conflict", "context")).withColumn("answer", said).withColumn("known", known)
    answers = cut_lineage(context.validate_citations(asked).withColumn("prompt_tokens", T.word_count(F.col("prompt"))).withColumn("completion_tokens", T.word_count(F.col("answer"))).drop("context", "prompt", "known"))
    generated = time.monotonic()
    spent = T.cost_usd(F.col("prompt_tokens"), F.col("completion_tokens"), F.lit(prices[0]), F.lit(prices[1])) if prices else F.lit(None).cast("double")
    reason = F.col("finish_reason") if "finish_reason" in answers.columns else F.lit("stop")
    out = queries.select("query_id").join(answers.withColumn("cost_usd", spent).withColumn("_cut", T.is_truncated(reason)), "query_id", "left")
    out = out.select(
        "query_id", F.coalesce("validated", F.lit(T.SENTINEL)).alias("answer"), F.coalesce("abstained", F.lit(True)).alias("abstained"), (F.coalesce("_cut", F.lit(False)) & ~F.coalesce("abstained", F.lit(True))).alias("truncated"),
        "conflict", "prompt_tokens", "completion_tokens", "cost_usd", F.lit(round(1000 * (retrieved - began), 1)).alias("retrieval_ms"), F.lit(round(1000 * (generated - retrieved), 1)).alias("generation_ms"), "n_sources", "cited",
    )
    sources = chosen.select("query_id", "place", F.concat(F.lit("S"), "place").alias("marker"), "chunk_id", "filename", "score", T.snippet(F.col("content")).alias("snippet"))
    return out.join(sources, "query_id", "left").withColumn("cited", F.array_contains("cited", F.col("marker")))
