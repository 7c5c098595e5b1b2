"""Rankings: top k per query, fusion, ordered concatenation, reranking, cached scores. Ties always end at ``chunk_id``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, k: int, keys: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The first k rows of each query with their ``rank``; Spark limits each partition before the shuffle."""
    keys = keys or ["query_id"]
    order = order or [F.col("score").desc(), F.col("chunk_id").asc()]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def rrf(rankings: list[DataFrame], k: int = 60, weights: list[float] | None = None, top: int | None = None) -> DataFrame:
    """``query_id, chunk_id, score, rank`` from (query_id, chunk_id, rank): sum of weight / (k + rank).

    A chunk repeated in one ranking counts at its first rank, later ones keep theirs. Ties: first appearance in branch order.
    Sums run in branch order, so that they don't depend on the partitioning.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if weights is not None and len(weights) != len(rankings):
        raise ValueError("as many weights as rankings are needed")
    parts = [r.select("query_id", "chunk_id", "rank", F.lit(n).alias("branch"), F.lit(float((weights or [1.0] * len(rankings))[n])).alias("weight")) for n, r in enumerate(rankings)]
    every = reduce(DataFrame.unionByName, parts).groupBy("query_id", "chunk_id", "branch", "weight").agg(F.min("rank").alias("rank"))
    hits = F.array_sort(F.collect_list(F.struct("branch", "rank", "weight")))  # at most one per branch
    fused = every.groupBy("query_id", "chunk_id").agg(hits.alias("hits")).select(
        "query_id", "chunk_id", F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["weight"] / (F.lit(float(k)) + h["rank"])).alias("score"), F.col("hits")[0]["branch"].alias("_b"), F.col("hits")[0]["rank"].alias("_r")
    )
    ranked = top_k(fused, top or 2**31 - 1, order=[F.col("score").desc(), F.col("_b"), F.col("_r"), F.col("chunk_id")])
    return ranked.drop("_b", "_r")


def concat_ranked(rankings: list[DataFrame], k: int) -> DataFrame:
    """The rankings one after the other, each chunk once, cut to k."""
    parts = [r.select("query_id", "chunk_id", "rank", F.lit(n).alias("branch")) for n, r in enumerate(rankings)]
    first = top_k(reduce(DataFrame.unionByName, parts), 1, ["query_id", "chunk_id"], [F.col("branch"), F.col("rank")]).drop("rank")
    order = reduce(DataFrame.unionByName, parts).groupBy("query_id", "chunk_id").agg(F.min(F.struct("branch", "rank")).alias("at"))
    return top_k(order.join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi"), k, order=[F.col("at")]).select("query_id", "chunk_id", "rank")


def rerank(hits: DataFrame, k: int) -> DataFrame:
    """By new score, ties by the incoming ``rank``."""
    return top_k(hits.withColumnRenamed("rank", "incoming"), k, order=[F.col("score").desc(), F.col("incoming").asc()]).drop("incoming")


def truncate(hits: DataFrame, k: int) -> DataFrame:
    """The no-op reranker."""
    return hits.filter(F.col("rank") <= k)


def cache_key(namespace: str, query: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(namespace), query, content), 256)


def cached_scores(pairs: DataFrame, cache: DataFrame, scorer) -> tuple[DataFrame, DataFrame]:
    """(pairs with scores, new cache rows). ``pairs`` has ``key``; ``scorer`` scores a DataFrame of distinct missing keys."""
    missing = pairs.join(cache, "key", "left_anti").dropDuplicates(["key"])
    new = scorer(missing).select("key", "score")
    return pairs.join(cache.select("key", "score").unionByName(new), "key"), new


def cached_on_disk(pairs: DataFrame, path: str, scorer) -> DataFrame:
    """``pairs`` with scores, from the table at ``path`` where it has them; new scores are appended to it, so that no key is ever scored twice."""
    from fundstelle.session import cut_lineage
    from fundstelle.sources.sinks import existing, insert_new

    cache = cut_lineage(existing(pairs.sparkSession, path, "key string, score double"))
    scored, new = cached_scores(pairs, cache, scorer)
    new = cut_lineage(new.select("key", F.col("score").cast("double").alias("score")))
    insert_new(new, path, ["key"])
    return pairs.join(cache.unionByName(new), "key")


def token_overlap(query: Column, content: Column) -> Column:
    """The default scorer: the share of the query's words that the content has."""
    from fundstelle.functions.text import terms

    q = F.array_distinct(terms(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, terms(content))).cast("double"), F.size(q)), F.lit(0.0))
