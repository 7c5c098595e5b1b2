"""What can be plugged in: embedders, rerankers, language models, page readers, storage. Defaults work offline and give equal results for equal inputs."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundstelle.functions.python import hash_embed
from fundstelle.operators import context, ranking
from fundstelle.sources.files import storage_key


class Embedder(Protocol):
    dim: int

    def passages(self, text: Column) -> Column: ...

    def questions(self, text: Column) -> Column: ...


class Reranker(Protocol):
    #: Whether scores are relevances that the gate may compare with its threshold.
    scores_relevance: bool

    def rerank(self, hits: DataFrame, k: int) -> DataFrame:
        """``hits(query_id, chunk_id, rank, question, content, ...)`` with new scores and ranks."""


class LlmClient(Protocol):
    def complete(self, prompts: DataFrame) -> DataFrame:
        """Adds ``answer, prompt_tokens, completion_tokens, finish_reason, error`` to ``prompts(query_id, context, question)``."""


class HashEmbedder:
    """Hashed word counts of length one; passages and questions alike."""

    def __init__(self, dim: int = 256):
        self.dim, self._embed = dim, hash_embed(dim)

    def passages(self, text: Column) -> Column:
        return self._embed(text)

    questions = passages


class OverlapReranker:
    scores_relevance = True

    def rerank(self, hits: DataFrame, k: int) -> DataFrame:
        return ranking.rerank(hits.withColumn("score", ranking.token_overlap(F.col("question"), F.col("content"))), k)


class NoReranker:
    scores_relevance = False

    def rerank(self, hits: DataFrame, k: int) -> DataFrame:
        return ranking.truncate(hits, k)


class CitingClient:
    """Cites every source of the context, or abstains."""

    def complete(self, prompts: DataFrame) -> DataFrame:
        words = lambda c: F.size(F.split(F.trim(c), r"\s+"))
        out = prompts.withColumn("answer", context.fake_answer(F.col("context")))
        return out.withColumns({"prompt_tokens": words(F.col("context")) + words(F.col("question")), "completion_tokens": words(F.col("answer")), "finish_reason": F.lit("stop"), "error": F.lit(None).cast("string")})


class FunctionClient:
    """Any Python function (context, question) -> answer; a failure becomes an ``error`` row instead of failing the job."""

    def __init__(self, function, retries: int = 2):
        self.function, self.retries = function, retries

    def complete(self, prompts: DataFrame) -> DataFrame:
        function, retries = self.function, self.retries

        @F.pandas_udf(T.StructType([T.StructField(n, t) for n, t in (("answer", T.StringType()), ("error", T.StringType()))]))
        def call(texts: pd.Series, questions: pd.Series) -> pd.DataFrame:
            rows = []
            for text, question in zip(texts, questions, strict=True):
                for attempt in range(retries + 1):
                    try:
                        rows.append((function(text, question), None))
                        break
                    except Exception as e:  # noqa: BLE001 - a question's failure is data
                        if attempt == retries:
                            rows.append((None, f"{type(e).__name__}: {e}"))
            return pd.DataFrame(rows, columns=["answer", "error"])

        out = prompts.withColumn("_r", call("context", "question"))
        none = F.lit(None).cast("int")
        return out.select(*prompts.columns, "_r.answer", none.alias("prompt_tokens"), none.alias("completion_tokens"), F.when(F.col("_r.error").isNull(), "stop").alias("finish_reason"), "_r.error")


class LocalStorage:
    """Files by content hash below a folder, written under another name and then renamed."""

    def __init__(self, root: str):
        self.root = root

    def save(self, content_hash: str, content: bytes) -> Path:
        path = storage_key(self.root, content_hash)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        part.write_bytes(content)
        os.replace(part, path)
        return path

    def read(self, content_hash: str) -> bytes:
        return storage_key(self.root, content_hash).read_bytes()
