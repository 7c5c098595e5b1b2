"""Exact nearest neighbours by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundstelle.operators.ranking import top_k

#: Queries that are sent to the workers at once at most: 4096 vectors of 1024 doubles are 32 MB.
BLOCK = 4096


def cosine(a: Column, b: Column) -> Column:
    """In doubles, in the arrays' order."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, scope: list[str] | None = None, ef_search: int | None = None) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the k nearest of ``vectors(chunk_id, vec, *scope)`` to each of ``queries(query_id, vec, *scope)``.

    Queries are taken in blocks of at most BLOCK; each partition multiplies its vectors with a block and keeps its own k best per
    query, which are merged by a window. With ``scope``, only vectors with equal values count. Fewer than k matches are no error;
    null vectors and zero vectors match nothing, and neither does a null in ``scope``. ``ef_search`` (1 to 1000) is the breadth of an approximate
    index; it is checked and has no effect, as the search is exact.
    """
    if ef_search is not None and not 1 <= ef_search <= 1000:
        raise ValueError("ef_search must lie between 1 and 1000")
    scope = scope or []
    wanted = queries.filter("vec IS NOT NULL").select("query_id", "vec", *scope)
    n = wanted.count()
    blocks = max(1, -(-n // BLOCK))
    out = None
    for b in range(blocks):
        rows = (wanted.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else wanted).collect()
        if not rows:
            continue
        found = _block(vectors, rows, k, scope, dict(queries.dtypes)["query_id"])
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(vectors.dtypes)['chunk_id']}, score double, rank int")
    return top_k(out, k)


def _block(vectors: DataFrame, rows: list, k: int, scope: list[str], query_type: str) -> DataFrame:
    q = np.array([r.vec for r in rows], float)
    length = np.linalg.norm(q, axis=1)
    q[length > 0] /= length[length > 0, None]
    ids, scopes = [r.query_id for r in rows], [tuple(r[c] for c in scope) for r in rows]
    by_scope: dict[tuple, list[int]] = {}
    for j, own in enumerate(scopes):
        if length[j] > 0 and None not in own:
            by_scope.setdefault(own, []).append(j)
    sent = vectors.sparkSession.sparkContext.broadcast((q, ids, {own: np.array(js) for own, js in by_scope.items()}))

    def run(batches):
        q, ids, by_scope = sent.value
        best: list[list] = [[] for _ in ids]
        for batch in batches:
            flat = batch["vec"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            norm = np.linalg.norm(flat, axis=1)
            flat[norm > 0] /= norm[norm > 0, None]
            keys, members = batch["chunk_id"].to_pylist(), {}
            for k_, own in enumerate(zip(*(batch[c].to_pylist() for c in scope), strict=True) if scope else [()] * batch.num_rows):
                if norm[k_] > 0:
                    members.setdefault(own, []).append(k_)
            for own, rows_ in members.items():  # only vectors and queries of one scope are multiplied
                if own not in by_scope:
                    continue
                at, js = np.array(rows_), by_scope[own]
                scores = flat[at] @ q[js].T
                for c, j in enumerate(js.tolist()):
                    s, chosen = scores[:, c], np.arange(len(at))
                    if len(at) > k:
                        edge = np.partition(s, len(at) - k)[len(at) - k]
                        chosen = np.flatnonzero(s >= edge)  # ties at the edge stay, the window decides
                    best[j] = sorted(best[j] + [(-s[i], keys[at[i]]) for i in chosen])[:k]
        flat_rows = [(ids[j], key, -neg) for j, found in enumerate(best) for neg, key in found]
        if flat_rows:
            c = list(zip(*flat_rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1]), pa.array(c[2], pa.float64())], names=["query_id", "chunk_id", "score"])

    source = vectors.filter("vec IS NOT NULL").select("chunk_id", "vec", *scope)
    return source.mapInArrow(run, f"query_id {query_type}, chunk_id {dict(vectors.dtypes)['chunk_id']}, score double")
