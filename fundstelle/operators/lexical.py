"""Full text (all and any terms) and trigram word similarity over chunks, for a batch of queries."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from fundstelle.functions import python as P
from fundstelle.functions import text as T
from fundstelle.functions.arrow import map_batches, strings
from fundstelle.operators.ranking import top_k
from fundstelle.session import SMALL_ROWS, cut_lineage, small_side


def parse_web(text: str) -> dict[str, list]:
    """Web-style query text: quoted phrases, -word, and implicit AND of the rest (lower case, not stemmed)."""
    out: dict[str, list] = {"must": [], "must_not": [], "phrases": []}
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text.lower()):
        found = re.findall(r"[^\W_]+", phrase or word)
        if minus:
            out["must_not"] += found
        elif phrase and len(found) > 1:
            out["phrases"].append(found)
        else:
            out["must"] += found
    return out


def postings(chunks: DataFrame, text: str = "content_norm") -> DataFrame:
    """``term, chunk_id, positions`` with plain lower-case terms: the index that equi-joins replace a cross join with."""
    each = chunks.select(F.col("id").alias("chunk_id"), F.posexplode(T.terms(F.col(text))).alias("pos", "term"))
    return each.groupBy("term", "chunk_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, n_terms`` of ``queries(query_id, question)``."""
    q = queries.select("query_id", F.array_distinct(T.terms(F.col("question"))).alias("terms"))
    return q.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def match(chunks: DataFrame, queries: DataFrame, every: bool, text: str = "content_norm") -> DataFrame:
    """``query_id, chunk_id, n_matched, occurrences``: chunks with all, or with any, of a query's terms."""
    if every:
        asked = queries.select("query_id", F.array_distinct(T.terms(F.col("question"))).alias("need"), F.array().cast("array<string>").alias("never"))
        own = chunks.select(F.col("id").alias("chunk_id"), T.terms(F.col(text)).alias("terms"))
        occurrences = F.size(F.filter("held", lambda x: F.array_contains("need", x))).cast("long")
        return _holding(own, cut_lineage(asked.distinct())).select("query_id", "chunk_id", F.size("need").cast("long").alias("n_matched"), occurrences.alias("occurrences"))
    wanted = query_terms(queries)
    each = chunks.select(F.col("id").alias("chunk_id"), F.explode(T.terms(F.col(text))).alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("n"))
    found = each.join(wanted, "term").groupBy("query_id", "chunk_id", "n_terms").agg(F.count(F.lit(1)).alias("n_matched"), F.sum("n").alias("occurrences"))
    return found.select("query_id", "chunk_id", "n_matched", "occurrences")


def _runs(n: int) -> Column:
    """All runs of ``n`` consecutive words of the column ``terms``, a blank between."""
    runs = F.transform(F.sequence(F.lit(1), F.size("terms") - n + 1), lambda i: F.array_join(F.slice("terms", i, n), " "))
    return F.when(F.size("terms") >= n, runs).otherwise(F.array().cast("array<string>"))


def _sent(df: DataFrame, side: DataFrame, on: str) -> DataFrame:
    """``df`` joined with ``side``, which is already written: it is sent to the executors, in blocks of some ``SMALL_ROWS`` rows if it has more. ``df`` is read once per block and never shuffled."""
    blocks = max(1, -(-side.count() // SMALL_ROWS))
    if blocks == 1:
        return df.join(F.broadcast(side), on)
    block = F.pmod(F.xxhash64(*side.columns), F.lit(blocks))
    return reduce(DataFrame.unionByName, [df.join(F.broadcast(side.filter(block == n)), on) for n in range(blocks)])


def _holding(own: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, chunk_id, need, held``: chunks of ``own(chunk_id, terms)`` that have all of ``need`` and none of ``never``, both distinct arrays of ``asked(query_id, need, never)``, which is read several times; an empty ``need`` matches nothing.

    Terms of any query get numbers, and each chunk keeps its own as ``held``. A match has the rarest term of its query, so chunks are joined on that one only, and the
    others are tested in the join: pairs that don't match are never shuffled. Terms and queries are sent to the executors, in blocks where they are many, so neither words nor probes of chunks are shuffled.
    """
    numbers = small_side(asked.select(F.explode(F.concat("need", "never")).alias("term")).distinct().withColumn("number", F.monotonically_increasing_id()))
    each = _sent(own.select("chunk_id", F.explode("terms").alias("term")), numbers, "term")
    held = cut_lineage(each.groupBy("chunk_id").agg(F.collect_list("number").alias("held")))
    probes = held.select("chunk_id", "held", F.explode(F.array_distinct("held")).alias("rarest"))
    counts = probes.groupBy(F.col("rarest").alias("number")).agg(F.count(F.lit(1)).alias("df"))
    tagged = F.concat(F.transform("need", lambda x: F.struct(x.alias("term"), F.lit(True).alias("must"))), F.transform("never", lambda x: F.struct(x.alias("term"), F.lit(False).alias("must"))))
    terms = asked.withColumn("t", F.explode(tagged)).select("query_id", "need", "never", "t.*").join(numbers.join(counts, "number"), "term")
    ranked = F.array_sort(F.collect_list(F.when(F.col("must"), F.struct("df", "number"))))
    numbered = terms.groupBy("query_id", "need", "never").agg(ranked.alias("ranked"), F.collect_list(F.when(~F.col("must"), F.col("number"))).alias("never_held"))
    whole = numbered.filter("size(ranked) = size(need) AND size(need) > 0").select("query_id", F.col("ranked.number").alias("need"), F.col("never_held").alias("never"))
    sides = cut_lineage(whole.select("query_id", F.col("need")[0].alias("rarest"), F.coalesce(F.get("need", F.lit(1)), F.col("need")[0]).alias("second"), "need", "never"))
    others = F.array_contains("held", F.col("second")) & F.forall("need", lambda x: F.array_contains("held", x)) & ~F.arrays_overlap("held", "never")
    return _sent(probes, sides, "rarest").filter(others).select("query_id", "chunk_id", "need", "held")


def match_web(chunks: DataFrame, queries: DataFrame, text: str = "content_norm") -> DataFrame:
    """``query_id, chunk_id`` for web-style queries: all words, quoted phrases as consecutive words, no -word. A query of only -words matches nothing.

    Phrases are terms of several words, which are looked up like words: the same runs of words are taken from the chunks, for each length that a phrase has.
    """
    parsed = StructType([StructField("must", ArrayType(StringType())), StructField("must_not", ArrayType(StringType())), StructField("phrases", ArrayType(ArrayType(StringType())))])

    @F.pandas_udf(parsed)
    def parse(question: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_web(q or "") for q in question], columns=["must", "must_not", "phrases"])

    q = queries.select("query_id", parse("question").alias("p")).select("query_id", "p.*")
    need = F.array_distinct(F.concat(T.terms(F.array_join("must", " ")), F.transform("phrases", lambda p: F.array_join(p, " "))))
    asked = cut_lineage(q.select("query_id", need.alias("need"), F.array_distinct("must_not").alias("never")).distinct())
    lengths = asked.select(F.explode("need").alias("term")).select(F.size(F.split("term", " ")).alias("n")).filter("n > 1").distinct().collect()
    own = chunks.select(F.col("id").alias("chunk_id"), T.terms(F.col(text)).alias("terms")).select("chunk_id", F.concat("terms", *[_runs(r["n"]) for r in lengths]).alias("terms"))
    return _holding(own, asked).select("query_id", "chunk_id")


def search_terms(chunks: DataFrame, queries: DataFrame, k: int, every: bool = False) -> DataFrame:
    """Top k by matched terms, then occurrences (the plain configuration, without stems)."""
    return top_k(match(chunks, queries, every), k, order=[F.col("n_matched").desc(), F.col("occurrences").desc(), F.col("chunk_id")])


def german_postings(chunks: DataFrame, text: str = "content_norm", scope: list[str] | None = None) -> DataFrame:
    """``stem, chunk_id, places, *scope``: where each stem stands in a chunk, to be stored. Stop words only keep places."""
    scope = scope or []
    own = chunks.select(F.col("id").alias("chunk_id"), *scope, F.posexplode(P.german_stems(F.col(text))).alias("pos", "stem")).filter("stem <> ''")
    return own.groupBy("stem", "chunk_id", *scope).agg(F.array_sort(F.collect_list("pos")).alias("places"))


def search_postings(postings: DataFrame, queries: DataFrame, k: int, every: bool = False, scope: list[str] | None = None) -> DataFrame:
    """Top k by cover density over stored postings; a query matches only chunks with its own values of ``scope``, and none where one is null."""
    scope = scope or []
    q = queries.select("query_id", *scope, F.explode(F.array_distinct(P.german_stems("question"))).alias("stem")).filter("stem <> ''")
    sizes = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    hits = postings.join(q, ["stem", *scope]).groupBy("query_id", "chunk_id").agg(F.collect_list("places").alias("places"))
    if every:
        hits = hits.join(sizes, "query_id").filter(F.size("places") == F.col("n_terms"))

    @F.pandas_udf("double")
    def density(places: pd.Series) -> pd.Series:
        return places.map(lambda ps: P.cover_density([list(p) for p in ps]))

    return top_k(hits.select("query_id", "chunk_id", density("places").alias("score")), k)


def search_german(chunks: DataFrame, queries: DataFrame, k: int, every: bool = False, text: str = "content_norm") -> DataFrame:
    """Top k by cover density over German stems; ``chunk_id, query_id, score, rank``: postings made for this one search.

    They are joined with the queries' stems on the stem; the places of a query's terms in a chunk are bounded by the chunk.
    """
    return search_postings(german_postings(chunks, text), queries, k, every)


def trigram_postings(chunks: DataFrame, text: str = "content_norm", scope: list[str] | None = None) -> DataFrame:
    """``trigram, chunk_id, *scope``, to be stored."""
    return chunks.select(F.explode(T.trigrams(F.col(text))).alias("trigram"), F.col("id").alias("chunk_id"), *(scope or []))


def search_trigrams(chunks: DataFrame, queries: DataFrame, k: int, threshold: float = 0.5, text: str = "content_norm", postings: DataFrame | None = None, scope: list[str] | None = None) -> DataFrame:
    """Top k by word similarity of the query's first code with the text; queries without a code have no rows.

    A match shares at least ceil(threshold * n) of the code's n trigrams, so it has one of the n - ceil(threshold * n) + 1 rarest: only
    those are joined (rarity is counted over all ``postings``, which are made for this search if none are given). Chunks with candidates are
    read once each, for all codes they may match; the list of a chunk's codes is bounded by the query set.
    """
    scope = scope or []
    coded = queries.select("query_id", *scope, T.first_code(P.composed(F.col("question"))).alias("code")).filter("code IS NOT NULL")
    wanted = coded.select("code", *scope).distinct().withColumn("t", T.trigrams(F.col("code"))).select("code", *scope, F.size("t").alias("n"), F.explode("t").alias("trigram"))
    own = trigram_postings(chunks, text, scope) if postings is None else postings
    counts = own.join(wanted.select("trigram").distinct(), "trigram", "left_semi").groupBy("trigram").agg(F.count(F.lit(1)).alias("df"))
    rarity = F.row_number().over(Window.partitionBy("code", *scope).orderBy(F.coalesce("df", F.lit(0)), "trigram"))
    prefix = wanted.join(counts, "trigram", "left").withColumn("r", rarity).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    pairs = own.join(prefix.select("trigram", "code", *scope), ["trigram", *scope]).select("chunk_id", "code", *scope).distinct().groupBy("chunk_id", *scope).agg(F.collect_list("code").alias("codes"))
    candidates = pairs.select("chunk_id", "codes").join(chunks.select(F.col("id").alias("chunk_id"), F.col(text).alias("text"), *scope), "chunk_id")

    def score(batch: pa.RecordBatch) -> dict | None:
        rows = []
        for at, (codes, body) in enumerate(zip(batch["codes"].to_pylist(), batch["text"].to_pylist(), strict=True)):
            trigrams = P.OrderedTrigrams(body)
            rows += [(at, c, s) for c in codes if (s := trigrams.similarity(P.code_trigrams(c), threshold)) >= threshold]
        if not rows:
            return None
        c = list(zip(*rows, strict=True))
        at = pa.array(c[0], pa.int64())
        return {"chunk_id": batch["chunk_id"].take(at), "code": strings(c[1]), "score": pa.array(c[2], pa.float64())} | {x: batch[x].take(at) for x in scope}

    types = dict(chunks.dtypes)
    found = map_batches(candidates.select("chunk_id", "codes", "text", *scope), score, "chunk_id string, code string, score double" + "".join(f", {x} {types[x]}" for x in scope), by="text")
    return top_k(found.join(coded, ["code", *scope]).select("query_id", "chunk_id", "score"), k)
