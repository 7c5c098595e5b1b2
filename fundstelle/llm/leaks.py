"""Evaluation passages inside a corpus, by a prefix-filtered set join of word shingles.

An item leaks into a document if both have ``run`` consecutive words in common. A run of the item (a window of ``run`` words) is the set
of its shingles of ``SHINGLE`` words; a document's window holds it only if it has all of them, so of the run's shingles ordered by rarity the
rarest one is a sufficient prefix. The steps are:

1. the items' runs and shingles are made a table;
2. the shingles are counted over the whole corpus (pre-aggregated per batch, then by Spark), and each run keeps its rarest with its place;
3. the documents' shingles are joined with these prefixes. A match must leave room for the run before and after it in the document
   (positional and length bounds), and the words around it must be the run's (exact verification in the join).

What documents send into the joins is reduced by a Bloom filter of the items' shingles, which has ``BITS`` bits whatever the number of
items; false positives are left to the joins. So the corpus is read twice, and neither driver nor workers hold the items. The prefix table is sent
to all executors if it is small, else both sides are shuffled with a salt, so that a shingle in a third of all documents is no hot task.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.arrow import ints, longs, map_batches, strings
from fundstelle.llm.bloom import filter_of, may_hold
from fundstelle.llm.text import WordHashes, shingle_hashes, words
from fundstelle.session import SMALL_ROWS, cut_lineage

RUN, SHINGLE = 10, 3
#: Bits of the filter that is sent to the workers: 8 MB.
BITS = 1 << 26
#: Parts of a key of the shuffled join.
SALT = 16


def normal_words(text: str | None) -> list[str]:
    return words(unicodedata.normalize("NFKC", text)) if text else []


def _parts(items: DataFrame, key: str, parts: list[str]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("text")) for p in parts)))
    return items.filter(F.col(key).isNotNull()).select(F.col(key).alias("item_id"), each.alias("_p")).select("item_id", "_p.part", "_p.text").filter("text IS NOT NULL").distinct()


def _runs(listed: DataFrame, run: int) -> DataFrame:
    """``run, item_id, part, words, shingles`` of each run of each item; ``run`` is its words in one string, a key that is exact."""
    known, n = WordHashes(), min(SHINGLE, run)

    def cut(batch: pa.RecordBatch) -> dict | None:
        rows = []
        for item, part, text in zip(*(batch[c].to_pylist() for c in ("item_id", "part", "text")), strict=True):
            found = normal_words(text)
            hashes = shingle_hashes(known.of(found), n).view(np.int64).tolist()
            rows += [(" ".join(found[k : k + run]), item, part, hashes[k : k + run - n + 1]) for k in range(len(found) - run + 1)]
        if not rows:
            return None
        c = list(zip(*rows, strict=True))
        return {"run": strings(c[0]), "item_id": strings(c[1]), "part": strings(c[2]), "shingles": pa.array(c[3], pa.list_(pa.int64()))}

    return map_batches(listed, cut, "run string, item_id string, part string, shingles array<long>", by="text").distinct()


def _salted(left: DataFrame, right: DataFrame, key: str, spread: Column) -> DataFrame:
    """The join of a large side with the prefixes: by a broadcast if those are few, else with each key in SALT parts."""
    if right.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return left.join(F.broadcast(right), key)
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.withColumn("_salt", F.pmod(spread, F.lit(SALT)).cast("int")).join(copies, [key, "_salt"]).drop("_salt")


def leaked_runs(documents: DataFrame, items: DataFrame, parts: list[str], run: int = RUN, item_key: str = "id") -> DataFrame:
    """``doc_id, item_id, part, n_runs, first_word, n_words``: for each document and item part with a common run, how many of the item's runs
    begin in the document, the first's place among the document's words, and how many of the document's words they cover.

    Words are longest runs of letters and digits after NFKC, lower-cased. Null and empty texts, and items shorter than ``run``
    words, have no runs. Repeated items and documents under other ids are found each; rows repeated in full give one row.
    """
    context, n = documents.sparkSession.sparkContext, min(SHINGLE, run)
    texts = documents.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")
    runs = cut_lineage(_runs(_parts(items, item_key, parts), run))
    distinct = runs.dropDuplicates(["run"]).select("run", "shingles")
    shingles = distinct.select(F.explode("shingles").alias("shingle")).distinct()
    every = context.broadcast(filter_of(shingles, "shingle", BITS))
    known = WordHashes()

    def of_texts(batch: pa.RecordBatch) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, all shingles, the number of each one's text, its place there)."""
        found = [normal_words(t) for t in batch["text"].to_pylist()]
        each = [shingle_hashes(known.of(w), n) for w in found]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        owner = np.repeat(np.arange(len(each)), sizes)
        return found, np.concatenate(each) if each else np.empty(0, np.uint64), owner, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def count(batch: pa.RecordBatch) -> dict:
        _, x, _, _ = of_texts(batch)
        value, times = np.unique(x[may_hold(every.value, x)], return_counts=True)
        return {"shingle": longs(value.view(np.int64)), "n": longs(times)}

    counts = map_batches(texts, count, "shingle long, n long", by="text").groupBy("shingle").agg(F.sum("n").alias("n"))
    placed = distinct.select("run", F.posexplode("shingles").alias("place", "shingle"))
    rarest = placed.join(counts, "shingle").groupBy("run").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("n", "shingle", "place")).alias("r"))
    # A run of which a shingle stands nowhere in the corpus can't stand there either.
    prefixes = cut_lineage(rarest.filter(F.col("held") == run - n + 1).select("run", "r.shingle", F.col("r.place").alias("offset")))
    wanted = context.broadcast(filter_of(prefixes, "shingle", BITS))

    def search(batch: pa.RecordBatch) -> dict | None:
        found, x, owner, place = of_texts(batch)
        held = np.flatnonzero(may_hold(wanted.value, x))
        if not len(held):
            return None
        docs, owner, place = batch["doc_id"].to_pylist(), owner[held].tolist(), place[held].tolist()
        low = [max(0, p - run + n) for p in place]
        return {
            "doc_id": longs([docs[k] for k in owner]), "shingle": longs(x[held].view(np.int64)), "place": ints(place), "low": ints(low),
            "words": pa.array([found[k][a : p + run] for k, p, a in zip(owner, place, low, strict=True)], pa.list_(pa.string())),
        }

    around = map_batches(texts, search, "doc_id long, shingle long, place int, low int, words array<string>", by="text")
    start = F.col("place") - F.col("offset") - F.col("low")
    fits = (start >= 0) & (start + run <= F.size("words"))
    held = F.when(fits, F.array_join(F.slice("words", F.when(fits, start + 1).otherwise(1), F.lit(run)), " ") == F.col("run"))
    matched = _salted(around, prefixes, "shingle", F.xxhash64("doc_id", "place")).filter(held).select("doc_id", "run", (F.col("place") - F.col("offset")).alias("start")).distinct()
    owned = _salted(matched, runs.select("run", "item_id", "part"), "run", F.xxhash64("doc_id", "start"))
    out = owned.groupBy("doc_id", "item_id", "part").agg(F.array_sort(F.collect_set("start")).alias("s"))
    gaps = F.zip_with(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(run)))
    covered = F.aggregate(gaps, F.lit(run), lambda a, g: a + g)
    return out.select("doc_id", "item_id", "part", F.size("s").alias("n_runs"), F.col("s")[0].alias("first_word"), covered.alias("n_words"))


def leaked_items(documents: DataFrame, items: DataFrame, parts: list[str], run: int = RUN, item_key: str = "id") -> DataFrame:
    """``doc_id, item_id``: each document with each item it leaks."""
    return leaked_runs(documents, items, parts, run, item_key).select("doc_id", "item_id").distinct()
