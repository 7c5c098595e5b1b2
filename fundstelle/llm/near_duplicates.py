"""Near-duplicate texts by SetSketch: mergeable registers, banded for candidates, estimated by likelihood, then verified.

A text is the set of its runs of ``SHINGLE`` words. For each register a set keeps the least of exponential variates of its elements, stored
as floor(1 - log_b x), so sketches of parts are merged by the maximum. Each element offers its variates in rising order: the j-th
falls into the j-th of ``M`` intervals that an exponential variate reaches in turn, for the register that a random affine map modulo
the prime ``M`` gives, so that elements stop as soon as no register can still change (sets larger than M log M offer few values).

1. Equal texts are one class, told by a 64-bit hash of the text, with one representative; copies cost nothing more.
2. Representatives are sketched; each run of ``ROWS`` registers is a band, and texts that share a band are candidates. At a similarity s,
   a pair is missed with probability (1 - s^ROWS)^BANDS: 1.6 % at 0.5, 0.2 % at 0.55, 0.01 % at 0.6.
3. For each candidate the similarity is estimated from how many of the first ``ESTIMATED`` registers are larger, smaller and equal (maximum
   of the joint likelihood, set sizes being known); pairs four standard errors under the threshold are left out.
4. The rest is verified on the texts themselves.

Candidates come from a join on band values (sorted, split where skewed); nothing is collected and no cap is set. ``similar_pairs`` returns every
pair and hence tries all candidates. ``groups`` needs only connected parts: each band's texts are first tried against one of them, and then only
candidates that lie in different parts are, so that n variants of one text cost n tries and not their square.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.arrow import ints, longs, map_batches
from fundstelle.llm.text import WORD, WordHashes, mix64, shingle_hashes
from fundstelle.session import cut_lineage

SHINGLE, SIMILARITY, LEAST_WORDS = 5, 0.8, 1
#: Registers (a prime), the base of their scale, registers in a band and bands.
M, BASE, ROWS, BANDS = 257, 1.001, 4, 64
#: Registers that the estimate uses, and how many standard errors below the threshold it may lie.
ESTIMATED, ERRORS = 128, 4.0
#: The rate of the variates. Registers are some 1,000 for a set of one element and 24,000 for one of 10^9, so 16 bits hold them.
_RATE = 20.0

_GAMMA = np.log1p(np.arange(M) / (M - np.arange(M))) / _RATE  # where the intervals begin
_INVERSE = 1.0 / math.log(BASE)


def _variates(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def sketch(elements: list[np.ndarray]) -> np.ndarray:
    """Registers (int16) of several non-empty sets of distinct 64-bit hashes, one row each."""
    sizes = np.array([len(e) for e in elements])
    least = np.full((len(elements), M), np.inf)
    offers = np.minimum(M, np.ceil(1.3 * M * math.log(M) / sizes)).astype(np.int64)
    todo, first = np.arange(len(elements)), np.zeros(len(elements), np.int64)
    while len(todo):
        flat = np.concatenate([elements[k] for k in todo])
        owner, step = np.repeat(todo, sizes[todo]), np.repeat((offers - first)[todo], sizes[todo])
        start = np.repeat(first[todo], sizes[todo])
        each = np.repeat(np.arange(len(flat)), step)
        j = np.arange(len(each)) - np.repeat(np.cumsum(step) - step, step) + start[each]
        seed = mix64(flat)
        a, c = seed % np.uint64(M - 1) + np.uint64(1), (seed >> np.uint64(32)) % np.uint64(M)
        register = ((a[each] * j.astype(np.uint64) + c[each]) % np.uint64(M)).astype(np.int64)
        u = _variates(mix64(seed[each] + j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        # Within the interval from gamma_j on, of probability mass 1/M: the last one is open.
        value = _GAMMA[j] - np.log1p(-u / (M - j)) / _RATE
        np.minimum.at(least, (owner[each], register), value)
        open_ = np.isinf(least[todo]).any(axis=1)
        highest = np.where(open_, np.inf, np.max(least[todo], axis=1))
        done = (offers[todo] >= M) | (_GAMMA[np.minimum(offers[todo], M - 1)] >= highest)
        todo = todo[~done]
        first[todo] = offers[todo]
        offers[todo] = np.minimum(M, 2 * offers[todo])
    return np.clip(np.floor(1 - np.log(least) * _INVERSE), 0, 32_767).astype(np.int16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def estimate(greater: np.ndarray, less: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, m: int = ESTIMATED) -> np.ndarray:
    """Similarity of the largest joint likelihood, given in how many of m registers a's is greater and less and the set sizes."""
    u = size_a / (size_a + size_b)
    v, b = 1 - u, BASE

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (b - 1) / b) / math.log(b)

    def likelihood(s: np.ndarray) -> np.ndarray:
        up, down = p(u - v * s), p(v - u * s)
        tiny = 1e-12
        return greater * np.log(up + tiny) + less * np.log(down + tiny) + (m - greater - less) * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(25):  # golden section; the likelihood has one maximum
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        better = likelihood(left) > likelihood(right)
        low, high = np.where(better, low, left), np.where(better, right, high)
    return (low + high) / 2


def _texts(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, class) of each distinct key, and (class, content) of each distinct text."""
    named = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("class"), F.col(text).alias("content"))
    return named.select("key", "class").distinct(), named.groupBy("class").agg(F.first("content").alias("content"))


def _sketched(texts: DataFrame, shingle: int, least_words: int) -> DataFrame:
    """class, size and bands (ROWS registers in each long) of texts with enough words for a shingle."""
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> dict | None:
        keep, sets = [], []
        for k, text in enumerate(batch["content"].to_pylist()):
            found = WORD.findall(text.lower())
            if len(found) >= max(least_words, 1):
                n = min(shingle, len(found))  # shorter texts are one shingle
                sets.append(np.unique(shingle_hashes(hashes.of(found), n)))
                keep.append(k)
        if not keep:
            return None
        out = []
        for at in range(0, len(sets), 64):  # bounds the memory of the offers
            out.append(sketch(sets[at : at + 64]))
        bands = np.ascontiguousarray(np.concatenate(out)[:, : ROWS * BANDS]).view(np.int64)
        flat = pa.array(bands.ravel(), pa.int64())
        return {
            "class": batch["class"].take(pa.array(keep, pa.int64())), "size": ints([len(s) for s in sets]),
            "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * BANDS, pa.int32()), flat),
        }

    return map_batches(texts.select("class", "content"), run, "class long, size int, bands array<long>", by="content")


def _likely(candidates: DataFrame, similarity: float) -> DataFrame:
    floor = similarity - ERRORS * math.sqrt(similarity * (1 - similarity) / ESTIMATED)

    def run(batch: pa.RecordBatch) -> dict:
        def registers(name: str) -> np.ndarray:
            return batch[name].flatten().to_numpy().view(np.int16).reshape(batch.num_rows, ESTIMATED)

        a, b = registers("bands_a"), registers("bands_b")
        s = estimate((a > b).sum(axis=1), (a < b).sum(axis=1), batch["size_a"].to_numpy().astype(float), batch["size_b"].to_numpy().astype(float))
        keep = pa.array(s >= floor, pa.bool_())
        return {"a": batch["a"].filter(keep), "b": batch["b"].filter(keep)}

    return map_batches(candidates, run, "a long, b long")


def _banded(sketched: DataFrame) -> DataFrame:
    """``class, band``: a class has BANDS rows."""
    return sketched.select("class", F.posexplode("bands").alias("band", "value")).select("class", F.xxhash64("band", "value").alias("band"))


def _verified(pairs: DataFrame, sketched: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``a, b, similarity`` of those of the distinct candidate ``pairs(a, b)`` that have the similarity: by estimate, then by the texts."""
    own = F.slice("bands", 1, ESTIMATED // ROWS)
    sizes_fit = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b")  # the similarity can't exceed the ratio of sizes
    seen = pairs.join(sketched.select(F.col("class").alias("a"), F.col("size").alias("size_a"), own.alias("bands_a")), "a")
    seen = seen.join(sketched.select(F.col("class").alias("b"), F.col("size").alias("size_b"), own.alias("bands_b")), "b").filter(sizes_fit)
    likely = cut_lineage(_likely(seen.select("a", "b", "size_a", "size_b", "bands_a", "bands_b"), similarity))
    used = likely.select(F.col("a").alias("class")).union(likely.select("b")).distinct()
    needed = texts.join(used, "class", "left_semi")
    both = likely.join(needed.select(F.col("class").alias("a"), F.col("content").alias("text_a")), "a").join(needed.select(F.col("class").alias("b"), F.col("content").alias("text_b")), "b")

    def verify(batch: pa.RecordBatch) -> dict | None:
        known: dict[int, set] = {}

        def shingles(key: int, text: str) -> set:
            if key not in known:
                w = WORD.findall(text.lower())
                n = min(shingle, len(w))
                known[key] = set(zip(*(w[k:] for k in range(n)), strict=False))
            return known[key]

        rows = []
        for a, b, x, y in zip(*(batch[c].to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
            p, q = shingles(a, x), shingles(b, y)
            common = len(p & q)
            s = common / (len(p) + len(q) - common)
            if s >= similarity:
                rows.append((a, b, s))
        if not rows:
            return None
        c = list(zip(*rows, strict=True))
        return {"a": longs(c[0]), "b": longs(c[1]), "similarity": pa.array(c[2], pa.float64())}

    return map_batches(both.select("a", "b", "text_a", "text_b"), verify, "a long, b long, similarity double", by="text_a")


def similar_classes(texts: DataFrame, shingle: int, similarity: float, least_words: int) -> DataFrame:
    """``a, b, similarity`` with a < b: pairs of different text classes, each verified."""
    sketched = cut_lineage(_sketched(texts, shingle, least_words))
    banded = _banded(sketched)
    left, right = banded.select("band", F.col("class").alias("a")), banded.select("band", F.col("class").alias("b"))
    pairs = left.join(right, "band").filter("a < b").select("a", "b").distinct()
    return _verified(pairs, sketched, texts, shingle, similarity)


def _components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``class, label``: the least class of each connected part of ``edges(a, b)``, from ``labels`` that connect nothing wrongly.

    Labels are taken over from neighbours and their labels (pointer jumping) until none changes; each round is written.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")))
    while True:
        offered = both.join(labels.select(F.col("class").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("offer"))
        nearer = labels.join(offered, F.col("class") == F.col("a"), "left").select("class", "label", F.least("label", F.coalesce("offer", "label")).alias("near"))
        # A part's old label follows the least of its members, so that parts joined at one member are joined whole.
        root = nearer.groupBy("label").agg(F.min("near").alias("least"))
        moved = nearer.join(root, "label").select("class", "label", F.least("near", "least").alias("near"))
        jumped = moved.join(labels.select(F.col("class").alias("near"), F.col("label").alias("far")), "near").select("class", "label", F.least("near", "far").alias("new"))
        after = cut_lineage(jumped)
        if after.filter("new <> label").isEmpty():
            return after.select("class", "label")
        labels = after.select("class", F.col("new").alias("label"))


def connected_classes(texts: DataFrame, shingle: int, similarity: float, least_words: int) -> DataFrame:
    """``class, label`` of all classes with enough words: the connected parts of the links that ``similar_classes`` would find.

    Twice, each band's classes are tried against one of them (the least, then the greatest class). Of the other candidates, those within a
    part can connect nothing more. The rest are pairs of a band's classes in different parts: in each band all are tried that aren't
    both in its largest part, so no link between parts is lost.
    """
    sketched = cut_lineage(_sketched(texts, shingle, least_words))
    banded = cut_lineage(_banded(sketched))
    labels = sketched.select("class", F.col("class").alias("label"))
    for first in (F.min, F.max):
        chosen = banded.groupBy("band").agg(first("class").alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "r")
        tried = banded.join(chosen, "band").filter("class <> r").select(F.least("class", "r").alias("a"), F.greatest("class", "r").alias("b")).distinct()
        parted = tried.join(labels.select(F.col("class").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("class").alias("b"), F.col("label").alias("y")), "b").filter("x <> y")
        labels = _components(_verified(parted.select("a", "b"), sketched, texts, shingle, similarity), labels)
    placed = banded.join(labels, "class")
    sizes = placed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("n", "label")).alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("band", F.col("m.label").alias("largest"))
    several = placed.join(largest, "band")
    left = several.filter("label <> largest").select("band", F.col("class").alias("a"), F.col("label").alias("x"))
    right = several.select("band", F.col("class").alias("b"), F.col("label").alias("y"))
    rest = left.join(right, "band").filter("x <> y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _components(_verified(rest, sketched, texts, shingle, similarity), labels)


def _long_enough(texts: DataFrame, least_words: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        keep = pa.array([len(WORD.findall(t)) >= least_words for t in batch["content"].to_pylist()], pa.bool_())
        return {"class": batch["class"].filter(keep)}

    return map_batches(texts.select("class", "content"), run, "class long", by="content")


def similar_pairs(df: DataFrame, key: str, text: str, shingle: int = SHINGLE, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """``key_a, key_b`` (a < b): pairs of different keys whose texts have at least ``least_words`` words and the similarity; equal texts are pairs too.

    Null keys and texts and texts without words have no pairs; a repeated key counts once (a key delivered with several texts stands
    for each). Texts with fewer words than a shingle are one shingle. The result holds every pair, so it grows with the square of a
    group of copies: ``groups`` gives one row per key instead.
    """
    members, texts = _texts(df, key, text)
    found = similar_classes(texts, shingle, similarity, least_words).select("a", "b")
    mine, other = members.select(F.col("key").alias("key_a"), F.col("class").alias("a")), members.select(F.col("key").alias("key_b"), F.col("class").alias("b"))
    between = found.join(mine, "a").join(other, "b").select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).filter("key_a <> key_b")
    copied = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("class")
    same = _long_enough(texts.join(copied, "class", "left_semi"), max(least_words, 1))
    held = members.join(same, "class", "left_semi")
    equal = held.select(F.col("key").alias("key_a"), "class").join(held.select(F.col("key").alias("key_b"), "class"), "class").filter("key_a < key_b").select("key_a", "key_b")
    return between.unionByName(equal).distinct()


def groups(df: DataFrame, key: str, text: str, shingle: int = SHINGLE, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """``key, group_id, n_texts``: each key with the least key of its group and how many different texts the group has.

    Groups are connected parts of the links between different texts; copies are members of their text's class and aren't expanded. Texts
    without enough words are grouped with their copies only. Null keys and texts have no row.
    """
    members, texts = _texts(df, key, text)
    labels = connected_classes(texts, shingle, similarity, least_words)
    counted = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_texts"))
    placed = cut_lineage(members.join(labels.join(counted, "label"), "class", "left").select("key", F.coalesce("label", "class").alias("label"), F.coalesce("n_texts", F.lit(1)).alias("n_texts")))
    least = placed.groupBy("label").agg(F.min("key").alias("group_id"))
    return placed.join(least, "label").select("key", "group_id", "n_texts")
