"""Functions that Spark has no expression for, as Arrow UDFs: composed characters, German stems, cover density, word
similarity, hashed embeddings, bootstrap intervals."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[^\W_]+")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text):
    """NFC only where a combining mark is present. The texts all pass through Python; for large tables see ``compose_rows``."""
    return F.when(text.rlike(r"\p{M}"), nfc(text)).otherwise(text)


def compose_rows(df, column: str):
    """``df`` with NFC in ``column``: only rows with a combining mark go through Python, the others stay in the JVM."""
    marked = F.coalesce(F.col(column).rlike(r"\p{M}"), F.lit(False))
    return df.filter(~marked).unionByName(df.filter(marked).withColumn(column, nfc(column)))


# --- German stems, after the published description of the Snowball algorithm (with ae, oe, ue as umlauts) ---

_VOWELS = "aeiouyäöü"


def _regions(word: str) -> tuple[int, int]:
    def after(start: int) -> int:
        return next((k + 1 for k in range(start + 1, len(word)) if word[k] not in _VOWELS and word[k - 1] in _VOWELS), len(word))

    first = after(0)
    return max(first, 3), after(first)


@functools.lru_cache(500_000)
def stem(word: str) -> str:
    word = word.lower().replace("ß", "ss")
    for pair, letter in (("ae", "ä"), ("oe", "ö")):
        word = word.replace(pair, letter)
    word = re.sub(r"(?<!q)ue", "ü", word)
    word = re.sub(rf"(?<=[{_VOWELS}])([uy])(?=[{_VOWELS}])", lambda m: m[1].upper(), word)
    r1, r2 = _regions(word)

    def ends(suffixes: tuple[str, ...], region: int) -> str:
        return next((s for s in sorted(suffixes, key=len, reverse=True) if word.endswith(s) and len(word) - len(s) >= region), "")

    if s := ends(("em", "ern", "er"), r1):
        word = word[: -len(s)]
    elif s := ends(("e", "en", "es"), r1):
        word = word[: -len(s)]
        if word.endswith("niss"):
            word = word[:-1]
    elif word.endswith("s") and len(word) - 1 >= r1 and word[-2:-1] in "bdfghklmnrt":
        word = word[:-1]
    if s := ends(("en", "er", "est"), r1):
        word = word[: -len(s)]
    elif word.endswith("st") and len(word) - 2 >= r1 and len(word) > 5 and word[-3] in "bdfghklmnt":
        word = word[:-2]
    if s := ends(("end", "ung"), r2):
        word = word[: -len(s)]
        if word.endswith("ig") and not word.endswith("eig") and len(word) - 2 >= r2:
            word = word[:-2]
    elif s := ends(("ig", "ik", "isch"), r2):
        if not word.endswith("e" + s):
            word = word[: -len(s)]
    elif s := ends(("lich", "heit"), r2):
        word = word[: -len(s)]
        if (t := ends(("er", "en"), r1)):
            word = word[: -len(t)]
    elif s := ends(("keit",), r2):
        word = word[: -len(s)]
        if (t := ends(("lich", "ig"), r2)):
            word = word[: -len(t)]
    return word.lower().translate(str.maketrans("äöü", "aou"))


#: Frequent function words, left out of German full text.
STOP_WORDS = frozenset(
    "aber alle als also am an auch auf aus bei bin bis bist da damit dann das dass dein dem den der des dich die dies diese dieser dir du ein eine einem einen einer eines er es für hat hatte "
    "hier ich ihr im in ist ja kann kein mein mich mit muss nach nicht noch nun nur ob oder ohne sehr sein sich sie sind so soll und uns unter vom von vor war was wenn wer werden wie wir wird zu zum zur über".split()
)


def stems(text: str | None, keep_stop_words: bool = False) -> list[str]:
    """Stems in order; a stop word keeps its place as an empty string, so that positions count it."""
    return [stem(w) if keep_stop_words or w not in STOP_WORDS else "" for w in _WORD.findall((text or "").lower())]


@F.pandas_udf(T.ArrayType(T.StringType()))
def german_stems(text: pd.Series) -> pd.Series:
    return text.map(lambda t: stems(t), na_action="ignore")


def cover_density(positions: list[list[int]]) -> float:
    """Rank of a text by its shortest stretches that hold all query terms: each adds (1/terms) / (1 + blanks in it).

    ``positions``: for each query term present its places in order. Fewer terms than two have the count of places, damped.
    """
    lists = [p for p in positions if p]
    if not lists:
        return 0.0
    if len(lists) == 1:
        return len(lists[0]) / (1 + len(lists[0]))
    events = sorted((p, k) for k, ps in enumerate(lists) for p in ps)
    last: dict[int, int] = {}
    score, before = 0.0, -1
    for place, k in events:
        last[k] = place
        if len(last) == len(lists):
            start = min(last.values())
            if start > before:
                score += 1.0 / (1 + (place - start + 1 - len(lists)))
                before = start
    return score * len(lists)


def _trigrams(word: str) -> list[str]:
    padded = f"  {word} "
    return [padded[k : k + 3] for k in range(len(padded) - 2)]


class OrderedTrigrams:
    """A text's trigrams in order and where each stands, made once for many codes."""

    def __init__(self, text: str):
        self.ordered = [t for w in _WORD.findall(text.lower()) for t in _trigrams(w)]
        self.places: dict[str, list[int]] = {}
        for k, t in enumerate(self.ordered):
            self.places.setdefault(t, []).append(k)

    def similarity(self, wanted: frozenset[str], threshold: float = 0.0) -> float:
        """The best Jaccard similarity of ``wanted`` with the set of any run of the trigrams; 0 if it can't reach the threshold.

        A run with h wanted and f other trigrams has at most h / (n + f), so runs with more than n / threshold - n others are left out.
        """
        n = len(wanted)
        if sum(map(self.places.__contains__, wanted)) < n * threshold:
            return 0.0
        hits = sorted(k for t in wanted for k in self.places.get(t, ()))
        most = n if threshold <= 0 else int(n / threshold - n)
        need, best = max(1, math.ceil(n * threshold - 1e-9)), 0.0
        for i, start in enumerate(hits):
            if i + need > len(hits):
                break
            seen, common, others, end = set(), 0, 0, start
            for place in hits[i:]:
                for t in self.ordered[end : place + 1]:
                    if t not in seen:
                        seen.add(t)
                        if t in wanted:
                            common += 1
                        else:
                            others += 1
                end = place + 1
                if others > most:
                    break
                best = max(best, common / (n + others))
        return best


@functools.lru_cache(100_000)
def code_trigrams(code: str) -> frozenset[str]:
    return frozenset(t for w in _WORD.findall(code.lower()) for t in _trigrams(w))


def word_similarity(code: str, text: str) -> float:
    """The best Jaccard similarity of the code's trigrams with those of any run of the text's trigrams in order."""
    return OrderedTrigrams(text).similarity(code_trigrams(code)) if code else 0.0


def hash_embedding(text: str | None, dim: int = 1024) -> np.ndarray:
    """Counts of lower-cased blank-separated words by hash, of length one; zeros for an empty text."""
    out = np.zeros(dim)
    for w in (text or "").lower().split():
        out[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big") % dim] += 1
    return out / (np.linalg.norm(out) or 1.0)


def hash_embed(dim: int = 1024):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        return pd.Series([hash_embedding(t, dim).astype("float32") for t in text])

    return embed


def bootstrap_interval(values: list[float], resamples: int = 2000, seed: int = 20, level: float = 0.95) -> tuple[float, float, float] | None:
    """Mean and percentile interval of the mean, None of nothing: each resample draws its places one by one by ``randrange`` from one generator.

    Of the sorted means, the lower end is at the truncated, the upper at the rounded (half to even) share of the last place.
    """
    if not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    if not values:
        return None
    draw, n = random.Random(seed).randrange, len(values)
    means = sorted(sum([values[draw(n)] for _ in range(n)]) / n for _ in range(resamples))
    tail, last = (1 - level) / 2, resamples - 1
    return sum(values) / n, means[int(tail * last)], means[round((1 - tail) * last)]
