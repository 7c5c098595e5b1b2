"""Exact ids of a byte-level BPE vocabulary by dynamic programming over prefixes.

Byte-pair merging gives each prefix of a word one encoding, and that encoding's last token together with the encoding of the
rest decides it. So one last token per prefix is stored: among the tokens that end at the prefix's end (found by an
automaton of all tokens), the one whose predecessor, the stored last token of the remaining prefix, may stand before it.
Whether two tokens may be neighbours is tested by undoing their merges from the seam outwards: no pair across the seam may
have merged before the merges that made the two tokens. Following the stored tokens back gives the ids.
"""

from __future__ import annotations

import base64
import functools
import json
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fundstelle.functions.arrow import longs, slices

FOLDER = "/opt/tokenizers"
#: Fixed value: how the vocabulary's publisher cuts text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids in each worker.
KEPT = 500_000


class PrefixEncoder:
    """Ids of one byte-level BPE vocabulary, given as bytes -> rank, the rank being the id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.split = regex.compile(pattern)
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.halves, self.joined = {}, {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
                continue
            a, b = self._last_merge(token, ranks)
            self.halves[rank] = (a, b)
            self.joined[a, b] = rank
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.ranks, self.words = ranks, {}

    @staticmethod
    def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int]:
        """The two tokens whose merge made this one: merging its bytes by rank below its own ends with two parts."""
        parts, own = [token[k : k + 1] for k in range(len(token))], ranks[token]
        while len(parts) > 2:
            rank, k = min((r, k) for k in range(len(parts) - 1) if (r := ranks.get(parts[k] + parts[k + 1], own)) < own)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two tokens."""
        before = 1 << 60  # merges at this rank or later come after the seam's parts are already gone
        while True:
            if self.joined.get((left, right), before) < before:
                return False
            if left > right:  # undo the later merge first; bytes come last
                a, b = self.halves[left]
                if a == b == left:
                    a, b = self.halves[right]
                    if a == b == right:
                        return True
                    before, right = right + 1, a
                else:
                    before, left = left, b
            else:
                a, b = self.halves[right]
                if a == b == right:
                    a, b = self.halves[left]
                    if a == b == left:
                        return True
                    before, left = left, b
                else:
                    before, right = right + 1, a

    def word(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8", "replace")
        if (whole := self.ranks.get(raw)) is not None:
            return (whole,)
        last: list[int] = [-1] * (len(raw) + 1)
        for end, rank in self.automaton.iter(raw.decode("latin-1")):
            at = end + 1
            if last[at] < 0:
                start = at - self.size[rank]
                if start == 0 or last[start] >= 0 and self.neighbours(last[start], rank):
                    last[at] = rank
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= self.size[last[at]]
        return tuple(ids[::-1])

    def encode(self, text: str) -> list[int]:
        known, ids = self.words, []
        for piece in self.split.findall(text):
            found = known.get(piece)
            if found is None:
                if len(known) > KEPT:
                    known.clear()
                found = self.word(piece)
                if len(piece) < 64:
                    known[piece] = found
            ids += found
        return ids


@functools.cache
def encoder(name: str, folder: str = FOLDER) -> PrefixEncoder:
    """From ``name``.tiktoken (bytes and ranks), or else from the vocabulary of ``name``.json."""
    path = Path(folder, f"{name}.tiktoken")
    if path.exists():
        return PrefixEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, path.read_bytes().splitlines()) if a})
    vocabulary = json.loads(Path(folder, f"{name}.json").read_text())["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return PrefixEncoder({bytes(shown[c] for c in t): k for t, k in vocabulary.items() if all(c in shown for c in t) and not t.startswith("<|")})


def token_ids(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``doc_id, ids``: one row per row of the input; a null or empty text has the empty list.

    The files' folder must exist on every executor. Strings of special tokens in a text are ordinary text. Other columns aren't read.
    """

    def run(batches):
        bpe = encoder(name, folder)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            ids = [bpe.encode(t) if t else [] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": longs(batch["doc_id"].to_pylist()), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
