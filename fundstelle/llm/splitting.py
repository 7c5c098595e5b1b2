"""Splitting of oversized texts into balanced pieces, cut at natural boundaries, with overlap.

With N tokens, a limit L and an overlap o, at least k = ceil((N - o) / (L - o)) pieces are needed. Cuts are aimed at j N / k
for j = 1 .. k - 1 and each is moved to the strongest boundary near its target (paragraph, line, sentence, word; the nearest
among equals). If a piece with its overlap then exceeds the limit, one more piece is tried, until all fit.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.arrow import ints, map_batches, strings

LIMIT, OVERLAP = 800, 80
#: From strong to weak.
LEVELS = ("paragraph", "line", "sentence", "word")
#: How far from its target a cut may be moved, as a share of a piece.
REACH = 0.25

_TOKEN = re.compile(r"\S+")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")


def boundaries(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Tokens as (start, end), and for each token the level (index in LEVELS) of the boundary before it; 0 for the first."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    level = np.full(len(spans), 3, np.int8)
    for k, (start, _) in enumerate(spans):
        if k == 0:
            level[k] = 0
            continue
        gap = text[spans[k - 1][1] : start]
        if "\n" in gap:
            level[k] = 0 if _BLANK_LINE.search(gap) else 1
        elif text[spans[k - 1][1] - 1] in ".!?" and text[start].isupper():
            level[k] = 2
    return spans, level


def coarsest(level: np.ndarray, limit: int) -> str:
    """The first level at which every unit has at most ``limit`` tokens."""
    for at, name in enumerate(LEVELS):
        starts = np.flatnonzero(level <= at)
        if np.diff(np.append(starts, len(level))).max(initial=0) <= limit:
            return name
    return LEVELS[-1]


def cuts(level: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Token indexes at which pieces after the first begin (before their overlap)."""
    n = len(level)
    if n <= limit:
        return []
    k = -(-(n - overlap) // (limit - overlap))
    while True:
        reach, found, last, fits = int(REACH * n / k), [], 0, True
        for j in range(1, k + 1):
            if j < k:
                target = round(j * n / k)
                low, high = max(last + 1, target - reach), min(n - 1, target + reach, last + limit - overlap * (j > 1))
                if low > high:
                    fits = False
                    break
                near = np.arange(low, high + 1)
                at = int(near[np.lexsort((np.abs(near - target), level[near]))[0]])
            else:
                at = n
            if at - last + overlap * (j > 1) > limit:
                fits = False
                break
            if j < k:
                found.append(at)
            last = at
        if fits:
            return found
        k += 1


def _oversized(chunks: DataFrame, limit: int) -> DataFrame:
    """Distinct ids whose content can exceed the limit: n tokens take at least 2 n - 1 characters."""
    large = chunks.filter(F.col("id").isNotNull() & (F.length("content") > 2 * limit))
    return large.select("id", "section_path", "heading", "content").dropDuplicates(["id"])


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``chunk_id, piece_no, section_path, heading, cut_at, start_token, n_tokens, overlap_tokens, boundary, content``, for each chunk over the limit.

    Tokens are blank-separated words of ``content``, which holds the breadcrumb; ``token_count`` isn't read. ``cut_at`` is the
    coarsest level at which every unit fits, ``boundary`` the level of the piece's own cut ("start" for the first). Pieces but the
    first begin ``overlap`` tokens before their cut. Null, empty and fitting contents give no rows; a repeated id gives its pieces once.
    Texts are taken whole, one at a time; a token longer than any limit is one token.
    """
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit is needed")

    def run(batch: pa.RecordBatch) -> dict | None:
        rows = []
        for key, path, heading, text in zip(*(batch[c].to_pylist() for c in ("id", "section_path", "heading", "content")), strict=True):
            spans, level = boundaries(text)
            if len(spans) <= limit:
                continue
            at, name = [0, *cuts(level, limit, overlap)], coarsest(level, limit)
            for no, (begin, end) in enumerate(zip(at, [*at[1:], len(spans)], strict=True)):
                first = max(0, begin - overlap) if no else 0
                rows.append((key, no, path, heading, name, first, end - first, begin - first, LEVELS[level[begin]] if no else "start", text[spans[first][0] : spans[end - 1][1]]))
        if not rows:
            return None
        c = list(zip(*rows, strict=True))
        return {
            "chunk_id": strings(c[0]), "piece_no": ints(c[1]), "section_path": strings(c[2]), "heading": strings(c[3]), "cut_at": strings(c[4]),
            "start_token": ints(c[5]), "n_tokens": ints(c[6]), "overlap_tokens": ints(c[7]), "boundary": strings(c[8]), "content": strings(c[9]),
        }

    return map_batches(
        _oversized(chunks, limit), run,
        "chunk_id string, piece_no int, section_path string, heading string, cut_at string, start_token int, n_tokens int, overlap_tokens int, boundary string, content string", by="content",
    )
