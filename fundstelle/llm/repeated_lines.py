"""Lines that stand in many chunks of one file (notices, prompts, bylines), by content-defined fragments.

A text's letters, whatever lines they stand in, are cut where a rolling hash over the last ``WINDOW`` letters says so. Fragments
hence cross line ends, and the same words give the same fragments wherever they stand, but for those at their edges. The steps are:

1. files with fewer distinct chunks than the least count are left out, for they can have no such line;
2. fragments are counted in distinct chunks per file, pre-aggregated in each Arrow batch and by Spark, and those that are repeated
   excessively are cut;
3. the cuts are mapped to lines: a line is proposed if all its own fragments are cut. A line's own fragments are those whose bounds depend on
   its letters alone; a line too short to have one is a fragment by itself, bounded by its ends;
4. proposed lines are verified: they are counted by their whole letters, and those that pass both limits are returned.

A line that is repeated excessively has only own fragments that are, so none is lost, and lines of different texts share fragments.
Counts are taken by key with partial aggregation, so a file that holds a third of all rows is no hot task.
Letters are compared by 64-bit hashes within a file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.arrow import ints, longs, map_batches, strings
from fundstelle.llm.text import letter_table, mix64
from fundstelle.session import cut_lineage, small_side
from fundstelle.sources.tables import latest_documents

MIN_CHUNKS, MIN_SHARE = 20, 0.15
#: Letters under the rolling hash, and the mean length of a fragment as a power of two.
WINDOW, MEAN_BITS = 4, 3


def _hashes(letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run of letters that begins at ``starts``."""
    within = np.arange(len(letters)) - np.repeat(starts, np.diff(np.append(starts, len(letters))))
    return mix64(np.add.reduceat(mix64(letters | (within.astype(np.uint64) << np.uint64(32))), starts))


def fragments(texts: list[str], window: int = WINDOW, mean_bits: int = MEAN_BITS) -> dict[str, np.ndarray]:
    """Content-defined fragments of the texts, and their lines.

    ``frag_text, frag``: for each fragment, and each line without an own one, its text's index and hash. ``text, no, whole``: for each line
    with letters its text's index, its number and the hash of all its letters. ``own, ends``: the lines' own fragments, one after the
    other, and where those of each line end.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    n_lines = np.fromiter((t.count("\n") + 1 for t in lowered), np.int64, len(lowered))
    first_line = np.concatenate(([0], np.cumsum(n_lines)[:-1]))
    line = np.cumsum(points == 10)
    is_letter = letter_table()[points]
    letters, line = points[is_letter].astype(np.uint64), line[is_letter]
    if not len(letters):
        none = np.empty(0, np.int64)
        return {k: none for k in ("text", "no", "whole", "own", "ends", "frag_text", "frag")}
    n = len(letters)
    of_text = np.searchsorted(first_line, line, "right") - 1
    new_text = np.concatenate(([True], of_text[1:] != of_text[:-1]))
    text_starts = np.flatnonzero(new_text)
    place = np.arange(n) - np.repeat(text_starts, np.diff(np.append(text_starts, n)))
    gear = mix64(letters)
    rolling = gear.copy()
    for k in range(1, window):
        rolling[k:] += np.where(place[k:] >= k, gear[:-k] << np.uint64(k), np.uint64(0))
    natural = ((rolling >> np.uint64(64 - mean_bits)) == 0) & (place >= window - 1)
    cut = natural.copy()
    cut[np.append(text_starts[1:], n) - 1] = True
    last = np.flatnonzero(cut)
    first = np.concatenate(([0], last[:-1] + 1))
    frag = _hashes(letters, first)
    line_starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    whole = _hashes(letters, line_starts)
    line_of = np.searchsorted(line_starts, first, "right") - 1
    inside = (line[first] == line[last]) & natural[last] & (first - window >= line_starts[line_of])
    n_own = np.bincount(line_of[inside], minlength=len(line_starts))
    short = n_own == 0
    of_line = of_text[line_starts]
    line_number = np.concatenate((line_of[inside], np.flatnonzero(short)))
    own = np.concatenate((frag[inside], whole[short]))[np.argsort(line_number, kind="stable")]
    return {
        "text": of_line, "no": line[line_starts] - first_line[of_line], "whole": whole.view(np.int64), "own": own.view(np.int64), "ends": np.cumsum(np.maximum(n_own, 1)),
        "frag_text": np.concatenate((of_text[first], of_line[short])), "frag": np.concatenate((frag, whole[short])).view(np.int64),
    }


def _of_large_files(chunks: DataFrame, source_documents: DataFrame, least: int) -> DataFrame:
    """(id, filename, n_chunks, content) of files with at least ``least`` distinct chunks, each id once in a file."""
    named = latest_documents(source_documents).filter("filename IS NOT NULL").select(F.col("id").alias("document_id"), "filename")
    keys = chunks.filter("id IS NOT NULL AND document_id IS NOT NULL").select("id", "document_id").distinct()
    sizes = keys.join(named, "document_id").groupBy("filename").agg(F.count_distinct("id").alias("n_chunks")).filter(F.col("n_chunks") >= least)
    wanted = named.join(sizes, "filename")
    own = chunks.filter("content IS NOT NULL").select("id", "document_id", "content").join(wanted, "document_id").select("id", "filename", "n_chunks", "content")
    return own.dropDuplicates(["id", "filename"])


def repeated_lines(chunks: DataFrame, source_documents: DataFrame, min_chunks: int = MIN_CHUNKS, min_share: float = MIN_SHARE) -> DataFrame:
    """``chunk_id, line_no``: each line to remove from ``chunks.content``.

    A repeated id counts once, also if delivered under equal contents again; null ids, contents, unknown documents and null
    filenames have no file and hence no such lines. Lines without letters never count. Empty tables give no rows.
    Other columns of the tables aren't read, so their names can't clash.
    """
    base = _of_large_files(chunks, source_documents, min_chunks)

    def count(batch: pa.RecordBatch) -> dict:
        found = fragments(batch["content"].to_pylist())
        files, code = np.unique(np.array(batch["filename"].to_pylist(), object).astype(str), return_inverse=True)
        of_text = np.unique(np.stack([found["frag_text"], found["frag"]]), axis=1) if len(found["frag"]) else np.empty((2, 0), np.int64)
        pairs, n = np.unique(np.stack([code[of_text[0]], of_text[1]]), axis=1, return_counts=True)
        size = dict(zip(batch["filename"].to_pylist(), batch["n_chunks"].to_pylist(), strict=True))
        names = files[pairs[0]].tolist()
        return {"filename": strings(names), "n_chunks": longs(map(size.__getitem__, names)), "fragment": longs(pairs[1]), "n": longs(n)}

    counted = map_batches(base, count, "filename string, n_chunks long, fragment long, n long", by="content")
    enough = F.greatest(F.lit(float(min_chunks)), F.col("n_chunks") * min_share)
    cut = counted.groupBy("filename", "n_chunks", "fragment").agg(F.sum("n").alias("n")).filter(F.col("n") >= enough).select("filename", "fragment")

    def lines(batch: pa.RecordBatch) -> dict:
        found = fragments(batch["content"].to_pylist())
        at = pa.array(found["text"], pa.int64())
        _, first = np.unique(np.stack([found["text"], found["whole"]]), axis=1, return_index=True)
        new = np.zeros(len(found["no"]), np.int32)
        new[first] = 1
        own = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], found["ends"])), pa.int32()), pa.array(found["own"], pa.int64()))
        return {
            "chunk_id": batch["id"].take(at), "filename": batch["filename"].take(at), "n_chunks": batch["n_chunks"].take(at), "line_no": ints(found["no"].astype(np.int32)), "own": own, "letters": longs(found["whole"]), "new": ints(new),
        }

    listed = map_batches(base, lines, "chunk_id string, filename string, n_chunks long, line_no int, own array<long>, letters long, new int", by="content")
    line = ["chunk_id", "filename", "n_chunks", "line_no", "letters", "new"]
    cut = small_side(cut)
    # Lines whose first own fragment isn't cut, which are most, are left out before the others' fragments are looked at.
    begun = listed.withColumn("fragment", F.col("own")[0]).join(cut, ["filename", "fragment"], "left_semi").withColumn("own", F.array_distinct("own"))
    each = begun.select(*line, F.size("own").alias("n_own"), F.explode("own").alias("fragment"))
    proposed = cut_lineage(each.join(cut, ["filename", "fragment"], "left_semi").groupBy(*line, "n_own").agg(F.count(F.lit(1)).alias("n_cut")).filter("n_cut = n_own"))
    excessive = proposed.groupBy("filename", "letters", "n_chunks").agg(F.sum("new").alias("n")).filter(F.col("n") >= enough).select("filename", "letters")
    return proposed.join(excessive, ["filename", "letters"], "left_semi").select("chunk_id", "line_no")


def without_lines(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """``chunk_id, content``: each distinct chunk's own text, with the found lines taken out.

    A null content stays null; a chunk without such lines stays as it is. The list of a chunk's lines is bounded by the chunk.
    """
    own = chunks.filter("id IS NOT NULL").groupBy(F.col("id").alias("chunk_id")).agg(F.first("content").alias("content"))
    drop = found.groupBy("chunk_id").agg(F.collect_list("line_no").alias("drop"))
    rest = F.filter(F.split("content", "\n", -1), lambda _, k: ~F.array_contains("drop", k))
    return own.join(drop, "chunk_id", "left").select("chunk_id", F.when(F.col("drop").isNull(), F.col("content")).otherwise(F.array_join(rest, "\n")).alias("content"))
