"""Helpers for ``mapInArrow``: columns in and out of numpy and Python lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are worked on at once in a worker; a longer text is worked on alone.
SLICE = 4_000_000


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts in ``column`` have some ``most`` bytes, so that memory doesn't follow the batch's size."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    part = ends // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        if end > start:
            yield batch.slice(start, end - start)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], dict | None], schema: str, by: str | None = None) -> DataFrame:
    """``f`` gets each Arrow batch and gives the columns of the result (in the schema's order), or None. With ``by``, batches are sliced by that text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, by) if by else [whole]:
                if batch.num_rows and (out := f(batch)) is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def strings(values: Iterable) -> pa.Array:
    return pa.array(values, pa.string())


def ints(values: Iterable) -> pa.Array:
    return pa.array(values, pa.int32())


def longs(values: Iterable) -> pa.Array:
    return pa.array(values, pa.int64())
