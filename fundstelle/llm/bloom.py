"""A Bloom filter of fixed size over a column of 64-bit hashes: what a join can't match is left out before the shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.arrow import longs, map_batches
from fundstelle.llm.text import mix64


def filter_of(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Words of 64 bits (two bits a hash); at most ``bits`` / 64 rows come to the driver, whatever the number of hashes."""

    def places(batch: pa.RecordBatch) -> dict:
        x = batch[column].to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.concatenate([x % np.uint64(bits), mix64(x) % np.uint64(bits)])
        word, value = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
        order = np.argsort(word, kind="stable")
        word, value = word[order], value[order]
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        return {"word": longs(word[starts]), "value": longs(np.bitwise_or.reduceat(value, starts).view(np.int64))}

    rows = map_batches(hashes.select(column), places, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["value"].to_numpy().view(np.uint64)
    return out


def may_hold(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    bits = np.uint64(64 * len(table))
    held = np.ones(len(x), bool)
    for at in (x % bits, mix64(x) % bits):
        held &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return held
