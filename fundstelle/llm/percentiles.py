"""Percentiles of very large numeric columns from signed logarithmic buckets.

A value x > 0 falls into bucket ceil(log_g x) with g = (1 + a) / (1 - a), a value below 0 into the bucket of -x on the
negative side, 0 into a bucket of its own. A bucket is told by its middle 2 g^k / (g + 1), which differs from every value
in it by at most the share ``a``. So each percentile returned differs from the exact order statistic of its rank by at
most the share ``a`` of it. Counts of equal buckets add up: sketches of partitions, days or runs are combined by summing.
Buckets are a few thousand per group whatever the rows (ints: at most 2 * log_g(2^31) = 2150 at a = 0.01).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 0.01


def _gamma(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def bucket(value: Column, accuracy: float = ACCURACY) -> Column:
    """Signed bucket: _BASE + k for a value x > 0, -(_BASE + k) for x < 0, with k = ceil(log_g |x|) > -_BASE; 0 for the value 0, null for null and NaN.

    So buckets order as their values do.
    """
    k = F.ceil(F.log(F.abs(value)) / F.lit(math.log(_gamma(accuracy)))).cast("int") + F.lit(_BASE)
    return F.when(value > 0, k).when(value < 0, -k).when(value == 0, F.lit(0))


#: Above every -k of a double's logarithm at accuracies of 0.0001 or more.
_BASE = 4_000_000


def sketch(df: DataFrame, keys: list[str], metrics: dict[str, Column], accuracy: float = ACCURACY) -> DataFrame:
    """``keys, metric, bucket, n``: counts of values per group, metric and bucket; nulls have bucket null.

    One pass with partial aggregation: a group that holds a third of all rows shuffles as many rows as any other.
    NaN counts as null, infinities are in the outermost buckets. Key values may be null and form a group.
    """
    clean = {m: F.when(~F.isnan(c.cast("double")), c.cast("double")) for m, c in metrics.items()}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(c, accuracy).alias("bucket")) for m, c in clean.items())))
    counted = df.select(*keys, each.alias("_m")).select(*keys, "_m.metric", "_m.bucket").groupBy(*keys, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return _told(counted, keys, accuracy)


def _told(sketched: DataFrame, keys: list[str], accuracy: float | None) -> DataFrame:
    """The sketch with its accuracy in the metadata of ``bucket``, which written tables keep."""
    told = F.col("bucket") if accuracy is None else F.col("bucket").alias("bucket", metadata={"accuracy": accuracy})
    return sketched.select(*keys, "metric", told, "n")


def accuracy_of(sketched: DataFrame) -> float | None:
    """The accuracy a sketch was made with; None if it doesn't tell."""
    return sketched.schema["bucket"].metadata.get("accuracy")


def merge(sketches: list[DataFrame], keys: list[str]) -> DataFrame:
    """One sketch of several, or of one by fewer keys (per day to overall): equal buckets add up. Sketches of different accuracies are refused."""
    known = {a for s in sketches if (a := accuracy_of(s)) is not None}
    if len(known) > 1:
        raise ValueError(f"sketches of different accuracies: {sorted(known)}")
    whole = reduce(DataFrame.unionByName, (s.select(*keys, "metric", "bucket", "n") for s in sketches)).groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    return _told(whole, keys, next(iter(known), None))


def percentiles(sketched: DataFrame, keys: list[str], shares: dict[str, float], accuracy: float = ACCURACY) -> DataFrame:
    """``keys, metric, n_values, n_null`` and a column per share: the value at rank floor(share * (n - 1)) + 1.

    A group without values has null percentiles. The window runs over buckets, not over values. ``accuracy`` must be the sketch's.
    """
    if accuracy_of(sketched) not in (None, accuracy):
        raise ValueError(f"the sketch has the accuracy {accuracy_of(sketched)}")
    group = Window.partitionBy(*keys, "metric")
    g = _gamma(accuracy)
    size = F.pow(F.lit(g), (F.abs("bucket") - _BASE).cast("double")) * (2 / (1 + g))
    value = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(F.signum(F.col("bucket").cast("double")) * size)
    ranked = sketched.withColumns({
        "total": F.sum(F.when(F.col("bucket").isNotNull(), F.col("n"))).over(group),
        "upto": F.sum(F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0)).over(group.orderBy(F.col("bucket").asc_nulls_first())),
    })
    at = {name: F.min(F.when(F.col("bucket").isNotNull() & (F.col("upto") >= F.floor(F.lit(share) * (F.col("total") - 1)) + 1), value)).alias(name) for name, share in shares.items()}
    return ranked.groupBy(*keys, "metric").agg(
        F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"),
        F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), *at.values(),
    )


METRICS = ("total_ms", "retrieval_ms", "generation_ms")
SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def log_rows(query_logs: DataFrame) -> DataFrame:
    """One row per log id: ``id, tenant_id, config_hash, day`` and the latencies; negative latencies are null.

    Replayed rows repeat id and contents. A duration below 0 was never measured (-1 is written for that), so it counts as
    null; every other value counts, however long. A null or missing map entry is null. Rows without an id are rows of their own.
    """
    own = F.coalesce("id", F.concat(F.lit("row "), F.monotonically_increasing_id()))
    picked = {m: F.col("latency_ms")[m] for m in METRICS}
    return (
        query_logs.select(own.alias("id"), "tenant_id", "config_hash", F.to_date("created_at").alias("day"), *(F.when(c >= 0, c).alias(m) for m, c in picked.items()))
        .groupBy("id", "tenant_id", "config_hash", "day").agg(*(F.max(m).alias(m) for m in METRICS))
    )


def log_sketch(query_logs: DataFrame, keys: list[str]) -> DataFrame:
    return sketch(log_rows(query_logs), keys, {m: F.col(m) for m in METRICS})
