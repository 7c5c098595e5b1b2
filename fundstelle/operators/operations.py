"""Operational analytics: roll-ups, budgets, listings, neighbours, rate limits, gaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tenant_stats(logs: DataFrame, keys: list[str], start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Counts, abstentions, cost and exact total_ms percentiles of logs created in [start, end)."""
    own = logs
    if start is not None:
        own = own.filter(F.col("created_at") >= start)
    if end is not None:
        own = own.filter(F.col("created_at") < end)
    ms = F.col("latency_ms")["total_ms"].cast("double")
    return own.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("abstained").alias("n_abstained"), F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double").alias("cost"),
        F.percentile(ms, F.lit(0.5)).alias("p50"), F.percentile(ms, F.lit(0.95)).alias("p95"),
    )


def status_buckets(documents: DataFrame, keys: list[str]) -> DataFrame:
    bucket = F.when(F.col("status").isin("ready", "failed"), F.col("status")).otherwise("processing")
    return documents.groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def daily_budget(logs: DataFrame, limit: int | None) -> DataFrame:
    """``day, n, exhausted``; null or 0 means no limit."""
    return logs.groupBy(F.date_trunc("day", "created_at").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("exhausted", (F.col("n") >= limit) if limit else F.lit(False))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """``document_id, counts``: chunks per strategy as a map."""
    each = chunks.groupBy("document_id", "strategy").agg(F.count_distinct("id").alias("n"))
    return each.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "n")))).alias("counts"))


def listing(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their counts, an empty map without chunks, in order of filename and version, nulls last."""
    counts = chunk_counts(chunks).withColumnRenamed("document_id", "id")
    empty = F.create_map().cast("map<string,bigint>")
    return documents.join(counts, "id", "left").withColumn("counts", F.coalesce("counts", empty)).orderBy("filename", F.col("version_label").asc_nulls_last(), "id")


def neighbours(chunks: DataFrame, seeds: DataFrame, width: int = 1) -> DataFrame:
    """``seed_id, id, offset``: chunks up to ``width`` places from each seed in the same document and strategy, without the seed.

    Offsets are exploded to an equi join instead of a range join; ``chunks`` and ``seeds`` have id, document_id, strategy, ordinal.
    """
    offsets = F.explode(F.array(*(F.lit(o) for o in range(-width, width + 1) if o)))
    wanted = seeds.select(F.col("id").alias("seed_id"), "document_id", "strategy", F.col("ordinal").alias("_at"), offsets.alias("offset")).withColumn("ordinal", F.col("_at") + F.col("offset"))
    return wanted.join(chunks.select("id", "document_id", "strategy", "ordinal"), ["document_id", "strategy", "ordinal"]).select("seed_id", "id", "offset")


def neighbours_outside(chunks: DataFrame, seeds: DataFrame, width: int = 1) -> DataFrame:
    """Distinct neighbours that are no seeds themselves."""
    return neighbours(chunks, seeds, width).select("id").distinct().join(seeds.select("id"), "id", "left_anti")


def chunk_context(chunks: DataFrame, seeds: DataFrame, width: int = 1) -> DataFrame:
    """``id, before, after``: neighbour ids in order."""
    each = neighbours(chunks, seeds, width).groupBy(F.col("seed_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("offset", F.col("id").alias("n")))).alias("all"))
    side = lambda test: F.transform(F.filter("all", test), lambda x: x["n"])
    out = each.select("id", side(lambda x: x["offset"] < 0).alias("before"), side(lambda x: x["offset"] > 0).alias("after"))
    none = F.array().cast("array<string>")
    return seeds.select("id").distinct().join(out, "id", "left").select("id", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))


def idle_gaps(events: DataFrame, key: str, ts: str, seq: str, limit: float) -> DataFrame:
    """Rows that come more than ``limit`` seconds after the one before: ``key, seq, gap``."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    gap = seconds - F.lag(seconds).over(Window.partitionBy(key).orderBy(seq))
    return events.select(key, seq, gap.alias("gap")).filter(F.col("gap") > limit)


def first_token_timeouts(requests: DataFrame, deltas: DataFrame, limit: float) -> DataFrame:
    """``request_id, wait``: requests(request_id, started_at) whose first delta(request_id, ts) came later than ``limit`` seconds, or (null) never."""
    first = deltas.groupBy("request_id").agg(F.min("ts").alias("_first"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    out = requests.join(first, "request_id", "left").select("request_id", (seconds("_first") - seconds("started_at")).alias("wait"))
    return out.filter(F.col("wait").isNull() | (F.col("wait") > limit))


def heartbeats(events: DataFrame, key: str, ts: str, seq: str, every: float) -> DataFrame:
    """``key, seq, beat``: for each pause before a row, one beat per ``every`` seconds in it, from 1 on."""
    gap = idle_gaps(events, key, ts, seq, every)
    beats = F.sequence(F.lit(1).cast("long"), F.floor(F.col("gap") / every))
    return gap.select(key, seq, F.explode(beats).alias("beat"))


def assembled(deltas: DataFrame) -> DataFrame:
    """Token streams put together: ``request_id, text, model, finish_reason``; the last non-null of the latter wins."""
    order = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return deltas.groupBy("request_id").agg(F.array_join(F.transform(order, lambda x: x["text"]), "").alias("text"), last("model"), last("finish_reason"))


def rate_limited(hits: DataFrame, keys: list[str], limit: int, window: float, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """``keys, seq, allowed``: a sliding window per key in which rejected hits don't count.

    Whether a hit counts depends on all before it, so a key's hits are replayed in order; they arrive sorted and are streamed
    through one task per key, which keeps at most ``limit`` times.
    """
    types = dict(hits.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", {seq} {types[seq]}, allowed boolean"
    ordered = hits.select(*keys, seq, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")).repartition(*keys).sortWithinPartitions(*keys, "_us", seq)

    def run(parts):
        from collections import deque

        now, taken = None, deque()
        for part in parts:
            allowed = []
            for row in part.itertuples(index=False):
                key = tuple(row[: len(keys)])
                if key != now:
                    now, taken = key, deque()
                while taken and taken[0] <= row[-1] - window * 1e6:
                    taken.popleft()
                ok = len(taken) < limit
                if ok:
                    taken.append(row[-1])
                allowed.append(ok)
            yield pd.concat([part[[*keys, seq]], pd.Series(allowed, name="allowed", index=part.index)], axis=1)

    return ordered.mapInPandas(run, schema)
