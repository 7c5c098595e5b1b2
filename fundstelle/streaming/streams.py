"""Structured Streaming forms: landing folder to chunks, rolling statistics, budgets, token streams, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from fundstelle.plans.ingestion import store
from fundstelle.session import cut_lineage, remove_folder, shared_folder


def read_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def ingest_stream(blocks: DataFrame, tenant_id: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of blocks runs the idempotent ingestion, so a batch that is tried again adds nothing twice."""
    return blocks.writeStream.foreachBatch(lambda batch, _: store(batch, tenant_id, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _once(logs: DataFrame, late: str, key: str | None) -> DataFrame:
    """With a watermark on ``created_at``; with ``key``, replays that come within it are dropped, and keys are forgotten after it."""
    marked = logs.withWatermark("created_at", late)
    return marked if key is None else marked.filter(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key])


def rolling_stats(logs: DataFrame, window: str = "1 hour", late: str = "2 days", key: str | None = None) -> DataFrame:
    """Counts, abstentions and cost per window of ``created_at``; rows later than ``late`` are dropped once their window is closed."""
    ms = F.col("latency_ms")["total_ms"]
    return _once(logs, late, key).groupBy(F.window("created_at", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("abstained").alias("n_abstained"), F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("cost"), F.percentile_approx(ms, [0.5, 0.95], 1000).alias("percentiles"),
    ).select(F.col("w.start").alias("start"), "n", "n_abstained", "cost", F.col("percentiles")[0].alias("p50"), F.col("percentiles")[1].alias("p95"))


def daily_questions(logs: DataFrame, limit: int, late: str = "2 days", key: str | None = None) -> DataFrame:
    counted = _once(logs, late, key).groupBy(F.window("created_at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").cast("date").alias("day"), "n", (F.col("n") >= limit).alias("exhausted"))


#: Requests whose state is kept in one row: Python is called once per group instead of once per request, and a micro-batch rewrites only the groups it touches.
GROUPS = 1024


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring deltas of one request and ``ts`` whose ``seq`` goes on by one as one row: ``first`` and the ``lengths`` of the pieces of ``text``, and the last reason that isn't empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        seq, text = batch["seq"].to_numpy(zero_copy_only=False), pc.fill_null(batch["text"], "")
        starts = np.concatenate([[True], seq[1:] != seq[:-1] + 1])
        for c in [x for x in ("request_id", "ts") if x in batch.schema.names]:
            starts[1:] |= pc.fill_null(pc.not_equal(batch[c][1:], batch[c][:-1]), True).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(starts)
        ends = np.append(at, batch.num_rows).astype(np.int32)
        told = np.flatnonzero(pc.fill_null(pc.not_equal(batch["finish_reason"], ""), False).to_numpy(zero_copy_only=False))
        last = np.searchsorted(told, ends[1:]) - 1
        last = np.where((last >= 0) & (np.append(told, 0)[last] >= at), np.append(told, 0)[last], -1)
        columns = {c: batch[c].take(pa.array(at)) for c in batch.schema.names if c in ("request_id", "ts")}
        lengths = pa.ListArray.from_arrays(pa.array(ends), pc.utf8_length(text).cast(pa.int32()))
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), text), "")
        yield pa.RecordBatch.from_pydict(columns | {"first": batch["seq"].take(pa.array(at)), "lengths": lengths, "text": whole, "finish_reason": batch["finish_reason"].take(pa.array(last, mask=last < 0))})


def token_streams(deltas: DataFrame, idle_ms: int = 600_000, late: str | None = "1 minute") -> DataFrame:
    """``request_id, text, finish_reason`` of requests from ``deltas(request_id, seq, text, finish_reason, ts)``, state kept per request, for ``GROUPS`` groups of requests.

    Once the watermark of ``ts`` is ``idle_ms`` past a request's last delta, an unfinished one ends with what it has and the reason timeout, and a finished one,
    remembered until then so that late pieces begin no new state, is forgotten. ``late`` None: the stream has a watermark already. Without ``ts``
    (only for streams that end) nothing is forgotten.
    """
    timed = "ts" in deltas.columns

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept: dict[str, tuple] = {}  # pieces, reason, done, until
        for request, seqs, texts, reason, done, until in zip(*state.get, strict=True) if state.exists else ():
            kept[request] = dict(zip(seqs, texts, strict=True)), reason, done, until
        now, fresh = state.getCurrentWatermarkMs() if timed else 0, set()
        for part in () if state.hasTimedOut else parts:
            ends = part["ts"].astype("datetime64[ms]").astype("int64").to_numpy() + idle_ms if timed else np.zeros(len(part), int)
            for request, first, lengths, text, finish, end in zip(part["request_id"], part["first"].to_numpy().tolist(), part["lengths"], part["text"], part["finish_reason"], ends.tolist(), strict=True):
                pieces, reason, done, until = kept.get(request) or ({}, "", False, 0)
                at = 0
                for seq, length in enumerate(lengths.tolist(), first):
                    pieces[seq] = text[at : at + length]
                    at += length
                kept[request] = pieces, finish or reason, done, max(until, end, now + 1)
                fresh.add(request)
        out = []
        for request, (pieces, reason, done, until) in list(kept.items()):
            over = timed and until < now and request not in fresh
            if (reason or over) and not done:
                out.append((request, "".join(pieces[k] for k in sorted(pieces)), reason or "timeout"))
            if over:
                del kept[request]
            elif reason:
                kept[request] = {}, reason, True, until
        if kept:
            rows = [(request, list(pieces), list(pieces.values()), reason, done, until) for request, (pieces, reason, done, until) in kept.items()]
            state.update(tuple(map(list, zip(*rows, strict=True))))
            if timed:
                state.setTimeoutTimestamp(max(min(r[-1] for r in rows), now + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["request_id", "text", "finish_reason"])

    state_of = "requests array<string>, seqs array<array<long>>, texts array<array<string>>, reasons array<string>, done array<boolean>, until array<long>"
    marked = deltas.withWatermark("ts", late) if timed and late else deltas
    rows = marked.select(F.col("request_id").cast("string").alias("request_id"), F.col("seq").cast("long").alias("seq"), "text", "finish_reason", *["ts"] * timed)
    combined = rows.mapInArrow(_runs, "request_id string, " + "ts timestamp, " * timed + "first long, lengths array<int>, text string, finish_reason string")
    if timed:  # the watermark's mark is lost in Python
        combined = combined.withColumn("ts", F.col("ts").alias("ts", metadata=marked.schema["ts"].metadata))
    grouped = combined.withColumn("group", F.pmod(F.xxhash64("request_id"), F.lit(GROUPS))).groupBy("group")
    return grouped.applyInPandasWithState(run, "request_id string, text string, finish_reason string", state_of, "append", "EventTimeTimeout" if timed else "NoTimeout")


def rate_limits(hits: DataFrame, limit: int, window: float, late: str = "1 minute") -> DataFrame:
    """``key, seq, allowed`` of ``hits(key, seq, ts)``: the sliding window per key of which only allowed hits count.

    A key's state holds at most ``limit`` times and is evicted once the watermark has passed its window.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        allowed = []
        for us in rows["ts"].astype("datetime64[us]").astype("int64"):
            taken = [t for t in taken if t > us - window * 1e6]
            allowed.append(len(taken) < limit)
            if allowed[-1]:
                taken.append(int(us))
        state.update((taken,))
        state.setTimeoutTimestamp(max(int(max(taken, default=0) / 1000 + window * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"].to_numpy(), "allowed": allowed})

    return hits.withWatermark("ts", late).groupBy("key").applyInPandasWithState(run, "key string, seq long, allowed boolean", "taken array<long>", "append", "EventTimeTimeout")


def result(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream has given once all that lies there is read: each micro-batch is written to the shared folder, then read as a table; the stream's folder is removed."""
    folder = shared_folder(stream.sparkSession)
    write = "overwrite" if mode == "complete" else "append"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    query = query.foreachBatch(lambda batch, _: batch.write.mode(write).parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    rows = cut_lineage(stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows"))
    remove_folder(stream.sparkSession, folder)
    return rows


def parse_frames(body: str) -> list[tuple[str, str]]:
    """(event, data) of server-sent events: frames end at empty lines, comments are skipped, several data lines are joined."""
    out, event, data = [], "message", []
    for line in body.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if not line:
            if data:
                out.append((event, "\n".join(data)))
            event, data = "message", []
        elif not line.startswith(":"):
            field, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if field == "data":
                data.append(value)
            elif field == "event":
                event = value
    return out


def register_frames(spark: SparkSession) -> None:
    """The table function sse_frames(body) -> (event, data)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="event string, data string")
    class Frames:
        def eval(self, body: str):
            yield from parse_frames(body or "")

    spark.udtf.register("sse_frames", Frames)
