"""Prompts, log rows, answer events, report checks and the Markdown matrix."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundstelle.functions import text as T


def rendered(template: str, values: dict[str, Column]) -> Column:
    """The template with its {places} filled in one pass: what a value holds is never filled again."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[p], F.lit("")) if k % 2 and p in values else F.lit(f"{{{p}}}" if k % 2 else p) for k, p in enumerate(parts)))


def bullets(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit("(keine)"))


def gold_lines(sources: Column) -> Column:
    """Gold sources as lines: document, section and page as far as known."""
    return bullets(F.transform(sources, lambda g: F.concat_ws(", ", g["document"], F.concat(F.lit("Abschnitt "), g["section"]), F.concat(F.lit("Seite "), g["page"]))))


def log_rows(answers: DataFrame, config_hash: str, now: Column) -> DataFrame:
    """Rows for query_logs from answers (request_id, tenant_id, question, retrieved_ids, answer, retrieval_ms, generation_ms, prompt_tokens, completion_tokens, cost)."""
    ms = lambda c: F.round(c).cast("int")
    return answers.select(
        F.sha2(F.concat_ws("\x00", "request_id", "tenant_id"), 256).alias("id"), "request_id", "tenant_id", "question", F.lit(config_hash).alias("config_hash"), "retrieved_ids", "answer",
        F.coalesce(F.col("answer") == T.SENTINEL, F.lit(False)).alias("abstained"),
        F.create_map(F.lit("retrieval_ms"), ms(F.col("retrieval_ms")), F.lit("generation_ms"), ms(F.col("generation_ms")), F.lit("total_ms"), ms(F.col("retrieval_ms") + F.col("generation_ms"))).alias("latency_ms"),
        F.create_map(F.lit("prompt"), F.col("prompt_tokens"), F.lit("completion"), F.col("completion_tokens")).alias("tokens"), F.col("cost").cast("decimal(10,6)").alias("cost_usd"), now.alias("created_at"),
    )


def answer_events(answers: DataFrame) -> DataFrame:
    """``query_id, seq, event, data``: the stream of an answer(query_id, sources, answer, error): stages, sources, tokens, then done or error."""
    event = lambda kind, data: F.struct(F.lit(kind).alias("event"), data.alias("data"))
    tokens = F.transform(F.filter(F.split("answer", r"(?<=\s)"), lambda t: t != ""), lambda t: event("token", t))
    failed = F.array(event("stage", F.lit("retrieving")), event("error", F.col("error")))
    good = F.concat(F.array(event("stage", F.lit("retrieving")), event("sources", F.to_json("sources")), event("stage", F.lit("generating"))), tokens, F.array(event("done", F.col("answer"))))
    return answers.select("query_id", F.posexplode(F.when(F.col("error").isNotNull(), failed).otherwise(good)).alias("seq", "e")).select("query_id", "seq", "e.event", "e.data")


def coverage(report: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``key, n_report, n_wanted`` of keys that don't occur equally often on both sides; empty if the report covers just what is wanted."""
    r, w = (df.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((report, "n_report"), (wanted, "n_wanted")))
    return r.join(w, key, "full").select(key, F.coalesce("n_report", F.lit(0)).alias("n_report"), F.coalesce("n_wanted", F.lit(0)).alias("n_wanted")).filter("n_report <> n_wanted")


def config_row(configs: DataFrame, knobs: dict[str, object]) -> DataFrame:
    """The one configuration with all these knobs and without error; ValueError if there is none or there are several."""
    found = configs.filter("error IS NULL")
    for name, value in knobs.items():
        found = found.filter(F.col(name).eqNullSafe(F.lit(value)))
    if len(found.limit(2).collect()) != 1:
        raise ValueError(f"not exactly one configuration with {knobs}")
    return found


def worksheet(sample: DataFrame, scored: DataFrame) -> DataFrame:
    """The sample with the judge's scores where there are any, and an empty column for a person's."""
    s = scored.select("question_id", F.col("score").cast("string").alias("judge"), "rationale")
    return sample.join(s, "question_id", "left").withColumns({"judge": F.coalesce("judge", F.lit("")), "rationale": F.coalesce("rationale", F.lit("")), "human": F.lit("")})


def markdown(table: DataFrame, best: dict[str, bool] | None = None, digits: int = 3) -> str:
    """A small table (one row per configuration) as Markdown, the best value of each column in bold; rows are read one by one."""
    rows = [r.asDict() for r in table.toLocalIterator()]
    shown = lambda v: "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", r"\|")
    top = {c: (max if up else min)((r[c] for r in rows if r[c] is not None), default=None) for c, up in (best or {}).items()}
    lines = ["| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
    lines += ["| " + " | ".join(f"**{shown(r[c])}**" if c in top and r[c] is not None and r[c] == top[c] else shown(r[c]) for c in table.columns) + " |" for r in rows]
    return "\n".join(lines)
