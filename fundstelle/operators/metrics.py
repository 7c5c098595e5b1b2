"""All metrics of evaluation runs by group, in one place, and the tables and pages that show them.

``runs`` has run_id, the group's keys, question_id, category, error, answer, abstained, should_abstain, has_gold, retrieved_ids,
latency_ms (a map), cost_usd; ``hits`` run_id, rank and hit (``evaluation.matched``); ``scored`` run_id, correct and judge_error.
"""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundstelle.functions import text as T
from fundstelle.operators import evaluation

PHASES = ("retrieval_ms", "generation_ms", "total_ms")


def latency(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``<phase>_p50, <phase>_p95`` of runs without error, interpolated; null where no run has the phase."""
    of = [F.percentile(F.col("latency_ms")[p].cast("double"), F.lit(q)).alias(f"{p}_p{n}") for p in PHASES for n, q in ((50, 0.5), (95, 0.95))]
    return runs.filter("error IS NULL").groupBy(*keys).agg(*of)


def cost(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``cost``: the mean of known costs."""
    return runs.groupBy(*keys).agg(F.avg(F.col("cost_usd").cast("double")).alias("cost"))


def cited_ranks(answer: Column) -> Column:
    """Distinct ranks that an answer's markers name."""
    return F.transform(T.markers(answer), lambda m: F.substring(m, 2, 9).cast("int"))


def citation_precision(runs: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """``citation_precision, n_cited``: the share of cited retrieved chunks that are gold sources; null where none is cited."""
    cited = runs.select("run_id", *keys, F.explode(cited_ranks(F.col("answer"))).alias("rank")).join(hits.select("run_id", "rank", "hit"), ["run_id", "rank"])
    return cited.groupBy(*keys).agg(F.try_divide(F.sum(F.col("hit").cast("int")), F.count(F.lit(1))).alias("citation_precision"), F.count(F.lit(1)).alias("n_cited"))


def hallucinated(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``hallucinated``: citations beyond what was retrieved, per run without error."""
    bad = F.size(F.filter(cited_ranks(F.col("answer")), lambda k: (k > F.size("retrieved_ids")) | (k < 1)))
    return runs.filter("error IS NULL AND retrieved_ids IS NOT NULL").groupBy(*keys).agg(F.avg(bad).alias("hallucinated"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``n, agreement`` of two raters over what both have rated."""
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"))


def lowest_correct(questions: DataFrame) -> DataFrame:
    """``lowest``: the lowest positive top score of a right answer to an answerable question."""
    return questions.filter("correct AND NOT should_abstain").agg(F.min(F.when(F.col("top_score") > 0, F.col("top_score"))).alias("lowest"))


def recall_sets(outcomes: DataFrame, by: str) -> DataFrame:
    """``by, hits, n, recall``: per value and over all (null)."""
    return outcomes.rollup(by).agg(F.sum("found").alias("hits"), F.count(F.lit(1)).alias("n"), F.avg("found").alias("recall"))


def promotions(fused: DataFrame, branches: list[DataFrame], k: int) -> DataFrame:
    """``query_id, chunk_id, rank``: what fusion brings into the first k that stands in no branch's first k."""
    seen = reduce(DataFrame.union, [b.filter(F.col("rank") <= k).select("query_id", "chunk_id") for b in branches])
    return fused.filter(F.col("rank") <= k).join(seen, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", "rank")


def compute(runs: DataFrame, hits: DataFrame, scored: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Every metric of each group in one row: counts, retrieval, citations, accuracy, abstention, latency and cost.

    Each metric is one aggregation by the keys; joined are only rows per group. Groups without a metric's runs have null there.
    """
    outcomes = evaluation.retrieval_outcomes(runs.withColumn("_k", F.struct(*keys)), hits, k).select("run_id", "found", "reciprocal", "precision").join(runs.select("run_id", *keys), "run_id")
    own = scored.select("run_id", "correct", "judge_error").join(runs.select("run_id", *keys), "run_id")
    parts = [
        runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_questions"), F.count("error").alias("n_errors")),
        outcomes.groupBy(*keys).agg(F.avg("found").alias("recall"), F.avg("reciprocal").alias("mrr"), F.avg("precision").alias("precision")),
        citation_precision(runs, hits, keys), hallucinated(runs, keys),
        own.groupBy(*keys).agg(F.avg(F.col("correct").cast("int")).alias("accuracy"), F.count("judge_error").alias("n_judge_errors")),
        evaluation.abstention_rates(runs, keys), latency(runs, keys), cost(runs, keys),
    ]
    return reduce(lambda a, b: a.join(b, keys, "left"), parts)


def matrix(outcomes: DataFrame, label: str, baseline: str, resamples: int = 2000) -> dict[str, DataFrame]:
    """The four tables of a comparison, of ``outcomes(label, question_id, category, correct, found)``: one row per configuration and question.

    ``overall`` has accuracy and recall with intervals and flags of the best; ``accuracy`` and ``recall`` are by category, with hits and n; ``paired``
    has each configuration's differences from the baseline and whether the interval leaves zero out.
    """
    number = outcomes.withColumn("_correct", F.col("correct").cast("double")).withColumn("_found", F.col("found").cast("double"))
    intervals = [
        evaluation.bootstrap(number.select(label, "question_id", v), [label], v, resamples).select(label, F.col("n").alias(f"n_{n}"), F.col("mean").alias(n), F.col("low").alias(f"{n}_low"), F.col("high").alias(f"{n}_high"))
        for v, n in (("_correct", "accuracy"), ("_found", "recall"))
    ]
    differences = evaluation.paired(number.select(label, "question_id", "_correct"), label, "question_id", "_correct", baseline)
    paired = evaluation.bootstrap(differences, [label], "difference", resamples).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))
    return {
        "overall": evaluation.best_flags(intervals[0].join(intervals[1], label, "left"), {"accuracy": True, "recall": True}),
        "accuracy": evaluation.rates_by(outcomes, label, "category", "correct"), "recall": evaluation.rates_by(outcomes.filter("found IS NOT NULL"), label, "category", "found"), "paired": paired,
    }


def _shown(value) -> str:
    return "–" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value)


def _rows(df: DataFrame) -> tuple[list[str], list[list[str]]]:
    """A small table (one row per configuration and category) as text."""
    columns = df.columns
    return columns, [[_shown(v) for v in r] for r in df.orderBy(*(c for c in columns[:2])).collect()]


def matrix_markdown(tables: dict[str, DataFrame]) -> str:
    out = []
    for name, df in tables.items():
        columns, rows = _rows(df)
        out += [f"## {name}", "", "| " + " | ".join(columns) + " |", "| " + " | ".join(["---"] * len(columns)) + " |", *("| " + " | ".join(r) + " |" for r in rows), ""]
    return "\n".join(out)


def matrix_html(tables: dict[str, DataFrame], label: str) -> str:
    """A page with the four tables and the heat map of recall by category."""
    out = ["<!doctype html><html><head><meta charset='utf-8'><title>matrix</title></head><body>"]
    for name, df in tables.items():
        columns, rows = _rows(df)
        cells = lambda r, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in r) + "</tr>"
        out.append(f"<h2>{html.escape(name)}</h2><table>{cells(columns, 'th')}{''.join(cells(r, 'td') for r in rows)}</table>")
    out.append(heat_map([(r[label], r.category, r.hits, r.n) for r in tables["recall"].collect()]))
    return "".join([*out, "</body></html>"])


#: The ends of the heat map's ramp, from no hit to all hits.
LIGHT, DARK = (239, 243, 255), (8, 69, 148)


def ramp(share: float) -> tuple[int, int, int]:
    """A colour between the ends, in proportion to the share."""
    share = min(1.0, max(0.0, share))
    return tuple(round(a + (b - a) * share) for a, b in zip(LIGHT, DARK, strict=True))


def luminance(colour: tuple[int, int, int]) -> float:
    """Relative luminance of an sRGB colour."""
    linear = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in (v / 255 for v in colour)]
    return 0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2]


def ink(colour: tuple[int, int, int]) -> str:
    """Black or white, whichever stands out more."""
    here = luminance(colour)
    return "#ffffff" if 1.05 / (here + 0.05) > (here + 0.05) / 0.05 else "#000000"


def heat_map(cells: list[tuple[str, str, int, int]], width: int = 120, height: int = 28) -> str:
    """SVG of (row, column, hits, total): a cell's colour follows its share; cells without a total are empty."""
    rows, columns = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    parts = [f"<text x='{(k + 2) * width}' y='{height - 9}' text-anchor='middle' font-size='11'>{html.escape(c)}</text>" for k, c in enumerate(columns)]
    for j, r in enumerate(rows):
        parts.append(f"<text x='{width * 1.4}' y='{(j + 1) * height + 18}' text-anchor='end' font-size='11'>{html.escape(r)}</text>")
    for r, c, hits, total in cells:
        if not total:
            continue
        x, y, colour = (columns.index(c) + 1.5) * width, (rows.index(r) + 1) * height, ramp(hits / total)
        parts.append(f"<rect x='{x}' y='{y}' width='{width}' height='{height}' fill='#{colour[0]:02x}{colour[1]:02x}{colour[2]:02x}'/>")
        parts.append(f"<text x='{x + width / 2}' y='{y + 18}' text-anchor='middle' font-size='11' fill='{ink(colour)}'>{hits}/{total}</text>")
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='{(len(columns) + 2) * width}' height='{(len(rows) + 1) * height + 6}'>{''.join(parts)}</svg>"
