"""Evaluation: gold matches, retrieval and answer metrics, gate replay, agreement, comparisons, scoring, resumption."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundstelle.functions import text as T
from fundstelle.functions.python import bootstrap_interval
from fundstelle.session import cut_lineage, small_side


def gold_match(document: Column, section: Column, page: Column, filename: Column, path: Column, first: Column, last: Column) -> Column:
    """Whether a retrieved chunk is a gold source: same document, section contained either way, page within one of the range."""
    by_section = F.coalesce(F.contains(path, section) | F.contains(section, path), F.lit(False))
    by_page = F.coalesce(page.between(first - 1, last + 1), F.lit(False))
    return (document == filename) & F.when(section.isNull() & page.isNull(), True).otherwise((section.isNotNull() & by_section) | (page.isNotNull() & by_page))


def matched(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """``retrieved(run_id, question_id, rank, filename, section_path, page_from, page_to)`` with ``hit``: any gold of the question matches."""
    g = gold.select("question_id", F.col("document").alias("filename"), F.struct("section", "page").alias("g")).groupBy("question_id", "filename").agg(F.collect_list("g").alias("golds"))
    hit = F.exists("golds", lambda x: gold_match(F.lit("x"), x["section"], x["page"], F.lit("x"), F.col("section_path"), F.col("page_from"), F.col("page_to")))
    return retrieved.join(g, ["question_id", "filename"], "left").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("golds")


def retrieval_outcomes(runs: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Per run with gold: ``run_id, config_hash, category, found, reciprocal, precision`` (null without retrieval)."""
    top = hits.filter(F.col("rank") <= k).groupBy("run_id").agg(F.max(F.col("hit").cast("int")).alias("found"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.avg(F.col("hit").cast("double")).alias("precision"))
    return runs.filter("has_gold").join(top, "run_id", "left").select("run_id", "config_hash", "category", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal"), "precision")


def layer1(answer: Column, points: Column) -> tuple[Column, Column]:
    """(found, missing) answer points, by containment after normalisation; repeats stay."""
    a = T.for_match(answer)
    held = lambda p: F.coalesce(F.contains(a, T.for_match(p)), F.lit(False))
    return F.filter(points, held), F.filter(points, lambda p: ~held(p))


def accurate(missing: Column, judge_score: Column, points: Column | None = None) -> Column:
    """Layer 1 passed or the judge gave 2. An empty list passes; with ``points`` given it doesn't (the strict variant)."""
    passed = F.size(missing) == 0
    if points is not None:
        passed = passed & (F.size(points) > 0)
    return passed | F.coalesce(judge_score == 2, F.lit(False))


def locate(point: Column, context: Column, neighbours: Column) -> Column:
    p = T.for_match(point)
    return F.when(F.contains(T.for_match(context), p), "context").when(F.contains(T.for_match(neighbours), p), "neighbour").otherwise("missing")


def located(points: DataFrame, retrieved: DataFrame, chunks: DataFrame, near: DataFrame) -> DataFrame:
    """``points(run_id, question_id, pos, point)`` with the ``place`` of each: context, neighbour or missing.

    A point is in the context if a chunk that the run retrieved contains it, else in a neighbour of one. ``retrieved`` has run_id,
    question_id and chunk_id, ``chunks`` id and content, ``near`` seed_id and id. Each text is searched once for the points of all
    questions, which are few; joined are only chunks that contain one. An empty point is in any context; a null one is missing.
    """
    wanted = points.select("question_id", "point", T.for_match(F.col("point")).alias("_p")).filter("_p <> ''").distinct()
    texts = chunks.filter("content IS NOT NULL").select("id", T.for_match(F.col("content")).alias("_text"))
    held = cut_lineage(texts.join(small_side(wanted), F.contains("_text", "_p")).select("id", "question_id", "point"))
    direct = held.select(F.col("id").alias("chunk_id"), "question_id", "point", F.lit(0).alias("_rank"))
    beside = near.join(held, "id").select(F.col("seed_id").alias("chunk_id"), "question_id", "point", F.lit(1).alias("_rank"))
    by_seed = direct.unionByName(beside).groupBy("chunk_id", "question_id", "point").agg(F.min("_rank").alias("_rank"))
    seen = retrieved.join(by_seed, ["chunk_id", "question_id"]).groupBy("run_id", "point").agg(F.min("_rank").alias("_rank"))
    place = F.when((T.for_match(F.col("point")) == "") | (F.col("_rank") == 0), "context").when(F.col("_rank") == 1, "neighbour").otherwise("missing")
    return points.join(seen, ["run_id", "point"], "left").select("run_id", "question_id", "pos", "point", place.alias("place"))


def fixable(places: DataFrame) -> DataFrame:
    """``run_id, context, neighbour, missing, fixable``: points by place, and whether neighbours would complete the context."""
    each = [F.count_if(F.col("place") == p).alias(p) for p in ("context", "neighbour", "missing")]
    return places.groupBy("run_id").agg(*each).withColumn("fixable", (F.col("missing") == 0) & (F.col("neighbour") > 0))


def abstention_rates(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``correct_abstention`` over unanswerable and ``false_abstention`` over answerable runs without error."""
    rate = lambda on: F.avg(F.when(on, F.col("abstained").cast("double")))
    return runs.filter("error IS NULL").groupBy(*keys).agg(rate(F.col("should_abstain")).alias("correct_abstention"), rate(~F.col("should_abstain")).alias("false_abstention"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``n, agreement, kappa`` of two raters; 1 if chance agreement is 1."""
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    n_a, n_b = both.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("n_a")), both.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("n_b"))
    counted = both.select("n", F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same"), F.lit(0.0).alias("chance"))
    chance = n_a.join(n_b, "label").select(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("same"), (F.col("n_a").cast("double") * F.col("n_b")).alias("chance"))
    total = counted.unionByName(chance).agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.sum("chance").alias("chance"))
    po, pe = F.try_divide(F.col("same"), F.col("n")), F.try_divide(F.col("chance"), F.col("n").cast("double") * F.col("n"))
    return total.select("n", po.alias("agreement"), F.when(pe == 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def gate_sweep(questions: DataFrame, thresholds: list[float]) -> DataFrame:
    """Replays the gate: ``threshold, accuracy, false_abstention, correct_abstention, calls_saved``.

    ``questions(should_abstain, top_score, abstained, correct)``. A gated question abstains; it is right if it should.
    One pass: each question is exploded to the thresholds, a fixed list.
    """
    each = questions.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    gated = F.col("top_score").isNull() | (F.col("top_score") < F.col("threshold"))
    quiet, right = gated | F.col("abstained"), F.when(gated, F.col("should_abstain")).otherwise(F.col("correct"))
    mean = lambda c: F.avg(c.cast("double"))
    return each.groupBy("threshold").agg(
        mean(right).alias("accuracy"), mean(F.when(~F.col("should_abstain"), quiet)).alias("false_abstention"), mean(F.when(F.col("should_abstain"), quiet)).alias("correct_abstention"), F.count_if(gated).alias("calls_saved"),
    )


def separability(questions: DataFrame) -> DataFrame:
    """``auc``: how often an answerable question's score exceeds an unanswerable one's, ties half.

    By running counts over distinct scores instead of all pairs. Scores are range-partitioned: each partition sums its own, and the
    partitions' totals (one row each) give what lies below, so that no task holds all scores.
    """
    by_score = questions.filter("top_score IS NOT NULL").groupBy("top_score").agg(F.count_if(~F.col("should_abstain")).alias("p"), F.count_if(F.col("should_abstain")).alias("q"))
    ranged = cut_lineage(by_score.repartitionByRange("top_score").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("q").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row per partition
    own = F.sum("q").over(Window.partitionBy("part").orderBy("top_score").rowsBetween(Window.unboundedPreceding, -1))
    wins = ranged.withColumn("below", F.coalesce(own, F.lit(0))).join(F.broadcast(before), "part").select("p", "q", (F.col("p") * (F.col("before") + F.col("below") + F.col("q") / 2)).alias("w"))
    return wins.agg(F.try_divide(F.sum("w"), F.sum("p").cast("double") * F.sum("q")).alias("auc"))


def bootstrap(values: DataFrame, keys: list[str], value: str, resamples: int = 2000, seed: int = 20) -> DataFrame:
    """``keys, n, mean, low, high`` by group, resampled with Python's generator so that intervals can be replayed.

    Values are taken in the order of the other columns. ``values`` must be one row per question: a group is collected to one task, so it is
    meant for question sets. A group without values has n 0 and nulls.
    """
    schema = ", ".join(f"{k} {dict(values.dtypes)[k]}" for k in keys) + ", n int, mean double, low double, high double"
    order = [c for c in values.columns if c not in keys and c != value] + [value]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = [float(v) for v in part.dropna(subset=[value]).sort_values(order)[value]]
        return pd.DataFrame([(*key, len(x), *(bootstrap_interval(x, resamples, seed) or (None, None, None)))])

    return values.groupBy(*keys).applyInPandas(run, schema)


def paired(values: DataFrame, config: str, question: str, value: str, baseline: str) -> DataFrame:
    """``config, question, difference``: each configuration against the baseline on questions both have values for."""
    own = values.filter(F.col(value).isNotNull())
    base = own.filter(F.col(config) == baseline).select(question, F.col(value).alias("_base"))
    return own.filter(F.col(config) != baseline).join(base, question).select(config, question, (F.col(value) - F.col("_base")).alias("difference"))


def rates_by(outcomes: DataFrame, label: str, category: str, value: str) -> DataFrame:
    return outcomes.groupBy(label, category).agg(F.avg(F.col(value).cast("double")).alias("rate"), F.sum(F.col(value).cast("int")).alias("hits"), F.count(value).alias("n"))


def best_flags(table: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """Adds ``best_<column>`` for each column (True: larger is better); all ties win, nulls don't. ``table`` has a row per configuration, which one task holds."""
    every = Window.partitionBy()
    return table.withColumns({f"best_{c}": F.coalesce(F.col(c) == (F.max(c) if up else F.min(c)).over(every), F.lit(False)) for c, up in columns.items()})


def latest_lines(lines: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Resumable state of a JSONL checkpoint: ``lines(line_no, question_id, error, ...)``, the last line per question, none if it is an error."""
    own = lines.filter("question_id IS NOT NULL")
    if wanted is not None:
        own = own.join(wanted.select("question_id"), "question_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("line_no").desc()))
    return own.withColumn("_rank", rank).filter("_rank = 1 AND error IS NULL").drop("_rank")


def stale(runs: DataFrame, scored: DataFrame) -> DataFrame:
    """Runs to score again: no score, another answer, or a judge error. ``scored(run_id, answer, judge_error)``."""
    s = scored.select("run_id", F.col("answer").alias("_answer"), "judge_error", F.lit(True).alias("_has"))
    return runs.join(s, "run_id", "left").filter(F.col("_has").isNull() | ~F.col("answer").eqNullSafe(F.col("_answer")) | F.col("judge_error").isNotNull()).select(*runs.columns)


def rescored(runs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """New scores over old ones, only for present runs: ``run_id, score``."""
    o, n = old.select("run_id", F.col("score").alias("_old")), new.select("run_id", F.col("score").alias("_new"), F.lit(True).alias("_has"))
    return runs.select("run_id").join(o, "run_id", "left").join(n, "run_id", "left").select("run_id", F.when(F.col("_has"), F.col("_new")).otherwise(F.col("_old")).alias("score")).filter("score IS NOT NULL")


def judge_parse(raw: Column) -> Column:
    """(score, rationale, error) of a judge's JSON answer; anything but one object with a score of 0, 1 or 2 is an error."""
    parsed = F.from_json(raw, "score INT, rationale STRING", {"mode": "PERMISSIVE"})
    good = F.trim(raw).rlike(r"(?s)^\{.*\}$") & parsed["score"].isin(0, 1, 2) & parsed["rationale"].isNotNull()
    ok = F.coalesce(good, F.lit(False))
    return F.struct(F.when(ok, parsed["score"]).alias("score"), F.when(ok, parsed["rationale"]).alias("rationale"), F.when(~ok, F.lit("invalid judge response")).alias("error"))


def first_per_category(rows: DataFrame, category: str, order: str, n: int = 3) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(category).orderBy(order))).filter(F.col("_n") <= n).drop("_n")
