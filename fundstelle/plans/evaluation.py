"""Evaluation as plans: experiments that change one knob, resumed runs of the answer pipeline, the retrieval-only grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundstelle.operators import evaluation
from fundstelle.plans import retrieval
from fundstelle.plans.index import Index
from fundstelle.session import cut_lineage
from fundstelle.sources.files import config_hash, read_checkpoint
from fundstelle.sources.sinks import append_checkpoint

_LINE = "question_id string, config_hash string, answer string, abstained boolean, truncated boolean, n_sources bigint, retrieved_ids array<string>, error string"
#: Knobs that ``retrieval.search`` and ``answer`` know.
BASE = {"strategy": "structural", "mode": "hybrid", "k": 8}


def one_knob(base: dict, changes: dict[str, list]) -> list[dict]:
    """The base configuration, then for each knob and value one that differs from it in this knob alone."""
    return [base] + [base | {knob: value} for knob, options in changes.items() for value in options if value != base.get(knob)]


def pending(questions: DataFrame, lines: DataFrame) -> DataFrame:
    """Questions without a finished line: those never answered and those whose last line is an error."""
    return questions.join(evaluation.latest_lines(lines, questions.withColumnRenamed("query_id", "question_id")).select(F.col("question_id").alias("query_id")), "query_id", "left_anti")


def resume(index: Index, chunks: DataFrame, documents: DataFrame, questions: DataFrame, config: dict, path: str) -> DataFrame:
    """Answers the questions that the checkpoint at ``path`` doesn't have yet, appends their lines and returns the last line of each question, in order.

    A second run with everything answered makes no answer. Lines of another configuration aren't looked at.
    """
    spark, key = questions.sparkSession, config_hash(BASE | config)
    knobs = BASE | config
    lines = read_checkpoint(spark, path, _LINE).filter(F.col("config_hash") == key) if _exists(spark, path) else spark.createDataFrame([], "line_no int, " + _LINE)
    open_ = cut_lineage(pending(questions, lines))
    if not open_.isEmpty():
        rows = retrieval.answer(index, chunks, documents, open_, knobs["strategy"], mode=knobs["mode"], k=knobs["k"], threshold=knobs.get("threshold"))
        one = rows.groupBy(F.col("query_id").alias("question_id")).agg(
            F.lit(key).alias("config_hash"), F.first("answer").alias("answer"), F.first("abstained").alias("abstained"), F.first("truncated").alias("truncated"), F.first("n_sources").cast("long").alias("n_sources"),
            F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved_ids"), F.lit(None).cast("string").alias("error"),
        )
        append_checkpoint(one, path)
    done = read_checkpoint(spark, path, _LINE).filter(F.col("config_hash") == key) if _exists(spark, path) else lines
    return evaluation.latest_lines(done, questions.withColumnRenamed("query_id", "question_id")).drop("line_no").orderBy("question_id")


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def retrieval_grid(index: Index, chunks: DataFrame, documents: DataFrame, questions: DataFrame, gold: DataFrame, configs: dict[str, dict], k: int = 10) -> DataFrame:
    """``config, n, recall, recall_low, recall_high, mrr, precision`` of each labelled configuration, over the questions with gold sources; no model is asked.

    ``gold(question_id, document, section, page)``. Configurations are plans of one union, so they run together.
    """
    asked = questions.join(gold.select(F.col("question_id").alias("query_id")).distinct(), "query_id", "left_semi")
    found = None
    for label, knobs in configs.items():
        hits = retrieval.search(index, chunks, documents, asked, knobs.get("strategy", "structural"), mode=knobs.get("mode", "hybrid"), k=knobs.get("k", k), weights=knobs.get("weights"), threshold=knobs.get("threshold", 0.5))
        own = hits.select(F.lit(label).alias("config"), F.col("query_id").alias("question_id"), "rank", "filename", "section_path", "page_from", "page_to")
        found = own if found is None else found.unionByName(own)
    name = F.concat_ws("\x00", "config", "question_id")
    labels = F.explode(F.array(*map(F.lit, configs)))
    runs = asked.select(labels.alias("config"), F.col("query_id").alias("question_id")).select(name.alias("run_id"), F.col("config").alias("config_hash"), F.lit("all").alias("category"), F.lit(True).alias("has_gold"), "question_id")
    matched = cut_lineage(evaluation.matched(found.withColumn("run_id", name), gold))
    outcomes = evaluation.retrieval_outcomes(runs, matched, k)
    outcomes = cut_lineage(outcomes.join(runs.select("run_id", "question_id"), "run_id").select(F.col("config_hash").alias("config"), "question_id", F.col("found").cast("double").alias("found"), "reciprocal", "precision"))
    interval = evaluation.bootstrap(outcomes.select("config", "question_id", "found"), ["config"], "found")
    rest = outcomes.groupBy("config").agg(F.avg("reciprocal").alias("mrr"), F.avg("precision").alias("precision"))
    return interval.join(rest, "config").select("config", "n", F.col("mean").alias("recall"), F.col("low").alias("recall_low"), F.col("high").alias("recall_high"), "mrr", "precision")
