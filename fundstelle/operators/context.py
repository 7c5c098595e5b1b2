"""From ranked hits to a numbered context, its version conflicts, and checked citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundstelle.functions import text as T

#: Words that separate the sources from the question in a prompt.
OPEN, CLOSE = "<quellen>", "</quellen>"


def select_context(hits: DataFrame, budget: int = 4000, cost: Column | None = None) -> DataFrame:
    """Hits kept for the context: ``hits(query_id, rank, document_id, section_path, content, ...)`` with a new ``place``.

    Of one document's section only the first is kept; a null or empty section never repeats. Then the prefix of hits whose
    costs (words) fit the budget; the first is always kept, and the first that overflows ends the prefix. Skipped repeats cost nothing.
    """
    price = cost if cost is not None else T.word_count(F.col("content"))
    has = F.coalesce(F.col("section_path") != "", F.lit(False))
    section = F.when(has, F.concat_ws("\x00", "document_id", "section_path")).otherwise(F.concat(F.lit("\x01"), F.col("rank").cast("string")))
    by_section = Window.partitionBy("query_id", "_section").orderBy("rank")
    prefix = Window.partitionBy("query_id").orderBy("rank")
    kept = hits.withColumn("_section", section).withColumn("_first", F.row_number().over(by_section)).filter("_first = 1")
    summed = kept.withColumn("_sum", F.sum(price).over(prefix.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(prefix))
    return summed.filter((F.col("_sum") <= budget) | (F.col("place") == 1)).drop("_section", "_first", "_sum")


def source_header(filename: Column, first: Column, last: Column, version: Column, section: Column) -> Column:
    return F.concat_ws(" | ", filename, T.page_label(first, last), F.nullif(version, F.lit("")), F.nullif(section, F.lit("")))


def context_block(selected: DataFrame, delimited: bool = False) -> DataFrame:
    """``query_id, context, n_sources``: sources marked [S1], [S2] ... in the order of ``place``.

    ``delimited`` puts each text between source tags; in both forms, tags and markers inside texts are made harmless.
    """
    head = source_header(F.col("filename"), F.col("page_from"), F.col("page_to"), F.col("version_label"), F.col("section_path"))
    marker = F.concat(F.lit("S"), F.col("place"))
    body = T.neutral(F.col("content"))
    shown = F.concat(F.lit("["), marker, F.lit("] "), T.neutral(head), F.lit("\n"), body)
    if delimited:
        shown = F.concat(F.lit('<quelle id="'), marker, F.lit('" titel="'), F.translate(T.neutral(head), '"<>', "'‹›"), F.lit('">\n'), body, F.lit("\n</quelle>"))
    parts = F.array_sort(F.collect_list(F.struct("place", shown.alias("shown"))))
    return selected.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["shown"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("n_sources"))


def version_conflicts(selected: DataFrame) -> DataFrame:
    """``query_id, code, labels``: codes whose sources have at least two version labels, labels in order of first appearance."""
    each = selected.filter("version_label IS NOT NULL").select("query_id", "place", "version_label", F.explode(T.extract_codes(F.col("content"))).alias("code"))
    first = each.groupBy("query_id", "code", "version_label").agg(F.min("place").alias("place"))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("place", "version_label"))), lambda x: x["version_label"])
    return first.groupBy("query_id", "code").agg(labels.alias("labels")).filter(F.size("labels") >= 2)


def gate(top_score: Column, scores_relevance: Column | bool, threshold: float = 0.3) -> Column:
    """Whether to abstain: nothing retrieved, or a relevance below the threshold; equal passes."""
    relevant = scores_relevance if isinstance(scores_relevance, Column) else F.lit(scores_relevance)
    return top_score.isNull() | F.coalesce(relevant & (top_score < threshold), F.lit(False))


def fake_answer(context: Column) -> Column:
    """The offline model: cites every marker of the sources, or abstains."""
    cited = T.markers(context)
    return F.when(F.size(cited) > 0, F.concat(F.lit("Siehe "), F.array_join(F.transform(cited, lambda m: F.concat(F.lit("["), m, F.lit("]"))), " "))).otherwise(F.lit(T.SENTINEL))


def validate_citations(answers: DataFrame, known: str = "known", answer: str = "answer") -> DataFrame:
    """Adds ``cited`` (valid markers, in order), ``invented`` (their number), ``validated`` and ``abstained``.

    ``known`` is the array of existing markers. Invented markers are cut with one blank before each. An answer without a valid
    citation becomes the sentinel; the sentinel itself passes.
    """
    found = T.markers(F.col(answer))
    bad = F.filter(found, lambda m: ~F.array_contains(F.col(known), m))
    cut = F.trim(F.aggregate(bad, F.col(answer), lambda a, m: F.regexp_replace(a, F.concat(F.lit(" ?\\["), m, F.lit("\\]")), F.lit(""))))
    out = answers.withColumn("cited", F.filter(found, lambda m: F.array_contains(F.col(known), m))).withColumn("invented", F.size(bad)).withColumn("_cut", cut)
    out = out.withColumn("validated", F.when((F.col("_cut") == T.SENTINEL) | (F.size("cited") == 0), F.lit(T.SENTINEL)).otherwise(F.col("_cut")))
    return out.withColumn("abstained", F.col("validated") == T.SENTINEL).drop("_cut")


def answer_segments(answer: Column) -> Column:
    """Text and citation segments in order: array of (kind, value)."""
    pieces = F.filter(F.split(answer, r"(?=\[S\d+\])|(?<=\[S\d{1,9}\])"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(F.when(p.rlike(r"^\[S\d+\]$"), "citation").otherwise("text").alias("kind"), p.alias("value")))
