"""Blocks, sections and chunks: titles, running headers, carry-forward, structural and fixed-window chunking."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from fundstelle.functions import text as T

FLOOR, CEILING, WINDOW, OVERLAP = 100, 800, 500, 0.15


def step_of(window: int, overlap: float) -> int:
    return max(1, round(window * (1 - overlap)))


def fixed_windows(texts: DataFrame, key: str, text: str, window: int = WINDOW, overlap: float = OVERLAP) -> DataFrame:
    """``key, ordinal, start_word, n_words, content``: windows of words; the last one ends at the text's end. Empty and null texts have none."""
    step = step_of(window, overlap)
    w = T.words(F.col(text))
    out = texts.select(key, w.alias("_w")).filter(F.size("_w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("_w") - window) / step)).cast("int")
    out = out.select(key, "_w", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    piece = F.slice("_w", F.col("ordinal") * step + 1, F.lit(window))
    return out.select(key, "ordinal", (F.col("ordinal") * step).alias("start_word"), F.size(piece).alias("n_words"), F.array_join(piece, " ").alias("content"))


def lines_as_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``document_id, block_no, text``: the non-blank lines of each text."""
    each = texts.select(F.col(key).alias("document_id"), F.posexplode(F.split(text, "\n", -1)).alias("block_no", "text"))
    return each.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def median_titles(blocks: DataFrame) -> DataFrame:
    """Adds ``is_title``: text blocks larger than the document's median font size (of text blocks with a size), numbered, or a paragraph heading."""
    text = F.col("kind") == "text"
    median = blocks.filter(text & (F.col("font_size") > 0)).groupBy("document_id").agg(F.median("font_size").alias("median"))
    big = F.coalesce(F.col("font_size") > F.col("median"), F.lit(False))
    return blocks.join(median, "document_id", "left").withColumn("is_title", text & (big | T.section_code(F.col("text")).isNotNull())).drop("median")


def fill_sections(blocks: DataFrame) -> DataFrame:
    """Adds ``section_path``: the code of the last title that has one."""
    code = F.when(F.col("is_title"), T.section_code(F.col("text")))
    upto = Window.partitionBy("document_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section_path", F.last(code, ignorenulls=True).over(upto))


def without_running_headers(blocks: DataFrame, pages: DataFrame | None = None, least_pages: int = 2, share: float = 0.6, grid: float = 5.0) -> DataFrame:
    """Leaves out blocks whose rounded place has blocks on more than ``share`` of the document's pages and at least ``least_pages``, whatever they say.

    ``pages(document_id, page_count)`` tells how many pages a document has; without it, or where it is null, the last page with a block counts.
    """
    placed = blocks.withColumn("_x", F.bround(F.col("bbox")[0] / grid)).withColumn("_y", F.bround(F.col("bbox")[1] / grid))
    last = blocks.groupBy("document_id").agg(F.max("page").alias("_pages"))
    if pages is not None:
        known = pages.groupBy("document_id").agg(F.max("page_count").alias("_known"))
        last = last.join(known, "document_id", "left").select("document_id", F.coalesce("_known", "_pages").alias("_pages"))
    anchors = placed.groupBy("document_id", "_x", "_y").agg(F.count_distinct("page").alias("_n")).join(last, "document_id")
    running = anchors.filter((F.col("_pages") >= least_pages) & (F.col("_n") >= least_pages) & (F.col("_n") / F.col("_pages") > share)).select("document_id", "_x", "_y")
    return placed.join(running, ["document_id", "_x", "_y"], "left_anti").drop("_x", "_y")


def outside_tables(blocks: DataFrame, tables: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Leaves out text blocks that lie inside a table's box on their page."""
    t = tables.select(F.col("document_id"), F.col("page"), F.col("bbox").alias("_box"))
    inside = (F.col("bbox")[0] >= F.col("_box")[0] - tolerance) & (F.col("bbox")[1] >= F.col("_box")[1] - tolerance) & (F.col("bbox")[2] <= F.col("_box")[2] + tolerance) & (F.col("bbox")[3] <= F.col("_box")[3] + tolerance)
    within = blocks.join(t, ["document_id", "page"]).filter(inside).select("document_id", "block_no").distinct()
    return blocks.join(within, ["document_id", "block_no"], "left_anti")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds ``place``: by page, top edge, original number."""
    order = Window.partitionBy("document_id").orderBy("page", F.col("bbox")[1], "block_no")
    return blocks.withColumn("place", F.row_number().over(order))


def span_blocks(spans: DataFrame) -> DataFrame:
    """Blocks from text spans (document_id, page, block_no, span_no, text, font_size, flags): joined in order, empty ones dropped, bold by flag bit 4.

    With ``bbox``, a block's box is the least that holds its spans'.
    """
    box = F.col("bbox") if "bbox" in spans.columns else F.lit(None).cast("array<double>")
    ordered = F.array_sort(F.collect_list(F.struct("span_no", "text", "font_size", "flags", box.alias("bbox"))))
    edge = lambda k, of: of(F.transform(F.filter("s", lambda x: x["bbox"].isNotNull()), lambda x: x["bbox"][k]))
    around = F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max))
    out = spans.groupBy("document_id", "page", "block_no").agg(ordered.alias("s"))
    out = out.select(
        "document_id", "page", "block_no", F.trim(F.array_join(F.transform("s", lambda x: x["text"]), "")).alias("text"), F.array_max(F.transform("s", lambda x: x["font_size"])).alias("font_size"),
        F.exists("s", lambda x: x["flags"].bitwiseAND(16) > 0).alias("bold"), around.alias("bbox"),
    ).filter("text <> ''")
    return out if "bbox" in spans.columns else out.drop("bbox")


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``run``: a new number whenever ``value`` changes in ``order`` (null equals null), from 0."""
    w = Window.partitionBy(key).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)).cast("int")
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w).cast("int")).drop("_new")


def structural_groups(blocks: DataFrame) -> DataFrame:
    """``document_id, run, path, n_words, n_blocks, first_block``: runs of blocks of one section."""
    counted = runs(blocks, "document_id", "block_no", "section_path").withColumn("_n", T.word_count(F.col("text")))
    return counted.groupBy("document_id", "run").agg(
        F.first("section_path").alias("path"), F.sum("_n").cast("int").alias("n_words"), F.count(F.lit(1)).cast("int").alias("n_blocks"), F.min("block_no").alias("first_block"),
    )


def merged_groups(groups: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Adds ``group_no``: small sections are folded into the next, of ``groups(document_id, run, n_words, ...)`` in order of the runs.

    A group is held back until it has ``floor`` words; what is left at a document's end stands alone. Rows stream through in order, and only
    one count is kept, so a document of any number of sections takes a time in proportion to it.
    """
    ordered = groups.repartition("document_id").sortWithinPartitions("document_id", "run")

    def number(batches):
        document, group, held = None, 0, 0
        for batch in batches:
            numbers = []
            for doc, n in zip(batch["document_id"].to_pylist(), batch["n_words"].to_pylist(), strict=True):
                if doc != document:
                    document, group, held = doc, 0, 0
                numbers.append(group)
                held += n
                if held >= floor:
                    group, held = group + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], names=[*batch.schema.names, "group_no"])

    return ordered.mapInArrow(number, T_.StructType([*ordered.schema.fields, T_.StructField("group_no", T_.IntegerType())]))


def merged_sections(groups: DataFrame, floor: int = FLOOR) -> DataFrame:
    """``document_id, group_no, path, n_words, n_blocks`` after folding; the last section's path wins."""
    return merged_groups(groups, floor).groupBy("document_id", "group_no").agg(
        F.max(F.struct("run", "path"))["path"].alias("path"), F.sum("n_words").cast("int").alias("n_words"), F.sum("n_blocks").cast("int").alias("n_blocks"),
    )


def word_windows(blocks: DataFrame, keys: list[str], window: int, step: int) -> DataFrame:
    """``keys, piece, words, page_from, page_to, section_path, regions`` over the words of each key's blocks in order of ``block_no``.

    Windows of ``window`` words begin every ``step`` words; the last one ends at the end. A block gives each window it touches its own part, so no
    row ever holds more than a window. Pages, boxes and the section are those of a window's own words: its first word's section, its blocks' distinct
    page and box in order. Blocks without words, and keys without any, give nothing.
    """
    box = F.col("bbox") if "bbox" in blocks.columns else F.lit(None).cast("array<double>")
    worded = blocks.select(*keys, F.col("block_no").cast("int").alias("block_no"), "page", "section_path", box.alias("bbox"), T.words(F.col("text")).alias("_w")).withColumn("_n", F.size("_w")).filter("_n > 0")
    upto = Window.partitionBy(*keys).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = worded.withColumn("_o", F.coalesce(F.sum("_n").over(upto), F.lit(0))).join(worded.groupBy(*keys).agg(F.sum("_n").alias("_all")), keys)
    last = F.greatest(F.lit(0), F.ceil((F.col("_all") - window) / step))
    low, high = F.greatest(F.lit(0), F.ceil((F.col("_o") - window + 1) / step)), F.least(last, F.floor((F.col("_o") + F.col("_n") - 1) / step))
    each = placed.withColumn("_low", low.cast("int")).withColumn("_high", high.cast("int")).filter("_low <= _high").withColumn("piece", F.explode(F.sequence("_low", "_high")))
    begin = F.greatest(F.col("_o"), F.col("piece") * step)
    end = F.least(F.col("_o") + F.col("_n"), F.col("piece") * step + window)
    own = F.slice("_w", (begin - F.col("_o") + 1).cast("int"), (end - begin).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("block_no", own.alias("w"), "page", "section_path", "bbox")))
    whole = each.groupBy(*keys, "piece").agg(parts.alias("p"))
    region = F.array_distinct(F.transform(F.filter("p", lambda x: x["bbox"].isNotNull()), lambda x: F.struct(x["page"].alias("page"), x["bbox"].alias("bbox"))))
    return whole.select(
        *keys, "piece", F.flatten(F.transform("p", lambda x: x["w"])).alias("words"), F.array_min(F.transform("p", lambda x: x["page"])).alias("page_from"),
        F.array_max(F.transform("p", lambda x: x["page"])).alias("page_to"), F.col("p")[0]["section_path"].alias("section_path"), region.alias("regions"),
    )


def fixed_chunks(blocks: DataFrame, window: int = WINDOW, overlap: float = OVERLAP) -> DataFrame:
    """``document_id, ordinal, section_path, heading, content, page_from, page_to, token_count, parent_ordinal, regions``: windows over a document's blocks."""
    out = word_windows(blocks, ["document_id"], window, step_of(window, overlap))
    return out.select(
        "document_id", F.col("piece").alias("ordinal"), "section_path", F.lit(None).cast("string").alias("heading"), F.array_join("words", " ").alias("content"),
        "page_from", "page_to", F.size("words").alias("token_count"), F.lit(None).cast("int").alias("parent_ordinal"), "regions",
    )


def structural_chunks(blocks: DataFrame, floor: int = FLOOR, ceiling: int = CEILING) -> DataFrame:
    """``document_id, ordinal, section_path, heading, content, page_from, page_to, token_count, parent_ordinal, regions``.

    Runs of one section, small ones merged, large ones cut at ``ceiling`` words with the first piece as the others' parent; the
    breadcrumb of headings stands on top of each. No row holds more than a piece and a document's headings.
    """
    own = runs(blocks, "document_id", "block_no", "section_path")
    grouped = merged_groups(structural_groups(blocks).select("document_id", "run", "path", "n_words"), floor)
    path = grouped.groupBy("document_id", "group_no").agg(F.max(F.struct("run", "path"))["path"].alias("path"))
    members = own.join(grouped.select("document_id", "run", "group_no"), ["document_id", "run"])
    pieces = word_windows(members, ["document_id", "group_no"], ceiling, ceiling).drop("section_path").join(path.withColumnRenamed("path", "section_path"), ["document_id", "group_no"])
    titles = blocks.filter("is_title AND section_path IS NOT NULL").groupBy("document_id", "section_path").agg(F.min_by("text", "block_no").alias("heading"))
    headings = titles.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("section_path", "heading"))).alias("headings"))
    order = Window.partitionBy("document_id").orderBy("group_no", "piece")
    out = pieces.join(headings, "document_id", "left").withColumn("ordinal", F.row_number().over(order) - 1).withColumn("heading", F.when(F.col("section_path").isNotNull(), T.breadcrumb(F.col("section_path"), F.col("headings"))))
    body = F.array_join("words", " ")
    content = F.when(F.col("heading").isNotNull(), F.concat("heading", F.lit("\n\n"), body)).otherwise(body)
    return out.select(
        "document_id", "ordinal", "section_path", "heading", content.alias("content"), "page_from", "page_to", (F.size("words") + T.word_count(F.col("heading"))).alias("token_count"),
        F.when(F.col("piece") > 0, F.col("ordinal") - F.col("piece")).alias("parent_ordinal"), "regions",
    )


def ocr_flag(first: Column, last: Column, ocr_pages: Column) -> Column:
    return F.exists(F.sequence(first, last), lambda p: F.array_contains(ocr_pages, p))


def better_reading(text: Column, ocr: Column, least: int = 50) -> Column:
    """A page with fewer than ``least`` characters takes its OCR text if that is longer."""
    return F.when((F.length(text) < least) & (F.length(F.coalesce(ocr, F.lit(""))) > F.length(text)), ocr).otherwise(text)
