"""Readers of files: Word documents, JSONL checkpoints, JSON reports, worksheets, prices, prompts, question sets, manifests."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundstelle.operators import chunking
from fundstelle.session import cut_lineage
from fundstelle.sources import pdf

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "document_id string, block_no int, text string, page int, bbox array<double>, font_size double, bold boolean, kind string, is_title boolean, section_path string"
#: Limits of an upload: members of an archive, total size and ratio of expansion (of members over 1 MiB).
MAX_TOTAL, MAX_RATIO, LARGE_MEMBER = 500 * 2**20, 200, 2**20
#: Pages of a PDF file at most.
MAX_PAGES = 2000


def _table(rows: list[list[str]]) -> str:
    """As wide as the first row: shorter rows are filled, longer ones cut."""
    width = len(rows[0]) if rows else 0
    lines = ["| " + " | ".join([*r, *[""] * width][:width]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if lines else ""


def word_blocks(content: bytes) -> list[dict]:
    """Blocks of a Word document in its order: paragraphs and tables (as Markdown); titles by style; the page is always 1."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    text_of = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    blocks, path = [], None
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            text = text_of(node).strip()
            style = node.find(f"{_W}pPr/{_W}pStyle")
            title = style is not None and re.match(r"(?i)(heading|berschrift|überschrift|title|titel)", style.get(f"{_W}val", "")) is not None
            if not text:
                continue
            if title:
                number = re.match(r"\d+(?:\.\d+)*", text)
                path = number[0] if number else text
            blocks.append({"text": text, "kind": "text", "is_title": title, "section_path": path})
        elif node.tag == f"{_W}tbl":
            rows = [[text_of(cell).strip() for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            if rows:
                blocks.append({"text": _table(rows), "kind": "table", "is_title": False, "section_path": path})
    return blocks


def inspect_upload(name: str, content: bytes) -> str | None:
    """A code for what is wrong with an upload, or None: unsupported, malformed, encrypted, too_large (when expanded), too_many_pages."""
    suffix = Path(name).suffix.lower()
    if suffix == ".pdf":
        try:
            file = pdf.File(content)
        except pdf.NotAPdfError:
            return "malformed"
        if file.encrypted:
            return "encrypted"
        n = len(file.pages())
        return "malformed" if n == 0 else "too_many_pages" if n > MAX_PAGES else None
    if suffix != ".docx":
        return "unsupported"
    if content.startswith(b"\xd0\xcf\x11\xe0"):
        return "encrypted"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            members = archive.infolist()
            if sum(m.file_size for m in members) > MAX_TOTAL or any(m.file_size > LARGE_MEMBER and m.file_size > MAX_RATIO * max(1, m.compress_size) for m in members):
                return "too_large"
            return None if "word/document.xml" in archive.namelist() else "malformed"
    except zipfile.BadZipFile:
        return "malformed"


SPANS = "document_id string, page int, block_no int, span_no int, text string, font_size double, flags int, bbox array<double>, kind string, is_title boolean, section_path string"


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """What the files of a folder hold, as rows of SPANS by ``kind``: ``span`` of PDF files; ``text`` and ``table`` of Word files; ``pages`` with the number of a PDF
    file's pages; ``error`` with a code as text for a file that can't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    names = [x.split()[0] for x in SPANS.split(", ")]

    def parts(path: str, content: bytes) -> list[dict]:
        if wrong := inspect_upload(path, content):
            return [{"text": wrong, "kind": "error"}]
        try:
            if path.lower().endswith(".docx"):
                return [b | {"block_no": n, "page": 1} for n, b in enumerate(word_blocks(content))]
            n_pages, found = pdf.spans(content)
            return [{"kind": "pages", "page": n_pages}] + [s | {"kind": "span"} for s in found]
        except (KeyError, ValueError, IndexError, TypeError, ElementTree.ParseError, zipfile.BadZipFile):
            return [{"text": "parse_failed", "kind": "error"}]

    def run(batches):
        for batch in batches:
            rows = [{"document_id": hashlib.sha256(c).hexdigest()} | part for p, c in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True) for part in parts(p, c)]
            types = {"page": pa.int32(), "block_no": pa.int32(), "span_no": pa.int32(), "flags": pa.int32(), "font_size": pa.float64(), "bbox": pa.list_(pa.float64()), "is_title": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names=names)

    return files.mapInArrow(run, SPANS)


def read_documents(spark: SparkSession, folder: str, recognised: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, failures) of the Word and PDF files of a folder. Files that can't be read are rows of ``failures(document_id, error_code)``.

    Of PDF files, runs of text are joined to blocks, running headers left out, titles found by size and number, and sections carried on.
    ``recognised(document_id, page, text)`` are readings of pages by OCR: one takes the place of a page's text if that has fewer than 50 characters and it has
    more. ``ocr_pages`` says which.
    """
    parts = cut_lineage(read_parts(spark, folder))
    columns = [x.split()[0] for x in BLOCKS.split(", ")]
    word = parts.filter("kind IN ('text', 'table')").withColumn("bold", F.lit(False)).select(*columns)
    n_pages = parts.filter("kind = 'pages'").select("document_id", F.col("page").alias("page_count"))
    own = chunking.span_blocks(parts.filter("kind = 'span'"))
    if recognised is not None:
        better = ocr_pages(own, recognised, n_pages)
        read = better.select("document_id", "page", F.lit(0).alias("block_no"), "text", F.lit(None).cast("double").alias("font_size"), F.lit(False).alias("bold"), F.lit(None).cast("array<double>").alias("bbox"))
        own = own.join(better, ["document_id", "page"], "left_anti").unionByName(read)
    placed = chunking.reading_order(chunking.without_running_headers(own.withColumn("kind", F.lit("text")), n_pages))
    ordered = placed.withColumn("block_no", F.col("place") - 1).drop("place")
    printed = chunking.fill_sections(chunking.median_titles(ordered)).select(*columns)
    return word.unionByName(printed), parts.filter("kind = 'error'").select("document_id", F.col("text").alias("error_code"))


def ocr_pages(blocks: DataFrame, recognised: DataFrame, n_pages: DataFrame, least: int = 50) -> DataFrame:
    """``document_id, page, text`` of the pages whose OCR reading is taken: those with little text of their own and more in the reading."""
    printed = blocks.groupBy("document_id", "page").agg(F.sum(F.length("text")).alias("n"))
    both = recognised.join(n_pages.select("document_id"), "document_id", "left_semi").join(printed, ["document_id", "page"], "left")
    n = F.coalesce("n", F.lit(0))
    return both.filter((n < least) & (F.length(F.trim("text")) > n)).select("document_id", "page", "text")


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL lines with ``line_no``; lines that aren't JSON of the schema are dropped. Lines keep their order within a file."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line")).filter("trim(line) <> ''")
    parsed = text.select("line_no", F.from_json("line", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.filter("r._bad IS NULL").select("line_no", "r.*").drop("_bad")


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_worksheet(spark: SparkSession, path: str) -> DataFrame:
    """A worksheet with ; or , between fields (sniffed from the first line), BOM and quoted line ends allowed."""
    head = spark.read.text(path).first()
    first = (head[0] if head else "").lstrip("﻿")
    return spark.read.csv(path, sep=";" if first.count(";") >= first.count(",") else ",", header=True, multiLine=True, escape='"', encoding="UTF-8")


def write_worksheet(rows: DataFrame, path: str) -> None:
    """A small worksheet with ; and BOM, for reading by people; rows are written by the driver one by one."""
    with open(path, "w", encoding="utf-8-sig", newline="") as file:
        out = csv.writer(file, delimiter=";")
        out.writerow(rows.columns)
        out.writerows(["" if v is None else v for v in row] for row in rows.toLocalIterator())


def _load(path: str):
    """The content of a JSON or, by its suffix, YAML file."""
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise ValueError("YAML files need the package pyyaml") from e
        return yaml.safe_load(Path(path).read_text("utf-8"))
    return json.loads(Path(path).read_text("utf-8"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """``model, price_in, price_out`` (per million tokens) of a file with ``models: {name: {input_per_mtok, output_per_mtok}}``."""
    models = (_load(path) or {}).get("models") or {}
    return spark.createDataFrame([(m, float(p["input_per_mtok"]), float(p["output_per_mtok"])) for m, p in models.items()], "model string, price_in double, price_out double")


def read_manifest(spark: SparkSession, path: str, documents: DataFrame, schema: str) -> DataFrame:
    """Documents with what a manifest (a list, or a list under one key) says of their ``filename``; documents it doesn't name keep nulls."""
    rows = _load(path)
    rows = next((v for v in rows.values() if isinstance(v, list)), []) if isinstance(rows, dict) else rows
    names = [f.strip().split()[0] for f in schema.split(",")]
    told = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema).dropDuplicates(["filename"])
    return documents.join(told, "filename", "left")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set from a list in JSON or YAML. Raises ValueError for a wrong id, an empty question or a repeated id."""
    rows = _load(path)
    if not isinstance(rows, list):
        raise ValueError("a question set is a list")
    seen: set[str] = set()
    for row in rows:
        if not re.fullmatch(r"Q\d{3}", row.get("id") or "") or not (row.get("question") or "").strip() or row["id"] in seen:
            raise ValueError(f"bad question: {row.get('id')!r}")
        seen.add(row["id"])
    schema = "id string, category string, question string, expected_answer_points array<string>, gold_sources array<struct<document:string,section:string,page:int>>, should_abstain boolean, difficulty string, notes string"
    names = [f.split()[0] for f in ("id", "category", "question", "expected_answer_points", "gold_sources", "should_abstain", "difficulty", "notes")]
    filled = [tuple([{"difficulty": "medium", "expected_answer_points": [], "gold_sources": []}.get(n) if r.get(n) is None else [tuple(g.get(k) for k in ("document", "section", "page")) for g in r[n]] if n == "gold_sources" else r[n] for n in names]) for r in rows]
    return spark.createDataFrame(filled, schema)


def read_table_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small JSON list of objects, such as prices or a corpus manifest."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """``name, text, sha256`` of prompt templates."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), F.decode("content", "UTF-8").alias("text"), F.sha2(F.decode("content", "UTF-8"), 256).alias("sha256"))


def config_hash(config: dict) -> str:
    """SHA-256 of compact JSON with sorted keys, without knobs that are None."""
    return hashlib.sha256(json.dumps({k: v for k, v in config.items() if v is not None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def questions_fingerprint(pairs: list[tuple[str, str]]) -> str:
    return hashlib.sha256(json.dumps([list(p) for p in pairs], ensure_ascii=False).encode()).hexdigest()[:12]


def storage_key(root: str, content_hash: str) -> Path:
    """Where a file is kept; refuses keys that would lie outside ``root``."""
    path = (Path(root) / content_hash[:2] / content_hash).resolve()
    if not path.is_relative_to(Path(root).resolve()) or not re.fullmatch(r"[0-9a-f]{64}", content_hash):
        raise ValueError("not a content hash")
    return path
