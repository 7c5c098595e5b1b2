"""Files, ingestion and streams."""

import datetime
import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from fundstelle.operators import ranking
from fundstelle.plans import evaluation, index
from fundstelle.plans.ingestion import both_strategies, store
from fundstelle.sources import files, sinks
from fundstelle.streaming import streams

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(text, style=None):
    return "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + f"<w:r><w:t>{text}</w:t></w:r></w:p>"


BODY = p("1.2 Ziel", "Heading1") + p("Text") + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>"


def test_word_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(BODY))
    (tmp_path / "b.docx").write_bytes(b"PKxx")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7")
    blocks, failures = files.read_documents(spark, str(tmp_path))
    assert [(r.text, r.kind, r.is_title, r.section_path) for r in blocks.orderBy("block_no").collect()] == [("1.2 Ziel", "text", True, "1.2"), ("Text", "text", False, "1.2"), ("| a | b |\n| --- | --- |", "table", False, "1.2")]
    assert sorted(r.error_code for r in failures.collect()) == ["malformed", "malformed"]  # a PDF file without pages is none


def make_pdf(pages, packed=True):
    """A PDF file of (x, y from the top, text, size, font) runs per page."""
    objects, kids, n = {}, [], 3
    for runs in pages:
        body = b"BT\n" + b"".join(b"/%s %g Tf 1 0 0 1 %g %g Tm (%s) Tj\n" % (f.encode(), s, x, 842 - y, t.replace("(", "\\(").replace(")", "\\)").encode("cp1252")) for x, y, t, s, f in runs) + b"ET"
        stream = zlib.compress(body) if packed else body
        objects[n + 1] = b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(stream), b"/Filter /FlateDecode " if packed else b"", stream)
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (n + 1)
        kids.append(b"%d 0 R" % n)
        n += 2
    fonts = b"<< /Font << /helv << /Type /Font /BaseFont /Helvetica >> /hebo << /Type /Font /BaseFont /Helvetica-Bold >> >> >>"
    objects |= {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 595 842] /Resources %s >>" % (b" ".join(kids), len(kids), fonts)}
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in sorted(objects.items())) + b"trailer << /Root 1 0 R >>"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_documents(spark, tmp_path, packed):
    page = lambda n, own: [(50, 30, f"Kopf Seite {n}", 9, "helv"), *own]
    pages = [page(1, [(50, 60, "1 Prüfung (neu)", 14, "hebo"), (50, 200, "Erster Satz", 10, "helv"), (50, 212, "geht weiter.", 10, "helv")]), page(2, [(50, 300, "2. kein Titel", 9, "helv"), (50, 120, "1.1 Ziel", 10, "helv")]), page(3, [])]
    (tmp_path / "a.pdf").write_bytes(make_pdf(pages, packed))
    (tmp_path / "geheim.pdf").write_bytes(make_pdf(pages) + b" /Encrypt 9 0 R")
    blocks, failures = files.read_documents(spark, str(tmp_path))
    assert [r.error_code for r in failures.collect()] == ["encrypted"]
    own = blocks.orderBy("block_no").collect()
    assert [(r.text, r.page, r.font_size, r.bold, r.is_title, r.section_path) for r in own] == [
        ("1 Prüfung (neu)", 1, 14.0, True, True, "1"), ("Erster Satz geht weiter.", 1, 10.0, False, False, "1"), ("1.1 Ziel", 2, 10.0, False, True, "1.1"), ("2. kein Titel", 2, 9.0, False, False, "1.1"),
    ]
    assert own[1].bbox == [50.0, 190.0, 110.0, 212.0]
    scan = spark.createDataFrame([(own[0].document_id, 3, "Gelesener Text der dritten Seite"), (own[0].document_id, 1, "kurz")], "document_id string, page int, text string")
    assert [r.text for r in files.read_documents(spark, str(tmp_path), scan)[0].filter("page = 3").collect()] == ["Gelesener Text der dritten Seite"]


def test_page_limit(monkeypatch):
    monkeypatch.setattr(files, "MAX_PAGES", 1)
    two = make_pdf([[(50, 50, "a", 9, "helv")], [(50, 50, "b", 9, "helv")]])
    assert files.inspect_upload("x.pdf", two) == "too_many_pages" and files.inspect_upload("x.pdf", make_pdf([[]])) is None


def test_yaml_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "q.yaml").write_text("- id: Q001\n  question: Was?\n  category: code_lookup\n  should_abstain: false\n  gold_sources:\n    - {document: a.pdf, page: 3}\n")
    (tmp_path / "p.yaml").write_text("models:\n  m:\n    input_per_mtok: 2.5\n    output_per_mtok: 10\n")
    (tmp_path / "m.yaml").write_text("documents:\n  - {filename: a.pdf, version_label: B}\n")
    q = files.read_questions(spark, str(tmp_path / "q.yaml")).first()
    assert (q.id, q.difficulty, q.gold_sources[0].page) == ("Q001", "medium", 3)
    assert [tuple(r) for r in files.read_prices(spark, str(tmp_path / "p.yaml")).collect()] == [("m", 2.5, 10.0)]
    docs = spark.createDataFrame([("1", "a.pdf"), ("2", "b.pdf")], "id string, filename string")
    out = files.read_manifest(spark, str(tmp_path / "m.yaml"), docs, "filename string, version_label string")
    assert sorted((r.id, r.version_label) for r in out.collect()) == [("1", "B"), ("2", None)]


def test_scores_are_kept_on_disk(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "x y", "x"), ("b", "x", "x"), ("a", "x y", "x")], "key string, question string, content string")
    asked = []

    def scorer(missing):
        asked.append(missing.count())
        return missing.withColumn("score", ranking.token_overlap(F.col("question"), F.col("content")))

    for _ in range(2):
        got = ranking.cached_on_disk(pairs, f"{tmp_path}/scores", scorer)
        assert sorted((r.key, r.score) for r in got.collect()) == [("a", 0.5), ("a", 0.5), ("b", 1.0)]
    assert asked == [2, 0] and spark.read.parquet(f"{tmp_path}/scores").count() == 2


def test_resumed_run_and_grid(spark, tmp_path):
    words = "pumpe motor ventil kessel druck leitung".split()
    rows = [(f"c{k}", "t", f"d{k % 3}", "structural", f"{words[k % 6]} {words[(k + 1) % 6]} steht hier", 1 + k) for k in range(12)]
    c = spark.createDataFrame(rows, "id string, tenant_id string, document_id string, strategy string, content string, page_from int")
    c = c.withColumns({"content_norm": F.col("content"), "page_to": F.col("page_from"), "section_path": F.lit(None).cast("string"), "heading": F.lit(None).cast("string"), "ocr": F.lit(False)})
    docs = spark.createDataFrame([(f"d{k}", f"f{k}", None) for k in range(3)], "id string, filename string, version_label string")
    q = spark.createDataFrame([(f"Q{k}", "t", f"Wo steht {words[k]}?") for k in range(4)], "query_id string, tenant_id string, question string")
    own, path = index.temporary(c, index.hashed()), f"{tmp_path}/lines"
    first = evaluation.resume(own, c, docs, q.filter("query_id < 'Q2'"), {"k": 3}, path).collect()
    assert [r.question_id for r in first] == ["Q0", "Q1"] and all(r.n_sources for r in first)
    n = spark.read.text(path).count()
    both = evaluation.resume(own, c, docs, q, {"k": 3}, path).collect()
    assert [r.question_id for r in both] == ["Q0", "Q1", "Q2", "Q3"] and spark.read.text(path).count() == n + 2
    assert len(evaluation.resume(own, c, docs, q, {"k": 3}, path).collect()) == 4 and spark.read.text(path).count() == n + 2
    gold = spark.createDataFrame([("Q0", "f0", None, None), ("Q1", "nirgends", None, None)], "question_id string, document string, section string, page int")
    grid = {r.config: r for r in evaluation.retrieval_grid(own, c, docs, q, gold, {"a": {}, "b": {"mode": "fts"}}, 5).collect()}
    assert set(grid) == {"a", "b"} and all(r.n == 2 and r.recall == 0.5 and r.recall_low <= 0.5 <= r.recall_high for r in grid.values())
    assert evaluation.one_knob({"k": 8, "mode": "hybrid"}, {"mode": ["fts", "hybrid"], "k": [4]}) == [{"k": 8, "mode": "hybrid"}, {"k": 8, "mode": "fts"}, {"k": 4, "mode": "hybrid"}]


def test_uploads():
    assert files.inspect_upload("a.txt", b"") == "unsupported" and files.inspect_upload("a.pdf", b"x") == "malformed"
    assert files.inspect_upload("a.pdf", b"%PDF-1.4 /Encrypt") == "encrypted" and files.inspect_upload("a.docx", b"\xd0\xcf\x11\xe0") == "encrypted"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"0" * (3 << 20))
    assert files.inspect_upload("a.docx", out.getvalue()) == "too_large" and files.inspect_upload("a.docx", docx(BODY)) is None


def test_checkpoint_and_worksheet(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"question_id": "Q001", "error": null}\nkaputt\n\n{"question_id": "Q002", "error": "x"}\n')
    rows = files.read_checkpoint(spark, str(tmp_path / "c.jsonl"), "question_id string, error string").collect()
    assert [(r.line_no, r.question_id) for r in rows] == [(0, "Q001"), (3, "Q002")]
    df = spark.createDataFrame([("Q001", 'zwei\nZeilen; "x"', None)], "id string, text string, human string")
    files.write_worksheet(df, str(tmp_path / "w.csv"))
    assert (tmp_path / "w.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    back = files.read_worksheet(spark, str(tmp_path / "w.csv")).first()
    assert back[0] == "Q001" and back["text"] == 'zwei\nZeilen; "x"'


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("Q001", None), ("Q002", "x")], "question_id string, error string")
    sinks.append_checkpoint(rows.coalesce(1), f"{tmp_path}/c")
    assert files.read_checkpoint(spark, f"{tmp_path}/c/part-*.txt", "question_id string, error string").count() == 2
    sinks.write_reports(rows.withColumn("config_hash", F.lit("h")), f"{tmp_path}/r")
    assert files.read_reports(spark, f"{tmp_path}/r/config_hash=h", "question_id string").count() == 2
    logs = spark.sql("SELECT '1' AS id, 0.1234567 AS cost_usd, timestamp'2026-01-05 10:00:00' AS created_at")
    sinks.append_logs(logs, f"{tmp_path}/l")
    assert str(spark.read.parquet(f"{tmp_path}/l").first().cost_usd) == "0.123457"


def test_question_sets(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"id": "Q001", "category": "conflict", "question": "Was?", "gold_sources": [{"document": "d", "page": 3}], "should_abstain": False}]))
    row = files.read_questions(spark, str(path)).first()
    assert row.difficulty == "medium" and row.gold_sources[0].page == 3 and row.expected_answer_points == []
    for wrong in ([{"id": "1", "question": "x"}], [{"id": "Q001", "question": " "}], [{"id": "Q001", "question": "x"}] * 2):
        path.write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            files.read_questions(spark, str(path))


def test_hashes_and_keys(spark, tmp_path):
    assert files.config_hash({"b": 1, "a": "ü", "c": None}) == files.config_hash({"a": "ü", "b": 1}) and len(files.questions_fingerprint([("Q001", "x")])) == 12
    with pytest.raises(ValueError):
        files.storage_key(str(tmp_path), "../x")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "antwort.txt").write_text("Grüße")
    assert files.read_prompts(spark, str(tmp_path / "p")).first().text == "Grüße"


def blocks(spark, n=3):
    rows = [(f"d{d}", k, "1 Titel" if k == 0 else f"wort{k} " * 60, 1 + k, k == 0, "1") for d in range(n) for k in range(3)]
    return spark.createDataFrame(rows, "document_id string, block_no int, text string, page int, is_title boolean, section_path string")


def test_ingestion_is_idempotent(spark, tmp_path):
    for _ in range(2):
        store(blocks(spark), "t", str(tmp_path))
        assert spark.read.parquet(f"{tmp_path}/chunks").count() == both_strategies(blocks(spark), "t").count() == 6
        assert spark.read.parquet(f"{tmp_path}/embeddings").count() == 6


def test_ingest_stream(spark, tmp_path):
    blocks(spark).write.parquet(f"{tmp_path}/in")
    source = streams.read_stream(spark, f"{tmp_path}/in", blocks(spark).schema)
    for _ in range(2):
        query = streams.ingest_stream(source, "t", f"{tmp_path}/out", f"{tmp_path}/cp")
        assert query.awaitTermination(120)
        assert spark.read.parquet(f"{tmp_path}/out/chunks").count() == 6


def run(df, tmp_path, mode):
    query = df.writeStream.format("memory").queryName(name := f"t{abs(hash(str(tmp_path)))}").outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_rolling_stats(spark, tmp_path):
    logs = spark.read.parquet("/root/testdata/sf0.001/query_logs.parquet").dropDuplicates(["id"])
    logs.write.parquet(f"{tmp_path}/in")
    out = run(streams.rolling_stats(streams.read_stream(spark, f"{tmp_path}/in", logs.schema)), tmp_path, "complete")
    assert out.agg(F.sum("n")).first()[0] == logs.count()
    assert out.agg(F.sum("n_abstained")).first()[0] == logs.filter("abstained").count()


def test_token_streams(spark, tmp_path):
    d = spark.createDataFrame([("r", 2, "b", "stop"), ("r", 1, "a", None), ("s", 1, "x", None)], "request_id string, seq long, text string, finish_reason string")
    d.write.parquet(f"{tmp_path}/in")
    out = run(streams.token_streams(streams.read_stream(spark, f"{tmp_path}/in", d.schema)), tmp_path, "append")
    assert [tuple(r) for r in out.collect()] == [("r", "ab", "stop")]


def test_token_streams_end_and_are_forgotten(spark, tmp_path):
    """A request that stops gives what it has; late pieces of a finished one give nothing."""
    at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    batches = [[("r", 1, "a", "stop", at(0)), ("s", 1, "x", None, at(0))], [("r", 2, "b", "stop", at(1))], [("z", 1, "spät", "stop", at(50))], [("z2", 1, "", "stop", at(59))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "request_id string, seq long, text string, finish_reason string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        (tmp_path / "in" / str(k)).rename(tmp_path / "in" / f"part={k}")
    d = spark.read.parquet(f"{tmp_path}/in").drop("part")
    source = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = run(streams.token_streams(source, 600_000), tmp_path, "append")
    got = sorted(tuple(r) for r in out.collect())
    assert ("r", "a", "stop") in got and ("s", "x", "timeout") in got and len([g for g in got if g[0] == "r"]) == 1


def test_token_streams_share_groups(spark, tmp_path, monkeypatch):
    """Python is called per group of requests, not per request; pieces of requests mixed over micro-batches come together."""
    monkeypatch.setattr(streams, "GROUPS", 2)
    rows = [(f"r{k}", seq, None if seq == 2 else f"{k}ä{seq}", "stop" if seq == 3 else None) for seq in (1, 2, 3) for k in range(9)]
    for at, part in enumerate((rows[:14], rows[14:])):
        spark.createDataFrame(part, "request_id string, seq long, text string, finish_reason string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={at}")
    d = spark.read.parquet(f"{tmp_path}/in").drop("part")
    source = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = run(streams.token_streams(source), tmp_path, "append")
    assert sorted(tuple(r) for r in out.collect()) == [(f"r{k}", f"{k}ä1{k}ä3", "stop") for k in range(9)]


def test_stream_rate_limits(spark, tmp_path):
    at = lambda k: datetime.datetime(2026, 1, 1, 0, 0, k)
    h = spark.createDataFrame([("a", k, at(k)) for k in range(4)] + [("b", 9, at(0))], "key string, seq long, ts timestamp").coalesce(1)
    h.write.parquet(f"{tmp_path}/in")
    out = run(streams.rate_limits(streams.read_stream(spark, f"{tmp_path}/in", h.schema), 2, 3.0), tmp_path, "append")
    assert sorted((r.seq, r.allowed) for r in out.collect()) == [(0, True), (1, True), (2, False), (3, True), (9, True)]


def test_frames(spark):
    body = ": ping\r\nevent: token\r\ndata: a\r\ndata: b\r\n\r\ndata:c\n\n"
    assert streams.parse_frames(body) == [("token", "a\nb"), ("message", "c")]
    streams.register_frames(spark)
    assert spark.sql("SELECT * FROM sse_frames('data: x\n\n')").first().data == "x"
