"""Prompts, reports and pluggable parts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fundstelle import protocols
from fundstelle.operators import reports


def test_prompts(spark):
    df = spark.createDataFrame([("{b}", "x", ["p"], [])], "a string, b string, p array<string>, q array<string>")
    r = df.select(reports.rendered("1 {a} 2 {b} {c}", {"a": F.col("a"), "b": F.col("b")}).alias("t"), reports.bullets(F.col("p")).alias("p"), reports.bullets(F.col("q")).alias("q")).first()
    assert (r.t, r.p, r.q) == ("1 {b} 2 x {c}", "- p", "(keine)")


def test_events(spark):
    df = spark.createDataFrame([("q", ["1"], "a b [S1]", None), ("e", ["1"], None, "kaputt")], "query_id string, sources array<string>, answer string, error string")
    rows = [(r.query_id, r.event, r.data) for r in reports.answer_events(df).orderBy("query_id", "seq").collect()]
    assert rows[:2] == [("e", "stage", "retrieving"), ("e", "error", "kaputt")]
    assert [x[1:] for x in rows[2:]] == [("stage", "retrieving"), ("sources", '["1"]'), ("stage", "generating"), ("token", "a "), ("token", "b "), ("token", "[S1]"), ("done", "a b [S1]")]


def test_report_checks(spark):
    a, b = spark.createDataFrame([("1",), ("1",), ("2",)], "k string"), spark.createDataFrame([("1",), ("2",), ("3",)], "k string")
    assert sorted(tuple(r) for r in reports.coverage(a, b, "k").collect()) == [("1", 2, 1), ("3", 0, 1)]
    c = spark.createDataFrame([("a", 5, None), ("a", 5, "x"), ("b", None, None)], "mode string, k int, error string")
    assert reports.config_row(c, {"mode": "a", "k": 5}).count() == 1 and reports.config_row(c, {"k": None}).first().mode == "b"
    with pytest.raises(ValueError):
        reports.config_row(c, {"mode": "z"})
    t = spark.createDataFrame([("a", 0.5, None), ("b", 0.25, 1.0)], "label string, x double, y double")
    assert reports.markdown(t, {"x": True, "y": False}).split("\n")[2:] == ["| a | **0.500** | – |", "| b | 0.250 | **1.000** |"]
    s = reports.worksheet(spark.createDataFrame([("1",), ("2",)], "question_id string"), spark.createDataFrame([("1", 2, "gut")], "question_id string, score int, rationale string"))
    assert sorted(tuple(r) for r in s.collect()) == [("1", "2", "gut", ""), ("2", "", "", "")]


def test_plugs(spark, tmp_path):
    p = spark.createDataFrame([("q", "[S1] x", "was?"), ("r", "", "was?")], "query_id string, context string, question string")
    assert [r.answer for r in protocols.CitingClient().complete(p).orderBy("query_id").collect()] == ["Siehe [S1]", "NICHT_GEFUNDEN"]

    def answer(context, question):
        return question if context else 1 / 0

    rows = protocols.FunctionClient(answer).complete(p).orderBy("query_id").collect()
    assert rows[0].answer == "was?" and rows[1].error.startswith("ZeroDivisionError")
    hits = spark.createDataFrame([("q", "a", 1, "rot", "blau"), ("q", "b", 2, "rot", "rot")], "query_id string, chunk_id string, rank int, question string, content string")
    assert protocols.OverlapReranker().rerank(hits, 1).first().chunk_id == "b" and protocols.NoReranker().rerank(hits, 1).first().chunk_id == "a"
    key = hashlib.sha256(b"x").hexdigest()
    store = protocols.LocalStorage(str(tmp_path))
    store.save(key, b"x")
    assert store.read(key) == b"x"
