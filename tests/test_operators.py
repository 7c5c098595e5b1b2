"""Small cases with known answers."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundstelle.functions import python as P
from fundstelle.functions import text as T
from fundstelle.operators import chunking, context, evaluation, ingest, lexical, metrics, operations, ranking, vectors
from fundstelle.plans import index, retrieval
from fundstelle.tenancy import NotFoundError, TenantScope


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def one(spark, expression, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(expression.alias("x")).first().x


@pytest.mark.parametrize(("text", "code"), [
    ("LH 3.2.1", "lh3.2.1"), ("LH-3.2.1", "lh3.2.1"), ("LH3.2.1", "lh3.2.1"), ("UN R79", "unr79"), ("ECE-R79", "ecer79"), ("R 79", "r79"), ("R 79H", "r79h"), ("ohne  Code hier", "ohne code hier"), ("xÜLH 3.2", "xülh 3.2"), ("", ""),
])
def test_normal_form(spark, text, code):
    assert one(spark, T.normalize_codes(F.col("t")), t=text) == code
    assert one(spark, T.normalize_codes(F.col("t")), t=code) == code


def test_codes(spark):
    assert one(spark, T.extract_codes(F.col("t")), t="Siehe LH-3.2.1, UN R79, SY 1.2 und LH 3.2.1.") == ["lh3.2.1", "sy1.2"]
    assert one(spark, T.first_code(F.col("t")), t="Was sagt UN R79?") == "unr79" and one(spark, T.first_code(F.col("t")), t="Der 3. Absatz, R 79H") == "r79h"
    assert one(spark, T.first_code(F.col("t")), t="keiner") is None


def test_composed(spark):
    assert one(spark, P.composed(F.col("t")), t="über") == "über"
    assert spark.createDataFrame([(None,)], "t string").select(P.composed(F.col("t")).alias("x")).first().x is None


def test_stems():
    assert P.stem("Prüfung") == P.stem("Pruefung") == P.stem("Prüfungen")
    assert P.stems("und die Prüfung") == ["", "", "prufung"]


def test_word_similarity_is_the_best_run():
    random.seed(3)
    for _ in range(60):
        code = random.choice(["lh3.2.1", "prf10.15.8", "unr79h"])
        text = " ".join(random.choices(["lh", "3", "2", "1", "prf10", "15", "8", "r79", "unr7", "79h", "lh3", "der"], k=random.randint(1, 8)))
        wanted, ordered = P.code_trigrams(code), P.OrderedTrigrams(text).ordered
        best = max((len(s & wanted) / len(s | wanted) for i in range(len(ordered)) for j in range(i + 1, len(ordered) + 1) for s in [set(ordered[i:j])]), default=0)
        assert P.word_similarity(code, text) == pytest.approx(best)
    assert P.word_similarity("", "x") == 0 and P.word_similarity("r79", "") == 0


def test_cover_density_prefers_near_terms():
    assert P.cover_density([[1], [2]]) > P.cover_density([[1], [9]]) > 0
    assert P.cover_density([]) == 0


def test_hash_embedding():
    assert np.linalg.norm(P.hash_embedding("a b a", 16)) == pytest.approx(1) and not P.hash_embedding("", 16).any()


def rank_rows(spark, *rankings):
    return [spark.createDataFrame([("q", c, k + 1) for k, c in enumerate(r)], "query_id string, chunk_id string, rank int") for r in rankings]


def test_rrf(spark):
    out = ranking.rrf(rank_rows(spark, "abc"), 60)
    assert values(out, "rank", "chunk_id") == [(1, "a"), (2, "b"), (3, "c")]
    assert out.filter("chunk_id = 'b'").first().score == pytest.approx(1 / 62)
    assert ranking.rrf(rank_rows(spark, "xay", "zab")).filter("rank = 1").first().chunk_id == "a"  # twice second beats once first
    assert values(ranking.rrf(rank_rows(spark, "ab", "ba")), "rank", "chunk_id") == [(1, "a"), (2, "b")]  # ties by first appearance
    assert ranking.rrf(rank_rows(spark, "aab")).filter("chunk_id = 'b'").first().score == pytest.approx(1 / 63)  # later ranks stay
    assert ranking.rrf(rank_rows(spark, "ab", "ba"), weights=[1.0, 2.0]).filter("rank = 1").first().chunk_id == "b"
    assert ranking.rrf(rank_rows(spark, "", "a")).count() == 1
    for wrong in ({"k": 0}, {"weights": [1.0]}):
        with pytest.raises(ValueError):
            ranking.rrf(rank_rows(spark, "a", "b"), **wrong)


def test_concat_and_rerank(spark):
    assert values(ranking.concat_ranked(rank_rows(spark, "ab", "bc"), 3), "rank", "chunk_id") == [(1, "a"), (2, "b"), (3, "c")]
    hits = rank_rows(spark, "abc")[0].withColumn("score", F.when(F.col("chunk_id") == "c", 2.0).otherwise(1.0))
    assert values(ranking.rerank(hits, 2), "rank", "chunk_id") == [(1, "c"), (2, "a")]


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [1.0, 1.0], "b"), (4, [0.0, 0.0], "a"), (5, None, "a")], "chunk_id long, vec array<double>, s string")
    q = spark.createDataFrame([("q", [1.0, 0.1], "a"), ("z", [0.0, 0.0], "a"), ("n", None, "a")], "query_id string, vec array<double>, s string")
    assert values(vectors.nearest(v, q, 2), "rank", "chunk_id") == [(1, 1), (2, 3)]
    assert values(vectors.nearest(v, q, 9, ["s"]), "rank", "chunk_id") == [(1, 1), (2, 2)]
    assert vectors.nearest(v, q.limit(0), 2).count() == 0
    assert vectors.nearest(v.limit(0), q, 2).count() == 0


def test_web_query():
    assert lexical.parse_web('bremse "rote linie" -alt') == {"must": ["bremse"], "must_not": ["alt"], "phrases": [["rote", "linie"]]}


def test_web_search(spark):
    c = spark.createDataFrame([("1", "die rote linie der bremse"), ("2", "rote bremse linie"), ("3", "rote linie bremse alt"), ("4", None)], "id string, content_norm string")
    q = spark.createDataFrame([("q", 'bremse "rote linie" -alt'), ("n", "-alt"), ("e", None)], "query_id string, question string")
    assert values(lexical.match_web(c, q), "query_id", "chunk_id") == [("q", "1")]


def test_web_phrases_of_any_length(spark):
    c = spark.createDataFrame([("1", "Die rote, lange Linie der Bremse"), ("2", "rote linie lange linie"), ("3", "lange linie"), ("4", "rote lange linie alt")], "id string, content_norm string")
    rows = [("two", '"lange linie"'), ("two", '"lange linie"'), ("three", '"rote lange linie" -alt'), ("mixed", 'bremse "die rote lange linie" "linie der"'), ("apart", '"rote linie der"'), ("none", '"lange linie" -linie')]
    found = lexical.match_web(c, spark.createDataFrame(rows, "query_id string, question string"))
    assert values(found, "query_id", "chunk_id") == [("mixed", "1"), ("three", "1"), ("two", "1"), ("two", "2"), ("two", "3"), ("two", "4")]
    assert "Exchange hashpartitioning(query_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_full_text(spark):
    c = spark.createDataFrame([("1", "die prüfung der bremse"), ("2", "bremse"), ("3", None), ("4", "")], "id string, content_norm string")
    q = spark.createDataFrame([("q", "Prüfung Bremse"), ("e", ""), ("n", None)], "query_id string, question string")
    assert values(lexical.match(c, q, True), "chunk_id") == [("1",)]
    assert values(lexical.match(c, q, False), "chunk_id") == [("1",), ("2",)]
    assert values(lexical.search_german(c, q, 5), "rank", "chunk_id") == [(1, "1"), (2, "2")]
    assert values(lexical.search_german(c, q, 5, every=True), "chunk_id") == [("1",)]


def test_all_terms_are_tested_in_the_join(spark, monkeypatch):
    c = spark.createDataFrame([("1", "die prüfung der bremse die"), ("2", "bremse"), ("3", "prüfung die bremse prüfung")], "id string, content_norm string")
    q = spark.createDataFrame([("q", "Prüfung Bremse die"), ("q", "Prüfung Bremse die"), ("o", "bremse"), ("x", "bremse achse")], "query_id string, question string")
    expected = [("o", "1", 1, 1), ("o", "2", 1, 1), ("o", "3", 1, 1), ("q", "1", 3, 4), ("q", "3", 3, 4)]
    found = lexical.match(c, q, True)
    assert values(found, "query_id", "chunk_id", "n_matched", "occurrences") == expected
    assert "Exchange hashpartitioning(query_id" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lexical, "small_side", lexical.cut_lineage)  # as with too many queries to send
    assert values(lexical.match(c, q, True), "query_id", "chunk_id", "n_matched", "occurrences") == expected


def test_many_queries_shuffle_no_probes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "small_side", lexical.cut_lineage)  # as with too many terms and queries to send at once
    monkeypatch.setattr(lexical, "SMALL_ROWS", 2, raising=False)
    c = spark.createDataFrame([("1", "die prüfung der bremse die"), ("2", "bremse"), ("3", "prüfung die bremse prüfung"), ("4", None)], "id string, content_norm string")
    rows = [("q", "Prüfung Bremse die"), ("q", "Prüfung Bremse die"), ("o", "bremse"), ("p", "Bremse"), ("d", "der die"), ("x", "bremse achse"), ("e", "")]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lexical.match(c, spark.createDataFrame(rows, "query_id string, question string"), True)
        plan = found._jdf.queryExecution().executedPlan().toString()
        wanted = [("d", "1"), ("o", "1"), ("o", "2"), ("o", "3"), ("p", "1"), ("p", "2"), ("p", "3"), ("q", "1"), ("q", "3")]
        assert values(found, "query_id", "chunk_id") == wanted and "hashpartitioning(rarest" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_trigram_search(spark):
    c = spark.createDataFrame([("1", "siehe lh3.2.1 dort"), ("2", "nichts"), ("3", None)], "id string, content_norm string")
    q = spark.createDataFrame([("q", "Was sagt LH-3.2.1?"), ("n", "kein code")], "query_id string, question string")
    assert values(lexical.search_trigrams(c, q, 5), "query_id", "chunk_id", "score") == [("q", "1", 1.0)]


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, rank int, document_id string, section_path string, content string, cost int")


def test_budget(spark):
    h = hits(spark, [("q", 1, "d", "1", "a", 9), ("q", 2, "d", "2", "b", 0), ("q", 3, "d", "3", "c", 1)])
    assert values(context.select_context(h, 5, F.col("cost")), "rank") == [(1,)]
    assert values(context.select_context(h, 9, F.col("cost")), "rank") == [(1,), (2,)]
    same = hits(spark, [("q", 1, "d", "1", "a", 1), ("q", 2, "d", "1", "b", 50), ("q", 3, "e", "1", "c", 1), ("q", 4, "d", None, "d", 1), ("q", 5, "d", None, "e", 1), ("q", 6, "d", "", "f", 1), ("q", 7, "d", "", "g", 1)])
    assert values(context.select_context(same, 9, F.col("cost")), "rank") == [(1,), (3,), (4,), (5,), (6,), (7,)]


def test_budget_against_a_loop(spark):
    random.seed(1)
    rows = [(f"q{q}", r, random.choice("de"), random.choice([None, "", "1", "2"]), "x", random.randint(0, 4)) for q in range(40) for r in range(1, 9)]
    wanted = []
    for q in range(40):
        seen, total, started = set(), 0, False
        for _, r, d, s, _, c in (x for x in rows if x[0] == f"q{q}"):
            if s and (d, s) in seen:
                continue
            if started and total + c > 6:
                break
            seen.add((d, s))
            total, started = total + c, True
            wanted.append((f"q{q}", r))
    assert values(context.select_context(hits(spark, rows), 6, F.col("cost")), "query_id", "rank") == sorted(wanted)


def test_citations(spark):
    def check(answer, known):
        df = spark.createDataFrame([(answer, known)], "answer string, known array<string>")
        r = context.validate_citations(df).first()
        return r.validated, r.cited, r.invented, r.abstained

    assert check("Ja [S1], nein [S9].", ["S1"]) == ("Ja [S1], nein.", ["S1"], 1, False)
    assert check("Ja [S9].", ["S1"])[0] == T.SENTINEL
    assert check("Ohne Beleg.", ["S1"])[0] == T.SENTINEL
    assert check(T.SENTINEL, ["S1"]) == (T.SENTINEL, [], 0, True)
    assert check("[S2] [S1] [S2]", ["S1", "S2"])[1] == ["S2", "S1"]


def test_conflicts_and_markup(spark):
    rows = [("q", 1, "v1", "LH-1.2.3 Kraft 300 N"), ("q", 2, "v2", "LH 1.2.3 Kraft 250 N"), ("q", 3, None, "LH 9.9 x"), ("q", 4, "v1", "LH 9.9 x")]
    df = spark.createDataFrame(rows, "query_id string, place int, version_label string, content string")
    assert values(context.version_conflicts(df), "code", "labels") == [("lh1.2.3", ["v1", "v2"])]
    assert one(spark, T.neutral(F.col("t")), t="<Quelle id=1>[S3]</quelle>") == "‹Quelle id=1›(S3)‹/quelle›"
    assert one(spark, T.snippet(F.col("t")), t=" " + "ab " * 100) == ("ab " * 80).strip() + "…"


def test_gate(spark):
    df = spark.createDataFrame([(0.3,), (0.2,), (None,)], "s double")
    assert [r.x for r in df.select(context.gate(F.col("s"), True, 0.3).alias("x")).collect()] == [False, True, True]
    assert [r.x for r in df.select(context.gate(F.col("s"), False, 0.3).alias("x")).collect()] == [False, False, True]


def test_fixed_windows(spark):
    df = spark.createDataFrame([("a", " ".join("abcdefghij")), ("e", ""), ("n", None)], "k string, t string")
    assert values(chunking.fixed_windows(df, "k", "t", 4, 0.25), "ordinal", "start_word", "n_words") == [(0, 0, 4), (1, 3, 4), (2, 6, 4)]


def test_structural_chunks(spark):
    word = lambda n: " ".join(f"w{k}" for k in range(n))
    rows = [("d", 0, "1 Einleitung", 1, True, "1"), ("d", 1, word(20), 1, False, "1"), ("d", 2, "1.1 Ziel", 2, True, "1.1"), ("d", 3, word(900), 2, False, "1.1"), ("d", 4, "2 Rest", 3, True, "2"), ("d", 5, "ende", 3, False, "2")]
    blocks = spark.createDataFrame(rows, "document_id string, block_no int, text string, page int, is_title boolean, section_path string")
    out = chunking.structural_chunks(blocks).orderBy("ordinal").collect()
    assert [(r.ordinal, r.section_path, r.parent_ordinal) for r in out] == [(0, "1.1", None), (1, "1.1", 0), (2, "2", None)]
    assert out[0].heading == "1 Einleitung > 1.1 Ziel" and out[0].token_count == 800 + 5 and (out[0].page_from, out[0].page_to) == (1, 2)
    assert out[2].content == "2 Rest\n\n2 Rest ende"


def test_merge_against_a_loop(spark):
    random.seed(5)
    cases = [[(random.choice(["1", "2", None]), random.choice([10, 60, 120])) for _ in range(random.randint(0, 6))] for _ in range(60)]
    df = spark.createDataFrame([(f"d{n}", k, path, words, 1) for n, c in enumerate(cases) for k, (path, words) in enumerate(c)], "document_id string, run int, path string, n_words int, n_blocks int")
    found = {(r.document_id, r.group_no): (r.path, r.n_words, r.n_blocks) for r in chunking.merged_sections(df).collect()}
    wanted = {}
    for n, case in enumerate(cases):
        out, held = [], None
        for path, words in case:
            held = (path, (held[1] if held else 0) + words, (held[2] if held else 0) + 1)
            if held[1] >= 100:
                out.append(held)
                held = None
        wanted |= {(f"d{n}", k): g for k, g in enumerate(out + ([held] if held else []))}
    assert found == wanted


def test_windows_against_slices(spark):
    """Words, pages, sections and boxes of fixed windows over blocks, against the words in one list."""
    random.seed(6)
    rows = [(f"d{d}", b, " ".join(f"w{d}.{b}.{k}" for k in range(random.choice([0, 1, 5, 30]))), 1 + b // 2, random.choice(["1", "2", None]), [float(b // 3)] * 4) for d in range(8) for b in range(random.randint(0, 9))]
    df = spark.createDataFrame(rows, "document_id string, block_no int, text string, page int, section_path string, bbox array<double>")
    got = {(r.document_id, r.ordinal): (r.content, r.page_from, r.page_to, r.section_path, [(x.page, x.bbox) for x in r.regions]) for r in chunking.fixed_chunks(df, 12, 0.25).collect()}
    wanted = {}
    for d in {r[0] for r in rows}:
        words = [(w, r[3], r[4], r[5]) for r in sorted(rows) if r[0] == d for w in r[2].split()]
        start = n = 0
        while start < len(words):
            own = words[start : start + 12]
            wanted[d, n] = (" ".join(w[0] for w in own), min(w[1] for w in own), max(w[1] for w in own), own[0][2], [(p, list(b)) for p, b in dict.fromkeys((w[1], tuple(w[3])) for w in own)])
            if start + 12 >= len(words):
                break
            start, n = start + 9, n + 1
    assert got == wanted


def test_headers_tables_titles(spark):
    rows = [("d", p, n, t, [10.0, y, 50.0, y + 8], 9.0, "text") for p in (1, 2, 3) for n, (t, y) in enumerate([(f"Kopf {p}", 20.0), (f"text {p} anders", 60.0 + 9 * p)], 2 * p)]
    b = spark.createDataFrame(rows, "document_id string, page int, block_no int, text string, bbox array<double>, font_size double, kind string")
    assert values(chunking.without_running_headers(b), "text") == [("text 1 anders",), ("text 2 anders",), ("text 3 anders",)]
    assert chunking.without_running_headers(b.filter("page = 1")).count() == 2
    assert values(chunking.without_running_headers(b, spark.createDataFrame([("d", 5)], "document_id string, page_count int")), "block_no") == [(k,) for k in range(2, 8)]  # 3 of 5 pages are no more than 0.6
    box = spark.createDataFrame([("d", 1, [9.0, 60.0, 60.0, 90.0])], "document_id string, page int, bbox array<double>")
    assert chunking.outside_tables(b, box).count() == 5
    t = spark.createDataFrame([([["a", "b"], ["1\n2"]],)], "r array<array<string>>").select(T.markdown_table(F.col("r")).alias("x")).first().x
    assert t == "| a | b |\n| --- | --- |\n| 1 / 2 |  |"
    t = spark.createDataFrame([([["a"], ["\n b ", "zu viel"], [None]],)], "r array<array<string>>").select(T.markdown_table(F.col("r")).alias("x")).first().x
    assert t == "| a |\n| --- |\n| b |\n|  |"
    assert one(spark, T.section_code(F.col("t")), t="1. Schraube lösen") is None
    assert one(spark, T.section_code(F.col("t")), t="§ 36 a Reifen") == "§36" and one(spark, T.section_code(F.col("t")), t="3.2 Ziel") == "3.2" and one(spark, T.section_code(F.col("t")), t="3.2Ziel") is None


def test_spans(spark):
    s = spark.createDataFrame([("d", 1, 0, 1, "lt", 9.0, 0), ("d", 1, 0, 0, "We", 12.0, 16), ("d", 1, 1, 0, "  ", 9.0, 0)], "document_id string, page int, block_no int, span_no int, text string, font_size double, flags int")
    assert values(chunking.span_blocks(s), "text", "font_size", "bold") == [("Welt", 12.0, True)]


def test_inserts_are_idempotent(spark):
    new = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b")], "k string, v string")
    first = ingest.new_rows(new.limit(0), new, ["k"])
    assert values(first, "k") == [("1",), ("2",)] and ingest.new_rows(first, new, ["k"]).count() == 0


def test_scope(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "id string, tenant_id string")
    assert values(TenantScope("a").rows(df), "id") == [("1",)] and TenantScope(None).rows(df).count() == 0
    with pytest.raises(NotFoundError):
        TenantScope("a").one(df, "2")
    with pytest.raises(Exception, match="another tenant"):
        TenantScope("a").checked(df).collect()


def test_kappa(spark):
    rows = [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15
    r = evaluation.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert (r.n, r.agreement, round(r.kappa, 6)) == (50, 0.7, 0.4)
    assert evaluation.kappa(spark.createDataFrame([("y", "y")] * 3, "a string, b string"), "a", "b").first().kappa == 1


def test_gold(spark):
    def match(section, page, path, first, last, same="d"):
        df = spark.createDataFrame([(section, page, path, first, last)], "s string, p int, path string, a int, b int")
        return df.select(evaluation.gold_match(F.lit("d"), F.col("s"), F.col("p"), F.lit(same), F.col("path"), F.col("a"), F.col("b")).alias("x")).first().x

    assert match("5", None, "3.5", 1, 1) and match("5", None, "§50", 1, 1) and match("3.5.1", None, "3.5", 1, 1)
    assert match(None, 4, None, 5, 6) and not match(None, 3, None, 5, 6) and match(None, None, None, 1, 1)
    assert not match("5", None, None, 1, 1) and not match(None, None, None, 1, 1, "e")


def test_layer1_and_f1(spark):
    df = spark.createDataFrame([("Die Kraft beträgt 3,5 N.", ["3.5 N", "4 N"]), ("x", [])], "a string, p array<string>")
    found, missing = evaluation.layer1(F.col("a"), F.col("p"))
    rows = df.select(found.alias("f"), missing.alias("m"), evaluation.accurate(missing, F.lit(0)).alias("ok"), evaluation.accurate(missing, F.lit(0), F.col("p")).alias("strict")).collect()
    assert [(r.f, r.m, r.ok, r.strict) for r in rows] == [(["3.5 N"], ["4 N"], False, False), ([], [], True, False)]


def test_judge(spark):
    raws = ['{"score": 2, "rationale": "gut"}', '{"score": 3, "rationale": "x"}', 'Antwort: {"score": 1, "rationale": "x"}', "", '{"score": 1}']
    df = spark.createDataFrame([(r,) for r in raws], "r string").select(evaluation.judge_parse(F.col("r")).alias("j"))
    assert [r.j.score for r in df.collect()] == [2, None, None, None, None]


def test_auc_and_gate(spark):
    random.seed(2)
    rows = [(random.random() < 0.4, random.choice([0.1, 0.2, 0.5, 0.9, None]), False, True) for _ in range(200)]
    q = spark.createDataFrame(rows, "should_abstain boolean, top_score double, abstained boolean, correct boolean")
    good, bad = [s for a, s, _, _ in rows if not a and s is not None], [s for a, s, _, _ in rows if a and s is not None]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert evaluation.separability(q).first().auc == pytest.approx(auc)
    assert evaluation.separability(q.limit(0)).first().auc is None
    swept = {r.threshold: r for r in evaluation.gate_sweep(q, [0.0, 0.2]).collect()}
    assert swept[0.0].calls_saved == sum(s is None for _, s, _, _ in rows) and swept[0.2].calls_saved == sum(s is None or s < 0.2 for _, s, _, _ in rows)


def test_bootstrap_draws_and_cuts_as_described(spark):
    """Against a plain statement of the rule: randrange for each place, the truncated and the rounded share of the last index."""
    for n, resamples, level in ((37, 2000, 0.95), (5, 300, 0.9), (1, 50, 0.5)):
        x = [((k * 7919) % 101) / 101 for k in range(n)]
        rng, means = random.Random(20), []
        for _ in range(resamples):
            means.append(sum(x[rng.randrange(n)] for _ in range(n)) / n)
        means.sort()
        tail = (1 - level) / 2
        assert P.bootstrap_interval(x, resamples, 20, level) == (pytest.approx(sum(x) / n), pytest.approx(means[int(tail * (resamples - 1))]), pytest.approx(means[round((1 - tail) * (resamples - 1))]))
    assert P.bootstrap_interval([]) is None and P.bootstrap_interval([1.0, 1.0])[1:] == (1.0, 1.0)
    with pytest.raises(ValueError):
        P.bootstrap_interval([1.0], level=1.0)
    v = spark.createDataFrame([("c", n, float(n % 3 == 0)) for n in range(30)] + [("leer", 1, None)], "k string, q int, v double")
    r, empty = evaluation.bootstrap(v, ["k"], "v", 500).orderBy("k").collect()
    assert (r.n, r["mean"]) == (30, pytest.approx(1 / 3)) and (r.low, r.high) == P.bootstrap_interval([float(n % 3 == 0) for n in range(30)], 500)[1:]
    assert (empty.n, empty["mean"], empty.low, empty.high) == (0, None, None, None)


def test_matrix(spark):
    rows = [(c, f"Q{n}", "ab"[n % 2], (n + k) % 3 > 0, None if n == 0 else n % 4 > k) for k, c in enumerate(("base", "other")) for n in range(12)]
    tables = metrics.matrix(spark.createDataFrame(rows, "config string, question_id string, category string, correct boolean, found boolean"), "config", "base", 200)
    overall = {r.config: r for r in tables["overall"].collect()}
    assert overall["base"].n_accuracy == 12 and overall["base"].n_recall == 11 and overall["base"].best_recall and not overall["other"].best_recall
    assert [r.config for r in tables["paired"].collect()] == ["other"] and tables["recall"].filter("config = 'base'").agg(F.sum("n")).first()[0] == 11
    page, text = metrics.matrix_html(tables, "config"), metrics.matrix_markdown(tables)
    assert page.count("<table>") == 4 and "<svg" in page and text.count("## ") == 4
    assert metrics.ramp(0) == metrics.LIGHT and metrics.ramp(2) == metrics.DARK and metrics.ink(metrics.LIGHT) == "#000000" and metrics.ink(metrics.DARK) == "#ffffff"


def test_checkpoint_and_rescore(spark):
    lines = spark.createDataFrame([(1, "Q001", None), (2, "Q001", "kaputt"), (3, "Q002", "kaputt"), (4, "Q002", None), (5, None, None)], "line_no int, question_id string, error string")
    assert values(evaluation.latest_lines(lines), "line_no") == [(4,)]
    runs = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", None)], "run_id string, answer string")
    scored = spark.createDataFrame([("1", "a", None), ("2", "B", None), ("3", "c", "x"), ("4", None, None)], "run_id string, answer string, judge_error string")
    assert values(evaluation.stale(runs, scored), "run_id") == [("2",), ("3",)]


def test_neighbours(spark):
    c = spark.createDataFrame([(f"{d}{o}", d, "s", o) for d in "ab" for o in range(4)], "id string, document_id string, strategy string, ordinal int")
    seeds = c.filter("id IN ('a1', 'a2')")
    assert values(operations.neighbours_outside(c, seeds), "id") == [("a0",), ("a3",)]
    assert values(operations.chunk_context(c, seeds, 2), "id", "before", "after") == [("a1", ["a0"], ["a2", "a3"]), ("a2", ["a0", "a1"], ["a3"])]


def test_rate_limit(spark):
    t = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    h = spark.createDataFrame([("a", 1, t(0)), ("a", 2, t(1)), ("a", 3, t(2)), ("a", 4, t(10)), ("a", 5, t(10.5)), ("b", 6, t(0))], "k string, seq int, ts timestamp")
    assert values(operations.rate_limited(h, ["k"], 2, 10.0), "seq", "allowed") == [(1, True), (2, True), (3, False), (4, True), (5, False), (6, True)]


def test_token_stream(spark):
    d = spark.createDataFrame([("r", 2, "b", None, "stop"), ("r", 1, "a", "m", None), ("r", 3, None, None, None)], "request_id string, seq int, text string, model string, finish_reason string")
    assert values(operations.assembled(d), "text", "model", "finish_reason") == [("ab", "m", "stop")]
    assert one(spark, T.is_truncated(F.col("t")), t="length") and not one(spark, T.is_truncated(F.col("t")), t="STOP") and not one(spark, T.is_truncated(F.col("t")), t=None)


def test_points_in_retrieved_and_neighbouring_chunks(spark):
    chunks = spark.createDataFrame([("a", "Es gilt 3,5 bar."), ("b", "Höchstens 20 mm."), ("c", None), ("z", "99 kg")], "id string, content string")
    near = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "seed_id string, id string")
    points = [("r1", "q", 0, "3.5 BAR"), ("r1", "q", 1, "20 mm"), ("r2", "q", 0, "20 mm"), ("r2", "q", 1, "99 kg"), ("r3", "q", 0, "99 kg"), ("r3", "q", 1, ""), ("r3", "q", 2, None)]
    points = spark.createDataFrame(points, "run_id string, question_id string, pos int, point string")
    retrieved = spark.createDataFrame([("r1", "q", "a"), ("r2", "q", "a"), ("r2", "q", "b"), ("r3", "q", "gone")], "run_id string, question_id string, chunk_id string")
    places = evaluation.located(points, retrieved, chunks, near)
    found = {(r.run_id, r.pos): r.place for r in places.collect()}
    assert found == {("r1", 0): "context", ("r1", 1): "neighbour", ("r2", 0): "context", ("r2", 1): "missing", ("r3", 0): "missing", ("r3", 1): "context", ("r3", 2): "missing"}
    assert {r.run_id: r.fixable for r in evaluation.fixable(places).collect()} == {"r1": True, "r2": False, "r3": False}


def three_tenants(spark):
    words = "die pumpe läuft warm und der motor treibt das ventil an sy1.2.3 regelt den druck im kessel".split()
    random.seed(9)
    rows = [(f"{t}{k}", t, f"d{t}", strategy, " ".join(random.choices(words, k=25))) for t in ("t1", "t2", "t3") for k, strategy in enumerate(["structural"] * 6 + ["fixed_500"] * 3)]
    c = spark.createDataFrame(rows, "id string, tenant_id string, document_id string, strategy string, content string").withColumns({"content_norm": T.normalize_codes(F.col("content")), "ordinal": F.lit(0), "page_from": F.lit(1), "page_to": F.lit(1), "section_path": F.lit(None).cast("string"), "heading": F.lit(None).cast("string"), "ocr": F.lit(False)})
    docs = spark.createDataFrame([(f"d{t}", f"{t}.pdf", "A") for t in ("t1", "t2", "t3")], "id string, filename string, version_label string")
    q = spark.createDataFrame([(f"q{t}", t, "Was regelt SY 1.2.3 am Ventil der Pumpe?") for t in ("t1", "t2", "t3", None)], "query_id string, tenant_id string, question string")
    return c, docs, q


@pytest.mark.parametrize("mode", ["vector", "fts", "hybrid"])
def test_search_keeps_to_tenant_strategy_and_model(spark, mode):
    c, docs, q = three_tenants(spark)
    found = retrieval.search(index.temporary(c, index.hashed(64)), c, docs, q, "structural", index.hashed(64), mode, k=20)
    strategy, hits = {r.id: r.strategy for r in c.collect()}, found.collect()
    assert {r.query_id for r in hits} == {"qt1", "qt2", "qt3"}  # none without a tenant
    assert all(r.chunk_id[:2] == r.query_id[1:] and strategy[r.chunk_id] == "structural" and r.filename == f"{r.chunk_id[:2]}.pdf" for r in hits)
    alone = retrieval.search(index.temporary(c.filter("tenant_id = 't2' AND strategy = 'structural'"), index.hashed(64)), c, docs, q.filter("tenant_id = 't2'"), "structural", index.hashed(64), mode, k=20)
    if mode != "fts":  # a code's rarest trigrams are counted over all tenants, so only candidates could differ
        assert values(found.filter("query_id = 'qt2'"), "chunk_id", "rank") == values(alone, "chunk_id", "rank")
    if mode == "vector":
        other = retrieval.search(index.temporary(c, index.Embedder("other", 64, *[index.hashed(64).passage] * 2)), c, docs, q, "structural", index.hashed(64), mode)
        assert other.count() == 0
        with pytest.raises(ValueError):
            retrieval.search(index.temporary(c, index.hashed(64)), c, docs, q, "structural", index.hashed(64), mode, ef_search=0)


def test_stored_index_grows_by_what_is_missing(spark, tmp_path):
    c, docs, q = three_tenants(spark)
    index.update(c.filter("tenant_id <> 't3'"), str(tmp_path), index.hashed(64))
    for _ in range(2):
        index.update(c, str(tmp_path), index.hashed(64))
        stored, fresh = index.load(spark, str(tmp_path)), index.temporary(c, index.hashed(64))
        assert stored.vectors.count() == c.count()
        assert values(stored.postings, "stem", "chunk_id", "places") == values(fresh.postings, "stem", "chunk_id", "places")
        assert values(stored.trigrams, "trigram", "chunk_id") == values(fresh.trigrams, "trigram", "chunk_id")


def test_answers_within_tenants(spark):
    c, docs, q = three_tenants(spark)
    docs = docs.withColumn("version_label", F.when(F.col("id") == "dt1", "A").otherwise("B"))
    out = retrieval.answer(index.temporary(c, index.hashed(64)), c, docs, q, "structural", index.hashed(64), prices=(1.0, 2.0)).collect()
    by = {r.query_id: r for r in out}
    assert len(by) == 3 + 1 and by["qt1"].cost_usd > 0 and not by["qt1"].abstained and not by["qt1"].truncated and by["qt1"].conflict is None
    none = next(r for r in out if r.chunk_id is None)
    assert none.abstained and none.answer == T.SENTINEL and none.n_sources is None
