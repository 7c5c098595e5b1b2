"""The operators against brute force, exact round trips, held-out accuracy, and odd inputs."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fundstelle.llm import leaks, near_duplicates, percentiles, repeated_lines, scanned, splitting, token_ids
from fundstelle.llm import queries as Q

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\W_]+")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def chunk_table(spark, data):
    """(id, document_id, content, ocr), with extra columns whose names clash with those used inside."""
    df = spark.createDataFrame(data, "id string, document_id string, content string, ocr boolean")
    extra = {n: F.lit("x") for n in ("filename", "n", "word", "class", "key", "a", "b", "band", "letters", "fragment", "line_no", "chunk_id", "kind", "share", "text", "rank")}
    return df.withColumns({"section_path": F.lit(None).cast("string"), "heading": F.lit(None).cast("string"), **extra})


def document_table(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string")
    return df.withColumns({n: F.lit("x") for n in ("ids", "kind", "value", "item_id", "part", "word", "n")})


def sources(spark, data):
    return spark.createDataFrame(data, "id string, filename string").withColumns({"status": F.lit("ready"), "created_at": F.lit(None).cast("timestamp"), "n_chunks": F.lit(1), "document_id": F.lit("x")})


ODD = [("e", "d", "", True), ("n", "d", None, True), ("b", "d", " \n\t\n", True), (None, "d", "x y", True), ("o", None, "x y", None), ("l", "d", "wort " * 30_000, True), ("r", "d", "a\r\nb\x00😀", False), ("r", "d", "a\r\nb\x00😀", False)]
ODD = [tuple(v.encode("utf-16", "surrogatepass").decode("utf-16") if isinstance(v, str) else v for v in r) for r in ODD]


# --- p1 ---


def test_repeated_lines_at_the_limits(spark):
    data = [(f"c{k}", "d", f"Eigener Text {'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'abcde'[k // 26]}\nSeite {k} drucken!\n{'Nur zwanzig Mal' if k < 20 else 'x' * k}\n{'neunzehn' if k < 19 else ''}", False) for k in range(130)]
    c = chunk_table(spark, [*data, data[0], *ODD, ("z", "other", "Seite 1 drucken", False)])
    s = sources(spark, [("d", "f.html"), ("d", "f.html"), ("other", "g.html"), ("null", None)])
    found = rows(repeated_lines.repeated_lines(c, s), "chunk_id", "line_no")
    assert found == sorted(((f"c{k}", 1) for k in range(130)), key=repr)  # 20 of 135 chunks are 14.8 %, of 130 15.4 %
    fewer = rows(repeated_lines.repeated_lines(chunk_table(spark, [*data, data[0]]), s), "chunk_id", "line_no")
    assert [x for x in fewer if x[1] != 1] == sorted(((f"c{k}", 2) for k in range(20)), key=repr) and len(fewer) == 150
    cleaned = dict(rows(repeated_lines.without_lines(c, repeated_lines.repeated_lines(c, s)), "chunk_id", "content"))
    assert cleaned["c25"].count("\n") == 2 and "drucken" not in cleaned["c25"] and cleaned["n"] is None and cleaned["e"] == ""
    assert repeated_lines.repeated_lines(c.limit(0), s).count() == 0 and repeated_lines.repeated_lines(c, s.limit(0)).count() == 0


def test_repeated_lines_against_counting(spark):
    c = pq.read_table(f"{SMALL}/chunks.parquet").to_pandas().drop_duplicates("id")
    name = pq.read_table(f"{SMALL}/source_documents.parquet").to_pandas().drop_duplicates("id").set_index("id").filename
    count, total, lines = defaultdict(set), defaultdict(set), []
    for key, doc, text in zip(c.id, c.document_id, c.content, strict=True):
        if doc not in name:
            continue
        total[name[doc]].add(key)
        for no, line in enumerate(text.split("\n")):
            letters = "".join(filter(str.isalpha, line.lower()))
            if letters:
                count[name[doc], letters].add(key)
                lines.append((key, no, name[doc], letters))
    wanted = sorted((k, n) for k, n, f, l in lines if len(count[f, l]) >= 20 and len(count[f, l]) >= 0.15 * len(total[f]))
    assert rows(Q.p1_found(spark, SMALL), "chunk_id", "line_no") == wanted and wanted


def test_fragments_cross_lines_and_own_ones_depend_on_the_line_alone():
    line = "Eine lange Zeile über Ölventile, Pumpen und Klappen (Stand 2024)"
    a, b, c = (repeated_lines.fragments([t]) for t in (line, f"davor\n12: {line.upper()}\ndanach", line.replace(" ", "\n")))
    assert a["no"].tolist() == [0] and b["no"].tolist() == [0, 1, 2] and a["whole"][0] == b["whole"][1]
    assert a["own"].tolist() == b["own"][b["ends"][0] : b["ends"][1]].tolist() and len(a["own"]) > 2 and set(a["own"]) <= set(a["frag"])
    assert set(a["frag"]) <= set(c["frag"])  # other line ends, same fragments
    assert set(b["own"]) <= set(b["frag"]) and b["own"][0] == b["whole"][0]  # a short line is a fragment by itself
    assert repeated_lines.fragments(["", "12 3", "\n"])["frag"].size == 0


def test_most_lines_have_own_fragments():
    """Of the lines to remove in the small table, those that are found by a fragment of their letters rather than as a whole."""
    texts = pq.read_table(f"{SMALL}/chunks.parquet").to_pandas().content.dropna().tolist()
    found = repeated_lines.fragments(texts)
    size = np.diff(np.concatenate(([0], found["ends"])))
    by_itself = (size == 1) & np.isin(found["own"][found["ends"] - 1], found["whole"]) & (found["own"][found["ends"] - 1] == found["whole"])
    assert by_itself.mean() < 0.35


# --- p2 ---


def test_percentiles_keep_their_bound(spark):
    random.seed(1)
    values = [random.choice([1, -1]) * random.lognormvariate(3, 4) for _ in range(5000)] + [0.0] * 100
    data = [(f"g{k % 3}", v) for k, v in enumerate(values)] + [("g0", None), ("g0", float("nan")), ("leer", None), (None, 5.0)]
    df = spark.createDataFrame(data, "g string, v double").withColumns({"metric": F.lit(1), "n": F.lit(2)})
    parts = [percentiles.sketch(df.filter(on), ["g"], {"v": F.col("v")}) for on in ("coalesce(v, 0) > 3", "coalesce(v, 0) <= 3")]
    shares = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    got = {r.g: r for r in percentiles.percentiles(percentiles.merge(parts, ["g"]), ["g"], shares).collect()}
    for g in ("g0", "g1", "g2"):
        own = sorted(v for k, v in data if k == g and v is not None and v == v)
        assert got[g].n_values == len(own)
        for name, share in shares.items():
            exact = own[int(share * (len(own) - 1))]
            assert abs(got[g][name] - exact) <= 0.010001 * abs(exact)
    assert got["leer"].n_values == 0 and got["leer"].p50 is None and got["g0"].n_null == 2 and got[None].p50 == pytest.approx(5, rel=0.01)
    assert percentiles.percentiles(percentiles.sketch(df.limit(0), ["g"], {"v": F.col("v")}), ["g"], shares).count() == 0


def test_log_rows(spark):
    import datetime

    t = datetime.datetime(2026, 1, 5, 23, 59)
    data = [("1", "a", "c", {"total_ms": 5, "retrieval_ms": -1}, t)] * 2 + [(None, "a", "c", {"total_ms": 7}, t)] * 2 + [("2", None, None, None, None), ("3", "a", "c", {}, t)]
    logs = spark.createDataFrame(data, "id string, tenant_id string, config_hash string, latency_ms map<string,int>, created_at timestamp").withColumn("day", F.lit("x"))
    got = rows(percentiles.log_rows(logs), "tenant_id", "total_ms", "retrieval_ms")
    assert got == sorted([("a", 5, None), ("a", 7, None), ("a", 7, None), (None, None, None), ("a", None, None)], key=repr)


def test_sketches_of_different_accuracies_are_refused(spark):
    df = spark.createDataFrame([("g", 5.0)], "g string, v double")
    fine, coarse = (percentiles.sketch(df, ["g"], {"v": F.col("v")}, a) for a in (0.01, 0.05))
    assert percentiles.accuracy_of(percentiles.merge([fine, fine], ["g"])) == 0.01
    for wrong in (lambda: percentiles.merge([fine, coarse], ["g"]), lambda: percentiles.percentiles(coarse, ["g"], {"p": 0.5}, 0.01)):
        with pytest.raises(ValueError):
            wrong()


def test_day_sketches_combine(spark):
    whole = rows(Q.QUERIES["p2_by_day"](spark, SMALL), "day", "metric", "p50", "p95", "p99")
    direct = rows(percentiles.percentiles(percentiles.log_sketch(spark.read.parquet(f"{SMALL}/query_logs.parquet"), ["day"]), ["day"], percentiles.SHARES), "day", "metric", "p50", "p95", "p99")
    assert whole == direct


# --- p3 ---


def level_of(text, limit):
    if len(text.split()) <= limit:
        return None
    lines = text.split("\n")
    paragraphs, now = [], []
    for line in [*lines, ""]:
        if line.strip():
            now.append(line)
        elif now:
            paragraphs.append(now)
            now = []
    if max(sum(len(x.split()) for x in p) for p in paragraphs) <= limit:
        return "paragraph"
    if max(len(x.split()) for x in lines) <= limit:
        return "line"
    return "sentence" if all(len(u.split()) <= limit for x in lines for u in re.split(r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])", x)) else "word"


def test_levels_against_plain_cutting(spark):
    texts = dict(zip(*(pq.read_table(f"{SMALL}/chunks.parquet")[c].to_pylist() for c in ("id", "content")), strict=True))
    wanted = sorted((k, level) for k, t in texts.items() if t and (level := level_of(t, 800)))
    assert rows(Q.p3_found(spark, SMALL), "chunk_id", "cut_at") == wanted and len({x for _, x in wanted}) > 1


@pytest.mark.parametrize(("limit", "overlap"), [(800, 80), (100, 0), (50, 49), (7, 3)])
def test_pieces_cover_the_text(spark, limit, overlap):
    c = spark.read.parquet(f"{SMALL}/chunks.parquet")
    texts = {r.id: r.content for r in c.select("id", "content").collect() if r.content}
    by = defaultdict(list)
    for r in splitting.split_oversized(c, limit, overlap).collect():
        by[r.chunk_id].append(r)
    assert set(by) == {k for k, t in texts.items() if len(t.split()) > limit}
    for key, pieces in by.items():
        words, end = texts[key].split(), 0
        for p in sorted(pieces, key=lambda p: p.piece_no):
            own = p.content.split()
            assert len(own) == p.n_tokens <= limit and words[p.start_token : p.start_token + p.n_tokens] == own
            assert p.start_token + p.overlap_tokens == end and p.overlap_tokens == (min(overlap, end) if p.piece_no else 0)
            end = p.start_token + p.n_tokens
        assert end == len(words)


def test_split_odd_rows(spark):
    out = splitting.split_oversized(chunk_table(spark, ODD))
    assert {r.chunk_id for r in out.collect()} == {"l"} and out.filter("cut_at <> 'word'").count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(chunk_table(spark, ODD), 10, 10)


def test_cuts_prefer_strong_boundaries():
    level = np.full(150, 3)
    level[0] = 0
    level[70], level[74] = 1, 0
    assert splitting.cuts(level, 100, 0) == [74]
    assert splitting.cuts(np.full(100, 3), 100, 10) == []


# --- p4 ---


def test_similar_pairs_against_all_pairs(spark):
    c = pq.read_table(f"{SMALL}/chunks.parquet").to_pandas().drop_duplicates("id")
    sets = {}
    for key, text in zip(c.id, c.content, strict=True):
        w = WORD.findall(text.lower())
        if len(w) >= 40:
            sets[key] = set(zip(w, w[1:], w[2:], strict=False))
    keys = sorted(sets)
    wanted = [(a, b) for k, a in enumerate(keys) for b in keys[k + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])]
    assert rows(Q.p4_found(spark, SMALL), "chunk_id_a", "chunk_id_b") == wanted and wanted


def texts_with_edits(n, edits, seed=3):
    random.seed(seed)
    vocabulary = [f"wort{k}" for k in range(3000)]
    out = []
    for k in range(n):
        base = random.choices(vocabulary, k=200)
        out.append((f"{k}a", " ".join(base)))
        for _ in range(edits):
            base[random.randrange(200)] = random.choice(vocabulary)
        out.append((f"{k}b", " ".join(base)))
    return out


def test_default_form_finds_small_edits(spark):
    df = spark.createDataFrame(texts_with_edits(150, 2), "id string, content string")
    pairs = rows(near_duplicates.similar_pairs(df, "id", "content"), "key_a", "key_b")
    assert set(pairs) == {(f"{k}a", f"{k}b") for k in range(150)}


def test_groups_and_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    chain = [("1", text), ("2", text.replace("w59", "x1")), ("3", text.replace("w59", "x1").replace("w0 ", "x2 ")), ("4", text), ("4", text)]
    c = chunk_table(spark, ODD + [(k, "d", t, False) for k, t in chain])
    form = {"shingle": 3, "similarity": 0.95, "least_words": 40}
    assert rows(near_duplicates.similar_pairs(c, "id", "content", **form), "key_a", "key_b") == [("1", "2"), ("1", "4"), ("2", "3"), ("2", "4")]
    got = {r.key: (r.group_id, r.n_texts) for r in near_duplicates.groups(c, "id", "content", **form).collect()}
    assert len({got[k][0] for k in "1234"}) == 1 and [got[k][1] for k in "1234"] == [3, 3, 3, 3] and got["e"][1] == 1 and set(got) == set("ebolr1234")
    assert near_duplicates.similar_pairs(c.limit(0), "id", "content").count() == 0 and near_duplicates.groups(c.limit(0), "id", "content").count() == 0


def parts_of(pairs, keys):
    label = {k: k for k in keys}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in pairs:
        label[max(top(a), top(b))] = min(top(a), top(b))
    return {k: top(k) for k in keys}


def test_groups_are_the_parts_of_all_pairs(spark):
    c = spark.read.parquet(f"{SMALL}/chunks.parquet")
    found = {r.chunk_id: r.group_id for r in Q.p4_groups(spark, SMALL).collect()}
    wanted = parts_of(rows(Q.p4_found(spark, SMALL), "chunk_id_a", "chunk_id_b"), {r.id for r in c.filter("id IS NOT NULL AND content IS NOT NULL").select("id").distinct().collect()})
    content = {r.id: r.content for r in c.select("id", "content").collect()}
    pairs = defaultdict(set)
    for k, g in found.items():
        pairs[g, wanted[k] if len(WORD.findall(content[k])) >= 40 else content[k]].add(k)
    assert len({g for g, _ in pairs}) == len({w for _, w in pairs}) == len(pairs) and all(g == min(members) for (g, _), members in pairs.items())


def test_many_variants_cost_few_tries(spark, monkeypatch):
    """Variants of one text, each with an edit of its own, and some that stand between two such groups."""
    pick = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    other = base[:60] + [f"v{k}" for k in range(60)]
    texts = [(f"a{k}", " ".join(base[:j] + [f"x{k}"] + base[j + 1 :])) for k in range(400) if (j := pick.randrange(120)) is not None]
    texts += [(f"b{k}", " ".join(other[:j] + [f"y{k}"] + other[j + 1 :])) for k in range(100) if (j := pick.randrange(120)) is not None]
    tried, real = [], near_duplicates._verified
    monkeypatch.setattr(near_duplicates, "_verified", lambda pairs, *rest: tried.append(pairs.count()) or real(pairs, *rest))
    df = spark.createDataFrame(texts, "k string, t string")
    found = {r.k: r.group_id for r in near_duplicates.groups(df, "k", "t", shingle=3, similarity=0.7).withColumnRenamed("key", "k").collect()}
    assert len({g for k, g in found.items() if k[0] == "a"}) == 1 == len({g for k, g in found.items() if k[0] == "b"}) and len(set(found.values())) == 2
    assert sum(tried) < 30 * len(texts), tried  # of some 125,000 pairs


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = e[:2400], e[800:3200]
    s = near_duplicates.sketch([a, b, e[:3200], e[:1], e[:3]])
    assert (near_duplicates.merge(s[0], s[1]) == s[2]).all()
    x, y = s[0][:128], s[1][:128]
    got = near_duplicates.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([2400.0]), np.array([2400.0]))[0]
    assert abs(got - 0.5) < 0.15 and (s[3] > 0).all()


def test_a_register_is_the_least_of_all_elements():
    """Stopping early changes nothing: a set's sketch is the merged sketch of its elements."""
    e = np.random.default_rng(2).integers(0, 2**63, 700).astype(np.uint64)
    alone = near_duplicates.sketch([e[k : k + 1] for k in range(700)])
    assert (near_duplicates.sketch([e])[0] == alone.max(axis=0)).all()


# --- p5 ---

PAGES = [
    "Lastenheft Pumpe   {n}\nDie Prüfung der Hydraulik-\nleitung erfolgt im Still¬\nstand. Der Otto-\nMotor läuft. Die Ein-\nund Ausgänge bleiben.\n- {n} -",
    "Werk Nord · Abnahme\nVor der Erpro-\n[{n}]\nLastenheft Pumpe   {n}\nbung ist die Leitung zu {w}.\nEin Wert von l4 bar gilt.",
]


def scan_table(spark):
    words = ["prüfen"] * 9 + ["priifen"]
    scans = [(f"s{k}", "scan", PAGES[k % 2].format(n=k + 10, w=words[k]), k % 3 > 0) for k in range(10)]
    clean = [(f"k{k}", "klar", "Die Hydraulikleitung ist im Stillstand zu prüfen, die Erprobung folgt.", False) for k in range(6)]
    return chunk_table(spark, scans + clean + [scans[0]] + [(i, "leer" if d else d, t, o) for i, d, t, o in ODD[:6]])


def test_scan_noise(spark):
    found = rows(scanned.scan_noise(scan_table(spark)), "chunk_id", "line_no", "kind")
    even = {(0, "header"), (1, "hyphen"), (2, "hyphen"), (6, "pageno")}
    odd = {(0, "header"), (1, "hyphen"), (2, "pageno"), (3, "header"), (5, "glyph")}
    for k in range(10):
        own = {x[1:] for x in found if x[0] == f"s{k}"}
        assert own == (odd | ({(4, "glyph")} if k == 9 else set()) if k % 2 else even), k
    assert not [x for x in found if x[0].startswith("k")]
    assert scanned.scan_noise(scan_table(spark).limit(0)).count() == 0


def test_all_frequent_forms_explain(spark):
    """The printed form is the least frequent of many forms of its skeleton."""
    common = ["Dein", "dEin", "deIn", "deiN", "DEin", "DeIn", "DeiN", "dEIn", "dEiN", "DEIN"]
    clean = [(f"k{k}", "klar", " ".join([*common, *common, "dein"]), False) for k in range(4)]
    found = scanned.scan_noise(chunk_table(spark, [("s", "scan", "Es ist dcin Wort.", True), *clean]))
    assert rows(found, "chunk_id", "line_no", "kind") == [("s", 0, "glyph")]


def test_headers_with_a_number_after_one_blank(spark):
    """A number of its own on each page doesn't tell headers apart; a digit within a word is a letter."""
    scans = [(f"s{k}", "scan", f"Handbuch X Seite {n}\nDie Leitung ist zu pr\u00fcfen.\nEs folgt Text.", True) for k, n in enumerate(("15", "16", "18", "2O", "l1"))]
    found = scanned.scan_noise(chunk_table(spark, scans)).filter("kind = 'header'")
    assert rows(found, "chunk_id", "line_no") == [(f"s{k}", 0) for k in range(5)]
    assert scanned.header_key("Werk geh6ren 15") == scanned.header_key("Werk gehören 16") != scanned.header_key("Werk Nord 16")


def test_paragraphs(spark):
    text = {r.chunk_id: r.text for r in scanned.paragraphs(scan_table(spark)).filter("paragraph_no = 0").collect()}
    assert text["s0"] == "Die Prüfung der Hydraulikleitung erfolgt im Stillstand. Der Otto-Motor läuft. Die Ein- und Ausgänge bleiben."
    assert text["s9"] == "Vor der Erprobung ist die Leitung zu prüfen. Ein Wert von 14 bar gilt."


def test_scan_rules():
    assert scanned.misread_places("prüfen", "priifen") == [2] and scanned.misread_places("Temperatur", "Ternperatnr") == [2, 9]
    assert scanned.misread_places("haus", "maus") is None and scanned.misread_places("haus", "haus") == []
    for s in ("[30]", "- 29 -", "S. 27", "23", "viii", "Seite 3 von 10", "[3O]", "- l9 -"):
        assert scanned.is_page_number(s), s
    for s in ("", "ms.", "14,2 mm", "Halt", "HN 200-3", "an."):
        assert not scanned.is_page_number(s), s
    assert scanned.skeleton("Wenk Nord") == scanned.skeleton("Werk Nord") and scanned.skeleton("geh6ren") == scanned.skeleton("gehören")


# --- p6 ---


def test_ids_round_trip(spark):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(f"{token_ids.FOLDER}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in Q.p6_ids(spark, SMALL).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    assert set(got) == set(texts)
    for key, text in texts.items():
        assert got[key] == (public.encode(text, add_special_tokens=False).ids if text else [])
        assert public.decode(got[key], skip_special_tokens=False) == (text or "")


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_ids_of_odd_texts(name):
    import base64

    import tiktoken

    lines = open(f"{token_ids.FOLDER}/{name}.tiktoken", "rb")
    own = tiktoken.Encoding("own", pat_str=token_ids.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
    e = token_ids.encoder(name)
    random.seed(4)
    odd = ["", " ", "\n\n \t", "<|endoftext|>", "a" * 3000, "🙂é́漢", "\x00\x07", "don't I'LL"]
    for text in odd + ["".join(random.choices("aabcdeé漢🙂 _-.,\n\t0123'sABZ", k=random.randint(1, 60))) for _ in range(1500)]:
        assert e.encode(text) == own.encode_ordinary(text), text


def test_ids_of_null_rows(spark):
    d = document_table(spark, [(1, None), (2, ""), (None, "x"), (3, "x"), (3, "x")])
    assert rows(token_ids.token_ids(d), "doc_id", "ids") == sorted([(1, []), (2, []), (None, [87]), (3, [87]), (3, [87])], key=repr)


# --- p7 ---


def test_leaks_against_all_runs(spark):
    docs, items = (pq.read_table(f"{SMALL}/{t}.parquet").to_pandas() for t in ("documents", "eval_questions"))
    runs = defaultdict(set)
    for r in items.itertuples():
        for text in (r.question, r.gold_passage):
            w = leaks.normal_words(text)
            for k in range(len(w) - 9):
                runs[tuple(w[k : k + 10])].add(r.id)
    wanted = set()
    for r in docs.itertuples():
        w = leaks.normal_words(r.text)
        for k in range(len(w) - 9):
            wanted |= {(r.doc_id, i) for i in runs.get(tuple(w[k : k + 10]), ())}
    assert set(rows(Q.p7_found(spark, SMALL), "doc_id", "item_id")) == wanted and wanted


@pytest.mark.parametrize(("small", "bits"), [(200_000, 1 << 26), (0, 1 << 26), (0, 64)])
def test_leaks_of_odd_rows(spark, monkeypatch, small, bits):
    """By a broadcast, by shuffles, and with a filter so full that it holds nothing back."""
    monkeypatch.setattr(leaks, "SMALL_ROWS", small)
    monkeypatch.setattr(leaks, "BITS", bits)
    base = [f"w{k}" for k in range(40)]
    items = spark.createDataFrame([(f"Q{k}", " ".join(base[k : k + 12]), None) for k in range(5)] + [("kurz", "w1 w2", ""), (None, " ".join(base), "x")], "id string, question string, gold_passage string").withColumn("text", F.lit(1))
    d = document_table(spark, [(1, "x " + " ".join(base[1:11]).upper() + " y"), (2, " ".join(base[1:10])), (3, None), (4, ""), (5, "ﬁ " * 5), (1, "x " + " ".join(base[1:11]).upper() + " y")])
    assert rows(leaks.leaked_runs(d, items, ["question", "gold_passage"]), "doc_id", "item_id", "n_runs", "first_word", "n_words") == [(1, "Q0", 1, 1, 10), (1, "Q1", 1, 1, 10)]
    assert leaks.leaked_items(d, items.limit(0), ["question"]).count() == 0 and leaks.leaked_items(d.limit(0), items, ["question"]).count() == 0


# --- p5: pages made from known clean text ---


def distance(a, b):
    """Least number of letters to insert, take out or replace."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_made_pages_come_out_as_their_clean_text(spark):
    """Letters that differ from the clean text, before and after, over pages with broken words, misreadings, headers and page numbers."""
    pick = random.Random(8)
    nouns = "Leitung Pumpe Prüfung Messung Klappe Führung Dichtung Halterung Temperatur Belastung Erprobung Wartung Sicherung Steuerung".split()
    rest = "wird nach jeder Schicht sorgfältig geprüft und danach wieder sicher verschlossen weil sonst Wasser in das Gehäuse eindringt".split()

    def sentence():
        return f"Die {pick.choice(nouns)} der {pick.choice(nouns)} {' '.join(pick.sample(rest, 9))} bis {pick.randint(11, 98)} bar anliegen."

    clean_pages, scans = [], []
    for page in range(40):
        text = " ".join(sentence() for _ in range(6)) + " Der Otto-Motor läuft."
        lines, line = [], ""
        for word in text.split():
            if word == "Otto-Motor":
                lines += [line + "Otto-"]
                line = "Motor "
            elif len(line) + len(word) > 60 and len(word) > 9 and word.isalpha():
                lines.append(line + word[:5] + "-")
                line = word[5:] + " "
            elif len(line) + len(word) > 60:
                lines.append(line.rstrip())
                line = word + " "
            else:
                line += word + " "
        lines.append(line.rstrip())
        read = []
        for line in lines:
            for a, b in (("prüf", "priif"), ("Temperatur", "Ternperatur"), ("Schicht", "5chicht"), ("11", "l1"), ("40", "4O")):
                if pick.random() < 0.3:
                    line = line.replace(a, b)
            read.append(line)
        scans.append((f"s{page}", "scan", "\n".join([f"Handbuch Pumpen   {page + 1}", *read, f"- {page + 1} -"]), True))
        clean_pages.append(text)
    clean = [(f"k{k}", "klar", " ".join(sentence() for _ in range(30)) + " Der Otto-Motor läuft.", False) for k in range(8)]
    got = {r.chunk_id: r.text for r in scanned.paragraphs(chunk_table(spark, scans + clean)).collect()}
    before = sum(distance(text, scan[2]) for text, scan in zip(clean_pages, scans, strict=True))
    after = sum(distance(text, got[scan[0]]) for text, scan in zip(clean_pages, scans, strict=True))
    total = sum(map(len, clean_pages))
    assert before / total > 0.05 and after / total < 0.002, (before, after, total)


def test_context_chooses_among_printed_forms(spark):
    """Two forms explain the word with one misreading each: neighbours decide, not the greater count."""
    clean = [(f"k{k}", "klar", "Der alte Tarf steht hier. " * 30 + "Die frohe Tauf beginnt bald. " * 9, False) for k in range(4)]
    scan = [("s", "scan", "Heute gilt: die frohe Tanf beginnt.\nWo der Tanf war, ist Wasser.", True)]
    parts = scanned._Parts(chunk_table(spark, scan + clean))
    assert {(r.printed, r.cost) for r in scanned.misread_words(parts).collect()} == {("Tarf", 1), ("Tauf", 1)}
    assert rows(scanned.misread_places_in_texts(parts), "line_no", "printed") == [(0, "Tauf"), (1, "Tarf")]
    assert scanned.paragraphs(chunk_table(spark, scan + clean)).first().text == "Heute gilt: die frohe Tauf beginnt. Wo der Tarf war, ist Wasser."
