"""Personal information: sentences written apart from the labelled table's frames, held-out frames, forms, odd inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundstelle.llm import crf, labelled, personal
from fundstelle.llm.identity import card_check, iban_check, insurance_check, tax_check
from tests.llm.sentences import SENTENCES, UNSEEN

_KIND = {"n": "name", "a": "address", "p": "phone", "e": "email", "i": "id_number"}


def parsed(sentences=SENTENCES):
    """(text, [(start, end, kind)]) of each sentence; numbers are made with right check digits. Titles before the bar aren't part of a name."""
    make, out = labelled._Maker([], [], random.Random(99)), []
    for line in sentences.strip().split("\n"):
        line, *named = line.replace("\\n", "\n").split("|{n:") if "|{n:" in line and line.endswith("}") and not line.startswith("{") else [line.replace("\\n", "\n")]
        text, marks, at = "", [], 0
        for m in re.finditer(r"\{([napei])(?::([^{}]*))?\}", line):
            text += line[at : m.start()]
            at, value = m.end(), m[2] if m[2] is not None else make.id()
            before, _, value = value.rpartition("|")
            text += before
            marks.append((len(text), len(text) + len(value), _KIND[m[1]]))
            text += value
        text += line[at:]
        for name in named:
            start = text.index(name[:-1])
            marks.append((start, start + len(name) - 1, "name"))
        out.append((text, marks))
    return out


@pytest.fixture(scope="module")
def scorer():
    return personal.Scorer(personal.trained(("Anna", "Otto", "Thea"), ("Feder", "Kornwinkel", "Tannhof")))


def counts(scorer, table):
    right, found, wanted = Counter(), Counter(), Counter()
    for (_, marks), got in zip(table, personal.decode(scorer, [t for t, _ in table]), strict=True):
        right.update(k for *_, k in set(marks) & set(got))
        found.update(k for *_, k in got)
        wanted.update(k for *_, k in marks)
    return right, found, wanted


def test_sentences_apart_from_the_frames(scorer):
    """With a list of six names, so nearly all names are known by form and context alone."""
    table = parsed()
    assert len(table) >= 200
    right, found, wanted = counts(scorer, table)
    for kind, recall, precision in (("name", 0.85, 0.9), ("address", 0.9, 0.9), ("phone", 0.9, 0.9), ("email", 0.9, 0.9), ("id_number", 0.9, 0.9)):
        assert right[kind] / wanted[kind] >= recall, (kind, right, wanted)
        assert right[kind] / found[kind] >= precision, (kind, right, found)


def test_sentences_not_seen_before(scorer):
    right, found, wanted = counts(scorer, parsed(UNSEEN))
    assert wanted["name"] >= 25 and right["name"] / wanted["name"] >= 0.75 and right["name"] / found["name"] >= 0.8, (right, found, wanted)
    assert all(right[k] / wanted[k] >= 0.8 for k in ("address", "phone", "email", "id_number")), (right, wanted)


def test_field_on_held_out_rows(scorer):
    right, found, wanted = counts(scorer, labelled.rows(["Anna", "Otto", "Milla"], ["Feder", "Bruchwinkel", "Kornhof"], 900, seed=77))
    assert right.total() / found.total() > 0.93 and right.total() / wanted.total() > 0.93


def test_frames_arent_the_corpus(spark):
    """No frame's literal text of 20 characters or more stands in the documents."""
    texts = "\n".join(r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text IS NOT NULL").select("text").collect())
    literal = {part.strip() for frame in labelled._templates(labelled.POSITIVE + labelled.NEGATIVE) for part in re.split(r"\{\w+\}\??|[()|]|\n", frame)}
    assert not [x for x in literal if len(x) >= 20 and x in texts and x not in ("Mit freundlichen Grüßen",)]


def test_long_text_is_decoded_whole(scorer):
    """A text of 50,000 tokens in one line: what stands at its middle is found as in a short one."""
    short = "Bitte wenden Sie sich an Frau Anna Kornwinkel, Tel. 030 23125-495."
    filler = "Die Pumpe läuft ruhig und kühl. " * 3500
    text = filler + short + " " + filler
    assert [text[a:b] for a, b, _ in personal.decode(scorer, [text])[0]] == ["Anna Kornwinkel", "030 23125-495"]


def test_lines_are_decoded_as_texts_are(scorer):
    """Cutting at line ends changes no best path: the same labels as by one pass over all tokens."""
    texts = [t for t, _ in labelled.rows(["Anna"], ["Feder"], 300, seed=5) if "\n" in t][:60]
    own = personal.Tokens(texts)
    scores, _ = scorer.of(own)
    new = np.flatnonzero(np.concatenate(([True], own.text[1:] != own.text[:-1])))
    whole = scorer.field.viterbi(scores, new, np.append(new[1:], len(scores)))
    marked = {(int(own.start[k]), personal.LABELS[whole[k]]) for k in np.flatnonzero(whole)}
    ends = own.hash == personal.Tokens(["\n"]).hash[0]
    begin = np.flatnonzero(np.isin(np.arange(len(scores)), new) | np.concatenate(([False], ends[:-1])))
    stop = np.append(begin[1:], len(scores))
    stop = stop - ends[stop - 1]
    first = ~np.isin(begin, new)
    cut = scorer.field.viterbi(scores, begin, stop, first, np.append(ends, False)[stop])
    assert marked == {(int(own.start[k]), personal.LABELS[cut[k]]) for k in np.flatnonzero(cut)} and marked


def test_tokens():
    texts = ["Ab12 c\n", "", "x y-́ é²_", "\n\n7"]
    own = personal.Tokens(texts)
    assert [(own.text[k], own.token(k)) for k in range(len(own.start))] == [
        (0, "Ab"), (0, "12"), (0, "c"), (0, "\n"), (2, "x"), (2, "y"), (2, "-"), (2, "́"), (2, "é²"), (2, "_"), (3, "\n"), (3, "\n"), (3, "7"),
    ]
    assert len(personal.Tokens([]).start) == 0 == len(personal.Tokens([""]).start)


def test_too_many_names(spark, monkeypatch):
    """No name is dropped silently."""
    monkeypatch.setattr(personal, "MOST_NAMES", 2)
    names = spark.createDataFrame([(n, "given") for n in ("Anna", "Ben", "Cem")], "name string, name_kind string")
    with pytest.raises(ValueError, match="more than 2 names"):
        personal._field(names)


_WHOLE = re.compile(
    rf"(?<![\w-])(?:{personal._BEFORE}+[A-ZÄÖÜ][\w-]+(?: [A-ZÄÖÜ][\w-]+)?|[A-ZÄÖÜ][\wß-]*{personal._ROAD}|[A-ZÄÖÜ][\wß-]*[- ]{personal._ROAD_WORD})\s{personal._HOUSE}|{personal._EN_STREET.pattern}"
)


def test_streets_as_one_pattern():
    """Looking back from the numbers finds what the whole pattern finds, less a preposition before a street called after a town."""
    long = "Straße der " * 9 + "Einheit"
    texts = ["Am ZOB 12", "Zum Café 3", "An der Allee C4 7", f"Treff: {long} 4 b, dann", "Am Alt- 5", "Am Platz 12 Baker Street", "12 Am Markt Street 5", "Ringweg\n7 Seestr. 8", "x-Hofweg 3", "Am Frankfurter Ring 8", "Karl-Marx-Allee 4", "Vorhang 3"]
    pick, words = random.Random(5), ["Am", "An der", "Zum", "Straße des", "Alten", "Markt", "ZOB", "C4", "Seestr.", "Ring", "Hofweg", "12", "7", "7a", "b", "12345", "Baker", "Street", "St", "O'5", "und", "-", ",", "(", "Große", "Alt-", "é"]
    texts += ["".join(pick.choice(words) + pick.choice([" ", " ", " ", " ", "\n", "\xa0", ""]) for _ in range(25)) for _ in range(20_000)]
    for t in texts:
        wanted = [(m.start() + (len(personal._LOOSE.match(t, m.start(), m.start() + len(re.match(r".*\s", m[0], re.DOTALL)[0]))[0]) if m[0][-1:].isalnum() and not m[0][0].isdigit() else 0), m.end()) for m in _WHOLE.finditer(t)]
        got = personal._streets(t)
        assert [b for _, b in got] == [b for _, b in wanted] and all(x == y or "er " in t[x:b] for (x, b), (y, _) in zip(wanted, got, strict=True)), t
    assert [personal._streets(t) != [] for t in texts[:4]] == [True] * 4
    assert [[t[a:b] for a, b in personal._streets(t)] for t in texts[9:12]] == [["Frankfurter Ring 8"], ["Karl-Marx-Allee 4"], []]


def test_check_digits():
    assert iban_check("DE89 3704 0044 0532 0130 00") and not iban_check("DE89 3704 0044 0532 0130 01") and not iban_check("DE89")
    assert tax_check("86095742719") and not tax_check("86095742718") and not tax_check("11111111111")
    assert insurance_check("15070649C103") and not insurance_check("15070649C104") and card_check("T220001293") and not card_check("T220001294")


def test_lists_of_names():
    known = personal.TokenFeatures({"Anna", "Paula"}, {"Feder", "Hof"})
    for text, names in {
        "Anna Feder, Otto Hof": ["Anna Feder", "Otto Hof"], "Feder, Anna, Otto Hof": ["Feder, Anna", "Otto Hof"], "Feder, Milla": ["Feder, Milla"], "van Hof, Anna": ["van Hof, Anna"], "Anna Feder, Hof, Paula": ["Anna Feder", "Hof, Paula"],
        "Quell, Hof, Paula": ["Quell", "Hof, Paula"], "Frau Quell, Dunker, Paula": ["Quell", "Dunker, Paula"], "Pohlmann, Stratmann": ["Pohlmann", "Stratmann"],
    }.items():
        at = text.index(names[0])
        assert [text[a:b] for a, b in personal.split_names(text, at, len(text), known)] == names


def test_field_learns_and_its_gradient_agrees_with_differences():
    own = crf.Crf(["O", "B-x", "I-x"], lambda t, o: [t], (2,))
    table = [(["a", "b", "a"], np.array([[0], [1], [0]]), ["O", "B-x", "I-x"]), (["b"], np.array([[0]]), ["B-x"])] * 3
    own.fit(table, rounds=30)
    score = lambda t, f: sum(own.type_scores(t[k])[2] + (own.type_scores(t[k - 1])[1] if k else own.type_scores("")[1]) for k in [0]) + own.flag_weights[0][f[0, 0]]
    assert score(["b"], np.array([[0]])).shape == (3,)
    scores = np.zeros((4, 3), np.float32)
    scores[0, 0] = scores[3, 1] = 5
    scores[1, 1] = scores[2, 2] = 5
    assert [own.labels[k] for k in own.viterbi(scores, np.array([0, 3]), np.array([3, 4]))] == ["O", "B-x", "I-x", "B-x"]
    types = {"": 0, "a": 1, "b": 2}
    padded = [np.array([[own.index[o].get(t, len(own.index[o]))] for t in types]) for o in range(5)]
    rng = np.random.default_rng(0)
    for w in [*own.weights, own.step, own.start]:
        w[...] = rng.normal(size=w.shape)
    for w in own.weights:
        w[-1] = 0
    data = [(np.array([1, 2, 1]), np.array([[0], [1], [0]]), np.array([0, 1, 2]))]

    def likelihood():
        t, f, y = data[0]
        row = np.array([0, 0, *t, 0, 0])
        e = np.array([sum(own.weights[o][padded[o][row[k + o]]].sum(axis=0) for o in range(5)) + own.flag_weights[0][f[k, 0]] for k in range(3)])
        paths = {}
        for a in range(3):
            for b in range(3):
                for c in range(3):
                    if own.may_start[a] and own.allowed[a, b] and own.allowed[b, c]:
                        paths[a, b, c] = own.start[a] + e[0, a] + own.step[a, b] + e[1, b] + own.step[b, c] + e[2, c]
        return paths[tuple(y)] - np.log(np.exp(np.array(list(paths.values()))).sum())

    grads = own._gradient(data, padded)
    for p, g in zip([*own.weights, *own.flag_weights, own.step, own.start], grads, strict=True):
        for at in np.ndindex(p.shape):
            if at[0] == len(p) - 1 and any(p is w for w in own.weights):
                continue
            p[at] += 1e-5
            up = likelihood()
            p[at] -= 2e-5
            down = likelihood()
            p[at] += 1e-5
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_redaction(spark):
    names = spark.createDataFrame([("Anna", "given"), ("Kornwinkel", "family"), (None, "given"), ("x", None)], "name string, name_kind string")
    text = "Auskunft gibt Frau Anna Kornwinkel, Tel. 030 23125-495.\nBitte die IBAN DE89 3704 0044 0532 0130 00 angeben.\nAlles Weitere an <a.korn (at) example.com> schicken."
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Die Feder (Typ Otto) ist gereinigt und bleibt im Lager."), (5, "wort " * 20_000), (1, text), (None, text)], "doc_id long, text string")
    d = d.withColumns({n: F.lit("x") for n in ("ids", "kind", "value", "item_id", "part", "word", "n")})
    got = sorted(tuple(r) for r in personal.personal_information(d, names).select("doc_id", "kind", "value").collect())
    assert got == [(1, "email", "a.korn (at) example.com"), (1, "id_number", "DE89 3704 0044 0532 0130 00"), (1, "name", "Anna Kornwinkel"), (1, "phone", "030 23125-495")]
    out = personal.redacted(d, names)
    assert out.count() == 7 and out.filter("doc_id = 1").first().text == "Auskunft gibt Frau [NAME], Tel. [PHONE].\nBitte die IBAN [ID_NUMBER] angeben.\nAlles Weitere an <[EMAIL]> schicken."
    assert out.filter("doc_id = 2").first().text is None
    assert personal.personal_information(d.limit(0), names.limit(0)).count() == 0
