"""Noise in text from scanned pages: broken words, misread characters, running headers and page numbers.

Only documents at least half of whose distinct chunks are marked as scanned are looked at. The steps are:

1. lines with nothing but a page number are found by their form;
2. digits and misreadings are masked in the other lines (a line's glyph skeleton), and what is left is counted per document and over the
   collection: a line that stands in several chunks is a running header or footer, near page breaks or with its own page number from two on;
3. among the remaining body lines, a line that ends inside a word is joined with the next body line;
4. words of the whole collection are grouped by glyph skeleton; a form that no unscanned text has is misread if a form of the same
   skeleton, reachable by known misreadings, is much more frequent. Of several such forms the one that unscanned texts have beside the
   same neighbours is taken. A number with letters in it is misread if no
   unscanned text has it, or if they have numbers (masked) beside its neighbours;
5. paragraphs are put together by windows over the lines (``paragraphs``).

All counts are taken by key with partial aggregation; texts are handled chunk by chunk, so no document or group is collected. Pairs of
neighbours are counted only where a scanned text asks for them, which a Bloom filter of fixed size tells.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundstelle.functions.arrow import ints, longs, map_batches, strings
from fundstelle.llm.bloom import filter_of, may_hold
from fundstelle.llm.text import WORD, WordHashes, mix64
from fundstelle.session import cut_lineage, small_side

#: Pairs of what was printed and what is read for it.
MISREADINGS = (
    ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("l", "1"), ("l", "I"), ("I", "l"), ("I", "1"), ("i", "l"), ("i", "1"), ("1", "l"),
    ("g", "q"), ("q", "g"), ("h", "b"), ("b", "h"), ("u", "ii"), ("ü", "ii"), ("u", "n"), ("n", "u"), ("r", "n"), ("n", "r"), ("o", "0"), ("O", "0"),
    ("m", "rn"), ("rn", "m"), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("Ä", "A"), ("Ö", "O"), ("Ü", "U"), ("S", "5"), ("s", "5"), ("G", "6"), ("ö", "6"), ("b", "6"),
    ("B", "8"), ("Z", "2"), ("z", "2"), ("g", "9"),
)
#: The share of a document's distinct chunks that are marked as scanned, from which on it counts as scanned.
SCANNED_SHARE = 0.5
#: A header stands in this many chunks of its document, or in FEWER if one stands at a page break; one with its own page
#: number in FEWER chunks of the collection.
HEADER_CHUNKS, FEWER = 3, 2
#: A misread word's printed form is this many times as frequent, and occurs at least LEAST times.
RATIO, LEAST = 4, 3
#: Bits of the filter of printed forms: 2 MB.
BITS = 1 << 24
#: Frequent forms of a skeleton in one block of the join with rare forms; a skeleton has as many blocks as it needs.
FORMS = 8

_SKELETON = str.maketrans("cf1iqbnrüöä058", "etllghuuuoaosh")
_NUMBER = r"(?:[0-9OoIl]{1,4}|[ivxl]{1,7})"
_PAGE_NUMBER = re.compile(rf"[\[(|]?\s*[-–—]?\s*(?:(?:S\.|Seite|Blatt|Page|p\.)\s*)?{_NUMBER}(?:\s*(?:von|of|/)\s*{_NUMBER})?\s*[-–—]?\s*[\])|]?", re.IGNORECASE)
_OWN_NUMBER = re.compile(rf"^{_NUMBER}\s{{2,}}|\s{{2,}}{_NUMBER}$")
#: Numbers that stand alone, digits read as letters included, and what stands after a word for page.
_ANY_NUMBER = re.compile(r"(?<![^\W_])[OoIl]*\d[\dOoIl]*(?![^\W_])|(?<=[Ss]eite )[OoIl]{1,4}$|(?<=[Bb]latt )[OoIl]{1,4}$|(?<=[Pp]age )[OoIl]{1,4}$")
_BREAKERS = "-­¬‐"
#: Words that follow a hyphen which stands for a part of a compound left out.
_AFTER_GAP = {"und", "oder", "bzw", "sowie", "bis"}


def skeleton(text: str) -> str:
    """Letters that are misread for each other become one; longer readings first."""
    text = text.lower().replace("rn", "m").replace("ii", "u")
    if "6" in text:
        text = ("g" + text[1:] if text[0] == "6" else text).replace("6", "o")
    return text.translate(_SKELETON)


_BY_PRINTED: dict[str, list[tuple[str, str]]] = {}
for _a, _b in MISREADINGS:
    _BY_PRINTED.setdefault(_a[0], []).append((_a, _b))


def misread_places(printed: str, read: str) -> list[int] | None:
    """Places in ``read`` that differ from ``printed`` by known misreadings, as few as possible; None if others are needed."""
    n, m = len(printed), len(read)
    round_, seen = [(0, 0, ())], {(0, 0)}
    while round_:  # places of equal number of misreadings, one more in each round
        following, k = [], 0
        while k < len(round_):
            i, j, places = round_[k]
            k += 1
            if i == n and j == m:
                return list(places)
            if i < n and j < m and printed[i] == read[j] and (i + 1, j + 1) not in seen:
                seen.add((i + 1, j + 1))
                round_.append((i + 1, j + 1, places))
            if i < n:
                following += [(i + len(a), j + len(b), (*places, j)) for a, b in _BY_PRINTED.get(printed[i], ()) if printed.startswith(a, i) and read.startswith(b, j)]
        round_ = []
        for i, j, places in following:
            if (i, j) not in seen:
                seen.add((i, j))
                round_.append((i, j, places))
    return None


def is_page_number(line: str) -> bool:
    return _PAGE_NUMBER.fullmatch(line.strip()) is not None


def header_key(line: str) -> str | None:
    """The letters of the skeleton without numbers; None for lines that end as sentences or broken words do."""
    line = line.strip()
    if not line or line[-1] in ".,;:!?" + _BREAKERS:
        return None
    key = "".join(filter(str.isalpha, skeleton(_ANY_NUMBER.sub("", _OWN_NUMBER.sub("", line)))))
    return key if len(key) >= 4 else None


def broken(line: str, following: str) -> bool:
    """Whether ``line`` ends inside a word that ``following`` continues."""
    line, following = line.rstrip(), following.lstrip()
    if len(line) < 2 or line[-1] not in _BREAKERS or not line[-2].isalpha():
        return False
    if line[-1] != "-" and following[:1].isalnum():
        return True
    word = WORD.match(following)
    if word is None or word[0].lower() in _AFTER_GAP:
        return False
    return following[0].islower() or (following[0] in "015689" and any(c.isalpha() for c in word[0]))


#: A number with the letters that are read for its digits; what stands for any number among neighbours.
_NUMBERLIKE, MASK = re.compile(r"[\dOoIl]*\d[\dOoIl]*"), "0"
_SINGLE = re.compile(r"(?<![^\W_])[lIO](?=[.,]\d)|(?<=\d[.,])[lIO]+(?![^\W_])")


def masked_words(line: str) -> list[tuple[str, bool]]:
    """(word, whether it is a number or part of one, misread digits included) in order."""
    single = {m.start() for m in _SINGLE.finditer(line)} if "." in line or "," in line else ()
    return [(m[0], _NUMBERLIKE.fullmatch(m[0]) is not None or m.start() in single) for m in WORD.finditer(line)]


def body_words(lines: list[str], furniture: set[int]) -> tuple[list[int], list[tuple[int, str, int, int, bool]]]:
    """Line numbers that end inside a word, and words as (line_no, word, letters on that line, the line of the rest, whether a number)."""
    body = [k for k, line in enumerate(lines) if k not in furniture and line.strip()]
    ends, found, carry = [], [], None
    for at, k in enumerate(body):
        own = masked_words(lines[k])
        if carry is not None and own:
            no, left = carry
            found.append((no, left + own[0][0], len(left), k, False))
            own = own[1:]
        carry = None
        if at + 1 < len(body) and broken(lines[k], lines[body[at + 1]]):
            ends.append(k)
            if own:
                carry = (k, own.pop()[0])
        found += [(k, w, len(w), k, number) for w, number in own]
    return ends, found


def neighbours(found: list[tuple[str, bool]]) -> list[tuple[str | None, str | None]]:
    """The words before and after each; numbers are masked, and parts of one number are one."""
    masked = [MASK if number else w for w, number in found]
    before, after, last = [], [None] * len(found), None
    for k, w in enumerate(masked):
        if k and w == MASK == masked[k - 1]:
            before.append(before[-1])
            continue
        before.append(last := masked[k - 1] if k else None)
    last = None
    for k in range(len(masked) - 1, -1, -1):
        if k + 1 < len(masked) and not masked[k] == MASK == masked[k + 1]:
            last = masked[k + 1]
        after[k] = last
    return list(zip(before, after, strict=True))


def _scanned(chunks: DataFrame) -> DataFrame:
    """document_id of scanned documents; a null mark counts as false."""
    each = chunks.filter("id IS NOT NULL AND document_id IS NOT NULL").groupBy("document_id", "id").agg(F.max(F.coalesce("ocr", F.lit(False)).cast("int")).alias("ocr"))
    return each.groupBy("document_id").agg(F.avg("ocr").alias("share")).filter(F.col("share") >= SCANNED_SHARE).select("document_id")


def _page_lines(base: DataFrame) -> DataFrame:
    """chunk_id, document_id, line_no, key (null for page numbers), at_break: it has its own page number or stands beside one or at an edge, numbered: it has its own."""

    def run(batch: pa.RecordBatch) -> dict | None:
        rows = []
        for key, doc, text in zip(*(batch[c].to_pylist() for c in ("id", "document_id", "content")), strict=True):
            at_break = True
            for no, line in enumerate(text.split("\n")):
                if not line.strip():
                    continue
                if is_page_number(line):
                    rows.append((key, doc, no, None, True, True))
                    at_break = True
                    continue
                masked = header_key(line)
                if masked is not None:
                    numbered = _OWN_NUMBER.search(line.strip()) is not None
                    rows.append((key, doc, no, masked, at_break or numbered, numbered))
                at_break = False
        if not rows:
            return None
        c = list(zip(*rows, strict=True))
        return {"chunk_id": strings(c[0]), "document_id": strings(c[1]), "line_no": ints(c[2]), "key": strings(c[3]), "at_break": pa.array(c[4], pa.bool_()), "numbered": pa.array(c[5], pa.bool_())}

    return map_batches(base, run, "chunk_id string, document_id string, line_no int, key string, at_break boolean, numbered boolean", by="content")


class _Parts:
    """The intermediate tables. Those that several plans read are written once; no plan shuffles the texts of unscanned documents."""

    def __init__(self, chunks: DataFrame):
        texts = chunks.filter("id IS NOT NULL AND content IS NOT NULL").select("id", "document_id", "content")
        raw = cut_lineage(texts.join(small_side(_scanned(chunks)), "document_id", "left_semi"))
        base = raw.dropDuplicates(["id"])
        lines = _page_lines(base)
        per_document = lines.filter("key IS NOT NULL").groupBy("document_id", "key").agg(F.count_distinct("chunk_id").alias("n"), F.max("at_break").alias("at_break"), F.max("numbered").alias("numbered"))
        everywhere = per_document.groupBy("key").agg(F.sum("n").alias("n_all"))
        several = (F.col("n") >= HEADER_CHUNKS) | (F.col("n") >= FEWER) & F.col("at_break") | (F.col("n_all") >= FEWER) & F.col("numbered")
        headers = per_document.join(everywhere, "key").filter(several).select("document_id", "key")
        self.furniture = cut_lineage(
            lines.filter("key IS NULL").select("chunk_id", "line_no", F.lit("pageno").alias("kind"))
            .unionByName(lines.join(headers, ["document_id", "key"], "left_semi").select("chunk_id", "line_no", F.lit("header").alias("kind")))
        )
        dropped = self.furniture.groupBy(F.col("chunk_id").alias("id")).agg(F.collect_list("line_no").alias("furniture"))
        self.with_furniture = cut_lineage(base.join(dropped, "id", "left"))
        self.texts, self.raw = texts, raw
        read = map_batches(self.with_furniture, _count_body, "word string, n long", by="content").groupBy("word").agg(F.sum("n").alias("n_read"))
        # Words of unscanned texts are all words less those of scanned ones, repeated rows included in both.
        every = map_batches(texts, _count_words, "word string, n long", by="content")
        inside = map_batches(raw, _count_words, "word string, n long", by="content").select("word", (-F.col("n")).alias("n"))
        clean = every.unionByName(inside).groupBy("word").agg(F.sum("n").alias("n_clean"))
        words = clean.join(read, "word", "full").select("word", F.coalesce("n_clean", F.lit(0)).alias("n_clean"), F.coalesce("n_read", F.lit(0)).alias("n_read"))
        self.words = cut_lineage(words.filter("n_clean > 0 OR n_read > 0"))
        self.misread = small_side(misread_words(self))
        self.body = cut_lineage(_body(self.with_furniture, self.misread))


def _hash_filter(words: DataFrame, column: str):
    """A Bloom filter of a column of words, sent to the workers."""
    known = WordHashes()

    def hashed(batch: pa.RecordBatch) -> dict:
        return {"h": longs(known.of(batch[column].to_pylist()).view(np.int64))}

    return words.sparkSession.sparkContext.broadcast(filter_of(map_batches(words.select(column).distinct(), hashed, "h long"), "h", BITS))


def _body(with_furniture: DataFrame, misread: DataFrame) -> DataFrame:
    """``chunk_id, line_no, kind, word, here, rest_line, before, after``: lines that end inside a word (hyphen), numbers with letters (digits), and words that
    may be misread forms (word; a filter tells, the join with the forms decides). All other words are left out here."""
    sent, known = _hash_filter(misread, "word"), WordHashes()

    def run(batch: pa.RecordBatch) -> dict | None:
        rows = []
        for key, text, furniture in zip(*(batch[c].to_pylist() for c in ("id", "content", "furniture")), strict=True):
            ends, found = body_words(text.split("\n"), set(furniture or ()))
            rows += [(key, k, "hyphen", None, 0, k, None, None) for k in ends]
            held = may_hold(sent.value, known.of([f[1] for f in found]))
            wanted = [n for n, (_, w, _, _, number) in enumerate(found) if (not w.isdigit() if number else held[n] and len(w) > 1)]
            if wanted:
                beside = neighbours([(w, number) for _, w, _, _, number in found])
                for n in wanted:
                    k, w, here, rest, number = found[n]
                    rows.append((key, k, "digits" if number else "word", w, here, rest, *beside[n]))
        if not rows:
            return None
        c = list(zip(*rows, strict=True))
        return {"chunk_id": strings(c[0]), "line_no": ints(c[1]), "kind": strings(c[2]), "word": strings(c[3]), "here": ints(c[4]), "rest_line": ints(c[5]), "before": strings(c[6]), "after": strings(c[7])}

    schema = "chunk_id string, line_no int, kind string, word string, here int, rest_line int, before string, after string"
    return map_batches(with_furniture, run, schema, by="content")


def _count_body(batch: pa.RecordBatch) -> dict:
    n: Counter = Counter()
    for text, furniture in zip(batch["content"].to_pylist(), batch["furniture"].to_pylist(), strict=True):
        n.update(w for _, w, _, _, number in body_words(text.split("\n"), set(furniture or ()))[1] if len(w) > 1 and not number)
    return {"word": strings(n.keys()), "n": longs(n.values())}


def _count_words(batch: pa.RecordBatch) -> dict:
    n: Counter = Counter()
    for text in batch["content"].to_pylist():
        n.update(WORD.findall(text))
    return {"word": strings(n.keys()), "n": longs(n.values())}


def _with_skeleton(words: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        return {"word": batch["word"], "n_clean": batch["n_clean"], "n_read": batch["n_read"], "skeleton": strings(map(skeleton, batch["word"].to_pylist()))}

    return map_batches(words.filter("NOT word RLIKE '^[0-9]+$'").select("word", "n_clean", "n_read"), run, "word string, n_clean long, n_read long, skeleton string")


def misread_words(parts: _Parts) -> DataFrame:
    """``word, printed, places, cost, n_form``: misread forms, each form that may have been printed, the places that differ and how many."""
    formed = _with_skeleton(parts.words)
    rare = formed.filter("n_clean = 0 AND n_read > 0 AND length(word) > 1 AND word RLIKE '[a-zA-ZäöüÄÖÜß]'")
    n = F.col("n_clean") + F.col("n_read")
    # Every frequent form is compared; a skeleton of many forms is split into blocks, so that no key of the join gets all its pairs.
    rank = F.row_number().over(Window.partitionBy("skeleton").orderBy(n.desc(), "word"))
    frequent = formed.filter(n >= LEAST).select("skeleton", F.col("word").alias("form"), n.alias("n_form"), F.floor((rank - 1) / FORMS).cast("int").alias("block"))
    blocks = frequent.groupBy("skeleton").agg(F.max("block").alias("last"))
    each = rare.join(blocks, "skeleton").select("skeleton", "word", "n_read", F.explode(F.sequence(F.lit(0), "last")).alias("block"))
    pairs = each.join(frequent, ["skeleton", "block"]).filter((F.col("form") != F.col("word")) & (F.col("n_form") >= RATIO * F.col("n_read")))

    def explained(batch: pa.RecordBatch) -> dict | None:
        rows = []
        for word, form, count in zip(*(batch[c].to_pylist() for c in ("word", "form", "n_form")), strict=True):
            if places := misread_places(form, word):
                rows.append((word, form, places, len(places), count))
        if not rows:
            return None
        c = list(zip(*rows, strict=True))
        return {"word": strings(c[0]), "printed": strings(c[1]), "places": pa.array(c[2], pa.list_(pa.int32())), "cost": ints(c[3]), "n_form": longs(c[4])}

    return map_batches(pairs.select("word", "form", "n_form"), explained, "word string, printed string, places array<int>, cost int, n_form long")


def _pair_keys(form: np.ndarray, neighbour: np.ndarray, side: int) -> np.ndarray:
    """Hashes of forms with a neighbour before (side 1) or after (side 2) them."""
    return mix64(form ^ mix64(neighbour + np.uint64(side)))


def _clean_pairs(parts: _Parts, asked: DataFrame) -> DataFrame:
    """``printed, side, neighbour, n`` of ``asked(printed, side, neighbour)``: how often unscanned texts have the neighbour before (side b) or after (side a)
    the form. A filter of what is asked tells which of a text's neighbours are counted at all."""
    known = WordHashes()

    def hashed(batch: pa.RecordBatch) -> dict:
        form, beside = (known.of(batch[c].to_pylist()) for c in ("printed", "neighbour"))
        before = np.array([x == "b" for x in batch["side"].to_pylist()])
        return {"h": longs(np.where(before, _pair_keys(form, beside, 1), _pair_keys(form, beside, 2)).view(np.int64))}

    sent = parts.texts.sparkSession.sparkContext.broadcast(filter_of(map_batches(asked, hashed, "h long"), "h", BITS))

    def count(batch: pa.RecordBatch) -> dict:
        each = [WORD.findall(_NUMBER_RUN.sub(MASK, text)) for text in batch["content"].to_pylist()]
        found = [w for own in each for w in own]
        h, n = known.of(found), Counter()
        inner = np.ones(max(0, len(found) - 1), bool)
        ends = np.cumsum([len(own) for own in each])
        inner[[e - 1 for e in ends[:-1] if 0 < e < len(found)]] = False  # the last word of a text and the first of the next
        for side, name in ((1, "b"), (2, "a")):
            form, beside = (h[1:], h[:-1]) if side == 1 else (h[:-1], h[1:])
            for k in np.flatnonzero(inner & may_hold(sent.value, _pair_keys(form, beside, side))).tolist():
                n[(found[k + 1], name, found[k]) if side == 1 else (found[k], name, found[k + 1])] += 1
        c = list(zip(*n, strict=True)) if n else ((), (), ())
        return {"printed": strings(c[0]), "side": strings(c[1]), "neighbour": strings(c[2]), "n": longs(n.values())}

    schema = "printed string, side string, neighbour string, n long"
    every = map_batches(parts.texts, count, schema, by="content")
    inside = map_batches(parts.raw, count, schema, by="content").withColumn("n", -F.col("n"))
    counted = every.unionByName(inside).groupBy("printed", "side", "neighbour").agg(F.sum("n").alias("n")).filter("n > 0")
    return counted.join(asked, ["printed", "side", "neighbour"], "left_semi")


_NUMBER_RUN = re.compile(r"(?<![^\W_])\d+(?:[.,]\d+)*(?![^\W_])")


def misread_places_in_texts(parts: _Parts) -> DataFrame:
    """``chunk_id, line_no, rest_line, here, word, printed, places``: each misread word or number where it stands.

    Of several forms that may have been printed, those that unscanned texts have beside the same neighbours come first, then the least misread,
    then the most frequent. A number with letters that unscanned texts have too (or a letter alone) counts only if they have a number beside one of its neighbours.
    """
    of_digits = F.lit(MASK).alias("printed"), F.array().cast("array<int>").alias("places"), F.lit(0).alias("cost"), F.lit(0).cast("long").alias("n_form")
    at = ["chunk_id", "line_no", "rest_line", "here", "word", "kind", "before", "after"]
    body = parts.body.filter("kind <> 'hyphen'").select(*at)
    found = cut_lineage(body.filter("kind = 'word'").join(parts.misread, "word").select(*at, "printed", "places", "cost", "n_form").unionByName(body.filter("kind = 'digits'").select(*at, *of_digits)))
    asked = found.select("printed", F.explode(F.array(F.struct(F.lit("b").alias("side"), F.col("before").alias("neighbour")), F.struct(F.lit("a").alias("side"), F.col("after").alias("neighbour")))).alias("q"))
    asked = cut_lineage(asked.select("printed", "q.side", "q.neighbour").filter("neighbour IS NOT NULL").distinct())
    held = cut_lineage(_clean_pairs(parts, asked))
    support = [held.filter(F.col("side") == side).select("printed", F.col("neighbour").alias(name), F.col("n").alias(f"n_{name}")) for side, name in (("b", "before"), ("a", "after"))]
    both = found.join(small_side(support[0]), ["printed", "before"], "left").join(small_side(support[1]), ["printed", "after"], "left")
    sides = F.col("n_before").isNotNull().cast("int") + F.col("n_after").isNotNull().cast("int")
    printed = parts.words.filter("n_clean > 0").select("word", F.lit(True).alias("in_clean"))
    ranked = both.withColumn("sides", sides).join(printed, "word", "left").filter("kind = 'word' OR sides > 0 OR in_clean IS NULL AND word RLIKE '[0-9]'")
    best = F.max(F.struct("sides", (-F.col("cost")).alias("less"), "n_form", "printed", "places")).alias("m")
    return ranked.groupBy("chunk_id", "line_no", "rest_line", "here", "word", "kind", "before", "after").agg(best).select("chunk_id", "line_no", "rest_line", "here", "word", "kind", "m.printed", "m.places")


def scan_noise(chunks: DataFrame) -> DataFrame:
    """``chunk_id, line_no, kind``: noise of scanned documents, once per line and kind (hyphen, header, pageno, glyph).

    A repeated chunk id counts once. Null ids, documents and contents give no rows, and so do empty tables and tables without a
    scanned document. Lines are cut at LF and numbered from 0; CR counts as white space.
    """
    parts = _Parts(chunks)
    read = misread_places_in_texts(parts)
    at = F.explode(F.transform("places", lambda p: F.when(p < F.col("here"), F.col("line_no")).otherwise(F.col("rest_line"))))
    words = read.filter("kind = 'word'").select("chunk_id", at.alias("line_no"))
    glyph = words.unionByName(read.filter("kind = 'digits'").select("chunk_id", "line_no")).select("chunk_id", "line_no", F.lit("glyph").alias("kind"))
    return parts.furniture.unionByName(parts.body.filter("kind = 'hyphen'").select("chunk_id", "line_no", "kind")).unionByName(glyph).distinct()


#: What misread digits were printed as.
_DIGIT_OF = str.maketrans("OoIl", "0011")


def repaired(line: str, fixes: list[tuple[str, str]]) -> str:
    """The line with misread words replaced; a number's letters become the digits they were read for."""
    known = dict(fixes)
    return WORD.sub(lambda m: m[0].translate(_DIGIT_OF) if known.get(m[0]) == MASK else known.get(m[0], m[0]), line)


def joins(line: str, following: str) -> bool:
    """Whether a line ends with a hyphen of its own after which the word goes on, as in "Otto-" and "Motor"."""
    line, word = line.rstrip(), WORD.match(following.lstrip())
    return len(line) > 1 and line[-1] in "-‐" and line[-2].isalnum() and word is not None and word[0].lower() not in _AFTER_GAP


def paragraphs(chunks: DataFrame) -> DataFrame:
    """``chunk_id, paragraph_no, text``: the chunks of scanned documents as continuous paragraphs.

    Headers and page numbers are left out, misread words and digits replaced by what was printed, also in words broken over two lines;
    broken words are joined, and hyphens that belong to a word at a line's end are joined without a blank, but for those that stand for a part
    left out ("Ein- und"). A paragraph ends at an empty line after the end of a sentence. Windows run within a chunk.
    """
    parts = _Parts(chunks)
    out = parts.with_furniture.select(F.col("id").alias("chunk_id"), "furniture", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))
    lines = out.filter(~F.coalesce(F.array_contains("furniture", F.col("line_no")), F.lit(False))).select("chunk_id", "line_no", F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line"))
    in_chunk = Window.partitionBy("chunk_id").orderBy("line_no")
    body = lines.withColumn("before", F.last(F.when(F.col("line") != "", F.col("line")), ignorenulls=True).over(in_chunk.rowsBetween(Window.unboundedPreceding, -1)))
    body = body.withColumn("gap", F.max(F.when(F.col("line") == "", F.col("line_no"))).over(in_chunk.rowsBetween(-1, -1)).isNotNull())
    body = body.filter("line <> ''").withColumn("new", F.col("gap") & F.coalesce(F.col("before").rlike(r"[.!?:]$"), F.lit(True)))
    body = body.withColumn("paragraph_no", F.sum(F.col("new").cast("int")).over(in_chunk).cast("int"))
    broken_at = parts.body.filter("kind = 'hyphen'").select("chunk_id", "line_no", F.lit(True).alias("broken"))
    read = cut_lineage(misread_places_in_texts(parts))
    within = read.filter("line_no = rest_line").groupBy("chunk_id", "line_no").agg(F.collect_set(F.struct("word", "printed")).alias("fixes"))
    tails = read.filter("line_no < rest_line").select("chunk_id", "line_no", F.col("printed").alias("tail"))
    heads = read.filter("line_no < rest_line").select("chunk_id", F.col("rest_line").alias("line_no"), F.lit(True).alias("taken"))
    piece = body.withColumn("following", F.lead("line").over(in_chunk)).join(broken_at, ["chunk_id", "line_no"], "left")
    for more in (within, tails, heads):
        piece = piece.join(more, ["chunk_id", "line_no"], "left")

    def repair(batch: pa.RecordBatch) -> dict:
        done = []
        for line, following, cut, fixes, tail, taken in zip(*(batch[c].to_pylist() for c in ("line", "following", "broken", "fixes", "tail", "taken")), strict=True):
            if taken:  # its first word has gone to the line before
                first = WORD.search(line)
                line = line[first.end() :] if first else line
            if fixes:
                line = repaired(line, [(f["word"], f["printed"]) for f in fixes])
            if cut:
                line = line.rstrip()[:-1]
                if tail is not None and (m := list(WORD.finditer(line))):
                    line = line[: m[-1].start()] + tail
                done.append(line)
            else:
                done.append(line if joins(line, following or "") else line + " ")
        return {"chunk_id": batch["chunk_id"], "paragraph_no": batch["paragraph_no"], "line_no": batch["line_no"], "line": strings(done)}

    fixed = map_batches(piece.select("chunk_id", "paragraph_no", "line_no", "line", "following", "broken", "fixes", "tail", "taken"), repair, "chunk_id string, paragraph_no int, line_no int, line string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "")
    return fixed.groupBy("chunk_id", "paragraph_no").agg(F.rtrim(joined).alias("text"))
