"""Personal information in free text: found by a conditional random field and replaced by typed placeholders.

Tokens get features of their own form (shape, endings, name lists) and of up to two neighbours, the classes of the tokens before and after,
and flags that say whether they stand in something that has the form of an address of mail, a number of a telephone, a number with right
check digits, or a street with a house number. The field is trained on the labelled table (``labelled.rows``, at most ``labelled.ROWS`` rows)
when it is first needed and sent to the workers; it decides from form and context which tokens are personal. A marked place is completed to
the whole form it touches, or stands by itself where no form is known; numbers that identify someone must pass their own check digits.

Texts of a batch are cut into tokens together, in numpy; token types are scored once per worker. A line end is never within a place, so
the best paths of lines are those of texts, and texts of any length are decoded whole.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundstelle.functions.arrow import longs, map_batches, strings
from fundstelle.llm import labelled
from fundstelle.llm.crf import NEVER, OFFSETS, Crf
from fundstelle.llm.identity import card_check, iban_check, insurance_check, tax_check
from fundstelle.llm.text import mix64

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ["O"] + [f"{b}-{k}" for k in KINDS for b in "BI"]
#: Names of the list that are taken to the driver and sent at once; a longer list is refused, so none is dropped.
MOST_NAMES = 1_000_000

_DOT, _AT = r"(?:\.| ?[\[(] ?(?:punkt|dot) ?[\])] ?)", r"(?: ?@ ?| ?[\[({] ?(?:at|AT|ät) ?[\])}] ?)"
_EMAIL = re.compile(rf"(?<![\w.+%-])[\w+%-]+(?:{_DOT}[\w+%-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,}}(?![\w-])", re.IGNORECASE)
_PHONE = re.compile(r"(?<![\w.,+-])(?:\+\d{1,3}|00\d{1,3}|\(0\d{1,5}\)|0\d{1,5}|\(\d{3}\))(?:(?: - |[ /.–-])?(?:\(0\)|\(\d{1,5}\)|\d+))+(?![\w])")
_IDS = (
    (re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?(?!\w)"), iban_check),
    (re.compile(r"(?<![\w.,])\d{2} ?\d{3} ?\d{3} ?\d{3}(?!\w)"), tax_check),
    (re.compile(r"(?<![\w.,])\d{2} ?\d{6} ?[A-Z] ?\d{2} ?\d(?!\w)"), insurance_check),
    (re.compile(r"(?<!\w)[A-Z][A-Z0-9]{8}\d(?!\w)"), card_check),
)
_ROAD = r"(?:stra(?:ß|ss)e|str\.|gasse|weg|platz|allee|ring|damm|ufer|wall|graben|hof|steig|pfad|markt|chaussee|twiete|stieg|kamp|anger|blick|(?<!An)(?<!Vor)(?<!zusammen)(?<!Zusammen)(?<!ber)hang)"
_ROAD_WORD = r"(?:Stra(?:ß|ss)e|Str\.|Landstraße|Gasse|Weg|Platz|Allee|Ring|Damm|Ufer|Chaussee|Markt|Wall|Reihe|Steig|Kamp|Hof)"
_BEFORE = r"(?:(?:Am|An der|An den|Zum|Zur|Im|In der|In den|Hinter der|Hinter dem|Hinter den|Auf den|Beim|Bei der|Bei den|Vor dem|Vor der|Unter den|Auf der|Auf dem|Obere[rns]?|Untere[rns]?|Alte[rns]?|Neue[rns]?|Große[rns]?|Kleine[rns]?|Hohe[rns]?|Lange[rns]?|Straße de[rs]|Platz de[rs]|Allee de[rs]|Weg de[rs]) )"
_HOUSE = r"\d{1,4}(?: ?[a-z](?![\w]))?(?!\w)"
_STREET_NAME = re.compile(rf"(?<![\w-])(?:{_BEFORE}+[A-ZÄÖÜ][\w-]+(?: [A-ZÄÖÜ][\w-]+)?|[A-ZÄÖÜ][\wß-]*{_ROAD}|[A-ZÄÖÜ][\wß-]*[- ]{_ROAD_WORD})\s$")
#: A preposition that isn't part of the street's name.
_LOOSE = re.compile(rf"(?:(?:Am|Im|An der|In der|Zum|Zur|Auf der|Beim) (?=[A-ZÄÖÜ][\w-]+er {_ROAD_WORD} ?$))?")
_HOUSE_NUMBER = re.compile(_HOUSE)
_EN_ROAD = re.compile(r"\b(?:Road|Street|Lane|Avenue|Close|Drive|Way|Square|Court|Place|Gardens|Terrace|Row|Hill|Grove|Crescent|Mews|Walk|Park|Green|Boulevard|Parade|Rise|Quay|Rd|St|Ave)(?!\w)")
_EN_STREET = re.compile(rf"(?<!\w)\d{{1,4}}[a-z]? (?:[A-Z][\w'-]+ ){{1,3}}{_EN_ROAD.pattern}")
_AT_SIGN = re.compile(r"@|[\[({] ?(?:at|ät) ?[\])}]", re.IGNORECASE)


class _Numbers:
    """Where a text's numbers begin, and which of them can begin or end a form at all: found in numpy, tried one by one."""

    def __init__(self, text: str, points: np.ndarray | None = None, kinds: np.ndarray | None = None):
        if points is None:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            kinds = _character_kinds()[points]
        self.text, n = text, len(points)
        digit, word = kinds == 4, (kinds >= 3) | (points == 95)
        self.starts = np.flatnonzero(digit & ~np.concatenate(([False], digit[:-1])))
        upto = np.concatenate(([0], np.cumsum(digit)))
        self.many = upto[np.minimum(self.starts + 48, n)] - upto[self.starts] >= 7  # a form of seven digits has at most 48 characters
        p = self.starts
        at = lambda k: np.maximum(p - k, 0)
        space = (kinds == 0) | (kinds == 2)
        before = (p >= 2) & space[at(1)] & (word[at(2)] | np.isin(points[at(2)], (45, 46)))
        capital = np.concatenate(([0], np.cumsum(((points >= 65) & (points <= 90)) | np.isin(points, (196, 214, 220)))))
        last_space = np.maximum.accumulate(np.where(points == 32, np.arange(n), -1)) if n else np.zeros(0, np.int64)
        begin = last_space[at(2)] + 1
        self.houses = p[before & (capital[at(1)] > capital[begin])].tolist()
        after = np.minimum(p + 1, n - 1)
        self.english = p[~np.concatenate(([False], word))[p] & np.isin(np.where(digit[after], 32, points[after]), (32, *range(97, 123)))].tolist() if n else []
        ten = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
        ends = np.flatnonzero(word & ~np.concatenate((word[1:], [False]))) if n else ten
        held = (ends - ten == 9) & digit[ends] & (points[ten] >= 65) & (points[ten] <= 90)
        self.cards = ten[held].tolist()
        self.accounts = (p[(p >= 2) & (points[at(1)] >= 65) & (points[at(1)] <= 90) & (points[at(2)] >= 65) & (points[at(2)] <= 90)] - 2).tolist()
        self.long = p[self.many].tolist()


_LAST_ROAD = re.compile(rf"(?:{_ROAD}|[- ]{_ROAD_WORD})$")
_ANY_BEFORE = re.compile(r"(?<![\w-])(?:Am|An|Zum|Zur|Im|In|Hinter|Auf|Beim|Bei|Vor|Unter|Obere|Untere|Alte|Neue|Große|Kleine|Hohe|Lange|Straße|Platz|Allee|Weg)")


def _streets(text: str, numbers: _Numbers | None = None) -> list[tuple[int, int]]:
    """Streets with a house number, from left to right and without overlaps.

    German ones are looked for backwards from the numbers, of which a text has few: to the start of the line or the number before,
    as no word of a name begins with a digit. Its last word has a capital.
    """
    numbers = numbers or _Numbers(text)
    out, at, first, number = [], 0, 0, 0

    def next_english(begin: int) -> re.Match | None:
        nonlocal first
        while first < len(numbers.english):
            place = numbers.english[first]
            if place >= begin and (m := _EN_STREET.match(text, place)):
                return m
            first += 1
        return None

    english = next_english(0)
    for p in numbers.houses:
        m = _HOUSE_NUMBER.match(text, p)
        if m is None:
            continue
        end, line = p - 1, max(at, text.rfind("\n", at, p - 1) + 1)
        low, number = max(line, number), p  # no word of a name begins with a digit
        if not (_LAST_ROAD.search(text, low, end) or _ANY_BEFORE.search(text, low, end)):
            continue
        while before := _STREET_NAME.search(text, max(low, at), p):
            if english and english.start() < before.start():
                out.append(english.span())
                at = english.end()
            else:
                out.append((before.start() + len(_LOOSE.match(text, before.start(), p)[0]), m.end()))
                at = m.end()
            if english and english.start() < at:
                english = next_english(at)
    while english:
        out.append(english.span())
        english = next_english(english.end())
    return out


def _mails(text: str) -> list[tuple[int, int]]:
    """Addresses of mail, looked for in the lines with a sign for one."""
    out, at = [], 0
    for m in _AT_SIGN.finditer(text):
        if m.start() >= at:
            begin, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            at = len(text) if end < 0 else end
            out += [x.span() for x in _EMAIL.finditer(text, begin, at)]
    return out


def forms(text: str, numbers: _Numbers | None = None) -> dict[str, list[tuple[int, int]]]:
    """Spans that have a kind's form; numbers only with right check digits, telephones with 7 to 15 digits."""
    numbers = numbers or _Numbers(text)
    found = {"email": _mails(text), "address": _streets(text, numbers), "id_number": [], "phone": []}
    taken = np.zeros(len(text) + 1, bool)

    def take(a: int, b: int) -> None:
        found["id_number"].append((a, b))
        taken[a:b] = True

    for (pattern, right), places in zip(_IDS, (numbers.accounts, numbers.long, numbers.long, numbers.cards), strict=True):
        at = 0
        for p in places:
            if p < at or (m := pattern.match(text, p)) is None:
                continue
            at = m.end()
            if right(m[0]) and not taken[m.start() : m.end()].any():
                take(*m.span())
            elif pattern is _IDS[0][0]:  # a shorter account number may be followed by capitals or digits
                for end in range(m.end() - 1, m.start() + 14, -1):
                    if right(text[m.start() : end]) and not text[end : end + 1].isalnum():
                        take(m.start(), end)
                        break
    at = 0
    for p in numbers.long:
        m = _PHONE.match(text, p - 1) if p > at and text[p - 1] in "+(" else None
        if m := m or p >= at and _PHONE.match(text, p):
            at = m.end()
            if 7 <= sum(map(str.isdigit, m[0])) <= 15 and not taken[m.start() : m.end()].any():  # (part of) a number whose check digits are right
                found["phone"].append(m.span())
    return found


#: Flags: track 0 for mail, identity numbers and streets, track 1 for telephones; 0 is none, then begin and inside of each.
_TRACKS = {"email": (0, 1), "id_number": (0, 3), "address": (0, 5), "phone": (1, 1)}

#: Closed classes of words, and titles and salutations before names.
_CLOSED = {
    "article": "der die das dem den des ein eine einen einem einer eines dies diese dieser dieses diesem diesen jede jeder jedes jedem jeden kein keine keiner keinem unser unsere ihre ihr mein meine sein seine alle the a an this that these each every no our",
    "preposition": "von vom mit bei beim für an am zu zum zur in im aus auf nach vor über unter durch gegen ohne um laut gemäß wegen trotz während seit bis zwischen neben hinter gegenüber außer innerhalb außerhalb mittels anhand bezüglich of by to from with at for on under per via about after before",
    "joint": "und oder sowie bzw and or & wie",
    "title": "herr herrn frau dr prof professor professorin dipl ing mag kollege kollegin kollegen kolleginnen familie mr mrs ms miss sir dear",
    "small": "ist sind war wird werden hat haben hatte wurde muss müssen darf kann soll sei is are was were has have had be been will must may shall er sie es wir ich uns mich he she it we i nicht not dass that wenn sobald falls",
    "adverb": "als ob weil was wer wie bevor nachdem dann da doch noch schon nur auch aber denn hier dort heute gestern morgen jetzt so sehr ganz bitte danke hallo guten alle beide manche viele einige mehrere welche solche andere etwas nichts alles weitere weiterer nächste letzte erste man dazu damit darf wo wann warum since if when while what who why how there here now then please thanks hello also only but so very all both many some most more yesterday today",
}
_CLASS_OF = {w: k for k, (_, ws) in enumerate(_CLOSED.items()) for w in ws.split()}
_MARKS = {"\n": 0, ".": 1, ",": 2, "-": 3, ":": 4, ";": 5, "(": 6, ")": 7, "/": 8, "<": 9, "@": 10, '"': 11}
_N_CLOSED, _N_CLASSES = len(_CLOSED), len(_CLOSED) + len(_MARKS) + 9
#: Marks of a token type of the training table whose word isn't to be known, that isn't to be known as listed either, and of which only the shape is.
_UNKNOWN, _UNLISTED, _BARE = "\x00", "\x01", "\x02"
_HIDING = _UNKNOWN + _UNLISTED + _BARE


class TokenFeatures:
    """What is seen of a token. Of words with a mark the word itself isn't, nor with _UNLISTED whether it is listed."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family

    def __call__(self, token: str, offset: int) -> list[str]:
        mark, token = token[-1:] if token[-1:] in _HIDING else "", token.rstrip(_HIDING)
        known, listed = not mark, mark in ("", _UNKNOWN)
        low, near = token.lower(), abs(offset) < 2
        shape = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.islower() else c for c in token)
        shape = re.sub(r"(.)\1{2,}", r"\1\1", shape) if token.isalpha() or token.isdigit() else shape
        out = [f"s={shape[:4]}", "bias"]
        if token.isdigit():
            out.append(f"d={min(len(token), 6)}")
        elif known:
            out.append(f"w={low}")
        if token.isalpha() and near:
            title = token.title()
            out += [f"g={listed and title in self.given}", f"f={listed and title in self.family}", f"n={min(len(token), 6)}"]
            if mark == _BARE:
                return out
            out += [f"e{k}={low[-k:]}" for k in (2, 3, 4, 5) if len(low) > k]
            if offset == 0:
                out += [f"p{k}={low[:k]}" for k in (2, 3, 4) if len(low) > k]
        return out

    def kind(self, token: str) -> int:
        """The class of a token, from 1 on; 0 is before a text's begin and after its end."""
        listed, token = token[-1:] not in (_UNLISTED, _BARE), token.rstrip(_HIDING)
        low = token.lower()
        if low in _CLASS_OF and (token.islower() or token.istitle()):
            return 1 + _CLASS_OF[low]
        if token in _MARKS:
            return 1 + _N_CLOSED + _MARKS[token]
        base = 1 + _N_CLOSED + len(_MARKS)
        if not token[:1].isalpha():
            return base if token.isdigit() else base + 1
        if token[0].islower():
            return base + 2
        if len(token) == 1:
            return base + 3
        title = token.title()
        return base + (4 if listed and title in self.given else 5 if listed and title in self.family else 6 if token.isupper() else 7)


@functools.cache
def _character_kinds() -> np.ndarray:
    """0 white space, 1 other, 2 line end, 3 letters, 4 digits, for each code point."""
    out = np.fromiter((4 if c.isdecimal() else 3 if c.isalnum() else 0 if c.isspace() else 1 for c in map(chr, range(0x110000))), np.int8, 0x110000)
    out[10] = 2
    return out


class Tokens:
    """The tokens of several texts: runs of letters, runs of digits, single other characters and line ends.

    ``joined``: the texts with two line ends between them; ``start, end``: where tokens stand in it; ``text``: the number of each
    token's text; ``hash``: of its characters (digits count alike); ``flags``: tracks 0 and 1; ``found``: the forms in the joined text.
    """

    def __init__(self, texts: list[str]):
        self.joined = "\n\n".join(texts)
        points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate(([0], np.cumsum(lengths + 2)))[:-1] if texts else np.zeros(0, np.int64)
        original, kinds = points, _character_kinds()[points].copy()
        if len(texts) > 1:
            between = self.offset[1:] - 2
            kinds[between] = kinds[between + 1] = 0
        new = np.ones(len(points), bool)
        new[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] < 3)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(points))[: len(starts)]
        kept = kinds[starts] != 0
        self.start, self.end = starts[kept], ends[kept]
        if len(starts):
            place = np.arange(len(points)) - np.repeat(starts, ends - starts)
            points = np.where(kinds == 4, np.uint32(48), points).astype(np.uint64)
            self.hash = mix64(np.add.reduceat(mix64(points | (place.astype(np.uint64) << np.uint64(32))), starts))[kept]
        else:
            self.hash = np.empty(0, np.uint64)
        self.text = np.searchsorted(self.offset, self.start, "right") - 1
        self.flags, self.found = np.zeros((len(self.start), 2), np.int64), forms(self.joined, _Numbers(self.joined, original, kinds))
        for kind in ("address", "phone", "id_number", "email"):
            track, number = _TRACKS[kind]
            if spans := self.found[kind]:
                first, last = np.searchsorted(self.start, np.array(spans)).T
                for a, b in zip(first, last, strict=True):
                    self.flags[a:b, track] = number + 1
                self.flags[first[first < last], track] = number

    def token(self, k: int) -> str:
        return self.joined[self.start[k] : self.end[k]]


def _triples(kinds: np.ndarray) -> np.ndarray:
    """The classes of the token before, the token and the one after as one number, for all but the first and last of ``kinds``."""
    return (kinds[:-2] * _N_CLASSES + kinds[1:-1]) * _N_CLASSES + kinds[2:]


#: Shares of words whose identity is hidden in training: of names, and of other words with a capital; and of these the share of which only the shape is seen.
HIDDEN_NAMES, HIDDEN_OTHERS, BARE = 0.75, 0.5, 0.45


@functools.lru_cache(4)
def trained(given: tuple[str, ...], family: tuple[str, ...]) -> Crf:
    """The field, trained on the labelled table with these names; the table's own common given names count as listed."""
    every = set(given) | set(labelled.GIVEN)
    part = sorted(every)
    # Part of the listed names count as unlisted in training, and words are hidden at random, so that the field learns from forms and context.
    known = TokenFeatures(set(part) - set(part[::4]), set(family[::2]))
    pick, table = random.Random(11), []
    for text, marks in labelled.rows(list(given), list(family)):
        own = Tokens([text])
        tokens, tags = [own.token(k) for k in range(len(own.start))], ["O"] * len(own.start)
        for a, b, kind in marks:
            for n, k in enumerate(range(np.searchsorted(own.start, a), np.searchsorted(own.start, b))):
                tags[k] = f"{'I' if n else 'B'}-{kind}"
        for k, t in enumerate(tokens):
            if t[0].isupper() and len(t) > 1 and t.lower() not in _CLASS_OF and pick.random() < (HIDDEN_NAMES if tags[k].endswith("name") else HIDDEN_OTHERS):
                tokens[k] = t + (_BARE if pick.random() < BARE else _UNLISTED if tags[k].endswith("name") and pick.random() < 0.5 else _UNKNOWN)
        kinds = np.array([0, *map(known.kind, tokens), 0])
        table.append((tokens, np.column_stack([own.flags, _triples(kinds)]), tags))
    field = Crf(LABELS, known, (7, 3, _N_CLASSES**3)).fit([row for row in table if row[0]])
    field.features = TokenFeatures(every, set(family))
    return field


#: What is taken from the score of "nothing" for words with a capital: a name missed counts for more than a word hidden in vain.
DOUBT = 0.25


class Scorer:
    """Scores of token types, kept between the batches of a worker and emptied when they grow past a bound."""

    BOUND = 300_000

    def __init__(self, field: Crf):
        self.field, self.rows = field, {}
        self._clear()

    def _clear(self) -> None:
        self.rows.clear()
        self.table, self.kinds = np.zeros((4096, len(OFFSETS), len(LABELS)), np.float32), np.zeros(4096, np.int64)
        self.table[0] = self.field.type_scores("")  # beyond the ends of a text

    def of(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(scores, whether a token is a line end) for all tokens."""
        if len(self.rows) > self.BOUND:
            self._clear()
        types, first, inverse = np.unique(tokens.hash, return_index=True, return_inverse=True)
        number = np.empty(len(types), np.int64)
        for k, key in enumerate(types.tolist()):
            row = self.rows.get(key)
            if row is None:
                row = self.rows[key] = len(self.rows) + 1
                if row >= len(self.table):
                    self.table, self.kinds = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.kinds, np.zeros_like(self.kinds)])
                token = tokens.token(int(first[k]))
                self.table[row], self.kinds[row] = self.field.type_scores(token), self.field.features.kind(token)
            number[k] = row
        n = len(tokens.start)
        place = np.arange(n) + 2 + 4 * tokens.text
        padded = np.zeros(n + 4 * (int(tokens.text[-1]) + 1) if n else 0, np.int64)
        padded[place] = number[inverse]
        scores = np.zeros((n, len(LABELS)), np.float32)
        for o, offset in enumerate(OFFSETS):
            scores += self.table[padded[place + offset], o]
        kinds = self.kinds[padded]
        flags = [tokens.flags[:, 0], tokens.flags[:, 1], (kinds[place - 1] * _N_CLASSES + kinds[place]) * _N_CLASSES + kinds[place + 1]]
        for w, f in zip(self.field.flag_weights, flags, strict=True):
            scores += w.astype(np.float32)[f]
        ends = kinds[place] == 1 + _N_CLOSED + _MARKS["\n"]
        capital = kinds[place] >= 1 + _N_CLOSED + len(_MARKS) + 3
        scores[capital, 0] -= DOUBT
        scores[ends, 1:] = NEVER
        return scores, ends


#: Titles and salutations, after which a name isn't reversed.
_TITLE = re.compile(r"(?:Frau|Herrn?|Kolleg(?:in|en?)|Mrs?|Ms|Dr|Prof|Ing)\.?\s+$")
#: A unit before a full stop that was taken for an initial.
_UNIT = re.compile(r"(?!(?:van|von|de|zu)\b)[a-zµäöü]+\.?\s+")
_SENTENCE_END = re.compile(r"(?<=[^\W\d_]{4})\.\s+")
_ONE_WORD, _ONE_UNIT = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*"), re.compile(r"(?:(?:van|von|de|zu) )?[^\W\d_]+(?:-[^\W\d_]+)*", re.IGNORECASE)

#: Endings of made family names that no given name has.
_FAMILY_LIKE = re.compile(rf"(?:{'|'.join(t for t in labelled._TAILS if len(t) > 3)})$")


def split_names(text: str, a: int, b: int, known: TokenFeatures) -> list[tuple[int, int]]:
    """The single names of a marked list: commas divide names unless they stand between a family and a given name."""
    parts, at = [], a
    for m in re.finditer(r",\s*", text[a:b]):
        parts.append((at, a + m.start()))
        at = a + m.end()
    parts.append((at, b))
    out, k = [], 0
    while k < len(parts):
        x, y = parts[k]
        if k + 1 < len(parts) and _ONE_UNIT.fullmatch(text, x, y) and _ONE_WORD.fullmatch(text, *parts[k + 1]) and not _TITLE.search(text, max(0, x - 20), x):
            first, after = (text[slice(*parts[n])].split("-")[0].title() if n < len(parts) else "" for n in (k + 1, k + 2))
            given = first in known.given or first not in known.family and not _FAMILY_LIKE.search(first) and (after not in known.given or not _ONE_WORD.fullmatch(text, *parts[k + 2]))
            if given:
                out.append((x, parts[k + 1][1]))
                k += 2
                continue
        if y > x:
            out.append((x, y))
        k += 1
    return out


#: The small words that names have within.
_PARTICLES = set("van von vom der den dem de del della di da dos du la le zu zum zur ter ten af av bin ibn al el y und and i".split())
_SMALL_WORD = re.compile(r"(?<![\w'’-])[a-zäöüß]+(?![\w-])")


def _without_small(text: str, a: int, b: int, kind: str) -> list[tuple[int, int, str]]:
    """A marked name divided at words of small letters that no name has within."""
    out, at = [], a
    for m in _SMALL_WORD.finditer(text, a, b):
        if m[0] not in _PARTICLES:
            out.append((at, m.start(), kind))
            at = m.end()
    return [p for p in [*out, (at, b, kind)] if p[1] > p[0]]


#: An article makes it the name of a thing.
_ARTICLE = re.compile(r"(?<![\w-])(?:Der|Die|Das|Ein|Eine|Dem|Den|Des|The)(?=\s)")


def _holds(kind: str, text: str) -> bool:
    """Whether a marked place without a known form can stand by itself."""
    digits = sum(map(str.isdigit, text))
    if kind == "email":
        return bool(_AT_SIGN.search(text)) and any(map(str.isalnum, text))
    if kind == "phone":
        return 6 <= digits <= 15 and not any(map(str.isalpha, text))
    if kind == "id_number":
        plain = "".join(filter(str.isalnum, text)).upper()
        return any(right(plain) for _, right in _IDS)
    if kind == "address":
        return digits > 0 and re.search(r"[^\W\d_]{3}", text) is not None
    return len(text) > 1 and any(map(str.isupper, text)) and "\n" not in text and not _ARTICLE.search(text) and any(w.lower() not in _CLASS_OF for w in re.findall(r"[^\W\d_]+", text))


def spans_of(text: str, marked: list[tuple[int, int, str]], found: dict[str, list[tuple[int, int]]], known: TokenFeatures) -> list[tuple[int, int, str]]:
    """(start, end, kind) without overlaps, in order, of what the field has marked in a text; ``found``: the forms near the marked places."""
    joined: list[tuple[int, int, str]] = []
    marked = [part for m in marked for part in (_without_small(text, *m) if m[2] == "name" else [m])]
    for a, b, kind in marked:  # names of a list are taken together first
        if kind == "name" and (m := _UNIT.match(text, a, b)):
            a = m.end()
        while kind == "name" and (m := _SENTENCE_END.search(text, a, b)):  # no name goes on after a sentence
            joined.append((a, m.start(), kind))
            a = m.end()
        if kind == "name" and joined and joined[-1][2] == kind and re.fullmatch(r",[^\S\n]*", text[joined[-1][1] : a]):
            joined[-1] = (joined[-1][0], b, kind)
        else:
            joined.append((a, b, kind))
    marked = [(x, y, kind) for a, b, kind in joined for x, y in (split_names(text, *_trimmed(text, a, b), known) if kind == "name" else [(a, b)])]
    out: list[tuple[int, int, str]] = []
    for a, b, kind in marked:
        whole = [(x, y) for x, y in found.get(kind, ()) if x < b and a < y]
        if whole:
            out += [(x, y, kind) for x, y in whole]
        else:
            a, b = _trimmed(text, a, b)
            if _holds(kind, text[a:b]):
                out.append((a, b, kind))
    rank = {k: n for n, k in enumerate(("email", "id_number", "phone", "address", "name"))}
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(set(out), key=lambda s: (rank[s[2]], s[0])):
        if not any(a < y and x < b for x, y, _ in kept):
            kept.append((a, b, kind))
    return sorted(kept)


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not text[a].isalnum():
        a += 1
    while a < b and not text[b - 1].isalnum():
        b -= 1
    return a, b


def decode(scorer: Scorer, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each text."""
    own = Tokens(texts)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not len(own.start):
        return out
    scores, ends = scorer.of(own)
    n = len(scores)
    new_text = np.concatenate(([True], own.text[1:] != own.text[:-1]))
    begin = np.flatnonzero(new_text | np.concatenate(([False], ends[:-1])))
    stop = np.append(begin[1:], n)
    stop = stop - ends[stop - 1]  # without the line end
    labels = scorer.field.viterbi(scores, begin, stop, ~new_text[begin], np.append(ends, False)[stop])
    held = {kind: np.array(spans, np.int64).reshape(-1, 2) for kind, spans in own.found.items()}
    for spans in held.values():
        spans.sort(axis=0)
    marked: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for k in np.flatnonzero(labels).tolist():
        first, kind = LABELS[labels[k]].split("-")
        mine, base = marked[own.text[k]], int(own.offset[own.text[k]])
        a, b = int(own.start[k]) - base, int(own.end[k]) - base
        if first == "B" or not mine or mine[-1][2] != kind:
            mine.append((a, b, kind))
        else:
            mine[-1] = (mine[-1][0], b, kind)
    for t, mine in enumerate(marked):
        if mine:
            base, size = int(own.offset[t]), len(texts[t])
            near = {}
            for kind in {m[2] for m in mine}:
                if kind in held:
                    spans = held[kind]
                    low, high = np.searchsorted(spans[:, 0], (base, base + size))
                    near[kind] = [(a - base, b - base) for a, b in spans[low:high].tolist()]
            out[t] = spans_of(texts[t], mine, near, scorer.field.features)
    return out


def _field(person_names: DataFrame) -> Crf:
    """Trained with the listed names; a list of more than MOST_NAMES is refused, as no name may be left out."""
    listed = person_names.filter("name IS NOT NULL AND name_kind IN ('given', 'family')").select("name", "name_kind").distinct().limit(MOST_NAMES + 1).collect()
    if len(listed) > MOST_NAMES:
        raise ValueError(f"person_names has more than {MOST_NAMES} names, which is the most that fits the field")
    return trained(*(tuple(sorted(r.name for r in listed if r.name_kind == kind)) for kind in ("given", "family")))


#: The scorer of this worker, and the broadcast it belongs to.
_KEPT: dict[int, Scorer] = {}


def _scorer(sent) -> Scorer:
    key = sent._jbroadcast.id() if getattr(sent, "_jbroadcast", None) is not None else id(sent.value)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Scorer(sent.value)
    return _KEPT[key]


def personal_information(documents: DataFrame, person_names: DataFrame) -> DataFrame:
    """``doc_id, kind, value``: once per document and kind, the value as it stands in the text.

    Null and empty texts have none. Rows repeated in full give one row. An empty list of names is allowed; then only forms and
    context decide. Other columns aren't read.
    """
    sent = documents.sparkSession.sparkContext.broadcast(_field(person_names))

    def run(batch: pa.RecordBatch) -> dict | None:
        texts, rows = batch["text"].to_pylist(), []
        for doc, text, spans in zip(batch["doc_id"].to_pylist(), texts, decode(_scorer(sent), texts), strict=True):
            rows += dict.fromkeys((doc, kind, text[a:b]) for a, b, kind in spans)
        if not rows:
            return None
        c = list(zip(*rows, strict=True))
        return {"doc_id": longs(c[0]), "kind": strings(c[1]), "value": strings(c[2])}

    return map_batches(documents.filter("text <> '' AND doc_id IS NOT NULL").select("doc_id", "text"), run, "doc_id long, kind string, value string", by="text").distinct()


def redacted(documents: DataFrame, person_names: DataFrame) -> DataFrame:
    """``doc_id, text``: each place of personal information is replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME].

    One row per row of the input; everything else stays as it is, null and empty texts too.
    """
    sent = documents.sparkSession.sparkContext.broadcast(_field(person_names))

    def run(batch: pa.RecordBatch) -> dict:
        texts, done = batch["text"].to_pylist(), []
        for text, spans in zip(texts, decode(_scorer(sent), [t or "" for t in texts]), strict=True):
            if spans:
                pieces, at = [], 0
                for a, b, kind in spans:
                    pieces += [text[at:a], f"[{kind.upper()}]"]
                    at = b
                text = "".join(pieces) + text[at:]
            done.append(text)
        return {"doc_id": batch["doc_id"], "text": strings(done)}

    return map_batches(documents.select("doc_id", "text"), run, "doc_id long, text string", by="text")
