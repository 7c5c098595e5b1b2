"""Text functions as Column expressions: codes, normal forms, trigrams, snippets, prompts, pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that Python's str.split() takes as white space; Java's \s has only a part of it.
BLANK = r"[\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Requirement codes, references to regulations, code-shaped tokens.
REQUIREMENT = r"(?U)\b([A-ZÄÖÜ]{2,4})[ -]?(\d+(?:\.\d+)+)\b"
UN_ECE = r"(?iU)\b(UN|ECE)[ -]?R[ -]?(\d+[A-Z]?)\b"
REGULATION = r"(?iU)\bR[ -]?(\d+[A-Z]?)\b"
CODE = r"(?U)\b[A-ZÄÖÜ]{1,4}(?:[ -]?[A-ZÄÖÜ]{1,3})?[ -]?\d+(?:\.\d+)*[A-Za-z]?\b"
SENTINEL = "NICHT_GEFUNDEN"


def words(text: Column) -> Column:
    """Blank-separated words; empty for an empty text, null for null."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, BLANK + "+", " "), "^ | $", "")


def normalize_codes(text: Column) -> Column:
    """Codes written one way, lower case, single blanks. Texts with combining marks are to be composed first (``nfc``)."""
    out = F.regexp_replace(text, REQUIREMENT, "$1$2")
    out = F.regexp_replace(F.regexp_replace(out, UN_ECE, "$1R$2"), REGULATION, "R$1")
    return collapse(F.lower(out))


def extract_codes(text: Column) -> Column:
    """Distinct requirement codes in their normal form, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(REQUIREMENT), 0), lambda c: F.lower(F.regexp_replace(c, "[ -]", ""))))


def first_code(text: Column) -> Column:
    """The first token of the looser code shape, in its normal form; null without one."""
    return normalize_codes(F.nullif(F.regexp_extract(text, CODE, 0), F.lit("")))


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, with two blanks before and one after it."""
    padded = F.transform(terms(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def for_match(text: Column) -> Column:
    """Lower case, decimal commas as points, single blanks: how answer points are compared."""
    return collapse(F.regexp_replace(F.lower(text), r"(?<=\d),(?=\d)", "."))


def snippet(text: Column, length: int = 240) -> Column:
    trimmed = F.trim(text)
    return F.when(F.length(trimmed) <= length, trimmed).otherwise(F.concat(F.rtrim(F.substring(trimmed, 1, length)), F.lit("…")))


def markers(answer: Column) -> Column:
    """Markers [S1], [S2] ... without brackets, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(S\d+)\]"), 1))


def neutral(text: Column) -> Column:
    """Source tags and markers inside a text made harmless."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)<(/?quelle[^>]*)>", "‹$1›"), r"\[(S\d+)\]", "($1)")


def page_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("Seite "), first)).otherwise(F.concat(F.lit("Seite "), first, F.lit("–"), last))


def breadcrumb(path: Column, headings: Column) -> Column:
    """Headings of the path's ancestors and its own, ' > ' between; null if the map ``headings`` has none."""
    parts = F.split(path, r"\.")
    codes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    known = F.filter(F.transform(codes, lambda c: F.try_element_at(headings, c)), lambda h: h.isNotNull())
    return F.when(F.size(known) > 0, F.array_join(known, " > "))


def section_code(line: Column) -> Column:
    """§ 36a -> §36a, or a leading number that is followed by white space."""
    paragraph = F.regexp_replace(F.regexp_extract(line, r"^(§\s*\d+[a-z]?)", 1), r"\s", "")
    return F.coalesce(F.nullif(paragraph, F.lit("")), F.nullif(F.regexp_extract(line, r"^(\d+(?:\.\d+)*)\s", 1), F.lit("")))


def markdown_table(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table as wide as its first row: shorter rows are filled, longer ones cut. The lines of a cell
    are trimmed and joined by ' / ', empty ones left out. No rows give an empty text."""
    width = F.size(rows[0])
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")), lambda x: x != "")
    clean = F.transform(rows, lambda r: F.slice(F.concat(F.transform(r, lambda c: F.array_join(parts(c), " / ")), F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), F.lit(1), width))
    lines = F.transform(clean, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    whole = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    return F.when(F.size(rows) > 0, whole).otherwise(F.when(rows.isNotNull(), ""))


def cost_usd(prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """Price of a call, six decimals, half to even; null if anything is unknown."""
    return F.bround(prompt / 1e6 * price_in + completion / 1e6 * price_out, 6)


def retry_after(now: Column) -> Column:
    """Seconds to the next midnight, at least 1."""
    return F.greatest(F.lit(1), (F.unix_timestamp(F.date_trunc("day", now) + F.expr("interval 1 day")) - F.unix_timestamp(now)).cast("int"))


def is_truncated(finish_reason: Column) -> Column:
    return F.coalesce(F.lower(finish_reason) != "stop", F.lit(False))
