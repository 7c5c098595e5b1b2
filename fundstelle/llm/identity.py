"""Check digits of numbers that identify persons and accounts (published rules)."""

from __future__ import annotations


def iban_check(text: str) -> bool:
    """ISO 13616: country and check digits moved to the end, letters as 10 to 35, remainder 1 modulo 97."""
    t = text.replace(" ", "").upper()
    if not (15 <= len(t) <= 34 and t[:2].isalpha() and t.isascii() and t.isalnum() and t[2:4].isdigit()) or t[:2] == "DE" and len(t) != 22:
        return False
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def tax_check(text: str) -> bool:
    """German tax number: eleven digits, of the first ten one occurs two or three times, ISO 7064 modulo 11, 10."""
    t = text.replace(" ", "")
    if len(t) != 11 or not t.isdigit() or not t.isascii():
        return False
    most = sorted(map(t[:10].count, set(t[:10])), reverse=True)
    if most[0] not in (2, 3) or (len(most) > 1 and most[1] > 1):
        return False
    product = 10
    for c in t[:10]:
        total = (int(c) + product) % 10 or 10
        product = total * 2 % 11
    return (11 - product) % 10 == int(t[10])


def insurance_check(text: str) -> bool:
    """German pension insurance number: the letter as two digits, weights, sums of digits, modulo 10."""
    t = text.replace(" ", "").upper()
    if len(t) != 12 or not (t[:8] + t[9:]).isdigit() or not "A" <= t[8] <= "Z":
        return False
    digits = [int(c) for c in t[:8] + f"{ord(t[8]) - 64:02}" + t[9:11]]
    weighted = (d * w for d, w in zip(digits, (2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1), strict=True))
    return sum(x // 10 + x % 10 for x in weighted) % 10 == int(t[11])


def card_check(text: str) -> bool:
    """Identity card and passport: nine letters or digits and a check digit, weights 7, 3, 1 modulo 10."""
    if len(text) != 10 or not text.isascii() or not text.isalnum() or not text[9].isdigit() or not text[0].isalpha():
        return False
    return sum(int(c, 36) * w for c, w in zip(text[:9], (7, 3, 1) * 3, strict=True)) % 10 == int(text[9])
