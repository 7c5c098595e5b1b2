"""Text of PDF files: pages, positioned runs of text with size and weight, joined into lines and blocks.

Reads what most text files have: plain and compressed objects, object streams, simple fonts (Windows encoding) and fonts with a table to
Unicode. Pictures, forms and other filters are passed over; a page without text gives no blocks, and is then a case for recognition.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|/[^\s<>\[\]()/%{}]*|\(|<[0-9A-Fa-f\s]*>|[^\s<>\[\]()/%{}]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class NotAPdfError(ValueError):
    """The bytes can't be read as a PDF."""


class Ref(tuple):
    """Number of an object."""


class Op(bytes):
    """An operator or other bare word."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string in brackets that begins at ``at``, and where it ends."""
    out, depth, k = bytearray(), 1, at + 1
    while k < len(data):
        c = data[k : k + 1]
        if c == b"\\":
            n = data[k + 1 : k + 2]
            if m := re.match(rb"[0-7]{1,3}", data[k + 1 : k + 4]):
                out.append(int(m[0], 8) & 255)
                k += 1 + len(m[0])
                continue
            out += b"" if n in b"\r\n" else _ESCAPES.get(n, n)
            k += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), k + 1
        out += c
        k += 1
    return bytes(out), k


def values(data: bytes):
    """Names (str), numbers, strings (bytes), arrays, dictionaries, references and operators in order."""
    stack: list[list] = [[]]
    at = 0
    while m := _TOKEN.search(data, at):
        t, at = m[0], m.end()
        if t[:1] == b"%":
            continue
        if t in (b"<<", b"["):
            stack.append([])
            continue
        if t in (b">>", b"]"):
            if len(stack) < 2:
                continue
            own = stack.pop()
            value = own if t == b"]" else {k: v for k, v in zip(own[::2], own[1::2], strict=False) if isinstance(k, str)}
        elif t == b"(":
            value, at = _string(data, m.start())
        elif t[:1] == b"<":
            hexed = re.sub(rb"\s", b"", t[1:-1])
            value = bytes.fromhex((hexed + b"0" * (len(hexed) % 2)).decode())
        elif t[:1] == b"/":
            value = t[1:].decode("latin-1")
        elif re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", t):
            value = float(t) if b"." in t else int(t)
        elif t == b"R" and len(stack[-1]) >= 2 and all(type(v) is int for v in stack[-1][-2:]):
            del stack[-1][-1]
            value = Ref((stack[-1].pop(),))
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(t, Op(t))
        if len(stack) == 1:
            stack[0].append(value)
            if isinstance(value, Op):
                yield from stack[0]
                stack[0] = []
        else:
            stack[-1].append(value)
    yield from stack[0]


class File:
    """The objects of a file by number, the latest of each."""

    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise NotAPdfError
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.DOTALL):
            body, stream = m[2], None
            if s := re.search(rb"\bstream\r?\n", body):
                stream, body = re.sub(rb"\r?\nendstream\s*$", b"", body[s.end() :]), body[: s.start()]
            found = list(values(body))
            number = int(m[1])
            self.objects[number] = found[0] if found else None
            if stream is not None:
                self.streams[number] = stream
        for number in list(self.streams):
            info = self.objects[number]
            if isinstance(info, dict) and info.get("Type") == "ObjStm":
                inner = self.data(Ref((number,)))
                first = int(self.at(info.get("First")) or 0)
                pairs = [v for v in values(inner[:first]) if type(v) is int]
                for n, offset in zip(pairs[::2], pairs[1::2], strict=False):
                    self.objects.setdefault(n, next(iter(values(inner[first + offset :])), None))
        self.encrypted = re.search(rb"/Encrypt\b", data) is not None

    def at(self, value):
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value[0])
        return None

    def data(self, ref) -> bytes:
        if not isinstance(ref, Ref) or ref[0] not in self.streams:
            return b""
        raw, info = self.streams[ref[0]], self.at(ref)
        filters = self.at(info.get("Filter")) if isinstance(info, dict) else None
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.at(f) != "FlateDecode":
                return b""
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                return b""
        return raw

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit."""
        roots = [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Pages" and "Parent" not in o]
        out: list[dict] = []

        def walk(node, inherited: dict, depth: int) -> None:
            node = self.at(node)
            if not isinstance(node, dict) or depth > 50:
                return
            own = inherited | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                for kid in self.at(node["Kids"]) or []:
                    walk(kid, own, depth + 1)
            else:
                out.append(own | node)

        for root in roots[-1:]:
            walk(root, {}, 0)
        return out


@dataclass
class Font:
    bold: bool = False
    wide: bool = False
    table: dict[int, str] = field(default_factory=dict)

    def text(self, raw: bytes) -> str:
        codes = [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw) - 1, 2)] if self.wide else list(raw)
        return "".join(self.table.get(c) or ("" if self.wide else bytes([c]).decode("cp1252", "ignore")) for c in codes)


def _font(file: File, info) -> Font:
    info = file.at(info)
    if not isinstance(info, dict):
        return Font()
    out = Font("bold" in str(file.at(info.get("BaseFont")) or "").lower(), file.at(info.get("Subtype")) == "Type0")
    mapping = file.data(info.get("ToUnicode"))
    for kind, body in re.findall(rb"beginbf(char|range)(.*?)endbf", mapping, re.DOTALL):
        found = [v for v in values(body) if isinstance(v, bytes | list) and not isinstance(v, Op)]
        read = lambda b: b.decode("utf-16-be", "ignore")
        if kind == b"char":
            out.table |= {int.from_bytes(a, "big"): read(b) for a, b in zip(found[::2], found[1::2], strict=False) if isinstance(b, bytes)}
        else:
            for a, b, to in zip(found[::3], found[1::3], found[2::3], strict=False):
                low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                for n in range(min(high - low + 1, 65_536)):
                    out.table[low + n] = read(to[n]) if isinstance(to, list) and n < len(to) else chr(ord(read(to)[-1]) + n) if isinstance(to, bytes) and read(to) else ""
    return out


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def runs(file: File, page: dict) -> list[tuple[float, float, float, bool, str]]:
    """(x, baseline from the top, size, bold, text) of the page's shown strings in order."""
    resources = file.at(page.get("Resources")) or {}
    fonts = {n: _font(file, f) for n, f in (file.at(resources.get("Font")) or {}).items()}
    box = [v if isinstance(v, int | float) else 0 for v in map(file.at, file.at(page.get("MediaBox")) or [0, 0, 595, 842])]
    contents = file.at(page.get("Contents")) if not (isinstance(page.get("Contents"), Ref) and page["Contents"][0] in file.streams) else [page["Contents"]]
    data = b"\n".join(file.data(c) for c in contents or [])
    unit = (1, 0, 0, 1, 0, 0)
    state, saved, out, args = unit, [], [], []
    matrix = line = unit
    font, size, leading = Font(), 0.0, 0.0

    def move(x: float, y: float) -> None:
        nonlocal matrix, line
        line = matrix = _times((1, 0, 0, 1, x, y), line)

    def show(parts: list) -> None:
        nonlocal matrix
        text = ""
        for p in parts:
            if isinstance(p, bytes):
                text += font.text(p)
            elif isinstance(p, int | float) and p < -180:  # a wide step stands for a blank
                text += " "
        place = _times(matrix, state)
        scale = abs(size) * (place[2] ** 2 + place[3] ** 2) ** 0.5
        if text:
            out.append((place[4], box[3] - place[5], round(scale, 2), font.bold, text))
        matrix = _times((1, 0, 0, 1, 0.5 * abs(size) * len(text), 0), matrix)

    for v in values(data):
        if not isinstance(v, Op):
            args.append(v)
            continue
        numbers = [a for a in args if isinstance(a, int | float)]
        op = bytes(v)
        if op == b"q":
            saved.append(state)
        elif op == b"Q" and saved:
            state = saved.pop()
        elif op == b"cm" and len(numbers) >= 6:
            state = _times(tuple(numbers[-6:]), state)
        elif op == b"BT":
            matrix = line = unit
        elif op == b"Tf" and args and numbers:
            font, size = fonts.get(next((a for a in args if isinstance(a, str)), ""), Font()), numbers[-1]
        elif op == b"TL" and numbers:
            leading = numbers[-1]
        elif op in (b"Td", b"TD") and len(numbers) >= 2:
            leading = -numbers[-1] if op == b"TD" else leading
            move(numbers[-2], numbers[-1])
        elif op == b"Tm" and len(numbers) >= 6:
            matrix = line = tuple(numbers[-6:])
        elif op == b"T*":
            move(0, -leading)
        elif op == b"Tj":
            show(args[-1:])
        elif op == b"TJ" and args and isinstance(args[-1], list):
            show(args[-1])
        elif op in (b"'", b'"'):
            move(0, -leading)
            show(args[-1:])
        args = []
    return out


def spans(content: bytes) -> tuple[int, list[dict]]:
    """(number of pages, spans): each span has page, block_no, span_no, text, font_size, flags (16 for bold) and bbox.

    Runs on one baseline are a line; lines of about the same size that follow within one and a half of it are a block.
    """
    file = File(content)
    pages, out, block = file.pages(), [], -1
    if not pages:
        raise NotAPdfError
    for number, page in enumerate(pages, 1):
        last, span = None, 0
        for x, y, size, bold, text in runs(file, page):
            same_line = last is not None and abs(y - last[1]) < 0.5 and abs(size - last[2]) < 0.5
            near = last is not None and 0 <= y - last[1] <= 1.5 * size and abs(size - last[2]) < 0.5 and bold == last[3]
            if not (same_line or near):
                block, span = block + 1, 0
            gap = "" if span == 0 or text[:1].isspace() else " " if not same_line or x - last[0] > 0.5 * size * last[4] + 0.3 * size else ""
            out.append({"page": number, "block_no": block, "span_no": span, "text": gap + text, "font_size": size, "flags": 16 if bold else 0, "bbox": [x, y - size, x + 0.5 * size * len(text), y]})
            last, span = (x, y, size, bold, len(text)), span + 1
    return len(pages), out
