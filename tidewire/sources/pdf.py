"""Text of PDF files: pages in order, text strings through their fonts' Unicode maps.

Covers what text PDFs are made of: Flate streams, object streams, simple and
composite fonts with ToUnicode maps (Latin-1 where a simple font has none). Scanned
pages have no text here; recognising them needs tools outside of this engine.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field


class Name(str):
    pass


class Operator(str):
    pass


@dataclass(frozen=True)
class Reference:
    number: int


@dataclass
class Stream:
    info: dict
    raw: bytes

    def data(self) -> bytes:
        filters = self.info.get("Filter", [])
        out = self.raw
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                return b""  # images and the like
            try:
                out = zlib.decompressobj().decompress(out)
            except zlib.error:
                return b""
        return out


_SPACE = b"\x00\t\n\x0c\r "
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_END = object()


class _Lexer:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        while self.at < len(self.data):
            c = self.data[self.at : self.at + 1]
            if c in _SPACE:
                self.at += 1
            elif c == b"%":
                while self.at < len(self.data) and self.data[self.at : self.at + 1] not in b"\r\n":
                    self.at += 1
            else:
                return

    def value(self) -> object:
        """The next object, operator or closing mark."""
        self.skip()
        if self.at >= len(self.data):
            return _END
        two, c = self.data[self.at : self.at + 2], self.data[self.at : self.at + 1]
        if two == b"<<":
            self.at += 2
            items = self._until(">>")
            return {str(k): v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
        if two == b">>":
            self.at += 2
            return Operator(">>")
        if c == b"[":
            self.at += 1
            return self._until("]")
        if c in b"]{})":
            self.at += 1
            return Operator(c.decode())
        if c == b"(":
            return self._string()
        if c == b"<":
            end = self.data.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at : end if end >= 0 else len(self.data)])
            self.at = end + 1 if end >= 0 else len(self.data)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"/":
            found = _WORD.match(self.data, self.at + 1)
            self.at = found.end() if found else self.at + 1
            return Name(found[0].decode("latin-1") if found else "")
        found = _WORD.match(self.data, self.at)
        if not found:
            self.at += 1
            return Operator(c.decode("latin-1"))
        self.at = found.end()
        word = found[0].decode("latin-1")
        return float(word) if _NUMBER.match(word) else Operator(word)

    def _until(self, mark: str) -> list:
        out: list = []
        while True:
            v = self.value()
            if v is _END or (isinstance(v, Operator) and v == mark):
                return out
            if isinstance(v, Operator) and v == "R" and len(out) >= 2:
                out[-2:] = [Reference(int(out[-2]))]
            else:
                out.append({"true": True, "false": False, "null": None}.get(v, v) if isinstance(v, Operator) else v)

    def _string(self) -> bytes:
        out, depth = bytearray(), 1
        self.at += 1
        while self.at < len(self.data):
            c = self.data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                e = self.data[self.at : self.at + 1]
                octal = re.compile(rb"[0-7]{1,3}").match(self.data, self.at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                    continue
                self.at += 1
                out += b"" if e in (b"\n", b"\r") else _ESCAPES.get(e, e)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        return bytes(out)


@dataclass
class _File:
    objects: dict[int, object] = field(default_factory=dict)

    def get(self, value: object) -> object:
        for _ in range(20):
            if not isinstance(value, Reference):
                return value
            value = self.objects.get(value.number)
        return None

    def dictionary(self, value: object) -> dict:
        found = self.get(value)
        return found.info if isinstance(found, Stream) else found if isinstance(found, dict) else {}

    def read(self, content: bytes) -> None:
        for found in re.finditer(rb"(\d+)\s+\d+\s+obj\b", content):
            lexer = _Lexer(content, found.end())
            value = lexer.value()
            if isinstance(value, dict):
                lexer.skip()
                if content.startswith(b"stream", lexer.at):
                    start = lexer.at + 6
                    start += 2 if content.startswith(b"\r\n", start) else 1
                    length = value.get("Length")
                    end = start + int(length) if isinstance(length, float) else content.find(b"endstream", start)
                    value = Stream(value, content[start : end if end >= 0 else len(content)])
            self.objects[int(found[1])] = value
        for value in list(self.objects.values()):
            if isinstance(value, Stream) and value.info.get("Type") == "ObjStm":
                self._packed(value)

    def _packed(self, stream: Stream) -> None:
        data, first = stream.data(), int(stream.info.get("First", 0))
        heads = [int(x) for x in data[:first].split() if x.isdigit()]
        for number, offset in zip(heads[::2], heads[1::2], strict=False):
            self.objects.setdefault(number, _Lexer(data, first + offset).value())

    def pages(self) -> list[dict]:
        root = next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), {})
        out: list[dict] = []
        todo: list[tuple[object, dict]] = [(root.get("Pages"), {})]
        seen: set[int] = set()
        while todo:
            reference, above = todo.pop()
            if isinstance(reference, Reference):
                if reference.number in seen:
                    continue
                seen.add(reference.number)
            node = self.dictionary(reference)
            resources = {"Resources": node.get("Resources", above.get("Resources"))}
            if "Kids" in node:
                todo += [(kid, resources) for kid in reversed(self.get(node["Kids"]) or [])]
            elif node:
                out.append(node | resources)
        return out


class _Font:
    def __init__(self, file: _File, info: dict):
        self.width = 2 if info.get("Subtype") == "Type0" else 1
        self.map: dict[int, str] = {}
        unicode = file.get(info.get("ToUnicode"))
        if isinstance(unicode, Stream):
            self._learn(unicode.data())

    def _learn(self, data: bytes) -> None:
        lexer, stack = _Lexer(data), []
        utf16 = lambda b: b.decode("utf-16-be", "replace")
        while (v := lexer.value()) is not _END:
            if not isinstance(v, Operator):
                stack.append(v)
                continue
            if v == "endbfchar":
                self.map |= {int.from_bytes(a): utf16(b) for a, b in zip(stack[::2], stack[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif v == "endbfrange":
                for low, high, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    if isinstance(low, bytes) and isinstance(high, bytes):
                        for k in range(min(65_536, int.from_bytes(high) - int.from_bytes(low) + 1)):
                            if isinstance(to, list):
                                self.map[int.from_bytes(low) + k] = utf16(to[k]) if k < len(to) and isinstance(to[k], bytes) else ""
                            elif isinstance(to, bytes) and to:
                                self.map[int.from_bytes(low) + k] = utf16(to[:-2]) + chr((int.from_bytes(to[-2:]) + k) & 0xFFFF)
            stack = []

    def text(self, codes: bytes) -> str:
        if self.width == 1:
            return "".join(self.map.get(c, bytes([c]).decode("latin-1")) for c in codes)
        return "".join(self.map.get(int.from_bytes(codes[k : k + 2]), "") for k in range(0, len(codes), 2))


def _page_text(file: _File, page: dict) -> str:
    contents = file.get(page.get("Contents"))
    parts = [file.get(p) for p in (contents if isinstance(contents, list) else [contents])]
    lexer = _Lexer(b"\n".join(p.data() for p in parts if isinstance(p, Stream)))
    listed = file.dictionary(file.dictionary(page.get("Resources")).get("Font"))
    fonts: dict[str, _Font] = {}
    font, out, stack, line = _Font(file, {}), [], [], 0.0

    def show(values: list) -> None:
        for v in values:
            if isinstance(v, bytes):
                out.append(font.text(v))
            elif isinstance(v, float) and v < -180:  # thousandths of the type size: a blank
                out.append(" ")

    while (v := lexer.value()) is not _END:
        if not isinstance(v, Operator):
            stack.append(v)
            continue
        if v == "Tf" and len(stack) >= 2:
            name = str(stack[-2])
            font = fonts.setdefault(name, _Font(file, file.dictionary(listed.get(name))))
        elif v in ("'", '"', "T*") or (v in ("Td", "TD") and len(stack) >= 2 and stack[-1]):
            out.append("\n")
        elif v == "Tm" and len(stack) >= 6 and stack[-1] != line:
            line = stack[-1]
            out.append("\n")
        elif v in ("Td", "TD", "Tm"):
            out.append(" ")
        if v in ("Tj", "'", '"') and stack:
            show(stack[-1:])
        elif v == "TJ" and stack and isinstance(stack[-1], list):
            show(stack[-1])
        stack = []
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def pdf_text(content: bytes | None) -> str | None:
    """Text of all pages, one line a line; None where the file is no PDF or shows no text."""
    if not content or b"%PDF" not in content[:1024]:
        return None
    file = _File()
    try:
        file.read(content)
        text = "\n".join(filter(None, (_page_text(file, p) for p in file.pages())))
    except (ValueError, TypeError, IndexError, RecursionError):  # a broken file has no text
        return None
    return text or None
