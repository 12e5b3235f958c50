"""Query and vector values: constructors, text and binary forms, equality."""

from __future__ import annotations

import struct
from collections import Counter
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Bm25Query:
    """A query text, with the index that it names if it does."""

    text: str
    index: str | None = None

    @classmethod
    def parse(cls, value: str) -> Bm25Query:
        """`index:text` or plain text; the first colon parts them, so text with a colon needs the constructor."""
        name, colon, text = value.partition(":")
        return cls(text, name) if colon and name else cls(value)

    def __str__(self) -> str:
        return f"{self.index}:{self.text}" if self.index else self.text

    def to_bytes(self) -> bytes:
        name, text = (self.index or "").encode(), self.text.encode()
        return struct.pack(">BBI", 1, int(self.index is not None), len(name)) + name + struct.pack(">I", len(text)) + text

    @classmethod
    def from_bytes(cls, data: bytes) -> Bm25Query:
        version, explicit, n = struct.unpack_from(">BBI", data)
        if version != 1 or len(data) < 10 + n:
            raise ValueError("invalid bm25query binary")
        (m,) = struct.unpack_from(">I", data, 6 + n)
        if m > 1 << 20 or len(data) != 10 + n + m:
            raise ValueError("invalid bm25query text length")
        text = data[10 + n :]
        if b"\x00" in data[6 : 6 + n] + text:
            raise ValueError("bm25query may not hold a zero byte")
        return cls(text.decode(), data[6 : 6 + n].decode() if explicit else None)


def to_bm25query(text: str, index: str | None = None) -> Bm25Query:
    return Bm25Query(text, index)


@dataclass(frozen=True)
class Bm25Vector:
    """Lexemes with their frequencies, under an index's name; entries are sorted."""

    index: str
    entries: tuple[tuple[str, int], ...] = field(default=())

    @classmethod
    def of(cls, index: str, lexemes: list[str]) -> Bm25Vector:
        return cls(index, tuple(sorted(Counter(lexemes).items(), key=lambda e: e[0].encode())))

    @classmethod
    def parse(cls, value: str) -> Bm25Vector:
        name, brace, rest = value.partition(":{")
        if not brace or not rest.endswith("}") or not name:
            raise ValueError(f"invalid bm25vector: {value!r}")
        entries = []
        for part in filter(None, rest[:-1].split(",")):
            lexeme, colon, n = part.rpartition(":")
            if not colon or not lexeme or not n.lstrip("-").isdigit():
                raise ValueError(f"invalid bm25vector entry: {part!r}")
            if int(n) < 0:
                raise ValueError(f"negative frequency in bm25vector: {part!r}")
            entries.append((lexeme, int(n)))
        return cls(name, tuple(sorted(entries, key=lambda e: e[0].encode())))

    def __str__(self) -> str:
        return f"{self.index}:{{{','.join(f'{lexeme}:{n}' for lexeme, n in self.entries)}}}"

    def frequency(self, lexeme: str) -> int:
        return dict(self.entries).get(lexeme, 0)

    def to_bytes(self) -> bytes:
        """A versioned form: name, count, then each lexeme with its frequency, lengths as varints."""
        out = bytearray(b"BM25\x02")
        for raw in (self.index.encode(),):
            out += _varint(len(raw)) + raw
        out += _varint(len(self.entries))
        for lexeme, n in self.entries:
            raw = lexeme.encode()
            out += _varint(n) + _varint(len(raw)) + raw
        return bytes(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Bm25Vector:
        if data[:4] != b"BM25":
            raise ValueError("not a bm25vector")
        if data[4:5] != b"\x02":
            raise ValueError("unsupported bm25vector version")
        at = 5

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                if at >= len(data) or shift > 63:
                    raise ValueError("truncated bm25vector")
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        def text() -> str:
            nonlocal at
            n = number()
            raw = data[at : at + n]
            if len(raw) != n or b"\x00" in raw:
                raise ValueError("bad bm25vector text")
            at += n
            return raw.decode()

        name, entries = text(), []
        for _ in range(number()):
            n = number()
            entries.append((text(), n))
        if at != len(data):
            raise ValueError("trailing bytes in bm25vector")
        return cls(name, tuple(sorted(entries, key=lambda e: e[0].encode())))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)
