"""The object tree: flat records that carry their depth, and their attributes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pagelake.functions import limits
from pagelake.functions.errors import Corrupt
from pagelake.functions.tlv import element, find, find_number, ints, ints_bytes, items, length_bytes, number, number_bytes, read
from pagelake.functions.tlv import elements as tlv_elements

#: Attribute numbers.
NAME, NUMBER, SIZE, DRAWING, DEFS, POSITION, THUMBNAIL, ROTATION, NAME_WIDE, PICTURES = 4, 3, 5, 7, 51, 52, 58, 61, 70, 300
PRIVATE = 0xC0


@dataclass
class Attr:
    cls: int
    tag: int
    value: bytes


@dataclass
class Def:
    tag: int
    type: int
    index: int
    name: str


@dataclass
class Record:
    depth: int
    kind_raw: bytes
    attrs: list[Attr] = field(default_factory=list)

    @property
    def kind(self) -> int:
        return number(self.kind_raw)

    def get(self, tag: int) -> Attr | None:
        return next((a for a in self.attrs if a.tag == tag), None)

    def ints(self, tag: int) -> list[int]:
        a = self.get(tag)
        return ints(a.value) if a else []

    def set(self, tag: int, value: bytes, cls: int = 0x80) -> None:
        a = self.get(tag)
        if a:
            a.value = value
        else:
            self.attrs.append(Attr(cls, tag, value))

    def drop(self, tag: int) -> None:
        self.attrs = [a for a in self.attrs if a.tag != tag]


def _element(b: bytes, at: int, end: int) -> tuple[int, int, int, int]:
    """(class bits, tag, value, end); tags of 31 and more are written in groups of seven bits."""
    i = at
    if i >= len(b):
        raise Corrupt(f"properties: bad element at {at}")
    first, i = b[i], i + 1
    tag = first & 0x1F
    if tag == 0x1F:
        tag = 0
        while True:
            if i >= len(b) or tag >> 32:
                raise Corrupt(f"properties: bad tag at {at}")
            x, i = b[i], i + 1
            tag = tag << 7 | x & 0x7F
            if not x & 0x80:
                break
    if i >= len(b):
        raise Corrupt(f"properties: bad element at {at}")
    n, i = b[i], i + 1
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or i + k > len(b):
            raise Corrupt(f"properties: bad length at {at}")
        n, i = int.from_bytes(b[i : i + k], "big"), i + k
    if i + n > end:
        raise Corrupt(f"properties: element at {at} runs past its end")
    return first & 0xE0, tag, i, i + n


def parse(b: bytes) -> list[Record]:
    out, at = [], 0
    while at < len(b):
        cls, tag, v, end = _element(b, at, len(b))
        if (cls, tag) != (0x60, 2):
            raise Corrupt(f"properties: no record at {at}")
        _, t0, v0, e0 = _element(b, v, end)
        if t0 != 0 or e0 - v0 != 1:
            raise Corrupt(f"properties: no depth at {v}")
        c1, t1, v1, e1 = _element(b, e0, end)
        if (c1, t1) != (0x60, 2):
            raise Corrupt(f"properties: no kind at {e0}")
        r = Record(b[v0], b[v1:e1])
        at = e1
        while at < end:
            c, t, va, at = _element(b, at, end)
            r.attrs.append(Attr(c, t, b[va:at]))
        out.append(r)
        if not len(out) & 1023:
            limits.tick()
        at = end
    return out


def _put(cls: int, tag: int, value: bytes) -> bytes:
    if tag < 0x1F:
        head = bytes([cls | tag])
    else:
        groups = [tag & 0x7F]
        while tag := tag >> 7:
            groups.append(tag & 0x7F | 0x80)
        head = bytes([cls | 0x1F, *reversed(groups)])
    return head + length_bytes(len(value)) + value


def write(records: list[Record]) -> bytes:
    """The inverse of parse()."""
    out = []
    for r in records:
        inner = _put(0x80, 0, bytes([r.depth])) + _put(0x60, 2, r.kind_raw) + b"".join(_put(a.cls, a.tag, a.value) for a in r.attrs)
        out.append(_put(0x60, 2, inner))
    return b"".join(out)


def parse_defs(v: bytes) -> list[Def]:
    """Groups of five: number, type, index, name length, name."""
    parts = items(v)
    return [Def(number(p[0]) & 0xFFFFFFFF, number(p[1]), number(p[2]), p[4].decode("utf-8", "replace").rstrip("\0")) for p in (parts[i : i + 5] for i in range(0, len(parts) - 4, 5))]


def defs_bytes(defs: list[tuple[int, int, str]]) -> bytes:
    """(tag, type, name) triples as a definition list; index -1."""
    out = b""
    for tag, kind, name in defs:
        raw = name.encode()
        out += ints_bytes([tag, kind, -1, len(raw)]) + bytes([len(raw)]) + raw
    return out


def named(attrs: list[tuple[int, str, bytes]]) -> list[Attr]:
    """Attribute 51 and the attributes that it names, numbered from 2001: (type, name, value)."""
    defs = Attr(0x80, DEFS, defs_bytes([(2001 + i, t, n) for i, (t, n, _) in enumerate(attrs)]))
    return [defs, *(Attr(0x80, 2001 + i, v) for i, (_, _, v) in enumerate(attrs))]


def reference(v: bytes) -> tuple[int, int] | None:
    """(entry number, length) of a reference value; other fields do not matter."""
    try:
        parts = tlv_elements(v)
    except Corrupt:
        return None
    n, size = find_number(parts, v, 0x81), find_number(parts, v, 0x82)
    return None if n is None or size is None else (n & 0xFFFFFFFF, size)


def reference_bytes(entry: int, size: int, stored: int | None = None) -> bytes:
    out = element(0x81, number_bytes(entry)) + element(0x82, number_bytes(size))
    return out + (element(0x83, number_bytes(stored)) if stored is not None else b"")


def renumbered(v: bytes, entry: int) -> bytes:
    """The same reference to another entry; all its other fields stay."""
    return b"".join(element(0x81, number_bytes(entry)) if e.tag == 0x81 else v[e.start : e.end] for e in tlv_elements(v))


def references(records: list[Record]) -> list[tuple[int, int, int]]:
    """(record, attribute, entry number) of every reference."""
    return [(i, k, ref[0]) for i, r in enumerate(records) for k, a in enumerate(r.attrs) if a.cls & PRIVATE == PRIVATE and (ref := reference(a.value))]


def subtree_end(records: list[Record], i: int) -> int:
    """One past the last record below record ``i``."""
    return next((j for j in range(i + 1, len(records)) if records[j].depth <= records[i].depth), len(records))


def parents(records: list[Record]) -> list[int]:
    """Each record's parent by one pass with a stack; -1 at the root."""
    out: list[int] = []
    stack: list[int] = []
    for i, r in enumerate(records):
        while stack and records[stack[-1]].depth >= r.depth:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return out


__all__ = ["Attr", "Def", "Record", "find", "named", "parents", "parse", "parse_defs", "read", "reference", "reference_bytes", "references", "renumbered", "subtree_end", "write"]
