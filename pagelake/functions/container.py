"""Files of segments: finding the state in effect, its entries, and writing segments."""

from __future__ import annotations

from dataclasses import dataclass, field

from pagelake.functions import limits, lzh, records
from pagelake.functions.errors import Corrupt, DocumentError, NotADocument, Protected, TooLarge
from pagelake.functions.tlv import Element, check, element, elements, field_number, find, find_number, number_bytes, read, signed32_bytes, words

#: Element tags.
HEADER, SEGMENT, PROPERTIES, ENTRY, TRAILER_OLD, PROPERTIES_SEALED, ENTRY_SEALED, TRAILER = 0x60, 0x61, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68


@dataclass
class Trailer:
    at: int
    tag: int
    count: int
    offsets: list[int]
    checks: list[tuple[int, int]]
    unknown82: bytes
    expanded: int
    stored: int
    check: int


@dataclass
class Segment:
    at: int
    end: int
    entries: list[int] = field(default_factory=list)
    properties: tuple[int, int] | None = None
    trailer: int | None = None


@dataclass
class Entry:
    at: int
    len: int
    check: int | None
    body: bytes
    is_fields: bool = False
    kind: int | None = None
    fields: dict[int, int | None] = field(default_factory=dict)
    data: bytes | None = None

    @property
    def expanded_size(self) -> int | None:
        if self.data is None:
            return None
        return needs_expand(self.kind, self.fields.get(0x8A), self.fields.get(0x81), len(self.data))

    def expanded(self) -> bytes | None:
        n = self.expanded_size
        return self.data if n is None else lzh.decompress(self.data, n)


@dataclass
class Container:
    size: int
    generation: int | None
    header: bytes
    trailer: Trailer
    properties: bytes  # as stored

    def expanded_properties(self) -> bytes:
        return lzh.decompress(self.properties, self.trailer.expanded)


def needs_expand(kind: int | None, flag: int | None, size: int | None, stored: int) -> int | None:
    """The expanded size where stored data is compressed: flagged so, or unflagged, not a thumbnail, and smaller."""
    if size is None:
        return None
    return size if flag == 1 or (kind != 7 and flag is None and size > stored) else None


def find_trailer(b: bytes) -> Trailer:
    """The last four bytes tell how long the trailer's value is."""
    value = len(b) - int.from_bytes(b[-4:], "little")
    if value < 0:
        raise Corrupt("trailer length past the start of the file")
    for head in range(2, 7):
        at = value - head
        if at < 0:
            break
        if b[at] in (TRAILER, TRAILER_OLD):
            try:
                t = read(b, at)
            except DocumentError:
                continue
            if t.value == value and t.end == len(b):
                return _trailer(b, t)
    raise NotADocument("no trailer at the end of the file")


def _trailer(b: bytes, t: Element) -> Trailer:
    f = elements(b, t.value, t.end)
    words_of = lambda tag: words(e.of(b)) if (e := find(f, tag)) else []
    pairs = words_of(0x8D)
    e82 = find(f, 0x82)
    n = lambda tag: (find_number(f, b, tag) or 0) & 0xFFFFFFFF
    return Trailer(t.start, t.tag, n(0x80), words_of(0x81), list(zip(pairs[::2], pairs[1::2])), e82.of(b) if e82 else b"", n(0x83), n(0x84), n(0x85))


def is_protected(b: bytes, t: Trailer) -> bool:
    if t.offsets and t.offsets[0] < len(b) and b[t.offsets[0]] == ENTRY_SEALED:
        return True
    return _before(b, t, PROPERTIES_SEALED) is not None


def _before(b: bytes, t: Trailer, tag: int) -> Element | None:
    """The element of ``tag`` and the stored size that ends where the trailer begins."""
    for head in range(2, 7):
        start = t.at - t.stored - head
        if start >= 0 and b[start] == tag:
            try:
                e = read(b, start)
            except DocumentError:
                continue
            if e.end == t.at and (tag != PROPERTIES or e.len == t.stored):
                return e
    return None


def parse(b: bytes) -> Container:
    most = limits.current().maxBytes
    if len(b) > most:
        raise TooLarge("maxBytes", f"{len(b)}")
    if len(b) < 24 or b[0] != HEADER:
        raise NotADocument("does not start with the header")
    head = read(b, 0)
    generation = find_number(elements(b, head.value, head.end), b, 0x82)
    trailer = find_trailer(b)
    if is_protected(b, trailer):
        raise Protected("protected by a password or certificate")
    p = _before(b, trailer, PROPERTIES)
    if p is None:
        raise Corrupt("properties block not found before the trailer")
    return Container(len(b), generation, b[: head.end], trailer, p.of(b))


def segments(b: bytes) -> list[Segment]:
    """The history of saves, read leniently: recorded lengths may be short or run past the file."""
    out: list[Segment] = []
    try:
        at = read(b, 0).end
    except DocumentError:
        return out
    while at + 2 <= len(b):
        try:
            t = read(b, at, 1 << 62)
        except DocumentError:
            break
        end = min(t.end, len(b))
        if t.tag != SEGMENT:
            if t.tag == 0 and t.len == 0:
                break
            at = t.end
            continue
        seg, j = Segment(at, t.end), t.value
        last = j
        while j < len(b):
            try:
                c = read(b, j)
            except DocumentError:
                break
            if c.tag == ENTRY:
                seg.entries.append(c.start)
            elif c.tag == PROPERTIES:
                seg.properties = (c.value, c.len)
            elif c.tag in (TRAILER, TRAILER_OLD):
                seg.trailer = c.start
            else:
                break
            j = last = c.end
            if c.tag in (TRAILER, TRAILER_OLD) or j >= t.end:
                break
        seg.end = max(seg.end, last)
        out.append(seg)
        at = max(last, end)
    return out


def parse_body(body: bytes) -> tuple[bool, int | None, dict[int, int | None], bytes | None]:
    """(is a field list, kind, fields, data): a list where the first byte is 0x80 and all of it parses."""
    if body[:1] == b"\x80":
        try:
            parts = elements(body)
        except DocumentError:
            return False, None, {}, None
        fields: dict[int, int | None] = {}
        for e in parts:
            fields.setdefault(e.tag, None if e.tag == 0x86 else field_number(e.of(body)))
        data = find(parts, 0x86)
        return True, fields.get(0x80), fields, data.of(body) if data else None
    return False, None, {}, None


def parse_entry(b: bytes, at: int) -> Entry:
    t = read(b, at)
    if t.tag != ENTRY:
        raise Corrupt(f"no entry at {at}")
    f = elements(b, t.value, t.end)
    c, body = find_number(f, b, 0x81), find(f, 0x82)
    if body is None:
        raise Corrupt("entry without a body")
    raw = body.of(b)
    return Entry(at, t.end - at, None if c is None else c & 0xFFFFFFFF, raw, *parse_body(raw))


def entries(b: bytes, t: Trailer) -> list[Entry]:
    return [parse_entry(b, o) for o in t.offsets]


def entry_element(body: bytes) -> bytes:
    return element(ENTRY, element(0x81, signed32_bytes(check(body))) + element(0x82, body))


def content_body(kind: int, fields: list[tuple[int, int]], data: bytes, compress: bool = True) -> bytes:
    """An entry's field list around ``data``."""
    stored = lzh.compress(data) if compress else data
    out = element(0x80, number_bytes(kind)) + (element(0x81, number_bytes(len(data))) if compress else b"")
    out += b"".join(element(t, number_bytes(v)) for t, v in fields)
    return out + (element(0x8A, b"\x01") if compress else b"") + element(0x89, number_bytes(len(stored))) + element(0x86, stored)


def header(kind: int, generation: int = 10) -> bytes:
    #: Fixed value: the last field, as every known file has it.
    return element(HEADER, element(0x82, bytes([generation])) + element(0x80, number_bytes(kind)) + element(0x83, b"\x01\x0d\x0a\x01"))


def trailer_element(tag: int, unknown82: bytes, offsets: list[int], checks: list[tuple[int, int]], expanded: int, stored: bytes) -> bytes:
    v = element(0x80, number_bytes(len(offsets)))
    if offsets:
        v += element(0x81, b"".join(x.to_bytes(4, "little") for x in offsets))
    if checks:
        v += element(0x8D, b"".join(i.to_bytes(4, "little") + c.to_bytes(4, "little") for i, c in checks))
    v += element(0x82, unknown82 or b"\0") + element(0x83, number_bytes(expanded)) + element(0x84, number_bytes(len(stored))) + element(0x85, signed32_bytes(check(stored)))
    return element(tag, v + element(0x86, (len(v) + 6).to_bytes(4, "little")))


def segment(start: int, prior: list[int], new: list[bytes], checks: list[tuple[int, int]], tree: list[records.Record], tag: int, unknown82: bytes) -> bytes:
    """One segment at file offset ``start``. The entry offsets depend on the length of its own head, found by trial."""
    expanded = records.write(tree)
    stored = lzh.compress(expanded)
    middle = b"".join(new) + element(PROPERTIES, stored)
    for head in (4, 5, 6, 2, 3):
        offsets, at = list(prior), start + head
        for e in new:
            offsets.append(at)
            at += len(e)
        body = middle + trailer_element(tag, unknown82, offsets, checks, len(expanded), stored)
        out = element(SEGMENT, body)
        if len(out) - len(body) == head:
            return out
    raise DocumentError("segment too large")
