"""One document in memory: its tree, pages, objects and entries, and how it is written.

This runs inside a Python worker, one file at a time; everything between files is DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pagelake.functions import container as ct
from pagelake.functions import limits as lim
from pagelake.functions import records as rc
from pagelake.functions import text as tx
from pagelake.functions.errors import Corrupt, TooLarge, Unsupported
from pagelake.functions.records import Attr, Record, named
from pagelake.functions.tlv import check, ints, ints_bytes, number_bytes

#: Record kinds and their names.
ROOT, BINDER, PAGES, PAGE, PLACE, BINDER_LIST, BINDER_ITEM, ORIGINALS = 0xC013, 0xC014, 0x1303, 0x1301, 0x1302, 0x1401, 0x1402, 0x1306
CONTENT, TEXT, STICKY, OLE, SIGNATURE, PICTURE = 0x8010, 0x8011, 0x801A, 0x800F, 0x8043, 0x803F
RECT, ELLIPSE, LINE, STAMP = 0x803D, 0x803E, 0x803C, 0x8033
KIND_NAMES = {
    0x8010: "page", 0x8011: "text", 0x803C: "line", 0x803D: "rectangle", 0x803E: "ellipse", 0x803F: "picture", 0x8045: "shape", 0x800F: "object", 0x802E: "header/footer",
    0x8033: "date stamp", 0x801A: "sticky note", 0x801B: "marker", 0x8042: "polygon", 0x8040: "received stamp", 0xC02F: "link", 0x8043: "signature",
}
#: Page size where none is stored, 1/100 mm.
DEFAULT_W, DEFAULT_H = 21000, 29700


def kind_name(kind: int) -> str:
    return KIND_NAMES.get(kind, "annotation")


@dataclass
class PageObject:
    place: int
    record: int
    kind: int
    kind_name: str
    x: int
    y: int
    w: int
    h: int
    rotation: int
    text: str | None


@dataclass
class Page:
    record: int
    w: int
    h: int
    objects: list[PageObject]


@dataclass
class Pending:
    body: bytes
    picture: bool = False


@dataclass
class BinderDoc:
    record: int
    name: str
    first_page: int
    pages: int


@dataclass
class Document:
    raw: bytes
    container: ct.Container
    entries: list[ct.Entry]
    records: list[Record]
    pending: list[Pending] = field(default_factory=list)

    @classmethod
    def open(cls, raw: bytes) -> Document:
        c = ct.parse(raw)
        d = cls(raw, c, ct.entries(raw, c.trailer), rc.parse(c.expanded_properties()))
        n = sum(r.kind == PAGE for r in d.records)
        if n > lim.current().maxPages:
            raise TooLarge("maxPages", f"{n}")
        return d

    # entries

    def body(self, n: int) -> bytes | None:
        """Entry ``n``: the file's own, or one added since it was opened."""
        if n < len(self.entries):
            return self.entries[n].body
        k = n - len(self.entries)
        return self.pending[k].body if k < len(self.pending) else None

    def data(self, n: int) -> bytes | None:
        """What an entry holds, expanded where it is compressed; a raw body as it is."""
        body = self.body(n)
        return None if body is None else body_data(body)

    def add_entry(self, body: bytes, picture: bool = False) -> bytes:
        """Keep a new entry; returns the reference to it."""
        self.pending.append(Pending(body, picture))
        return rc.reference_bytes(len(self.entries) + len(self.pending) - 1, len(body))

    def is_picture_entry(self, n: int) -> bool:
        if n < len(self.entries):
            return any(i == n for i, _ in self.container.trailer.checks)
        return self.pending[n - len(self.entries)].picture

    # attributes

    def defs(self, i: int) -> list[rc.Def]:
        """A record's definitions, stored in it or in an entry of their own."""
        a = self.records[i].get(rc.DEFS)
        if a is None:
            return []
        if a.cls & rc.PRIVATE != rc.PRIVATE:
            return rc.parse_defs(a.value)
        ref = rc.reference(a.value)
        data = self.data(ref[0]) if ref else None
        return rc.parse_defs(data) if data is not None else []

    def named(self, i: int, name: str) -> Attr | None:
        d = next((d for d in self.defs(i) if d.name == name), None)
        return self.records[i].get(d.tag) if d else None

    def named_ints(self, i: int, name: str) -> list[int]:
        a = self.named(i, name)
        return ints(a.value) if a else []

    # pages

    def below(self, i: int) -> range:
        return range(i + 1, rc.subtree_end(self.records, i))

    def _text_of(self, k: int) -> str | None:
        kind = self.records[k].kind
        at = k if kind == TEXT else next((m for m in self.below(k) if self.records[m].kind == TEXT), None) if kind == STICKY else None
        if at is None:
            return None
        if a := self.named(at, "%Text(w"):
            return tx.utf16_trimmed(a.value)
        a = self.named(at, "%Text")
        return tx.sjis_decode(a.value) if a else None

    def _object(self, place: int) -> PageObject | None:
        r = self.records
        k = next((k for k in self.below(place) if r[k].depth == r[place].depth + 1), None)
        if k is None:
            return None
        at, size, dim = r[place].ints(rc.POSITION), r[k].ints(rc.SIZE), self.named_ints(place, "childdim")
        pick = lambda v, i: v[i] if len(v) > i else None
        w, h = (next((x for x in (pick(dim, i), pick(size, i)) if x is not None), 0) for i in (0, 1))
        return PageObject(place, k, r[k].kind, kind_name(r[k].kind), pick(at, 0) or 0, pick(at, 1) or 0, w, h, (r[k].ints(rc.ROTATION) or [0])[0], self._text_of(k))

    def pages(self) -> list[Page]:
        out = []
        for i, r in enumerate(self.records):
            if r.kind == PAGE:
                size = r.ints(rc.SIZE)
                places = [j for j in self.below(i) if self.records[j].depth == r.depth + 1 and self.records[j].kind == PLACE]
                objects = [o for j in places if (o := self._object(j))]
                out.append(Page(i, size[0] if size else DEFAULT_W, size[1] if len(size) > 1 else DEFAULT_H, objects))
        return out

    # binders and signatures

    @property
    def is_binder(self) -> bool:
        return bool(self.records) and self.records[0].kind == BINDER

    @property
    def is_signed(self) -> bool:
        return any(r.kind == SIGNATURE for r in self.records)

    def binder_name(self) -> str | None:
        if not self.is_binder:
            return None
        a = self.records[0].get(rc.NAME)
        return tx.name_decode(a.value) if a else ""

    def doc_name(self, i: int) -> str:
        if a := self.records[i].get(rc.NAME_WIDE):
            return tx.utf16_cut(a.value)
        a = self.records[i].get(rc.NAME)
        return tx.name_decode(a.value) if a else ""

    def binder_docs(self) -> list[BinderDoc]:
        if not self.is_binder:
            return []
        pages, out, after = [i for i, r in enumerate(self.records) if r.kind == PAGE], [], 0
        for i, r in enumerate(self.records):
            if i and r.kind == ROOT:
                end = rc.subtree_end(self.records, i)
                mine = [k for k, p in enumerate(pages) if i < p < end]
                out.append(BinderDoc(i, self.doc_name(i), mine[0] if mine else after, len(mine)))
                after = out[-1].first_page + len(mine)
        return out

    def signatures(self) -> list[dict]:
        out = []
        for i, r in enumerate(self.records):
            if r.kind == SIGNATURE:
                module, version = self.named(i, "%smin"), self.named(i, "%sigver")
                name = tx.sjis_decode(module.value) if module else ""
                out.append({"module": name, "version": tx.sjis_decode(version.value) if version else None, "stamp": "電子印鑑" in name or "Stamp" in name})
        return out

    # drawings

    def drawing(self, i: int) -> bytes | None:
        """The body of an object's drawing: inline, or of the entry referred to."""
        a = self.records[i].get(rc.DRAWING)
        if a is None:
            return None
        if a.cls & rc.PRIVATE == rc.PRIVATE:
            ref = rc.reference(a.value)
            return self.body(ref[0]) if ref else None
        return a.value

    def pictures(self, i: int) -> list[bytes]:
        """The pictures that an object's drawing uses: attributes 301 to 400, then the ``#pd`` ones by index."""
        a = self.records[i].get(rc.PICTURES)
        n = int.from_bytes(a.value[:4], "little") if a else 0
        defs = self.defs(i) if n > 100 else []
        more = {d.index: d.tag for d in reversed(defs) if d.name == "#pd"}
        out = []
        for k in range(1, min(n, 100 + len(more)) + 1):
            got = self.records[i].get(rc.PICTURES + k) if k <= 100 else self.records[i].get(more.get(k, -1))
            ref = rc.reference(got.value) if got else None
            if ref:
                out.append(self.data(ref[0]) or b"")
        return out

    # writing

    def fresh_parts(self) -> tuple[list[Record], list[bytes], list[tuple[int, int]], dict[int, int]]:
        """The tree with references renumbered densely, the entries it uses, their picture checks, old to new numbers."""
        refs, total = rc.references(self.records), len(self.entries) + len(self.pending)
        if wrong := next((n for *_, n in refs if n >= total), None):
            raise Corrupt(f"a reference to entry {wrong}, but there are {total}")
        new = {old: k for k, old in enumerate(sorted({n for *_, n in refs}))}
        parts, checks = [], []
        own = dict(self.container.trailer.checks)
        for old, k in new.items():
            if old < len(self.entries):
                e = self.entries[old]
                parts.append(self.raw[e.at : e.at + e.len])
                if old in own:
                    checks.append((k, own[old]))
            else:
                p = self.pending[old - len(self.entries)]
                parts.append(ct.entry_element(p.body))
                if p.picture:
                    checks.append((k, check(p.body)))
        tree = [Record(r.depth, r.kind_raw, [Attr(a.cls, a.tag, a.value) for a in r.attrs]) for r in self.records]
        for i, k, old in refs:
            if new[old] != old:
                tree[i].attrs[k].value = rc.renumbered(tree[i].attrs[k].value, new[old])
        return tree, parts, checks, new

    def save_fresh(self) -> bytes:
        """The document anew with only what it uses, read back and compared."""
        tree, parts, checks, _ = self.fresh_parts()
        t = self.container.trailer
        out = self.container.header + ct.segment(len(self.container.header), [], parts, checks, tree, t.tag, t.unknown82)
        back = Document.open(out)
        if back.records != tree or [self_.body for self_ in back.entries] != [ct.parse_entry(p, 0).body for p in parts] or len(ct.segments(out)) != 1:
            raise Corrupt("the saved file does not read back the same")
        return out

    def pending_parts(self) -> tuple[list[Record], list[Pending]]:
        """The tree and the new entries still in use, numbered after the file's own."""
        base, refs = len(self.entries), rc.references(self.records)
        used = sorted({n for *_, n in refs if n >= base})
        if used and used[-1] >= base + len(self.pending):
            raise Corrupt(f"a reference to entry {used[-1]}")
        new = {old: base + k for k, old in enumerate(used)}
        tree = [Record(r.depth, r.kind_raw, [Attr(a.cls, a.tag, a.value) for a in r.attrs]) for r in self.records]
        for i, k, old in refs:
            if new.get(old, old) != old:
                tree[i].attrs[k].value = rc.renumbered(tree[i].attrs[k].value, new[old])
        return tree, [self.pending[n - base] for n in used]

    def save_append(self) -> bytes:
        """One more segment at the end of the file, as signed documents need it."""
        tree, new = self.pending_parts()
        t, base = self.container.trailer, len(self.entries)
        checks = [*t.checks, *((base + k, check(p.body)) for k, p in enumerate(new) if p.picture)]
        out = self.raw + ct.segment(len(self.raw), t.offsets, [ct.entry_element(p.body) for p in new], checks, tree, t.tag, t.unknown82)
        back = Document.open(out)
        if back.records != tree or len(back.entries) != base + len(new):
            raise Corrupt("the saved file does not read back the same")
        return out

    def save(self) -> tuple[bytes, str]:
        return (self.save_append(), "append") if self.is_signed else (self.save_fresh(), "fresh")

    def verify(self) -> dict:
        """Check values of the properties and of the entries that carry one, and the tree's round trip."""
        t = self.container.trailer
        bad = [i for i, e in enumerate(self.entries) if e.check is not None and e.check != check(e.body)]
        plain = self.container.expanded_properties()
        return {"properties_ok": t.check == check(self.container.properties), "bad_entries": bad, "round_trip": rc.write(rc.parse(plain)) == plain}


def body_data(body: bytes) -> bytes | None:
    from pagelake.functions import lzh

    is_fields, kind, fields, data = ct.parse_body(body)
    if not is_fields:
        return body
    if data is None:
        return None
    n = ct.needs_expand(kind, fields.get(0x8A), fields.get(0x81), len(data))
    return data if n is None else lzh.decompress(data, n)


def content_of(body: bytes) -> tuple[int | None, bytes | None]:
    """(kind, expanded data) of a drawing's field list."""
    is_fields, kind, _, _ = ct.parse_body(body)
    return (kind, body_data(body)) if is_fields else (None, None)


def record(depth: int, kind: int, *attrs: Attr) -> Record:
    return Record(depth, number_bytes(kind), list(attrs))


def ints_attr(tag: int, *values: float) -> Attr:
    return Attr(0x80, tag, ints_bytes([round_half_away(v) for v in values]))


def round_half_away(v: float) -> int:
    return int(v + 0.5) if v >= 0 else -int(-v + 0.5)


def blank_tree(w: float, h: float, pages: int = 1) -> list[Record]:
    if not (1000 <= w <= 500_000 and 1000 <= h <= 500_000):
        raise Unsupported(f"page size {w} x {h}")
    last = lambda n: named([(2, "lastmid", ints_bytes([n]))])
    out = [record(0, ROOT), record(1, PAGES, *last(pages))]
    out += [record(2, PAGE, *last(0), ints_attr(rc.SIZE, w, h), ints_attr(rc.NUMBER, k + 1)) for k in range(pages)]
    return out + [record(1, 0x1304), record(1, ORIGINALS), record(1, 0x1305)]


def write_tree(tree: list[Record], kind: int = ROOT, entries: list[bytes] = ()) -> bytes:
    head = ct.header(kind)
    return head + ct.segment(len(head), [], [ct.entry_element(b) for b in entries], [], tree, ct.TRAILER, b"\0")


def blank(w: float = DEFAULT_W, h: float = DEFAULT_H, pages: int = 1) -> Document:
    """A new document of blank pages."""
    return Document.open(write_tree(blank_tree(w, h, pages)))
