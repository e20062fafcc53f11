"""Edits of one document: annotations, pages, binders, and scripts of them.

Each takes a Document and changes its tree; files are independent, so a script runs as one Python call
for each file (see edit_files). Bulk forms of the same edits over tables are in bulk_edits.
"""

from __future__ import annotations

import json

from pagelake.functions import records as rc
from pagelake.functions import text as tx
from pagelake.functions.errors import Corrupt, Unsupported
from pagelake.functions.records import Attr, Record, named
from pagelake.functions.tlv import ints, ints_bytes, number_bytes
from pagelake.sources import model as md
from pagelake.sources.model import Document, PageObject, ints_attr, record

#: Margins and sizes of annotations, 1/100 mm; line height in ems.
MARGIN, LINE_HEIGHT, STAMP_SIZE, STICKY_PAD, STICKY_SHADOW = 170.0, 1.25, 1800.0, 300.0, 50.0
FACE, FACE_WIDE, NO_BACKGROUND = "ＭＳ ゴシック", "MS Gothic", 65793
MARK = "%picture_mark"


def colorref(rgb: int) -> int:
    """0xRRGGBB and 0x00BBGGRR, either way."""
    return (rgb & 0xFF) << 16 | rgb & 0xFF00 | rgb >> 16 & 0xFF


def text_box(text: str, size: float) -> tuple[float, float]:
    em, lines = size * 2540 / 72, text.split("\n")
    return max(map(tx.advance, lines)) * em + 2 * MARGIN, len(lines) * em * LINE_HEIGHT + 2 * MARGIN


def sticky_box(text: str, size: float) -> tuple[float, float]:
    w, h = text_box(text, size)
    around = 2 * STICKY_PAD + STICKY_SHADOW
    return max(w + around, 3000.0), max(h + around, 1500.0)


def box_size(shape: dict, w: float, h: float) -> tuple[float, float]:
    if w <= 0 or h <= 0:
        match shape["type"]:
            case "text":
                return text_box(shape["text"], shape.get("size", 12.0))
            case "sticky":
                return sticky_box(shape["text"], shape.get("size", 12.0))
            case "stamp":
                return STAMP_SIZE, STAMP_SIZE
    return max(w, 100.0), max(h, 100.0)


def draw_mode(frame: bool, fill: bool) -> int:
    return 2 if frame and fill else 1 if fill else 0


def stamp_date(year: int, month: int, day: int) -> str:
    return f"'{year % 100:02d}.{month:02d}.{day:02d}"


def stamp_parts(date: str) -> tuple[str, str, str, str]:
    """(prefix, year, month, day) of ``'yy.mm.dd`` or ``yyyy.m.d``."""
    prefix, rest = ("'", date[1:]) if date[:1] in ("'", "’") else ("", date)
    year, month, day = (rest.split(".") + ["", "", ""])[:3]
    return prefix, year, month, day


def _color(c: int | None, otherwise: int) -> int:
    return otherwise if c is None else colorref(c)


def _num(name: str, *v: float) -> tuple[int, str, bytes]:
    return 2, name, ints_bytes([md.round_half_away(x) for x in v])


def _settings(shape: dict, w: float, h: float) -> tuple[int, list[tuple[int, str, bytes]]]:
    kind, get = shape["type"], shape.get
    if kind == "text":
        t, z = shape["text"], lambda s: tx.sjis_encode(s) + b"\0"
        frame, back = get("frame"), get("background")
        return md.TEXT, [
            (4, "%Face", z(FACE)), _num("%PitchAndFamily", 17), _num("%CharSet", 128), _num("%hidden", 0), _num("%Style", int(bool(get("bold")))), _num("%Size", get("size", 12.0) * 10), _num("%Color", _color(get("color", 0), 0)),
            _num("%ATTR_BKGND_COLOR", _color(back, NO_BACKGROUND)), _num("%Turnover", 0), _num("%TextBetweenLine", 100), _num("%TextVerticalWriting", 0), _num("%TextRotationAngle", 0), (107, "%NoRotateTextDim", ints_bytes([round(w), round(h)])),
            _num("%AutoResizeHeight", 0), _num("%Spacing", 0), _num("%LeftMargin", MARGIN), _num("%TopMargin", MARGIN), _num("%RightMargin", MARGIN), _num("%BottomMargin", MARGIN), _num("%Align", 0), _num("%BkGndPermeable", 0),
            _num("%FrameOnOff", int(frame is not None)), (4, "%Face(w", tx.utf16_value(FACE_WIDE)), _num("%CCP_%Face", 932), _num("%CCP_#name", 932), (4, "%Text(w", tx.utf16_value(t)), (4, "%Text", z(t)), _num("%FrameColor", _color(frame, 0)),
        ]
    if kind in ("rect", "ellipse"):
        p, stroke, fill = ("RECTATT_", "ARCATT_")[kind == "ellipse"], get("stroke"), get("fill")
        return (md.RECT, md.ELLIPSE)[kind == "ellipse"], [
            _num(p + "LINE", 0), _num(p + "THICK", max(1.0, get("width", 1.0))), _num(p + "LINECOLOR", _color(stroke, 0)), _num(p + "DRAW", draw_mode(stroke is not None, fill is not None)), _num(p + "RECTCOLOR", _color(fill, 0xFFFFFF)),
            _num("ATTR_FRAMETRANSPARENT", 0), _num("ATTR_FILLTRANSPARENT", int(bool(get("highlight")))),
        ]
    if kind == "line":
        points = b"".join(md.round_half_away(v).to_bytes(4, "little", signed=True) for p in shape["points"] for v in p)
        return md.LINE, [_num("LINE_COLOR", colorref(get("color", 0))), _num("LINE_WIDTH", max(1.0, get("width", 1.0))), _num("LINE_STYLE", 0), _num("ARROW_SORT", 0), (4, "LINE_DATA", points)]
    if kind == "stamp":
        prefix, year, month, day = stamp_parts(get("date", ""))
        z = lambda s: tx.sjis_encode(s) + b"\0"
        out = [_num("STAMPATT_COLOR", colorref(get("color", 0xE60012))), _num("STAMPATT_TRANSPARENT", 0)]
        for name, s in (("STAMPATT_POST", get("top", "")), ("STAMPATT_NAME", get("bottom", ""))):
            out += [(4, name, z(s)), (4, name + "(w", tx.utf16_value(s)), _num("%CCP_" + name, 932)]
        out += [_num("STAMPATT_DATEFLAG", 1), _num("STAMPATT_ERA", 0), _num("STAMPATT_BASEYEAR", 0), (4, "STAMPATT_PREFIX", z(prefix)), (4, "STAMPATT_DATEFORMAT", z("yy.mm.dd")), _num("STAMPATT_DATEORDER", 0)]
        return md.STAMP, out + [(4, "STAMPATT_YEAR", z(year)), (4, "STAMPATT_MONTH", z(month)), (4, "STAMPATT_DAY", z(day))]
    raise Unsupported(f"shape {kind}")


def object_records(depth: int, number: int, shape: dict, w: float, h: float) -> list[Record]:
    """The records of an annotation; a sticky note holds a text annotation."""
    from pagelake.functions.emf_writer import drawing_of

    look = Attr(0xA0, rc.DRAWING, drawing_of(shape, w, h))
    if shape["type"] == "sticky":
        inner = {"type": "text", "text": shape["text"], "size": shape.get("size", 12.0), "color": shape.get("color", 0)}
        tw, th = text_box(inner["text"], inner["size"])
        place = place_record(depth + 1, STICKY_PAD, STICKY_PAD, tw, th)
        place.kind_raw = number_bytes(md.STICKY)
        note = named([_num("FSN_COLOR", colorref(shape.get("background", 0xFFFF64))), _num("%AutoResize", 0), _num("lastmid", 1)])
        return [record(depth, md.STICKY, ints_attr(rc.SIZE, w, h), *note, ints_attr(rc.NUMBER, number), look), place, *object_records(depth + 2, 1, inner, tw, th)]
    kind, settings = _settings(shape, w, h)
    return [record(depth, kind, *named(settings), ints_attr(rc.NUMBER, number), ints_attr(rc.SIZE, w, h), look)]


def place_record(depth: int, x: float, y: float, w: float, h: float, sticky: bool = False) -> Record:
    dim = named([(107, "childdim", ints_bytes([md.round_half_away(w), md.round_half_away(h)]))])
    return record(depth, md.PLACE, *([ints_attr(54, 1)] if sticky else []), ints_attr(rc.POSITION, x, y), *dim)


def next_number(d: Document, i: int, below: int) -> int:
    """The next free number among the records ``below`` levels under record ``i``, kept in its lastmid."""
    tag = next((x.tag for x in d.defs(i) if x.name == "lastmid"), None)
    taken = [d.records[k].ints(rc.NUMBER)[0] for k in d.below(i) if d.records[k].depth == d.records[i].depth + below and d.records[k].ints(rc.NUMBER)]
    n = max([0, *taken, *(d.records[i].ints(tag)[:1] if tag else [])]) + 1
    if tag is None:
        defs = [(x.tag, x.type, x.name) for x in d.defs(i)]
        tag = max([2000, *(t for t, *_ in defs)]) + 1
        d.records[i].set(rc.DEFS, rc.defs_bytes([*defs, (tag, 2, "lastmid")]))
    d.records[i].set(tag, ints_bytes([n]))
    return n


def _page(d: Document, page: int) -> md.Page:
    pages = d.pages()
    if not 0 <= page < len(pages):
        raise Unsupported(f"no page {page + 1}")
    return pages[page]


def _object(d: Document, page: int, obj: int) -> PageObject:
    objects = _page(d, page).objects
    if not 0 <= obj < len(objects):
        raise Unsupported(f"no object {obj} on page {page + 1}")
    return objects[obj]


def add_annotation(d: Document, page: int, x: float, y: float, w: float, h: float, shape: dict) -> int:
    w, h = box_size(shape, w, h)
    p = _page(d, page)
    number = next_number(d, p.record, 2)
    at, depth = rc.subtree_end(d.records, p.record), d.records[p.record].depth
    d.records[at:at] = [place_record(depth + 1, x, y, w, h, shape["type"] == "sticky"), *object_records(depth + 2, number, shape, w, h)]
    return len(p.objects)


def change_annotation(d: Document, page: int, obj: int, x: float, y: float, w: float, h: float, shape: dict) -> None:
    o = _object(d, page, obj)
    if o.kind == md.CONTENT:
        raise Unsupported("the page content cannot be changed")
    w, h = box_size(shape, w, h)
    number, depth = (d.records[o.record].ints(rc.NUMBER) or [1])[0], d.records[o.place].depth
    d.records[o.place : rc.subtree_end(d.records, o.place)] = [place_record(depth, x, y, w, h, shape["type"] == "sticky"), *object_records(depth + 1, number, shape, w, h)]


def move_object(d: Document, page: int, obj: int, x: float, y: float) -> None:
    o = _object(d, page, obj)
    if o.kind in (md.CONTENT, md.SIGNATURE):
        raise Unsupported("page content and signatures cannot be moved")
    d.records[o.place].set(rc.POSITION, ints_attr(0, x, y).value)


def delete_object(d: Document, page: int, obj: int) -> None:
    o = _object(d, page, obj)
    if o.kind in (md.CONTENT, md.SIGNATURE):
        raise Unsupported("page content and signatures cannot be deleted")
    del d.records[o.place : rc.subtree_end(d.records, o.place)]


def rotate_page(d: Document, page: int, quarters: int) -> None:
    """Clockwise; boxes move with the page and objects turn in them."""
    for _ in range(quarters % 4):
        p = _page(d, page)
        d.records[p.record].set(rc.SIZE, ints_bytes([p.h, p.w]))
        for o in p.objects:
            place, own = d.records[o.place], d.records[o.record]
            place.set(rc.POSITION, ints_bytes([p.h - (o.y + o.h), o.x]))
            tag = next((x.tag for x in d.defs(o.place) if x.name == "childdim"), 2001)
            place.set(tag, ints_bytes([o.h, o.w]))
            if len(own.ints(rc.SIZE)) == 2:
                own.set(rc.SIZE, ints_bytes(own.ints(rc.SIZE)[::-1]))
            own.set(rc.ROTATION, ints_bytes([((own.ints(rc.ROTATION) or [0])[0] + 90) % 360]))


def list_of(d: Document, i: int) -> int | None:
    """The page list that holds page record ``i``."""
    up = next((j for j in range(i - 1, -1, -1) if d.records[j].depth < d.records[i].depth), None)
    return up if up is not None and d.records[up].kind == md.PAGES else None


def _in_list(d: Document, i: int) -> int:
    return sum(list_of(d, p.record) == list_of(d, i) for p in d.pages())


def delete_page(d: Document, page: int) -> None:
    p = _page(d, page)
    if len(d.pages()) <= 1:
        raise Unsupported("a document needs at least one page")
    if _in_list(d, p.record) <= 1:
        raise Unsupported("the last page of a binder document")
    del d.records[p.record : rc.subtree_end(d.records, p.record)]


def move_page(d: Document, source: int, target: int) -> None:
    """After the target when moving down, before it when moving up."""
    if source == target:
        return
    a, b = _page(d, source).record, _page(d, target).record
    if d.records[a].depth != d.records[b].depth:
        raise Unsupported("pages of different documents in a binder")
    crossing = list_of(d, a) != list_of(d, b)
    if crossing and _in_list(d, a) <= 1:
        raise Unsupported("the last page of a binder document cannot leave it")
    end = rc.subtree_end(d.records, a)
    to = rc.subtree_end(d.records, b) if target > source else b
    block = d.records[a:end]
    del d.records[a:end]
    if to >= end:
        to -= end - a
    d.records[to:to] = block
    if crossing and (up := list_of(d, to)) is not None:
        n = next_number(d, up, 1)
        d.records[to].set(rc.NUMBER, ints_bytes([n]))


def _insert_page(d: Document, at: int, block: list[Record]) -> int:
    pages = d.pages()
    if not pages:
        raise Unsupported("the document has no pages")
    beside = pages[at].record if at < len(pages) else pages[-1].record
    up = list_of(d, beside)
    if up is None:
        raise Unsupported("page without page list")
    number = next_number(d, up, 1)
    to = beside if at < len(pages) else rc.subtree_end(d.records, beside)
    shift = d.records[up].depth + 1 - block[0].depth
    for r in block:
        r.depth += shift
    block[0].set(rc.NUMBER, ints_bytes([number]))
    d.records[to:to] = block
    return min(at, len(pages))


def insert_blank_page(d: Document, at: int, w: float, h: float) -> int:
    return _insert_page(d, at, [record(0, md.PAGE, ints_attr(rc.SIZE, w, h), ints_attr(rc.NUMBER, 0), *named([(2, "lastmid", ints_bytes([0]))]))])


def _imported(d: Document, source: Document, block: list[Record], known: dict[int, int]) -> list[Record]:
    """Copies whose entries are copied too, each once; a reference keeps all its other fields."""
    out = []
    for r in block:
        attrs = []
        for a in r.attrs:
            value, ref = a.value, rc.reference(a.value) if a.cls & rc.PRIVATE == rc.PRIVATE else None
            if ref:
                if ref[0] not in known:
                    body = source.body(ref[0])
                    if body is None:
                        raise Corrupt(f"entry {ref[0]} is missing")
                    d.add_entry(body, source.is_picture_entry(ref[0]))
                    known[ref[0]] = len(d.entries) + len(d.pending) - 1
                value = rc.renumbered(value, known[ref[0]])
            attrs.append(Attr(a.cls, a.tag, value))
        out.append(Record(r.depth, r.kind_raw, attrs))
    return out


def insert_pages_from(d: Document, at: int, source: Document, which: list[int]) -> int:
    known: dict[int, int] = {}
    at = min(at, len(d.pages()))
    for n, k in enumerate(which):
        p = _page(source, k)
        _insert_page(d, at + n, _imported(d, source, source.records[p.record : rc.subtree_end(source.records, p.record)], known))
    return len(which)


def _holder(d: Document, k: int) -> int:
    docs = d.binder_docs()
    if not 0 <= k < len(docs):
        raise Unsupported(f"no document {k + 1} in the binder")
    at = docs[k].record
    up = next((j for j in range(at - 1, -1, -1) if d.records[j].depth < d.records[at].depth), None)
    if up is None or d.records[up].kind != md.BINDER_ITEM:
        raise Unsupported("binder document without its holder")
    return up


def rename_binder_doc(d: Document, k: int, name: str) -> None:
    _holder(d, k)
    r = d.records[d.binder_docs()[k].record]
    r.set(rc.NAME, tx.sjis_encode(name.strip()) + b"\0")
    if r.get(rc.NAME_WIDE):
        r.set(rc.NAME_WIDE, tx.utf16_value(name.strip()))


def delete_binder_doc(d: Document, k: int) -> None:
    if len(d.binder_docs()) <= 1:
        raise Unsupported("a binder needs at least one document")
    at = _holder(d, k)
    del d.records[at : rc.subtree_end(d.records, at)]


def move_binder_doc(d: Document, source: int, target: int) -> None:
    n = len(d.binder_docs())
    if source == target or not 0 <= target < n:
        return
    a = _holder(d, source)
    block = d.records[a : rc.subtree_end(d.records, a)]
    del d.records[a : a + len(block)]
    to = rc.subtree_end(d.records, _holder(d, n - 2)) if target >= n - 1 else _holder(d, target)
    d.records[to:to] = block


def add_binder_docs(d: Document, at: int, source: Document, name: str) -> int:
    """A document, or all documents of a binder; the first may be renamed."""
    if not d.is_binder:
        raise Unsupported("not a binder")
    up = next((i for i, r in enumerate(d.records) if r.kind == md.BINDER_LIST), None)
    if up is None:
        raise Unsupported("binder without document list")
    if source.is_binder:
        parts = [(x.record, x.name) for x in source.binder_docs()]
    elif source.records and source.records[0].kind == md.ROOT:
        parts = [(0, name)]
    else:
        raise Unsupported("the other file is not a document")
    docs = d.binder_docs()
    wide = any(d.records[x.record].get(rc.NAME_WIDE) for x in docs)
    to = _holder(d, at) if at < len(docs) else rc.subtree_end(d.records, up)
    known: dict[int, int] = {}
    for k, (start, old) in enumerate(parts):
        block = _imported(d, source, source.records[start : rc.subtree_end(source.records, start)], known)
        shift = d.records[up].depth + 2 - block[0].depth
        for r in block:
            r.depth += shift
        new = name.strip() if k == 0 and name.strip() else old
        block[0].set(rc.NAME, tx.sjis_encode(new) + b"\0")
        if wide:
            block[0].set(rc.NAME_WIDE, tx.utf16_value(new))
        block[0].set(rc.NUMBER, ints_bytes([next_number(d, up, 2)]))
        block.insert(0, record(d.records[up].depth + 1, md.BINDER_ITEM))
        d.records[to:to] = block
        to += len(block)
    return len(parts)


def shape_of(d: Document, page: int, obj: int) -> dict | None:
    """An annotation's settings as a shape; None for what has none that can be edited."""
    o = _object(d, page, obj)
    i = o.record
    one = lambda name, other=None: (d.named_ints(i, name) or [other])[0]
    if o.kind == md.TEXT:
        back = one("%ATTR_BKGND_COLOR", NO_BACKGROUND)
        return {"type": "text", "text": o.text or "", "size": one("%Size", 120) / 10, "color": colorref(one("%Color", 0)), "bold": bool(one("%Style", 0) & 1), "background": None if back == NO_BACKGROUND else colorref(back), "frame": colorref(one("%FrameColor", 0)) if one("%FrameOnOff", 0) else None}
    if o.kind == md.STICKY:
        t = next((m for m in d.below(i) if d.records[m].kind == md.TEXT), None)
        of = lambda name, other: (d.named_ints(t, name) or [other])[0] if t is not None else other
        return {"type": "sticky", "text": o.text or "", "size": of("%Size", 120) / 10, "color": colorref(of("%Color", 0)), "background": colorref(one("FSN_COLOR", 0x64FFFF))}
    if o.kind in (md.RECT, md.ELLIPSE):
        p = "RECTATT_" if o.kind == md.RECT else "ARCATT_"
        mode = one(p + "DRAW", 0)
        out = {"type": "rect" if o.kind == md.RECT else "ellipse", "stroke": None if mode == 1 else colorref(one(p + "LINECOLOR", 0)), "width": float(one(p + "THICK", 1)), "fill": colorref(one(p + "RECTCOLOR", 0xFFFFFF)) if mode in (1, 2) else None}
        return out | ({"highlight": bool(one("ATTR_FILLTRANSPARENT", 0))} if o.kind == md.RECT else {})
    if o.kind == md.LINE:
        a = d.named(i, "LINE_DATA")
        v = [int.from_bytes(a.value[k : k + 4], "little", signed=True) for k in range(0, len(a.value) // 8 * 8, 4)] if a else []
        return {"type": "line", "points": [list(map(float, p)) for p in zip(v[::2], v[1::2])], "color": colorref(one("LINE_COLOR", 0)), "width": float(one("LINE_WIDTH", 1))}
    if o.kind == md.STAMP:
        s = lambda name: (tx.utf16_cut(a.value) if (a := d.named(i, name + "(w")) else tx.sjis_decode(b.value) if (b := d.named(i, name)) else "")
        return {"type": "stamp", "top": s("STAMPATT_POST"), "date": s("STAMPATT_PREFIX") + ".".join(s("STAMPATT_" + x) for x in ("YEAR", "MONTH", "DAY")), "bottom": s("STAMPATT_NAME"), "color": colorref(one("STAMPATT_COLOR", colorref(0xE60012)))}
    return None


def set_attr(d: Document, i: int, tag: int, value: str) -> None:
    """Raw attribute edits: ``hex:``, ``u16:``, ``int:`` values, or ``del``."""
    r = d.records[i]
    if value == "del":
        r.drop(tag)
    elif value.startswith("hex:"):
        r.set(tag, bytes.fromhex(value[4:]))
    elif value.startswith("u16:"):
        r.set(tag, tx.utf16_value(value[4:]))
    elif value.startswith("int:"):
        r.set(tag, ints_bytes([int(x) for x in value[4:].split(",")]))
    else:
        raise Unsupported(f"value {value}")


def run_script(d: Document, script: str | list[dict], files: dict[str, bytes] | None = None) -> Document:
    """The operations of a JSON list, in order; an unknown one is an error."""
    other = lambda name: Document.open((files or {})[name])
    for op in json.loads(script) if isinstance(script, str) else script:
        g = op.get
        match g("op"):
            case "add":
                add_annotation(d, g("page", 0), g("x", 0), g("y", 0), g("w", 0), g("h", 0), op["shape"])
            case "change":
                change_annotation(d, g("page", 0), op["obj"], g("x", 0), g("y", 0), g("w", 0), g("h", 0), op["shape"])
            case "move":
                move_object(d, g("page", 0), op["obj"], g("x", 0), g("y", 0))
            case "delete":
                delete_object(d, g("page", 0), op["obj"])
            case "rotate":
                rotate_page(d, g("page", 0), g("q", 1))
            case "blank_page":
                insert_blank_page(d, g("at", 0), g("w", md.DEFAULT_W), g("h", md.DEFAULT_H))
            case "delete_page":
                delete_page(d, g("page", 0))
            case "move_page":
                move_page(d, op["from"], op["to"])
            case "copy_pages":
                insert_pages_from(d, g("at", 0), other(op["file"]), op["pages"])
            case "binder_add":
                add_binder_docs(d, g("at", 0), other(op["file"]), g("name", ""))
            case "binder_rename":
                rename_binder_doc(d, op["doc"], op["name"])
            case "binder_delete":
                delete_binder_doc(d, op["doc"])
            case "binder_move":
                move_binder_doc(d, op["from"], op["to"])
            case "image_page" | "picture" | "set_picture":
                from pagelake.operators import pictures

                pictures.apply(d, op, files or {})
            case unknown:
                raise Unsupported(f"operation {unknown}")
    return d


def named_values(d: Document, i: int) -> dict[str, list[int] | str]:
    """All named attributes of a record, by name."""
    return {x.name: ints(a.value) if x.type in (2, 107) else a.value.hex() for x in d.defs(i) if (a := d.records[i].get(x.tag))}
