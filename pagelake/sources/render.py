"""Pages of a document as displays."""

from __future__ import annotations

import math
import struct

from pagelake.functions import dib, limits
from pagelake.functions.covered import page_text, remove_covered
from pagelake.functions.drawing import Display, Matrix, apply, compose, f32, render_emf, scale
from pagelake.functions.errors import DocumentError
from pagelake.functions.wmf import is_wmf, render_wmf
from pagelake.sources.model import CONTENT, Document, Page, PageObject, content_of


def place(d: Display, first: int, m: Matrix) -> None:
    """Move an object's items: points, widths, dashes, sizes, angles, pictures, and their clips."""
    k, turn = scale(m), math.degrees(math.atan2(-m[1], m[0]))
    move = lambda path: [(op, *(f32(c) for i in range(0, len(v), 2) for c in apply(m, v[i], v[i + 1]))) for op, *v in path]
    clips: dict[int, int] = {0: 0}
    for it in d.items[first:]:
        if "path" in it:
            it["path"] = move(it["path"])
        if it["kind"] == "stroke":
            it["width"], it["dash"] = f32(it["width"] * k), [f32(v * k) for v in it["dash"]]
        elif it["kind"] == "text":
            x, y = apply(m, it["x"], it["y"])
            it |= {"x": f32(x), "y": f32(y), "angle": f32(it["angle"] + turn), "size": f32(it["size"] * k), "xs": [f32(v * k) for v in it["xs"]]}
        elif it["kind"] == "image":
            it["m"] = [f32(v) for v in compose(m, it["m"])]
        if it["clip"] not in clips:
            clips[it["clip"]] = d.clip_id([move(p) for p in d.clips[it["clip"]]])
        it["clip"] = clips[it["clip"]]


def render_object(doc: Document, o: PageObject, d: Display, number: int) -> None:
    body = doc.drawing(o.record)
    if body is None:
        d.skipped.append(f"{o.kind_name} without drawing")
        return
    kind, data = content_of(body)
    if data is None:
        d.skipped.append(f"{o.kind_name}: drawing not readable")
        return
    turn = o.rotation % 360
    w, h = (o.h, o.w) if turn in (90, 270) else (o.w, o.h)
    first = len(d.items)
    if kind in (1, 4) and is_wmf(data):
        render_wmf(data, (w, h), d, doc.pictures(o.record))
    elif kind in (1, 4) and data[40:44] == b" EMF":
        render_emf(data, (w, h), d, doc.pictures(o.record), o.kind != CONTENT)
    elif kind in (1, 5, 7):
        picture = dib.external(data)
        if picture is None:
            d.skipped.append(f"{o.kind_name}: picture not readable")
        else:
            d.images.append(picture)
            d.items.append({"kind": "image", "image": len(d.images) - 1, "m": [w, 0.0, 0.0, h, 0.0, 0.0], "clip": 0, "alpha": 1.0, "mul": False})
    else:
        d.skipped.append(f"{o.kind_name}: drawing kind {kind}")
    m: Matrix = {90: (0, 1, -1, 0, o.x + o.w, o.y), 180: (-1, 0, 0, -1, o.x + o.w, o.y + o.h), 270: (0, -1, 1, 0, o.x, o.y + o.h)}.get(turn, (1, 0, 0, 1, o.x, o.y))
    place(d, first, m)
    for it in d.items[first:]:
        it["object"] = number


def render_page(doc: Document, page: Page, include_hidden: bool = False) -> Display:
    """One page within the limits of its own scope; covered text is left out unless asked for."""
    d = Display(page.w, page.h)
    with limits.scope(limits.current()):
        for n, o in enumerate(page.objects):
            if limits.over():
                break
            try:
                render_object(doc, o, d, n)
            except (struct.error, IndexError, ValueError) as e:
                d.skipped.append(f"{o.kind_name}: {e}")
        if not include_hidden:
            remove_covered(d)
    return d


def document_text(doc: Document, include_hidden: bool = False) -> list[str]:
    """The text of every page; a page that cannot be read is empty."""
    out = []
    for p in doc.pages():
        try:
            out.append(page_text(render_page(doc, p, include_hidden)))
        except DocumentError:
            out.append("")
    return out
