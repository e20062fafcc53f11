"""Drawings of annotations as enhanced metafiles: a window of 300 units to the inch over the box."""

from __future__ import annotations

import math
import struct

from pagelake.functions import lzh
from pagelake.functions import text as tx
from pagelake.functions.tlv import element, number_bytes

UNIT = 2540 / 300


def units(v: float) -> int:
    """1/100 mm to drawing units."""
    r = v / UNIT
    return int(math.floor(r + 0.5)) if r >= 0 else -int(math.floor(-r + 0.5))


def colorref(rgb: int) -> int:
    return (rgb & 0xFF) << 16 | rgb & 0xFF00 | rgb >> 16 & 0xFF


class Emf:
    def __init__(self, w: float, h: float):
        self.w, self.h, self.body, self.count, self.handles = w, h, [], 1, 1
        self.put(17, "<i", 8)  # anisotropic
        self.put(10, "<ii", 0, 0)
        self.put(9, "<ii", max(1, units(w)), max(1, units(h)))
        self.put(18, "<i", 1)  # transparent background

    def put(self, kind: int, form: str = "", *v, tail: bytes = b"") -> None:
        data = (struct.pack(form, *v) if form else b"") + tail
        data += b"\0" * (-len(data) % 4)
        self.body.append(struct.pack("<II", kind, 8 + len(data)) + data)
        self.count += 1

    def handle(self) -> int:
        self.handles += 1
        return self.handles - 1

    def pen(self, rgb: int | None, width: float = 1.0) -> None:
        n = self.handle()
        self.put(38, "<IIiiI", n, 5 if rgb is None else 0, max(1, units(width)), 0, colorref(rgb or 0))
        self.put(37, "<I", n)

    def brush(self, rgb: int | None) -> None:
        n = self.handle()
        self.put(39, "<IIII", n, 1 if rgb is None else 0, colorref(rgb or 0), 0)
        self.put(37, "<I", n)

    def box(self, kind: int, x: float, y: float, w: float, h: float) -> None:
        """Rectangle (43) or ellipse (42)."""
        self.put(kind, "<iiii", units(x), units(y), units(x + w), units(y + h))

    def poly(self, kind: int, points: list[tuple[float, float]]) -> None:
        """Polygon (3) or polyline (4)."""
        flat = [units(v) for p in points for v in p]
        xs, ys = flat[::2], flat[1::2]
        self.put(kind, f"<iiiiI{len(flat)}i", min(xs), min(ys), max(xs), max(ys), len(points), *flat)

    def font(self, size: float, bold: bool = False) -> None:
        n = self.handle()
        face = "ＭＳ ゴシック".encode("utf-16-le").ljust(64, b"\0")
        head = struct.pack("<iiiiiBBBBBBBB", -max(1, units(size)), 0, 0, 0, 700 if bold else 400, 0, 0, 0, 128, 0, 0, 0, 17)
        self.put(82, "<I", n, tail=head + face + b"\0" * (320 - len(head) - len(face)))
        self.put(37, "<I", n)

    def text(self, x: float, y: float, line: str, em: float, rgb: int) -> None:
        """One line from its baseline, with the advance of every UTF-16 unit."""
        self.put(24, "<I", colorref(rgb))
        self.put(22, "<I", 24)
        raw = line.encode("utf-16-le")
        n, steps = len(raw) // 2, []
        at = 0.0
        for c in line:
            new = at + tx.advance(c) * em
            steps.append(units(new) - units(at))
            steps += [0] * (ord(c) > 0xFFFF)
            at = new
        padded = raw + b"\0" * (-len(raw) % 4)
        self.put(84, "<iiiiIffiiIIIiiiiI", 0, 0, -1, -1, 1, 1.0, 1.0, units(x), units(y), n, 76, 0, 0, 0, -1, -1, 76 + len(padded), tail=padded + struct.pack(f"<{n}i", *steps))

    def bitmap(self, x: float, y: float, w: float, h: float, info: bytes, bits: bytes, pw: int, ph: int, rop: int = 0xCC0020) -> None:
        self.put(81, "<iiiiiiiiiiIIIIIIii", 0, 0, -1, -1, units(x), units(y), 0, 0, pw, ph, 80, len(info), 80 + len(info), len(bits), 0, rop, units(w), units(h), tail=info + bits)

    def done(self) -> bytes:
        self.put(14, "<III", 0, 16, 20)
        body = b"".join(self.body)
        w, h = int(self.w), int(self.h)
        head = struct.pack("<II4i4i4sIIIHHIIIii ii III ii".replace(" ", ""), 1, 108, 0, 0, units(w), units(h), 0, 0, w, h, b" EMF", 0x10000, 108 + len(body), self.count, self.handles, 0, 0, 0, 0, 4960, 7016, 210, 297, 0, 0, 0, 210_000, 297_000)
        return head + body


def draw(shape: dict, w: float, h: float) -> bytes:
    """The metafile of a shape in a w x h box."""
    from pagelake.operators.edits import LINE_HEIGHT, MARGIN, STICKY_PAD, STICKY_SHADOW

    e, get, kind = Emf(w, h), shape.get, shape["type"]

    def lines(x: float, y: float, text: str, size: float, rgb: int, bold: bool = False) -> None:
        em = size * 2540 / 72
        e.font(em, bold)
        for k, line in enumerate(text.split("\n")):
            if line.strip():
                e.text(x, y + k * em * LINE_HEIGHT + 0.88 * em, line, em, rgb)

    if kind == "text":
        if get("background") is not None or get("frame") is not None:
            e.pen(get("frame"), 20)
            e.brush(get("background"))
            e.box(43, 0, 0, w, h)
        lines(MARGIN, MARGIN, shape["text"], get("size", 12.0), get("color", 0), bool(get("bold")))
    elif kind == "sticky":
        e.pen(None)
        e.brush(0x999999)
        e.box(43, STICKY_SHADOW, STICKY_SHADOW, w - STICKY_SHADOW, h - STICKY_SHADOW)
        e.pen(0x666666, 10)
        e.brush(get("background", 0xFFFF64))
        e.box(43, 0, 0, w - STICKY_SHADOW, h - STICKY_SHADOW)
        lines(STICKY_PAD + MARGIN, STICKY_PAD + MARGIN, shape["text"], get("size", 12.0), get("color", 0))
    elif kind in ("rect", "ellipse"):
        if get("highlight"):
            e.put(20, "<i", 9)
        stroke, width = get("stroke"), max(1.0, get("width", 1.0))
        e.pen(stroke, width)
        e.brush(get("fill"))
        pad = width / 2 if stroke is not None else 0
        e.box(43 if kind == "rect" else 42, pad, pad, w - 2 * pad, h - 2 * pad)
    elif kind == "line":
        e.pen(get("color", 0), max(1.0, get("width", 1.0)))
        e.poly(4, [tuple(p) for p in shape["points"]])
    elif kind == "stamp":
        rgb = get("color", 0xE60012)
        e.pen(rgb, 40)
        e.brush(None)
        e.box(42, 20, 20, w - 40, h - 40)
        for y in (h / 3, 2 * h / 3):
            inset = w / 2 - math.sqrt(max(0.0, (w / 2) ** 2 - (h / 2 - y) ** 2))
            e.poly(4, [(inset, y), (w - inset, y)])
        for k, s in enumerate((get("top", ""), get("date", ""), get("bottom", ""))):
            if s.strip():
                em = min(h * 0.2, 0.72 * w / max(tx.advance(s), 0.5))
                e.font(em)
                e.text((w - tx.advance(s) * em) / 2, h * (2 * k + 1) / 6 + 0.35 * em, s, em, rgb)
    return e.done()


def drawing_body(emf: bytes, w: float, h: float) -> bytes:
    """An inline drawing: compressed, which its size shows, without a flag."""
    stored = lzh.compress(emf)
    out = element(0x80, b"\x04") + element(0x81, number_bytes(len(emf)))
    for tag, v in ((0x84, round(w)), (0x85, round(h)), (0x8D, 1), (0x90, max(1, units(w))), (0x91, max(1, units(h)))):
        out += element(tag, number_bytes(v))
    return out + element(0x89, number_bytes(len(stored))) + element(0x86, stored)


def drawing_of(shape: dict, w: float, h: float) -> bytes:
    return drawing_body(draw(shape, w, h), w, h)
