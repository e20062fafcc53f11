"""Drawing records to display items.

An interpreter keeps a device context (mapping, transform, pen, brush, font, text settings, clip, path)
and turns records into items in 1/100 mm of the object's box: fills, strokes, texts and images.
Coordinates of items are rounded to 32-bit floats. Unknown records are named in ``skipped``.
"""

from __future__ import annotations

import copy
import math
import struct
from dataclasses import dataclass, field

import numpy as np

from pagelake.functions import dib, limits
from pagelake.functions import text as tx
from pagelake.functions.errors import DocumentError

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def f32(v: float) -> float:
    return float(np.float32(v))


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def compose(outer: Matrix, inner: Matrix) -> Matrix:
    """First ``inner``, then ``outer``."""
    a, b, c, d, e, f = inner
    return outer[0] * a + outer[2] * b, outer[1] * a + outer[3] * b, outer[0] * c + outer[2] * d, outer[1] * c + outer[3] * d, *apply(outer, e, f)


def scale(m: Matrix) -> float:
    return math.sqrt(abs(m[0] * m[3] - m[1] * m[2]))


def scale_y(m: Matrix) -> float:
    return math.hypot(m[2], m[3])


@dataclass
class Display:
    w: float = 0.0
    h: float = 0.0
    items: list[dict] = field(default_factory=list)
    clips: list[list] = field(default_factory=lambda: [[]])  # clip 0: none
    images: list[dict] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    hidden_chars: int = 0

    def clip_id(self, paths: list) -> int:
        """Equal clips share a number."""
        if not paths:
            return 0
        for i, c in enumerate(self.clips):
            if c == paths:
                return i
        self.clips.append(paths)
        return len(self.clips) - 1


@dataclass
class State:
    world: Matrix = IDENTITY
    mode: int = 1
    window: tuple[float, float] = (0, 0)
    window_size: tuple[float, float] = (1, 1)
    view: tuple[float, float] = (0, 0)
    view_size: tuple[float, float] = (1, 1)
    pen: dict = field(default_factory=lambda: {"style": 0, "width": 0, "color": 0})
    brush: dict = field(default_factory=lambda: {"style": 0, "color": 0xFFFFFF})
    font: dict = field(default_factory=lambda: {"height": -12, "escapement": 0, "charset": 0, "face": "", "bold": False})
    text_color: int = 0
    back_color: int = 0xFFFFFF
    back_mode: int = 2
    align: int = 0
    even_odd: bool = True
    rop: int = 13
    at: tuple[float, float] = (0, 0)
    clip: list = field(default_factory=list)


def rgb(c: int) -> int:
    return (c & 0xFF) << 16 | c & 0xFF00 | c >> 16 & 0xFF


#: Stock objects.
STOCK = {
    0x80000000: ("brush", {"style": 0, "color": 0xFFFFFF}), 0x80000001: ("brush", {"style": 0, "color": 0xC0C0C0}), 0x80000002: ("brush", {"style": 0, "color": 0x808080}), 0x80000003: ("brush", {"style": 0, "color": 0x404040}),
    0x80000004: ("brush", {"style": 0, "color": 0}), 0x80000005: ("brush", {"style": 1, "color": 0}), 0x80000006: ("pen", {"style": 0, "width": 0, "color": 0xFFFFFF}), 0x80000007: ("pen", {"style": 0, "width": 0, "color": 0}),
    0x80000008: ("pen", {"style": 5, "width": 0, "color": 0}),
}


def arc_beziers(cx: float, cy: float, rx: float, ry: float, start: float, sweep: float) -> list[tuple]:
    """An arc as cubic pieces of at most a quarter turn; the sweep is held to two turns."""
    sweep = max(-4 * math.pi, min(4 * math.pi, sweep))
    n = max(1, math.ceil(abs(sweep) / (math.pi / 2) - 1e-9))
    step = sweep / n
    k = 4 / 3 * math.tan(step / 4)
    out = []
    for i in range(n):
        a, b = start + i * step, start + (i + 1) * step
        ca, sa, cb, sb = math.cos(a), math.sin(a), math.cos(b), math.sin(b)
        out.append((cx + rx * (ca - k * sa), cy + ry * (sa + k * ca), cx + rx * (cb + k * sb), cy + ry * (sb - k * cb), cx + rx * cb, cy + ry * sb))
    return out


def ellipse_path(x0: float, y0: float, x1: float, y1: float) -> list[tuple]:
    cx, cy, rx, ry = (x0 + x1) / 2, (y0 + y1) / 2, abs(x1 - x0) / 2, abs(y1 - y0) / 2
    return [("M", cx + rx, cy), *(("C", *p) for p in arc_beziers(cx, cy, rx, ry, 0.0, 2 * math.pi)), ("Z",)]


def rect_path(x0: float, y0: float, x1: float, y1: float) -> list[tuple]:
    return [("M", x0, y0), ("L", x1, y0), ("L", x1, y1), ("L", x0, y1), ("Z",)]


def dw_points(b: bytes, encoding: int) -> list[tuple[int, int]]:
    """Points of a driver path: u32 count, the first as two i16, the rest absolute or as steps."""
    if len(b) < 8:
        return []
    n = limits.fit(struct.unpack_from("<I", b)[0], len(b) - 4, 1)
    x, y = struct.unpack_from("<hh", b, 4)
    out, i = [(x, y)][:n], 8
    limits.points(n)
    while len(out) < n and i < len(b):
        if encoding & 0x20:
            if i + 4 > len(b):
                break
            x, y = struct.unpack_from("<hh", b, i)
            i += 4
        elif encoding & 0x40:
            if i + 2 > len(b):
                break
            dx, dy = struct.unpack_from("<bb", b, i)
            x, y, i = x + dx, y + dy, i + 2
        else:
            v, i = b[i], i + 1
            steps = []
            for nibble in (v >> 4, v & 15):
                if nibble == 8:
                    if i >= len(b):
                        return out
                    steps.append(struct.unpack_from("<b", b, i)[0])
                    i += 1
                else:
                    steps.append(nibble - 16 if nibble > 8 else nibble)
            x, y = x + steps[0], y + steps[1]
        out.append((x, y))
    return out


class Interpreter:
    """The parts that both metafile kinds share: state, mapping, painting."""

    def __init__(self, out: Display, base: Matrix, pictures: list[bytes]):
        self.out, self.base, self.pictures = out, base, list(pictures)
        self.s, self.saved, self.objects = State(), [], {}
        self.path: list | None = None
        self.closed_path: list = []
        self.driver_path: list = []
        self.picture: int | None = None
        self.next_picture = 0

    # mapping

    def to_device(self) -> Matrix:
        s = self.s
        if s.mode == 1:
            return (1, 0, 0, 1, s.view[0] - s.window[0], s.view[1] - s.window[1])
        if s.mode in (7, 8):
            sx = s.view_size[0] / s.window_size[0] if s.window_size[0] else 1.0
            sy = s.view_size[1] / s.window_size[1] if s.window_size[1] else 1.0
            if s.mode == 7:
                k = min(abs(sx), abs(sy))
                sx, sy = math.copysign(k, sx), math.copysign(k, sy)
        else:  # fixed units, y upwards
            unit = {2: 10.0, 3: 1.0, 4: 25.4, 5: 2.54, 6: 2540 / 1440}.get(s.mode, 10.0)
            sx, sy = unit / self.pixel[0], -unit / self.pixel[1]
        return (sx, 0, 0, sy, s.view[0] - s.window[0] * sx, s.view[1] - s.window[1] * sy)

    pixel = (1.0, 1.0)

    def matrix(self) -> Matrix:
        return compose(self.base, compose(self.to_device(), self.s.world))

    def map(self, path: list) -> list:
        m, out = self.matrix(), []
        for op, *v in path:
            out.append((op, *(f32(c) for i in range(0, len(v), 2) for c in apply(m, v[i], v[i + 1]))))
        return out

    # painting

    def emit(self, path: list, fill: bool, stroke: bool) -> None:
        if self.path is not None:
            self.path += path
            return
        if not path:
            return
        s = self.s
        limits.points(len(path))
        clip = self.out.clip_id(s.clip)
        mapped = self.map(path)
        if fill and s.brush["style"] != 1:
            limits.item()
            self.out.items.append({"kind": "fill", "path": mapped, "color": s.brush["color"], "even_odd": s.even_odd, "mul": s.rop == 9, "clip": clip})
        if stroke and s.pen["style"] & 15 != 5:
            limits.item()
            k = scale(self.matrix())
            width = max(s.pen["width"] * k, 10.0 if not s.pen["width"] else 0.0)
            dash = {1: [18, 6], 2: [3, 3], 3: [9, 6, 3, 6], 4: [9, 3, 3, 3, 3, 3]}.get(s.pen["style"] & 15, [])
            self.out.items.append({"kind": "stroke", "path": mapped, "color": s.pen["color"], "width": f32(width), "dash": [f32(d * max(width / 3, 10)) for d in dash], "mul": s.rop == 9, "clip": clip})

    def poly(self, points: list, close: bool, fill: bool = False) -> None:
        if points:
            self.emit([("M", *points[0]), *(("L", *p) for p in points[1:]), *([("Z",)] if close else [])], fill, True)

    def bezier(self, start: tuple, points: list) -> list:
        return [("M", *start)] * (start is not None) + [("C", *points[i], *points[i + 1], *points[i + 2]) for i in range(0, len(points) - 2, 3)]

    def select(self, n: int) -> None:
        kind, value = STOCK.get(n) or self.objects.get(n, (None, None))
        if kind:
            setattr(self.s, kind, value)

    def text(self, x: float, y: float, s: str, steps: list[float] | None) -> None:
        """Lay out one run: size from the font's height, the anchor moved along and across the turned baseline."""
        st = self.s
        if st.align & 1:
            x, y = st.at
        if not s:
            return
        font, m = st.font, self.matrix()
        height, face = font["height"], font["face"]
        cjk = font["charset"] in (128, 129, 134, 136) or any(ord(c) > 0x2E80 for c in face)
        em = -height if height < 0 else height / (1.0 if cjk else 1.15) if height else 12.0
        if steps is None or len(steps) != len(s):
            steps = [(0.5 if tx.half_width_drawn(c) else 1.0) * em for c in s]
        total, ascent = sum(steps), (0.88 if cjk else 0.9) * em
        along = {2: -total, 6: -total / 2}.get(st.align & 6, 0.0)
        down = {24: 0.0, 8: ascent - em}.get(st.align & 24, ascent)
        # the escapement turns against the clock as seen, also where the y axis points up
        turn, up = math.radians(font["escapement"] / 10), -1.0 if m[3] >= 0 else 1.0
        ux, uy = math.cos(turn), up * math.sin(turn)
        dx, dy = up * uy, -up * ux
        if st.align & 1:
            st.at = (x + ux * total, y + uy * total)
        if not s.strip():
            return
        limits.item()
        px, py = apply(m, x + ux * along + dx * down, y + uy * along + dy * down)
        k, at, xs = math.hypot(m[0], m[1]), 0.0, []
        for d in steps:
            xs.append(f32(at * k))
            at += d
        wide = 2.0 * abs(font.get("width", 0)) / em if font.get("width") and height else 1.0
        self.out.items.append({"kind": "text", "x": f32(px), "y": f32(py), "angle": f32(font["escapement"] / 10), "size": f32(em * scale_y(m)), "sx": f32(wide), "xs": xs, "text": s, "color": st.text_color, "bold": font["bold"], "vertical": face.startswith("@"), "clip": self.out.clip_id(st.clip)})

    def image(self, box: tuple[float, float, float, float], picture: dict | None, mul: bool = False, alpha: float = 1.0) -> None:
        if picture is None:
            self.out.skipped.append("picture not readable")
            return
        limits.item()
        self.out.images.append(picture)
        x, y, w, h = box
        m = compose(self.matrix(), (w, 0, 0, h, x, y))
        self.out.items.append({"kind": "image", "image": len(self.out.images) - 1, "m": [f32(v) for v in m], "clip": self.out.clip_id(self.s.clip), "alpha": alpha, "mul": mul})

    def raster(self, box: tuple, picture: dict | None, rop: int) -> None:
        """A picture under a raster operation; without one, a fill of the box."""
        if picture is None:
            color = {0x42: 0, 0xFF0062: 0xFFFFFF}.get(rop)
            if rop in BRUSH_ROPS and self.s.brush["style"] != 1 and not (rop == 0xA000C9 and self.s.brush["color"] == 0xFFFFFF):
                color = self.s.brush["color"]
            if color is not None:
                x, y, w, h = box
                self.out.items.append({"kind": "fill", "path": self.map(rect_path(x, y, x + w, y + h)), "color": color, "even_odd": False, "mul": False, "clip": self.out.clip_id(self.s.clip)})
            return
        rgba = picture.get("rgba")
        if rgba is not None and rop in (0x8800C6, 0xEE0086, 0x660046, 0x330008, 0xB8074A, 0xE20746):
            rgba = rgba.copy()
            if rop in (0xB8074A, 0xE20746):  # a mask through which the brush paints: its dark or its light part
                part = (rgba[..., 0] < 128) == (rop == 0xB8074A)
                rgba[part, :3] = [self.s.brush["color"] >> n & 0xFF for n in (16, 8, 0)]
                rgba[~part, 3] = 0
            if rop == 0x8800C6:
                rgba[(rgba[..., :3] >= 250).all(-1), 3] = 0
            elif rop == 0x330008:
                rgba[..., :3] = 255 - rgba[..., :3]
            elif rop in (0xEE0086, 0x660046):
                rgba[(rgba[..., :3] == 0).all(-1), 3] = 0
            picture = picture | {"rgba": rgba}
        self.image(box, picture, mul=rop == 0x8800C6)

    def driver(self, b: bytes) -> bool:
        """A comment of the printer driver; True when it was one."""
        if b[:2] != b"DW" or len(b) < 3:
            return False
        op = b[2]
        if op in b"abc":
            self._driver_picture(op, b)
        elif op == 2:
            self.driver_path = []
        elif op in (3, 6):
            if op == 6 and len(b) >= 19:
                self.s.clip = [self.map(rect_path(*struct.unpack_from("<4i", b, len(b) - 16)))]
            elif op == 3:
                self.s.clip = [self.map(self.driver_path)]
        elif op == 4:
            self.emit(self.driver_path, True, False)
        elif op == 5:
            self.emit(self.driver_path, False, True)
        elif len(b) > 4 and op != 1:
            points = [(float(x), float(y)) for x, y in dw_points(b[4:], b[3])]
            if not points:
                return True
            if op & 0x20 or op & 0x40:
                path = [("M", *points[0]), *(("L", *p) for p in points[1:])] + [("Z",)] * bool(op & 0x20)
                self.emit(path, bool(op & 0x20), bool(op & 0x40))
                return True
            part = [("M" if op & 1 else "L", *points[0])]
            part += self.bezier(None, points[1:]) if op & 0x10 else [("L", *p) for p in points[1:]]
            self.driver_path += part + [("Z",)] * bool(op & 2)
        return True

    def _driver_picture(self, op: int, b: bytes) -> None:
        if op == ord("b"):
            self.picture = self.next_picture
            self.next_picture += 1
        elif op == ord("c") and self.picture is not None and len(b) >= 3 + 60:
            v = struct.unpack_from("<15i", b, len(b) - 60)
            data = self.pictures[self.picture] if self.picture < len(self.pictures) else b""
            self.image((v[4], v[5], v[13], v[14]), dib.external(data), mul=v[12] & 0xFFFFFFFF == 0x8800C6)


#: Raster operations that fill a rectangle with the brush.
BRUSH_ROPS = {0xF00021, 0xA000C9, 0xFA0089, 0x5A0049}


class EmfReader(Interpreter):
    def __init__(self, data: bytes, box: tuple[float, float], out: Display, pictures: list[bytes] = (), annotation: bool = False):
        frame = struct.unpack_from("<4i", data, 24)
        device, mm = struct.unpack_from("<ii", data, 72), struct.unpack_from("<ii", data, 80)
        self.pixel = (100 * mm[0] / max(1, device[0]) or 1.0, 100 * mm[1] / max(1, device[1]) or 1.0)
        fw, fh = max(1, frame[2] - frame[0]), max(1, frame[3] - frame[1])
        px, py = self.pixel
        base: Matrix = (px * box[0] / fw, 0, 0, py * box[1] / fh, -frame[0] * box[0] / fw, -frame[1] * box[1] / fh)
        super().__init__(out, base, pictures)
        self.data, self.box = data, box
        self.annotation = annotation
        if annotation and (ext := self._first_window()):
            self.base = (box[0] / ext[0], 0, 0, box[1] / ext[1], 0, 0)
            self.fitted = True
        else:
            self.fitted = False

    def _records(self):
        at, data = 0, self.data
        while at + 8 <= len(data):
            kind, size = struct.unpack_from("<II", data, at)
            if size < 8 or at + size > len(data):
                break
            yield kind, data[at : at + size]
            if kind == 14:
                break
            at += size

    def _first_window(self) -> tuple[int, int] | None:
        for kind, r in self._records():
            if kind == 9 and len(r) >= 16:
                w, h = struct.unpack_from("<ii", r, 8)
                return (w, h) if w and h else None
        return None

    def to_device(self) -> Matrix:
        if self.fitted:  # the window is the box, whatever the mode
            return (1, 0, 0, 1, -self.s.window[0], -self.s.window[1])
        return super().to_device()

    def run(self) -> None:
        for kind, r in self._records():
            limits.record()
            if limits.over():
                break
            try:
                self.one(kind, r)
            except (struct.error, IndexError):
                self.out.skipped.append(f"record {kind} cut off")

    def points32(self, r: bytes, at: int = 24) -> list:
        n = limits.fit(struct.unpack_from("<I", r, at)[0], len(r) - at - 4, 8)
        limits.points(n)
        v = struct.unpack_from(f"<{2 * n}i", r, at + 4)
        return list(zip(v[::2], v[1::2]))

    def points16(self, r: bytes, at: int = 24) -> list:
        n = limits.fit(struct.unpack_from("<I", r, at)[0], len(r) - at - 4, 4)
        limits.points(n)
        v = struct.unpack_from(f"<{2 * n}h", r, at + 4)
        return list(zip(v[::2], v[1::2]))

    def one(self, kind: int, r: bytes) -> None:
        s, i4 = self.s, lambda k, n=1: struct.unpack_from(f"<{n}i", r, k)
        if kind in (2, 3, 4, 5, 6, 85, 86, 87, 88, 89):
            points = self.points16(r) if kind > 80 else self.points32(r)
            base = kind - 83 if kind > 80 else kind
            if not points:
                return
            if base == 2:
                self.emit(self.bezier(points[0], points[1:]), False, True)
            elif base == 3:
                self.poly(points, True, True)
            elif base == 4:
                self.poly(points, False)
            else:
                start = [] if self.path else [("M", *s.at)]
                part = self.bezier(None, points) if base == 5 else [("L", *p) for p in points]
                self.emit(start + part, False, True)
                s.at = points[-1]
        elif kind in (7, 8, 90, 91):
            wide, polygon = kind < 10, kind in (8, 91)
            n = limits.fit(i4(24)[0], len(r) - 32, 4)
            counts = struct.unpack_from(f"<{n}I", r, 32)
            at, size, form = 32 + 4 * n, 8 if wide else 4, "i" if wide else "h"
            path = []
            for c in counts:
                c = limits.fit(c, len(r) - at, size)
                limits.points(c)
                v = struct.unpack_from(f"<{2 * c}{form}", r, at)
                at += c * size
                p = list(zip(v[::2], v[1::2]))
                if p:
                    path += [("M", *p[0]), *(("L", *q) for q in p[1:])] + [("Z",)] * polygon
            self.emit(path, polygon, True)
        elif kind == 9:
            s.window_size = i4(8, 2)
        elif kind == 10:
            s.window = i4(8, 2)
        elif kind == 11:
            s.view_size = i4(8, 2)
        elif kind == 12:
            s.view = i4(8, 2)
        elif kind in (31, 32):
            a, b, c, d = i4(8, 4)
            old = s.view_size if kind == 31 else s.window_size
            new = (old[0] * a / (b or 1), old[1] * c / (d or 1))
            if kind == 31:
                s.view_size = new
            else:
                s.window_size = new
        elif kind == 17:
            s.mode = i4(8)[0]
        elif kind == 18:
            s.back_mode = i4(8)[0]
        elif kind == 19:
            s.even_odd = i4(8)[0] == 1
        elif kind == 20:
            s.rop = i4(8)[0]
        elif kind == 22:
            s.align = i4(8)[0]
        elif kind == 24:
            s.text_color = rgb(i4(8)[0] & 0xFFFFFF)
        elif kind == 25:
            s.back_color = rgb(i4(8)[0] & 0xFFFFFF)
        elif kind == 27:
            s.at = i4(8, 2)
            if self.path is not None:
                self.path.append(("M", *s.at))
        elif kind == 54:
            p = i4(8, 2)
            self.emit([("L", *p)] if self.path else [("M", *s.at), ("L", *p)], False, True)
            s.at = p
        elif kind == 30:
            s.clip = [*s.clip, self.map(rect_path(*i4(8, 4)))]
        elif kind == 33:
            self.saved.append(copy.deepcopy(s))
        elif kind == 34:
            n = i4(8)[0]
            keep = len(self.saved) + n if n < 0 else n - 1
            if 0 <= keep < len(self.saved):
                self.s = self.saved[keep]
                del self.saved[keep:]
        elif kind == 35:
            s.world = struct.unpack_from("<6f", r, 8)
        elif kind == 36:
            m, how = struct.unpack_from("<6f", r, 8), i4(32)[0]
            s.world = IDENTITY if how == 1 else compose(s.world, m) if how == 2 else compose(m, s.world) if how == 3 else m
        elif kind == 37:
            self.select(i4(8)[0] & 0xFFFFFFFF)
        elif kind == 38:
            n, style, w, _, c = struct.unpack_from("<IIiiI", r, 8)
            self.objects[n] = ("pen", {"style": style, "width": w, "color": rgb(c)})
        elif kind == 39:
            n, style, c = struct.unpack_from("<III", r, 8)
            self.objects[n] = ("brush", {"style": style, "color": rgb(c)})
        elif kind in (93, 94):
            self.objects[i4(8)[0]] = ("brush", {"style": 0, "color": 0x808080})
        elif kind == 95:
            n, style, w, brush, c = struct.unpack_from("<I16xIIII", r, 8)
            self.objects[n] = ("pen", {"style": style, "width": w, "color": rgb(c)})
        elif kind == 40:
            self.objects.pop(i4(8)[0], None)
        elif kind == 82:
            n, height, _, esc, _, weight = struct.unpack_from("<Iiiiii", r, 8)
            self.objects[n] = ("font", {"height": height, "width": struct.unpack_from("<i", r, 16)[0], "escapement": esc, "charset": r[35], "face": tx.utf16_cut(r[40:104]), "bold": weight >= 600})
        elif kind == 42:
            self.emit(ellipse_path(*i4(8, 4)), True, True)
        elif kind == 43:
            self.emit(rect_path(*i4(8, 4)), True, True)
        elif kind == 44:
            x0, y0, x1, y1, rw, rh = i4(8, 6)
            rx, ry = min(abs(rw) / 2, abs(x1 - x0) / 2), min(abs(rh) / 2, abs(y1 - y0) / 2)
            path = [("M", x0 + rx, y0)]
            for cx, cy, a in ((x1 - rx, y0 + ry, -math.pi / 2), (x1 - rx, y1 - ry, 0.0), (x0 + rx, y1 - ry, math.pi / 2), (x0 + rx, y0 + ry, math.pi)):
                path.append(("L", cx + rx * math.cos(a), cy + ry * math.sin(a)))
                path += [("C", *p) for p in arc_beziers(cx, cy, rx, ry, a, math.pi / 2)]
            self.emit([*path, ("Z",)], True, True)
        elif kind in (41, 45, 46, 47, 55):
            self._arc(kind, r)
        elif kind == 59:
            self.path = []
        elif kind == 60:
            self.closed_path, self.path = self.path or [], None
        elif kind == 61 and self.path:
            self.path.append(("Z",))
        elif kind in (62, 63, 64):
            path, self.closed_path = self.closed_path, []
            self.emit(path, kind != 64, kind != 62)
        elif kind == 67:
            path, how, self.closed_path = self.map(self.closed_path), i4(8)[0], []
            s.clip = [path] if how == 5 else [*s.clip, path]
        elif kind == 68:
            self.path, self.closed_path = None, []
        elif kind == 75:
            how = i4(12)[0]
            n = limits.fit(i4(24)[0] if len(r) >= 48 else 0, len(r) - 48, 16)
            path = [p for k in range(n) for p in rect_path(*struct.unpack_from("<4i", r, 48 + 16 * k))]
            if how == 5:
                s.clip = [self.map(path)] if path else []
            elif how == 1 and path:
                s.clip = [*s.clip, self.map(path)]
        elif kind == 70:
            n = limits.fit(i4(8)[0], len(r) - 12, 1)
            self.driver(r[12 : 12 + n])
        elif kind in (76, 77, 114, 116):
            x, y, w, h = i4(24, 4)
            rop = i4(40)[0] & 0xFFFFFFFF if kind < 100 else 0xCC0020
            info, ni, bits, nb = struct.unpack_from("<4I", r, 84)
            picture = dib.decode(r[info : info + ni], r[bits : bits + nb]) if ni else None
            alpha = r[42] / 255 if kind == 114 else 1.0
            if kind == 114 and picture:
                self.image((x, y, w, h), picture, alpha=alpha)
            else:
                self.raster((x, y, w, h), picture, rop)
        elif kind in (80, 81):
            x, y, sx, sy, sw, sh, info, ni, bits, nb, _, rop = struct.unpack_from("<iiiiiiIIIIII", r, 24) if kind == 81 else (*i4(24, 6), *struct.unpack_from("<5I", r, 48), 0xCC0020)
            w, h = i4(72, 2) if kind == 81 else (sw, sh)
            self.raster((x, y, w, h), dib.crop(dib.decode(r[info : info + ni], r[bits : bits + nb]), sx, sy, sw, sh), rop)
        elif kind in (83, 84):
            self._text(kind, r)
        elif kind in (56, 92):
            self._poly_draw(kind, r)
        elif kind not in IGNORED:
            self.out.skipped.append(f"record {kind}")

    def _arc(self, kind: int, r: bytes) -> None:
        if kind == 41:
            cx, cy = struct.unpack_from("<ii", r, 8)
            radius, start, sweep = struct.unpack_from("<Iff", r, 16)
            a, b = -math.radians(start), -math.radians(sweep)
            path = [("C", *p) for p in arc_beziers(cx, cy, radius, radius, a, b)]
            first = ("L" if self.path else "M", *self.s.at)
            self.emit([first, ("L", cx + radius * math.cos(a), cy + radius * math.sin(a)), *path], False, True)
            self.s.at = path[-1][-2:]
            return
        x0, y0, x1, y1, ax, ay, bx, by = struct.unpack_from("<8i", r, 8)
        cx, cy, rx, ry = (x0 + x1) / 2, (y0 + y1) / 2, abs(x1 - x0) / 2 or 1, abs(y1 - y0) / 2 or 1
        a, b = math.atan2((ay - cy) / ry, (ax - cx) / rx), math.atan2((by - cy) / ry, (bx - cx) / rx)
        sweep = b - a if b < a else b - a - 2 * math.pi  # against the clock, y downwards
        pieces = [("C", *p) for p in arc_beziers(cx, cy, rx, ry, a, sweep)]
        start = (cx + rx * math.cos(a), cy + ry * math.sin(a))
        if kind == 55:
            self.emit([("L" if self.path else "M", *self.s.at), ("L", *start), *pieces], False, True)
            self.s.at = pieces[-1][-2:]
            return
        path = [("M", *start), *pieces]
        self.emit(path + ([("L", cx, cy)] if kind == 47 else []) + ([("Z",)] if kind != 45 else []), kind != 45, True)

    def _text(self, kind: int, r: bytes) -> None:
        x, y, n, off, options = struct.unpack_from("<iiIII", r, 36)
        box, steps_at = struct.unpack_from("<4i", r, 56), struct.unpack_from("<I", r, 72)[0]
        n = limits.fit(n, max(0, len(r) - off), 1 if kind == 83 else 2)
        if options & 2 and box[2] > box[0] and box[3] > box[1]:
            self.out.items.append({"kind": "fill", "path": self.map(rect_path(*box)), "color": self.s.back_color, "even_odd": False, "mul": False, "clip": self.out.clip_id(self.s.clip)})
        if options & 0x10 and n:
            self.out.skipped.append("text by glyph numbers")
            return
        raw = r[off : off + n * (1 if kind == 83 else 2)]
        text = tx.sjis_decode(raw) if kind == 83 else raw.decode("utf-16-le", "replace")
        steps = None
        if steps_at and steps_at + 4 * n <= len(r):
            unit, steps, k = struct.unpack_from(f"<{n}i", r, steps_at), [], 0
            for c in text:  # an advance for each character, of the units that it takes
                width = len(tx.sjis_encode(c)) if kind == 83 else 2 if ord(c) > 0xFFFF else 1
                steps.append(float(sum(unit[k : k + width])))
                k += width
        self.text(x, y, text, steps)

    def _poly_draw(self, kind: int, r: bytes) -> None:
        points = self.points16(r) if kind == 92 else self.points32(r)
        types = r[28 + len(points) * (4 if kind == 92 else 8) :][: len(points)]
        path, i = [], 0
        while i < len(points) and i < len(types):
            t = types[i]
            if t & 6 == 6:
                path.append(("M", *points[i]))
            elif t & 4 and i + 2 < len(points):
                path.append(("C", *points[i], *points[i + 1], *points[i + 2]))
                i += 2
                t = types[i] if i < len(types) else t
            else:
                path.append(("L", *points[i]))
            if t & 1:
                path.append(("Z",))
            i += 1
        if path and path[0][0] != "M" and not self.path:
            path.insert(0, ("M", *self.s.at))
        self.emit(path, False, True)
        if points:
            self.s.at = points[-1]


#: Records without visible effect here.
IGNORED = {1, 13, 14, 15, 16, 21, 23, 26, 28, 29, 48, 49, 50, 51, 52, 53, 57, 58, 65, 66, *range(98, 114), 115, 117, 119, 120, 121, 122}


def render_emf(data: bytes, box: tuple[float, float], out: Display, pictures: list[bytes] = (), annotation: bool = False) -> None:
    if len(data) < 108 or data[40:44] != b" EMF":
        raise DocumentError("no metafile")
    EmfReader(data, box, out, pictures, annotation).run()
