"""Windows metafiles: 16-bit records over the same interpreter."""

from __future__ import annotations

import copy
import struct

from pagelake.functions import dib, limits
from pagelake.functions import text as tx
from pagelake.functions.drawing import Display, Interpreter, Matrix, ellipse_path, rect_path, rgb


def is_wmf(d: bytes) -> bool:
    return d[:4] == b"\xd7\xcd\xc6\x9a" or len(d) >= 18 and d[0] in (1, 2) and d[1] == 0 and d[2:4] == b"\x09\x00"


class WmfReader(Interpreter):
    def __init__(self, data: bytes, box: tuple[float, float], out: Display, pictures: list[bytes]):
        self.start = 22 if data[:4] == b"\xd7\xcd\xc6\x9a" else 0
        self.data, self.slots = data, []
        org, ext = (0, 0), None
        if self.start:
            x0, y0, x1, y1 = struct.unpack_from("<4h", data, 6)
            org, ext = (x0, y0), (x1 - x0, y1 - y0)
        for kind, r in self._records():
            if kind == 0x20B and len(r) >= 10:
                org = struct.unpack_from("<hh", r, 6)[::-1]
            elif kind == 0x20C and len(r) >= 10:
                ext = struct.unpack_from("<hh", r, 6)[::-1]
                break
        w, h = (ext[0] or 1, ext[1] or 1) if ext else (1, 1)
        base: Matrix = (box[0] / w, 0, 0, box[1] / h, 0, 0)
        super().__init__(out, base, pictures)
        self.s.window = org

    def to_device(self) -> Matrix:
        return (1, 0, 0, 1, -self.s.window[0], -self.s.window[1])

    def _records(self):
        at = self.start + 18
        while at + 6 <= len(self.data):
            words, kind = struct.unpack_from("<IH", self.data, at)
            if words < 3 or at + 2 * words > len(self.data) or kind == 0:
                break
            yield kind, self.data[at : at + 2 * words]
            at += 2 * words

    def run(self) -> None:
        for kind, r in self._records():
            limits.record()
            try:
                self.one(kind, r)
            except (struct.error, IndexError):
                self.out.skipped.append(f"record {kind:04x} cut off")

    def keep(self, kind: str, value: dict) -> None:
        """Objects take the first free slot."""
        n = next((i for i, x in enumerate(self.slots) if x is None), len(self.slots))
        self.slots[n : n + 1] = [(kind, value)]

    def points(self, r: bytes, at: int, n: int) -> list:
        n = limits.fit(n, len(r) - at, 4)
        limits.points(n)
        v = struct.unpack_from(f"<{2 * n}h", r, at)
        return list(zip(v[::2], v[1::2]))

    def one(self, kind: int, r: bytes) -> None:
        s = self.s
        i2 = lambda k, n=1: struct.unpack_from(f"<{n}h", r, k)
        if kind == 0x20B:
            s.window = i2(6, 2)[::-1]
        elif kind == 0x102:
            s.back_mode = i2(6)[0]
        elif kind == 0x201:
            s.back_color = rgb(struct.unpack_from("<I", r, 6)[0])
        elif kind == 0x209:
            s.text_color = rgb(struct.unpack_from("<I", r, 6)[0])
        elif kind == 0x12E:
            s.align = i2(6)[0]
        elif kind == 0x106:
            s.even_odd = i2(6)[0] == 1
        elif kind == 0x104:
            s.rop = i2(6)[0]
        elif kind == 0x1E:
            self.saved.append(copy.deepcopy(s))
        elif kind == 0x127:
            if self.saved:
                self.s = self.saved.pop()
        elif kind == 0x214:
            s.at = i2(6, 2)[::-1]
        elif kind == 0x213:
            p = i2(6, 2)[::-1]
            self.emit([("M", *s.at), ("L", *p)], False, True)
            s.at = p
        elif kind in (0x324, 0x325):
            self.poly(self.points(r, 8, i2(6)[0]), kind == 0x324, kind == 0x324)
        elif kind == 0x538:
            n = limits.fit(i2(6)[0], len(r) - 8, 2)
            counts, at, path = struct.unpack_from(f"<{n}H", r, 8), 8 + 2 * n, []
            for c in counts:
                p = self.points(r, at, c)
                at += 4 * len(p)
                if p:
                    path += [("M", *p[0]), *(("L", *q) for q in p[1:]), ("Z",)]
            self.emit(path, True, True)
        elif kind in (0x41B, 0x418):
            y1, x1, y0, x0 = i2(6, 4)
            self.emit((rect_path if kind == 0x41B else ellipse_path)(x0, y0, x1, y1), True, True)
        elif kind == 0x61C:
            _, _, y1, x1, y0, x0 = i2(6, 6)
            self.emit(rect_path(x0, y0, x1, y1), True, True)
        elif kind == 0x2FA:
            style, w = i2(6, 2)
            self.keep("pen", {"style": style, "width": w, "color": rgb(struct.unpack_from("<I", r, 12)[0])})
        elif kind == 0x2FC:
            style, c = struct.unpack_from("<HI", r, 6)
            self.keep("brush", {"style": style, "color": rgb(c)})
        elif kind in (0x142, 0x1F9):
            self.keep("brush", {"style": 0, "color": 0x808080})
        elif kind == 0x2FB:
            h, width, esc, _, weight = i2(6, 5)
            self.keep("font", {"height": h, "width": width, "escapement": esc, "charset": r[19], "face": tx.sjis_decode(r[24:56]), "bold": weight >= 600})
        elif kind in (0xF7, 0x6FF):
            self.keep("other", {})
        elif kind == 0x12D:
            n = i2(6)[0]
            if 0 <= n < len(self.slots) and self.slots[n] and self.slots[n][0] != "other":
                setattr(s, *self.slots[n])
        elif kind == 0x1F0:
            n = i2(6)[0]
            if 0 <= n < len(self.slots):
                self.slots[n] = None
        elif kind == 0x416:
            y1, x1, y0, x0 = i2(6, 4)
            s.clip = [*s.clip, self.map(rect_path(x0, y0, x1, y1))]
        elif kind == 0x12C:
            s.clip = []
        elif kind == 0x521:
            n = limits.fit(i2(6)[0], len(r) - 8, 1)
            y, x = i2(8 + n + n % 2, 2)
            self.text(x, y, tx.sjis_decode(r[8 : 8 + n]), None)
        elif kind == 0xA32:
            y, x, n, options = i2(6, 4)
            n, at = limits.fit(n, len(r) - 14, 1), 14
            if options & 6:
                box, at = i2(14, 4), 22
                if options & 2:
                    self.out.items.append({"kind": "fill", "path": self.map(rect_path(*box)), "color": s.back_color, "even_odd": False, "mul": False, "clip": self.out.clip_id(s.clip)})
            text, after = tx.sjis_decode(r[at : at + n]), at + n + n % 2
            steps, k = None, 0
            if after + 2 * n <= len(r):
                unit, steps = i2(after, n), []
                for c in text:
                    w = len(tx.sjis_encode(c))
                    steps.append(float(sum(unit[k : k + w])))
                    k += w
            self.text(x, y, text, steps)
        elif kind == 0x61D:
            rop, h, w, y, x = struct.unpack_from("<I4h", r, 6)
            self.raster((x, y, w, h), None, rop)
        elif kind in (0xB41, 0xF43, 0x940, 0xD33):
            rop = struct.unpack_from("<I", r, 6)[0]
            if kind == 0xF43:
                _, sh, sw, sy, sx, h, w, y, x = i2(10, 9)
                at = 28
            elif kind == 0xB41:
                sh, sw, sy, sx, h, w, y, x = i2(10, 8)
                at = 26
            elif kind == 0x940:
                sy, sx, h, w, y, x = i2(10, 6)
                sw, sh, at = w, h, 22
            else:
                _, _, _, sh, sw, h, w, y, x = i2(10, 9)
                sx = sy = 0
                at = 28
            b = r[at:]
            n = dib.info_length(b) if len(b) >= 40 else 0
            self.raster((x, y, w, h), dib.crop(dib.decode(b[:n], b[n:]), sx, sy, sw, sh) if n else None, rop)
        elif kind == 0x626:
            how, n = struct.unpack_from("<HH", r, 6)
            if how == 15:
                self.driver(r[10 : 10 + n])
        elif kind not in (0x103, 0x20C, 0x20D, 0x20E, 0x107, 0x108, 0x10A, 0x234, 0x35, 0x436, 0x149, 0x231):
            self.out.skipped.append(f"record {kind:04x}")


def render_wmf(data: bytes, box: tuple[float, float], out: Display, pictures: list[bytes] = ()) -> None:
    WmfReader(data, box, out, pictures).run()
