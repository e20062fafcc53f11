"""Text that something opaque, drawn later, covers; and the text of a page.

Runs and covers are compared in the order of drawing. The relational form of the same rules, over
tables of runs and boxes, is in pagelake.operators.page_text.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pagelake.functions.dib import opaque
from pagelake.functions.drawing import Display
from pagelake.functions.text import half_width_drawn, half_width_line

#: Fixed value: character and cover comparisons on one page; beyond it the rest of the page is kept.
BUDGET = 20_000_000
CHORDS = 8


def flatten(path: list) -> list[list[tuple[float, float]]]:
    """Figures as polygons; a curve becomes eight chords, figures of up to two points go."""
    out, now = [], []
    for op, *v in path:
        if op == "M":
            out.append(now)
            now = [tuple(v)]
        elif op == "L":
            now.append(tuple(v))
        elif op == "C" and now:
            x0, y0 = now[-1]
            for k in range(1, CHORDS + 1):
                t = k / CHORDS
                u = 1 - t
                now.append(tuple(u**3 * a + 3 * u * u * t * b + 3 * u * t * t * c + t**3 * d for a, b, c, d in ((x0, v[0], v[2], v[4]), (y0, v[1], v[3], v[5]))))
        elif op == "Z" and now:
            out.append(now)
            now = [now[0]]
    return [p for p in (*out, now) if len(p) > 2]


def bounds(polygons: list) -> tuple[float, float, float, float] | None:
    points = [p for poly in polygons for p in poly if math.isfinite(p[0]) and math.isfinite(p[1])]
    if not points:
        return None
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


def winding(polygons: list, x: float, y: float) -> tuple[int, int]:
    """(winding number, crossings) of a point."""
    total = crossings = 0
    for poly in polygons:
        for (x0, y0), (x1, y1) in zip(poly, poly[1:] + poly[:1]):
            if (y0 <= y) != (y1 <= y):
                at = x0 + (y - y0) / (y1 - y0) * (x1 - x0)
                if at > x:
                    crossings += 1
                    total += 1 if y1 > y0 else -1
    return total, crossings


def inside(polygons: list, even_odd: bool, x: float, y: float) -> bool:
    total, crossings = winding(polygons, x, y)
    return crossings % 2 == 1 if even_odd else total != 0


def in_quad(quad: list, x: float, y: float) -> bool:
    """Strictly inside a convex quadrilateral."""
    sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for (ax, ay), (bx, by) in zip(quad, quad[1:] + quad[:1])]
    return all(s > 1e-3 for s in sides) or all(s < -1e-3 for s in sides)


def places(item: dict) -> list[float]:
    """Where each character starts on its baseline; an em for each character where the item does not say."""
    xs = item["xs"][: len(item["text"])]
    return [*xs, *(k * item["size"] for k in range(len(xs), len(item["text"])))]


def char_boxes(item: dict) -> list[list[tuple[float, float]]]:
    """Each character's box: inset by 15 % of its advance, 0.7 em high, on the turned baseline."""
    a, size, out = -math.radians(item["angle"]), item["size"], []
    ux, uy = math.cos(a), math.sin(a)
    vx, vy = uy, -ux  # up
    xs, wide = places(item), item.get("sx", 1.0) or 1.0
    for k, c in enumerate(item["text"]):
        step = xs[k + 1] - xs[k] if k + 1 < len(xs) else 0.0
        if step <= 0:  # no advance to go by
            step = size * (0.5 if half_width_drawn(c) else 1.0)
        lo, hi = (xs[k] + 0.15 * step) * wide, (xs[k] + 0.85 * step) * wide
        base = lambda d, up: (item["x"] + ux * d + vx * up, item["y"] + uy * d + vy * up)
        out.append([base(lo, 0.0), base(hi, 0.0), base(hi, 0.7 * size), base(lo, 0.7 * size)])
    return out


def _covers_of(d: Display) -> list[dict]:
    out = []
    for i, it in enumerate(d.items):
        if it["kind"] == "fill" and not it["mul"]:
            polygons, even = flatten(it["path"]), it["even_odd"]
        elif it["kind"] == "image" and not it["mul"] and it["alpha"] >= 1 and opaque(d.images[it["image"]]):
            a, b, c, e, x, y = it["m"]
            polygons, even = [[(x, y), (x + a, y + b), (x + a + c, y + b + e), (x + c, y + e)]], False
        else:
            continue
        if (box := bounds(polygons)) is not None:
            clips = [flatten(p) for p in d.clips[it["clip"]]]
            out.append({"at": i, "object": it.get("object"), "image": it["kind"] == "image", "polygons": polygons, "even_odd": even, "box": box, "clips": clips})
    return out


def _covered(cover: dict, quad: list) -> bool:
    x0, y0, x1, y1 = cover["box"]
    corners = quad
    quad = [*corners, ((corners[0][0] + corners[2][0]) / 2, (corners[0][1] + corners[2][1]) / 2)]  # and the middle
    if any(not (x0 <= x <= x1 and y0 <= y <= y1) for x, y in quad):
        return False
    if not all(inside(cover["polygons"], cover["even_odd"], x, y) for x, y in quad):
        return False
    if any(not inside(c, False, x, y) for c in cover["clips"] for x, y in quad):
        return False
    return not any(in_quad(corners, x, y) for group in (cover["polygons"], *cover["clips"]) for poly in group for x, y in poly)


def remove_covered(d: Display) -> None:
    """Drop characters that a later fill or opaque picture covers; a picture never covers its own object's text."""
    covers = _covers_of(d)
    starts, checks, kept = [c["at"] for c in covers], 0, []
    for i, it in enumerate(d.items):
        if it["kind"] != "text":
            kept.append(it)
            continue
        later = [c for c in covers[bisect_right(starts, i) :] if not (c["image"] and c["object"] is not None and c["object"] == it.get("object"))]
        gone = set()
        for k, quad in enumerate(char_boxes(it) if later and checks <= BUDGET else []):
            if checks > BUDGET:
                break
            checks += len(later)
            if any(_covered(c, quad) for c in later):
                gone.add(k)
        if not gone:
            kept.append(it)
            continue
        d.hidden_chars += sum(not it["text"][k].isspace() for k in gone)
        left = [k for k in range(len(it["text"])) if k not in gone]
        if left:
            xs = places(it)
            first, a = xs[left[0]], -math.radians(it["angle"])
            along = first * (it.get("sx", 1.0) or 1.0)
            kept.append(it | {"text": "".join(it["text"][k] for k in left), "xs": [xs[k] - first for k in left], "x": it["x"] + math.cos(a) * along, "y": it["y"] + math.sin(a) * along})
    d.items = kept


def page_text(d: Display) -> str:
    """Runs in drawing order: a new line where the baseline moves or turns, a space after a gap."""
    out, last = [], None
    for it in d.items:
        if it["kind"] != "text":
            continue
        size = it["size"]
        if last is not None:
            end, y = last
            if abs(y - it["y"]) > size * 0.5 or abs(it["angle"]) > 1:
                out.append("\n")
            elif it["x"] - end > size * 0.6:
                out.append(" ")
        out.append(it["text"])
        tail = size * (0.5 if half_width_line(it["text"][-1]) else 1.0)
        last = (it["x"] + (it["xs"][len(it["text"]) - 1] if len(it["xs"]) >= len(it["text"]) else 0.0) + tail, it["y"])
    return "".join(out)
