"""Resource limits for untrusted documents, and the accounting of one call.

A limit once passed stays passed: the outermost scope raises even if inner code went on.
"""

from __future__ import annotations

import math
import re
import threading
import time
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, fields

from pagelake.functions.errors import DocumentError, TooLarge

#: What stored data may grow by, besides its ratio.
SLACK = 64 * 1024


class Timeout(DocumentError):
    kind = "Timeout"


@dataclass(frozen=True)
class Limits:
    maxBytes: int = 768 << 20
    maxExpand: int = 256 << 20
    maxRatio: int = 1000
    maxPages: int = 20_000
    maxImagePixels: int = 100_000_000
    maxRecords: int = 1_000_000
    maxPoints: int = 5_000_000
    deadline: float = 0.0  # seconds for one file; 0: none

    @classmethod
    def from_json(cls, text: str) -> Limits:
        """A flat scan of ``name: number`` pairs; values below 1, not finite or unreadable keep the default."""
        known = {f.name for f in fields(cls)} - {"deadline"}
        out = {}
        for part in text.strip().strip("{}").split(","):
            name, _, value = part.partition(":")
            name = name.strip().strip('"').strip()
            try:
                number = float(value.strip().strip('"'))
            except ValueError:
                continue
            if name in known and math.isfinite(number) and number >= 1:
                out[name] = int(number)
        return cls(**out)

    @classmethod
    def from_options(cls, options: dict[str, str]) -> Limits:
        names = {f.name.lower(): f.name for f in fields(cls)}
        return cls(**{names[k.lower()]: (float(v) if k.lower() == "deadline" else int(float(v))) for k, v in options.items() if k.lower() in names and re.fullmatch(r"\s*[\d.eE+]+\s*", v)})

    def expand_cap(self, stored: int) -> int:
        return min(stored * self.maxRatio + SLACK, self.maxExpand)


@dataclass
class Usage:
    expanded: int = 0
    pixels: int = 0
    records: int = 0
    points: int = 0
    items: int = 0
    failed: str = ""


@dataclass
class _Scope:
    limits: Limits
    usage: Usage = field(default_factory=Usage)
    until: float = 0.0


_here = threading.local()


def _stack() -> list[_Scope]:
    if not hasattr(_here, "stack"):
        _here.stack = []
    return _here.stack


@contextmanager
def scope(limits: Limits):
    """Account for one call. Inner scopes share the outermost one's failure."""
    stack = _stack()
    s = _Scope(limits, until=stack[0].until if stack else (time.monotonic() + limits.deadline if limits.deadline else 0.0))
    stack.append(s)
    try:
        yield s.usage
    finally:
        stack.pop()
        _here.last = s.usage
        if stack and s.usage.failed:
            stack[-1].usage.failed = stack[-1].usage.failed or s.usage.failed
    if s.usage.failed:
        raise TooLarge(s.usage.failed)


def last_usage() -> dict:
    return asdict(getattr(_here, "last", Usage()))


def over() -> bool:
    return bool(_stack()) and bool(_stack()[-1].usage.failed)


def _fail(name: str, text: str = "") -> TooLarge:
    if _stack():
        _stack()[-1].usage.failed = _stack()[-1].usage.failed or name
    return TooLarge(name, text)


def current() -> Limits:
    return _stack()[-1].limits if _stack() else Limits()


def tick() -> None:
    s = _stack()
    if s and s[-1].until and time.monotonic() > s[-1].until:
        raise Timeout("deadline")


def expand(stored: int, claimed: int) -> None:
    """Before expanding: may ``stored`` bytes become ``claimed``?"""
    cap = current().expand_cap(stored)
    if claimed > cap:
        raise _fail("maxExpand", f"{claimed} bytes from {stored}")
    _charge("expanded", claimed, current().maxExpand, "maxExpand")


def _charge(what: str, n: int, most: int, name: str) -> None:
    s = _stack()
    if not s:
        return
    now = getattr(s[-1].usage, what) + n
    setattr(s[-1].usage, what, now)
    if now > most:
        raise _fail(name, f"{now}")
    tick()


def image(w: int, h: int) -> None:
    most = current().maxImagePixels
    if w < 0 or h < 0 or w * h > most:
        raise _fail("maxImagePixels", f"{w} x {h}")
    _charge("pixels", w * h, most, "maxImagePixels")


def record() -> None:
    _charge("records", 1, current().maxRecords, "maxRecords")


def points(n: int) -> None:
    _charge("points", n, current().maxPoints, "maxPoints")


def item() -> None:
    _charge("items", 1, current().maxRecords, "maxRecords")


def fit(count: int, room: int, each: int) -> int:
    """A claimed count cut to what the data can hold."""
    return max(0, min(count, room // each if each else 0))
