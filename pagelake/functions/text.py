"""Strings as stored: Shift_JIS and UTF-16 values, names of either, and the widths of characters."""

from __future__ import annotations

import unicodedata

#: Where the Encoding Standard's Shift_JIS differs from Python's cp932.
_DECODE_FIX = {b"\x80": "\x80", b"\xa0": "�", b"\xfd": "�", b"\xfe": "�", b"\xff": "�"}
_HIGH = "纊", "黑"


def sjis_decode(v: bytes) -> str:
    """Up to the first NUL; unreadable bytes become U+FFFD."""
    v = v.split(b"\0", 1)[0]
    out, i = [], 0
    while i < len(v):
        one = v[i : i + 1]
        if one in _DECODE_FIX:
            out.append(_DECODE_FIX[one])
            i += 1
            continue
        if 0x81 <= v[i] <= 0x9F or 0xE0 <= v[i] <= 0xFC:
            two = v[i : i + 2]
            try:
                out.append(two.decode("cp932"))
                i += 2
                continue
            except UnicodeDecodeError:
                out.append("�")
                i += 2 if len(two) == 2 and two[1] >= 0x80 else 1
                continue
        out.append(one.decode("cp932", "replace"))
        i += 1
    return "".join(out)


def _one(c: str) -> bytes:
    if c == "\x80":
        return b"\x80"
    if c == "¥":
        return b"\\"
    if c == "‾":
        return b"~"
    if c == "−":
        return b"\x81\x7c"
    if c == "髙":
        return b"\xfb\xfc"  # the later of two codes, as the Encoding Standard has it
    try:
        raw = c.encode("cp932")
    except UnicodeEncodeError:
        return f"&#{ord(c)};".encode()
    return f"&#{ord(c)};".encode() if raw in (b"\xa0", b"\xfd", b"\xfe", b"\xff") else raw


def sjis_encode(s: str) -> bytes:
    """Characters that Shift_JIS lacks become decimal character references."""
    return s.encode() if s.isascii() else b"".join(map(_one, s))


def utf16_trimmed(v: bytes) -> str:
    """Whole pairs, trailing NULs dropped."""
    return v[: len(v) // 2 * 2].decode("utf-16-le", "replace").rstrip("\0")


def utf16_cut(v: bytes) -> str:
    """Whole pairs up to the first NUL."""
    return v[: len(v) // 2 * 2].decode("utf-16-le", "replace").split("\0", 1)[0]


def utf16_value(s: str) -> bytes:
    return (s + "\0").encode("utf-16-le")


def name_decode(v: bytes) -> str:
    """A name that is UTF-16 or Shift_JIS: ASCII in pairs shows the first, half-width kana or bad bytes rule out the second."""
    if len(v) >= 2 and v[0] and not v[1]:
        return utf16_cut(v)
    s = sjis_decode(v)
    if "�" in s or any("｡" <= c <= "ﾟ" for c in s):
        return utf16_cut(v)
    return s


def fold(s: str) -> str:
    """For searching: compatibility forms and letter case do not matter."""
    return unicodedata.normalize("NFKC", s).lower()


def matches(text: str, word: str) -> list[int]:
    """Places of all matches in the folded text, overlapping ones too."""
    text, word = fold(text), fold(word)
    out, at = [], text.find(word) if word else -1
    while at >= 0:
        out.append(at)
        at = text.find(word, at + 1)
    return out


def half_width_line(c: str) -> bool:
    """Text assembly: below U+2000."""
    return ord(c) < 0x2000


def half_width_drawn(c: str) -> bool:
    """Covered text and the text layer of PDF: below U+2000, and half-width kana."""
    return ord(c) < 0x2000 or 0xFF61 <= ord(c) <= 0xFF9F


def advance(line: str) -> float:
    """A line's width in ems: controls 0, half-width characters 0.5, others 1."""
    return sum(0.0 if ord(c) < 0x20 else 0.5 if half_width_drawn(c) else 1.0 for c in line)


def show_value(v: bytes) -> str:
    """An attribute's value for people: numbers, UTF-16, Shift_JIS or hex."""
    from pagelake.functions.tlv import items, ints

    parts = items(v)
    if v and parts and sum(1 + len(p) for p in parts) == len(v) and all(0 < len(p) <= 8 for p in parts):
        return "[" + ", ".join(map(str, ints(v))) + "]"
    for s in (utf16_trimmed(v) if len(v) % 2 == 0 else "", sjis_decode(v)):
        if s and "�" not in s and s.isprintable():
            return f'"{s}"'
    return v.hex()
