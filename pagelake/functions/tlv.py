"""Tag-length-value elements, the numbers in them, and block check values."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from pagelake.functions.errors import Corrupt


class Element(NamedTuple):
    tag: int
    start: int
    value: int
    len: int

    @property
    def end(self) -> int:
        return self.value + self.len

    def of(self, b: bytes) -> bytes:
        return b[self.value : self.value + self.len]


def read(b: bytes, at: int, limit: int | None = None) -> Element:
    """The element at ``at``; lengths of no or over four bytes, and values past ``limit``, are errors."""
    limit = len(b) if limit is None else limit
    if at + 2 > min(limit, len(b)):
        raise Corrupt(f"element at {at} is cut off")
    n, value = b[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or value + k > len(b):
            raise Corrupt(f"bad length at {at}")
        n, value = int.from_bytes(b[value : value + k], "big"), value + k
    if value + n > limit:
        raise Corrupt(f"element at {at} runs past its end")
    return Element(b[at], at, value, n)


def elements(b: bytes, start: int = 0, end: int | None = None) -> list[Element]:
    out, end = [], len(b) if end is None else end
    while start < end:
        out.append(read(b, start, end))
        start = out[-1].end
    return out


def find(items: list[Element], tag: int) -> Element | None:
    return next((x for x in items if x.tag == tag), None)


def field_number(v: bytes) -> int | None:
    """A field's number, at most 9 bytes, as an unsigned 64-bit value."""
    if not v or len(v) > 9:
        return None
    return int.from_bytes(v, "big", signed=True) & 0xFFFFFFFFFFFFFFFF


def find_number(items: list[Element], b: bytes, tag: int) -> int | None:
    e = find(items, tag)
    return None if e is None else field_number(e.of(b))


def number(v: bytes) -> int:
    """A number of an attribute: 0 where there are no or over eight bytes."""
    return int.from_bytes(v, "big", signed=True) if 0 < len(v) <= 8 else 0


def number_bytes(v: int) -> bytes:
    """Shortest two's complement, big-endian."""
    return v.to_bytes((v + (v < 0)).bit_length() // 8 + 1, "big", signed=True)


def signed32_bytes(v: int) -> bytes:
    return number_bytes(v - (1 << 32) if v & 0x80000000 else v)


def length_bytes(n: int) -> bytes:
    """Below 0x80 one byte, to 0xfe two, from 0xff on the shortest of two, three or four after a marker."""
    if n < 0x80:
        return bytes([n])
    if n < 0xFF:
        return bytes([0x81, n])
    k = max(2, (n.bit_length() + 7) // 8)
    return bytes([0x80 | k]) + n.to_bytes(k, "big")


def element(tag: int, value: bytes) -> bytes:
    return bytes([tag]) + length_bytes(len(value)) + value


def check(block: bytes) -> int:
    """XOR of the whole little-endian 32-bit words."""
    whole = np.frombuffer(block, "<u4", len(block) // 4)
    return int(np.bitwise_xor.reduce(whole)) if len(whole) else 0


def words(v: bytes) -> list[int]:
    return np.frombuffer(v, "<u4", len(v) // 4).tolist()


def items(v: bytes) -> list[bytes]:
    """Length-prefixed parts, up to the first that overruns."""
    out, i = [], 0
    while i < len(v) and i + 1 + v[i] <= len(v):
        out.append(v[i + 1 : i + 1 + v[i]])
        i += 1 + v[i]
    return out


def ints(v: bytes) -> list[int]:
    return [number(x) for x in items(v)]


def ints_bytes(values: list[int]) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in map(number_bytes, values))
