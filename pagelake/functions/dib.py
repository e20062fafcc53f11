"""Bitmaps: device-independent ones of all depths, the stored form of thumbnails, and JPEG sizes."""

from __future__ import annotations

import struct

import numpy as np

from pagelake.functions import limits, lzh
from pagelake.functions.errors import DocumentError


def jpeg_size(d: bytes) -> tuple[int, int] | None:
    """Width and height from the first frame header."""
    if len(d) < 4 or d[:2] != b"\xff\xd8":
        return None
    i = 2
    while i + 4 <= len(d):
        m = d[i + 1]
        if d[i] != 0xFF or m == 0xFF:
            i += 1
        elif m in (0x01, 0xD8) or 0xD0 <= m <= 0xD7:
            i += 2
        elif 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            if i + 9 > len(d):
                return None
            h, w = struct.unpack_from(">HH", d, i + 5)
            return (w, h) if w and h else None
        else:
            i += 2 + struct.unpack_from(">H", d, i + 2)[0]
    return None


def _rle(bits: bytes, w: int, h: int, depth: int) -> np.ndarray:
    """Runs of palette numbers, bottom row first."""
    out = np.zeros((h, w), np.uint8)
    x = y = i = 0
    while i + 1 < len(bits) and y < h:
        n, v = bits[i], bits[i + 1]
        i += 2
        if n:
            pair = (v, v) if depth == 8 else (v >> 4, v & 15)
            m = min(n, max(0, w - x))
            out[y, x : x + m : 2], out[y, x + 1 : x + m : 2] = pair[0], pair[1]
            x += n
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            if i + 1 < len(bits):
                x, y, i = x + bits[i], y + bits[i + 1], i + 2
        else:
            size = v if depth == 8 else (v + 1) // 2
            part = np.frombuffer(bits[i : i + size], np.uint8)
            if depth == 4:
                part = np.stack([part >> 4, part & 15], 1).ravel()
            part = part[: min(v, max(0, w - x))]
            out[y, x : x + len(part)] = part
            x, i = x + v, i + size + size % 2
        limits.tick()
    return out


def _masked(v: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.zeros(v.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    most = mask >> shift
    return ((v & mask) >> shift).astype(np.uint64) * 255 // most


def decode(info: bytes, bits: bytes) -> dict | None:
    """An image {w, h, rgba} with the top row first, or {w, h, jpeg}; None where it cannot be read."""
    if len(info) < 40:
        return None
    size, w, h, _, depth, how, _, _, _, used = struct.unpack_from("<IiiHHIIiiI", info)
    if how == 4:
        got = jpeg_size(bits)
        if got is None:
            return None
        limits.image(*got)
        return {"w": got[0], "h": got[1], "jpeg": bits}
    if how == 5 or w <= 0 or h == 0 or depth not in (1, 4, 8, 16, 24, 32):
        return None
    rows = abs(h)
    limits.image(w, rows)
    at, masks = size, None
    if how == 3:
        masks = struct.unpack_from("<3I", info, 40) if len(info) >= 52 else None
        at = max(size, 52) if size == 40 else size
    colors = np.zeros((1 << depth if depth <= 8 else 0, 3), np.uint8)
    if depth <= 8:
        n = min(used or 1 << depth, 1 << depth, max(0, (len(info) - at) // 4))
        table = np.frombuffer(info, np.uint8, 4 * n, at).reshape(-1, 4)
        colors[:n] = table[:, 2::-1]
    out = np.full((rows, w, 4), 255, np.uint8)
    if how in (1, 2):
        out[..., :3] = colors[_rle(bits, w, rows, 8 if how == 1 else 4) & (len(colors) - 1)]
    else:
        stride = (w * depth + 31) // 32 * 4
        have = min(rows, len(bits) // stride)
        raw = np.zeros((rows, stride), np.uint8)
        raw[:have] = np.frombuffer(bits, np.uint8, have * stride).reshape(have, stride)
        if depth <= 8:
            if depth == 1:
                v = np.unpackbits(raw, axis=1)[:, :w]
            elif depth == 4:
                v = np.stack([raw >> 4, raw & 15], 2).reshape(rows, -1)[:, :w]
            else:
                v = raw[:, :w]
            out[..., :3] = colors[v]
        elif depth == 24:
            out[..., :3] = raw[:, : 3 * w].reshape(rows, w, 3)[..., ::-1]
        else:
            v = raw.view("<u2" if depth == 16 else "<u4")[:, :w].astype(np.uint32)
            masks = masks or ((0x7C00, 0x3E0, 0x1F) if depth == 16 else (0xFF0000, 0xFF00, 0xFF))
            for k, m in enumerate(masks):
                out[..., k] = _masked(v, m)
    return {"w": w, "h": rows, "rgba": out if h < 0 else out[::-1].copy()}


def info_length(b: bytes) -> int:
    """Bytes of a bitmap's head with its masks and palette."""
    size, depth, how, used = struct.unpack_from("<I", b)[0], struct.unpack_from("<H", b, 14)[0], struct.unpack_from("<I", b, 16)[0], struct.unpack_from("<I", b, 32)[0]
    return size + (12 if how == 3 and size == 40 else 0) + 4 * ((used or 1 << depth) if depth <= 8 else used)


def stored(b: bytes) -> dict | None:
    """The form of kind 7: the head, then 1, stored size, size, rows, and compressed bits."""
    if len(b) < 56:
        return None
    n = info_length(b)
    one, packed, size, _ = struct.unpack_from("<4I", b, n) if n + 16 <= len(b) else (0, 0, 0, 0)
    if one != 1 or n + 16 + packed > len(b) + 3:
        return decode(b[:n], b[n:])
    return decode(b[:n], lzh.decompress(b[n + 16 : n + 16 + packed], size))


def stored_bytes(info: bytes, bits: bytes, rows: int) -> bytes:
    packed = lzh.compress(bits)
    return info + struct.pack("<4I", 1, len(packed), len(bits), rows) + packed


def external(b: bytes) -> dict | None:
    """A picture of a page's list: a 16-byte head and a JPEG, a JPEG, or a stored bitmap."""
    try:
        for part in (b[16:], b):
            if part[:2] == b"\xff\xd8" and (got := jpeg_size(part)):
                limits.image(*got)
                return {"w": got[0], "h": got[1], "jpeg": part}
        return stored(b)
    except (struct.error, DocumentError, ValueError):
        if limits.over():
            raise
        return None


def crop(picture: dict | None, x: int, y: int, w: int, h: int) -> dict | None:
    if picture is None or "rgba" not in picture or (x, y, w, h) == (0, 0, picture["w"], picture["h"]):
        return picture
    x, y = max(0, x), max(0, y)
    part = picture["rgba"][y : y + max(0, h), x : x + max(0, w)]
    return {"w": part.shape[1], "h": part.shape[0], "rgba": part} if part.size else picture


def opaque(picture: dict) -> bool:
    return "jpeg" in picture or bool((picture["rgba"][..., 3] == 255).all())


def rgba_to_24(rgba: np.ndarray) -> tuple[bytes, bytes]:
    """A bottom-up 24-bit bitmap, transparent parts over white: (head, bits)."""
    h, w = rgba.shape[:2]
    a = rgba[..., 3:].astype(np.uint32)
    mixed = ((rgba[..., :3] * a + 255 * (255 - a) + 127) // 255).astype(np.uint8)
    stride = (3 * w + 3) // 4 * 4
    out = np.zeros((h, stride), np.uint8)
    out[:, : 3 * w] = mixed[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, out.size, 0, 0, 0, 0), out.tobytes()
