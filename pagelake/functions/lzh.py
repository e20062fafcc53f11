"""The -lh5- method: LZSS over an 8 KiB window with static Huffman blocks.

Reading keeps the stream's bits in one integer that is refilled eight bytes at a time and decodes by
table; writing is greedy with short chains of earlier positions.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pagelake.functions import limits
from pagelake.functions.errors import Corrupt

WINDOW, LONGEST, SHORTEST = 8192, 256, 3
LITERALS, DISTANCES, LENGTHS = 510, 14, 19


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.have, self.bits, self.spare = data, 0, 0, 0, 64

    def _fill(self, n: int) -> None:
        while self.have < n:
            part = self.data[self.at : self.at + 8]
            self.at += len(part)
            if not part:  # the last code may reach a little past the data
                self.spare -= 8
                if self.spare < 0:
                    raise Corrupt("compressed data ends early")
                part = b"\0"
            self.bits = (self.bits << 8 * len(part)) | int.from_bytes(part, "big")
            self.have += 8 * len(part)

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        if self.have < n:
            self._fill(n)
        self.have -= n
        out = self.bits >> self.have
        self.bits &= (1 << self.have) - 1
        return out

    def peek(self, n: int) -> int:
        if self.have < n:
            self._fill(n)
        return self.bits >> (self.have - n)

    def symbol(self, table: tuple[int, list[int]]) -> int:
        """Table entries hold symbol * 32 + code length."""
        width, of = table
        if not width:
            return of[0]
        x = of[self.peek(width)]
        if x < 0:
            raise Corrupt("no such code")
        self.take(x & 31)
        return x >> 5


def _table(lengths: list[int]) -> tuple[int, list[int]]:
    width = max(lengths, default=0)
    if width > 16 or sum(1 << (width - n) for n in lengths if n) > 1 << width:
        raise Corrupt("bad code lengths")
    out = [-1] * (1 << width)
    at = 0
    for n in range(1, width + 1):
        step = 1 << (width - n)
        for s, m in enumerate(lengths):
            if m == n:
                out[at : at + step] = [s << 5 | n] * step
                at += step
    return width, out


def _short_lengths(b: _Bits, count: int, width: int, gap: int) -> tuple[int, list[int]]:
    n = b.take(width)
    if n == 0:
        return 0, [b.take(width)]
    if n > count:
        raise Corrupt("too many code lengths")
    out: list[int] = []
    while len(out) < n:
        x = b.take(3)
        if x == 7:
            while b.take(1):
                x += 1
                if x > 16:
                    raise Corrupt("code length over 16")
        out.append(x)
        if len(out) == gap:
            out += [0] * b.take(2)
    return _table(out[:count])


def _literal_lengths(b: _Bits, helper: tuple[int, list[int]]) -> tuple[int, list[int]]:
    n = b.take(9)
    if n == 0:
        return 0, [b.take(9)]
    if n > LITERALS:
        raise Corrupt("too many code lengths")
    out: list[int] = []
    while len(out) < n:
        x = b.symbol(helper)
        if x > 2:
            out.append(x - 2)
        else:
            out += [0] * (1 if x == 0 else b.take(4) + 3 if x == 1 else b.take(9) + 20)
    return _table(out[:LITERALS])


def decompress(src: bytes, size: int) -> bytes:
    """``size`` bytes; a block of no symbols is an error, as is data that ends before."""
    limits.expand(len(src), size)
    b, out = _Bits(src), bytearray()
    left = 0
    literal = distance = (0, [0])
    while len(out) < size:
        if not left:
            left = b.take(16)
            if not left:
                raise Corrupt("empty block")
            helper = _short_lengths(b, LENGTHS, 5, 3)
            literal = _literal_lengths(b, helper)
            distance = _short_lengths(b, DISTANCES, 4, -1)
            limits.tick()
        left -= 1
        s = b.symbol(literal)
        if s < 256:
            out.append(s)
            continue
        n, p = s - 253, b.symbol(distance)
        if p > 1:
            p = (1 << (p - 1)) + b.take(p - 1)
        start = len(out) - p - 1
        if start < 0 or p >= 1 << 13:
            raise Corrupt("a match from before the data or beyond the window")
        if n <= len(out) - start:
            out += out[start : start + n]
        elif n:
            unit = bytes(out[start:])
            out += (unit * (n // len(unit) + 1))[:n]
    return bytes(out[:size])


class _Writer:
    def __init__(self):
        self.bits, self.have, self.out = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.bits = self.bits << n | value
        self.have += n
        if self.have >= 256:
            rest = self.have & 7
            self.out += (self.bits >> rest).to_bytes(self.have >> 3, "big")
            self.bits &= (1 << rest) - 1
            self.have = rest

    def done(self) -> bytes:
        pad = -self.have % 8
        self.out += (self.bits << pad).to_bytes((self.have + pad) >> 3, "big")
        return bytes(self.out)


def _code_lengths(freq: list[int], most: int = 16) -> list[int]:
    """Huffman lengths; frequencies are flattened until none passes ``most``."""
    while True:
        heap = [(f, i, (i,)) for i, f in enumerate(freq) if f]
        out = [0] * len(freq)
        if len(heap) < 2:
            return out
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in (*a[2], *b[2]):
                out[i] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(out) <= most:
            return out
        freq = [(f + 1) // 2 if f else 0 for f in freq]


def _codes(lengths: list[int]) -> list[int]:
    out, code = [0] * len(lengths), 0
    for n in range(1, 17):
        for s, m in enumerate(lengths):
            if m == n:
                out[s] = code
                code += 1
        code <<= 1
    return out


def _put_short(w: _Writer, lengths: list[int], freq: list[int], width: int, gap: int) -> None:
    if not any(lengths):
        w.put(0, width)
        w.put(next((i for i, f in enumerate(freq) if f), 0), width)
        return
    n = max(i for i, x in enumerate(lengths) if x) + 1
    w.put(n, width)
    i = 0
    while i < n:
        x = lengths[i]
        if x <= 6:
            w.put(x, 3)
        else:
            w.put((1 << (x - 3)) - 2, x - 3)
        i += 1
        if i == gap:
            skip = 0
            while skip < 3 and i < n and lengths[i] == 0:
                skip, i = skip + 1, i + 1
            w.put(skip, 2)


def _runs(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(helper symbol, extra, extra's width) for the literal code lengths."""
    n = max((i for i, x in enumerate(lengths) if x), default=-1) + 1
    out, i = [], 0
    while i < n:
        if lengths[i]:
            out.append((lengths[i] + 2, 0, 0))
            i += 1
            continue
        run = 0
        while i < n and lengths[i] == 0:
            run, i = run + 1, i + 1
        while run:
            if run >= 20:
                take = min(run, 531)
                out.append((2, take - 20, 9))
            elif run >= 3:
                take = min(run, 18)
                out.append((1, take - 3, 4))
            else:
                take = 1
                out.append((0, 0, 0))
            run -= take
    return out


def _block(w: _Writer, tokens: list[tuple[int, int]]) -> None:
    lf, df = [0] * LITERALS, [0] * DISTANCES
    for s, c in Counter(t[0] for t in tokens).items():
        lf[s] = c
    for d, c in Counter(t[1].bit_length() for t in tokens if t[0] >= 256).items():
        df[d] = c
    ll, dl = _code_lengths(lf), _code_lengths(df)
    w.put(len(tokens), 16)
    if any(ll):
        runs = _runs(ll)
        hf = [0] * LENGTHS
        for s, *_ in runs:
            hf[s] += 1
        hl = _code_lengths(hf)
        _put_short(w, hl, hf, 5, 3)
        hc = _codes(hl)
        w.put(max(i for i, x in enumerate(ll) if x) + 1, 9)
        for s, extra, width in runs:
            w.put(hc[s], hl[s])
            w.put(extra, width)
    else:
        w.put(0, 5)
        w.put(0, 5)
        w.put(0, 9)
        w.put(next(i for i, f in enumerate(lf) if f), 9)
    _put_short(w, dl, df, 4, -1)
    lc, dc = _codes(ll), _codes(dl)
    for s, d in tokens:
        w.put(lc[s], ll[s])
        if s >= 256:
            k = d.bit_length()
            w.put(dc[k], dl[k])
            if k > 1:
                w.put(d - (1 << (k - 1)), k - 1)


def compress(src: bytes, chain: int = 16, block: int = 32_768) -> bytes:
    if not src:
        return b""
    w, tokens, seen = _Writer(), [], {}
    i, n = 0, len(src)
    while i < n:
        best, at, key = 0, 0, src[i : i + 3]
        if len(key) == 3 and (places := seen.get(key)):
            room = min(LONGEST, n - i)
            for p in reversed(places[-chain:]):
                if i - p > WINDOW:
                    break
                if best and src[p + best : p + best + 1] != src[i + best : i + best + 1]:
                    continue
                k = 3
                while k < room and src[p + k] == src[i + k]:
                    k += 1
                if k > best:
                    best, at = k, p
                    if k == room:
                        break
        step = max(1, best)
        tokens.append((253 + best, i - at - 1) if best >= SHORTEST else (src[i], 0))
        for j in range(i, min(i + step, n - 2)):
            places = seen.setdefault(src[j : j + 3], [])
            places.append(j)
            if len(places) > 4 * chain:
                del places[: 3 * chain]
        i += step
        if len(tokens) == block:
            _block(w, tokens)
            tokens = []
    if tokens:
        _block(w, tokens)
    return w.done()
