"""SentencePiece encoding and decoding as a streaming Viterbi search.

The lattice over a text has an edge for each piece. The given models are of the BPE kind, whose answer
is not the best sum of scores but the one path in which each neighbouring pair of pieces is what
merging gives for its concatenation; so an edge survives only if it is compatible with the edge before
it, and each position keeps one backpointer, as in a Viterbi search with scores 0 and minus infinity.
A window of the last positions is kept; whenever the backpointer paths of all positions that a further
piece can still start from meet in one boundary, ids up to there are committed and the window moves.

Segments between white space are encoded alone (no piece crosses into a following space), each once
in a bounded cache. Characters without a piece become byte pieces.

Defined cases: null and empty texts have no ids and decode to the empty text; the space mark itself in
a text decodes to a space, as in the library; texts are read whole; equal texts have equal ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagelake.llm.common import by_size, kept, ship, table, tokenizer_path

MARK = "▁"
_SEGMENTS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
CACHE = 500_000


class Pieces:
    """A BPE-kind model with byte fallback, an identity normaliser and a space before the text."""

    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.bytes_of = [b""] * n
        self.byte_id, self.rank = [0] * 256, {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.bytes_of[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                self.rank[piece] = (-sp.get_score(i), i)
        self.longest = max(map(len, self.rank))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.rank):
            raise ValueError("a piece crosses into a following space or line")
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.able = {p: i for p, (_, i) in self.rank.items() if len(p) == 1 or self._parts(p)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.limit, self.known, self.old = cache, {}, {}
        # marks that no piece joins to a letter before them end a word alone
        self.marks = {m: np.array([self.able[m]], "<u4").tobytes() for m in ".,;:!?|" if m in self.able and not any(a.isalpha() and b == m for p in self.rank for a, b in zip(p, p[1:]))}
        self.line = np.array([self.byte_id[10]], "<u4").tobytes()

    def _parts(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes ``piece``; None where merging its characters gives something else."""
        if piece not in self.parts:
            now, last = list(piece), None
            while len(now) > 1:
                best = min(((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(now, now[1:])) if a + b in self.rank), default=None)
                if best is None:
                    break
                k = best[1]
                last = (now[k], now[k + 1])
                now[k : k + 2] = [now[k] + now[k + 1]]
            self.parts[piece] = last if len(now) == 1 else None
        return self.parts[piece]

    def _side(self, piece: str, right: int) -> Iterator[tuple[str, float]]:
        """Parts at the right (or left) end of a piece, each with the rank of the merge that ends it."""
        until = float("inf")
        while True:
            yield piece, until
            if len(piece) == 1 or (parts := self._parts(piece)) is None:
                return
            until, piece = self.rank[piece][0], parts[right]

    def joins(self, a: str, b: str) -> bool:
        """Whether a then b is what merging gives: no merge across their border comes before their own."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= 500_000:
                self.pairs.clear()
            ok = self.pairs[a, b] = not any((m := self.rank.get(x + y)) is not None and m[0] < p and m[0] <= q for x, p in self._side(a, 1) for y, q in self._side(b, 0))
        return ok

    def ids_of_piece(self, piece: str) -> list[int]:
        return [self.able[piece]] if piece in self.able else [self.byte_id[x] for x in piece.encode()]

    def segment(self, text: str) -> bytes:
        """The ids of one segment as little-endian unsigned 32-bit integers."""
        got = self.known.get(text)
        if got is None:
            got = self.old.get(text)
            if got is None and text[-1] in self.marks and (stem := text[:-1]).lstrip(MARK).isalpha():
                got = self.segment(stem) + self.marks[text[-1]]
            if got is None:
                s = Stream(self)
                ids = [*s.feed(text), *s.finish()]
                got = np.array(ids, "<u4").tobytes()
            if len(text) <= 64:
                if len(self.known) >= self.limit:
                    self.old, self.known = self.known, {}
                self.known[text] = got
        return got

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "  " in text or text[0] == " " or MARK in text:
            return b"".join(map(self.segment, _SEGMENTS.findall(MARK + text.replace(" ", MARK))))
        out, known, segment = [], self.known, self.segment
        for k, line in enumerate((" " + text).split("\n")):
            first, *rest = line.split(" ")
            if k:
                out.append(self.line)
            if first:
                out.append(segment(first))
            for w in rest:
                w = MARK + w
                out.append(known[w] if w in known else segment(w))
            known = self.known
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


class Stream:
    """The search itself, fed text in any portions; ``widest`` is the largest window that was kept."""

    def __init__(self, pieces: Pieces):
        self.p, self.text, self.widest = pieces, "", 0
        self.back, self.piece = [0], [""]  # of each position of the window; the first is committed

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        p, get, longest, pairs = self.p, self.p.able.get, self.p.longest, self.p.pairs
        for start in range(0, len(text), 4 * longest):
            self.text += text[start : start + 4 * longest]
            s, back, piece = self.text, self.back, self.piece
            for i in range(len(back), len(s) + 1):
                for j in range(i - 1, max(-1, i - longest - 1), -1):
                    part = s[j:i]
                    if get(part) is None and j < i - 1:
                        continue
                    before = piece[j]
                    ok = not before or pairs.get((before, part))
                    if ok is None:
                        ok = p.joins(before, part)
                    if ok:
                        back.append(j)
                        piece.append(part)
                        break
                else:
                    raise AssertionError("a prefix without an encoding")
            self.widest = max(self.widest, len(s))
            if len(text) - start > 4 * longest:
                out += self._commit()
        return out

    def _path(self, end: int) -> list[int]:
        parts = []
        while end:
            parts.append(self.piece[end])
            end = self.back[end]
        return [i for part in reversed(parts) for i in self.p.ids_of_piece(part)]

    def _commit(self) -> list[int]:
        """Ids up to the boundary where the paths of all live positions meet."""
        n = len(self.text)
        live = set(range(max(0, n - self.p.longest + 1), n + 1))
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(self.back[last])
        c = live.pop()
        out = self._path(c)
        self.text, self.back = self.text[c:], [0, *(max(0, j - c) for j in self.back[c + 1 :])]
        self.piece = self.piece[c:]
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.text))
        self.text, self.back, self.piece = "", [0], [""]
        return out


def pieces(path: str) -> Pieces:
    return kept(("pieces", path), lambda: Pieces(path))


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, n_ids, ids_crc32, n_chars and crc32 of the decoded text, round_trip; and the ids if asked for."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelake.llm.pieces import MARK, pieces

        p = pieces(path)
        for whole in batches:
            for b in by_size(whole, 1):
                texts = [t or "" for t in b.column(1).to_pylist()]
                ids = [p.encode(t) for t in texts]
                back = [p.decode(x) for x in ids]
                cols = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([len(t) for t in back], pa.int64()), pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()), pa.array([t.replace(MARK, " ") == d for t, d in zip(texts, back)], pa.bool_())]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, [key, "n_ids", "ids_crc32", "n_chars", "decoded_crc32", "round_trip"] + ["ids"] * with_ids)

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_ids long, ids_crc32 long, n_chars long, decoded_crc32 long, round_trip boolean" + ", ids array<long>" * with_ids
    return df.select(key, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key and text of id lists; a null list is an empty text."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelake.llm.pieces import pieces

        p = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


def op3_streaming_pieces(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_path(model))
