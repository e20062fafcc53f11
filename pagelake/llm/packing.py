"""Pattern packing by non-negative least squares over the histogram of piece lengths.

Documents become token ids and a closing id; longer ones are cut into pieces of the sequence length.
The histogram of piece lengths, at most as many entries as the sequence has tokens, is all the driver
sees. Patterns of up to ``most`` pieces that fill a sequence are enumerated over length bins, a
non-negative least squares fit finds how often to repeat each so that the histogram is used up, the
counts are rounded down, and what is left is packed best-fit decreasing into the room that is left
and into new sequences. The plan maps (length, rank among pieces of that length) to a sequence and an
offset; ranks are found without gathering a length in one task.

Defined cases: null text counts as empty, whose only id is the closing one; an empty table gives an
empty result; equal rows are pieces of their own; a null key is a key; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import by_size, chunks, cut, gapless_rank, give_back, kept, ship, table, tokenizer_path

#: White space that separates words for any word-level pre-tokenizer here.
_SPACE = str.maketrans("\n\r\t", "   ")
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = ".,;:!?|"
_BEYOND = re.compile("[^\x00-\xff]")
_MARKED = re.compile("(?<=[a-zß-öø-ÿ])([.,;:])(?=[ \n])")
#: Words that a worker keeps: about 200 bytes each, twice over.
WORDS = 250_000
#: Bytes of texts that are encoded at once; characters of one text that are split into words at once.
AT_ONCE, LONG = 300_000, 1_000_000


def _words(text: str) -> list[str]:
    """Words between white space. In texts of Latin-1, where letter case does not reach the ids, they are
    in lower case, and a mark between a letter and white space is a word: fewer words to look up."""
    if text.isascii() or not _BEYOND.search(text):
        if "<|" not in text:
            text = _MARKED.sub(r" \1", text.lower())
    return (text.translate(_SPACE) if "\t" in text or "\r" in text else text.replace("\n", " ")).split(" ")


class WordEncoder:
    """Ids of texts whose pre-tokenizer never joins characters across white space: a word is encoded
    once by the tokenizers library and then looked up. ``cache``: words that a worker keeps at most.

    Words of plain Latin letters, alone or before one mark, are one piece and that mark; new ones go
    to the library many to a text and are told apart by the tokens that end a word.
    """

    def __init__(self, path: str, cache: int = WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would each keep memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache, self.new, self.old = cache, {}, {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _known(self, w: str) -> bytes | None:
        x = self.new.get(w)
        return self.old.get(w) if x is None else x

    def _letters(self, words: list[str]) -> None:
        """Learn lower-case words of plain letters."""
        few = [words[i : i + 500] for i in range(0, len(words), 500)]
        for group, e in (x for part in chunks(few, 8) for x in zip(part, self.tokenizer.encode_batch_fast([" ".join(g) for g in part], add_special_tokens=False))):
            ids = np.array(e.ids, "<u4")
            stop = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stop) != len(group):
                raise AssertionError("a word of letters is not one piece")
            raw, start = ids.tobytes(), 0
            for w, end in zip(group, stop):
                self.new[w] = raw[start:end]
                start = end

    def _learn(self, words: list[str]) -> None:
        """Make all of ``words`` known in ``new``."""
        if len(self.new) + len(words) > self.cache:
            self.old, self.new = self.new, {}
        new, odd, plain, marked = self.new, [], {}, []
        for w in words:
            if (x := self.old.get(w)) is not None:
                new[w] = x
            elif _PLAIN.fullmatch(w):
                plain[w.lower()] = None
                marked.append((w, w.lower(), ""))
            elif w and w[-1] in _MARKS and _PLAIN.fullmatch(w[:-1]):
                plain[w[:-1].lower()] = None
                marked.append((w, w[:-1].lower(), w[-1]))
            else:
                odd.append(w)
        for m in _MARKS:
            if m not in new:
                new[m] = np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes()
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            new[w] = np.array(e.ids, "<u4").tobytes()
        unknown = []
        for w in plain:
            if w not in new:
                if (x := self.old.get(w)) is not None:
                    new[w] = x
                else:
                    unknown.append(w)
        self._letters(unknown)
        for w, stem, mark in marked:
            new[w] = new[stem] + new[mark] if mark else new[stem]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(texts) == 1 and len(texts[0]) > LONG:  # in parts, cut at a space
            t = texts[0]
            at = t.rfind(" ", 0, LONG) + 1 or t.find(" ", LONG) + 1 or len(t)
            return [self.encode([t[:at]])[0] + (self.encode([t[at:]])[0] if at < len(t) else b"")] if at <= LONG or at < len(t) else [self._whole(t)]
        split = [_words(t) for t in texts]
        fresh: set[str] = set()
        for words in split:
            fresh.update(words)
        if missing := [w for w in fresh if w not in self.new]:
            if 2 * len(fresh) + len(_MARKS) > self.cache:  # more words than are kept: in halves
                if len(texts) == 1:
                    return [self._whole(texts[0])]
                return self.encode(texts[: len(texts) // 2]) + self.encode(texts[len(texts) // 2 :])
            before = self.new
            self._learn(missing)
            if self.new is not before:
                self._learn([w for w in fresh if w not in self.new])
        return [b"".join(map(self.new.__getitem__, words)) for words in split]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str, cache: int = WORDS) -> WordEncoder:
    return kept(("packing", path, cache), lambda: WordEncoder(path, cache))


def pieces(df: DataFrame, path: str, size: int, end_id: int = 0, with_ids: bool = False, text: str = "text", key: str = "doc_id", cache: int = WORDS) -> DataFrame:
    """key, piece, start, length, ids_crc32 of every piece of every document, and its ids if asked for."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelake.llm.packing import encoder

        enc, close = encoder(path, cache), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for b in by_size(whole, 1, AT_ONCE):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, got in enumerate(enc.encode([t or "" for t in b.column(1).to_pylist()])):
                    got += close
                    for k, s in enumerate(range(0, len(got), 4 * size)):
                        part = got[s : s + 4 * size]
                        row.append(i)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int64))
                cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            give_back()

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return df.select(key, text).mapInArrow(run, schema)


def patterns(bins: int, most: int) -> np.ndarray:
    """All ways to fill ``bins`` with 1 to ``most`` parts, one column each, with the parts' counts by size."""
    out: list[tuple[int, ...]] = []

    def add(rest: int, least: int, parts: tuple[int, ...]) -> None:
        if rest >= least:
            out.append((*parts, rest))
        if len(parts) + 1 < most:
            for x in range(least, rest // 2 + 1):
                add(rest - x, x, (*parts, x))

    add(bins, 1, ())
    a = np.zeros((bins, len(out)))
    for k, parts in enumerate(out):
        for x in parts:
            a[x - 1, k] += 1
    return a


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """min |a x - b| over x >= 0 by active sets: let in the steepest column, step back when one turns negative."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, bool)
    slack = a.T @ b
    close = 1e-9 * max(1.0, float(np.abs(slack).max(initial=0)))
    for _ in range(rounds or 4 * a.shape[0]):
        if inside.all() or slack[~inside].max(initial=-1) <= close:
            break
        inside[np.argmax(np.where(inside, -np.inf, slack))] = True
        while True:
            cols = np.flatnonzero(inside)
            s = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if s.min(initial=1) > 0:
                x[:] = 0
                x[cols] = s
                break
            bad = s <= 0
            old = x[cols]
            step = float((old[bad] / np.maximum(old[bad] - s[bad], 1e-300)).min())
            x[cols] = old + step * (s - old)
            inside[cols[(x[cols] <= 1e-12) & bad]] = False
            x[~inside] = 0
            if not inside.any():
                break
        slack = a.T @ (b - a @ x)
    return x


@dataclass
class Group:
    """``count`` sequences that hold the same lengths: runs of (length, times), ``used`` tokens in all."""

    count: int
    runs: tuple[tuple[int, int], ...]
    used: int


def plan_groups(histogram: dict[int, int], size: int, bins: int = 64, most: int = 4, shares: tuple[float, ...] = (1.0, 0.9, 0.75, 0.5)) -> list[Group]:
    """Sequences for a histogram of lengths. Its work and result follow the number of lengths, not of pieces.

    The fitted counts are rounded down whole and at a few smaller shares, which leave more pieces to fill
    gaps; the plan of the fewest sequences counts.
    """
    width = -(-size // bins)
    full = size // width
    b = np.zeros(full)
    for n, c in histogram.items():
        if n < size and n <= full * width:
            b[-(-n // width) - 1] += c
    x, a = np.zeros(0), np.zeros((full, 0))
    if b.any():
        a = patterns(full, most)
        x = nnls(a, b)
    plans = [_planned(histogram, size, width, a, x * s) for s in shares]
    return min(plans, key=lambda g: sum(p.count for p in g))


def _planned(histogram: dict[int, int], size: int, width: int, a: np.ndarray, x: np.ndarray) -> list[Group]:
    left = {n: c for n, c in histogram.items() if c > 0}
    groups = [Group(left.pop(size), ((size, 1),), size)] if size in left else []
    by_bin: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left):
        by_bin[-(-n // width)].append(n)
    if len(x):
        lengths = sorted(left)
        for k in np.argsort(-x):
            need = {int(i) + 1: int(a[i, k]) for i in np.flatnonzero(a[:, k])}
            times = int(x[k] + 1e-6)
            parts = sorted((i for i, m in need.items() for _ in range(m)), reverse=True)
            while times > 0:
                taken = _filled(parts, by_bin, left, lengths, size)
                if taken is None:
                    break
                want = defaultdict(int)
                for n in taken:
                    want[n] += 1
                now = min([times, *(left[n] // m for n, m in want.items())])
                for n, m in want.items():
                    left[n] -= m * now
                    if not left[n]:
                        del left[n]
                        by_bin[-(-n // width)].remove(n)
                        lengths.pop(bisect_left(lengths, n))
                groups.append(Group(now, _runs(taken), sum(taken)))
                times -= now
    return _best_fit(groups, left, size)


def _filled(parts: list[int], by_bin: dict[int, list[int]], left: dict[int, int], lengths: list[int], size: int) -> list[int] | None:
    """Lengths for one sequence of a pattern: the longest left of each bin but the last, and then the
    longest of all that fits, which makes up for what the bins round up. None where a bin has run out."""
    taken: list[int] = []
    spent: dict[int, int] = defaultdict(int)
    for i in parts[:-1]:
        n = next((n for n in reversed(by_bin[i]) if left[n] > spent[n]), None)
        if n is None:
            return None
        taken.append(n)
        spent[n] += 1
    room, at = size - sum(taken), bisect_left(lengths, size - sum(taken) + 1) - 1
    while at >= 0 and left[lengths[at]] <= spent[lengths[at]]:
        at -= 1
    if at < 0:
        return None
    if parts[:-1] or lengths[at] == room:
        return [*taken, lengths[at]]
    return None


def _runs(lengths: list[int]) -> tuple[tuple[int, int], ...]:
    out: list[tuple[int, int]] = []
    for n in sorted(lengths, reverse=True):
        if out and out[-1][0] == n:
            out[-1] = (n, out[-1][1] + 1)
        else:
            out.append((n, 1))
    return tuple(out)


def _best_fit(groups: list[Group], left: dict[int, int], size: int) -> list[Group]:
    """Longest first, each into the least room that takes it, whole groups of equal sequences at a time."""
    rooms: list[tuple[int, int]] = []
    for k, g in enumerate(groups):
        if g.used < size:
            insort(rooms, (size - g.used, k))
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            at = bisect_left(rooms, (n, -1))
            if at == len(rooms):
                times = min(size // n, c)
                count = c // times
                c -= count * times
                groups.append(Group(count, ((n, times),), n * times))
                if n * times < size:
                    insort(rooms, (size - n * times, len(groups) - 1))
                continue
            room, k = rooms.pop(at)
            g = groups[k]
            times = min(room // n, c)
            count = min(g.count, c // times)
            if count < g.count:
                groups.append(Group(g.count - count, g.runs, g.used))
                insort(rooms, (room, len(groups) - 1))
            groups[k] = Group(count, (*g.runs, (n, times)), g.used + n * times)
            c -= count * times
            if size > groups[k].used:
                insort(rooms, (size - groups[k].used, k))
    return groups


def plan(histogram: dict[int, int], size: int) -> tuple[np.ndarray, ...]:
    """Arrays (length, first rank, times in a sequence, first sequence, offset), sorted by length and rank."""
    rows, at, sequence = [], defaultdict(int), 0
    for g in plan_groups(histogram, size):
        offset = 0
        for n, times in g.runs:
            rows.append((n, at[n], times, sequence, offset))
            at[n] += g.count * times
            offset += n * times
        sequence += g.count
    if dict(at) != {n: c for n, c in histogram.items() if c}:
        raise AssertionError("the plan does not use each piece once")
    cols = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(cols.T.copy())


def pack(pieces_: DataFrame, size: int) -> DataFrame:
    """Add sequence_id and offset. ``pieces_`` must be a written table: it is read three times."""
    hist = {r["length"]: r["n"] for r in pieces_.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 < n <= size for n in hist):
        raise ValueError("a piece is empty or longer than a sequence")
    length, rank, times, first, offset = plan(hist, size)
    keys = length << 40 | rank
    ranked = gapless_rank(pieces_, "length", hist, ["doc_id", "piece", "ids_crc32"], "_rank")
    names = [f.name for f in pieces_.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "_rank"))
            k = np.searchsorted(keys, n.astype(np.int64) << 40 | r.astype(np.int64), side="right") - 1
            inside = r - rank[k]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(x)) for x in names] + [pa.array(first[k] + inside // times[k]), pa.array(offset[k] + inside % times[k] * n)], [*names, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_.schema.fields) + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, size: int = 2048, cache: int = WORDS) -> DataFrame:
    return pack(cut(pieces(docs, path, size, cache=cache)), size)


def op10_nnls_packing(spark: SparkSession, sf_dir: str, size: int = 2048, tokenizer: str = "word_bpe_49k.json", cache: int = 700_000) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(tokenizer), size, cache)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
