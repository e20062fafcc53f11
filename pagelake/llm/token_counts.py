"""Exact byte-level BPE token counts at every prefix by dynamic programming over last tokens.

For a merge-ordered BPE the encoding of a string is the one segmentation in which each neighbouring
pair of tokens is itself the encoding of its concatenation. So the last token of prefix ``i`` is the
one token ``t`` that ends there and is compatible with the last token of prefix ``i - len(t)``; one
pass stores, for every prefix, its last token and its count. A piece of the pre-tokenizer is encoded
alone, so pieces are solved once and kept in a bounded cache, and running sums over pieces give the
count of every prefix of a whole text. Counts, truncation and budgets are then lookups.

Defined cases: a null or empty text has 0 tokens; equal texts have equal counts; texts of any length
are read whole in time linear in their length; the table's other columns are kept unless a column of
the same name is added, which then replaces them.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import by_size, kept, ship, table, tokenizer_path

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE files. White space is Unicode's property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces and words whose totals a worker keeps at most.
CACHE = 500_000
#: White space other than spaces and line feeds.
ODD_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _plain(text: str) -> bool:
    """Words stand between single spaces or line feeds, so that each is encoded alone."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or ODD_SPACE.search(text))


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix counts of one vocabulary file. ``cache``: pieces whose totals are kept at most."""

    def __init__(self, path: str, cache: int = CACHE):
        spec = json.load(open(path, encoding="utf-8"))
        chars = _byte_chars()
        raw = {k: bytes(chars[c] for c in k) for k in spec["model"]["vocab"]}
        self.ids = {raw[k]: i for k, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merge = {(self.ids[raw[a]], self.ids[raw[b]]): (n, self.ids[raw[a] + raw[b]]) for n, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split_special = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.find = regex.compile(PIECES).findall
        self.parts_of = {new: (n, a, b) for (a, b), (n, new) in self.merge.items()}
        self.pairs: dict[int, bool] = {}
        self.ends: dict[tuple[int, int], list[tuple[int, float]]] = {}
        alone: dict[int, bool] = {}
        for t, (n, x, y) in sorted(self.parts_of.items(), key=lambda kv: kv[1][0]):
            alone[t] = alone.get(x, True) and alone.get(y, True) and self._joins(x, y, n)
        self.able = {b: i for b, i in self.ids.items() if alone.get(i, len(b) == 1)}
        self.limit = cache
        self.totals: dict[str, int] = _Totals(self, "")
        self.spaced: dict[str, int] = _Totals(self, " ")

    def _side(self, t: int, right: int) -> list[tuple[int, float]]:
        """The parts of ``t`` at its right (or left) end, each with the rank of the merge that ends it."""
        if (out := self.ends.get((t, right))) is None:
            out, until, x = [], float("inf"), t
            while True:
                out.append((x, until))
                if x not in self.parts_of:
                    break
                until, *two = self.parts_of[x]
                x = two[right]
            self.ends[t, right] = out
        return out

    def _joins(self, a: int, b: int, until: float = float("inf")) -> bool:
        """Whether no merge across the border of a and b comes before their own merges, or ``until``.

        Of equal merges the left one comes first, hence the two kinds of comparison.
        """
        merge = self.merge
        for x, p in self._side(a, 1):
            for y, q in self._side(b, 0):
                if (m := merge.get((x, y))) is not None and m[0] < p and m[0] <= q and m[0] < until:
                    return False
        return True

    def piece(self, data: bytes) -> tuple[list[int], list[int]]:
        """For every prefix of one piece: its token count and its last token (-1 for the empty one)."""
        count, last = [0] * (len(data) + 1), [-1] * (len(data) + 1)
        get, pairs, longest = self.able.get, self.pairs, self.longest
        for i in range(1, len(data) + 1):
            for j in range(i - 1, max(-1, i - longest - 1), -1):
                t = get(data[j:i])
                if t is None:
                    continue
                if j:
                    key = last[j] << 20 | t
                    if (ok := pairs.get(key)) is None:
                        if len(pairs) >= 500_000:
                            pairs.clear()
                        ok = pairs[key] = self._joins(last[j], t)
                    if not ok:
                        continue
                count[i], last[i] = count[j] + 1, t
                break
        return count, last

    def ids_of(self, text: str) -> list[int]:
        """Token ids by walking last tokens back; for tests and decoding, not for counting."""
        out: list[int] = []
        for part, special in self._parts(text):
            for x in self.find(part):
                data = x.encode()
                last, got, i = self.piece(data)[1], [], len(data)
                while i:
                    got.append(last[i])
                    i -= len(self.bytes_of[last[i]])
                out += got[::-1]
            if special:
                out.append(next(i for i, b in self.bytes_of.items() if b == special.encode()) if special.encode() in self.ids else -1)
        return out

    def _parts(self, text: str) -> list[tuple[str, str]]:
        if self.split_special is None or not any(s in text for s in self.special):
            return [(text, "")]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out.append((text[at : m.start()], m[0]))
            at = m.end()
        return [*out, (text[at:], "")]

    def pieces(self, text: str) -> list[str]:
        """Units that are encoded alone, in order: pieces, special strings, or where words are plainly
        spaced whole words with the space before them."""
        if _plain(text) and not any(x in text for x in self.special):
            out = []
            for k, line in enumerate(text.split("\n")):
                first, *rest = line.split(" ")
                out += ["\n"] * bool(k) + [first] * bool(first) + [" " + w for w in rest]
            return out
        out = []
        for part, special in self._parts(text):
            out += self.find(part)
            if special:
                out.append(special)
        return out

    def total(self, text: str | None) -> int:
        """The count of the longest prefix, the text itself."""
        if not text:
            return 0
        if not _plain(text) or any(x in text for x in self.special):
            return sum(map(self.totals.__getitem__, self.pieces(text)))
        n, of, spaced = 0, self.totals, self.spaced.__getitem__
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            n += (of[first] if first else 0) + sum(map(spaced, rest))
        return n + text.count("\n") * of["\n"]

    def table(self, text: str) -> tuple[list[str], list[int], list[int]]:
        """Units, where they start, and the tokens before each: all that prefix questions need."""
        pieces = self.pieces(text)
        return pieces, [0, *accumulate(map(len, pieces))], [0, *accumulate(self.spaced[x[1:]] if x[0] == " " else self.totals[x] for x in pieces)]

    def prefix_total(self, text: str, end: int, pieces: list[str], starts: list[int], before: list[int]) -> int:
        """The exact count of text[:end]; only the piece that it cuts and the one before are read again."""
        k = max(0, bisect_right(starts, max(0, end - 1)) - 1)
        k = max(0, k - 1)
        return before[k] + self.total(text[starts[k] : end])

    def prefix_counts(self, text: str) -> list[int]:
        """The count of every prefix, by code points, from the empty one to the whole text."""
        pieces, starts, before = self.table(text)
        return [self.prefix_total(text, e, pieces, starts, before) for e in range(len(text) + 1)]

    def cut(self, text: str | None, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        if not text:
            return 0
        reach = 8 * budget + 64
        while True:
            part = text[:reach]
            pieces, starts, before = self.table(part)
            k = bisect_right(before, budget) - 1  # pieces before k fit, piece k does not
            if len(part) == len(text) or k + 4 < len(pieces):
                break
            reach *= 4
        if before[-1] <= budget:
            return len(text)
        stop = min(len(part), starts[min(k + 2, len(pieces))])
        for e in range(stop, -1, -1):
            if self.prefix_total(part, e, pieces, starts, before) <= budget:
                return e
        return 0


class _Totals(dict):
    """Totals of units behind ``lead``. When full it starts anew, and takes what is asked again from before."""

    def __init__(self, counter: PrefixCounter, lead: str):
        super().__init__()
        self.counter, self.lead, self.old = counter, lead, {}

    def __missing__(self, unit: str) -> int:
        if (n := self.old.get(unit)) is None:
            c, text = self.counter, self.lead + unit
            if unit.isalpha():  # one piece: letters, with or without the space
                n = c.piece(text.encode())[0][-1]
            elif text in c.special:
                n = 1
            elif unit[:-1].isalpha() and unit[-1] in ".,;:!?|":
                n = self[unit[:-1]] + c.totals[unit[-1]]
            elif len(found := c.find(text)) > 1:
                n = sum(map(c.totals.__getitem__, found))
            else:
                n = c.piece(text.encode())[0][-1]
        if len(unit) <= 64:
            if len(self) >= self.counter.limit:
                self.old = dict(self)
                self.clear()
            self[unit] = n
        return n


def counter(path: str) -> PrefixCounter:
    return kept(("token_counts", path), lambda: PrefixCounter(path))


def count_tokens(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", budget: int | None = None) -> DataFrame:
    """key, n_bytes, n_tokens, and with a budget cut_chars: the longest prefix within it, in code points."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelake.llm.token_counts import counter

        c = counter(path)
        for b in (part for whole in batches for part in by_size(whole, 1)):
            texts = b.column(1).to_pylist()
            n = [c.total(t) for t in texts]
            cols = [b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64())]
            names = [key, "n_bytes", "n_tokens"]
            if budget is not None:
                cols.append(pa.array([len(t or "") if k <= budget else c.cut(t, budget) for t, k in zip(texts, n)], pa.int64()))
                names.append("cut_chars")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{key}` {kind}, n_bytes long, n_tokens long" + (", cut_chars long" if budget is not None else "")
    return df.select(key, text).mapInArrow(run, schema)


def prefix_table(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, prefix_tokens: the exact count of every prefix, an array of one more than the code points."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelake.llm.token_counts import counter

        c = counter(path)
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([c.prefix_counts(t or "")], pa.list_(pa.int64()))], [key, "prefix_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, prefix_tokens array<long>")


def op4_prefix_tokens(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(tokenizer), budget=limit)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cut_chars")
