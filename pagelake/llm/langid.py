"""Hyperdimensional language profiles: letter vectors bound into trigrams, bundled, compared by cosine.

Each letter has a fixed random vector of +1 and -1. A trigram's vector is the product of its letters'
vectors, the first rotated twice and the second once; a text's vector is the sum over its trigrams. A
language's prototype is the sum of the unit vectors of its learning texts. A text gets the language of
the largest cosine; equal ones go to the first by name.

Learning reads all texts whose language is not null, whole, and so does learning the least cosines;
only sums and counts come to the driver. Prediction reads whole texts and nothing but the text.

Least cosines are learned from labelled texts that the prototypes have not seen, whole and in stretches
of 1, 2, 4 and so on words: for each language and length, half of the cosine that 99 in 100 reach. Where
that cosine is no more than chance gives (NOISE / sqrt(dim)) there is none, so short texts stay; it never
falls as texts get longer. It tells unknown scripts and noise, not an unknown language that shares its
trigrams with a learned one.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is any text where
nothing could be learned; runs of other characters count as one space; text shorter than a trigram is
padded with spaces; equal texts have equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import by_size, give_back, kept, parts_by_size, ship, table, with_text

DIM = 1024
SLOTS = 1024
#: What a unit vector's length is learned in: sums of two thousand million stay whole.
UNIT = float(1 << 32)
#: What cosines are counted in, rounded down, to find the one that 99 in 100 reach.
STEPS = 1 << 16
#: Trigram vectors that a worker keeps, and that it adds up at once.
KNOWN, AT_ONCE = 32_768, 2048
#: Standard deviations of a chance cosine that learned texts must be above, stretches that a length needs, lengths.
NOISE, ENOUGH, LENGTHS = 4.0, 50, 64


@functools.cache
def _slots() -> np.ndarray:
    """Each code point's letter number: 0 for what is no letter; numbers are shared beyond U+0373."""
    out = np.zeros(0x110000, np.int32)
    cps = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()], np.int64)
    low = cps < 0x374
    out[cps[low]] = cps[low] - 0x40
    out[cps[~low]] = 820 + (cps[~low] % 200)
    return out


class Space:
    """Letter vectors and the trigram vectors met so far, at most KNOWN."""

    def __init__(self, dim: int = DIM, seed: int = 20_240_601):
        rng = np.random.default_rng(seed)
        base = (rng.integers(0, 2, (SLOTS, dim), dtype=np.int8) * 2 - 1).astype(np.int8)
        self.dim, self.r0, self.r1, self.r2 = dim, base, np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
        self.codes, self.order = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vectors = np.empty((KNOWN, dim), np.int8)  # the system gives its memory as rows are filled

    def _bind(self, codes: np.ndarray) -> np.ndarray:
        return self.r2[codes >> 20] * self.r1[codes >> 10 & 1023] * self.r0[codes & 1023]

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Row numbers of trigram vectors; unknown ones are bound first."""
        for _ in range(2):
            if len(self.codes):
                at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
                if (self.codes[at] == codes).all():
                    return self.order[at]
            new = np.setdiff1d(codes, self.codes)
            if len(self.codes) + len(new) > KNOWN:
                new, self.codes, self.order = np.unique(codes), self.codes[:0], self.order[:0]
            all_codes, n = np.concatenate([self.codes, new]), len(self.codes)
            numbers = np.concatenate([self.order, np.arange(n, n + len(new))])
            self.vectors[n : n + len(new)] = self._bind(new)
            by = np.argsort(all_codes, kind="stable")
            self.codes, self.order = all_codes[by], numbers[by]
        raise AssertionError("unreachable")

    def vector(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The bundle of one text's trigrams."""
        out = np.zeros(self.dim, np.float32)
        for k in range(0, len(codes), AT_ONCE):
            rows = self.rows(codes[k : k + AT_ONCE])
            out += counts[k : k + AT_ONCE].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return out


def trigrams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, trigram codes, counts) of each text that has a letter."""
    slots = _slots()
    for i, t in enumerate(texts):
        if not t:
            continue
        s = slots[np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = s != 0
        if not keep.any():
            continue
        keep[1:] |= keep[:-1]  # one space after each run of letters
        s = np.concatenate([[0], s[keep], [0]]).astype(np.int64)
        codes = s[:-2] << 20 | s[1:-1] << 10 | s[2:]
        codes.sort()
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        yield i, codes[first], np.diff(np.append(first, len(codes)))


def space(dim: int) -> Space:
    return kept(("langid", dim), lambda: Space(dim))


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # unit rows

    def nearest(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, int]]:
        """(row, language number, cosine, length) of each text that has a letter; a length is the bits of the number of trigrams."""
        if self.languages:
            sp = space(self.prototypes.shape[1])
            for i, codes, counts in trigrams(texts):
                v = sp.vector(codes, counts)
                cos = self.prototypes @ v / max(float(np.linalg.norm(v)), 1e-12)
                k = int(np.argmax(cos))
                yield i, k, float(cos[k]), int(counts.sum()).bit_length()

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        for i, k, cos, _ in self.nearest(texts):
            names[i], scores[i] = self.languages[k], min(1.0, max(0.0, cos))
        return names, scores

    def like(self, texts: list[str | None], least: np.ndarray) -> list[bool]:
        """Whether each text is like its nearest prototype, by the least cosines of ``learn_least``."""
        out = [False] * len(texts)
        for i, k, cos, length in self.nearest(texts):
            out[i] = max(0.0, cos) >= least[k, length]
        return out


def stretches(text: str) -> Iterator[str]:
    """The text, and stretches of its words of each power of two that is shorter."""
    yield text
    words, n = text.split(), 1
    at = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    while n < len(words):
        first = at % (len(words) - n + 1)
        yield " ".join(words[first : first + n])
        n *= 2


def _known(labelled: DataFrame, text: str, lang: str, most_languages: int) -> DataFrame | None:
    """Language and text of all rows whose language is not null; None without rows."""
    known = labelled.filter(F.col(lang).isNotNull())
    languages = known.select(lang).distinct().limit(most_languages + 1).count()
    if languages > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    return known.select(lang, text) if languages else None


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", most_languages: int = 1000, dim: int = DIM) -> Profiles:
    """Prototypes from all rows whose language is not null."""
    ship(labelled.sparkSession)
    known = _known(labelled, text, lang, most_languages)
    if known is None:
        return Profiles((), np.zeros((0, dim), np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelake.llm.langid import space, trigrams

        sp, sums = space(dim), {}  # of each language, in units small enough and whole, so that the order of sums does not matter
        for b in (part for whole in batches for part in by_size(whole, 1)):
            names = b.column(0).to_pylist()
            for i, codes, counts in trigrams(b.column(1).to_pylist()):
                v = sp.vector(codes, counts).astype(np.float64)
                total = sums.setdefault(names[i], np.zeros(dim, np.int64))
                total += np.rint(v * (UNIT / max(np.linalg.norm(v), 1e-12))).astype(np.int64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dim, pa.string()), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "at", "x"])

    total: dict[str, np.ndarray] = {}
    for r in known.mapInArrow(run, "lang string, at int, x long").groupBy("lang", "at").agg(F.sum("x").alias("x")).collect():
        total.setdefault(r["lang"], np.zeros(dim))[r["at"]] = r["x"]
    names = tuple(sorted(total))
    rows = np.array([total[x] / max(np.linalg.norm(total[x]), 1e-12) for x in names], np.float32).reshape(len(names), dim)
    return Profiles(names, rows)


def learn_least(labelled: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang", most_languages: int = 1000) -> np.ndarray:
    """The least cosine of each language and length, from all rows given, which ``profiles`` has not learned; 0 where they show none."""
    ship(labelled.sparkSession)
    least = np.zeros((len(profiles.languages), LENGTHS))
    known = _known(labelled, text, lang, most_languages)
    if known is None or not profiles.languages:
        return least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelake.llm.langid import stretches

        for b in (part for whole in batches for part in by_size(whole, 1)):
            found: Counter = Counter()
            for t in b.column(1).to_pylist():
                found.update((k, length, math.floor(cos * STEPS)) for _, k, cos, length in profiles.nearest(list(stretches(t or ""))))
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in found], pa.int32()) for i in range(3)), pa.array(list(found.values()), pa.int64())], ["k", "length", "step", "n"])
        give_back()

    counts = known.mapInArrow(run, "k int, length int, step int, n long").groupBy("k", "length", "step").agg(F.sum("n").alias("n"))
    seen = counts.groupBy("k", "length").agg(F.sum("n").alias("of"), (F.percentile("step", F.lit(0.01), F.col("n")) / STEPS).alias("low"))
    low = {(r["k"], r["length"]): r["low"] for r in seen.filter(F.col("of") >= ENOUGH).collect()}
    chance = NOISE / np.sqrt(profiles.prototypes.shape[1])
    for k in range(len(profiles.languages)):
        known, so_far = sorted(n for j, n in low if j == k), np.inf
        for n in reversed(known):  # also for lengths beyond, up to the next that is known
            so_far = min(so_far, low[k, n] / 2 if low[k, n] > chance else 0.0)
            least[k, n:] = np.where(least[k, n:] > so_far, least[k, n:], so_far)
    return least


def like(profiles: Profiles, least: np.ndarray, text: str = "text") -> Column:
    """Whether the text is like a learned language. Only the text goes to Python."""

    @F.arrow_udf("boolean")
    def alike(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([x for part in parts_by_size(b) for x in profiles.like(part, least)], pa.bool_())
            give_back()

    return alike(F.col(f"`{text}`"))


def predict(df: DataFrame, profiles: Profiles, keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` with the language and the score, called ``names``."""
    ship(df.sparkSession)
    sent, at = with_text(df, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_size(whole, at):
                found, scores = profiles.predict(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])
        give_back()

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), f"`{names[0]}` string, `{names[1]}` double"])
    return sent.mapInArrow(run, schema)


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts))


def learned(docs: DataFrame) -> Profiles:
    return learn(docs.filter(fold("doc_id", 4) != 2))


def learned_least(docs: DataFrame, profiles: Profiles) -> np.ndarray:
    return learn_least(docs.filter(fold("doc_id", 4) == 2), profiles)


def op6_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = predict(docs, learned(docs), ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
