"""Generalised additive model with pairwise interactions, boosted one feature at a time.

Features describe the form of a whole text. Each is cut into bins at quantiles of the learning rows;
rounds go through the features in turn, fit a tree of at most four leaves to the gradient over the
bins, and add it to that feature's lookup table. The pairs with the largest gain that is left get
tables of their own, by trees that cut one feature and then the other. A score is the logistic of the
intercept and one table entry for each feature and pair, looked up for all rows at once.

Learning uses about ``rows`` labelled rows at most, chosen by a hash of the key; that is the only
bound here. Scores read whole texts and nothing but the text.

Defined cases: a null text counts as empty, and empty texts get a score; labels that are null or
neither 0 nor 1 are left out; a key with several labels counts with the smallest; without labels of
both kinds all scores are the smoothed share of 1; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import by_size, give_back, kept, parts_by_size, ship, table, with_text
from pagelake.llm.langid import fold
from pagelake.llm.simhash import _mix, word_hashes

FEATURES = [
    "log_bytes", "log_words", "word_length", "upper", "digit", "space", "newline", "stop_mark", "shout_mark", "bar", "bracket", "other_mark", "beyond_ascii", "control",
    "entropy", "distinct_words", "distinct_trigrams", "distinct_lines", "line_words", "long_words",
]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _byte_classes() -> np.ndarray:
    groups = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"-", b"!?", b"|", b"()[]{}<>", b"#$%&*+/=@\\^_`~", bytes(range(128, 256)), bytes(x for x in range(32) if x not in b" \t\n\r") + b"\x7f"]
    out = np.zeros((256, len(groups)))
    for k, g in enumerate(groups):
        out[list(g), k] = 1
    return out


_CLASSES = _byte_classes()


def _share_distinct(h: np.ndarray) -> float:
    if not len(h):
        return 1.0
    h = np.sort(h)
    return (1 + int((h[1:] != h[:-1]).sum())) / len(h)


def features(text: str | None) -> list[float]:
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    n = max(1, len(data))
    upper, digit, space, newline, stop, shout, bar, bracket, other, beyond, control = (counts @ _CLASSES / n).tolist()
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum()) if len(p) else 0.0
    h, lengths = word_hashes(data)
    words = len(h)
    three = _mix(h[:-2] * _ODD + _mix(h[1:-1]) * np.uint64(3) + h[2:]) if words > 2 else h[:0]
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        math.log1p(len(data)), math.log1p(words), float(lengths.mean()) if words else 0.0, upper, digit, space, newline, stop, shout, bar, bracket, other, beyond, control,
        entropy, _share_distinct(h), _share_distinct(three), len(set(lines)) / len(lines) if lines else 1.0, math.log1p(words / max(1, len(lines))), float((lengths > 18).mean()) if words else 0.0,
    ]


def _gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


def _cut(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, int]:
    """The best place to cut a row of bins: (gain, bins on the left); gain 0 where none helps."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    if not len(gl):
        return 0.0, 0
    gain = np.where((hl >= least) & (hr >= least), _gain(gl, hl, l2) + _gain(gr, hr, l2) - _gain(g.sum(), h.sum(), l2), 0.0)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> np.ndarray:
    """A tree of depth two over the bins of one feature: the step for each bin."""
    out = np.zeros(len(g))
    gain, k = _cut(g, h, l2, least)
    if gain <= 0:
        return out
    for lo, hi in ((0, k), (k, len(g))):
        inner, m = _cut(g[lo:hi], h[lo:hi], l2, least)
        for a, b in ((lo, lo + m), (lo + m, hi)) if inner > 0 else ((lo, hi),):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, np.ndarray]:
    """Cut the first feature, then the second on either side: (gain, the step for each cell)."""
    best, whole = (0.0, np.zeros(g.shape)), _gain(g.sum(), h.sum(), l2)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, a.shape[0]):
            gain, out = -whole, np.zeros(a.shape)
            for lo, hi in ((0, k), (k, a.shape[0])):
                x, y = a[lo:hi].sum(0), b[lo:hi].sum(0)
                more, m = _cut(x, y, l2, least)
                gain += more + _gain(x.sum(), y.sum(), l2)
                for s, e in ((0, m), (m, len(x))) if more > 0 else ((0, len(x)),):
                    out[lo:hi, s:e] = x[s:e].sum() / (y[s:e].sum() + l2)
            if gain > best[0]:
                best = (float(gain), out.T if flip else out)
    return best


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        for i, j, ei, ej, t in self.pairs:
            z += t[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, bins: int = 32, rate: float = 0.15, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40, l2: float = 2.0, least: float = 2.0) -> Model:
    ones = float(y.sum())
    model = Model(math.log((ones + 1) / (len(y) - ones + 1)))
    if not 0 < ones < len(y):
        return model
    n_features = x.shape[1]
    model.edges = [_edges(x[:, f], bins) for f in range(n_features)]
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(n_features):
            g, h = slopes()
            m = len(model.tables[f])
            step = rate * _tree(np.bincount(at[f], g, m), np.bincount(at[f], h, m), l2, least)
            model.tables[f] += step
            z += step[at[f]]
    coarse = [_edges(x[:, f], pair_bins) for f in range(n_features)]
    cell = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        m, n = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(cell[i] * n + cell[j], v, m * n).reshape(m, n)

    g, h = slopes()
    gains = sorted(((-_tree2(grid(i, j, g), grid(i, j, h), l2, least)[0], i, j) for i, j in combinations(range(n_features), 2)))[:pairs]
    kept = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in gains if gain < 0]
    for _ in range(pair_rounds):
        for i, j, t in kept:
            g, h = slopes()
            step = rate * _tree2(grid(i, j, g), grid(i, j, h), l2, least)[1]
            t += step
            z += step[cell[i], cell[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], t) for i, j, t in kept]
    return model


def _with_features(df: DataFrame, keep: list[str], then, name: str, kind: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``then`` of the features, called ``name``."""
    ship(df.sparkSession)
    sent, at = with_text(df, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelake.llm.quality import FEATURES, features

        kept(("quality",), dict)
        for whole in batches:
            for b in by_size(whole, at):
                x = np.array([features(t) for t in b.column(at).to_pylist()], float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), then(x)], [*keep, name])
        give_back()

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), f"`{name}` {kind}"])
    return sent.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 16_000, key: str = "doc_id", text: str = "text") -> Model:
    """A model from about ``rows`` labelled documents at most; that bound is what makes the broadcast safe."""
    usable = labels.filter(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).cast("int").alias("_y"))
    n = usable.count()
    draw = F.pmod(F.xxhash64(F.lit(29), F.col(key)), F.lit(1_000_000))
    chosen = usable.filter(draw < min(1_000_000, -(-rows * 1_000_000 // max(1, n))))
    known = docs.select(key, text).join(F.broadcast(chosen), key)
    got = _with_features(known, ["_y"], lambda x: pa.array(x.tolist(), pa.list_(pa.float64())), "f", "array<double>", text).collect()
    got.sort(key=lambda r: (r["_y"], r["f"]))
    x = np.array([r["f"] for r in got], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["_y"] for r in got], float))


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` with the score, called ``name``."""
    return _with_features(df, keep, lambda x: pa.array(model.score(x), pa.float64()), name, "double", text)


def scored(model: Model, text: str = "text") -> Column:
    """The score of a text. Only the text goes to Python."""

    @F.arrow_udf("double")
    def score_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pagelake.llm.quality import FEATURES, features

        kept(("quality",), dict)
        for b in batches:
            x = [features(t) for part in parts_by_size(b) for t in part]
            yield pa.array(model.score(np.array(x, float).reshape(-1, len(FEATURES))), pa.float64())
            give_back()

    return score_of(F.col(f"`{text}`"))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    return learn(docs, labels.filter(fold("doc_id", 3) != 1))


def op8_boosted_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learned(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")), ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
