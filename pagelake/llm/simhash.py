"""SimHash: weighted term hashes vote on signed bits; permuted block tables find near fingerprints.

Terms are pairs of neighbouring words (with the text's ends as words of their own, so that one word
is enough), a pair weighing as much as its words are long, at most 12 each. Each term's 256-bit hash
votes for or against each bit with that weight; a bit is set where the votes are above 0. Hashes of
all words of a batch come from one running polynomial sum over its bytes, without a step per word.

Defined cases: null and empty texts have no terms and the all-zero fingerprint; equal texts have
equal fingerprints; repeated keys are ordered by text; a null key is ordered first; a single row is
its own next; very long texts vote in blocks; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import cut, ship, table

BITS = 256
BLOCK = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(1099511628211)
_SALTS = (np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[None, :]
#: Scripts without spaces: each character is a word.
_ALONE = re.compile("[⺀-鿿가-힣\U00020000-\U0003ffff]")
_LOWEST = -(2**63)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser by shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the step and of its inverse, as many as were ever needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            back = np.uint64(pow(int(_STEP), -1, 2**64))
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _STEP, np.uint64), dtype=np.uint64)])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, back, np.uint64), dtype=np.uint64)])
        return self.up, self.down


_powers = _Powers()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and length of each run of bytes above 0x20."""
    b = np.frombuffer(data, np.uint8)
    word = np.zeros(len(b) + 2, np.int8)
    np.greater(b, 32, out=word[1:-1], casting="unsafe")
    edge = np.diff(word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers.get(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * up[: len(b)], dtype=np.uint64, out=total[1:])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), end - start


def fingerprint(text: str | None) -> np.ndarray:
    """The 32 bytes of one text."""
    if not text:
        return np.zeros(BITS // 8, np.uint8)
    if not text.isascii() and _ALONE.search(text):
        text = _ALONE.sub(r" \g<0> ", text)
    h, n = word_hashes(text.lower().encode())
    if not len(h):
        return np.zeros(BITS // 8, np.uint8)
    h = np.concatenate([[np.uint64(1)], h, [np.uint64(2)]])
    n = np.concatenate([[0], np.minimum(n, 12), [0]])
    terms, weight = h[:-1] * _ODD + (h[1:] ^ (h[1:] >> np.uint64(29))), (n[:-1] + n[1:]).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for k in range(0, len(terms), BLOCK):
        w = weight[k : k + BLOCK]
        bits = np.unpackbits(_mix(terms[k : k + BLOCK, None] + _SALTS).view(np.uint8), axis=1)
        votes += 2 * (w @ bits.astype(np.float32)) - w.sum(dtype=np.float64)
    return np.packbits(votes > 0)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 minus the share of bits that differ, for rows of packed bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=-1) / BITS


def add_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint as lowercase hex."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def hexed(texts: pd.Series) -> pd.Series:
        from pagelake.llm.simhash import fingerprint

        return pd.Series([fingerprint(t).tobytes().hex() for t in texts])

    return df.withColumn(out, hexed(F.col(text)))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two hex fingerprints."""
    total = F.lit(0)
    for k in range(0, BITS // 4, 8):
        x, y = (F.conv(F.substring(c, k + 1, 8), 16, 10).cast("long") for c in (a, b))
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def near(classes: DataFrame, radius: int, spare: int = 2, hot: int = 256) -> DataFrame:
    """All pairs a < b of different fingerprints at most ``radius`` bits apart: a, b, distance.

    ``classes`` has one row for each different ``fingerprint``. The bits are cut into radius + spare
    blocks; two fingerprints within the radius agree on ``spare`` blocks at least, so a table for each
    choice of ``spare`` blocks, with those blocks moved to the front as its key, holds every pair in
    one bucket. A bucket of more than ``hot`` rows is joined on its key and one more block of the
    rest, which again loses none: of the blocks that are left at most ``radius`` can differ, and there
    are radius + 1 sub-blocks.
    """
    digits = BITS // 4
    blocks = radius + spare
    edge = [digits * k // blocks for k in range(blocks + 1)]
    ids = classes.select("fingerprint").distinct()
    keyed = []
    for chosen in combinations(range(blocks), spare):
        rest = [k for k in range(blocks) if k not in chosen]
        part = lambda ks: F.concat(*[F.substring("fingerprint", edge[k] + 1, edge[k + 1] - edge[k]) for k in ks])
        keyed.append(F.struct(F.concat(F.lit("-".join(map(str, chosen)) + ":"), part(chosen)).alias("key"), part(rest).alias("rest")))
    rows = ids.select("fingerprint", F.explode(F.array(*keyed)).alias("t")).select("fingerprint", "t.key", "t.rest")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(sizes, "key")
    wide = F.length("rest")
    subs = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda i: F.concat(F.col("key"), F.lit("/"), i.cast("string"), F.lit(":"), F.substring(F.col("rest"), (F.floor(wide * i / (radius + 1)) + 1).cast("int"), (F.floor(wide * (i + 1) / (radius + 1)) - F.floor(wide * i / (radius + 1))).cast("int"))))
    fine = rows.select("fingerprint", F.explode(F.when(F.col("n") > hot, subs).otherwise(F.array("key"))).alias("key"))
    a, b = fine.select("key", F.col("fingerprint").alias("a")), fine.select("key", F.col("fingerprint").alias("b"))
    pairs = a.join(b, "key").filter("a < b").withColumn("distance", hamming(F.col("a"), F.col("b"))).filter(F.col("distance") <= radius)
    return pairs.select("a", "b", "distance").distinct()


def with_next(df: DataFrame, text: str = "text", key: str = "doc_id", rows_per_bucket: int = 2000, most_buckets: int = 50_000) -> tuple[DataFrame, list[int]]:
    """Rows dealt by ranges of the key, so that a task sees each row's successor.

    The first keys of the ranges (``most_buckets`` at most) are found from the key column alone. The
    row that heads a range is also sent, marked ``ahead``, to the range before, and the first of all
    to the last range. Columns: bucket, ahead, key, text, sorted by them inside a partition.
    """
    ship(df.sparkSession)
    at = F.coalesce(F.col(key), F.lit(_LOWEST))
    keys = df.select(at.alias("k"))
    n = max(1, min(most_buckets, -(-keys.count() // rows_per_bucket)))
    heads = sorted(r["k"] for r in keys.repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")).collect())
    first, last = np.array(heads, np.int64), max(0, len(heads) - 1)

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        """The row's range, and where it heads one the range before; that one comes second."""
        b = np.searchsorted(first, k.to_numpy(np.int64), side="right") - 1
        return pd.Series([[x, x - 1 if x else last] if first[x] == v else [x] for x, v in zip(b.tolist(), k.tolist())])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.posexplode(places(at)).alias("ahead", "bucket"))
    return rows.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bucket").sortWithinPartitions("bucket", "ahead", "key", "text"), heads


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to one another and the next."""
    rows, _ = with_next(df, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelake.llm.simhash import edited, fingerprint, likeness

        names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        out: list[tuple] = []
        waiting = None  # bucket, key, text, fingerprint of the row whose next is not yet seen

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:5]), *(pa.array(c, pa.float64()) for c in cols[5:])], names)

        for b in batches:
            for bucket, ahead, k, t in zip(*(b.column(i).to_pylist() for i in range(4))):
                t = t or ""
                if ahead and (waiting is None or waiting[0] != bucket):
                    continue  # the rows that tie with the one ahead
                own = fingerprint(t)
                if waiting is not None:
                    _, k0, t0, f0 = waiting
                    new = edited(t0, t)
                    f1 = fingerprint(new)
                    out.append((k0, len(t0), hashlib.sha256(new.encode()).hexdigest(), f0.tobytes().hex(), f1.tobytes().hex(), float(likeness(f0, f1)), float(likeness(f0, own))))
                    if len(out) >= 2000:
                        yield emit()
                waiting = None if ahead else (bucket, k, t, own)
        if out:
            yield emit()

    schema = f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ordered = rows.select("bucket", "ahead", F.col("key").cast("long"), "text")
    return ordered.mapInArrow(run, schema)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def near_documents(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Classes of equal fingerprints, and the classes within ``radius``: a, b, distance by representatives."""
    marked = cut(add_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fingerprint"))
    classes = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    ids = classes.select("fingerprint", "doc_id")
    pairs = near(classes, radius)
    return pairs.join(ids.toDF("a", "doc_a"), "a").join(ids.toDF("b", "doc_b"), "b").select("doc_a", "doc_b", "distance")
