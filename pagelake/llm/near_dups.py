"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Each document's set of word shingles is hashed once; the k smallest values are its sketch, and a
   digest of the whole set makes documents of equal sets one class. All further work is on classes.
2. Inverted lists of the sketch values give overlaps: classes that share a value of a list of at most
   ``hot`` classes are candidates, if their sizes and the number of values shared allow the
   similarity. Values of longer lists are hot.
3. A class with few values that are not hot could miss a partner that way. Those classes (``heavy``)
   also take part with their whole sets, as a prefix join: shingles ordered from rare to frequent
   among them, each class listed under its first |set| - ceil(s |set|) + 1 shingles, of which two
   similar sets share one at least; the place in that order bounds the overlap and drops pairs early.
   A list longer than ``hot`` first gives a star around one class, drawn by a hash of list and class, so
   that a class meets another hub in each of its lists.
4. The union sketch of a pair (the k smallest of both sketches) estimates the similarity; pairs well
   below are dropped. The bound is so low that a similar pair fails it less than once in a million.
   A second bound has no misses: each class has the parities of its set's sizes in BUCKETS buckets, and the number of
   parities in which two sets differ is at most that of the shingles in which they differ. It also drops pairs of long
   lists as they are formed, so a group whose members are all a little too far apart doesn't give all its pairs.
5. Exact sets decide. First each class is confirmed with its best candidate, and components are formed;
   then every candidate pair that is still in two components is confirmed. Where long lists still have many
   pairs in two components, their classes beyond a list's largest component are tried against a few of
   that one, in rounds; at last all pairs of the long lists still in two components are confirmed. So a group of any size costs about its size, and no link
   between components is missed.

Defined cases: null or empty texts, and those without words, have the empty set and link with
nothing; fewer words than a shingle's are one shingle; equal sets are linked; a row with a null key
is a component of its own, with a null id; repeated rows each get their class's component; the key
must be an integer; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.llm.common import by_size, cut, free, give_back, kept, ship, table
from pagelake.llm.components import components, merged
from pagelake.llm.simhash import _mix, _powers

K = 32
HOT = 32
#: Of a sketch's values, the share that must be shared by a pair that is confirmed exactly.
LEAST = 0.35
#: Buckets whose parities are kept, 64 in a long.
BUCKETS = 1024
#: Of a sketch's values, the share of hot ones above which a class takes part with its whole set.
HEAVY = 0.38
#: Hubs that a class of a long list tries in a round, rounds at most (they end when few tries hit), and pairs a row of a
#: list that need no round.
TRIES, ROUNDS, FEW = 3, 4, 100
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 63-bit hashes of the text's shingles; A-Z count as a-z, words end at ASCII white space."""
    if not text:
        return np.zeros(0, np.int64)
    data = text.encode("utf-8", "surrogatepass").lower()
    b = np.frombuffer(data, np.uint8)
    word = np.zeros(len(b) + 2, np.int8)
    word[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.int64)
    up, down = _powers.get(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64, out=total[1:])
    h = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)
    size = min(words, len(h))
    s = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        s = _mix(s * _ODD + h[k : len(h) - size + 1 + k])
    return np.unique((s >> np.uint64(1)).astype(np.int64))


def parities(s: np.ndarray) -> np.ndarray:
    """Whether the number of the set's values in each of BUCKETS buckets is odd, as bits of longs."""
    return np.packbits(np.bincount(s & (BUCKETS - 1), minlength=BUCKETS) & 1).view(np.int64)


def sketches(docs: DataFrame, words: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n (size of the set), digest of the set, sketch (the K smallest values), odd (the parities)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelake.llm.near_dups import parities, shingle_set

        kept(("near_dups",), dict)
        for b in (part for whole in batches for part in by_size(whole, 1)):
            sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.string()), *(pa.array(x, pa.list_(pa.int64())) for x in ([s[:K] for s in sets], [parities(s) for s in sets]))], ["doc_id", "n", "digest", "sketch", "odd"])
        give_back()

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "doc_id long, n long, digest string, sketch array<long>, odd array<long>")


def _bits_of(ids: DataFrame, most_bits: int = 1 << 26) -> np.ndarray:
    """A bitmap with a bit for each id's hash: at most 8 MB, whatever the number of ids. Filled up, it lets all pass."""
    bits = 1 << max(15, min(most_bits, 16 * max(1, ids.count())).bit_length())
    bits = min(bits, most_bits)
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    rows = ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("page")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("map")).collect()
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in rows:
        out[int(r["page"])] = np.frombuffer(bytes(r["map"]), np.uint8)
    return out.ravel()


def whole_sets(docs: DataFrame, ids: DataFrame, words: int, text: str = "text", key: str = "doc_id", as_array: bool = False) -> DataFrame:
    """id, s (the set, 8 bytes a value, or an array) of the documents whose id is in ``ids``.

    A bitmap of a fixed size skips most others before their words are looked at; the join is exact.
    """
    ship(docs.sparkSession)
    bitmap = _bits_of(ids)
    bits = 8 * len(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelake.llm.near_dups import shingle_set

        for b in batches:
            at = b.column(1).to_numpy(zero_copy_only=False)
            some = pa.array(np.flatnonzero(bitmap[at >> 3] >> (at & 7) & 1))
            if len(some):
                for part in by_size(pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(2).take(some)], ["id", "t"]), 1):
                    sets = [shingle_set(t, words) for t in part.column(1).to_pylist()]
                    column = pa.array(sets, pa.list_(pa.int64())) if as_array else pa.array([s.tobytes() for s in sets], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), column], ["id", "s"])
        give_back()

    some = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), text)
    some = some.select("id", F.pmod(F.xxhash64("id"), F.lit(bits)).alias("at"), text).mapInArrow(run, "id long, s " + ("array<long>" if as_array else "binary"))
    return some.join(ids, "id", "left_semi")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches ``percent`` / 100."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(m), t.column(1).filter(m)], ["u", "v"])
        give_back()

    left = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "sa", "sb").mapInArrow(run, "u long, v long")


def _sizes_fit(na: Column, nb: Column, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _odd_fit(percent: int) -> Column:
    """Whether sets whose parities differ so often can still be similar: those of J >= s differ in (na + nb) (1 - s) / (1 + s) shingles at most."""
    differ = reduce(Column.__add__, (F.bit_count(F.col("oa")[k].bitwiseXOR(F.col("ob")[k])) for k in range(BUCKETS // 64)))
    return differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with the union sketch's estimate, those below LEAST and those of too different parities dropped."""
    a, b = (classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"o{x}")) for x in "ab")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u")))
    joined = pairs.join(a, "a").join(b, "b").filter(_odd_fit(percent)).withColumn("u", union).withColumn("est", shared / F.size("u"))
    return joined.filter(F.col("est") >= LEAST).select("a", "b", "est")


def _prefix_rows(docs: DataFrame, heavy: DataFrame, words: int, percent: int, text: str, key: str) -> DataFrame:
    """v, rep, n, pos: the heavy classes under the rare end of their sets."""
    sets = whole_sets(docs, heavy.select(F.col("rep").alias("id")), words, text, key, as_array=True)
    rows = cut(sets.select(F.explode("s").alias("v"), F.col("id").alias("rep"), F.size("s").cast("long").alias("n")))
    often = rows.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = rows.join(often, "v")
    by = Window.partitionBy("rep")
    shared = shared.withColumn("r", F.row_number().over(by.orderBy("c", "v"))).withColumn("m", F.count(F.lit(1)).over(by))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    # shingles of no other class come first: n - m of them
    found = cut(shared.withColumn("pos", F.col("n") - F.col("m") + F.col("r")).filter(F.col("pos") <= first).select("v", "rep", "n", "pos"))
    free(rows)
    return found


def _places_fit(percent: int) -> Column:
    """Whether sets that first meet at these places can still share enough."""
    rest = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return rest * (100 + percent) >= F.lit(percent) * (F.col("na") + F.col("nb"))


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    seen = cut(sketches(docs, words, text, key))
    classes = seen.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("odd").alias("odd"))
    classes = cut(classes)
    lists = classes.select(F.explode("sketch").alias("v"), "rep", "n")
    often = lists.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = cut(lists.join(often, "v"))
    hot = shared.filter(F.col("c") > HOT).groupBy("rep").agg(F.count(F.lit(1)).alias("hc"))
    cold = shared.filter(F.col("c") <= HOT).join(hot, "rep", "left").select("v", "rep", "n", F.coalesce("hc", F.lit(0)).alias("hc"))
    a, b = (cold.select("v", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("hc").alias(f"h{x}")) for x in "ab")
    both = a.join(b, "v").filter("a < b").filter(_sizes_fit(F.col("na"), F.col("nb"), percent))
    overlap = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("o"), F.min(F.least("ha", "hb")).alias("h"), F.min(F.least("na", "nb", F.lit(K))).alias("k"))
    candidates = [overlap.filter(F.col("o") + F.col("h") >= LEAST * F.col("k")).select("a", "b")]

    heavy = cut(hot.join(classes.select("rep", F.size("sketch").alias("k")), "rep").filter(F.col("hc") > HEAVY * F.col("k")).select("rep").distinct())
    long_lists = None
    if heavy.limit(1).count():
        rows = _prefix_rows(docs, heavy, words, percent, text, key)
        often = rows.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.min_by("rep", F.struct(F.xxhash64("rep", "v"), "rep")).alias("hub")).filter("c > 1")
        rows = rows.join(often, "v")
        a, b = (rows.filter(F.col("c") <= HOT).select("v", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}")) for x in "ab")
        candidates.append(a.join(b, "v").filter("a < b").filter(_sizes_fit(F.col("na"), F.col("nb"), percent) & _places_fit(percent)).select("a", "b"))
        long_lists = cut(rows.filter(F.col("c") > HOT).join(classes.select("rep", "odd"), "rep").select("v", "rep", "n", "pos", "hub", "odd"))
        candidates.append(long_lists.filter("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")))
    pairs = cut(_estimated(reduce(DataFrame.unionByName, candidates).distinct(), classes, percent))
    free(shared, heavy)

    def confirmed(some: DataFrame) -> DataFrame:
        ids = cut(some.select(F.col("a").alias("id")).unionByName(some.select(F.col("b").alias("id"))).distinct())
        sets = cut(whole_sets(docs, ids, words, text, key))
        out = cut(confirm(some.select("a", "b"), sets, percent))
        free(ids, sets)
        return out

    best = cut(pairs.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")).select("a", "b"))
    roots = components(confirmed(best))
    root = lambda df, x: df.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")), x, "left").withColumn(f"r{x}", F.coalesce(f"r{x}", x))
    apart = cut(root(root(pairs.join(best, ["a", "b"], "left_anti"), "a"), "b").filter("ra <> rb").select("a", "b"))
    if apart.limit(1).count():
        roots = merged(roots, confirmed(apart))
    if long_lists is not None:
        rows = long_lists.withColumnRenamed("rep", "x").drop("hub")
        for k in range(ROUNDS + 1):
            lists = cut(_with_main(root(rows, "x")))
            size = lists.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rx") != F.col("main")).alias("o")).agg(F.count(F.lit(1)).alias("lists"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("o")).alias("pairs")).first()
            if k == ROUNDS or (size["pairs"] or 0) <= FEW * (size["rows"] or 0):
                break
            tried = cut(_estimated(_tries(lists, k, percent), classes, percent))
            if tried.count() <= 2 * TRIES * size["lists"]:  # about two pairs a row of a list are left, so all can be confirmed
                break
            found = confirmed(tried)
            roots = merged(roots, found)
            if 20 * found.count() < tried.count():
                lists = cut(_with_main(root(rows, "x")))
                break
        apart = cut(_across(lists, classes, percent))
        if apart.limit(1).count():
            roots = merged(roots, confirmed(apart))
    member = seen.select("doc_id", "digest", "n").join(classes.select("digest", "rep"), "digest", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return member.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _with_main(rows: DataFrame) -> DataFrame:
    """Rows of the lists of more than one component, with the list's largest one."""
    counts = rows.groupBy("v", "rx").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("v").agg(F.max_by("rx", F.struct("c", -F.col("rx"))).alias("main"), F.count(F.lit(1)).alias("of")).filter("of > 1")
    return rows.join(main.drop("of"), "v")


def _tries(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of a list beyond its main component, each with TRIES rows of that one whose sizes and parities fit."""
    drawn = [F.min_by(F.struct("x", "n", "odd"), F.struct(F.xxhash64(F.lit(k * TRIES + j + 1), "x", "v"), "x")) for j in range(TRIES)]
    hubs = rows.filter("rx = main").groupBy("v").agg(F.array_distinct(F.array(*drawn)).alias("hubs")).select("v", F.explode("hubs").alias("h"))
    hubs = hubs.select("v", F.col("h.x").alias("hub"), F.col("h.n").alias("nb"), F.col("h.odd").alias("ob"))
    met = rows.filter("rx <> main").withColumnsRenamed({"n": "na", "odd": "oa"}).join(hubs, "v").filter(_sizes_fit(F.col("na"), F.col("nb"), percent) & _odd_fit(percent))
    return met.select(F.least("x", "hub").alias("a"), F.greatest("x", "hub").alias("b")).distinct()


def _across(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of long lists (with their main component) that are in two components: all but the main one against the others."""
    a = rows.filter("rx <> main").select("v", F.col("x").alias("a"), F.col("rx").alias("ra"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("odd").alias("oa"))
    b = rows.select("v", F.col("x").alias("b"), F.col("rx").alias("rb"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("odd").alias("ob"), (F.col("rx") == F.col("main")).alias("in_main"))
    met = a.join(b, "v").filter(F.col("ra") != F.col("rb")).filter(F.col("in_main") | (F.col("a") < F.col("b"))).filter(_sizes_fit(F.col("na"), F.col("nb"), percent) & _places_fit(percent) & _odd_fit(percent))
    return _estimated(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes, percent).select("a", "b")


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), words=4)


def expected_misses(k: int = K, least: float = LEAST, s: float = 0.8) -> float:
    """The chance that the estimate of a pair of similarity ``s`` falls below ``least``."""
    return sum(math.comb(k, i) * s**i * (1 - s) ** (k - i) for i in range(math.ceil(least * k)))
