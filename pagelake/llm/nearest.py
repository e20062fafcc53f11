"""Nearest neighbours by learned partitions.

On a sample of at most SAMPLE vectors a neighbour graph is built and cut into parts of near equal size
(parts are grown along edges, then vertices move to the part that most of their neighbours are in,
within the size allowed). A small network learns which part a vector's neighbours are in. Every vector
is indexed in its most probable part; a query looks in its most probable parts, as many as the sample
needs for the recall asked for, and what it finds is reranked by the exact cosine.

Equal vectors are one class: the index and the searches hold classes, each with its few smallest ids,
which is all that a list of nearest rows can use. Large parts are cut into blocks of rows and of
queries, so a task holds a bounded number of both.

Defined cases: vectors that are null, zero, or hold a null or a component that is not finite take no
part, as candidate or query, nor do those of another length than the most common; fewer candidates
than asked for give fewer rows; ties go to the smaller id; repeated rows are kept as rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.llm.common import cut, ship, table

SAMPLE = 8192
#: Classes, and queries, in one task's block.
BLOCK = 4096


def unit(x: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that squares neither vanish nor overflow
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row of unit vectors, by blocks."""
    n, k = len(x), min(k, len(x) - 1)
    out = np.zeros((n, max(k, 0)), np.int32)
    for s in range(0, n, 1024):
        sim = (x[s : s + 1024] @ x.T).astype(np.float32)
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -np.inf
        if k > 0:
            out[s : s + 1024] = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, passes: int = 8, slack: float = 1.05, seed: int = 7) -> np.ndarray:
    """A part for each vertex: grown along the edges, then refined within the size allowed."""
    n = len(graph)
    edges: list[list[int]] = [list(r) for r in graph.tolist()]
    for i, r in enumerate(graph.tolist()):
        for j in r:
            edges[j].append(i)
    part, rng = np.full(n, -1), np.random.default_rng(seed)
    order, at = rng.permutation(n), 0
    for p in range(parts):
        want, heap, links = n * (p + 1) // parts - n * p // parts, [], {}
        while want:
            while heap and part[heap[0][1]] >= 0:
                heapq.heappop(heap)
            if heap:
                v = heapq.heappop(heap)[1]
            else:
                while part[order[at]] >= 0:
                    at += 1
                v = int(order[at])
            part[v] = p
            want -= 1
            for u in edges[v]:
                if part[u] < 0:
                    links[u] = links.get(u, 0) + 1
                    heapq.heappush(heap, (-links[u], u))
    size, most = np.bincount(part, minlength=parts), max(1, int(np.ceil(slack * n / parts)))
    for _ in range(passes):
        moved = 0
        for v in rng.permutation(n).tolist():
            if edges[v]:
                votes = np.bincount(part[edges[v]], minlength=parts)
                old = part[v]
                votes[(size >= most) & (np.arange(parts) != old)] = -1
                new = int(np.argmax(votes))
                if votes[new] > votes[old]:
                    part[v] = new
                    size[old] -= 1
                    size[new] += 1
                    moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """One hidden layer from a unit vector to the probability of each part; ``probes`` parts are searched."""

    weights: tuple[np.ndarray, ...]
    probes: int
    sample_recall: float

    @property
    def parts(self) -> int:
        return len(self.weights[3])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def best(self, x: np.ndarray, k: int) -> np.ndarray:
        z = self.logits(x.astype(np.float32))
        return np.argsort(-z, axis=1, kind="stable")[:, :k]


def train(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, batch: int = 256, rate: float = 3e-3, seed: int = 11) -> tuple[np.ndarray, ...]:
    """Adam on the cross entropy against the shares of each vector's neighbours in the parts."""
    rng = np.random.default_rng(seed)
    d, p = x.shape[1], target.shape[1]
    w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, p)), np.zeros(p)]
    w = [v.astype(np.float32) for v in w]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        lr = rate * (1 - epoch / epochs)
        for s in range(0, len(x), batch):
            idx = order[s : s + batch]
            a, y = x[idx], target[idx]
            h = np.maximum(a @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z -= z.max(axis=1, keepdims=True)
            q = np.exp(z)
            q /= q.sum(axis=1, keepdims=True)
            dz = (q - y) / len(idx)
            dh = (dz @ w[2].T) * (h > 0)
            grads, step = [a.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)], step + 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return tuple(w)


def fit(sample: np.ndarray, parts: int, near: int = 5, graph_k: int = 10, recall: float = 0.97) -> Router:
    """Cut the sample's graph, learn the parts, and count the probes that rows need which the router has not seen.

    Four rows in five are learned from, unless they are few; the fifth asks for its neighbours among all.
    """
    everything = unit(sample).astype(np.float32)
    asks = np.arange(len(everything)) % 5 == 4 if len(everything) >= 100 else np.ones(len(everything), bool)
    x = everything[~asks] if not asks.all() else everything
    parts = max(1, min(parts, len(x)))
    graph = neighbour_graph(x, graph_k)
    part = balanced_parts(graph, parts)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1)
    np.add.at(target, (np.arange(len(x)), part), 1)
    target /= target.sum(axis=1, keepdims=True)
    router = Router(train(x, target), parts, 1.0)
    mine, ranked = router.best(everything, 1)[:, 0], router.best(everything[asks], parts)
    truth = neighbour_graph(everything, near)[asks]
    place = np.argsort(ranked, axis=1)  # place[i, p]: how early query i would look in part p
    early = place[np.arange(len(place))[:, None], mine[truth]] if truth.shape[1] else np.zeros((len(place), 1), int)
    for probes in range(1, parts + 1):
        got = float((early < probes).mean())
        if got >= recall:
            break
    return Router(router.weights, probes, got)


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def usable(df: DataFrame, vector: str, key: str) -> DataFrame:
    """Rows that take part: vec_id and vec of the most common length."""
    inf = float("inf")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vec")).filter(F.col("vec").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return rows.filter(F.size("vec") == (sizes[0]["n"] if sizes else 0))


def classes_of(rows: DataFrame, kept: int) -> DataFrame:
    """One row for each different vector: h, vec, and its ``kept`` smallest ids, sorted."""
    rows = rows.withColumn("h", F.xxhash64("vec")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for by in (["h", "vec", "salt"], ["h", "vec"]):
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).filter(F.col("_k") <= kept)
    return rows.groupBy("h", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def search(rows: DataFrame, queries: DataFrame, near: int = 5, parts: int | None = None, recall: float = 0.97, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``near`` nearest rows of each query, itself left out.

    ``rows`` and ``queries`` come from usable(); queries are rows too.
    """
    spark = rows.sparkSession
    ship(spark)
    kept = near + 1  # a query's own row may be among the first
    classes = cut(classes_of(rows, kept))
    n = classes.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    rate = min(1_000_000, -(-int(0.95 * sample) * 1_000_000 // n))
    some = classes.filter(F.pmod("h", F.lit(1_000_000)) < rate).select("h", "vec").limit(sample).collect()
    some = some or classes.select("h", "vec").limit(sample).collect()
    some.sort(key=lambda r: (r["h"], r["vec"]))
    router = fit(np.array([r["vec"] for r in some], float), parts or max(4, min(256, n // 1024)), near, recall=recall)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = router.best(unit(_matrix(b.column(0))), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), *b.columns], ["part", "vec", "ids"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = router.best(unit(_matrix(b.column(0))), router.probes)
            i = np.repeat(np.arange(b.num_rows), p.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(p.ravel().astype(np.int32)), b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i))], ["part", "vec", "qid"])

    kind = rows.schema["vec"].dataType.simpleString()
    indexed = cut(classes.select("vec", "ids").mapInArrow(index, f"part int, vec {kind}, ids array<long>"))
    asked = queries.withColumn("h", F.xxhash64("vec"))
    classes_asked = asked.groupBy("h", "vec").agg(F.min("vec_id").alias("qid"))
    routed = cut(classes_asked.select("vec", "qid").mapInArrow(route, f"part int, vec {kind}, qid long"))

    def blocks(df: DataFrame) -> DataFrame:  # at most as many rows as parts
        return df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("of"))

    row_blocks, query_blocks = blocks(indexed).toDF("part", "rows_of"), blocks(routed).toDF("part", "queries_of")
    of = F.broadcast(row_blocks.join(query_blocks, "part"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(of, "part").withColumn("rb", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("rows_of")).cast("int")).select("part", "rb", spread("queries_of").alias("qb"), "vec", "ids")
    right = routed.join(of, "part").withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("queries_of")).cast("int")).select("part", spread("rows_of").alias("rb"), "qb", "vec", "qid")

    def look(a: pa.Table, b: pa.Table) -> pa.Table:
        from pagelake.llm.nearest import nearest_in

        q, v, s = nearest_in(_matrix(a["vec"]), a["ids"].to_pylist(), _matrix(b["vec"]), b["qid"].to_pylist(), kept) if a.num_rows and b.num_rows else ([], [], [])
        return pa.table({"qid": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    keys = ["part", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, "qid long, vec_id long, score double")
    ranked = found.withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_k") <= kept)
    lists = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    by_class = classes_asked.join(lists, "qid").select("h", "vec", "found")
    mine = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, near)
    out = asked.withColumnRenamed("vec_id", "query_id").join(by_class, ["h", "vec"]).select("query_id", F.posexplode(mine).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def nearest_in(rows: np.ndarray, ids: list[list[int]], queries: np.ndarray, qids: list[int], kept: int) -> tuple[list, list, list]:
    """The ``kept`` nearest rows of each query in one block: by matrix product, then exactly."""
    by = np.argsort([i[0] for i in ids], kind="stable")
    rows, ids = rows[by], [ids[k] for k in by]
    units, norm = unit(rows), np.sqrt((rows * rows).sum(axis=1))
    out: tuple[list, list, list] = ([], [], [])
    for s in range(0, len(queries), 256):
        sim = unit(queries[s : s + 256]) @ units.T
        if sim.shape[1] > kept:
            least = np.partition(sim, -kept, axis=1)[:, -kept] - 1e-9
        else:
            least = np.full(len(sim), -np.inf)
        for i, row in enumerate(sim):
            some = np.flatnonzero(row >= least[i])
            q = queries[s + i]
            exact = (rows[some] * q).sum(axis=1) / (norm[some] * np.sqrt((q * q).sum()))
            order = np.argsort(-exact, kind="stable")[:kept]  # rows stand in the order of their ids
            near = sorted(((-float(exact[k]), v) for k in order for v in ids[some[k]]))[:kept]
            out[0].extend([qids[s + i]] * len(near))
            out[1].extend(v for _, v in near)
            out[2].extend(-x for x, _ in near)
    return out


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    return search(rows, rows.filter(F.col("vec_id") % 50 == 0))
