"""Nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into parts of equal size; a small classifier learns
which parts hold a vector's neighbours; every vector is indexed under its likeliest part and every
query looks into its likeliest parts, where exact inner products rank the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import table
from kindred.sources.scratch import materialize

#: Vectors the partition and the classifier are fitted on (those of least id hash): 8 MB at 256 dimensions.
SAMPLE = 4000
PARTS, GRAPH_NEIGHBOURS, HIDDEN, EPOCHS = 32, 20, 64, 40
#: Recall the number of parts looked into is chosen for, on sampled vectors the classifier was not fitted on.
TARGET_RECALL = 0.94
TOP, QUERY_EVERY = 20, 20
#: Rows of one block of a part, and queries that meet it at once.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 8192


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of rows that take part: an id, and a vector that's neither null, empty nor zero, without null or non-finite components."""
    e = F.col("embedding")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = vectors.select("vec_id", e.cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    return v.where(F.forall(e, fine) & F.exists(e, lambda x: x != 0))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(x: np.ndarray, among: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    out = []
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ among.T
        if skip_self:
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out.append(np.argsort(-s, axis=1, kind="stable")[:, :k])
    return np.concatenate(out)


def partition(graph: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """Parts of sizes that differ by one at most, with few edges between: repeated halving by a smoothed random vector, then swaps."""
    n, k = graph.shape
    a, b = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()]), np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    rng, part, groups = np.random.default_rng(seed), np.zeros(n, np.int64), [np.arange(n)]
    while len(groups) < parts:
        halves = []
        for own in groups:
            inside = np.full(n, -1)
            inside[own] = np.arange(len(own))
            keep = (inside[a] >= 0) & (inside[b] >= 0)
            u, v = inside[a[keep]], inside[b[keep]]
            degree = np.maximum(1, np.bincount(u, minlength=len(own)))
            x = rng.standard_normal(len(own))
            for _ in range(30):
                x = 0.5 * x + 0.5 * np.bincount(u, x[v], len(own)) / degree
                x = (x - x.mean()) / max(x.std(), 1e-12)
            side = np.zeros(len(own), bool)
            side[np.argsort(x, kind="stable")[len(own) // 2 :]] = True
            for _ in range(8):  # swap the vertices that gain most, as many from either side
                there = np.bincount(u, side[v], len(own)) / degree
                gain = np.where(side, 1 - 2 * there, 2 * there - 1)
                left, right = (np.flatnonzero(side == s) for s in (False, True))
                left, right = (h[np.argsort(-gain[h], kind="stable")] for h in (left, right))
                m = min(len(left), len(right))
                good = np.flatnonzero(gain[left[:m]] + gain[right[:m]] <= 0.1)
                m = (good[0] if len(good) else m) // 2
                if not m:
                    break
                side[left[:m]], side[right[:m]] = True, False
            halves += [own[~side], own[side]]
        groups = halves
    for i, own in enumerate(groups):
        part[own] = i
    return part


class Router:
    """A perceptron with one hidden layer: probabilities of parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.scale = 1 / max(1e-12, float(np.sqrt((x * x).mean())))
        d, p = x.shape[1], target.shape[1]
        self.w = [rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, p)) / np.sqrt(HIDDEN), np.zeros(p)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                rows = order[at : at + 128]
                h, q = self._run(x[rows])
                back = (q - target[rows]) / len(rows)
                hidden = (back @ self.w[2].T) * (1 - h * h)
                grads, t = [(x[rows] * self.scale).T @ hidden + 1e-4 * self.w[0], hidden.sum(0), h.T @ back + 1e-4 * self.w[2], back.sum(0)], t + 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def _run(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x * self.scale @ self.w[0] + self.w[1])
        z = h @ self.w[2] + self.w[3]
        e = np.exp(z - z.max(1, keepdims=True))
        return h, e / e.sum(1, keepdims=True)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts from the likeliest on."""
        return np.argsort(-self._run(x)[1], axis=1, kind="stable")


def fit(x: np.ndarray, top: int = TOP, target: float = TARGET_RECALL) -> tuple[Router | None, int, int]:
    """(router, parts, parts to look into). Too few vectors make one part."""
    parts = PARTS
    while parts > 1 and len(x) < 16 * parts:
        parts //= 2
    if parts < 2:
        return None, 1, 1
    held = np.arange(len(x)) % 8 == 7  # the last eighth of every eight only chooses the number of parts
    graph = nearest(x, x, min(GRAPH_NEIGHBOURS, len(x) - 1), True)
    part = partition(graph, parts)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1 / graph.shape[1])
    router = Router(x[~held], soft[~held])
    order = router.order(x)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], 1)
    truth = nearest(x, x, min(top, len(x) - 1), True)[held]
    where = rank[held][np.arange(held.sum())[:, None], order[truth, 0]]
    share = [(where < r).mean() for r in range(1, parts + 1)]
    return router, parts, 1 + next(i for i, s in enumerate(share) if s >= target)


def _assign(batches, router: Router | None, dim: int, probes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.filter(pc.equal(pc.list_value_length(batch.column("embedding")), dim))
        if not own.num_rows:
            continue
        x = matrix(own.column("embedding"), dim)
        order = router.order(x)[:, :probes] if router else np.zeros((len(x), 1), np.int64)
        yield pa.RecordBatch.from_arrays([own.column("vec_id").cast(pa.int64()), own.column("embedding"), pa.array(order[:, 0]), pa.array(list(order), pa.list_(pa.int64()))], ["vec_id", "embedding", "part", "probes"])


def rank_block(queries: np.ndarray, ids: np.ndarray, q: np.ndarray, x: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's best in a block. Candidates are recomputed in one fixed order of summation, so equal vectors tie."""
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ x.T
        s[queries[at : at + 256, None] == ids[None, :]] = -np.inf
        k = min(top, s.shape[1])
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        for i in range(len(s)):
            near = np.flatnonzero((s[i] >= least[i] - 1e-9 * (1 + abs(least[i]))) & (s[i] > -np.inf))
            exact = (x[near] * q[at + i]).sum(1)
            best = np.lexsort((ids[near], -exact))[:top]
            yield int(queries[at + i]), ids[near][best], exact[best]


def _search(left: pa.Table, right: pa.Table, dim: int, top: int) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("found", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    rows = list(rank_block(left["query_id"].to_numpy(), right["vec_id"].to_numpy(), matrix(left["embedding"], dim), matrix(right["embedding"], dim), top))
    return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], schema=schema)


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, top: int = TOP, every: int = QUERY_EVERY, sample: int = SAMPLE) -> DataFrame:
    """The `top` candidates of largest inner product found for every vector whose id is divisible by `every`.

    Every usable vector is indexed. Vectors of another length than most sampled ones take no
    part. Parts are cut into blocks of BLOCK_ROWS rows by a hash of the id, and their queries
    into blocks of BLOCK_QUERIES, so no task holds a whole part however large or hot it is. A
    query without usable candidates, and an empty table, give no rows. A repeated vec_id is as many candidates,
    and none of a query of that id.
    """
    spark = vectors.sparkSession
    v = usable(vectors)
    drawn = v.select(F.xxhash64("vec_id").alias("h"), "vec_id", "embedding").orderBy("h", "vec_id").limit(sample).select("embedding").toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], RESULT)
    lengths = np.diff(np.concatenate([[0], np.cumsum(pc.list_value_length(drawn["embedding"]).to_numpy())]))
    dim = int(np.bincount(lengths).argmax())
    x = matrix(drawn.filter(pa.array(lengths == dim))["embedding"], dim)
    router, parts, probes = fit(x, top)
    index = materialize(v.mapInArrow(lambda b: _assign(b, router, dim, probes), "vec_id long, embedding array<double>, part long, probes array<bigint>"), "index")
    queries = index.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "embedding", F.explode("probes").alias("part")).dropDuplicates(["query_id", "part"])
    rows = {r.part: r.n for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}
    asked = {r.part: r.n for r in queries.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = lambda have, size: F.element_at(F.create_map(*[F.lit(z) for p in range(parts) for z in (p, -(-have.get(p, 1) // size))]), F.col("part").cast("int"))
    row_blocks, query_blocks = blocks(rows, BLOCK_ROWS), blocks(asked, BLOCK_QUERIES)
    every_block = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = queries.withColumn("b", every_block(row_blocks)).withColumn("c", F.pmod(F.xxhash64("query_id"), query_blocks).cast("int"))
    right = index.select("vec_id", "embedding", "part").withColumn("b", F.pmod(F.xxhash64("vec_id"), row_blocks).cast("int")).withColumn("c", every_block(query_blocks))
    found = left.groupBy("part", "b", "c").cogroup(right.groupBy("part", "b", "c")).applyInArrow(lambda a, b: _search(a, b, dim, top), "query_id long, found array<long>, scores array<double>")
    best = found.groupBy("query_id").agg(F.flatten(F.collect_list(F.arrays_zip((F.transform("scores", lambda s: -s)).alias("s"), "found"))).alias("all"))
    best = best.select("query_id", F.posexplode(F.slice(F.array_sort("all"), 1, top)).alias("rank", "one"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("one.found").alias("vec_id"), (-F.col("one.s")).alias("score"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
