"""Operator 3: approximate nearest neighbours by learned partitions.

The index is fitted on a bounded sample: its neighbour graph is cut into balanced parts by recursive bisection (the
second eigenvector of the graph splits at its median, then pairs of nodes are exchanged while that lowers the cut), and
a small classifier learns from a vector where its neighbours lie. All rows are put into the part that the classifier
finds most probable; a query visits its most probable parts, as many as held-out sample vectors need for TARGET recall,
and is compared with all vectors there in double precision.

Parts are cut into blocks of bounded size, for vectors and for queries, so that many equal vectors are no burden for one
task. A task returns the best ``k`` of a block for each query; Spark merges those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import space

#: Vectors that the index is fitted on, at most, and the parts they are cut into (a power of two).
SAMPLE, PARTS = 2048, 32
#: Neighbours of a vector in the graph; width of the classifier's hidden layer.
GRAPH_NEIGHBOURS, HIDDEN = 10, 128
#: Recall on held-out vectors of the sample from which on no more parts are visited.
TARGET = 0.95
#: Vectors and queries in a block, on average.
BLOCK, QUERY_BLOCK = 4096, 512
#: Neighbours that are returned.
K = 20


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Cut a symmetric neighbour graph (dense 0/1) into ``parts`` of equal size, with few edges between them."""
    out = np.zeros(len(graph), dtype=np.int64)
    todo = [(np.arange(len(graph)), 0, parts)]
    while todo:
        nodes, first, count = todo.pop()
        if count == 1 or len(nodes) < 2:
            out[nodes] = first
            continue
        own = graph[np.ix_(nodes, nodes)]
        degree = np.maximum(own.sum(axis=1), 1e-9)
        scaled = own / np.sqrt(np.outer(degree, degree))
        lead = np.sqrt(degree) / np.linalg.norm(np.sqrt(degree))
        v = rng.standard_normal(len(nodes))
        for _ in range(60):  # power iteration, kept off the first eigenvector
            v = scaled @ v + v
            v -= lead * (lead @ v)
            v /= max(np.linalg.norm(v), 1e-12)
        side = np.zeros(len(nodes), dtype=bool)
        side[np.argsort(v, kind="stable")[len(nodes) // 2 :]] = True
        for _ in range(20):  # exchange the nodes that gain most, pairwise, so that balance is kept
            inside = own @ side.astype(np.float32)
            gain = np.where(side, degree - 2 * inside, 2 * inside - degree)
            a, b = (np.flatnonzero(s)[np.argsort(-gain[s], kind="stable")] for s in (side, ~side))
            m = min(len(a), len(b))
            better = gain[a[:m]] + gain[b[:m]] - 2 * own[a[:m], b[:m]] > 0
            m = int(np.argmin(np.r_[better, False]) + 1) // 2  # half of them: neighbours' moves change gains
            if not m:
                break
            side[a[:m]], side[b[:m]] = False, True
        todo += [(nodes[~side], first, count // 2), (nodes[side], first + count // 2, count - count // 2)]
    return out


@dataclass
class Router:
    """The classifier: which part is how probable for a vector."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int
    recall: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(_unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def fit(sample: np.ndarray, *, parts: int = PARTS, k: int = K, seed: int = 0) -> Router:
    """A router from the vectors of a sample, and how many parts its held-out eighth must visit for TARGET recall."""
    rng = np.random.default_rng(seed)
    n, dim = sample.shape
    parts = min(parts, 1 << max(0, (n // 32).bit_length() - 1)) if n >= 32 else 1
    if parts == 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1, 1.0)
    near = sample @ sample.T
    np.fill_diagonal(near, -np.inf)
    best = np.argpartition(-near, GRAPH_NEIGHBOURS, axis=1)[:, :GRAPH_NEIGHBOURS]
    graph = np.zeros((n, n), dtype=np.float32)
    np.put_along_axis(graph, best, 1, axis=1)
    graph = np.maximum(graph, graph.T)
    part = balanced_parts(graph, parts, rng)
    # What is learned for a vector: the share of its neighbours, and of itself, in each part.
    goal = np.zeros((n, parts))
    np.add.at(goal, (np.repeat(np.arange(n), GRAPH_NEIGHBOURS), part[best].ravel()), 1.0)
    goal[np.arange(n), part] += GRAPH_NEIGHBOURS / 2
    goal /= goal.sum(axis=1, keepdims=True)
    held = rng.permutation(n)
    held, seen = held[: n // 8], held[n // 8 :]
    router = _trained(_unit(sample), goal, seen, rng)
    # Held-out vectors look for their neighbours among all of the sample, where the classifier has put it.
    own = np.argmax(router.scores(sample), axis=1)
    order = np.argsort(-router.scores(sample[held]), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
    top = np.argpartition(-near[held], min(k, n - 2), axis=1)[:, :k]
    needed = np.take_along_axis(place, own[top], axis=1)
    recall = np.array([(needed < m).mean() for m in range(1, parts + 1)])
    router.visits = int(np.argmax(recall >= TARGET)) + 1
    router.recall = float(recall[router.visits - 1])
    return router


def _trained(x: np.ndarray, goal: np.ndarray, seen: np.ndarray, rng: np.random.Generator, epochs: int = 30, batch: int = 256) -> Router:
    """One hidden layer, cross-entropy against ``goal``, Adam."""
    dim, parts = x.shape[1], goal.shape[1]
    p = [rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / dim), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = rng.permutation(seen)
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            hidden = np.maximum(x[rows] @ p[0] + p[1], 0)
            out = hidden @ p[2] + p[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            delta = (out / out.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            back = (delta @ p[2].T) * (hidden > 0)
            grads = [x[rows].T @ back, back.sum(axis=0), hidden.T @ delta, delta.sum(axis=0)]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.005 * (1 - epoch / epochs) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*p, visits=parts, recall=1.0)


# --- Spark --------------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    whole = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    return rows.where(F.expr(whole))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, vector and score of each query's best k in one block; scores of equal vectors are equal, and ties go to smaller ids."""
    near = q @ x.T
    near[q_ids[:, None] == ids[None, :]] = -np.inf
    least = np.partition(near, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
    # The product's rounding depends on the place in the matrix: what may be among the best is computed again, alike for all.
    slack = 1e-12 * (np.abs(q) @ np.abs(x).max(axis=0, initial=0) + 1)
    row, col = np.nonzero((near >= (least - slack)[:, None]) & np.isfinite(near))
    score = np.empty(len(row))
    for a in range(0, len(row), 1 << 16):
        own = slice(a, a + (1 << 16))
        score[own] = (q[row[own]] * x[col[own]]).sum(axis=1)
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    top = rank < k
    return row[top], ids[col[top]], score[top]


def search(vectors: DataFrame, queries: DataFrame, *, k: int = K, parts: int = PARTS, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of ``vectors`` for each row of ``queries`` (both vec_id, embedding).

    Nearest is the largest inner product. Vectors that are null, empty, zero, or hold a null or a number that isn't finite
    take no part, nor do rows without a vec_id, or with another dimension than most. A query isn't its own neighbour, nor
    is a row with its vec_id. If there are fewer than k candidates, all are returned. An empty table gives no rows. Equal
    queries (vec_id and vector) are asked once; different vectors under one vec_id each get k neighbours. Of the candidates
    each row counts, also repeated ones. The index is fitted on the ``sample`` rows of least hash.
    """
    spark = vectors.sparkSession
    schema = "query_id long, q long, vec_id long, score double"
    base, asked = usable(vectors), usable(queries).dropDuplicates(["vec_id", "embedding"]).withColumn("q", F.xxhash64("embedding"))
    drawn = base.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
    if not len(drawn):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = np.bincount([len(v) for v in drawn])
    dim = int(np.argmax(sizes))
    router = fit(np.stack([v for v in drawn if len(v) == dim]).astype(float), parts=parts, k=k, seed=seed)
    n_parts = len(router.b2)
    base, asked = base.where(F.size("embedding") == dim), asked.where(F.size("embedding") == dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = np.argmax(router.scores(_matrix(batch.column("embedding"), dim)), axis=1)
                yield pa.RecordBatch.from_pydict({"part": pa.array(part.astype(np.int32)), "vec_id": batch.column("vec_id"), "embedding": batch.column("embedding")})

    index = space.cut(base.mapInArrow(assign, "part int, vec_id long, embedding array<double>"), "index")
    count = np.zeros(n_parts, dtype=np.int64)
    for row in index.groupBy("part").count().collect():  # a row for each part
        count[row["part"]] = row["count"]
    blocks = np.maximum(1, -(-count // BLOCK))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("embedding"), dim)
            order = np.argsort(-router.scores(x), axis=1, kind="stable")
            # As many parts as the held-out vectors needed, and more if those hold too few vectors.
            filled = np.cumsum(count[order], axis=1)
            visits = np.maximum(router.visits, 1 + (filled < k + 1).sum(axis=1))
            row, rank = np.nonzero(np.arange(n_parts)[None, :] < visits[:, None])
            part = order[row, rank]
            at = pa.array(row)
            yield pa.RecordBatch.from_pydict({"part": pa.array(part.astype(np.int32)), "blocks": pa.array(blocks[part].astype(np.int32)), "vec_id": batch.column("vec_id").take(at), "q": batch.column("q").take(at), "embedding": batch.column("embedding").take(at)})

    routed = space.cut(asked.mapInArrow(route, "part int, blocks int, vec_id long, q long, embedding array<double>"), "routed")
    asked_count = np.zeros(n_parts, dtype=np.int64)
    for row in routed.groupBy("part").count().collect():
        asked_count[row["part"]] = row["count"]
    q_blocks = np.maximum(1, -(-asked_count // QUERY_BLOCK))

    def of_part(values: np.ndarray) -> F.Column:
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("part") + 1)

    left = index.where(of_part(asked_count) > 0).select("part", F.pmod(F.xxhash64("vec_id"), of_part(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), of_part(q_blocks) - 1)).alias("q_block"), "vec_id", "embedding")
    right = routed.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), of_part(q_blocks)).cast("int").alias("q_block"), "vec_id", "q", "embedding")

    def compare(table: pa.Table, asked: pa.Table) -> pa.Table:
        if not table.num_rows or not asked.num_rows:
            row, ids, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        else:
            row, ids, score = _best(asked.column("vec_id").to_numpy(), _matrix(asked.column("embedding"), dim), table.column("vec_id").to_numpy(), _matrix(table.column("embedding"), dim), k)
        return pa.table({"query_id": asked.column("vec_id").take(pa.array(row)), "q": asked.column("q").take(pa.array(row)), "vec_id": ids, "score": score})

    keys = ("part", "block", "q_block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = space.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
