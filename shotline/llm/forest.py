"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue.

A tree halves space again and again: a node has a random direction and, as threshold, the median of the projections of
the sample rows that reach it.  The forest is fitted on a bounded sample (FIT_ROWS rows at most, those with the smallest
hashes); every row is indexed: it is stored once, with the leaf that it reaches in each tree.  The trees' size is bounded
too, so that the forest can be broadcast (FOREST_BYTES at most); with more rows, leaves hold more.

A query puts the roots of all trees into one queue.  The most promising node comes first: the one whose least margin, over
the thresholds on its way, is largest.  Leaves are taken until they hold effort * rows rows together (repeats counted), at
least LEAST.  Queries go out in blocks of bounded size; a task sorts its rows by leaf, tree by tree, multiplies the rows of
a leaf with the queries that take it, and reranks what beats a query's k-th best by exact distances.  Only k rows a query and task
travel.  Equal vectors beyond the first k + 1 by id can't be among the best k and aren't indexed; equal queries are searched once.

Rows with a null id, or with a vector that is null, zero or holds null or non-finite entries, take no part.  Vectors may differ
in length: what is missing is zero.  Of rows with one id, the one with the greatest vector counts.  Ties go to the smaller
id.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotline.llm import shared, whitening

TREES = 4
EFFORT = 1.0
LEAST = 8192
FIT_ROWS = 1 << 16
FIT_BYTES = 32 << 20
FOREST_BYTES = 32 << 20
#: Sample rows of a leaf, and leaves of a tree, at most.
LEAF_SAMPLE = 32
MOST_DEPTH = 10
#: Rows that a task holds at once, and bytes of a block of queries that is broadcast.
TASK_BYTES = 32 << 20
BLOCK_BYTES = 64 << 20
#: Products of rows and queries that a task holds at once.
MEET = 1 << 21


class Forest(NamedTuple):
    """Complete trees of one depth; node i's children are 2 i + 1 (below or at the threshold) and 2 i + 2."""

    normals: np.ndarray  # tree, node, dim
    cuts: np.ndarray  # tree, node

    @property
    def depth(self) -> int:
        return (self.cuts.shape[1] + 1).bit_length() - 1

    @property
    def leaves(self) -> int:
        return 1 << self.depth


class Index(NamedTuple):
    """rows: (id, v, leaf), v an array of doubles and leaf of each tree's leaf, both packed; sizes: of each tree's leaves."""

    rows: DataFrame
    forest: Forest
    sizes: np.ndarray
    dim: int
    k: int


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, one an id."""
    v = F.col(vector)
    rows = df.filter(F.col(key).isNotNull() & whitening.finite(v)).filter(F.exists(v, lambda x: x != 0))
    return rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.max("v").alias("v"))


def grow(sample: np.ndarray, trees: int = TREES, seed: int = 1) -> Forest:
    """Fit trees on distinct sample rows."""
    rng = np.random.default_rng(seed)
    n, dim = sample.shape
    room = FOREST_BYTES // max(1, trees * dim * 8)
    depth = max(0, min(MOST_DEPTH, int(np.log2(max(1, n / LEAF_SAMPLE))), int(np.log2(max(1, room)))))
    normals, cuts = np.zeros((trees, (1 << depth) - 1, dim)), np.zeros((trees, (1 << depth) - 1))
    for t in range(trees):
        held = {0: np.arange(n)}
        for node in range((1 << depth) - 1):
            rows = held.pop(node)
            w = rng.normal(size=dim)
            w /= np.linalg.norm(w)
            at = sample[rows] @ w
            cut = float(np.median(at)) if len(at) else 0.0
            normals[t, node], cuts[t, node] = w, cut
            held[2 * node + 1], held[2 * node + 2] = rows[at <= cut], rows[at > cut]
    return Forest(normals, cuts)


def leaves_of(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Each row's leaf in each tree."""
    out = np.zeros((len(x), len(forest.cuts)), dtype=np.uint16)
    for t in range(len(forest.cuts)):
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(forest.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, forest.normals[t][node]) > forest.cuts[t][node])
        out[:, t] = node - (forest.leaves - 1)
    return out


def visited(forest: Forest, q: np.ndarray, sizes: np.ndarray, goal: float) -> np.ndarray:
    """(tree, leaf) flags of the leaves that a query takes, the most promising first, until they hold goal rows."""
    inner, took, held = forest.leaves - 1, np.zeros(sizes.shape, dtype=bool), 0
    margin = (forest.normals @ q - forest.cuts).tolist()
    queue = [(-np.inf, t, 0) for t in range(len(sizes))]
    while queue and held < goal:
        bound, tree, node = heapq.heappop(queue)
        if node >= inner:
            took[tree, node - inner] = True
            held += sizes[tree, node - inner]
        else:
            m = margin[tree][node]
            heapq.heappush(queue, (max(bound, m), tree, 2 * node + 1))
            heapq.heappush(queue, (max(bound, -m), tree, 2 * node + 2))
    return took


def build(rows: DataFrame, k: int, trees: int = TREES, seed: int = 1) -> Index | None:
    """Index rows (id, v), one an id, for searches of up to k neighbours; None if there are none."""
    dim = rows.agg(F.max(F.size("v")).alias("dim")).first()["dim"]
    if not dim:
        return None
    most = max(1, min(FIT_ROWS, FIT_BYTES // (8 * dim)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("v").toArrow().column("v").combine_chunks()
    forest = grow(np.unique(np.concatenate([x for _, x in shared.dense(sample, dim)]), axis=0), trees, seed)
    sent = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, x in shared.dense(b.column("v"), dim):
                leaf = leaves_of(sent.value, x)
                yield pa.record_batch({"id": b.column("id").slice(a, len(x)), "v": pa.array([r.tobytes() for r in x], pa.binary()), "leaf": pa.array([r.tobytes() for r in leaf], pa.binary())})

    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = rows.withColumn("place", place).filter(F.col("place") <= k + 1).select("id", "v")
    stored = shared.materialize(first.mapInArrow(run, "id long, v binary, leaf binary"))
    shape = (trees, forest.leaves)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(shape, dtype=np.int64)
        for b in batches:
            leaf = np.frombuffer(b"".join(b.column("leaf").to_pylist()), dtype=np.uint16).reshape(-1, trees)
            for t in range(trees):
                n[t] += np.bincount(leaf[:, t], minlength=shape[1])
        slots = np.flatnonzero(n)
        yield pa.record_batch({"slot": pa.array(slots, pa.int64()), "n": pa.array(n.ravel()[slots], pa.int64())})

    each = stored.select("leaf").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    sizes = np.zeros(shape, dtype=np.int64)
    for slot, n in each:
        sizes.ravel()[slot] = n
    return Index(stored, forest, sizes, dim, k)


def plan(index: Index, queries: DataFrame, effort: float) -> DataFrame:
    """(id, v, takes) of queries (id, v): their vectors, packed, and flags of the leaves they take, as bits."""
    forest, sizes, dim = index.forest, index.sizes, index.dim
    sent = queries.sparkSession.sparkContext.broadcast(forest)
    goal = max(LEAST, effort * int(sizes[0].sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, x in shared.dense(b.column("v"), dim):
                takes = [np.packbits(visited(sent.value, q, sizes, goal)).tobytes() for q in x]
                yield pa.record_batch({"id": b.column("id").slice(a, len(x)), "v": pa.array([q.tobytes() for q in x], pa.binary()), "takes": pa.array(takes, pa.binary())})

    return queries.mapInArrow(run, "id long, v binary, takes binary")


class Best:
    """The k best rows so far of each query of a block, by exact distance, then id."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k, self.bar = q, k, np.full(len(q), np.inf)
        self.who, self.row, self.far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.scale = np.square(q).sum(axis=1)

    def add(self, who: np.ndarray, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Rows at of x and ids for queries who; repeats of a row don't matter."""
        step = max(1, shared.AT_ONCE // x.shape[1])
        far = [np.sqrt(np.square(x[at[i : i + step]] - self.q[who[i : i + step]]).sum(axis=1)) for i in range(0, len(who), step)]
        who, row, far = np.concatenate([self.who, who]), np.concatenate([self.row, ids[at]]), np.concatenate([self.far, *far])
        order = np.lexsort((row, far, who))
        who, row, far = who[order], row[order], far[order]
        new = np.ones(len(who), dtype=bool)
        new[1:] = (who[1:] != who[:-1]) | (row[1:] != row[:-1])
        who, row, far = who[new], row[new], far[new]
        first = np.searchsorted(who, who)
        keep = np.arange(len(who)) - first < self.k
        self.who, self.row, self.far = who[keep], row[keep], far[keep]
        last = np.flatnonzero(np.arange(len(who)) - first == self.k - 1)
        self.bar[who[last]] = np.square(far[last])


def rerank(ids: np.ndarray, x: np.ndarray, leaf: np.ndarray, takes: np.ndarray, best: Best, held: int = 1 << 18) -> None:
    """Meet rows with the queries that take their leaves; takes: (query, tree, leaf) flags."""
    norm = np.square(x).sum(axis=1)
    slack = 1e-9 * (best.scale + norm.max(initial=0.0))  # what the product may be off; the distance decides
    for t in range(leaf.shape[1]):
        order = np.argsort(leaf[:, t], kind="stable")
        which, first = np.unique(leaf[order, t], return_index=True)
        who, rows, n = [], [], 0
        for one, a, b in zip(which, first, np.append(first[1:], len(order)), strict=True):
            asks = np.flatnonzero(takes[:, t, one])
            q, step = best.q[asks], max(1, min(4096, MEET // max(1, len(asks))))
            for i in range(a, b, step) if len(asks) else ():
                own = order[i : min(b, i + step)]
                near = norm[own] + best.scale[asks, None] - 2 * (q @ x[own].T)
                hit, at = np.nonzero(near <= (best.bar + slack)[asks, None])
                who.append(asks[hit])
                rows.append(own[at])
                n += len(hit)
                if n >= held:
                    best.add(np.concatenate(who), np.concatenate(rows), ids, x)
                    who, rows, n = [], [], 0
        if n:
            best.add(np.concatenate(who), np.concatenate(rows), ids, x)


def lookup(index: Index, planned: DataFrame) -> DataFrame:
    """(asks, id, score): the nearest k + 1 rows that each planned query finds, itself among them if it's indexed."""
    spark = planned.sparkSession
    trees, leaves, dim, k = len(index.forest.cuts), index.forest.leaves, index.dim, index.k + 1
    each = 8 * dim + trees * leaves + 24 * k + 64
    blocks = max(1, -(-planned.count() * each // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        part = planned.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow()
        sent = spark.sparkContext.broadcast((shared.ints(part.column("id").combine_chunks()), part.column("v").to_pylist(), part.column("takes").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asks, v, bits = sent.value
            if not len(asks):
                return
            q = np.frombuffer(b"".join(v), dtype=np.float64).reshape(-1, dim)
            takes = np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(asks), -1), axis=1)[:, : trees * leaves].reshape(-1, trees, leaves)
            best, most, waiting, n = Best(q, k), max(4096, TASK_BYTES // (8 * dim)), [], 0

            def meet() -> None:
                ids = np.concatenate([shared.ints(w.column("id")) for w in waiting])
                x = np.frombuffer(b"".join(r for w in waiting for r in w.column("v").to_pylist()), dtype=np.float64).reshape(-1, dim)
                leaf = np.frombuffer(b"".join(r for w in waiting for r in w.column("leaf").to_pylist()), dtype=np.uint16).reshape(-1, trees)
                rerank(ids, x, leaf, takes, best)

            for batch in batches:
                for a in range(0, batch.num_rows, most):
                    waiting.append(batch.slice(a, most))
                    n += waiting[-1].num_rows
                    if n >= most:
                        meet()
                        waiting, n = [], 0
            if waiting:
                meet()
            yield pa.record_batch({"asks": asks[best.who], "id": best.row, "score": best.far})

        hits = index.rows.mapInArrow(run, "asks long, id long, score double")
        rank = F.row_number().over(Window.partitionBy("asks").orderBy("score", "id"))
        hits = shared.materialize(hits.withColumn("n", rank).filter(F.col("n") <= k).drop("n"))
        sent.unpersist()
        out = hits if out is None else out.unionByName(hits)
    return out


def neighbours(df: DataFrame, asks: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, effort: float = EFFORT, seed: int = 1) -> DataFrame:
    """(query_id, rank, id, score): the k rows found nearest to each row where asks holds, without itself; score is the Euclidean distance.

    asks is a condition on id.  More effort, more recall: at 1.0, 0.95 or more on 64-dimensional vectors without any
    structure, the hardest case, from some thousand rows on; effort equal to trees searches everything.
    """
    spark: SparkSession = df.sparkSession
    rows = usable(df, key, vector)
    index = build(rows, k, trees, seed)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    queries = rows.filter(asks)
    alike = shared.materialize(queries.groupBy("v").agg(F.min("id").alias("asks")))
    link = queries.join(alike, "v").select(F.col("id").alias("query_id"), "asks")
    planned = shared.materialize(plan(index, alike.select(F.col("asks").alias("id"), "v"), effort))
    found = lookup(index, planned).join(link, "asks").filter(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
