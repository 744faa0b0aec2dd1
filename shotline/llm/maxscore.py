"""Exact top-k search by MaxScore over shards of an inverted index.

Rows and queries are integer vectors; a component is a term and its value the weight, and the score of a row is the
integer inner product.  Rows are written once, dealt out to shards by a hash of their id; queries are sent to all
shards in blocks of bounded size, one after the other.  A task searches its shards in turn and carries each query's k best from one to
the next, so that only those leave it.  In a shard each term has postings (rows with a weight other than zero) and bounds of its weights.  The
terms of a query are ordered by score bound: those whose bounds together stay below the k-th best score so far are
non-essential.  Only postings of essential terms are traversed; rows that stay competitive with the bounds of the
others are probed there, term by term in falling order, and dropped once they can't reach the k-th best.  The
shards' best k are merged by a window.  Ties go to the smaller id; a row never matches its own id.

Rows with a null id, a null vector, or null or non-finite components take no part.  Vectors may differ in length: what
is missing is zero.  Of rows with one id, the one with the greatest vector counts.  Scores are exact whatever the size of
components: where products may pass 2^53, Python's integers are used.  A best score that no long can hold raises an
error that names its query and row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotline.llm import shared

SHARD_ROWS = 8192
#: Bytes of a block of queries that is broadcast.
BLOCK_BYTES = 32 << 20
#: Rows of a shard after which the k-th best score so far is taken anew.
STEP = 2048
PROBE = 8


class Shard:
    """Rows of a shard, ordered by id, as postings of each term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, reach: float):
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], rows[order].T
        if reach < 2.0**53:
            self.weights = np.ascontiguousarray(rows).astype(np.float32 if reach < 2.0**24 else np.float64)
        else:  # beyond what a double holds exactly
            self.weights = np.array([[int(x) for x in row] for row in rows], dtype=object).reshape(rows.shape)
        self.full = (rows != 0).mean(axis=1) > 0.5  # terms whose postings are nearly all rows
        self.postings = [None if f else np.flatnonzero(w) for f, w in zip(self.full, rows, strict=True)]
        self.low, self.high = self.weights.min(axis=1), self.weights.max(axis=1)

    def search(self, q: np.ndarray, own: int, k: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the query's k best rows: those it has from other shards, and this one's, block by block; the bar rises with each block."""
        n = len(self.ids)
        whole = self.weights.dtype == object
        q = np.array([int(x) for x in q], dtype=object) if whole else q.astype(self.weights.dtype)
        bound = np.maximum(np.maximum(q * self.low, q * self.high), 0)
        order = np.argsort(bound, kind="stable")
        order = order[q[order] != 0]
        upto = np.cumsum(bound[order])
        at = 0
        while at < n:
            to = min(n, at + (STEP if at or len(ids) else max(4 * k, 64)))
            least = scores[-1] if len(scores) == k else None
            split = 0 if least is None or not len(upto) else int(np.searchsorted(upto, least, "left"))
            essential, rest = order[split:], order[:split][::-1]
            if least is None or least <= 0 or self.full[essential].any():
                live = np.arange(at, to)  # any row may compete
                part = q[essential] @ self.weights[essential, at:to]
            else:
                held = [self.postings[t] for t in essential]
                held = [x[np.searchsorted(x, at) : np.searchsorted(x, to)] for x in held]
                live = np.unique(np.concatenate(held)) if held else np.zeros(0, dtype=np.int64)
                part = q[essential] @ self.weights[np.ix_(essential, live)]
            if not len(essential):
                part = np.zeros(len(live), dtype=self.weights.dtype)
            ahead = bound[rest].sum()
            for first in range(0, len(rest) + 1, PROBE):
                if least is not None:
                    keep = np.asarray(part + ahead >= least, dtype=bool)  # of equal scores the smaller id counts
                    live, part = live[keep], part[keep]
                terms = rest[first : first + PROBE]
                if not len(terms) or not len(live):
                    break
                part = part + q[terms] @ self.weights[np.ix_(terms, live)]
                ahead = max(0, ahead - bound[terms].sum())
            keep = self.ids[live] != own
            ids, scores = np.concatenate([ids, self.ids[live][keep]]), np.concatenate([scores, part[keep]])
            top = np.lexsort((ids, -scores))[:k] if not whole else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
            ids, scores, at = ids[top], scores[top], to
        return ids, scores


def whole_numbers(scores: np.ndarray, query: int, ids: np.ndarray) -> np.ndarray:
    """Scores as longs."""
    for i, x in zip(ids, scores) if scores.dtype == object else ():
        if not -(1 << 63) <= x < 1 << 63:
            raise OverflowError(f"the score {x} of query {query} and row {i} doesn't fit a long")
    return scores.astype(np.int64)


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, v): floor(scale * x) of each component of the vectors that take part, as doubles, which hold it exactly if scale is a power of two."""
    v = F.col(vector)
    usable = v.isNotNull() & F.col(key).isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    scaled = lambda x: x.cast("double") * scale
    whole = F.transform(v, lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return df.filter(usable).select(F.col(key).cast("long").alias("id"), whole.alias("v")).groupBy("id").agg(F.max("v").alias("v"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, id, score): the k best rows of each query; both have id and v (array of doubles that are whole numbers)."""
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("most")).first()
    dim = max(1, sizes["dim"] or 1, queries.agg(F.max(F.size("v"))).first()[0] or 1)
    reach = float(sizes["most"] or 0) ** 2 * dim
    stored = shared.materialize(rows.select("id", "v").repartition(-(-max(1, sizes["n"]) // SHARD_ROWS), "id"))
    each = 8 * dim + 24 * k + 64
    blocks = max(1, -(-queries.count() * each // BLOCK_BYTES))
    h, found = F.xxhash64("id"), None
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    for b in range(blocks):
        asked = queries.filter(F.pmod(h, F.lit(blocks)) == b).select("id", "v").orderBy("id").toArrow()
        vectors = list(shared.dense(asked.column("v").combine_chunks(), dim)) if asked.num_rows else []
        sent = rows.sparkSession.sparkContext.broadcast((shared.ints(asked.column("id").combine_chunks()), np.concatenate([np.zeros((0, dim)), *[x for _, x in vectors]])))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asks, q = sent.value
            best: list = [(np.zeros(0, np.int64), None)] * len(asks)
            waiting, n = [], 0

            def meet() -> None:
                ids = np.concatenate([shared.ints(w.column("id")) for w in waiting])
                shard = Shard(ids, np.concatenate([x for w in waiting for _, x in shared.dense(w.column("v"), dim)]), reach)
                for i, own in enumerate(asks):
                    held, scores = best[i]
                    best[i] = shard.search(q[i], int(own), k, held, np.zeros(0, dtype=shard.weights.dtype) if scores is None else scores)

            for batch in batches:
                for a in range(0, batch.num_rows, SHARD_ROWS):
                    waiting.append(batch.slice(a, SHARD_ROWS))
                    n += waiting[-1].num_rows
                    if n >= SHARD_ROWS:
                        meet()
                        waiting, n = [], 0
            if waiting:
                meet()
            if n or any(s is not None for _, s in best):
                who = np.concatenate([np.zeros(0, np.int64), *(np.full(len(r), i) for i, (r, _) in zip(asks, best, strict=True))])
                hits = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in best)])
                scores = np.concatenate([np.zeros(0, np.int64), *(whole_numbers(s, int(i), r) for i, (r, s) in zip(asks, best, strict=True))])
                yield pa.record_batch({"query_id": who, "id": hits, "score": scores})

        part = stored.mapInArrow(search, "query_id long, id long, score long").withColumn("rank", rank).filter(F.col("rank") <= k)
        if blocks > 1:
            part = shared.materialize(part)
            sent.unpersist()
        found = part if found is None else found.unionByName(part)
    return found.select("query_id", "rank", "id", "score")
