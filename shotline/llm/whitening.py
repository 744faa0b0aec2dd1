"""Embedding whitening by a weighted multiplicity covariance.

Each component of a vector becomes a whole number x.  Identical x vectors are grouped and counted first, with partial
counts before the shuffle, so that a vector that a third of all rows share is one row from then on.  The distinct
vectors are the fit list; each weighs as much as it has copies, or one.  Sums, then the covariance (centred before it is
multiplied, a weighted matrix product a task) are added over tasks by dimension; the driver holds one matrix of
dimensions by dimensions, whatever the number of rows.  Each distinct vector is whitened once, and rows get the result by
a join on a 128-bit digest of their x vector.

Rows with a null vector, or null or non-finite entries, take no part; a null id stays an id.  Vectors may differ in
length: what is missing is zero.  Repeated rows come out as often as they went in.  A component along which the fit
list doesn't vary (all of them if it's one vector) is whitened to 0.0 and explains 0.0.  An empty table gives no rows.  A
component too large for a long raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.llm import shared

SCHEMA = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


class Packed(NamedTuple):
    """Whole-number vectors: rows (id, key, x), all of dim entries of dtype, whose size is below most."""

    rows: DataFrame
    dim: int
    dtype: str
    most: int


class Model(NamedTuple):
    """n vectors by weight with sums, unit axes (a column each) with their variances, and the whole variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variance: np.ndarray
    total: float


def finite(v: Column) -> Column:
    """Whether the vector is there and all its entries are finite numbers."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def packed(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> Packed | None:
    """floor(scale * entry) of the vectors that take part; None if there are none with an entry."""
    rows = df.filter(finite(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    largest = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    seen = rows.agg(F.max(F.size("v")).alias("dim"), F.max(largest).alias("most")).first()
    dim = seen["dim"] or 0
    if not dim:
        return None
    if seen["most"] * scale >= 2.0**63:
        raise OverflowError(f"an entry of {seen['most']} times {scale} doesn't fit a long")
    most = int(seen["most"] * scale) + 1
    dtype = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, v in shared.dense(b.column("v"), dim):
                x = np.floor(scale * v).astype(dtype)
                wide, raw = x.shape[1] * x.itemsize, x.tobytes()
                each = [raw[i : i + wide] for i in range(0, len(raw), wide)]
                keys = [hashlib.blake2b(r, digest_size=16).digest() for r in each]
                yield pa.record_batch({"id": b.column("id").slice(a, len(x)), "key": pa.array(keys, pa.binary()), "x": pa.array(each, pa.binary())})

    return Packed(rows.mapInArrow(run, "id long, key binary, x binary"), dim, dtype, most)


def matrix(column: pa.Array, p: Packed) -> Iterator[tuple[slice, np.ndarray]]:
    """Packed vectors as (rows, matrix of longs), piece by piece."""
    step = max(1, shared.AT_ONCE // p.dim)
    for a in range(0, len(column), step):
        own = column.slice(a, step)
        yield slice(a, a + len(own)), np.frombuffer(b"".join(x.as_py() for x in own), dtype=p.dtype).reshape(-1, p.dim).astype(np.int64)


def fit(distinct: DataFrame, p: Packed) -> Model:
    """Mean and axes of distinct vectors (x, weight long).  Sums are exact; the covariance is centred before it's multiplied."""
    shape = p._replace(rows=None)
    n = distinct.agg(F.sum("weight")).first()[0]
    room = (1 << 62) // p.most

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * shape.dim
        for b in batches:
            weight = np.asarray(b.column("weight"))
            for rows, x in matrix(b.column("x"), shape):
                w = weight[rows]
                part = w @ x if int(w.sum()) < room else w.astype(object) @ x.astype(object)
                sums = [s + int(t) for s, t in zip(sums, part, strict=True)]
        yield pa.record_batch({"i": pa.array(range(shape.dim), pa.int32()), "s": pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))})

    each = distinct.select("x", "weight").mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(each, key=lambda r: r["i"])]
    mean = np.array([s / n for s in sums])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((shape.dim, shape.dim))
        for b in batches:
            weight = np.asarray(b.column("weight")).astype(np.float64)
            for rows, x in matrix(b.column("x"), shape):
                z = x - mean
                total += (z * weight[rows, None]).T @ z
        yield pa.record_batch({"i": pa.array(range(shape.dim), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    def combine(table: pa.Table) -> pa.Table:
        rows = np.asarray(table.column("row").combine_chunks().flatten()).reshape(table.num_rows, -1)
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})

    kind = "i int, row array<double>"
    rows = distinct.select("x", "weight").mapInArrow(multiply, kind).groupBy("i").applyInArrow(combine, kind).toArrow().sort_by("i")
    cov = np.asarray(rows.column("row").combine_chunks().flatten()).reshape(p.dim, p.dim) / n
    variance, axes = np.linalg.eigh((cov + cov.T) / 2)
    axes = axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(p.dim)] < 0, -1.0, 1.0)  # the same sign in every run
    return Model(n, sums, axes, variance[::-1].copy(), float(np.trace(cov)))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: float = 256.0, weights: str = "one") -> DataFrame:
    """(id, component from 1, n, deviation, whitened, explained, identity_error) of each row that takes part.

    n: the fit list's weight; deviation: the exact sum over dimensions of (n * x - sum)^2; explained: the component's share
    of the variance; identity_error: how far the covariance of whitened, over the fit list, is from the identity, at
    most.  weights is "one" or "count" (see above).
    """
    if weights not in ("one", "count"):
        raise ValueError("weights has to be 'one' or 'count'")
    spark = df.sparkSession
    p = packed(df, key, vector, scale)
    if p is None:
        return spark.createDataFrame([], SCHEMA)
    weight = F.count("*") if weights == "count" else F.max(F.lit(1))
    distinct = shared.materialize(p.rows.groupBy("key", "x").agg(weight.cast("long").alias("weight")))
    model, shape = fit(distinct, p), p._replace(rows=None)
    components = min(components, p.dim)
    alive = model.variance[:components] > p.dim * np.finfo(float).eps * max(model.variance[0], 0.0)
    spread = np.sqrt(np.where(alive, model.variance[:components], 1.0))
    onto = np.where(alive, model.axes[:, :components] / spread, 0.0)
    n, sums = model.n, model.sums
    mean = np.array([s / n for s in sums])
    fits = p.dim * (n * p.most + max(abs(s) for s in sums)) ** 2 < 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in matrix(b.column("x"), shape):
                if fits:
                    dev = pa.array(np.square(n * x - np.array(sums, dtype=np.int64)).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:  # beyond a long on the way
                    far = np.square(n * x.astype(object) - np.array(sums, dtype=object)).sum(axis=1)
                    dev = pa.array([Decimal(int(d)) for d in far], pa.decimal128(38, 0))
                w = (x - mean) @ onto
                part = b.slice(rows.start, len(x))
                yield pa.record_batch({"key": part.column("key"), "weight": part.column("weight"), "deviation": dev, "w": pa.array(list(w), pa.list_(pa.float64()))})

    done = shared.materialize(distinct.mapInArrow(run, "key binary, weight long, deviation decimal(38,0), w array<double>"))
    error = identity_error(done, np.flatnonzero(alive).tolist())
    explained = F.array(*[F.lit(float(v / model.total) if a else 0.0) for v, a in zip(model.variance, alive, strict=False)])
    rows = p.rows.select("id", "key").join(done.drop("weight"), "key")
    each = rows.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(done: DataFrame, alive: list[int]) -> float:
    """Largest absolute entry of the covariance of w (weighted by weight) minus the identity, over the components in alive."""
    if not alive:
        return 0.0
    total = F.sum("weight")
    means = done.agg(*[(F.sum(F.col("weight") * F.col("w")[i]) / total).alias(f"m{i}") for i in alive]).first()
    off = lambda i: F.col("w")[i] - F.lit(means[f"m{i}"])
    cells = [(i, j) for i in alive for j in alive if i <= j]
    got = done.agg(*[(F.sum(F.col("weight") * off(i) * off(j)) / total).alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in cells)

