"""A stored index of cells, searched cell by cell in order of what a cell can hold at best.

Frames lie on the unit sphere in the cell of their nearest centre.  A cell is a partition of the table; its centre, its radius (the largest angle between its
centre and a frame in it) and its size stand in a small table beside it.  No frame of a cell can be nearer to a query than the angle to the centre less
the radius, which bounds its cosine.  An exact search visits each query's cells by falling bound, in rounds of doubling width, until no cell left can beat the k-th
best score; with an effort n it stops after n cells.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.functions import vectors as V
from shotline.operators.search import PLACES, _merge, _scan, materialize, of_one_length, shared_dir

#: Frames that centres are fitted on, frames of a cell on average, and bytes of all centres, at most.
FIT_ROWS = 65_536
CELL_ROWS = 65_536
CENTRE_BYTES = 64 << 20
SLACK = 1e-9
#: Cells of the first round of an exact search.
FIRST = 4


class Cells(NamedTuple):
    """frames: (point_id, vector, cell), vectors of unit length; centres: (cell, centre, radius, n)."""

    frames: DataFrame
    centres: DataFrame


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def build(frames: DataFrame, path: str | None = None, cells: int | None = None, seed: int = 1) -> Cells:
    """Write the cells of frames (point_id, vector) to path, or else to the shared folder.

    Centres are fitted on at most FIT_ROWS frames, those with the smallest hashes; every frame with a usable vector of the
    common length (that of the longest) is put into a cell.
    """
    spark = frames.sparkSession
    path = path or f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    usable, dim = of_one_length(frames, "vector")
    unit = usable.select("point_id", V.normalise(F.col("vector")).alias("vector"))
    sample = materialize(unit.orderBy(F.xxhash64("point_id"), "point_id").limit(FIT_ROWS))
    n = usable.count()
    cells = max(1, min(cells or max(16, n // CELL_ROWS), sample.count(), CENTRE_BYTES // max(8, 8 * dim)))
    found = np.zeros((0, dim))
    if n:
        model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f", predictionCol="cell").fit(sample.withColumn("f", array_to_vector("vector")))
        found = np.unique(np.array(model.clusterCenters()), axis=0)
        size = np.linalg.norm(found, axis=1, keepdims=True)
        found = found / np.where(size > 0, size, 1)
    sent = spark.sparkContext.broadcast(found)  # at most CENTRE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = _matrix(b.column("vector"), dim) @ sent.value.T
            cell = near.argmax(axis=1)
            yield pa.record_batch({"point_id": b.column("point_id"), "vector": b.column("vector"), "angle": np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1)), "cell": pa.array(cell.astype(np.int32))})

    kind = dict(frames.dtypes)["point_id"]
    placed = unit.mapInArrow(run, f"point_id {kind}, vector array<double>, angle double, cell int")
    placed.repartitionByRange("cell", "point_id").write.partitionBy("cell").parquet(f"{path}/frames")
    rows = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(found)], "cell int, centre array<double>")
    if n:
        kept = spark.read.parquet(f"{path}/frames").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        rows = rows.join(kept, "cell")
    else:
        rows = rows.withColumns({"radius": F.lit(0.0), "n": F.lit(0).cast("long")})
    rows.write.parquet(f"{path}/centres")
    return load(spark, path, kind)


def load(spark: SparkSession, path: str, kind: str = "long") -> Cells:
    """The cells at path, as build wrote them; kind is the type of point_id."""
    frames = spark.read.schema(f"point_id {kind}, vector array<double>, cell int").parquet(f"{path}/frames")
    return Cells(frames, spark.read.parquet(f"{path}/centres"))


def order(index: Cells, queries: DataFrame, first: int, last: int) -> DataFrame:
    """(query_id, cell, bound): each query's cells by falling bound of the cosine, then nearness of the centre, from place first to last - 1 (counted from 0)."""
    held = index.centres.orderBy("cell").toArrow()
    sent = queries.sparkSession.sparkContext.broadcast((np.array(held.column("cell").to_pylist(), dtype=np.int32), np.array(held.column("centre").to_pylist()), np.array(held.column("radius").to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, centre, radius = sent.value
        for b in batches:
            if not b.num_rows or not len(cell):
                continue
            near = np.clip(_matrix(b.column("vector"), centre.shape[1]) @ centre.T, -1, 1)
            bound = np.cos(np.maximum(np.arccos(near) - radius, 0))
            ranks = np.lexsort((-near, -bound), axis=1)[:, first:last]
            who = np.repeat(np.arange(len(near)), ranks.shape[1])
            yield pa.record_batch({"query_id": b.column("query_id").take(pa.array(who)), "cell": pa.array(cell[ranks].ravel()), "bound": pa.array(np.take_along_axis(bound, ranks, 1).ravel())})

    kind = dict(queries.dtypes)["query_id"]
    return queries.select("query_id", "vector").mapInArrow(run, f"query_id {kind}, cell int, bound double")


def search(index: Cells, queries: DataFrame, k: int = 20, effort: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, reads): the k best frames of each query (query_id, point_id, score, rank), and how many cells it visited (query_id, cells).

    Without effort the result is exact: a round visits the next cells, twice as many as the one before, whose bound still reaches the
    k-th best score (with a slack for rounding).  A round reads only the partitions of cells that some query visits in it.
    """
    dims = index.centres.select(F.size("centre")).first()
    unit = of_one_length(queries, "vector", dims[0] if dims else 0)[0].select("query_id", V.normalise(F.col("vector")).alias("vector"))
    cells = index.centres.count()
    kind = dict(queries.dtypes)["query_id"]
    spark = queries.sparkSession
    hits = spark.createDataFrame([], f"query_id {kind}, point_id {dict(index.frames.dtypes)['point_id']}, score double, rank int")
    visited, at = [], 0
    most = cells if effort is None else min(effort, cells)
    while at < most:
        to = most if effort is not None else min(most, max(FIRST, 2 * at))
        bar = hits.filter(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
        due = order(index, unit, at, to).join(bar, "query_id", "left")
        due = materialize(due.filter(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - SLACK)).select("query_id", "cell"))
        own = [r[0] for r in due.select("cell").distinct().collect()]  # as many as there are cells, at most
        if not own:
            break  # bounds fall: what comes later can't reach the bar either
        visited.append(due)
        frames = index.frames.filter(F.col("cell").isin(own))
        found = _scan(unit, frames, due.withColumn("skip", F.array().cast("array<long>")), "cell", k).select("query_id", "point_id", F.round("score", PLACES).alias("score"))
        hits = materialize(_merge(hits.drop("rank").unionByName(found), k))
        at = to
    reads = unit.select("query_id")
    if visited:
        counts = reduce(DataFrame.unionByName, visited).groupBy("query_id").agg(F.count("*").alias("cells"))
        reads = reads.join(counts, "query_id", "left").select("query_id", F.coalesce("cells", F.lit(0)).alias("cells"))
    else:
        reads = reads.withColumn("cells", F.lit(0).cast("long"))
    return hits, reads
