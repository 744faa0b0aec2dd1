"""Small helpers of the operators: materialising, task-side column access, packed shuffles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Numbers that one numpy pass over vectors works on.
AT_ONCE = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one only where none is set and all is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to a table in the shared folder and read that: cheaper on disk than a checkpoint, and pruned by column."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions for work that grows with df: at least the session's, and as many as df is read in."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def with_id(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key as long and the text, whatever other columns there are."""
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def ints(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An integer column without nulls as int64."""
    return np.asarray(column.cast(pa.int64()))


def u64(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def blobs(dtype: np.dtype, parts: int, at_once: int = 2_000_000) -> Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]]:
    """Pack records for a shuffle: (part, records of dtype) pairs become rows (part int, blob binary), one for each part and flush."""

    def pack(pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            part, rows = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.argsort(part, kind="stable")
            part, rows = part[order], rows[order]
            which, first = np.unique(part, return_index=True)
            last = np.append(first[1:], len(part))
            yield pa.record_batch({"part": pa.array(which.astype(np.int32)), "blob": pa.array([rows[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())})
            held.clear()

        for part, rows in pieces:
            if len(rows):
                held.append((part, rows.astype(dtype, copy=False)))
                n += len(rows)
            if n >= at_once:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    return pack


def unpack(table: pa.Table, dtype: np.dtype) -> np.ndarray:
    """The records of a group's blobs."""
    return np.concatenate([np.frombuffer(x.as_py(), dtype=dtype) for chunk in table.column("blob").chunks for x in chunk])


def dense(column: pa.Array, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """A list column as (first row, matrix of doubles), piece by piece; shorter lists are filled with zeros."""
    size = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten()).astype(np.float64)
    ends = np.cumsum(size)
    step = max(1, AT_ONCE // max(dim, 1))
    for a in range(0, len(size), step):
        own = size[a : a + step]
        begin = ends[a : a + step] - own
        out = np.zeros((len(own), dim))
        out[np.repeat(np.arange(len(own)), own), np.arange(own.sum()) - np.repeat(begin - begin[0], own)] = flat[begin[0] : begin[0] + own.sum()]
        yield a, out
