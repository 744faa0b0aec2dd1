"""The verifying half of the set-similarity joins.

Candidate search names small groups of sets that may be similar.  Here the groups get their sets, very large groups
are dealt out as pairs of blocks, and each pair of sets in a group is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.llm import shared

#: Sets that one task compares with each other at most; larger groups are dealt out as pairs of blocks.
BLOCK = 2048
#: Bits of the filter that spares sets outside all groups the shuffle, at least and at most; an exact join follows.
FILTER_BITS = (1 << 24, 1 << 28)

GROUP = np.dtype([("comp", "<u8"), ("set", "<u8")])
POPCOUNT = np.bitwise_count


def overlaps(tokens: list[np.ndarray], rows: int = 256, cells: int = 1 << 23) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, shared tokens of the sets first..last with every set), for sets of distinct tokens."""
    n = len(tokens)
    owner = np.repeat(np.arange(n), [len(x) for x in tokens])
    _, column, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    keep = count[column] > 1  # a token of one set is shared with none
    owner, column = owner[keep], (np.cumsum(count > 1) - 1)[column[keep]]
    width = int((count > 1).sum())
    wide = max(1, cells // n)
    for lo in range(0, n, rows):
        hi = min(n, lo + rows)
        total = np.zeros((hi - lo, n), dtype=np.float32)
        for at in range(0, width, wide):
            dense = np.zeros((n, min(wide, width - at)), dtype=np.float32)
            own = (column >= at) & (column < at + wide)
            dense[owner[own], column[own] - at] = 1
            total += dense[lo:hi] @ dense.T
        yield lo, hi, total


def similar(tokens: list[np.ndarray], least: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, whether the Jaccard similarity of sets first..last with every set is at least least)."""
    size = np.array([len(x) for x in tokens], dtype=np.float64)
    for lo, hi, total in overlaps(tokens):
        yield lo, hi, total >= least * (size[lo:hi, None] + size[None, :] - total) - 1e-9


def presence_filter(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap with a bit set for each value: eight bits a row, within FILTER_BITS."""
    bits, n = FILTER_BITS[0], df.count()
    while bits < min(FILTER_BITS[1], 8 * n):
        bits *= 2
    low = df.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("x"))
    words = low.select(F.expr("cast(x div 64 as int) as w"), F.expr("shiftleft(1L, cast(x % 64 as int)) as b"))
    table = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[np.asarray(table.column("w"))] = np.asarray(table.column("b"))
    return out.view(np.uint64)


def maybe_in(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def dealt(groups: DataFrame, key: Column | None = None) -> DataFrame:
    """Groups (comp, set) as (comp, a, b, own, set): a pair of blocks for each row, (0, 0) for groups of up to BLOCK sets."""
    big = shared.checkpoint(groups.groupBy("comp").count().filter(F.col("count") > BLOCK))
    few = big.count() <= 10_000
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    marked = groups.join(F.broadcast(big) if few else big, "comp", "left").withColumn("n", F.coalesce(blocks, F.lit(1)))
    own = F.pmod(F.xxhash64("set"), F.col("n")).cast("int")
    each = marked.withColumn("own", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return each.select("comp", F.least("own", "j").alias("a"), F.greatest("own", "j").alias("b"), "own", "set")


def compare(rows: DataFrame, parts: int, judge: Callable[[dict[str, np.ndarray], list[np.ndarray]], pa.RecordBatch], schema: str, dtype: str = "<u8") -> DataFrame:
    """Run judge on each (comp, a, b) of rows, which have a binary column tokens of distinct tokens.

    judge gets the group's other columns and its sets.
    """

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in parted if x.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        names = [x for x in table.column_names if x != "tokens"]
        data = {x: np.asarray(table.column(x).combine_chunks()) for x in names}
        blob = table.column("tokens").combine_chunks()
        order = np.lexsort((data["b"], data["a"], data["comp"]))
        key = [data[x][order] for x in ("comp", "a", "b")]
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        first = np.flatnonzero(new)
        for at, to in zip(first, np.append(first[1:], len(order)), strict=True):
            if to - at > 1:
                own = order[at:to]
                out = judge({x: v[own] for x, v in data.items()}, [np.frombuffer(blob[int(i)].as_py(), dtype=dtype) for i in own])
                if out.num_rows:
                    yield out

    return rows.repartition(parts, "comp", "a", "b").mapInArrow(run, schema)
