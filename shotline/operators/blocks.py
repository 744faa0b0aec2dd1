"""Ordered work on long groups: a group is cut into blocks by its order, and what a block has to know of the others travels as one row a block.

A window over a whole video or scene is one task, however long that is.  Here windows see one block; over the whole group only summaries of
blocks are scanned, and the results are joined back to the blocks' rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Numbers of frames, or other places in order, that a block spans.
SPAN = 65_536
BLOCK = "__block"


def cut(df: DataFrame, at: str, span: int = SPAN) -> DataFrame:
    """df with the block of each row: places [span * block, span * (block + 1))."""
    return df.withColumn(BLOCK, F.floor(F.col(at) / span))


def inside(keys: list[str], *order: str | Column) -> WindowSpec:
    """Window over a block, in order."""
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def over(keys: list[str]) -> WindowSpec:
    """Window over the summaries of a group's blocks."""
    return Window.partitionBy(*keys).orderBy(BLOCK)


def earlier(keys: list[str]) -> WindowSpec:
    return over(keys).rowsBetween(Window.unboundedPreceding, -1)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys in which nulls are equal; right's other columns are added."""
    names = {k: f"__r_{k}" for k in keys}
    r = right.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in right.columns if c not in keys])
    on = None
    for k, n in names.items():
        same = F.col(k).eqNullSafe(F.col(n))
        on = same if on is None else on & same
    return left.join(r, on, how).drop(*names.values())


def carried(rows: DataFrame, keys: list[str], summary: list[Column], derived: dict[str, Column]) -> DataFrame:
    """rows (with their blocks) and the derived columns, which are computed over the summaries of a group's blocks, in this order."""
    blocks = rows.groupBy(*keys, BLOCK).agg(*summary)
    for name, c in derived.items():
        blocks = blocks.withColumn(name, c)
    return joined(rows, blocks.select(*keys, BLOCK, *derived), [*keys, BLOCK])


def last_of_first(rows: DataFrame, keys: list[str], value: str, most: str, coarse: int = 512) -> DataFrame:
    """(*keys, edge, left): of each group's most first rows by falling value the value of the last one, and how many with that value belong to them.

    value has nine places.  Counts by coarse steps of the value say in which step the last one lies, counts by value in that step which
    value it has; no window sees more than the steps of a group, or the values of a step.
    """

    def edge(df: DataFrame, by: str, want: str, name: str) -> DataFrame:
        down = Window.partitionBy(*keys).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
        n = df.groupBy(*keys, by).agg(F.count("*").alias("__c"), F.max(want).alias("__want"))
        n = n.withColumn("__before", F.coalesce(F.sum("__c").over(down), F.lit(0)))
        hit = (F.col("__before") < F.col("__want")) & (F.col("__before") + F.col("__c") >= F.col("__want"))
        return n.filter(hit).select(*keys, F.col(by).alias(name), (F.col("__want") - F.col("__before")).alias("left"))

    stepped = rows.select(*keys, value, most, F.floor(F.col(value) * coarse).alias("__step"))
    near = joined(stepped, edge(stepped, "__step", most, "__s"), keys).filter(F.col("__step") == F.col("__s"))
    return edge(near, value, "left", "edge")
