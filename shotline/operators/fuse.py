"""Fusion, re-scoring and reduction of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotline.operators.search import ranked


def rrf(lists: list[DataFrame], labels: list[str] | None = None, k: int = 60) -> DataFrame:
    """A1: sum of 1 / (k + rank) over lists; ties by the earliest (list, rank), then point_id.  matched_via: the lists' labels in order."""
    labels = labels or [str(i) for i in range(len(lists))]
    parts = [x.select("query_id", "point_id", "rank").withColumn("list", F.lit(i)).withColumn("label", F.lit(name)) for i, (x, name) in enumerate(zip(lists, labels, strict=True))]
    both = reduce(DataFrame.unionByName, parts)
    via = F.transform(F.array_sort(F.collect_set(F.struct("list", "label"))), lambda x: x["label"])
    fused = both.groupBy("query_id", "point_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), via.alias("matched_via"), F.min(F.struct("list", "rank")).alias("first"))
    return ranked(fused, "query_id", F.desc(F.round("score", 12)), F.asc("first"), F.asc("point_id")).drop("first")


def coherence(hits: DataFrame, window: int = 10, weight: float = 0.3) -> DataFrame:
    """Each hit gains weight times the scores of the query's other hits of its video within window frames; hits without video or frame don't."""
    near = Window.partitionBy("query_id", "source_file").orderBy("frame_idx").rangeBetween(-window, window)
    usable = F.col("source_file").isNotNull() & F.col("frame_idx").isNotNull()
    others = F.sum("score").over(near) - F.col("score")
    boosted = hits.withColumn("boosted", F.when(usable, F.col("score") + weight * others).otherwise(F.col("score")))
    return ranked(boosted.drop("rank"), "query_id", F.desc(F.round("boosted", 9)), F.asc("point_id"))


def diversify(hits: DataFrame, k: int = 20, score: str = "score") -> DataFrame:
    """The best hit of each video and scene, then the best k; missing keys count as one scene."""
    best = ranked(hits.drop("rank"), ["query_id", "source_file", "scene_id"], F.desc(F.round(score, 9)), F.asc("point_id"), k=1, name="n").drop("n")
    return ranked(best, "query_id", F.desc(F.round(score, 9)), F.asc("point_id"), k=k)


def head_tail(hits: DataFrame, new: DataFrame, head: int = 20, tail: int = 100) -> DataFrame:
    """The first head hits in the order of new scores (query_id, point_id, new_score; none: 0), then the others up to tail as they were."""
    both = hits.filter(F.col("rank") <= tail).join(new, ["query_id", "point_id"], "left").withColumnRenamed("rank", "old_rank")
    late = F.col("old_rank") > head
    own = F.when(late, F.lit(0.0)).otherwise(F.coalesce("new_score", F.lit(0.0)))
    return ranked(both, "query_id", late.asc(), F.desc(F.round(own, 9)), F.asc("old_rank"))


def merge_first_wins(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All of first, and what second has besides."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def threshold(hits: DataFrame, score: str = "rerank_score", least: float = 0.2) -> DataFrame:
    """F4."""
    return hits.filter(F.col(score) >= least)


def best_videos(hits: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, source_file, score, rank): the videos with the best single hits; ties by name, hits without a video don't count."""
    best = hits.filter(F.col("source_file").isNotNull()).groupBy("query_id", "source_file").agg(F.max("score").alias("score"))
    return ranked(best, "query_id", F.desc(F.round("score", 9)), F.asc("source_file"), k=most)
