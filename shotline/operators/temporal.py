"""Operators on time: chains of steps, event alignment, interval and nearest joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.functions import vectors as V
from shotline.operators import blocks
from shotline.operators.search import BLOCK_QUERIES, of_one_length, ranked


def step_chain(steps: list[DataFrame], window: int = 150) -> DataFrame:
    """Per query and video the increasing chain, one frame a step, gaps in (0, window], with the largest score sum.

    steps: (query_id, source_file, frame_idx, score).  Each step joins to the one before on video and a bucket of
    window frames, or the next bucket, and keeps the best predecessor of a frame; ties go to earlier frames.
    """
    best = lambda df: df.groupBy("query_id", "source_file", "frame_idx").agg(F.max("score").alias("score"))
    path = best(steps[0]).select("query_id", "source_file", "frame_idx", F.col("score").alias("total"), F.array("frame_idx").alias("path"))
    for step in steps[1:]:
        before = path.withColumn("bucket", F.explode(F.array(F.floor(F.col("frame_idx") / window), F.floor(F.col("frame_idx") / window) + 1)))
        before = before.withColumnRenamed("frame_idx", "from")
        after = best(step).withColumn("bucket", F.floor(F.col("frame_idx") / window))
        pair = after.join(before, ["query_id", "source_file", "bucket"]).filter((F.col("frame_idx") > F.col("from")) & (F.col("frame_idx") - F.col("from") <= window))
        order = F.struct(F.round("total", 9), -F.col("from"))
        path = pair.groupBy("query_id", "source_file", "frame_idx", "score").agg(F.max_by(F.struct("total", "path"), order).alias("b"))
        path = path.select("query_id", "source_file", "frame_idx", (F.col("b.total") + F.col("score")).alias("total"), F.concat("b.path", F.array("frame_idx")).alias("path"))
    whole = path.groupBy("query_id", "source_file").agg(F.max_by(F.struct("total", "path"), F.struct(F.round("total", 9), -F.col("frame_idx"))).alias("b"))
    out = whole.select("query_id", "source_file", F.col("b.total").alias("score"), F.col("b.path").alias("frames"))
    return ranked(out, "query_id", F.desc(F.round("score", 9)), F.asc("source_file"))


def in_every_step(steps: list[DataFrame]) -> list[DataFrame]:
    """O3: the steps' hits in videos that every step of their query has."""
    keys = ["query_id", "source_file"]
    common = steps[0].select(*keys).distinct()
    for step in steps[1:]:
        common = common.join(step.select(*keys), keys, "left_semi")
    return [step.join(common, keys, "left_semi") for step in steps]


def speech_quality(asr: DataFrame, no_speech: float = 0.6, logprob: float = -1.0, ratio: float = 2.4) -> DataFrame:
    """segments (text, no_speech_prob, avg_logprob, compression_ratio) good enough to keep; a missing number passes."""
    ok = lambda c, test: F.col(c).isNull() | test
    return asr.filter(
        (F.length(F.trim("text")) >= 2) & ok("no_speech_prob", F.col("no_speech_prob") <= no_speech) & ok("avg_logprob", F.col("avg_logprob") >= logprob)
        & ok("compression_ratio", F.col("compression_ratio") <= ratio)
    )


def _runs(sim: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
    """(a, b, total, places): events a to b - 1 on strictly later columns with the largest sum; ties take later columns, from the last event on.

    sim: events by columns, whole numbers.  Runs that don't fit are left out.
    """
    n, m = sim.shape
    none = np.iinfo(np.int64).min // 2
    for a in range(n if m else 0):
        d, back = sim[a].copy(), []
        for b in range(a, n):
            if b > a:
                top = np.maximum.accumulate(d)
                back.append(np.maximum.accumulate(np.where(d == top, np.arange(m), -1)))
                d = np.full(m, none)
                d[1:] = np.where(top[:-1] > none // 2, top[:-1] + sim[b, 1:], none)
            j = m - 1 - int(d[::-1].argmax())
            if d[j] <= none // 2:
                break
            total, path = int(d[j]), [j]
            for step in reversed(back):
                path.append(int(step[path[-1] - 1]))
            yield a, b + 1, total, path[::-1]


def _fold(table: pa.Table) -> list[tuple[int, list[int], list[float | None]]]:
    """Runs of a video's blocks (block, a, b, n, total, frames, times), put together in order: at most one alignment of all n events.

    best[a, b] is the best way to place events a to b - 1 in the blocks so far; a block's runs continue it.  Of equal totals the one
    with the later frames counts, from the last event on.
    """
    rows = table.sort_by("block").to_pylist()
    n = rows[0]["n"]
    best: dict[int, tuple[int, list[int], list[float | None]]] = {0: (0, [], [])}
    at = 0
    while at < len(rows):
        to, found = at, dict(best)
        while to < len(rows) and rows[to]["block"] == rows[at]["block"]:
            r = rows[to]
            to += 1
            if r["a"] in best:
                t, f, x = best[r["a"]]
                new = (t + r["total"], f + r["frames"], x + r["times"])
                if r["b"] not in found or (new[0], new[1][::-1]) > (found[r["b"]][0], found[r["b"]][1][::-1]):
                    found[r["b"]] = new
        best, at = found, to
    return [best[n]] if n in best else []


def align_events(events: DataFrame, frames: DataFrame, pairs: DataFrame | None = None, span: int = blocks.SPAN) -> DataFrame:
    """Events (query_id, event, vector) onto strictly later frames (source_file, frame_idx, point_id, vector) of each video.

    The largest sum of cosines, divided by the number of the query's events; ties take the later frame; videos with fewer frames
    than events are left out.  pairs (query_id, source_file) says which videos a query is held against; without it every query
    meets every video, queries in blocks that are broadcast.  Frames may have a query_id instead: then they're that query's own.
    frames and times of the result: numbers and, if frames have timestamps, times of the aligned frames.

    A video is cut into blocks of span frame numbers.  A block gives the best run of each stretch of events within it; a
    video's blocks are put together from these few rows alone, so that one long video is many tasks.  Vectors that can't be
    compared (search.of_one_length) take no part.
    """
    usable, dim = of_one_length(events, "vector")
    own = usable.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("event", V.doubles(F.col("vector")).alias("vector")))).alias("ev"))
    keys = ["query_id", "source_file"] if "query_id" in frames.columns else ["source_file"]
    kinds = dict(events.dtypes) | dict(frames.dtypes)
    time = F.col("timestamp").cast("double") if "timestamp" in frames.columns else F.lit(None).cast("double")
    unit = V.normalise(F.col("vector")).alias("v")
    rows = blocks.cut(of_one_length(frames, "vector", dim)[0].filter("frame_idx is not null"), "frame_idx", span)
    rows = rows.select(*keys, blocks.BLOCK, F.col("frame_idx").cast("long").alias("frame_idx"), "point_id", time.alias("time"), unit)
    schema = f"query_id {kinds['query_id']}, source_file string, block long, n int, a int, b int, total long, frames array<long>, times array<double>"

    def runs(key: tuple, asks: list[dict], table: pa.Table) -> pa.Table:
        table = table.sort_by([("frame_idx", "ascending"), ("point_id", "ascending")])
        v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, dim).T
        frame, at = table.column("frame_idx").to_pylist(), table.column("time").to_pylist()
        out = []
        for ask in asks:
            e = np.array([x["vector"] for x in ask["ev"]])
            size = np.linalg.norm(e, axis=1, keepdims=True)
            sim = np.rint(np.round((e / np.where(size > 0, size, 1)) @ v, 9) * 1e9).astype(np.int64)
            out += [(ask["query_id"], key[-2], key[-1], len(e), a, b, total, [frame[j] for j in path], [at[j] for j in path]) for a, b, total, path in _runs(sim)]
        names = ["query_id", "source_file", "block", "n", "a", "b", "total", "frames", "times"]
        types = [kind, pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    kind = own.select("query_id").limit(0).toArrow().schema.field("query_id").type
    named = lambda key: tuple(k.as_py() for k in key)
    if "query_id" in keys:
        pairs = rows.select(*keys).distinct()
    if pairs is not None:
        asked = pairs.select("query_id", "source_file").distinct().join(own, "query_id")
        n = asked.groupBy(*keys).agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts"))
        dealt = rows.join(n, keys)
        asks = asked.join(dealt.select(*keys, blocks.BLOCK, "parts").distinct(), keys).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        by = ["part", *keys, blocks.BLOCK]

        def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            return runs(named(key), left.select(["query_id", "ev"]).to_pylist(), right)

        own_names = [f"__a{i}" for i in range(len(by))]  # both sides may come from the same frames
        asks = asks.select(*[F.col(c).alias(x) for c, x in zip(by, own_names, strict=True)], F.col("query_id").alias("query_id"), "ev")
        found = asks.groupBy(*own_names).cogroup(dealt.drop("parts").groupBy(*by)).applyInArrow(meet, schema)
    else:

        def meeting(sent: Broadcast) -> Callable[[tuple, pa.Table], pa.Table]:
            def meet_all(key: tuple, table: pa.Table) -> pa.Table:
                return runs(named(key), sent.value, table)

            return meet_all

        found, parts = None, max(1, -(-own.count() // BLOCK_QUERIES))
        for p in range(parts):
            sent = frames.sparkSession.sparkContext.broadcast(own.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).toArrow().to_pylist())

            part = rows.groupBy(*keys, blocks.BLOCK).applyInArrow(meeting(sent), schema)
            found = part if found is None else found.unionByName(part)

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        out, n = _fold(table), table.column("n")[0].as_py()
        score = pa.array([t / 1e9 / n for t, _, _ in out], pa.float64())
        return pa.table([pa.array([key[0].as_py()] * len(out), table.column("query_id").type), pa.array([key[1].as_py()] * len(out), pa.string()), score, pa.array([f for _, f, _ in out], pa.list_(pa.int64())), pa.array([x for _, _, x in out], pa.list_(pa.float64()))], ["query_id", "source_file", "score", "frames", "times"])

    return found.groupBy("query_id", "source_file").applyInArrow(fold, f"query_id {kinds['query_id']}, source_file string, score double, frames array<long>, times array<double>")


#: Queries that meet a block of a video in one task.
ASKS = 1024


def nodes(lo: Column, hi: Column) -> Column:
    """The fewest nodes (level, node) of a binary tree over whole numbers that cover lo to hi; node n of level l covers [n * 2^l, (n + 1) * 2^l)."""
    empty = F.array().cast("array<struct<level:int,node:bigint>>")
    levels = F.sequence(F.lit(0), F.ceil(F.log2((hi - lo + 1).cast("double"))).cast("int") + 1)

    def climb(s: Column, level: Column) -> Column:
        live = s["a"] <= s["b"]
        left, right = live & (s["a"].bitwiseAND(F.lit(1)) == 1), live & (s["b"].bitwiseAND(F.lit(1)) == 0)
        node = lambda take, n: F.when(take, F.array(F.struct(level.alias("level"), n.alias("node")))).otherwise(empty)
        a, b = F.when(left, s["a"] + 1).otherwise(s["a"]), F.when(right, s["b"] - 1).otherwise(s["b"])
        up = lambda x, done: F.when(a <= b, F.shiftright(x, 1)).otherwise(F.lit(done).cast("long"))  # noqa: E731  what is covered stays so
        return F.struct(up(a, 1).alias("a"), up(b, 0).alias("b"), F.concat(s["nodes"], node(left, s["a"]), node(right, s["b"])).alias("nodes"))

    begin = F.struct(lo.cast("long").alias("a"), hi.cast("long").alias("b"), empty.alias("nodes"))
    return F.when(hi >= lo, F.aggregate(levels, begin, climb, lambda s: s["nodes"])).otherwise(empty)


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, lo: str, hi: str, width: float = 1.0) -> DataFrame:
    """Points with each interval of their key that holds them: lo <= at <= hi; columns of both, keys once.

    Time is a binary tree over cells of width.  An interval is the few nodes that cover its cells, at most two a level however long it
    is; a point is its cell's ancestors, on those levels that some interval has.  A pair meets at one node exactly.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    spans = intervals.filter(F.col(hi) >= F.col(lo)).withColumn("__n", F.explode(nodes(cell(lo), cell(hi)))).select("*", F.col("__n.level").alias("__level"), F.col("__n.node").alias("__node")).drop("__n")
    levels = sorted(r[0] for r in spans.select("__level").distinct().collect())  # at most 64
    up = F.array(*[F.struct(F.lit(x).alias("level"), F.shiftright(cell(at), x).alias("node")) for x in levels]).cast("array<struct<level:int,node:bigint>>")
    placed = points.withColumn("__n", F.explode(up)).select("*", F.col("__n.level").alias("__level"), F.col("__n.node").alias("__node")).drop("__n")
    both = placed.join(spans, [*keys, "__level", "__node"]).drop("__level", "__node")
    return both.filter((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi)))


def attach_speech(frames: DataFrame, asr: DataFrame, margin: float = 3.0, width: float = 30.0) -> DataFrame:
    """Frames (point_id, source_file, timestamp) with the texts of segments whose interval, widened by margin, holds them.

    An interval join over cells of width; texts are joined in order of start.
    """
    spans = asr.select("source_file", "text", "start", (F.col("start") - margin).alias("lo"), (F.col("end") + margin).alias("hi"))
    found = interval_join(frames.select("point_id", "source_file", "timestamp"), spans, ["source_file"], "timestamp", "lo", "hi", width)
    joined = found.groupBy("point_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), " ").alias("speech"), F.count("*").alias("n_segments"))
    return frames.join(joined, "point_id", "left").select("point_id", "source_file", F.coalesce("speech", F.lit("")).alias("speech"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"))


def nearest(frames: DataFrame, index: DataFrame, most: int = 5) -> DataFrame:
    """The keyframe (source_file, native_idx, name) nearest to each frame (source_file, frame_idx), within most frames; ties to the first."""
    width = most + 1
    around = index.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("native_idx") / width) + d for d in (-1, 0, 1)])))
    placed = frames.withColumn("bucket", F.floor(F.col("frame_idx") / width))
    near = placed.join(around, ["source_file", "bucket"]).withColumn("dist", F.abs(F.col("frame_idx") - F.col("native_idx"))).filter(F.col("dist") <= most)
    best = near.groupBy("source_file", "frame_idx").agg(F.min_by(F.struct("name", "dist"), F.struct("dist", "native_idx", "name")).alias("b"))
    return frames.join(best, ["source_file", "frame_idx"], "left").select(*frames.columns, F.col("b.name").alias("keyframe"), F.col("b.dist").alias("distance"))


def audio_segments(media: DataFrame, seconds: float = 10.0) -> DataFrame:
    """(source_file, duration) in pieces of fixed length, the last one shorter."""
    n = F.ceil(F.col("duration") / seconds).cast("int")
    cut = media.filter("duration > 0").withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.select("source_file", (F.col("i") * seconds).alias("start"), F.least((F.col("i") + 1) * seconds, F.col("duration")).alias("end"))


def match_truth(hits: DataFrame, truth: DataFrame, frames_within: int = 5, seconds_within: float = 3.0) -> DataFrame:
    """Hits with matched: same video, and near by frame if both have one, else by time, else by video alone."""
    t = truth.select("query_id", F.col("source_file").alias("t_video"), F.col("frame_idx").alias("t_frame"), F.col("timestamp").alias("t_time"))
    by_frame = F.abs(F.col("frame_idx") - F.col("t_frame")) <= frames_within
    by_time = F.abs(F.col("timestamp") - F.col("t_time")) <= seconds_within
    near = F.coalesce(by_frame, by_time, F.lit(True))
    matched = F.coalesce((F.col("source_file") == F.col("t_video")) & near, F.lit(False))
    return hits.join(t, "query_id", "left").withColumn("matched", matched).drop("t_video", "t_frame", "t_time")
