"""Shots, scenes and keyframes from signals and vectors of frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotline.functions import media as M
from shotline.functions import vectors as V
from shotline.operators import blocks
from shotline.operators.search import materialize
from shotline.operators.temporal import interval_join


def islands(probs: DataFrame, least: float = 0.5, span: int = blocks.SPAN) -> DataFrame:
    """(source_file, frame_idx, prob) -> shots: a rise above least starts a new one, but not at the first frame.

    Rises are counted block by block; a block's first frame is compared with the last one of the block before, and counts are
    carried over blocks.
    """
    keys = ["source_file"]
    rows = blocks.cut(probs.select(*keys, "frame_idx", (F.col("prob") > least).alias("high")), "frame_idx", span)
    w = blocks.inside(keys, "frame_idx")
    rows = rows.withColumn("starts", F.coalesce((F.col("high") & (F.lag("high").over(w) == F.lit(False))).cast("int"), F.lit(0)))
    ends = [F.min_by("high", "frame_idx").alias("first"), F.max_by("high", "frame_idx").alias("last"), F.sum("starts").alias("n")]
    edge = F.coalesce((F.col("first") & (F.lag("last").over(blocks.over(keys)) == F.lit(False))).cast("int"), F.lit(0))
    before = F.coalesce(F.sum(F.col("n") + F.col("edge")).over(blocks.earlier(keys)), F.lit(0)) + F.col("edge")
    rows = blocks.carried(rows, keys, ends, {"edge": edge, "before": before})
    rows = rows.withColumn("shot", (F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")).cast("int"))
    return rows.groupBy("source_file", "shot").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))


def shot_seconds(probs: DataFrame, fps: float, least: float = 0.5) -> DataFrame:
    """W6 in seconds: the shots of each video from start to end, the end open; shots without length go.

    A video always has a shot: without a rise it's the whole video.
    """
    ends = probs.groupBy("source_file").agg((F.count("*") / fps).alias("duration"))
    cut = islands(probs, least).join(ends, "source_file").select(
        "source_file", "shot", (F.col("first_frame") / fps).alias("start"), F.least((F.col("last_frame") + 1) / fps, F.col("duration")).alias("end"),
    )
    return cut.filter("end > start")


def stitch(predictions: DataFrame, offset: int = 25, most: int = 50) -> DataFrame:
    """(source_file, chunk_start, valid, preds): the central frames of overlapping windows, without padding."""
    each = predictions.select("source_file", "chunk_start", "valid", F.posexplode("preds").alias("pos", "prob"))
    kept = each.filter((F.col("pos") >= offset) & (F.col("pos") < offset + F.least(F.col("valid"), F.lit(most))))
    return kept.select("source_file", (F.col("chunk_start") + F.col("pos") - offset).alias("frame_idx"), "prob")


SCENE = ["source_file", "scene_id"]


def dake_scores(sizes: DataFrame, reach: int = 3, span: int = blocks.SPAN) -> DataFrame:
    """(source_file, scene_id, i, size) with dake: the summed steepness towards the reach frames before and after.

    A scene is cut into blocks by i; a block gets the last reach sizes before it and the first ones behind it.
    """
    rows = blocks.cut(sizes, "i", span)
    w = blocks.inside(SCENE, "i")
    back = blocks.inside(SCENE, F.desc("i"))
    rows = rows.withColumn("__pos", F.row_number().over(w)).withColumn("__rest", F.row_number().over(back))
    ordered = lambda c: F.array_sort(F.collect_list(F.when(c <= reach, F.struct("i", "size"))))
    summary = [F.max("size").alias("__m"), ordered(F.col("__pos")).alias("__head"), ordered(F.col("__rest")).alias("__tail")]
    over = blocks.over(SCENE)
    near = lambda c, a, b: F.transform(F.array_sort(F.flatten(F.collect_list(c).over(over.rowsBetween(a, b)))), lambda x: x["size"])
    whole = Window.partitionBy(*SCENE)
    rows = blocks.carried(rows, SCENE, summary, {"__before": near("__tail", -reach, -1), "__after": near("__head", 1, reach), "__most": F.max("__m").over(whole)})
    early = lambda g: F.when(F.col("__pos") > g, F.lag("size", g).over(w)).otherwise(F.get("__before", F.size("__before") - 1 - (g - F.col("__pos"))))
    late = lambda g: F.when(F.col("__rest") > g, F.lead("size", g).over(w)).otherwise(F.get("__after", g - F.col("__rest")))
    parts = [F.coalesce(M.steepness(F.col("size"), f(g), g, F.col("__most")), F.lit(0.0)) for g in range(1, reach + 1) for f in (early, late)]
    return rows.withColumn("dake", sum(parts[1:], parts[0])).select(*sizes.columns, "dake")


def dake_keep(scored: DataFrame, share: float = 0.5, gap: int = 4, span: int = blocks.SPAN) -> DataFrame:
    """The best half of each scene, the earlier of equals, plus frames so that no gap exceeds gap; up to two frames all stay.

    Works on blocks of a scene: places and the last frame kept are carried from block to block.
    """
    w, whole = blocks.inside(SCENE, "i"), Window.partitionBy(*SCENE)
    rows = materialize(blocks.cut(scored, "i", span).withColumn("__v", F.round("dake", 9)).withColumn("__pos", F.row_number().over(w) - 1))
    n, before = F.sum("__c").over(whole), F.coalesce(F.sum("__c").over(blocks.earlier(SCENE)), F.lit(0))
    placed = blocks.carried(rows, SCENE, [F.count("*").alias("__c")], {"__size": n, "__before": before})
    placed = placed.withColumn("__most", F.bround(F.col("__size") * share))
    equal = F.coalesce((F.col("__v") == F.col("edge")).cast("int"), F.lit(0))
    marked = materialize(blocks.joined(placed, blocks.last_of_first(placed, SCENE, "__v", "__most"), SCENE, "left").withColumn("__q", equal))
    marked = blocks.carried(marked, SCENE, [F.sum("__q").alias("__n")], {"__ahead": F.coalesce(F.sum("__n").over(blocks.earlier(SCENE)), F.lit(0))})
    place = F.sum("__q").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__ahead")
    top = F.coalesce((F.col("__v") > F.col("edge")) | ((F.col("__q") == 1) & (place <= F.col("left"))), F.lit(False))
    at = F.col("__pos") + F.col("__before")
    marked = materialize(marked.withColumn("__top", top).withColumn("__at", at).withColumn("__own", F.when(F.col("__top"), F.col("__at"))))
    marked = blocks.carried(marked, SCENE, [F.max("__own").alias("__t")], {"__last": F.coalesce(F.max("__t").over(blocks.earlier(SCENE)), F.lit(-1))})
    last = F.coalesce(F.max("__own").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__last"))
    fill = (F.col("__at") - last) % gap == 0
    return marked.withColumn("kept", (F.col("__size") <= 2) | F.col("__top") | fill).select(*scored.columns, "kept")


def sharpness(frames: DataFrame) -> DataFrame:
    """Raw sharpness scaled between a scene's 10th and 90th percentile, clipped; 0.5 where these are equal."""
    cut = frames.groupBy("source_file", "scene_id").agg(F.expr("percentile(raw, array(0.1, 0.9))").alias("p"))
    lo, hi = F.col("p")[0], F.col("p")[1]
    scaled = F.when(hi > lo, F.least(F.greatest((F.col("raw") - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise(0.5)
    return frames.join(cut, ["source_file", "scene_id"]).withColumn("sharpness", F.when(F.col("raw").isNotNull(), scaled)).drop("p")


def scene_variance(frames: DataFrame) -> DataFrame:
    """Mean over dimensions of the population variance, and the keyframe budget it gives."""
    v = array_to_vector(V.doubles(F.col("vector")))
    agg = frames.groupBy("source_file", "scene_id").agg(vector_to_array(Summarizer.variance(v)).alias("var"), F.count("*").alias("n"))
    total = F.aggregate("var", F.lit(0.0), lambda a, x: a + x) / F.size("var")
    variance = F.when(F.col("n") > 1, total * (F.col("n") - 1) / F.col("n")).otherwise(0.0)
    return agg.select("source_file", "scene_id", "n", variance.alias("variance"), M.keyframe_budget(variance).alias("budget"))


def shot_vectors(frames: DataFrame, most_text: int = 8000) -> DataFrame:
    """A4, A5: a row for each (source_file, scene_id): pooled unit vector, child ids and times in order, text."""
    has = F.max(F.col("sharpness").isNotNull()).over(Window.partitionBy("source_file", "scene_id"))
    sharp = F.least(F.greatest(F.coalesce("sharpness", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    weight = F.when(has, 0.75 + 0.25 * sharp).otherwise(1.0)
    rows = frames.withColumn("w", weight).withColumn("f", array_to_vector(V.doubles(F.col("vector"))))
    child = F.array_sort(F.collect_list(F.struct("frame_idx", "point_id", "timestamp", F.coalesce("text_blob", F.lit("")).alias("t"))))
    agg = rows.groupBy("source_file", "scene_id").agg(vector_to_array(Summarizer.mean(F.col("f"), F.col("w"))).alias("m"), child.alias("c"))
    text = F.left(F.array_join(F.filter(F.transform("c", lambda x: x["t"]), lambda t: t != ""), " . "), F.lit(most_text))
    return agg.select(
        "source_file", "scene_id", V.normalise(F.col("m")).alias("vector"), F.transform("c", lambda x: x["point_id"]).alias("frame_ids"),
        F.transform("c", lambda x: x["timestamp"]).alias("timestamps"), F.size("c").alias("frame_count"), text.alias("text_blob"),
    )


def boundary_similarity(frames: DataFrame, least: float = 0.9) -> DataFrame:
    """For each scene and the next of its video: mean cosine within both and across, and whether the boundary is weak.

    Weak: the mean across is at least least of the mean within; where that isn't above 0, never.  One aggregate of unit vectors a scene gives all three means; no frame meets another.
    """
    unit = frames.select("source_file", "scene_id", array_to_vector(V.normalise(F.col("vector"))).alias("u"))
    agg = unit.groupBy("source_file", "scene_id").agg(vector_to_array(Summarizer.sum(F.col("u"))).alias("s"), F.count("*").alias("n"))
    n, s = F.col("n"), F.col("s")
    within = F.when(n > 1, (V.dot(s, s) - n) / (n * (n - 1))).otherwise(1.0)
    w = Window.partitionBy("source_file").orderBy("scene_id")
    nxt = agg.withColumn("within", within).withColumn("b", F.lead(F.struct("scene_id", "s", "n", "within")).over(w)).filter("b is not null")
    cross = V.dot(s, F.col("b.s")) / (n * F.col("b.n"))
    mean = (F.col("within") + F.col("b.within")) / 2
    weak = (mean > 0) & (F.round(cross / F.when(mean > 0, mean), 9) >= least)
    return nxt.select("source_file", "scene_id", F.col("b.scene_id").alias("next_scene"), "within", F.col("b.within").alias("next_within"), cross.alias("cross"), F.coalesce(weak, F.lit(False)).alias("weak"))


def motion_samples(frames: DataFrame, floor: float = 0.05, span: int = blocks.SPAN) -> DataFrame:
    """(source_file, scene_id, i, timestamp, energy): frames at quantiles of the motion, nearest first.

    energy is the motion from a frame to the next one.  As many quantiles as the scene's length asks for (P19) are
    taken of the energies, a floor of their mean added; a sample lies between two frames, in proportion, and goes to
    the nearer one, the earlier if both are as near.  Scenes with no more frames than that stay whole; one without
    motion is sampled evenly.  Null or negative energies count as 0.

    Works on blocks of a scene: sums up to a block, and the frame behind it, are carried over the blocks.
    """
    rows = frames.select(*SCENE, "i", "timestamp", F.greatest(F.coalesce("energy", F.lit(0.0)), F.lit(0.0)).alias("e"))
    rows, w, whole = blocks.cut(rows, "i", span), blocks.inside(SCENE, "i"), Window.partitionBy(*SCENE)
    at = F.struct("i", "timestamp")
    summary = [F.min(at).alias("__first"), F.min("timestamp").alias("__lo"), F.max("timestamp").alias("__hi"), F.count("*").alias("__c")]
    n = M.motion_frames(F.max("__hi").over(whole) - F.min("__lo").over(whole))
    rows = blocks.carried(rows, SCENE, summary, {"__next": F.lead("__first").over(blocks.over(SCENE)), "n": n, "size": F.sum("__c").over(whole)})
    rows = materialize(rows.withColumn("next", F.coalesce(F.lead(at).over(w), F.col("__next"))).drop("__next"))
    moved = F.col("next").isNotNull()
    sums = [F.sum(F.when(moved, F.col("e"))).alias("__e"), F.count(F.when(moved, F.lit(1))).alias("__m")]
    rows = blocks.carried(rows, SCENE, sums, {"mean": F.sum("__e").over(whole) / F.sum("__m").over(whole)})
    mass = F.when(F.col("next").isNull(), 0.0).otherwise(F.greatest(F.col("e") + F.when(F.col("mean") > 0, floor * F.col("mean")).otherwise(1.0), F.lit(1e-8)))
    rows = blocks.carried(rows.withColumn("m", mass), SCENE, [F.sum("m").alias("__s")], {"total": F.sum("__s").over(whole), "__ahead": F.coalesce(F.sum("__s").over(blocks.earlier(SCENE)), F.lit(0.0))})
    upto = F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__ahead")
    rows = rows.withColumn("upto", upto).withColumn("hi", F.round(F.col("upto") / F.col("total"), 9)).withColumn("lo", F.round((F.col("upto") - F.col("m")) / F.col("total"), 9))
    every = rows.filter(F.col("size") <= F.col("n")).select(*SCENE, "i")
    quantiles = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.round((k + 0.5) / F.col("n"), 9))
    inside = F.filter(quantiles, lambda q: (q > F.col("lo")) & (q <= F.col("hi")))
    cut = rows.filter((F.col("size") > F.col("n")) & F.col("next").isNotNull()).withColumn("q", F.explode(inside))
    share = F.least(F.greatest((F.col("q") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8)), F.lit(0.0)), F.lit(1.0))
    picked = cut.select(*SCENE, F.when(F.round(share, 9) <= 0.5, F.col("i")).otherwise(F.col("next.i")).alias("i"))
    return every.unionByName(picked.distinct())


def _picks(batches: Iterator[pa.RecordBatch], weight: float) -> Iterator[pa.RecordBatch]:
    """(source_file, scene_id, point_id, vector, sharpness, budget) in order, scene by scene -> the picks of each whole scene."""
    held: list[pa.RecordBatch] = []  # rows of the scene that isn't over yet
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        names, scenes = b.column("source_file").dictionary_encode().indices.fill_null(-1), b.column("scene_id")
        changes = np.zeros(b.num_rows, dtype=bool)
        for c in (np.asarray(names), np.asarray(scenes.fill_null(0)), np.asarray(scenes.is_null())):
            changes[1:] |= c[1:] != c[:-1]
        changes[0] = (b.column("source_file")[0].as_py(), scenes[0].as_py()) != key
        key = (b.column("source_file")[-1].as_py(), scenes[-1].as_py())
        edges = np.flatnonzero(changes)
        if len(edges) and (held or edges[-1] > 0):
            yield _pick([*held, b.slice(0, edges[-1])], weight)
            held = []
        held.append(b.slice(edges[-1]) if len(edges) else b)
    if held:
        yield _pick(held, weight)


def _pick(parted: list[pa.RecordBatch], weight: float) -> pa.RecordBatch:
    b = pa.Table.from_batches(parted).combine_chunks().to_batches()[0]
    sizes = np.unique(np.asarray(b.column("vector").value_lengths().fill_null(-1)))
    if len(sizes) > 1 or sizes[0] < 0:
        raise ValueError("vectors of a scene that are null or differ in length")
    every = np.asarray(b.column("vector").flatten()).astype(np.float64).reshape(b.num_rows, -1)
    sharpness = np.asarray(b.column("sharpness").cast(pa.float64()).fill_null(0.0))
    budget = np.asarray(b.column("budget").cast(pa.int64()))
    names, scenes = (np.asarray(b.column(c).dictionary_encode().indices.fill_null(-1)) for c in ("source_file", "scene_id"))
    edges = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (scenes[1:] != scenes[:-1])))
    rows, picks = [], []
    for first, last in zip(edges, np.append(edges[1:], b.num_rows), strict=True):
        v, sharp = every[first:last], sharpness[first:last]
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(size > 0, size, 1)
        chosen, near = [0], v @ v[0]
        while len(chosen) < min(int(budget[first]), len(v)):
            gain = np.round(1 - near + weight * sharp, 9)
            gain[chosen] = -np.inf
            chosen.append(int(gain.argmax()))
            near = np.maximum(near, v @ v[chosen[-1]])
        rows.append(first + np.array(chosen))
        picks.append(np.arange(len(chosen), dtype=np.int32))
    taken = b.select(["source_file", "scene_id", "point_id"]).take(pa.array(np.concatenate(rows)))
    return pa.record_batch([*taken.columns, pa.array(np.concatenate(picks))], ["source_file", "scene_id", "point_id", "pick"])


def diverse_keyframes(frames: DataFrame, weight: float = 0.15) -> DataFrame:
    """(source_file, scene_id, point_id, frame_idx, vector, sharpness, budget): greedy farthest picks, the first frame seeded.

    Greedy by nature: a scene is picked from in one task; scenes are short, and there are many, so a task reads them in order and takes
    those of an Arrow batch together.
    """
    rows = frames.select("source_file", F.col("scene_id").cast("long").alias("scene_id"), F.col("point_id").cast("long").alias("point_id"), "frame_idx", "vector", "sharpness", "budget")
    ordered = rows.repartition("source_file", "scene_id").sortWithinPartitions("source_file", "scene_id", "frame_idx", "point_id").drop("frame_idx")
    return ordered.mapInArrow(lambda batches: _picks(batches, weight), "source_file string, scene_id long, point_id long, pick int")


def scene_times(frames: DataFrame) -> DataFrame:
    """(source_file, scene_id, start, end) of contiguous scenes: each ends where the next begins, the last at its last frame."""
    agg = frames.groupBy("source_file", "scene_id").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("last"))
    return agg.select("source_file", "scene_id", "start", F.coalesce(F.lead("start").over(Window.partitionBy("source_file").orderBy("scene_id")), "last").alias("end"))


def merge_scenes(frames: DataFrame, scenes: DataFrame, least: float = 0.9, window: float = 1.5, samples: int = 3) -> DataFrame:
    """Contiguous scenes of a video merged left to right while the boundary between two is weak, again after each merge.

    frames: (source_file, timestamp, vector); scenes: (source_file, scene_id, start, end).  Returns (source_file,
    scene_id, merged).  A boundary is tested on up to samples frames within window seconds on either side, as far as
    the two (merged) scenes reach: it's weak if the mean cosine across is at least least of the mean within (1 for a
    single frame), that mean above 0 and neither side empty.

    A scene of at least window seconds hides what lies behind it from a boundary, so boundaries on either side of it
    don't depend on each other.  Runs of boundaries between such scenes are the groups that are merged in sequence.
    """
    video = Window.partitionBy("source_file").orderBy("scene_id")
    cuts = scenes.select("source_file", "scene_id", "start", "end", F.lead("end").over(video).alias("end_next"), F.sum(F.when(F.col("end") - F.col("start") >= window, 1).otherwise(0)).over(video).alias("run"))
    cuts = cuts.filter("end_next is not null")
    near = cuts.select("source_file", "scene_id", F.col("end").alias("cut"), F.explode(F.array(*[F.floor(F.col("end") / window) + d for d in (-1, 0, 1)])).alias("bucket"))
    unit = frames.select("source_file", "timestamp", V.normalise(F.col("vector")).alias("u"), F.floor(F.col("timestamp") / window).alias("bucket"))
    both = near.join(unit, ["source_file", "bucket"]).filter((F.col("timestamp") >= F.col("cut") - window) & (F.col("timestamp") < F.col("cut") + window))
    both = both.withColumn("late", F.col("timestamp") >= F.col("cut"))
    place = F.row_number().over(Window.partitionBy("source_file", "scene_id", "late").orderBy(F.abs(F.col("timestamp") - F.col("cut")), "timestamp"))
    beside = both.withColumn("n", place).filter(F.col("n") <= samples).groupBy("source_file", "scene_id").agg(F.sort_array(F.collect_list(F.struct("timestamp", "late", "u"))).alias("s"))
    rows = cuts.join(beside, ["source_file", "scene_id"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("scene_id").reset_index(drop=True)
        start, end, end_next = (pdf[c].to_numpy() for c in ("start", "end", "end_next"))

        def weak(i: int, begin: float, finish: float) -> bool:
            s = [] if pdf["s"][i] is None else pdf["s"][i]
            a = np.array([x["u"] for x in s if not x["late"] and x["timestamp"] >= begin])
            b = np.array([x["u"] for x in s if x["late"] and x["timestamp"] < finish])
            if not len(a) or not len(b):
                return False
            within = sum((np.square(x.sum(0)).sum() - len(x)) / (len(x) * (len(x) - 1)) if len(x) > 1 else 1.0 for x in (a, b)) / 2
            return within > 0 and round(float((a @ b.T).mean() / within), 9) >= least

        left, before = list(range(len(pdf))), None
        while left != before:
            before, k = list(left), 0
            while k < len(left):
                begin = start[left[k - 1] + 1] if k else start[0]
                finish = end[left[k + 1]] if k + 1 < len(left) else end_next[-1]
                if weak(left[k], begin, finish):
                    del left[k]
                else:
                    k += 1
        return pdf.drop(index=left)[["source_file", "scene_id"]]

    weak = rows.groupBy("source_file", "run").applyInPandas(run, "source_file string, scene_id long").withColumn("weak", F.lit(1))
    marked = scenes.select("source_file", "scene_id").join(weak, ["source_file", "scene_id"], "left")
    strong_before = F.sum(F.lit(1) - F.coalesce("weak", F.lit(0))).over(video.rowsBetween(Window.unboundedPreceding, -1))
    return marked.select("source_file", "scene_id", F.coalesce(strong_before, F.lit(0)).cast("long").alias("merged"))


def frame_step(frames: DataFrame, scenes: DataFrame, fps: float, rate: float) -> DataFrame:
    """every n-th frame of each scene (source_file, scene_id, start, end in seconds), n = fps / rate, at least 1."""
    step = max(1, int(fps / rate))
    spans = scenes.withColumn("__lo", F.floor(F.col("start") * fps)).withColumn("__hi", F.floor(F.col("end") * fps) - 1)
    both = interval_join(frames, spans, ["source_file"], "frame_idx", "__lo", "__hi", 64)
    return both.filter((F.col("frame_idx") - F.col("__lo")) % step == 0).drop("__lo", "__hi")


def attach_keyframes(shots: DataFrame, files: DataFrame) -> DataFrame:
    """Shots (source_file, shot_id, start, end) with keyframe, a name of files (source_file, name), or null.

    Where a video has as many keyframes as shots, the n-th by name belongs to the n-th by start; else a shot gets the
    one name whose stem contains its id, whatever the case; none if no or several names do.
    """
    order = lambda *c: F.row_number().over(Window.partitionBy("source_file").orderBy(*c))
    of = lambda df, name: df.groupBy("source_file").agg(F.count("*").alias(name))
    s, f = shots.withColumn("n", order("start", "end", "shot_id")), files.select("source_file", "name").withColumn("n", order("name"))
    counted = s.join(of(shots, "shots"), "source_file").join(of(files, "files"), "source_file", "left")
    even = F.col("shots") == F.col("files")
    by_place = counted.filter(even).join(f, ["source_file", "n"], "left").select(*shots.columns, F.col("name").alias("keyframe"))
    rest = counted.filter(~F.coalesce(even, F.lit(False)))
    stem = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    hit = rest.join(files.select("source_file", "name"), "source_file").filter(F.contains(stem, F.lower("shot_id")))
    one = hit.groupBy("source_file", "n").agg(F.count("*").alias("hits"), F.min("name").alias("keyframe")).filter("hits = 1").drop("hits")
    return by_place.unionByName(rest.join(one, ["source_file", "n"], "left").select(*shots.columns, "keyframe"))


def on_regions(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """frames (with point_id) that have a proposed region; without one, a frame gets no detections and no OCR."""
    return frames.join(regions.select("point_id").distinct(), "point_id", "left_semi")
