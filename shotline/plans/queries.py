"""Queries of the engine over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotline.functions import ids as I
from shotline.functions import media as M
from shotline.functions import text as T
from shotline.functions import vectors as V
from shotline.operators import blocks, cells, compose, evaluate, fuse, postings, search, session, shots, temporal
from shotline.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from embeddings: a label is a video, its vectors in order of id are every fourth frame, five a scene.

    Places are counted by video and block of ids, so that a video with many frames is many groups; the blocks' sizes
    give where each begins.
    """
    e = table(spark, sf_dir, "embeddings").withColumn("block", F.floor(F.col("vec_id") / 65536))
    sizes = e.groupBy("label", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select(F.col("label").alias("l"), F.col("block").alias("b"), F.coalesce(before, F.lit(0)).alias("begin"))
    e = e.join(begins, e.label.eqNullSafe(F.col("l")) & (F.col("block") == F.col("b")))
    at = F.row_number().over(Window.partitionBy("label", "block").orderBy("vec_id")) - 1 + F.col("begin")
    rows = e.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), "label", at.cast("long").alias("ord"))
    return rows.select(
        "point_id", "vector", "label", F.concat(F.lit("V"), F.lpad(F.col("label").cast("string"), 3, "0"), F.lit(".mp4")).alias("source_file"),
        (F.col("ord") * 4).alias("frame_idx"), F.floor(F.col("ord") / 5).alias("scene_id"), (F.col("ord") * 4 / 25.0).alias("timestamp"), (F.col("point_id") % 11 / 10.0).alias("sharpness"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), F.col("text").alias("text_blob"))


def token_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("doc_id % 100 = 0")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    return rows.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(words, 1, 3), " ").alias("text"))


def placed(hits: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.join(frames(spark, sf_dir).drop("vector"), "point_id")


def r6(name: str) -> F.Column:
    return F.round(name, 6).alias(name)


def _hits(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return search.knn(vectors(spark, sf_dir), frames(spark, sf_dir), k)


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "point_id", r6("score"), "rank")


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frames(spark, sf_dir).filter(F.col("source_file").isin("V001.mp4", "V003.mp4", "V005.mp4"))
    return search.knn(vectors(spark, sf_dir), own, 10).select("query_id", "point_id", r6("score"), "rank")


def knn_by_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").filter("vec_id % 60 = 7").select(F.col("vec_id").alias("point_id"))
    return search.by_example(points, frames(spark, sf_dir), 5).select("query_id", "point_id", r6("score"), "rank")


def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 with an effort of 13 of 16 cells, so that at least 0.9 of the exact best ten are found; cells grow with the frames."""
    index = cells.build(frames(spark, sf_dir))
    hits, _ = cells.search(index, vectors(spark, sf_dir), 10, -(-index.centres.count() * 13 // 16))
    return hits.select("query_id", "point_id", r6("score"), "rank")


def knn_cells_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 without an effort: cells are visited until no other can change the best ten."""
    hits, _ = cells.search(cells.build(frames(spark, sf_dir)), vectors(spark, sf_dir), 10)
    return hits.select("query_id", "point_id", r6("score"), "rank")


def clip_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = vectors(spark, sf_dir).select((F.col("query_id") - F.col("query_id") % 200).alias("query_id"), F.col("query_id").alias("clip_ts"), "vector")
    return search.clip_search(clips, frames(spark, sf_dir), 10).select("query_id", "point_id", r6("score"), "clip_ts", "rank")


def rocchio_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, f = vectors(spark, sf_dir), frames(spark, sf_dir)
    marks = q.select("query_id", F.explode(F.array(*[F.struct((F.col("query_id") + d).alias("point_id"), F.lit(s).alias("sign")) for d, s in ((1, 1), (2, 1), (3, -1))])).alias("m"))
    moved = search.rocchio(q, marks.select("query_id", "m.point_id", "m.sign"), f)
    return search.knn(moved, f, 10).select("query_id", "point_id", r6("score"), "rank")


def truncation_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the full-length best ten that each prefix length finds."""
    q, f = vectors(spark, sf_dir), frames(spark, sf_dir)
    full, out = search.knn(q, f, 10).select("query_id", "point_id"), None
    for dim in (8, 16, 32):
        cut = V.truncate(F.col("vector"), dim)
        part = search.knn(q.withColumn("vector", cut), f.withColumn("vector", cut), 10).join(full, ["query_id", "point_id"])
        row = part.agg(F.count("*").alias("m")).crossJoin(full.agg(F.count("*").alias("n"))).select(F.lit(dim).alias("dim"), F.round(F.col("m") / F.col("n"), 6).alias("recall"))  # one row each
        out = row if out is None else out.union(row)
    return out


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots.shot_vectors(frames(spark, sf_dir).withColumn("text_blob", F.lit(None).cast("string")))
    key = I.shot_key(F.col("source_file"), F.col("scene_id"))
    return s.withColumn("shot_id", key).withColumn("point_id", F.element_at("frame_ids", 1))


def coarse_to_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("shot_id", I.shot_key(F.col("source_file"), F.col("scene_id")))
    return search.coarse_to_fine(vectors(spark, sf_dir), _shots(spark, sf_dir), f, 10, 8).select("query_id", "point_id", r6("score"), "rank")


def shot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: a row for each shot and component of its vector, with its children in order and its text's length."""
    f = frames(spark, sf_dir).join(texts(spark, sf_dir), "point_id", "left")
    s = shots.shot_vectors(f).withColumn("shot_id", I.shot_key(F.col("source_file"), F.col("scene_id")))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    rows = s.select("shot_id", "frame_count", joined("frame_ids").alias("frame_ids"), F.size("timestamps").alias("n_times"), F.md5("text_blob").alias("text_md5"), F.posexplode("vector").alias("component", "x"))
    return rows.withColumn("x", F.round("x", 6))


def scene_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.scene_variance(frames(spark, sf_dir)).select("source_file", "scene_id", "n", r6("variance"), "budget")


def boundary_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = shots.boundary_similarity(frames(spark, sf_dir))
    return b.select("source_file", "scene_id", "next_scene", r6("within"), r6("next_within"), r6("cross"), "weak")


_INDEXES: dict[tuple, postings.Index] = {}


def text_index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The inverted index of the documents, written once a session and then read by every search, as long as the files are the same."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parquet").select("path", "length", "modificationTime")
    stamp = (spark.sparkContext.applicationId, sf_dir, files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())
    if stamp not in _INDEXES:
        _INDEXES[stamp] = postings.build(texts(spark, sf_dir))
    return _INDEXES[stamp]


def _token_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.match(text_index(spark, sf_dir), token_queries(spark, sf_dir))


def token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_hits(spark, sf_dir).select("query_id", "point_id", r6("score"), "rank")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, f = vectors(spark, sf_dir), frames(spark, sf_dir)
    short = V.truncate(F.col("vector"), 16)
    other = search.knn(q.withColumn("vector", short), f.withColumn("vector", short), 20)
    fused = fuse.rrf([search.knn(q, f, 20), other], ["full", "short"])
    return fused.select("query_id", "point_id", r6("score"), F.array_join("matched_via", ",").alias("matched_via"), "rank")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vectors(spark, sf_dir).filter("query_id % 100 = 0")
    return fuse.rrf([search.knn(q, frames(spark, sf_dir), 20), _token_hits(spark, sf_dir)], ["dense", "token"])


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("query_id", "point_id", r6("score"), F.array_join("matched_via", ",").alias("matched_via"), "rank")


def interactive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and token search fused, boosted by coherence, one hit a scene, the first ten."""
    fused = placed(_hybrid(spark, sf_dir), spark, sf_dir)
    best = fuse.diversify(fuse.coherence(fused), 10, "boosted")
    return best.select("query_id", "point_id", "source_file", "scene_id", F.round("boosted", 6).alias("score"), "rank")


def coherence_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.coherence(placed(_hits(spark, sf_dir), spark, sf_dir)).select("query_id", "point_id", r6("score"), r6("boosted"), "rank")


def scene_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.diversify(placed(_hits(spark, sf_dir), spark, sf_dir), 10).select("query_id", "point_id", "source_file", "scene_id", r6("score"), "rank")


def head_tail_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir, 30)
    new = hits.select("query_id", "point_id", (F.col("point_id") * 7 % 13 / 13.0).alias("new_score"))
    return fuse.head_tail(hits, new).select("query_id", "point_id", "old_rank", "rank")


def in_video_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, f = vectors(spark, sf_dir), frames(spark, sf_dir)
    hits = search.knn(q, f, 10).withColumn("score", 1.0 / (60 + F.col("rank")))
    return search.refine_in_videos(q, hits, f, 3, 2).select("query_id", "point_id", r6("score"), "rank")


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries of three event vectors: ids 100 a, 100 a + 1 and 100 a + 2; and them by event."""
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 100 < 3")
    ev = e.select((F.col("vec_id") - F.col("vec_id") % 100).alias("query_id"), (F.col("vec_id") % 100).cast("int").alias("event"), F.col("embedding").alias("vector"))
    return ev, frames(spark, sf_dir)


def temporal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, f = _steps(spark, sf_dir)
    lists = []
    for i in range(3):
        hits = search.knn(ev.filter(F.col("event") == i), f, 40).withColumn("score", F.round(1.0 / (60 + F.col("rank")), 9))
        lists.append(hits.join(f.select("point_id", "source_file", "frame_idx"), "point_id"))
    return temporal.step_chain(temporal.in_every_step(lists)).select("query_id", "source_file", r6("score"), F.concat_ws(",", F.transform("frames", lambda x: x.cast("string"))).alias("frames"), "rank")


def event_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, f = _steps(spark, sf_dir)
    return temporal.align_events(ev, f).select("query_id", "source_file", r6("score"), F.concat_ws(",", F.transform("frames", lambda x: x.cast("string"))).alias("frames"))


def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.ambiguity(placed(_hits(spark, sf_dir), spark, sf_dir)).select("query_id", r6("video_ratio"), r6("margin"), r6("ambiguity"), "ask")


def clarification_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = _token_hits(spark, sf_dir).join(texts(spark, sf_dir), "point_id")
    prior = tok.filter("point_id % 2 = 0").select("query_id", "point_id")
    answers = table(spark, sf_dir, "documents").filter("doc_id % 100 = 1").select((F.col("doc_id") - 1).alias("query_id"), F.col("text").alias("answer"))
    return session.clarification_boost(tok, prior, answers).select("query_id", "point_id", r6("overlap"), r6("boosted"), "rank")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of their user's video, in order of time; places are counted by user and day."""
    e = table(spark, sf_dir, "events").withColumn(blocks.BLOCK, F.floor(F.unix_timestamp("ts") / 86_400))
    before = F.coalesce(F.sum("c").over(blocks.earlier(["user_id"])), F.lit(0))
    e = blocks.carried(e, ["user_id"], [F.count("*").alias("c")], {"before": before})
    at = F.row_number().over(blocks.inside(["user_id"], "ts", "event_id")) - 1 + F.col("before")
    return e.select(F.col("user_id").cast("string").alias("source_file"), at.cast("long").alias("frame_idx"), (F.col("event_id") % 10 / 10.0).alias("prob"), "value", "event_id")


def shot_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.islands(_signals(spark, sf_dir))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("source_file", F.floor(F.col("frame_idx") / 20).alias("scene_id"), F.col("frame_idx").alias("i"), F.round(F.coalesce("value", F.lit(0.0)), 2).alias("size"))


def dake_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.dake_keep(shots.dake_scores(_sizes(spark, sf_dir))).filter("kept").select("source_file", "scene_id", "i", r6("dake"))


def motion_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _sizes(spark, sf_dir).select("source_file", "scene_id", "i", (F.col("i") / 4).alias("timestamp"), F.col("size").alias("energy"))
    return shots.motion_samples(f)


def sharpness_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sizes(spark, sf_dir).select("source_file", "scene_id", "i", F.col("size").alias("raw"))
    return shots.sharpness(rows).select("source_file", "scene_id", "i", r6("sharpness"))


def diverse_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    budget = shots.scene_variance(f).select("source_file", "scene_id", "budget")
    return shots.diverse_keyframes(f.join(budget, ["source_file", "scene_id"]))


def merge_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return shots.merge_scenes(f, shots.scene_times(f), 0.6)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight boxes a vector from all of its 64 components: of each eight, four give corners, one the confidence, three the label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(V.doubles(F.col("embedding")), lambda x: F.round(x, 6)).alias("v"))
    lo, hi = F.array_min("v"), F.array_max("v")
    rows = e.withColumn("c", F.transform("v", lambda x: F.when(hi > lo, F.round((x - lo) / (hi - lo) * 100, 3)).otherwise(0.0)))
    c = lambda k, j: F.col("c")[8 * k + j]
    box = lambda k: F.array(F.least(c(k, 0), c(k, 2)), F.least(c(k, 1), c(k, 3)), F.greatest(c(k, 0), c(k, 2)), F.greatest(c(k, 1), c(k, 3)))
    label = lambda k: F.concat(F.lit("L"), F.when(F.col("v")[8 * k + 5] + F.col("v")[8 * k + 6] + F.col("v")[8 * k + 7] > 0, "1").otherwise("0"))
    det = lambda k: F.struct(label(k).alias("label"), box(k).alias("bbox"), F.col("v")[8 * k + 4].alias("conf"))
    return rows.select("vec_id", F.array(*[det(k) for k in range(8)]).alias("dets"))


def box_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = M.nms(F.col("dets"), 0.3)
    return _boxes(spark, sf_dir).select("vec_id", F.posexplode(kept).alias("place", "d")).select("vec_id", "place", "d.label", F.round("d.conf", 6).alias("conf"))


def _asr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    return e.select(F.col("user_id").cast("string").alias("source_file"), F.col("props").alias("text"), F.unix_timestamp("ts").cast("double").alias("start"), (F.unix_timestamp("ts") + 2).cast("double").alias("end"), "event_id")


def speech_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    f = e.select(F.col("event_id").alias("point_id"), F.col("user_id").cast("string").alias("source_file"), F.unix_timestamp("ts").cast("double").alias("timestamp"))
    return temporal.attach_speech(f, _asr(spark, sf_dir), 3600.0, 7200.0)


def nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir)
    index = s.filter("event_id % 7 = 0").select("source_file", F.col("frame_idx").alias("native_idx"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("name"))
    return temporal.nearest(s.select("source_file", "frame_idx"), index)


def audio_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("source_file")).agg(F.round(F.sum("value"), 2).alias("duration"))
    return temporal.audio_segments(d).select("source_file", r6("start"), r6("end"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    nxt = F.lead(F.struct("role", "text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = c.withColumn("n", nxt).filter("role = 'user'")
    none = F.array().cast("array<string>")
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("turn"), F.col("text").alias("query"), F.when(F.col("n.role") == "assistant", F.col("n.text")).alias("answer"), none.alias("rejected"), none.alias("accepted"))


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.transcript(_turns(spark, sf_dir))


def feedback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type in ('purchase', 'error')")
    fb = e.select(F.col("user_id").alias("session_id"), (F.col("event_id") % 4).cast("int").alias("turn"), F.col("event_id").alias("place"), F.col("event_id").alias("point_id"), F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("sign"))
    points = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), F.when(F.col("doc_id") % 3 == 1, F.regexp_replace("text", r"[^A-Za-z ]", "")).alias("caption"), F.concat(F.lit("V"), F.col("doc_id").cast("string")).alias("source_file"))
    return session.feedback_lines(fb, points).select("session_id", "turn", "sign", F.array_join("lines", "|").alias("lines"))


# Responses of a model as they come: good ones, and each way to break the contract.  {c}: confidence, {u}: user.
RESPONSES = [
    '{{"found": true, "answer": "a{u}", "confidence": {c}}}', "not json", '{{"found": false, "answer": "x", "confidence": 0.5}}',
    '```json\n{{"found": true, "answer": "red", "confidence": 1.5}}\n```', '{{"found": true, "answer": " ", "confidence": 0.5}}',
    '{{"found": true, "answer": "unknown", "confidence": true}}', '{{"found": true, "answer": " na ", "confidence": {c}}}',
    '{{"found": true, "answer": "b{u}", "confidence": "NaN"}}', '{{"found": true, "answer": "c", "confidence": true}}', '[{c}]',
    '```\n{{"found": true, "answer": " d{u}", "confidence": "{c}"}}```', '{{"found": "true", "answer": "e", "confidence": {c}}}',
    '{{"found": true, "answer": {u}, "confidence": {c}}}', '{{"answer": "f", "found": true}}',
]


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, u, raw = (F.col("event_id") % 10 / 10.0).cast("string"), F.col("user_id").cast("string"), F.lit(None).cast("string")
    for k, form in enumerate(RESPONSES):
        text = F.regexp_replace(F.regexp_replace(F.lit(form.replace("{{", "{").replace("}}", "}").replace("{c}", "<c>").replace("{u}", "<u>")), F.lit("<c>"), c), F.lit("<u>"), u)
        raw = F.when(F.col("event_id") % len(RESPONSES) == k, text).otherwise(raw)
    return table(spark, sf_dir, "events").select("event_id", "user_id", raw.alias("raw"))


def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _responses(spark, sf_dir).select("event_id", T.grounded(F.col("raw")).alias("g"))
    return g.select("event_id", "g.valid", "g.answer", r6("g.confidence").alias("confidence"), "g.reason")


def grounding_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.reasons(grounded_answers(spark, sf_dir)).select("reason", "n", r6("mean_confidence"))


def score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("Score: "), (F.col("event_id") % 15 / 10.0).cast("string"), F.lit(" of 1"))
    return table(spark, sf_dir, "events").select("event_id", F.round(T.first_score(raw), 6).alias("score"))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth of a query is its label's video; its own point doesn't count as a hit, nor take a rank."""
    q = vectors(spark, sf_dir)
    others = search.renumbered(_hits(spark, sf_dir, 21).filter("point_id <> query_id"), 20)
    hits = placed(others, spark, sf_dir).select("query_id", "rank", "source_file", "frame_idx", "timestamp")
    video = F.concat(F.lit("V"), F.lpad(F.col("label").cast("string"), 3, "0"), F.lit(".mp4"))
    truth = q.select("query_id", video.alias("source_file"), F.lit(None).cast("long").alias("frame_idx"), F.lit(None).cast("double").alias("timestamp"))
    m = evaluate.metrics(q.select("query_id", (F.col("query_id") % 150 / 50 + 1).cast("int").alias("type"), (F.col("query_id") % 100 == 0).alias("annotated")), temporal.match_truth(hits, truth))
    return m.select("type", "n", *[r6(c) for c in ("recall_1", "recall_5", "recall_10", "recall_20", "mrr", "ndcg_10", "mrr_annotated")])


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("type"), F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return evaluate.latency(t).select("type", "stage", "n", *[r6(c) for c in ("mean", "least", "most", "p50", "p95", "per_second")])


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 5).alias("team"), (F.col("user_id") % 7).alias("task"), F.concat(F.lit("v"), (F.col("event_id") % 20).cast("string")).alias("video"), "ts", F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("correct"), (F.unix_timestamp("ts") % 300).cast("double").alias("t"))


def avs_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _submissions(spark, sf_dir).withColumn("accepted", F.col("correct")).withColumn("forced", F.col("id") % 11 == 0)
    return session.duplicate_videos(s).filter("duplicate").select("id", "task", "video")


def kis_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.kis_scores(_submissions(spark, sf_dir)).select("team", "task", r6("score"))


def avs_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.avs_scores(_submissions(spark, sf_dir)).select("team", "task", r6("score"))


def contest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.avs_scores(_submissions(spark, sf_dir)).withColumnRenamed("task", "category")
    return evaluate.normalised(s).select("team", r6("total"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    key = I.shot_key(F.col("source_file"), F.col("scene_id"))
    return f.select("point_id", key.alias("shot_key"), I.uuid5(key).alias("shot_uuid"))


def text_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """speech segments of good quality; missing confidences pass."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("text"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 10 / 10.0).alias("no_speech_prob"), F.when(F.col("event_id") % 7 > 0, -(F.col("event_id") % 20) / 10.0).alias("avg_logprob"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 30 / 10.0).alias("compression_ratio"))
    return temporal.speech_quality(e).select("event_id")


def token_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1900 + 20).alias("h"), (F.col("event_id") * 7 % 2500 + 30).alias("w"))
    return e.select("event_id", M.aligned_size(F.col("h"), F.col("w"), 3136, 1003520).alias("s")).select("event_id", "s.h", "s.w", "s.tokens")


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 7 * 300 + 200).cast("int").alias("w"), (F.col("vec_id") % 5 * 250 + 100).cast("int").alias("h"))
    x = e.select("vec_id", "h", F.explode(M.tile_starts(F.col("w"), 640, 0.2)).alias("x"))
    return x.select("vec_id", "x", F.explode(M.tile_starts(F.col("h"), 640, 0.2)).alias("y"))


def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    f = frames(spark, sf_dir).groupBy("source_file").agg(F.count("*").alias("n"), F.count_distinct("scene_id").alias("scenes"))
    return f


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, speech and labels of a page as one text."""
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return p.select("page_id", T.join_parts([F.lit(""), title, F.regexp_extract("url", r"://([^/]+)", 1)]).alias("text_blob"))


class Setting(NamedTuple):
    """Tables of a whole search (see compose), derived from embeddings and documents."""

    queries: DataFrame
    events: DataFrame
    frames: DataFrame
    media: DataFrame
    score: compose.Model
    answer: compose.Model


def setting(spark: SparkSession, sf_dir: str) -> Setting:
    """Each 50th vector asks; its next one is the hypothetical description's, its first 16 components the second model's."""
    e = table(spark, sf_dir, "embeddings")
    q = vectors(spark, sf_dir)
    hyde = e.select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("hyde_vector"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    said = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(words, 1, 3), " ").alias("text"), F.array_join(F.slice(words, 4, 2), " ").alias("hyde_text"))
    kind = (F.col("query_id") % 150 / 50 + 1).cast("int")
    queries = q.join(hyde, "query_id", "left").join(said, "query_id", "left").select("query_id", kind.alias("type"), "vector", "text", "hyde_vector", "hyde_text", V.truncate(F.col("vector"), 16).alias("second"), "label")
    queries = search.materialize(queries)
    at = F.col("vec_id") % 50
    events = e.filter(at < 3).select((F.col("vec_id") - at).alias("query_id"), at.cast("int").alias("event"), F.col("embedding").alias("vector")).filter("query_id % 150 = 100")
    f = search.materialize(frames(spark, sf_dir).join(texts(spark, sf_dir), "point_id", "left").withColumn("second", V.truncate(F.col("vector"), 16)))
    media = f.filter("label % 4 <> 3").select(F.col("source_file").alias("name")).distinct()
    p, n = F.col("point_id"), F.col("query_id")
    said_score = F.concat(F.lit("Score: "), (((p * 7 + n) % 11) / 10.0).cast("string"), F.lit(" of 1"))
    score = lambda hits: hits.withColumn("raw", F.when(p % 17 == 0, "no idea").otherwise(said_score))
    good = F.concat(F.lit('{"found": true, "answer": "p'), p.cast("string"), F.lit('", "confidence": '), ((p * 3 % 10) / 10.0).cast("string"), F.lit("}"))
    answer = lambda hits: hits.withColumn("raw", F.when(p % 3 == 1, "sorry").when(p % 3 == 2, '{"found": false}').otherwise(good))
    return Setting(queries, events, f, media, score, answer)


def _pending(s: Setting) -> DataFrame:
    """Each query answers, by its own text, a clarification about its predecessor's best five videos."""
    before = compose.retrieve(s.queries.select(*[c for c in s.queries.columns if c != "label"]), s.frames, 15)
    shown = session.clarification_candidates(before).select((F.col("query_id") + 50).alias("query_id"), "point_id")
    return shown.join(s.queries.select("query_id", F.col("text").alias("answer")), "query_id")


def interactive_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 whole: nested fusion, coherence, scenes, clarification, ambiguity, re-ranking by type."""
    s = setting(spark, sf_dir)
    out = compose.interactive(s.queries, s.events, s.frames, s.media, s.score, s.answer, _pending(s))
    return out.select("query_id", "type", "rank", "item", r6("score"), F.array_join("matched_via", ",").alias("matched_via"), "ask")


def _batch(s: Setting) -> DataFrame:
    return compose.batch(s.queries, s.events, s.frames, s.media, s.score, s.answer)


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked answers of all queries, as K5 writes them."""
    return _batch(setting(spark, sf_dir)).select("query_id", "type", "rank", "answer")


def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query the first answer and how many there are."""
    s = setting(spark, sf_dir)
    out = sinks.batch_results(s.queries.select("query_id", "type"), _batch(s).select("query_id", "rank", "answer"))
    return out.select("query_id", "type", "result", F.size("results").alias("n"))


def evaluation_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of C2's results; the truth of a query is its own frame, of a sequence its three frames."""
    s = setting(spark, sf_dir)
    f = s.frames.select(F.col("point_id").alias("p"), "source_file", "frame_idx", "timestamp")
    spot = s.events.select("query_id", (F.col("query_id") + F.col("event")).alias("p")).join(f, "p").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("frame_idx").alias("frame_id"), "timestamp"))).alias("events"))
    truth = s.queries.select("query_id").join(f, F.col("query_id") == F.col("p")).drop("p").join(spot, "query_id", "left")
    m = compose.replay(s.queries, _batch(s), truth)
    return m.select("type", "n", *[r6(c) for c in ("recall_1", "recall_5", "mrr", "mrr_annotated", "sequence_recall", "in_order")])


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).join(texts(spark, sf_dir), "point_id", "left")
    det = F.array(F.struct(F.concat(F.lit("kind"), F.col("point_id") % 3).alias("label")), F.struct(F.concat(F.lit("kind"), F.col("point_id") % 2).alias("label")))
    return f.select(
        "source_file", F.floor(F.col("frame_idx") / 40).alias("scene_id"), "frame_idx", "timestamp", "vector", (F.col("point_id") * 37 % 101).cast("double").alias("size"),
        F.col("sharpness").alias("raw"), F.col("text_blob").alias("caption"), F.lit("").alias("ocr_text"), F.array(F.concat(F.lit("act"), F.col("point_id") % 5)).alias("actions"), det.alias("dets"),
    )


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 over frames from embeddings; speech from view events, a user being a video; every other video has official shots."""
    c = search.materialize(_candidates(spark, sf_dir))
    scenes = c.select("source_file", "scene_id").distinct().withColumn("official_id", F.when(F.substring("source_file", 4, 1).cast("int") % 2 == 0, F.concat(F.lit("s"), F.col("scene_id"))))
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    video = F.concat(F.lit("V"), F.lpad((F.col("user_id") % 10).cast("string"), 3, "0"), F.lit(".mp4"))
    asr = e.select(video.alias("source_file"), F.col("props").alias("text"), (F.col("event_id") % 4000).cast("double").alias("start"), (F.col("event_id") % 4000 + 2).cast("double").alias("end"))
    meta = c.select("source_file").distinct().withColumn("meta", F.create_map(F.lit("title"), F.concat(F.lit("Title "), F.col("source_file")), F.lit("category"), F.lit(""), F.lit("keywords"), F.lit("frames")))
    return compose.index(c, scenes, asr, meta)


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: the indexed frames."""
    return _index(spark, sf_dir).select("point_id", "source_file", "scene_id", "shot_id", "frame_idx", r6("sharpness"), F.md5("text_blob").alias("text_md5"))


def index_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: the shots above them."""
    return compose.index_shots(_index(spark, sf_dir)).select("point_id", "shot_id", "frame_count", F.md5(F.array_join("frame_ids", ",")).alias("frames_md5"), F.round(V.norm(F.col("vector")), 6).alias("norm"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        interactive_search, knn_exact, knn_filtered, knn_by_example, knn_cells, knn_cells_exact, clip_search, rocchio_search, truncation_recall, coarse_to_fine,
        shot_vectors, scene_variance, boundary_similarity, token_match, rrf_fusion, hybrid_search, coherence_boost, scene_diversify,
        head_tail_rerank, in_video_refine, temporal_chain, event_alignment, ambiguity, clarification_boost, shot_islands, dake_keep,
        motion_sample, sharpness_scaled, diverse_keyframes, merge_boundaries, box_nms, speech_attach, nearest_frame, audio_segments,
        transcript, feedback_lines, grounded_answers, grounding_reasons, score_parse, retrieval_metrics, latency_stats, avs_duplicates,
        kis_score, avs_score, contest_totals, stable_ids, text_quality_filter, token_sizing, tile_grid, collection_counts, search_text,
        interactive_session, batch_search, batch_results, evaluation_replay, index_build, index_shots,
    )
}
