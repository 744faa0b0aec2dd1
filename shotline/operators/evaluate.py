"""Evaluation of retrieval and of contests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotline.functions import text as T
from shotline.functions.hooks import similarity
from shotline.operators.temporal import interval_join


def metrics(queries: DataFrame, matched: DataFrame) -> DataFrame:
    """Queries (query_id, type, annotated), matched (query_id, rank, matched): recall, MRR and nDCG over all queries of a type."""
    first = matched.filter("matched").groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = queries.join(first, "query_id", "left")
    recall = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    reciprocal = F.coalesce(1.0 / F.col("first"), F.lit(0.0))
    gain = F.when(F.col("first") <= 10, 1.0 / F.log2(F.col("first") + 1.0)).otherwise(0.0)
    return rows.groupBy("type").agg(
        F.count("*").alias("n"), recall(1).alias("recall_1"), recall(5).alias("recall_5"), recall(10).alias("recall_10"), recall(20).alias("recall_20"),
        F.avg(reciprocal).alias("mrr"), F.avg(gain).alias("ndcg_10"), F.avg(F.when(F.col("annotated"), reciprocal)).alias("mrr_annotated"),
    )


def coverage(hits: DataFrame, k: int = 10) -> DataFrame:
    """Unique videos and the share of repeated ones among each query's first k hits."""
    head = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count_distinct("source_file").alias("videos"), F.count("*").alias("n"))
    return head.select("query_id", "videos", (1 - F.col("videos") / F.col("n")).alias("duplicate_rate"))


def sequences(found: DataFrame, truth: DataFrame, within: int = 5, seconds: float = 3.0) -> DataFrame:
    """Found (query_id, rank, source_file, frames, times), truth (query_id, source_file, events array<struct<frame_id, timestamp>>).

    Per query of truth: the rank of the first sequence in the true video (video_rank), the share of true events that
    this sequence has a frame or, where the event or the sequence has no frames, a time near (sequence_recall, null
    without events), and whether its times rise (in_order, null for fewer than two).  All null if no sequence is there.
    """
    ours = found.join(truth.select("query_id", "source_file"), ["query_id", "source_file"], "left_semi")
    first = ours.groupBy("query_id").agg(F.min_by(F.struct("rank", "frames", "times"), "rank").alias("s"))
    rows = truth.select("query_id", "events").join(first, "query_id", "left").select("query_id", "events", F.col("s.rank").alias("video_rank"), F.filter("s.frames", lambda f: f.isNotNull()).alias("frames"), F.col("s.times").alias("times"))
    by_frame = lambda e: F.exists("frames", lambda f: F.abs(f - e["frame_id"]) <= within)
    by_time = lambda e: F.exists("times", lambda t: F.abs(t - e["timestamp"]) <= seconds)
    near = lambda e: F.coalesce(F.when(e["frame_id"].isNotNull() & (F.size("frames") > 0), by_frame(e)).otherwise(by_time(e)), F.lit(False))
    recall = F.when((F.size("events") > 0) & F.col("video_rank").isNotNull(), F.size(F.filter("events", near)) / F.size("events"))
    pairs = F.zip_with(F.slice("times", 1, F.greatest(F.size("times") - 1, F.lit(0))), F.slice("times", 2, F.greatest(F.size("times"), F.lit(0))), lambda a, b: a < b)
    return rows.select("query_id", "video_rank", recall.alias("sequence_recall"), F.when(F.size("times") > 1, F.forall(pairs, lambda x: F.coalesce(x, F.lit(False)))).alias("in_order"))


def evidence(candidates: DataFrame, media: DataFrame) -> DataFrame:
    """Candidates (source_file, raw: the model's response) with the checked answer.

    A candidate whose file isn't in media (name) is frame_unavailable: no answer, score 0, whatever the response says.
    Adds evidence, vqa_valid, vqa_answer (UNKNOWN if invalid), vqa_score, vqa_reason (grounded if valid).
    """
    there = media.select(F.col("name").alias("source_file")).distinct().withColumn("evidence", F.lit(True))
    rows = candidates.join(there, "source_file", "left").withColumn("evidence", F.coalesce("evidence", F.lit(False))).withColumn("g", T.grounded(F.col("raw")))
    valid = F.col("evidence") & F.col("g.valid")
    reason = F.when(~F.col("evidence"), "frame_unavailable").when(F.col("g.valid"), "grounded").otherwise(F.col("g.reason"))
    return rows.select(
        *[c for c in candidates.columns if c != "raw"], "evidence", valid.alias("vqa_valid"), F.when(valid, F.col("g.answer")).otherwise("UNKNOWN").alias("vqa_answer"),
        F.when(valid, F.col("g.confidence")).otherwise(0.0).alias("vqa_score"), reason.alias("vqa_reason"),
    )


def latency(trace: DataFrame) -> DataFrame:
    """Trace (type, stage, seconds): mean, least, most, percentiles and rate."""
    return trace.groupBy("type", "stage").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("most"), F.expr("percentile(seconds, 0.5)").alias("p50"), F.expr("percentile(seconds, 0.95)").alias("p95"), (F.count("*") / F.sum("seconds")).alias("per_second"))


#: Share of ranks that a sketch's percentile may be off; with SKETCH_K entries a level the sketch's own bound is below it.
RANK_ERROR, SKETCH_K = 0.02, 400


def latency_sketches(trace: DataFrame, keys: list[str] | None = None, every: str = "1 hour") -> DataFrame:
    """Trace (*keys, seconds, ts) as KLL sketches, a row for each key and hour: n and sketch; works on streams with a watermark, too.

    Sketches of hours can be kept and merged later (merged_latency), where exact percentiles would need all rows again.  Seconds that are null or
    NaN don't count.
    """
    keys = ["stage"] if keys is None else keys
    rows = trace.filter(F.col("seconds").isNotNull() & ~F.isnan("seconds"))
    return rows.groupBy(*keys, F.window("ts", every).alias("hour")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("seconds").cast("double"), SKETCH_K).alias("sketch"))


def merged_latency(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n, hours, p50, p95) of kept sketches, merged."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.count_distinct("hour").alias("hours"), F.kll_merge_agg_double("sketch").alias("s"))
    at = lambda q: F.kll_sketch_get_quantile_double(F.col("s"), F.lit(q))
    return merged.select(*keys, "n", "hours", at(0.5).alias("p50"), at(0.95).alias("p95"))


def reasons(checked: DataFrame) -> DataFrame:
    """How often each outcome of the grounding contract occurs."""
    return checked.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


def yes_ratio(answers: DataFrame) -> DataFrame:
    """(query_id, point_id, raw): share of answers that begin with YES."""
    return answers.groupBy("query_id", "point_id").agg(F.avg(F.upper(F.trim("raw")).startswith("YES").cast("double")).alias("ratio"))


def rerank_score(scored: DataFrame, ratios: DataFrame | None = None, kind: int = 1) -> DataFrame:
    """Blend of parsed score (null: 0), fused score and verification ratio (no questions: 1)."""
    own = F.coalesce("parsed", F.lit(0.0))
    if ratios is None:
        score = own if kind == 1 else 0.4 * F.col("score") + 0.6 * own
        return scored.withColumn("rerank_score", score)
    r = F.coalesce("ratio", F.lit(1.0))
    score = 0.7 * own + 0.3 * r if kind == 1 else 0.3 * F.col("score") + 0.5 * own + 0.2 * r
    return scored.join(ratios, ["query_id", "point_id"], "left").withColumn("rerank_score", score).drop("ratio")


def kis_scores(submissions: DataFrame, limit: float = 300.0) -> DataFrame:
    """G1: (team, task, id, t, correct): 50 + (300 - t) / 6 - 10 for each wrong one before the first right one; 0 if none is right."""
    w = Window.partitionBy("team", "task").orderBy("t", "id")
    wrong = F.sum((~F.col("correct")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = submissions.withColumn("wrong", wrong)
    first = rows.filter("correct").groupBy("team", "task").agg(F.min(F.struct("t", "id", "wrong")).alias("x"))
    score = F.greatest(F.lit(0.0), 50 + (limit - F.col("x.t")) / 6 - 10 * F.col("x.wrong"))
    return submissions.select("team", "task").distinct().join(first, ["team", "task"], "left").select("team", "task", F.coalesce(score, F.lit(0.0)).alias("score"))


def avs_scores(submissions: DataFrame) -> DataFrame:
    """(team, task, video, correct): 1000 * max(sum over videos of (right - 0.2 * wrong) / N, 0); N: distinct right videos of all teams."""
    per = submissions.groupBy("team", "task", "video").agg(F.max(F.col("correct").cast("int")).alias("c"), F.sum((~F.col("correct")).cast("int")).alias("i"))
    n = submissions.filter("correct").groupBy("task").agg(F.count_distinct("video").alias("n"))
    each = per.groupBy("team", "task").agg(F.sum(F.col("c") - 0.2 * F.col("i")).alias("x")).join(n, "task", "left")
    return each.select("team", "task", F.when(F.col("n") > 0, 1000 * F.greatest(F.col("x") / F.col("n"), F.lit(0.0))).otherwise(0.0).alias("score"))


def normalised(scores: DataFrame) -> DataFrame:
    """Scores (team, category, score) scaled to 1000 in each category and summed."""
    most = F.max("score").over(Window.partitionBy("category"))
    return scores.withColumn("s", F.when(most > 0, 1000 * F.col("score") / most).otherwise(0.0)).groupBy("team").agg(F.sum("s").alias("total"))


def submissions_on_shots(submissions: DataFrame, shots: DataFrame, width: float = 60.0) -> DataFrame:
    """The shot (source_file, shot_id, start, end) that holds each submitted time, by an interval join; the end is open.

    Submissions in no shot have a null shot_id; equal rows count once.
    """
    spans = shots.select("source_file", "shot_id", F.col("start").alias("__start"), F.col("end").alias("__end"))
    found = interval_join(submissions, spans, ["source_file"], "t", "__start", "__end", width).filter(F.col("t") < F.col("__end"))
    every = submissions.withColumn("shot_id", F.lit(None).cast(shots.schema["shot_id"].dataType)).unionByName(found.drop("__start", "__end"))
    return every.groupBy(*submissions.columns).agg(F.min("shot_id").alias("shot_id"))


def failures(truth: DataFrame, hits: DataFrame, submissions: DataFrame, k: int = 100) -> DataFrame:
    """Each query as solved, retrieved but not submitted, or never retrieved."""
    seen = hits.filter(F.col("rank") <= k).join(truth, ["query_id", "source_file"], "left_semi").select("query_id").distinct().withColumn("seen", F.lit(True))
    sent = submissions.join(truth, ["query_id", "source_file"], "left_semi").select("query_id").distinct().withColumn("sent", F.lit(True))
    rows = truth.select("query_id").distinct().join(seen, "query_id", "left").join(sent, "query_id", "left")
    return rows.select("query_id", F.when(F.col("sent"), "solved").when(F.col("seen"), "not_submitted").otherwise("never_retrieved").alias("outcome"))


def token_budgets(runs: DataFrame) -> DataFrame:
    """(image, budget, estimate, measured as text, seconds, caption): means a budget.

    Measured tokens that aren't numbers don't count.  similarity: of a caption to that of the image's highest budget,
    to three places.
    """
    best = runs.groupBy("image").agg(F.max_by("caption", F.struct("budget", "caption")).alias("best"))
    rows = runs.join(best, "image").withColumn("similarity", F.round(similarity(F.col("caption"), F.col("best")), 3))
    return rows.groupBy("budget").agg(
        F.avg("estimate").alias("mean_estimate"), F.avg(F.col("measured").try_cast("double")).alias("mean_measured"), F.avg("seconds").alias("mean_seconds"),
        F.avg("similarity").alias("mean_similarity"), F.count("*").alias("n"),
    )
