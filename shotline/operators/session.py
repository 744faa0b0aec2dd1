"""Sessions: ambiguity and clarification, transcripts, feedback, submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotline.functions import text as T
from shotline.operators.search import ranked


def ambiguity(hits: DataFrame, top: int = 10) -> DataFrame:
    """Per query the share of distinct videos among the top hits (no video counts as one), how close the two
    best scores are, both combined, and whether to ask for a clarification."""
    head = ranked(hits.drop("rank"), "query_id", F.desc(F.round("score", 9)), F.asc("point_id"), k=top)
    agg = head.groupBy("query_id").agg(
        (F.count_distinct(F.coalesce("source_file", F.lit("\u0000"))) / F.count("*")).alias("video_ratio"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
    )
    margin = F.when((F.col("s1") > 0) & F.col("s2").isNotNull(), 1 - F.least(F.greatest((F.col("s1") - F.col("s2")) / F.col("s1"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    both = F.least(F.greatest(0.5 * F.col("video_ratio") + 0.5 * margin, F.lit(0.0)), F.lit(1.0))
    return agg.select("query_id", "video_ratio", margin.alias("margin"), both.alias("ambiguity"), (F.round(both, 9) >= 0.7).alias("ask"))


def clarification_candidates(hits: DataFrame, most: int = 5) -> DataFrame:
    """The best hit of each of the first distinct videos."""
    best = ranked(hits, ["query_id", "source_file"], F.asc("rank"), k=1, name="n").drop("n")
    return ranked(best, "query_id", F.asc("rank"), k=most, name="place")


def clarification_boost(hits: DataFrame, prior: DataFrame, answers: DataFrame, weight: float = 0.5) -> DataFrame:
    """Hits (query_id, point_id, score, rank, text_blob) that were candidates before gain weight * share * top score.

    The share of the answer's words that the hit's text has is shown as overlap, to three places; nothing changes
    without words.  The top score counts as 1 if it isn't above 0.  Equal ones keep their order.
    """
    asked = answers.select("query_id", T.tokens(F.col("answer")).alias("a"))
    rows = hits.join(asked, "query_id", "left").join(prior.select("query_id", "point_id").distinct().withColumn("was", F.lit(True)), ["query_id", "point_id"], "left")
    n = F.size("a")
    share = F.when(F.col("was") & (n > 0), F.size(F.array_intersect("a", T.tokens(F.lower("text_blob")))) / n).otherwise(0.0)
    most = F.max("score").over(Window.partitionBy("query_id"))
    top = F.when(most > 0, most).otherwise(1.0)
    out = rows.withColumn("share", share).withColumn("boosted", F.col("score") + weight * F.col("share") * top).withColumn("overlap", F.round("share", 3)).drop("a", "was", "share")
    return ranked(out.withColumnRenamed("rank", "old_rank"), "query_id", F.desc(F.round("boosted", 9)), F.asc("old_rank"))


def duplicate_videos(submissions: DataFrame) -> DataFrame:
    """Submissions (task, video, ts, id, accepted, forced) with duplicate: the video was accepted for the task before.

    Forced ones and those without a video are never duplicates; a null forced counts as false, a null accepted too.
    """
    before = Window.partitionBy("task", "video").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("accepted").over(before), F.lit(False))
    return submissions.withColumn("duplicate", seen & ~F.coalesce("forced", F.lit(False)) & (F.coalesce("video", F.lit("")) != ""))


def transcript(turns: DataFrame) -> DataFrame:
    """Turns (session_id, turn, query, answer, rejected, accepted): lines of each session in order, empty ones left out."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ")
    parts = F.concat_ws("\n", line("User: ", F.col("query")), line("System: ", F.col("answer")), line("Operator rejected: ", joined(F.col("rejected"))), line("Operator confirmed: ", joined(F.col("accepted"))))
    rows = turns.select("session_id", "turn", parts.alias("t")).filter("t <> ''")
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n").alias("transcript"), F.count("*").alias("n_turns"))


def feedback_lines(feedback: DataFrame, points: DataFrame, most: int = 3, width: int = 120) -> DataFrame:
    """Feedback (session_id, turn, place, point_id, sign) as descriptions: caption, else video, else id; distinct, in order."""
    named = feedback.join(points.select("point_id", "caption", "source_file"), "point_id", "left")
    words = F.coalesce(F.nullif(F.left(F.trim("caption"), F.lit(width)), F.lit("")), F.nullif("source_file", F.lit("")), F.col("point_id").cast("string"))
    rows = named.groupBy("session_id", "turn", "sign").agg(F.array_sort(F.collect_list(F.struct("place", words.alias("w")))).alias("x"))
    return rows.select("session_id", "turn", "sign", F.slice(F.array_distinct(F.transform("x", lambda r: r["w"])), 1, most).alias("lines"))


def model_input(transcripts: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Transcript, query and the numbered candidates of each session as one text, the input of a clarifying question."""
    listed = candidates.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda r: F.concat(r["place"].cast("string"), F.lit(". "), r["line"])), "\n").alias("list"))
    rows = queries.join(transcripts, "session_id", "left").join(listed, "session_id", "left")
    head = F.when(F.coalesce("transcript", F.lit("")) != "", F.concat(F.lit("Conversation:\n"), F.col("transcript")))
    tail = F.when(F.col("list").isNotNull(), F.concat(F.lit("Candidates:\n"), F.col("list")))
    return rows.select("session_id", F.concat_ws("\n\n", head, F.concat(F.lit("Query: "), F.col("query")), tail).alias("input"))


def rewrite_input(transcripts: DataFrame, queries: DataFrame) -> DataFrame:
    """W18, the other form: the history of each session and its latest query, the input of a rewrite; without history only that."""
    rows = queries.join(transcripts.select("session_id", "transcript"), "session_id", "left")
    return rows.select("session_id", F.concat(F.lit("History:\n"), F.coalesce("transcript", F.lit("")), F.lit("\nLatest Query: "), F.coalesce("query", F.lit("")), F.lit("\nRewritten Query:")).alias("input"))


def pending_clarification(turns: DataFrame) -> DataFrame:
    """The clarification that each search uses: the question of the turn before, whatever its type."""
    return turns.withColumn("answers", F.lag("clarification").over(Window.partitionBy("session_id").orderBy("turn")))
